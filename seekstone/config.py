"""Settings of indexing, chunking and embedding."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

DEFAULT_MODEL = "hashing-384"
INDEX_DIR = ".seekstone"

# Fixed value: the version of chunks that indexes of this kind agree on.
CHUNKER_VERSION = 3

# The directories, suffixes and languages that indexes of this kind agree on.
EXCLUDED_DIRS = (".git", INDEX_DIR, "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", "eval_repos", ".tox", "egg-info")
EXCLUDED_EXTENSIONS = (".pyc", ".pyo", ".so", ".dll", ".dylib", ".exe", ".bin", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz", ".lock")
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".md": "markdown", ".markdown": "markdown"}


@dataclass(frozen=True)
class Settings:
    """All tunables; frozen, so that it travels to workers by closure."""

    # The defaults that indexes of this kind agree on.
    embedding_model: str = DEFAULT_MODEL
    embedding_batch_size: int = 32
    max_chunk_tokens: int = 2000
    module_window_tokens: int = 400
    module_overlap_tokens: int = 50
    window_lines: int = 60
    overlap_lines: int = 10
    header_imports: int = 10
    default_k: int = 5
    index_buckets: int = 64
    dedupe_module_tail: bool = False
    class_heritage: bool = False
    excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS
    excluded_extensions: tuple[str, ...] = EXCLUDED_EXTENSIONS

    def chunk_fingerprint(self) -> str:
        """Changes with everything that changes chunks."""
        own = {k: v for k, v in asdict(self).items() if k not in ("embedding_model", "embedding_batch_size", "default_k", "index_buckets")}
        return hashlib.sha256(json.dumps([CHUNKER_VERSION, own], sort_keys=True).encode()).hexdigest()[:16]
