import os
import shutil
import subprocess
import sys

from .conftest import ROOT


def test_without_the_corpus_operators(tmp_path):
    """A copy without the corpus operators, with and without their pipeline, still has all else."""
    for name in ("seekstone", "jobs", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(src) else shutil.copy
        copy(src, tmp_path / name)
    shutil.rmtree(tmp_path / "seekstone" / "llm")
    code = "import __spark_entry__ as e, seekstone.cli; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and 'job1_refresh_windows' in q and set(o) <= set(q) and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=60)
        if (tmp_path / "corpus_pipeline.py").exists():
            os.remove(tmp_path / "corpus_pipeline.py")
