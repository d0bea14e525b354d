"""What the jobs share: configuration files and their sessions."""

from __future__ import annotations

import json
import logging
from dataclasses import fields

from pyspark.sql import SparkSession


def read_config(cls, path: str | None):
    """A configuration from a JSON file; unknown names are an error, missing ones have their defaults."""
    if path is None:
        return cls()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := set(given) - {x.name for x in fields(cls)}:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return cls(**given)


def start(name: str) -> SparkSession:
    """The session of a command line, with logging to stderr."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
