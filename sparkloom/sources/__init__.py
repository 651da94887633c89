"""Sources: a prefix and a path, opened as a DataFrame. Readers of files are Spark's wherever it has one.

OPENERS has the built-in prefixes; register_source adds one. An opener takes (spark, spec, base) and returns a DataFrame whose
reading is left to executors.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans.tree import DialectError


@dataclass
class Spec:
    prefix: str
    path: str
    options: dict = field(default_factory=dict)

    @staticmethod
    def of(ref: str, options: dict | None = None) -> Spec:
        prefix, sep, path = ref.partition(":")
        if not sep or not prefix.isidentifier():
            raise DialectError(f"not a prefix and a path: {ref}")
        return Spec(prefix.lower(), ref if prefix.lower() in ("http", "https") else path, dict(options or {}))

    def flag(self, name: str, default: bool = False) -> bool:
        return str(self.options.get(name, default)).lower() in ("1", "true", "yes")


Opener = Callable[[SparkSession, Spec, str], DataFrame]
OPENERS: dict[str, Opener] = {}


def opener(*prefixes: str) -> Callable[[Opener], Opener]:
    def put(f: Opener) -> Opener:
        for p in prefixes:
            OPENERS[p] = f
        return f

    return put


def located(path: str, base: str) -> str:
    """A path as Spark reads it: relative ones are under base; those with a scheme stay."""
    if "://" in path or os.path.isabs(path):
        return path
    return os.path.join(base, path) if "://" in base else os.path.abspath(os.path.join(base, path))


def load(spark: SparkSession, spec: Spec, base: str = ".") -> DataFrame:
    if spec.prefix not in OPENERS:
        raise DialectError(f"unknown source {spec.prefix}:")
    return OPENERS[spec.prefix](spark, spec, base)


def register_source(name: str, columns: list[tuple[str, str]] | Callable, rows: Callable, partitions: Callable | None = None) -> None:
    """A source of the user's own under a prefix, read by Spark's Python data source API; see plugins."""
    from .plugins import register

    register(name, columns, rows, partitions)


from . import files, logs, plugins, remote, transcripts  # noqa: E402, F401
