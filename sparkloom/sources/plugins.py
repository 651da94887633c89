"""Sources of the user's own, on Spark's Python data source API: columns, rows and, if wanted, partitions and filters.

    register("ticks", [("n", "bigint")], lambda options, part, filters: ((i,) for i in range(10)))

rows is called by executors with the spec's options, one of the partitions, and the filters that Spark pushed, as tuples
(operator, column, value); it may use them to read less, since Spark applies them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from . import OPENERS, Spec

NAMES = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNull: "is null", IsNotNull: "is not null", StringStartsWith: "starts with", StringEndsWith: "ends with", StringContains: "contains"}


def encoded(f: object) -> tuple | None:
    """A pushed filter as a tuple, or None if it has no such form."""
    if isinstance(f, Not):
        inner = encoded(f.child)
        return ("not", inner) if inner else None
    if type(f) in NAMES and len(f.attribute) == 1:
        return (NAMES[type(f)], f.attribute[0], getattr(f, "value", None))
    return None


def register(name: str, columns, rows: Callable, partitions: Callable | None = None) -> None:
    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options, self.filters = options, []

        def partitions(self):
            return [InputPartition(p) for p in (partitions(self.options) if partitions else [None])]

        def read(self, partition):
            for r in rows(self.options, partition.value, self.filters):
                yield tuple(r)

    class PushingReader(Reader):
        def pushFilters(self, filters):
            for f in filters:
                if (e := encoded(f)) is not None:
                    self.filters.append(e)
                yield f

    class Source(DataSource):
        @classmethod
        def name(cls):
            return f"sparkloom_plugin_{name}"

        def schema(self):
            cols = columns(dict(self.options)) if callable(columns) else columns
            return ", ".join(f"`{n}` {t}" for n, t in cols)

        def reader(self, schema):
            return (PushingReader if self.options.get("push_") == "true" else Reader)(dict(self.options))

    def open_(spark, spec: Spec, base: str):
        from .files import pushes

        spark.dataSource.register(Source)
        return spark.read.format(f"sparkloom_plugin_{name}").options(path_=spec.path, push_=pushes(spark), **{k: str(v) for k, v in spec.options.items()}).load()

    OPENERS[name.lower()] = open_
