"""Reductions for showing: pivots, series of charts, calendars, edges of graphs and paths as trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"sum": lambda c: F.sum(c.cast("double")), "count": lambda c: F.count(F.lit(1)), "avg": F.avg, "min": F.min, "max": F.max}
COLUMNS, ROWS = 60, 300


def _value(how: str, value: str | None):
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how}")
    return AGGREGATES[how](F.col(value) if value else F.lit(1))


def pivot(df: DataFrame, rows: str, columns: str, how: str = "count", value: str | None = None, max_columns: int = COLUMNS, max_rows: int = ROWS) -> DataFrame:
    """A row for each value of rows, a column for each of columns; as much of both as a page shows, the first in order."""
    heads = [r[0] for r in df.select(columns).distinct().orderBy(columns).limit(max_columns).collect()]
    return df.groupBy(rows).pivot(columns, heads).agg(_value(how, value)).orderBy(rows).limit(max_rows)


def long_pivot(df: DataFrame, rows: str, columns: str, how: str = "count", value: str | None = None) -> DataFrame:
    """The pivot's cells as rows, all of them."""
    return df.groupBy(rows, columns).agg(_value(how, value).alias("value"))


def series(df: DataFrame, x: str, how: str = "sum", value: str | None = None, by: str | None = None) -> DataFrame:
    """x, series, value: what a chart draws."""
    keys = [F.col(x).alias("x"), F.col(by).cast("string").alias("series") if by else F.lit(value or how).alias("series")]
    return df.groupBy(*keys).agg(_value(how, value).alias("value"))


def calendar(df: DataFrame, time: str, how: str = "count", value: str | None = None, zone: str = "UTC") -> DataFrame:
    """day (of the zone), value."""
    return df.groupBy(F.to_date(F.from_utc_timestamp(F.col(time), zone)).alias("day")).agg(_value(how, value).alias("value"))


def edges(df: DataFrame, source: str, target: str) -> DataFrame:
    """source, target, weight."""
    return df.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target")).agg(F.count("*").alias("weight"))


def nodes(pairs: DataFrame) -> DataFrame:
    """node, out_degree, in_degree of edges."""
    both = pairs.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select("target", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def path_tree(df: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """node, parent, depth, n of every prefix of the paths."""
    steps = F.filter(F.split(F.col(path), f"\\Q{separator}\\E"), lambda s: s != "")
    found = df.select(steps.alias("s")).filter(F.size("s") > 0).select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"))
    upto = lambda n: F.array_join(F.slice("s", F.lit(1), n), separator)
    return found.select(upto(F.col("depth")).alias("node"), F.nullif(upto(F.col("depth") - 1), F.lit("")).alias("parent"), "depth").groupBy("node", "parent", "depth").agg(F.count("*").alias("n"))
