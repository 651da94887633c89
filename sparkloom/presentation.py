"""Queries of the presentation operators, the log reader and the streaming extension over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pivots
from .sources import Spec, logs


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    return e.select(F.concat_ws(" ", F.concat(F.lit("level="), F.upper("event_type")), F.concat(F.lit("user="), F.col("user_id").cast("string")), F.concat(F.lit('msg="took '), F.col("value").cast("string"), F.lit('"'))).alias("value"))


QUERIES = {
    "pivot": (lambda s, d: pivots.pivot(_table(s, d, "orders"), "o_orderpriority", "o_orderstatus"), "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1"),
    "pivot_long": (lambda s, d: pivots.long_pivot(_table(s, d, "orders"), "o_orderpriority", "o_orderstatus", "sum", "o_totalprice"), "SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2"),
    "chart_series": (lambda s, d: pivots.series(_table(s, d, "events"), "user_id", "avg", "value", "event_type"), "SELECT user_id AS x, event_type AS series, avg(value) AS value FROM events GROUP BY 1, 2"),
    "calendar": (lambda s, d: pivots.calendar(_table(s, d, "events"), "ts").withColumn("day", F.col("day").cast("string")), "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS value FROM events GROUP BY 1"),
    "graph_edges": (lambda s, d: pivots.edges(_table(s, d, "events"), "user_id", "event_type"), "SELECT CAST(user_id AS VARCHAR) AS source, event_type AS target, count(*) AS weight FROM events GROUP BY 1, 2"),
    "graph_nodes": (lambda s, d: pivots.nodes(pivots.edges(_table(s, d, "events"), "user_id", "event_type")), "WITH e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS source, event_type AS target FROM events) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY 1"),
    "log_logfmt": (lambda s, d: logs.frame(_log_lines(s, d), Spec("log", "", {"format": "logfmt"})).groupBy("level", "user").agg(F.count("msg").alias("n")), 'SELECT upper(event_type) AS level, user_id AS "user", count(*) AS n FROM events GROUP BY 1, 2'),
    "log_pattern": (lambda s, d: logs.frame(_log_lines(s, d), Spec("log", "", {"pattern": r"level=(?P<level>\w+) user=(?P<who>\d+) msg=\"took (?P<took>[\d.eE-]+)\""})).groupBy("level").agg(F.max("took").alias("slowest"), F.count("raw").alias("unparsed")), "SELECT upper(event_type) AS level, max(value) AS slowest, CAST(0 AS BIGINT) AS unparsed FROM events GROUP BY 1"),
}
