"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard draws a number for every key, and the key goes to the shard with the highest draw, so a new shard can only take
keys to itself. Draws are a cubic polynomial modulo the prime 2**31 - 1 in the two halves of the key's MD5, with
coefficients that follow from the shard's number; a weight w turns the uniform draw u into ln(u) / w. All of it is
DataFrame expressions.

Defined results: a null key is a key like any other (written as the empty string); rows that repeat a key share its shard
and get a slot each; a null text has no bytes (size 16, CRC 0); an empty table gives an empty result; further columns of the
input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PRIME = 2**31 - 1
SHARDS = 40
#: Slots are numbered within bins of a shard; the bins' first slots are a table of at most shards * BINS rows. Equal rows are
#: spread again RUN at a time.
BINS, RUN = 1024, 100_000


def coefficients(shard: int) -> tuple[int, int]:
    """Of a shard's draws; those of other shards play no part, so shards can be added."""
    digest = hashlib.md5(f"shard {shard}".encode()).hexdigest()
    return int(digest[:8], 16) % (PRIME - 1) + 1, int(digest[8:16], 16) % (PRIME - 1) + 1


def with_shard(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", grown: str | None = None, added_weight: float = 1.0) -> DataFrame:
    """df with the shard of its key among len(weights) shards; grown: also the one among those and one more."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % PRIME

    def draws(shards: Sequence[tuple[int, float]]) -> Column:
        known = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"), F.lit(float(w)).alias("w")) for i, w in shards for a, b in [coefficients(i)]])

        def draw(s: Column) -> Column:
            x = (F.col("__k1") * s["a"] + F.col("__k2") * s["b"]) % PRIME
            z = (x * x % PRIME * x + F.col("__k2")) % PRIME
            return F.struct((F.log((z + 1) / F.lit(float(PRIME + 1))) / s["w"]).alias("score"), (-s["i"]).alias("less"))

        return F.array_max(F.transform(known, draw))

    df = df.withColumns({"__k1": half(1), "__k2": half(9)}).withColumn("__best", draws(list(enumerate(weights))))
    df = df.withColumn(out, -F.col("__best.less"))
    if grown:
        more = draws([(len(weights), added_weight)])
        df = df.withColumn(grown, F.when(more["score"] > F.col("__best.score"), F.lit(len(weights))).otherwise(F.col(out)))
    return df.drop("__k1", "__k2", "__best")


def assign_slots(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """A row for each row of docs: key, size, text_crc32, law, shard, grown_shard, and slot, gapless from 0 within the shard.

    Equal rows are counted before they are shuffled, and numbered by spreading each count again, in runs of RUN rows at most,
    which are dealt out where there is more than one; so neither a hot key nor a large shard lands in one task or in one
    row. The numbering follows (bin, key, CRC, size).
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    counted = with_shard(rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("__n")), key, weights, "shard", "grown_shard")
    counted = written(counted.withColumn("__bin", ((F.col("text_crc32") + F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))) % BINS).cast("int")), "sharding")
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.groupBy("shard", "__bin").agg(F.sum("__n").alias("__n")).select("shard", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__bin").orderBy(key, "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__from", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    placed = placed.join(F.broadcast(bins), ["shard", "__bin"])  # at most shards * BINS rows of 20 bytes
    placed = placed.withColumn("__first", F.col("__first") + F.col("__from"))
    upto = F.col("__first") + F.col("__n")
    if (counted.agg(F.max("__n")).first()[0] or 0) > RUN:
        runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / RUN)))
        placed = placed.withColumn("__upto", upto).withColumn("__run", runs).withColumn("__first", F.col("__first") + F.col("__run") * RUN)
        placed, upto = placed.repartition("shard", "__bin", "__run"), F.least("__upto", F.col("__first") + RUN)
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.explode(F.sequence(F.col("__first"), upto - 1)).alias("slot"), F.col("grown_shard").cast("int"))


def oracle_sql(shards: int = SHARDS) -> str:
    """The same rows in DuckDB SQL: the draws again, and CRC-32 by its usual table of 256."""
    drawn = ", ".join(f"({i}, {a}, {b})" for i in range(shards + 1) for a, b in [coefficients(i)])
    crc = lambda x: f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda y: CAST('0x' || y AS BIGINT))), lambda c, y: xor(tab[xor(c, y) % 256 + 1], c >> 8)), 4294967295)"
    step = "(CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)"
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: {step})) AS tab),
shards(i, a, b) AS (VALUES {drawn}),
keys AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, {crc("coalesce(CAST(doc_id AS VARCHAR), '')")} AS key_crc, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM (SELECT DISTINCT doc_id FROM documents), tab),
halves AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {PRIME} AS k1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % {PRIME} AS k2 FROM keys),
drawn AS (SELECT doc_id, i, k2, (k1 * a + k2 * b) % {PRIME} AS x FROM halves, shards),
scored AS (SELECT doc_id, i, (((x * x) % {PRIME}) * x + k2) % {PRIME} AS z FROM drawn),
best AS (SELECT doc_id, arg_max(i, z * 64 - i) FILTER (i < {shards}) AS shard, arg_max(i, z * 64 - i) AS grown_shard FROM scored GROUP BY doc_id),
rows AS (SELECT d.doc_id, CAST(strlen(coalesce(d.text, '')) + 16 AS BIGINT) AS size, CAST({crc("coalesce(d.text, '')")} AS BIGINT) AS text_crc32 FROM documents d, tab)
SELECT r.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY (text_crc32 + key_crc) % {BINS}, r.doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM rows r JOIN best b ON r.doc_id IS NOT DISTINCT FROM b.doc_id JOIN keys k ON r.doc_id IS NOT DISTINCT FROM k.doc_id"""
