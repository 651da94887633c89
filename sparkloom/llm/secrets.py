"""Secret scans over an incremental ledger of blobs.

A text is a blob, named by the SHA-256 of its UTF-8 bytes; every path (here: row) that ever held it is one of its versions.
The ledger is a table of (blob, rule_version, findings). A run names the blobs of its input, takes those that the ledger
lacks at this rule version, scans each once, adds them to the ledger, and joins findings back to all rows of each blob.

Scanning: kind by kind, leftmost matches that don't overlap, then those that fail their kind's test are dropped. Letters of
the assign rule's names are ASCII letters in either case. Spans count code points, end exclusive.

Defined results: a null text is empty; rows with equal texts share one scan and get a row each; an empty table scans
nothing; further columns are kept by scan() and don't clash with its own, which begin with two underscores until the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

#: kind: pattern, the group whose length counts, its least length. The first three are the base rules.
RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),  # the runs of 32 and more among all runs
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"), 0, 0),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"), 0, 32),
    "forge": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = hashlib.sha256(repr([(k, p.pattern, p.flags, g, n) for k, (p, g, n) in RULES.items()]).encode()).hexdigest()[:16]
LEDGER = "blob string, rule_version string, findings array<struct<kind:string,start:bigint,end:bigint>>"


def findings(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then in the order of RULES."""
    found = [(m.start(), at, kind, m.end()) for at, (kind, (rule, group, least)) in enumerate(RULES.items()) for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame({"blob": df["__blob"], "rule_version": RULE_VERSION, "findings": [[{"kind": k, "start": s, "end": e} for k, s, e in findings(t)] for t in df["__text"]]})


def scan(docs: DataFrame, text: str = "text", ledger: str | None = None) -> DataFrame:
    """docs with __findings, all spans of each row's text. ledger: the table's folder, made or extended; None: a new one.

    Texts travel once, to their blob's name, where equal ones become one; a task merges its own before it sends them, so a blob
    that a third of all rows hold arrives once for each task. Findings that aren't empty are few; the join back leaves the
    texts where they are if Spark finds those small enough to broadcast.
    """
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    blob = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(ledger)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    blobs = docs.select(blob.alias("__blob"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    if there:
        seen = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == RULE_VERSION).select(F.col("blob").alias("__blob"))
        blobs = blobs.join(seen, "__blob", "left_anti")
    # One task of the scan sees each blob once: equal texts are merged before and after the shuffle by its name.
    once = blobs.groupBy("__blob").agg(F.first("__text").alias("__text"))
    once.mapInPandas(_scan, LEDGER).write.mode("append").parquet(ledger)
    found = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("rule_version") == RULE_VERSION) & (F.size("findings") > 0))
    # A repeated append adds nothing. Written, the few blobs with findings are a table whose size Spark knows.
    found = written(found.groupBy(F.col("blob").alias("__blob")).agg(F.first("findings").alias("__findings")), "findings")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return docs.withColumn("__blob", blob).join(found, "__blob", "left").withColumn("__findings", F.coalesce("__findings", empty)).drop("__blob")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", ledger: str | None = None) -> DataFrame:
    """key, the base kinds' counts, base_sha256 and spans of each row."""
    df = scan(docs.select(key, text), text, ledger)
    words = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("__findings", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("__findings", lambda s: s["kind"].isin(*BASE))
    return df.select(key, *[count(k) for k in BASE], F.sha2(words(base).cast("binary"), 256).alias("base_sha256"), words(F.col("__findings")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", ledger: str | None = None, mask: str = "[SECRET]", changed: str | None = None) -> DataFrame:
    """docs with each found span of the text replaced by the mask; overlapping spans are one. Null texts stay null. changed: a column that says whether there were any."""
    df = scan(docs, text, ledger)
    t = F.col(text)
    merged = F.aggregate(
        "__findings", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(t.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))).alias("out"), s["end"].alias("at"))),
        lambda a: F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), F.length(t))),
    )
    any_found = F.size("__findings") > 0
    df = df.withColumns({text: F.when(any_found, merged).otherwise(t), **({changed: any_found} if changed else {})})
    return df.drop("__findings")
