"""Quality rules with adaptive thresholds from mergeable quantile sketches, by DataFrame expressions alone.

The sketch of a signal is a histogram over buckets whose width is at most a sixteenth of their values (exact below 32), by
integer arithmetic: two sketches merge by adding counts, in any order, with the same result every time. Sketches are made
for each (lang, source), and merged into one for each language and one for all.

A document fails the verdict if a signal lies beyond its group's fence. The upper fence is the larger of the group's 99th
percentile and median + FENCE * (90th percentile - median), so that less than one percent of a group fails by a signal, and
none where the tail goes on as the bulk lets expect; mean word length has a lower fence of the same form. No fence has a
fixed part: where nearly all of a group agree in a value, who is beyond it fails; the same counts may pass in one source and
fail in another. A percentile is taken as the far end of its bucket, so a fence is at most a sixteenth too far out, never too
near. In a group of fewer than TAIL documents the 99th percentile is the largest value and nobody could fail; such a group
takes the fences of its language, and a language of so few those of all.

Defined results: a null or empty text has no words, lines or symbols and fails the base rules; a null language or source is
a group like any other; repeated rows each get a row; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: One document in TAIL may lie beyond a percentile that is a fence; the bulk's distance that is still no outlier.
TAIL, FENCE = 100, 3
#: Signals in thousandths: name, SQL of the value, whether low values fail too.
SIGNALS = (
    ("symbols", "n_symbols * 1000 DIV greatest(word_chars, 1)", False),
    ("repeats", "n_repeat_words * 1000 DIV greatest(n_words, 1)", False),
    ("dup_lines", "n_dup_lines * 1000 DIV greatest(n_lines, 1)", False),
    ("word_chars", "word_chars * 1000 DIV greatest(n_words, 1)", True),
)
#: The first value of a bucket, in SQL.
START = "CASE WHEN {b} < 32 THEN {b} ELSE shiftleft({b} % 16 + 16, CAST({b} DIV 16 - 1 AS INT)) END"


def with_counts(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """key and more, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text.

    For the repeats, the three-word windows are sorted by hash with their places; neighbours of equal hash are compared by
    their words, so a collision can't make a repeat. Each step is a projection of its own: an array that a lambda reads must
    be a column, not an expression to evaluate for every element.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    shown = lambda chars: F.length(F.translate(F.col("__t"), chars, ""))
    df = docs.select(key, *more, t.alias("__t"))
    df = df.select(
        key, *more, F.filter(F.split("__t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("__w"), shown(" \t\n\x0b\x0c\r").cast("bigint").alias("word_chars"), (F.length("__t") - shown("#*$%&|<>")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "").alias("__lines"),
    )
    df = df.select(key, *more, "__w", "word_chars", "n_symbols", F.size("__w").cast("bigint").alias("n_words"), F.size("__lines").cast("bigint").alias("n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"))
    word = lambda i: F.get(F.col("__w"), i)
    windows = F.when(F.size("__w") >= 3, F.transform(F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(1))), lambda w, i: F.struct(F.xxhash64(w, word(i + 1), word(i + 2)).alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (word(a["i"]) == word(b["i"])) & (word(a["i"] + 1) == word(b["i"] + 1)) & (word(a["i"] + 2) == word(b["i"] + 2)), F.lit(False))

    at = lambda j: F.get(F.col("__s"), j)
    df = df.withColumn("__p", F.sort_array(F.transform(F.filter("__s", lambda s, j: same(s, at(j + 1)) | same(s, at(j - 1))), lambda s: s["i"])))
    new = F.transform("__p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("__p"), j + 1) - p, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(new, F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("__w", "__s", "__p", "__lines")


def sketches(df: DataFrame) -> DataFrame:
    """lang, source, signal, bucket, n: the histogram of every signal in every group."""
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("signal"), F.expr(sql).alias("v")) for name, sql, _ in SIGNALS]))
    df = df.select("lang", "source", values.alias("x")).select("lang", "source", "x.signal", F.col("x.v").alias("v"))
    df = df.withColumn("e", F.expr("greatest(length(bin(v)) - 5, 0)"))
    return df.groupBy("lang", "source", "signal", F.expr("CAST(e * 16 + shiftright(v, e) AS BIGINT)").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, size, and a lower and an upper fence for each signal, from the sketches merged over all but by."""
    merged = sketch.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "signal")
    run = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "size": F.sum("n").over(w)})
    start, end = F.expr(START.format(b="bucket")), F.expr(START.format(b="(bucket + 1)")) - 1
    at = lambda part, of, value: F.min(F.when(F.col("upto") * of >= F.col("size") * part, value))
    found = run.groupBy(*by, "signal").agg(
        F.max("size").alias("size"), at(1, TAIL, start).alias("p1"), at(1, 10, start).alias("p10"), at(1, 2, start).alias("low"), at(1, 2, end).alias("high"), at(9, 10, end).alias("p90"), at(TAIL - 1, TAIL, end).alias("p99"),
    )
    hi, lo = F.greatest("p99", F.col("low") + FENCE * (F.col("p90") - F.col("low"))), F.least("p1", F.col("high") - FENCE * (F.col("high") - F.col("p10")))
    out = []
    for name, _, below in SIGNALS:
        here = F.col("signal") == name
        out += [F.max(F.when(here, hi)).alias(f"{name}_hi")] + [F.max(F.when(here, lo)).alias(f"{name}_lo")] * below
    return found.groupBy(*by).agg(F.max("size").alias("size"), *out)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A row for each row of docs: key, the counts, base_failed and kept. Texts are read once; what follows sees the counts."""
    docs = docs.select(F.col(key), F.col(text), F.col(lang).alias("lang"), F.col(source).alias("source"))
    counts = written(with_counts(docs, key, text, "lang", "source"), "quality")
    sketch = written(sketches(counts), "quality-sketch")
    names = [f"{name}_{end}" for name, _, low in SIGNALS for end in ("hi", *["lo"] * low)]
    fine = fences(sketch, ["lang", "source"]).filter(F.col("size") >= TAIL)
    mid = fences(sketch, ["lang"]).filter(F.col("size") >= TAIL)
    near = lambda f, by, p: f.select(*[F.col(b).alias(f"{p}_{b}") for b in by], *[F.col(n).alias(f"{p}_{n}") for n in names])
    df = counts.join(near(fine, ["lang", "source"], "f"), F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    df = df.join(near(mid, ["lang"], "m"), F.col("lang").eqNullSafe(F.col("m_lang")), "left")
    whole = fences(sketch, []).first() or dict.fromkeys(names)  # one row
    bad = F.lit(False)
    for name, sql, low in SIGNALS:
        fence = lambda end, name=name: F.coalesce(*[F.col(f"{p}_{name}_{end}") for p in "fm"], F.lit(whole[f"{name}_{end}"]).cast("bigint"))
        bad = bad | (F.expr(sql) > fence("hi"))
        if low:
            bad = bad | (F.expr(sql) < fence("lo"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~bad).alias("kept"))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    names = [(name, sql.replace("DIV", "//"), low) for name, sql, low in SIGNALS]
    long = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS signal, {sql} AS v FROM counts" for name, sql, _ in names)
    start = lambda b: f"CASE WHEN {b} < 32 THEN {b} ELSE ({b} % 16 + 16) << ({b} // 16 - 1) END"

    def level(at: str, by: str) -> str:
        keys, part = (f"{by}, ", f"PARTITION BY {by}, signal") if by else ("", "PARTITION BY signal")
        ends = ", ".join(f"max(greatest(p99, low + {FENCE} * (p90 - low))) FILTER (signal = '{name}') AS {name}_hi" + f", max(least(p1, high - {FENCE} * (high - p10))) FILTER (signal = '{name}') AS {name}_lo" * low for name, _, low in names)
        quantile = lambda value, q, of, name: f"min({value}) FILTER (upto * {of} >= size * {q}) AS {name}"
        found = ", ".join(quantile(*x) for x in (("first", 1, TAIL, "p1"), ("first", 1, 10, "p10"), ("first", 1, 2, "low"), ("last", 1, 2, "high"), ("last", 9, 10, "p90"), ("last", TAIL - 1, TAIL, "p99")))
        return f"""{at}_m AS (SELECT {keys}signal, bucket, sum(n) AS n FROM sketch GROUP BY {keys}signal, bucket),
{at}_r AS (SELECT {keys}signal, {start('bucket')} AS first, {start('(bucket + 1)')} - 1 AS last, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS size FROM {at}_m),
{at}_q AS (SELECT {keys}signal, max(size) AS size, {found} FROM {at}_r GROUP BY {keys}signal),
{at} AS (SELECT {keys}max(size) AS size, {ends} FROM {at}_q {f'GROUP BY {by}' if by else ''})"""

    fence = lambda name, end: f"coalesce(f.{name}_{end}, m.{name}_{end}, a.{name}_{end})"
    bad = " OR ".join(f"{sql} > {fence(name, 'hi')}" + f" OR {sql} < {fence(name, 'lo')}" * low for name, sql, low in names)
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return rf"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
dup AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, sum(least(3, coalesce(j - i, 3))) AS n FROM dup GROUP BY r),
counts AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM split LEFT JOIN rep USING (r)),
long AS ({long}),
sketch AS (SELECT lang, source, signal, e * 16 + (v >> e) AS bucket, count(*) AS n FROM (SELECT *, greatest(length(bin(v)) - 5, 0) AS e FROM long) GROUP BY ALL),
{level('f', 'lang, source')}, {level('m', 'lang')}, {level('a', '')}
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND NOT ({bad}) AS kept
FROM counts c LEFT JOIN f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source AND f.size >= {TAIL}
LEFT JOIN m ON c.lang IS NOT DISTINCT FROM m.lang AND m.size >= {TAIL} CROSS JOIN a"""
