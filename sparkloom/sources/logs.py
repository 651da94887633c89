"""Log files: a format found on the first lines, then one parse of every line by Spark's expressions.

Each format but JSON and logfmt is a regular expression with named groups. A line that doesn't fit keeps its text in raw and
has NULL elsewhere. Columns and their types follow from all lines, in one pass of executors: a column is integers, floats or
booleans if all its values are, so no value is lost; times are TIMESTAMP_NTZ. The sample only tells the format.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tree import DialectError
from . import Spec, located, opener

SAMPLE, SHARE = 200, 0.7
#: The layouts of common log formats, tried in this order.
FORMATS = {
    "combined": r'^(?P<host>\S+) (?P<ident>\S+) (?P<user>\S+) \[(?P<time>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d{3}|-) (?P<bytes>\d+|-) "(?P<referer>[^"]*)" "(?P<user_agent>[^"]*)".*$',
    "common": r'^(?P<host>\S+) (?P<ident>\S+) (?P<user>\S+) \[(?P<time>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d{3}|-) (?P<bytes>\d+|-)\s*$',
    "syslog": r"^(?:<(?P<priority>\d+)>)?(?P<time>[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (?P<host>\S+) (?P<app>[^\s:\[]+)(?:\[(?P<pid>\d+)\])?: (?P<message>.*)$",
    "bracketed": r"^\[(?P<time>[^\]]*\d[^\]]*)\]\s*\[?(?P<level>[A-Za-z]+)?\]?\s*(?:\[(?P<component>[^\]]+)\])?:?\s*(?P<message>.*)$",
    "leveled": r"^(?P<time>\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?)\s+\[?(?P<level>(?i:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL))\]?:?\s+(?P<message>.*)$",
}
_PAIR = re.compile(r'([A-Za-z_][\w.\-]*)=("(?:[^"\\]|\\.)*"|\S*)')
TIME_NAMES = ("time", "ts", "timestamp")


def is_json(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def is_logfmt(line: str) -> bool:
    return len(_PAIR.findall(line)) >= 2 and not _PAIR.sub("", line).strip()


def detect(lines: list[str]) -> str:
    """The first format that SHARE of the lines have: json, combined, common, syslog, bracketed, logfmt, leveled or raw."""
    lines = [x for x in lines if x.strip()]
    tests = {"json": is_json, **{k: re.compile(v).match for k, v in FORMATS.items()}, "logfmt": is_logfmt}
    for name in ("json", "combined", "common", "syslog", "bracketed", "logfmt", "leveled"):
        if lines and sum(bool(tests[name](x)) for x in lines) >= SHARE * len(lines):
            return name
    return "raw"


#: Texts of a type, from the narrowest.
KINDS = (("bigint", r"^[+-]?\d{1,18}$"), ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), ("boolean", r"^(?i:true|false)$"))


def kinds(text: Column) -> list[Column]:
    """Aggregates: whether all values of a column are of each type; NULL without any."""
    return [F.bool_and(text.rlike(rx)) for _, rx in KINDS]


def typed(text: Column, flags: list[bool | None]) -> Column:
    kind = next((k for (k, _), flag in zip(KINDS, flags, strict=True) if flag), None)
    return text.try_cast(kind) if kind else text


def as_time(c: Column) -> Column:
    """Of ISO texts, access logs' times, syslog's (without a year: this one) and epoch seconds."""
    iso = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ",", "."), "/", "-"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    zoned = F.when(iso.rlike(r"^\d{4}-.*:.*(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(iso).cast("timestamp_ntz"))
    plain = F.when(iso.rlike(r"^\d{4}-\d"), iso.try_cast("timestamp_ntz"))
    access = F.try_to_timestamp(c, F.lit("dd/MMM/yyyy:HH:mm:ss Z")).cast("timestamp_ntz")
    syslog = F.try_to_timestamp(F.concat_ws(" ", F.year(F.current_date()).cast("string"), F.regexp_replace(c, " +", " ")), F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz")
    epoch = F.when(c.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_micros((c.cast("double") * 1000000).cast("bigint")).cast("timestamp_ntz"))
    return F.coalesce(zoned, plain, access, syslog, epoch)


def by_pattern(df: DataFrame, pattern: str, access: bool = False) -> DataFrame:
    """Columns of the named groups, and raw for lines without a match."""
    try:
        rx = re.compile(pattern)
    except re.error as e:
        raise DialectError(f"bad pattern: {e}") from None
    if not rx.groupindex:
        raise DialectError("a pattern needs named groups")
    java, line = re.sub(r"\(\?P<\w+>", "(", pattern), F.col("value")
    fits = line.rlike(java)
    # Spark's regexp_extract counts groups, so every one is found by its number
    texts: dict[str, Column] = {}
    for name, n in sorted(rx.groupindex.items(), key=lambda x: x[1]):
        text = F.when(fits, F.nullif(F.nullif(F.regexp_extract(line, java, n), F.lit("")), F.lit("-")))
        if name == "request" and access:
            texts |= {part: F.get(F.split(text, " "), F.lit(k)) for k, part in enumerate(("method", "path", "protocol"))}
        else:
            texts[name] = text
    free = [n for n in texts if n not in TIME_NAMES and not (access and n in ("method", "path", "protocol"))]
    flags = iter(df.agg(*[x for n in free for x in kinds(texts[n])]).first() if free else ())
    found = {n: [next(flags) for _ in KINDS] for n in free}
    return df.select(*[(as_time(t) if n in TIME_NAMES else typed(t, found[n]) if n in found else t).alias(n) for n, t in texts.items()], F.when(~fits, line).alias("raw"))


def by_pairs(df: DataFrame) -> DataFrame:
    """logfmt: a column for each key of any line, in the order of their first places in a line, then by name. Of a key's values in a line, the first counts."""
    line = F.col("value")
    names = F.regexp_extract_all(line, F.lit(_PAIR.pattern), F.lit(1))
    values = F.transform(F.regexp_extract_all(line, F.lit(_PAIR.pattern), F.lit(2)), lambda v: F.nullif(F.when(v.startswith('"'), F.regexp_replace(v, '^"|"$', "")).otherwise(v), F.lit("")))
    df = df.select("value", names.alias("__names"), values.alias("__values"))
    each = df.select(F.posexplode(F.arrays_zip("__names", "__values"))).select("pos", F.col("col.__names").alias("name"), F.col("col.__values").alias("text"))
    keys = sorted(each.groupBy("name").agg(F.min("pos").alias("at"), *kinds(F.col("text"))).collect(), key=lambda r: (r["at"], r["name"]))  # a row for each column
    cols = []
    for name, _, *flags in keys:
        text = F.get("__values", (F.array_position("__names", name) - 1).cast("int"))
        text = F.when(F.array_contains("__names", name), text)
        cols.append((as_time(text) if name in TIME_NAMES else typed(text, flags)).alias(name))
    return df.select(*cols, F.when(F.size("__names") == 0, line).alias("raw"))


def frame(lines: DataFrame, spec: Spec) -> DataFrame:
    """Rows of a DataFrame of lines (value)."""
    lines = lines.filter(F.trim("value") != "")
    if "pattern" in spec.options:
        return by_pattern(lines, spec.options["pattern"])
    form = spec.options.get("format") or detect([r["value"] for r in lines.limit(SAMPLE).collect()])
    if form == "raw":
        return lines.select(F.col("value").alias("raw"))
    if form == "json":
        from .files import json_rows

        ok = F.try_parse_json("value").isNotNull()
        good = json_rows(lines.filter(ok & F.trim("value").startswith("{")))
        return good.unionByName(lines.filter(~(ok & F.trim("value").startswith("{"))).select(F.col("value").alias("raw")), allowMissingColumns=True)
    if form == "logfmt":
        return by_pairs(lines)
    if form not in FORMATS:
        raise DialectError(f"unknown log format {form}")
    return by_pattern(lines, FORMATS[form], form in ("combined", "common"))


@opener("log")
def log(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    return frame(spark.read.text(located(spec.path, base)), spec)
