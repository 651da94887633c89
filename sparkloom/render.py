"""Results as text: table, csv, json, ndjson, yaml and raw. All but the table are written row by row as Spark hands them over."""

from __future__ import annotations

import csv
import datetime
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

FORMATS = ("table", "csv", "json", "ndjson", "yaml", "raw")


def plain(v: object) -> object:
    """A value as JSON has it."""
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep="T") + ("Z" if v.tzinfo is None else "")
    if isinstance(v, datetime.timedelta):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v if isinstance(v, (int, float, str, bool)) or v is None else str(v)


def cell(v: object) -> str:
    v = plain(v)
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def rows(df: DataFrame) -> Iterator[tuple]:
    return (tuple(r) for r in df.toLocalIterator())


def lines(df: DataFrame, how: str = "table") -> Iterator[str]:
    names = df.columns
    if how == "table":
        held = [[cell(v) if v is not None else "NULL" for v in r] for r in rows(df)]
        wide = [max(len(n), *(len(r[i]) for r in held)) if held else len(n) for i, n in enumerate(names)]
        rule = "+".join("-" * (w + 2) for w in wide)
        yield " | ".join(n.ljust(w) for n, w in zip(names, wide, strict=True)).rstrip()
        yield rule
        for r in held:
            yield " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip()
        yield f"({len(held)} row{'' if len(held) == 1 else 's'})"
    elif how == "csv":
        for r in [names] if names else []:
            yield _csv(r)
        for r in rows(df):
            yield _csv([cell(v) for v in r])
    elif how == "json":
        yield "["
        last = None
        for r in rows(df):
            if last is not None:
                yield last + ","
            last = "  " + json.dumps(dict(zip(names, map(plain, r), strict=True)), ensure_ascii=False)
        if last is not None:
            yield last
        yield "]"
    elif how == "ndjson":
        for r in rows(df):
            yield json.dumps(dict(zip(names, map(plain, r), strict=True)), ensure_ascii=False)
    elif how == "yaml":
        for r in rows(df):
            for i, (n, v) in enumerate(zip(names, r, strict=True)):
                yield f"{'- ' if not i else '  '}{n}: {json.dumps(plain(v), ensure_ascii=False)}"
    elif how == "raw":
        for r in rows(df):
            yield "\t".join(cell(v) for v in r)
    else:
        raise ValueError(f"unknown format {how}; there are {', '.join(FORMATS)}")


def _csv(values: list) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


def export(df: DataFrame, path: str, how: str = "parquet", partition_by: list[str] | None = None) -> None:
    """The rows as files, written by executors."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(header=True).format(how).save(path)
