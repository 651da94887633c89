"""CSV, JSON, YAML, Excel, Parquet, and SQL databases."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tree import DialectError
from . import Spec, located, opener


@opener("csv")
def csv(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    """The first row names the columns. A column is integers, floats, booleans or text, by all its values; an empty cell is NULL; short rows are filled."""
    never = "'no such date'yyyy"
    df = spark.read.options(header=True, inferSchema=True, sep=spec.options.get("delimiter", ","), nullValue="", mode="PERMISSIVE", timestampFormat=never, timestampNTZFormat=never, dateFormat=never, multiLine=spec.flag("multiline"), escape='"').csv(located(spec.path, base))
    return widened(df)


def widened(df: DataFrame) -> DataFrame:
    """Integers of any width as 64 bits, floats as doubles."""
    wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
    return df.select(*[F.col(f"`{n}`").cast(wide.get(t, "double" if t.startswith("decimal") else t)).alias(n) if t in wide or t.startswith("decimal") else F.col(f"`{n}`") for n, t in df.dtypes])


@opener("parquet")
def parquet(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    return spark.read.parquet(located(spec.path, base))


@opener("json")
def json_(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    """An array of objects, or an object a line; by the first character. Columns are sorted."""
    path = located(spec.path, base)
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "value string")
    array = first[0]["value"].lstrip("﻿ \t")[:1] == "["
    whole = array or first[0]["value"].strip() == "{"
    df = spark.read.option("multiLine", whole).json(path)
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def json_rows(df: DataFrame, column: str = "value", sort: bool = True) -> DataFrame:
    """Rows of the JSON objects in a column of texts; the schema is inferred over all of them, by executors."""
    parsed = F.try_parse_json(F.col(column))
    said = df.select(F.schema_of_variant_agg(parsed)).first()[0]
    if not said or not said.startswith("OBJECT<"):
        return df.sparkSession.createDataFrame([], "value string") if not said or said == "VOID" else df.select(F.col(column).alias("value"))
    ddl = said.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("DECIMAL", "DECIMAL")
    out = df.filter(F.col(column).isNotNull()).select(F.from_json(column, ddl).alias("r")).select("r.*")
    out = widened(out)
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)]) if sort else out


def parsed_files(spark: SparkSession, path: str, parse: Callable[[bytes], list]) -> DataFrame:
    """A JSON text for each record that parse finds in each file; files are read and parsed by executors, whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"value": [json.dumps(r, default=str) for content in df["content"] for r in parse(bytes(content))]}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def yaml_records(content: bytes) -> list:
    """Of a sequence, a mapping, or several documents."""
    import yaml

    out = []
    for doc in yaml.safe_load_all(content):
        if isinstance(doc, list):
            out += [r if isinstance(r, dict) else {"value": r} for r in doc]
        elif isinstance(doc, dict):
            out.append(doc)
        elif doc is not None:
            out.append({"value": doc})
    return out


@opener("yaml")
def yaml_(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    return json_rows(parsed_files(spark, located(spec.path, base), yaml_records))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]


def sheet_records(content: bytes, sheet: str | None = None) -> list[dict]:
    """A worksheet's rows by the names in its first; an unnamed column is colN."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheets = {s.get("name"): targets[s.get(_REL)] for s in book.iter(f"{_NS}sheet")}
        name = sheet or next(iter(sheets))
        if name not in sheets:
            raise DialectError(f"no sheet {name}")
        target = sheets[name]
        body = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in body.iter(f"{_NS}row"):
        cells: dict[int, object] = {}
        for n, c in enumerate(row.iter(f"{_NS}c")):
            letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
            at = n
            if letters:
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                at -= 1
            kind, v = c.get("t"), c.find(f"{_NS}v")
            text = v.text if v is not None else None
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif text is None:
                continue
            elif kind == "s":
                cells[at] = shared[int(text)]
            elif kind == "b":
                cells[at] = text == "1"
            elif kind in ("str", "e"):
                cells[at] = text
            else:
                x = float(text)
                cells[at] = int(x) if x.is_integer() and "." not in text and "E" not in text.upper() else x
        rows.append(cells)
    if not rows:
        return []
    width = max((max(r, default=-1) for r in rows), default=-1) + 1
    names = [str(rows[0].get(i) or f"col{i + 1}") for i in range(width)]
    return [{n: r.get(i) for i, n in enumerate(names)} for r in rows[1:] if r]


@opener("excel")
def excel(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    sheet = spec.options.get("sheet")
    df = parsed_files(spark, located(spec.path, base), lambda content: sheet_records(content, sheet))
    first = df.limit(1).collect()
    out = json_rows(df, sort=False)
    order = list(json.loads(first[0][0])) if first else []
    return out.select(*[F.col(f"`{c}`") for c in order if c in out.columns], *[F.col(f"`{c}`") for c in out.columns if c not in order])


def expanded(spark: SparkSession, name: str, spec: Spec, base: str) -> dict[str, Spec]:
    """A spec whose sheet or table is '*' as one for each sheet or table."""
    if spec.prefix == "excel" and spec.options.get("sheet") == "*":
        content = bytes(spark.read.format("binaryFile").load(located(spec.path, base)).select("content").first()[0])
        return {f"{name}_{re.sub(r'[^a-z0-9]+', '_', s.lower()).strip('_')}": Spec("excel", spec.path, spec.options | {"sheet": s}) for s in sheet_names(content)}
    if spec.prefix == "sql" and spec.options.get("table") == "*":
        return {f"{name}_{t}": Spec("sql", spec.path, spec.options | {"table": t}) for t in sqlite_tables(sqlite_path(spec, base))}
    return {name: spec}


def pushes(spark: SparkSession) -> str:
    """Whether the session lets Python sources see filters; a reader that asks where it doesn't is an error."""
    return spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")


def sqlite_path(spec: Spec, base: str) -> str:
    return located(re.sub(r"^(sqlite|file):(//)?", "", spec.path), base)


def sqlite_tables(path: str) -> list[str]:
    import contextlib
    import sqlite3

    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]


@opener("sql")
def sql(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    """SQLite by its own module; Postgres, MySQL and SQL Server by Spark's JDBC source, which pushes filters, aggregates and limits down.

    A query option is run by the database, which is how DATE_BIN buckets can be computed there.
    """
    m = re.match(r"(jdbc:)?(postgres|postgresql|mysql|sqlserver|mssql)://", spec.path)
    if m:
        url = spec.path if m[1] else "jdbc:" + re.sub(r"^postgres(ql)?:", "postgresql:", re.sub(r"^mssql:", "sqlserver:", spec.path))
        options = {k: v for k, v in spec.options.items() if k in ("user", "password", "driver", "partitionColumn", "lowerBound", "upperBound", "numPartitions", "fetchsize")}
        what = {"query": spec.options["query"]} if "query" in spec.options else {"dbtable": spec.options.get("table", "")}
        return spark.read.format("jdbc").options(url=url, pushDownAggregate="true", pushDownLimit="true", **what, **options).load()
    from .sqlite import SqliteSource

    path = sqlite_path(spec, base)
    table = spec.options.get("table")
    if "query" not in spec.options and not table:
        tables = sqlite_tables(path)
        if len(tables) != 1:
            raise DialectError(f"name a table of {spec.path}: {', '.join(tables)}")
        table = tables[0]
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sparkloom_sqlite").options(path=path, push=pushes(spark), **({"query": spec.options["query"]} if "query" in spec.options else {"table": table})).load()
