"""Queries that write a test table as files of each kind and read them again through the dialect, with the same question to DuckDB.

Files stand in the folder that driver and executors share (spark.checkpoint.dir); where that is unset, in a temporary one.
"""

from __future__ import annotations

import atexit
import io
import shutil
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pivots
from .session import Engine
from .sources import Spec

_own: list[str] = []


def _folder(spark: SparkSession) -> str:
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return f"{found.rstrip('/')}/files-{uuid.uuid4().hex}"
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sparkloom-files-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}/{uuid.uuid4().hex}"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, by the file system of its path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()


def _asked(spark: SparkSession, prefix: str, path: str, text: str, **options: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("t", Spec(prefix, path, options))
    return engine.query(text)


def _csv(spark: SparkSession, d: str, delimiter: str, text: str) -> DataFrame:
    path = _folder(spark)
    _table(spark, d, "customer").write.options(header=True, sep=delimiter, emptyValue="").csv(path)
    return _asked(spark, "csv", path, text, delimiter=delimiter)


def _json(spark: SparkSession, d: str, text: str) -> DataFrame:
    path = _folder(spark)
    _table(spark, d, "part").write.json(path)
    return _asked(spark, "json", path, text)


def _yaml(spark: SparkSession, d: str, text: str) -> DataFrame:
    path = _folder(spark)
    _table(spark, d, "supplier").select(F.concat(F.lit("- "), F.to_json(F.struct("*")))).write.text(path)
    return _asked(spark, "yaml", path, text)


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """The bytes of a workbook with these rows; texts stand in the cells."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="s{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def _excel(spark: SparkSession, d: str, sheet: str, text: str) -> DataFrame:
    """nation and region are 30 rows at any size."""
    sheets = {}
    for name in ("nation", "region"):
        df = _table(spark, d, name)
        sheets[name.title()] = [df.columns, *map(list, df.collect())]
    path = f"{_folder(spark)}.xlsx"
    _put(spark, path, workbook(sheets))
    return _asked(spark, "excel", path, text, sheet=sheet)


def _sqlite(spark: SparkSession, d: str, text: str, **options: str) -> DataFrame:
    """The database is a file of the driver's: nation, 25 rows at any size."""
    path = f"{tempfile.mkdtemp(prefix='sparkloom-db-')}/d.db"
    atexit.register(shutil.rmtree, path.rpartition("/")[0], True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", map(tuple, _table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()))
    db.close()
    return _asked(spark, "sql", path, text, **options)


def _log(line: Callable[[], Column], text: str, **options: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = _folder(spark)
        _table(spark, d, "events").select(line()).write.text(path)
        return _asked(spark, "log", path, text, **options)

    return run


def _words(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_at = lambda form: F.date_format("ts", form)
_access = lambda: _words("10.0.0.", F.col("user_id") % 250, " - u", F.col("user_id"), " [", _at("dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', F.col("event_type"), ' HTTP/1.1" ', F.col("event_id") % 4 * 100 + 200, " ", F.col("event_id"))
_BY_STATUS = "SELECT status, path, COUNT(*) AS n, SUM(bytes) AS bytes, MIN(time) AS first, COUNT(DISTINCT host) AS hosts FROM t GROUP BY status, path"
_BY_STATUS_SQL = "SELECT event_id % 4 * 100 + 200 AS status, '/' || event_type AS path, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS bytes, min(date_trunc('second', ts)) AS first, count(DISTINCT user_id % 250) AS hosts FROM events GROUP BY 1, 2"
_LEVEL = "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END"
_level = lambda: F.expr(_LEVEL)


def _persistent(spark: SparkSession, d: str) -> DataFrame:
    """A persistent materialized view, read by another engine over the same store; a view that is dropped and made anew."""
    store = _folder(spark).removeprefix("file://")
    one = Engine(spark, store=store)
    one.register("orders", Spec("parquet", f"{d}/orders.parquet"))
    one.execute("CREATE PERSISTENT MATERIALIZED VIEW by_status AS SELECT o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY o_orderstatus")
    two = Engine(spark, store=store)
    two.reload()
    two.execute("CREATE VIEW v AS SELECT 1 AS x")
    two.execute("DROP VIEW v")
    two.execute("CREATE VIEW v AS SELECT o_orderstatus, n, s FROM by_status WHERE n > 0;")
    return two.query("SELECT * FROM v")


def _templates(spark: SparkSession, d: str) -> DataFrame:
    from . import templates

    lines = _table(spark, d, "events").select(_words("user ", F.col("user_id"), " did ", F.col("event_type"), " for ", F.round(F.col("value"), 2), " units").alias("value"))
    return templates.count(lines).agg(F.sum("n").alias("n"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "source_csv": (lambda s, d: _csv(s, d, ",", "SELECT c_mktsegment, COUNT(*) AS n, SUM(c_acctbal) AS s, MIN(c_name) AS least FROM t GROUP BY c_mktsegment"), "SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS s, min(c_name) AS least FROM customer GROUP BY 1"),
    "source_csv_delimiter": (lambda s, d: _csv(s, d, ";", "SELECT c_custkey, c_name, c_acctbal FROM t WHERE c_acctbal > 5000"), "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000"),
    "source_json": (lambda s, d: _json(s, d, "SELECT p_brand, COUNT(*) AS n, AVG(p_retailprice) AS mean, MAX(p_size) AS most FROM t GROUP BY p_brand"), "SELECT p_brand, count(*) AS n, avg(p_retailprice) AS mean, max(p_size) AS most FROM part GROUP BY 1"),
    "source_yaml": (lambda s, d: _yaml(s, d, "SELECT s_nationkey, COUNT(*) AS n, MAX(s_name) AS last FROM t GROUP BY s_nationkey"), "SELECT s_nationkey, count(*) AS n, max(s_name) AS last FROM supplier GROUP BY 1"),
    "source_excel": (lambda s, d: _excel(s, d, "Nation", "SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS first FROM t GROUP BY n_regionkey"), "SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation GROUP BY 1"),
    "source_excel_second_sheet": (lambda s, d: _excel(s, d, "Region", "SELECT r_regionkey, r_name FROM t"), "SELECT r_regionkey, r_name FROM region"),
    "source_sqlite": (lambda s, d: _sqlite(s, d, "SELECT n_name, n_nationkey FROM t WHERE n_regionkey IN (1, 3) AND n_name <> 'X'", table="nation"), "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey IN (1, 3)"),
    "source_sqlite_query": (lambda s, d: _sqlite(s, d, "SELECT k, n FROM t WHERE n > 0", query="SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1"), "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1"),
    "log_combined": (_log(lambda: _words(_access(), ' "http://x/" "agent ', F.col("user_id"), '"'), _BY_STATUS), _BY_STATUS_SQL),
    "log_common": (_log(_access, _BY_STATUS), _BY_STATUS_SQL),
    "log_syslog": (_log(lambda: _words("<13>", _at("MMM dd HH:mm:ss"), " web", F.col("user_id"), " app[", F.col("event_id"), "]: did ", F.col("event_type")), "SELECT host, message, COUNT(*) AS n, SUM(pid) AS pids, EXTRACT(MONTH FROM MIN(time)) AS month FROM t GROUP BY host, message"), "SELECT 'web' || user_id AS host, 'did ' || event_type AS message, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS pids, extract(month FROM min(ts)) AS month FROM events GROUP BY 1, 2"),
    "log_bracketed": (_log(lambda: _words("[", _at("yyyy-MM-dd HH:mm:ss"), "] [", _level(), "] did ", F.col("event_type")), "SELECT level, message, COUNT(*) AS n, MAX(time) AS last FROM t GROUP BY level, message"), f"SELECT {_LEVEL} AS level, 'did ' || event_type AS message, count(*) AS n, max(date_trunc('second', ts)) AS last FROM events GROUP BY 1, 2"),
    "log_leveled": (_log(lambda: _words(_at("yyyy-MM-dd HH:mm:ss"), " ", _level(), " did ", F.col("event_type")), "SELECT level, message, COUNT(*) AS n, MAX(time) AS last FROM t GROUP BY level, message"), f"SELECT {_LEVEL} AS level, 'did ' || event_type AS message, count(*) AS n, max(date_trunc('second', ts)) AS last FROM events GROUP BY 1, 2"),
    "log_json": (_log(lambda: F.to_json(F.struct("event_type", "user_id", "value")), "SELECT event_type, COUNT(*) AS n, SUM(user_id) AS users, MAX(value) AS most FROM t GROUP BY event_type"), "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS DOUBLE) AS users, max(value) AS most FROM events GROUP BY 1"),
    "log_raw": (_log(lambda: _words("did ", F.col("event_type")), "SELECT raw, COUNT(*) AS n FROM t GROUP BY raw"), "SELECT 'did ' || event_type AS raw, count(*) AS n FROM events GROUP BY 1"),
    "log_logfmt_detected": (_log(lambda: _words("kind=", F.col("event_type"), " who=", F.col("user_id"), F.when(F.col("event_id") % 7 == 0, F.lit(" late=1")).otherwise(F.lit(""))), "SELECT kind, COUNT(late) AS late, MAX(who) AS who, COUNT(*) AS n FROM t GROUP BY kind"), "SELECT event_type AS kind, count(*) FILTER (event_id % 7 = 0) AS late, max(user_id) AS who, count(*) AS n FROM events GROUP BY 1"),
    "persistent_view": (_persistent, "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1"),
    "path_tree": (lambda s, d: pivots.path_tree(_table(s, d, "events").select(_words(F.col("event_type"), "/", F.col("user_id") % 10, "/", F.col("event_id") % 3).alias("p")), "p"), "WITH p AS (SELECT event_type AS a, event_type || '/' || user_id % 10 AS b, event_type || '/' || user_id % 10 || '/' || event_id % 3 AS c FROM events) SELECT a AS node, CAST(NULL AS VARCHAR) AS parent, 1 AS depth, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT b, a, 2, count(*) FROM p GROUP BY 1, 2 UNION ALL SELECT c, b, 3, count(*) FROM p GROUP BY 1, 2"),
    "template_mining": (_templates, "SELECT count(*) AS n FROM events"),
}
