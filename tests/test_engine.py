"""Views, materialized views and their store."""

import os

import pytest

from sparkloom.plans.tree import DialectError
from sparkloom.session import Engine


@pytest.fixture
def e(engine, spark):
    engine.register("emp", spark.createDataFrame([("Ann", "eng", 100), ("Bob", "eng", 90), ("Cy", "eng", 150), ("Di", "sales", 80)], "name string, dept string, salary bigint"))
    return engine


def test_views(e, spark):
    assert e.execute("CREATE VIEW eng AS SELECT name, salary FROM emp WHERE dept = 'eng' AND EXISTS (SELECT 1 FROM emp x WHERE x.salary > 100)").notice == "view eng created"
    for _ in range(2):  # a definition is text: naming it doesn't wear it
        assert e.query("SELECT COUNT(*) AS n FROM eng").first()[0] == 3
    e.execute("CREATE VIEW rich AS WITH a AS (SELECT name FROM eng WHERE salary > 95) SELECT * FROM a")
    assert {r[0] for r in e.query("SELECT name FROM rich").collect()} == {"Ann", "Cy"}
    e.register("emp", spark.createDataFrame([("Ed", "eng", 500)], "name string, dept string, salary bigint"))
    assert [r[0] for r in e.query("WITH eng AS (SELECT 1 AS one) SELECT name FROM rich").collect()] == ["Ed"]
    with pytest.raises(DialectError, match="already"):
        e.execute("CREATE VIEW emp AS SELECT 1 AS x")
    with pytest.raises(DialectError):
        e.execute("CREATE VIEW bad AS SELECT nope FROM emp")
    with pytest.raises(DialectError, match="itself"):
        e.execute("CREATE OR REPLACE VIEW eng AS SELECT name FROM rich")
    e.execute("DROP VIEW rich")
    e.execute("DROP VIEW IF EXISTS rich")
    with pytest.raises(DialectError):
        e.execute("DROP VIEW rich")


def test_materialized_views(e, spark):
    e.execute("CREATE MATERIALIZED VIEW m AS SELECT e.dept, SUM(e.salary) AS total FROM emp e GROUP BY e.dept")
    assert dict(e.query("SELECT dept, total FROM m").collect()) == {"eng": 340.0, "sales": 80.0}
    e.register("emp", spark.createDataFrame([("Ed", "eng", 500)], "name string, dept string, salary bigint"))
    assert e.query("SELECT COUNT(*) AS n FROM m").first()[0] == 2
    e.execute("REFRESH MATERIALIZED VIEW m")
    assert dict(e.query("SELECT dept, total FROM m").collect()) == {"eng": 500.0}
    e.execute("REFRESH MATERIALIZED VIEW m WITH NO DATA")
    with pytest.raises(DialectError, match="no data"):
        e.query("SELECT * FROM m")
    assert "already" in e.execute("CREATE MATERIALIZED VIEW IF NOT EXISTS m AS SELECT 1 AS x").notice
    with pytest.raises(DialectError, match="twice"):
        e.execute("CREATE MATERIALIZED VIEW d AS SELECT a.name, b.name FROM emp a JOIN emp b ON a.name = b.name")
    e.execute("REFRESH MATERIALIZED VIEW m")
    assert e.query("SELECT total FROM mem:m").first()[0] == 500.0
    e.execute("DROP MATERIALIZED VIEW m")
    assert "m" not in e.names()
    with pytest.raises(DialectError):
        e.query("SELECT total FROM mem:m")


def test_persistent_views_survive(e, spark, tmp_path):
    e.execute("CREATE PERSISTENT MATERIALIZED VIEW p AS SELECT dept, COUNT(*) AS n FROM emp GROUP BY dept")
    e.execute("CREATE PERSISTENT MATERIALIZED VIEW hollow AS SELECT name FROM emp WITH NO DATA")
    again = Engine(spark, base=str(tmp_path))
    assert again.reload() == ["hollow", "p"]
    assert dict(again.query("SELECT dept, n FROM p").collect()) == {"eng": 3, "sales": 1}
    assert again.names()["p"] == "mem, persistent"
    with pytest.raises(DialectError):
        again.query("SELECT * FROM hollow")
    again.register("emp", spark.createDataFrame([("Ed", "ops", 1)], "name string, dept string, salary bigint"))
    again.execute("REFRESH MATERIALIZED VIEW p")
    assert dict(again.query("SELECT dept, n FROM p").collect()) == {"ops": 1}
    again.execute("DROP MATERIALIZED VIEW p")
    assert not os.path.exists(tmp_path / ".sparkloom/matviews/p")
    taken = Engine(spark, base=str(tmp_path))
    taken.register("hollow", spark.range(1).toDF("x"))
    assert taken.reload() == [] and taken.warnings


def test_a_failed_persist_leaves_nothing(e, spark, tmp_path):
    with pytest.raises(Exception):
        Engine(spark, base=str(tmp_path), store="/proc/nowhere").execute("CREATE PERSISTENT MATERIALIZED VIEW q AS SELECT 1 AS x")
    assert "q" not in e.names()


def test_temporary_views_go_when_a_query_is_resolved(engine, spark):
    engine.register("t", spark.range(5).withColumnRenamed("id", "x"))
    engine.execute("CREATE VIEW a AS SELECT x FROM t WHERE x > 1")
    engine.execute("CREATE VIEW b AS WITH w AS (SELECT x FROM a) SELECT w.x FROM w JOIN a ON w.x = a.x")
    before = {v.name for v in spark.catalog.listTables() if v.isTemporary}
    df = engine.query("WITH c AS (SELECT x FROM b) SELECT c.x FROM c JOIN a ON c.x = a.x JOIN b ON b.x = a.x ORDER BY c.x")
    assert {v.name for v in spark.catalog.listTables() if v.isTemporary} == before
    assert [r[0] for r in df.collect()] == [2, 3, 4]
