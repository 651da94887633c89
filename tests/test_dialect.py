"""Parsing, and the fixtures' expected rows."""

import datetime as dt
import math
import random
import re

import pytest

from sparkloom.functions.intervals import parse_interval
from sparkloom.plans import tree as T
from sparkloom.plans.parser import parse
from sparkloom.plans.tree import DialectError

D = [dt.datetime(2026, 1, i) for i in range(1, 7)]


def rows(engine, text):
    return sorted((tuple(r) for r in engine.query(text).collect()), key=repr)


def ordered(engine, text):
    return [tuple(r) for r in engine.query(text).collect()]


@pytest.fixture
def sets(engine, spark):
    engine.register("s1", spark.createDataFrame([(1,), (2,), (2,)], "n bigint"))
    engine.register("s2", spark.createDataFrame([(2,), (3,)], "n bigint"))
    return engine


@pytest.mark.parametrize("text", ["SELECT", "SELECT 1 FROM", "SELECT * FROM t WHERE", "SELECT 'a", "SELECT 1 2 3 FROM t", "SELECT a FROM (SELECT 1)", "WITH RECURSIVE a AS (SELECT 1) SELECT 1", "SELECT a FROM t ASOF RIGHT JOIN u ON t.a > u.a", "SELECT CAST(a AS decimal) FROM t", "SELECT SUM(x) OVER (ORDER BY y GROUPS 1 PRECEDING) FROM t", "CREATE PERSISTENT VIEW v AS SELECT 1", "SELECT a FROM t LIMIT x", "SELECT @", "DELETE FROM t"])
def test_syntax_errors(text):
    with pytest.raises(DialectError):
        parse(text)


def test_tree():
    q = parse("SELECT a, b x FROM t AS u WHERE NOT a = 1 OR b LIKE 'x%' -- why\n ORDER BY 2 DESC LIMIT 3 OFFSET 1;")
    assert (q.items[1], q.source, q.limit, q.offset) == ((T.Column("b"), "x"), T.Table("t", None, "u"), 3, 1)
    assert isinstance(q.where, T.Binary) and q.where.op == "OR"
    q = parse("SELECT a FROM s UNION SELECT b FROM t INTERSECT SELECT c FROM u ORDER BY 1")
    assert (q.op, q.right.op, len(q.order)) == ("union", "intersect", 1)
    assert parse("SELECT * FROM csv:./a/b-c.csv AS s WHERE x = \"y\"").source == T.Table("./a/b-c.csv", "csv", "s")
    assert parse("SELECT * FROM https://h/x?a=1&b=2 d").source == T.Table("https://h/x?a=1&b=2".replace("https:", "https:"), "https", "d")
    s = parse("CREATE PERSISTENT MATERIALIZED VIEW IF NOT EXISTS m AS SELECT 1 WITH NO DATA")
    assert (s.action, s.persistent, s.lenient, s.data, s.text) == ("create matview", True, True, False, "SELECT 1")


@pytest.mark.parametrize("text, micros", [("90", 90_000_000), ("15 minutes", 900_000_000), ("1 day 2 hours", 93_600_000_000), ("2h30m", 9_000_000_000), ("-1 day", -86_400_000_000), ("1 month", 30 * 86_400_000_000), ("0.5 seconds", 500_000)])
def test_intervals(text, micros):
    assert parse_interval(text) == micros


@pytest.mark.parametrize("kind, n", [("INNER", 2), ("LEFT", 3), ("RIGHT", 3), ("FULL", 4)])
def test_joins(sets, kind, n):
    assert len(rows(sets, f"SELECT s1.n, s2.n FROM s1 {kind} JOIN s2 ON s1.n = s2.n")) == n


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT n FROM s1 WHERE EXISTS (SELECT 1 FROM s2 WHERE s2.n = s1.n)", [(2,), (2,)]),
        ("SELECT n FROM s1 WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.n = s1.n)", [(1,)]),
        ("SELECT DISTINCT n, (SELECT COUNT(*) FROM s2 WHERE s2.n = s1.n) AS c FROM s1", [(1, 0), (2, 1)]),
        ("SELECT n FROM s1 WHERE n >= (SELECT MIN(n) FROM s2)", [(2,), (2,)]),
        ("SELECT n, COUNT(*) AS c FROM s1 WHERE n >= (SELECT MIN(n) FROM s2) GROUP BY n", [(2, 2)]),
        ("SELECT n FROM s1 INTERSECT SELECT n FROM s2", [(2,)]),
        ("SELECT n FROM s1 INTERSECT ALL SELECT n FROM s2", [(2,)]),
        ("SELECT n FROM s1 EXCEPT SELECT n FROM s2", [(1,)]),
        ("SELECT n FROM s1 EXCEPT ALL SELECT n FROM s2", [(1,), (2,)]),
        ("SELECT n FROM s1 UNION SELECT n FROM s2 INTERSECT SELECT n FROM s2", [(1,), (2,), (3,)]),
        ("SELECT n FROM s1 EXCEPT SELECT n FROM s2 UNION SELECT n FROM s2", [(1,), (2,), (3,)]),
        ("SELECT n FROM s1 WHERE n NOT IN (SELECT n FROM s2 WHERE n > 2)", [(1,), (2,), (2,)]),
    ],
)
def test_sets_and_subqueries(sets, text, expected):
    assert rows(sets, text) == expected


def test_scalar_subquery_of_two_rows_fails(sets):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY|more than one row"):
        rows(sets, "SELECT n FROM s1 WHERE n = (SELECT n FROM s2)")


def test_windows(sets):
    assert rows(sets, "SELECT n, ROW_NUMBER() OVER (ORDER BY n) r, RANK() OVER (ORDER BY n) k, DENSE_RANK() OVER (ORDER BY n) d, SUM(n) OVER (ORDER BY n) s FROM s1") == [(1, 1, 1, 1, 1.0), (2, 2, 2, 2, 5.0), (2, 3, 2, 2, 5.0)]
    assert ordered(sets, "SELECT LAG(n) OVER (ORDER BY n) a, LEAD(n, 1, -1) OVER (ORDER BY n) b FROM s1 ORDER BY n, b DESC") == [(None, 2), (1, 2), (2, -1)]


def test_null_keys_never_join(engine, spark):
    engine.register("emp", spark.createDataFrame([(1, "Alice"), (2, "bob"), (3, "Carol"), (None, "Nul")], "id bigint, name string"))
    engine.register("ord", spark.createDataFrame([(1,), (2,), (2,)], "emp_id bigint"))
    assert rows(engine, "SELECT name FROM emp e WHERE EXISTS (SELECT 1 FROM ord o WHERE o.emp_id = e.id)") == [("Alice",), ("bob",)]
    assert rows(engine, "SELECT name FROM emp e WHERE NOT EXISTS (SELECT 1 FROM ord o WHERE o.emp_id = e.id)") == [("Carol",), ("Nul",)]
    assert rows(engine, "SELECT name FROM emp e WHERE (SELECT COUNT(*) FROM ord o WHERE o.emp_id = e.id) > 0") == [("Alice",), ("bob",)]


def test_aggregates(engine, spark):
    engine.register("orders", spark.createDataFrame([(1, 100.0, "USD"), (1, 19.49, "USD"), (2, 50.0, "EUR")], "customer_id bigint, amount double, currency string"))
    assert rows(engine, "SELECT customer_id, SUM(amount) * 2 AS d FROM orders GROUP BY customer_id") == [(1, 238.98), (2, 100.0)]
    assert rows(engine, "SELECT customer_id FROM orders GROUP BY customer_id HAVING SUM(amount) > 60") == [(1,)]
    assert rows(engine, "SELECT SUM(amount) OVER (PARTITION BY customer_id) s, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY amount) r FROM orders") == [(119.49, 1), (119.49, 2), (50.0, 1)]
    engine.register("v", spark.createDataFrame([(2, "a"), (4, "b"), (4, "b"), (6, "c")], "v bigint, s string"))
    assert ordered(engine, "SELECT MEDIAN(v), VAR_POP(v), STDDEV_POP(v), VAR_SAMP(v), PERCENTILE_CONT(v, 0.5), PERCENTILE_CONT(v, 0), PERCENTILE_CONT(v, 1), QUANTILE(v, 0.25), PERCENTILE_DISC(v, 0.5), PERCENTILE_DISC(v, 0.75), STRING_AGG(s, ','), STRING_AGG(DISTINCT s, '-') FROM v") == [(4.0, 2.0, 2**0.5, 8 / 3, 4.0, 2.0, 6.0, 3.5, 4.0, 4.0, "a,b,b,c", "a-b-c")]
    assert ordered(engine, "SELECT STDDEV(v), VARIANCE(v), VAR_POP(v) FROM v WHERE v = 2") == [(None, None, 0.0)]
    engine.register("xy", spark.createDataFrame([(1, 3, 1), (2, 5, 1), (3, 7, 1)], "x bigint, y bigint, k bigint"))
    got = ordered(engine, "SELECT REGR_SLOPE(y, x), REGR_INTERCEPT(y, x), CORR(y, x), REGR_R2(y, x), REGR_COUNT(y, x), REGR_AVGX(y, x), REGR_AVGY(y, x), COVAR_POP(y, x), COVAR_SAMP(y, x), CORR(y, k) FROM xy")[0]
    assert got == pytest.approx((2, 1, 1, 1, 3, 2, 5, 4 / 3, 2, None))
    assert ordered(engine, "SELECT COUNT(*), SUM(x) FROM xy WHERE x > 9") == [(0, None)]
    assert ordered(engine, "SELECT k, COUNT(*) FROM xy WHERE x > 9 GROUP BY k") == []


@pytest.fixture
def readings(engine, spark):
    data = [("a", D[2], 3.0), ("a", D[0], 1.0), ("a", None, 99.0), ("b", D[1], 5.0), ("b", D[0], 4.0), ("c", D[0], 7.0), ("c", D[1], None), ("d", D[0], None), ("d", D[1], 8.0)]
    engine.register("readings", spark.createDataFrame(data, "station string, ts timestamp_ntz, value double"))
    return engine


def test_time_series(readings):
    assert rows(readings, "SELECT station, FIRST(value, ts), LAST(value, ts) FROM readings GROUP BY station") == [("a", 1.0, 3.0), ("b", 4.0, 5.0), ("c", 7.0, None), ("d", None, 8.0)]
    assert ordered(readings, "SELECT FIRST(value, ts) FROM readings WHERE station = 'z'") == [(None,)]
    assert rows(readings, "SELECT DISTINCT station, LAST(value, ts) OVER (PARTITION BY station) FROM readings WHERE station IN ('a', 'b')") == [("a", 3.0), ("b", 5.0)]
    assert ordered(readings, "SELECT LOCF(value) OVER (PARTITION BY station ORDER BY ts) FROM readings WHERE station IN ('c', 'd') ORDER BY station, ts") == [(7.0,), (7.0,), (None,), (8.0,)]
    assert ordered(readings, "SELECT DELTA(value) OVER (ORDER BY ts) d, RATE(value, ts) OVER (ORDER BY ts) r FROM readings WHERE station = 'b' ORDER BY ts") == [(None, None), (1.0, 1 / 86400)]
    spine = "generate_series(CAST('2026-01-01' AS timestamp), CAST('2026-01-03' AS timestamp), INTERVAL '1 day') AS g(t)"
    assert ordered(readings, f"SELECT r.value, LOCF(r.value) OVER (ORDER BY g.t) f FROM {spine} LEFT JOIN (SELECT ts, value FROM readings WHERE station = 'a') r ON r.ts = g.t ORDER BY g.t") == [(1.0, 1.0), (None, 1.0), (3.0, 3.0)]
    assert ordered(readings, f"SELECT r.value FROM {spine} ASOF JOIN (SELECT ts, value FROM readings WHERE station = 'a') r ON g.t >= r.ts ORDER BY g.t") == [(1.0,), (1.0,), (3.0,)]


def test_rate_takes_a_drop_for_a_restart(engine, spark):
    engine.register("c", spark.createDataFrame([(1, 10), (2, 3), (4, 9)], "t bigint, v bigint"))
    assert ordered(engine, "SELECT RATE(v, t) OVER (ORDER BY t) AS r FROM c ORDER BY t") == [(None,), (3.0,), (3.0,)]


def test_rate_over_short_steps_is_exact(engine, spark):
    at = [dt.datetime(2024, 1, 5, 7, 12, 9, 903), dt.datetime(2024, 1, 5, 7, 12, 9, 904), dt.datetime(2024, 1, 5, 7, 12, 9, 911)]
    engine.register("c", spark.createDataFrame([(t, (1 << 60) + i, x) for i, (t, x) in enumerate(zip(at, (0.0, 1.0, 8.0), strict=True))], "ts timestamp_ntz, n bigint, v double"))
    assert ordered(engine, "SELECT RATE(v, ts) OVER (ORDER BY ts) AS r, RATE(v, n) OVER (ORDER BY ts) AS s FROM c ORDER BY ts") == [(None, None), (1e6, 1.0), (1e6, 7.0)]


@pytest.mark.parametrize("on, kind, expected", [("e.ts >= r.ts2", "", [(7, 30, 1), (7, 90, 3)]), ("e.ts >= r.ts2", "LEFT", [(7, 30, 1), (7, 90, 3), (8, 90, None)]), ("r.ts2 <= e.ts", "", [(7, 30, 1), (7, 90, 3)]), ("e.ts <= r.ts2", "", [(7, 30, 3), (8, 90, 5)])])
def test_asof(engine, spark, on, kind, expected):
    engine.register("e", spark.createDataFrame([(7, 90), (7, 30), (8, 90)], "k bigint, ts bigint"))
    engine.register("r", spark.createDataFrame([(7, 25, 1), (7, 70, 3), (8, 95, 5)], "k bigint, ts2 bigint, v bigint"))
    assert rows(engine, f"SELECT e.k, e.ts, r.v FROM e ASOF {kind} JOIN r ON {on} AND e.k = r.k") == expected
    engine.asof_bins = 3
    assert rows(engine, f"SELECT e.k, e.ts, r.v FROM e ASOF {kind} JOIN r ON {on} AND e.k = r.k") == expected
    assert rows(engine, "SELECT r.v FROM (SELECT 80 AS ts) e ASOF JOIN r ON e.ts >= r.ts2") == [(3,)]
    assert rows(engine, "SELECT r.v FROM (SELECT 70 AS ts) e ASOF JOIN r ON e.ts > r.ts2") == [(1,)]
    for bad in ("e.k = r.k", "e.ts > r.ts2 AND e.ts < r.ts2", "e.ts > r.ts2 AND e.k > 1", "e.ts > r.ts2 OR e.k = r.k"):
        with pytest.raises(DialectError):
            engine.query(f"SELECT r.v FROM e ASOF JOIN r ON {bad}")


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof_against_its_definition(spark, op, how):
    import random

    from sparkloom.operators.asof import asof_join, asof_lateral

    rng = random.Random(7)
    pick = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    left = spark.createDataFrame([(i, pick(4), pick(30)) for i in range(80)], "i bigint, k bigint, t bigint")
    right = spark.createDataFrame([(pick(4), pick(30), i) for i in range(60)], "rk bigint, rt bigint, v bigint")
    want = sorted(map(tuple, asof_lateral(left, right, [("k", "rk")], ("t", op, "rt"), how).collect()), key=repr)
    for bins in (0, 5):
        assert sorted(map(tuple, asof_join(left, right, [("k", "rk")], ("t", op, "rt"), how, bins).collect()), key=repr) == want
    want = sorted(map(tuple, asof_lateral(left, right, [], ("t", op, "rt"), how).collect()), key=repr)
    assert sorted(map(tuple, asof_join(left, right, [], ("t", op, "rt"), how, 4).collect()), key=repr) == want


def test_frames(engine, spark):
    engine.register("t", spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "t bigint, v bigint"))
    over = lambda frame: [r[0] for r in ordered(engine, f"SELECT SUM(v) OVER (ORDER BY t {frame}) AS s FROM t ORDER BY t")]
    assert over("ROWS 2 PRECEDING") == [10, 30, 60, 90, 120]
    assert over("ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING") == [30, 60, 90, 120, 90]
    assert over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW") == [10, 30, 60, 100, 150]
    engine.register("p", spark.createDataFrame([(1, 10), (2, 20), (2, 5), (3, 30)], "t bigint, v bigint"))
    assert sorted(r[0] for r in ordered(engine, "SELECT SUM(v) OVER (ORDER BY t RANGE BETWEEN CURRENT ROW AND CURRENT ROW) FROM p")) == [10, 25, 25, 30]
    engine.register("d", spark.createDataFrame([(dt.datetime(2024, 3, x), 10.0 * i) for i, x in enumerate((1, 2, 3, 8, 9), 1)], "ts timestamp_ntz, v double"))
    assert [r[0] for r in ordered(engine, "SELECT SUM(v) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '7 days' PRECEDING AND CURRENT ROW) s FROM d ORDER BY ts")] == [10, 30, 60, 100, 140]


@pytest.mark.parametrize("size", [("3 PRECEDING", "CURRENT ROW"), ("CURRENT ROW", "2 FOLLOWING"), ("4 PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", "5 FOLLOWING"), ("1 PRECEDING", "1 FOLLOWING"), ("1000 PRECEDING", "CURRENT ROW"), ("1 PRECEDING", "CURRENT ROW")])
@pytest.mark.parametrize("down", ["", " DESC"])
def test_frames_of_a_length_by_definition(engine, spark, size, down):
    rng = random.Random(5)
    data = [(i, rng.choice([None, "a", "b"]), rng.choice([None, *range(-12, 13)]), rng.choice([None, 1e20, 0.25, 1.5, -3.0]) if i % 7 else 2.0) for i in range(120)]
    engine.register("t", spark.createDataFrame(data, "id bigint, k string, n bigint, v double"))
    start = dt.datetime(2024, 3, 9)
    engine.register("h", spark.createDataFrame([(i, k, None if n is None else start + dt.timedelta(hours=n), v) for i, k, n, v in data], "id bigint, k string, n timestamp_ntz, v double"))
    reach = [0 if x == "CURRENT ROW" else int(x.split()[0]) * (-1 if "PRECEDING" in x else 1) for x in size]

    def frame(row):
        for _, k, n, v in data:
            if k == row[1] and (n is None) == (row[2] is None) and (n is None or reach[0] <= (row[2] - n if down else n - row[2]) <= reach[1]):
                yield v

    want = []
    for row in data:
        every = list(frame(row))
        vs = [v for v in every if v is not None]
        want.append((row[0], math.fsum(vs) if vs else None, len(vs), len(every), math.fsum(vs) / len(vs) if vs else None, min(vs, default=None), max(vs, default=None)))
    for table, bounds in (("t", size), ("h", [x if x == "CURRENT ROW" else f"INTERVAL '{x.split()[0]} hours' {x.split()[1]}" for x in size])):
        over = f"OVER (PARTITION BY k ORDER BY n{down} RANGE BETWEEN {bounds[0]} AND {bounds[1]})"
        df = engine.query(f"SELECT id, SUM(v) {over} AS s, COUNT(v) {over} AS c, COUNT(*) {over} AS rows, AVG(v) {over} AS a, MIN(v) {over} AS low, MAX(v) {over} AS high FROM {table} WHERE id >= 0 ORDER BY id")
        assert [tuple(r) for r in df.collect()] == [tuple(x if x is None else pytest.approx(x, rel=1e-12) for x in r) for r in want]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert set(re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*),", plan)) == {"unboundedpreceding$()"}  # no row adds up its own frame anew


def test_frames_of_a_length_in_any_place(engine, spark):
    engine.register("t", spark.createDataFrame([(1, "x", 10.0), (2, "y", 20.0), (2, "x", 5.0), (9, "y", 30.0)], "t bigint, g string, v double"))
    engine.register("u", spark.createDataFrame([("x", 1), ("y", 2)], "g string, w bigint"))
    over = "OVER (ORDER BY t.t RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)"
    assert rows(engine, f"SELECT t.g, u.w, SUM(t.v) {over} / 2 + MAX(u.w) OVER (PARTITION BY t.g ORDER BY t.t RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS z, ROW_NUMBER() OVER (ORDER BY t.t, t.v) AS n FROM t JOIN u ON t.g = u.g WHERE u.w < 9") == [("x", 1, 18.5, 2), ("x", 1, 6.0, 1), ("y", 2, 17.0, 4), ("y", 2, 19.5, 3)]
    assert rows(engine, f"WITH c AS (SELECT t.g AS g, SUM(v) {over} AS s FROM t) SELECT DISTINCT s FROM (SELECT * FROM c) AS d WHERE s > 10") == [(30.0,), (35.0,)]
    assert ordered(engine, f"SELECT v FROM t ORDER BY SUM(v) {over} DESC, v LIMIT 2") == [(5.0,), (20.0,)]
    edges = [-(1 << 63), -(1 << 63) + 1, (1 << 63) - 2, (1 << 63) - 1]
    engine.register("e", spark.createDataFrame([(x,) for x in edges], "n bigint"))
    for size, want in ((1, [1, 2, 1, 2]), (3, [1, 2, 1, 2])):
        assert [r[1] for r in ordered(engine, f"SELECT n, COUNT(*) OVER (ORDER BY n RANGE BETWEEN {size} PRECEDING AND CURRENT ROW) AS c FROM e ORDER BY n")] == want


@pytest.mark.parametrize(
    "expression, value",
    [
        ("5 / 0", None), ("7 / 2", 3.5), ("MOD(7, 0)", None), ("MOD(-7, 3)", -1), ("TRIM(' \t x ')", "x"), ("SUBSTR('abcdef', -1, 3)", "abc"), ("LEFT('abc', -1)", "ab"), ("RIGHT('abc', -1)", "bc"), ("SPLIT_PART('a,b', ',', 3)", ""), ("SPLIT_PART('a,b', ',', 0)", ""),
        ("REGEXP_REPLACE('a1b2', '[0-9]', '$0')", "a$0b2"), ("REGEXP_REPLACE('a1b2', '([0-9])', '<$1>', 'g')", "a<1>b<2>"), ("REGEXP_EXTRACT('port=80', 'port=([0-9]+)')", "80"), ("REGEXP_EXTRACT('abc', 'z')", None), ("EXTRACT_VALUE(level FROM 'level=info msg=x')", "info"), ("EXTRACT_VALUE('a: \"b c\"', 'a')", "b c"),
        ("JSON_EXTRACT('{\"a\": [1, {\"k\": \"v\"}]}', '$.a[1].k')", "v"), ("JSON_EXTRACT('nope', 'a')", None), ("CAST('x' AS int)", None), ("CAST('2.7' AS int)", 2), ("CAST(-2.7 AS int)", -2), ("CAST('yes' AS bool)", True), ("LOG(1000)", 3.0), ("LOG(2, 8)", 3.0), ("SQRT(-1)", None), ("LN(0)", None), ("POWER(0, -1)", None), ("TRUNC(-2.57, 1)", -2.5), ("SIGN(-3)", -1),
        ("GREATEST(1, NULL, 3)", 3), ("COALESCE(NULL, 'a')", "a"), ("CONCAT('a', NULL, 1)", "a1"), ("'a' LIKE 'A'", False), ("'a' ILIKE 'A'", True), ("'a\\b' LIKE 'a\\%'", True), ("1 = '1'", True), ("1 = 'x'", None), ("NULL = 1", None), ("NOT NULL", None), ("TRUE OR NULL", True), ("2 NOT IN (1, 3)", True), ("WIDTH_BUCKET(5, 0, 10, 5)", 3), ("POSITION('c' IN 'abc')", 3), ("LENGTH('äö')", 2),
        ("DATE_BIN('5 minutes', CAST('1969-12-31 23:58:00' AS timestamp))", dt.datetime(1969, 12, 31, 23, 55)), ("DATE_TRUNC('week', CAST('2024-03-07' AS timestamp))", dt.datetime(2024, 3, 4)), ("CAST('2024-01-02T03:04:05-0700' AS timestamp)", dt.datetime(2024, 1, 2, 10, 4, 5)), ("CAST('2024/01/02' AS timestamp)", dt.datetime(2024, 1, 2)), ("STRFTIME('%Y-%m', CAST('2024-01-02' AS timestamp))", "2024-01"),
        ("EXTRACT(DOW FROM CAST('2024-03-03' AS timestamp))", 0), ("CAST('2024-01-02' AS timestamp) - CAST('2024-01-01' AS timestamp)", dt.timedelta(days=1)), ("TO_TIMESTAMP(1.5)", dt.datetime(1970, 1, 1, 0, 0, 1, 500000)), ("FROM_TZ(CAST('2024-07-01 08:00:00' AS timestamp), 'America/New_York')", dt.datetime(2024, 7, 1, 12)), ("CASE 2 WHEN 1 THEN 'a' ELSE 'b' END", "b"), ("INTERVAL '1 day' > INTERVAL '23 hours'", True), ("-(-3)", 3), ("'it''s'", "it's"),
    ],
)
def test_expressions(engine, expression, value):
    got = engine.query(f"SELECT {expression} AS x").first()[0]
    assert got == (pytest.approx(value) if isinstance(value, float) else value)


@pytest.mark.parametrize("text", ["SELECT nope FROM s1", "SELECT NOPE(1)", "SELECT n FROM nope", "SELECT s9.n FROM s1", "SELECT n FROM s1 GROUP BY 2", "SELECT n FROM s1 UNION SELECT n, n FROM s2", "SELECT SUM(SUM(n)) FROM s1", "SELECT LOCF(n) FROM s1", "SELECT DATE_TRUNC('eon', n) FROM s1", "SELECT LEFT('a') AS x", "SELECT n FROM s1 AS a(x, y)", "SELECT s1.n FROM s1 JOIN s2 AS s1 ON 1 = 1", "SELECT value FROM generate_series(1, 5, 0)", "SELECT nope:x FROM s1", "SELECT n FROM s1 WHERE SUM(n) > 1"])
def test_binding_errors(sets, text):
    with pytest.raises((DialectError, ValueError)):
        sets.query(text)


def test_names(sets):
    assert sets.query("SELECT n, n + 1, COUNT(*), 1, 'a', LOWER('A') FROM s1 GROUP BY n").columns == ["n", "expr", "count", "int", "string", "lower"]
    assert rows(sets, "SELECT x FROM s1 AS a(x) WHERE x = 1") == [(1,)]
    assert rows(sets, "SELECT day FROM generate_series(3, 1, -1) AS g(day)") == [(1,), (2,), (3,)]
    assert rows(sets, "SELECT value FROM generate_series(5, 1)") == []
    assert rows(sets, "WITH s1 AS (SELECT 9 AS n) SELECT n FROM s1") == [(9,)]
    assert ordered(sets, "SELECT n AS m FROM s2 ORDER BY m DESC") == [(3,), (2,)]


def test_strict_casts_raise(spark):
    from sparkloom.session import Engine

    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        Engine(spark, strict=True).query("SELECT CAST('x' AS float) AS y").collect()


def test_pushdown_reaches_the_scan(engine, spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s").write.parquet(str(tmp_path / "t"))
    plan = engine.explain(f"SELECT k, COUNT(*) AS n FROM parquet:{tmp_path}/t WHERE id > 900 GROUP BY k")
    assert "GreaterThan(id,900)" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan
