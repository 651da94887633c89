"""One query of the dialect for each operator, over the test tables, with the same question as DuckDB asks it."""

from __future__ import annotations

#: name: (dialect, DuckDB; None: the dialect's text is DuckDB's too)
QUERIES: dict[str, tuple[str, str | None]] = {
    "scan_filter_project": ("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS gross FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'", None),
    "select_star": ("SELECT * FROM nation", None),
    "qualified_star": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "from_less": ("SELECT 1 + 2 AS three, 'a' AS letter", "SELECT CAST(3 AS BIGINT) AS three, 'a' AS letter"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "in_between_like": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 100 AND 5000 AND c_name LIKE '%7_' AND c_name NOT LIKE '%3_'", None),
    "ilike": ("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%E%' AND p_brand NOT ILIKE 'x%'", None),
    "null_semantics": ("SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') IS NULL AS gone, NULLIF(c_nationkey, 3) = 3 AS same, COALESCE(NULLIF(c_nationkey, 3), -1) AS filled, NOT (NULLIF(c_nationkey, 3) > 5) AS small FROM customer", "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') IS NULL AS gone, NULLIF(c_nationkey, 3) = 3 AS same, CAST(COALESCE(NULLIF(c_nationkey, 3), -1) AS BIGINT) AS filled, NOT (NULLIF(c_nationkey, 3) > 5) AS small FROM customer"),
    "case_when": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS code FROM orders"),
    "cast_try": ("SELECT p_partkey, CAST(p_name AS int) AS none, CAST(p_retailprice AS int) AS whole, CAST(CAST(p_size AS text) AS float) AS back, CAST('2.7' AS int) AS cut, CAST(p_size AS bool) AS yes FROM part", "SELECT p_partkey, TRY_CAST(TRY_CAST(p_name AS DOUBLE) AS BIGINT) AS none, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(p_size AS DOUBLE) AS back, CAST(2 AS BIGINT) AS cut, CAST(p_size AS BOOLEAN) AS yes FROM part"),
    "cast_time": ("SELECT o_orderkey, CAST('2024/01/02' AS timestamp) AS slashes, CAST('2024-01-02T03:04:05+0200' AS timestamp) AS zoned, CAST('nothing' AS timestamp) AS none, CAST(STRFTIME('%Y-%m-%d', o_orderdate) AS timestamp) AS day FROM orders", "SELECT o_orderkey, TIMESTAMP '2024-01-02 00:00:00' AS slashes, TIMESTAMP '2024-01-02 01:04:05' AS zoned, CAST(NULL AS TIMESTAMP) AS none, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day FROM orders"),
    "arithmetic": ("SELECT l_orderkey, l_linenumber, -l_quantity AS minus, l_quantity / (l_linenumber - 1) AS ratio, l_orderkey / 2 AS half, l_linenumber * 2 + 1 AS odd, l_extendedprice * (1 - l_discount) AS net FROM lineitem", "SELECT l_orderkey, l_linenumber, -l_quantity AS minus, l_quantity / NULLIF(l_linenumber - 1, 0) AS ratio, l_orderkey / 2 AS half, CAST(l_linenumber * 2 + 1 AS BIGINT) AS odd, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "string_funcs": ("SELECT c_custkey, LOWER(c_name) AS lo, UPPER(c_mktsegment) AS up, LENGTH(c_name) AS n, SUBSTR(c_name, 3, 4) AS sub, SUBSTRING(c_name, 0) AS whole, LEFT(c_name, 3) AS l, RIGHT(c_name, 3) AS r, LEFT(c_name, -3) AS lneg, CONCAT(c_mktsegment, '-', c_custkey, NULL) AS cat, REPLACE(c_name, '#', '/') AS rep, LPAD(c_mktsegment, 12, '*') AS lp, RPAD(c_mktsegment, 12) AS rp, REVERSE(c_name) AS rev, REPEAT('ab', 2) AS ab, STRPOS(c_name, '#') AS pos, POSITION('0' IN c_name) AS zero, SPLIT_PART(c_name, '#', 2) AS part, SPLIT_PART(c_name, '#', 5) AS past, TRIM('  x ') AS t, LTRIM('  x') AS lt, RTRIM('x  ') AS rt, INITCAP('hello big world') AS cap FROM customer", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n, substr(c_name, 3, 4) AS sub, c_name AS whole, left(c_name, 3) AS l, right(c_name, 3) AS r, left(c_name, -3) AS lneg, concat(c_mktsegment, '-', c_custkey, NULL) AS cat, replace(c_name, '#', '/') AS rep, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, ' ') AS rp, reverse(c_name) AS rev, 'abab' AS ab, strpos(c_name, '#') AS pos, strpos(c_name, '0') AS zero, split_part(c_name, '#', 2) AS part, '' AS past, 'x' AS t, 'x' AS lt, 'x' AS rt, 'Hello Big World' AS cap FROM customer"),
    "regexp_funcs": (r"SELECT doc_id, REGEXP_REPLACE(lang, '[aeiou]', '_') AS first_only, REGEXP_REPLACE(source, '([a-z])([0-9])', '$2$1', 'g') AS swapped, REGEXP_EXTRACT(source, 'src([0-9]+)') AS num, REGEXP_EXTRACT(source, '([a-z]+)([0-9]+)', 0) AS whole, REGEXP_MATCHES(source, 'zzz') AS none FROM documents", r"SELECT doc_id, regexp_replace(lang, '[aeiou]', '_') AS first_only, regexp_replace(source, '([a-z])([0-9])', '\2\1', 'g') AS swapped, regexp_extract(source, 'src([0-9]+)', 1) AS num, regexp_extract(source, '([a-z]+)([0-9]+)', 0) AS whole, CAST(NULL AS VARCHAR) AS none FROM documents"),
    "extract_value_json": ("SELECT event_id, JSON_EXTRACT(props, 'k') AS k, JSON_EXTRACT(props, '$.missing') AS none, CAST(JSON_EXTRACT(props, 'k') AS int) + 1 AS k1, JSON_EXTRACT('{\"a\": [{\"b\": 7}]}', 'a[0].b') AS deep, EXTRACT_VALUE(port FROM 'host=a port: 80') AS port, EXTRACT_VALUE('user=\"x y\"', 'user') AS usr FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1, '7' AS deep, '80' AS port, 'x y' AS usr FROM events"),
    "json_compare": ("SELECT event_id FROM events WHERE JSON_EXTRACT(props, 'k') > 50", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50"),
    "math_funcs": ("SELECT p_partkey, ABS(-p_size) AS a, ROUND(p_retailprice, 1) AS r1, FLOOR(p_retailprice) AS fl, CEIL(p_retailprice) AS ce, SQRT(p_size) AS sq, EXP(p_size / 50) AS ex, LN(p_size) AS ln, LOG10(p_size) AS l10, LOG(p_size) AS lg, LOG(2, p_size) AS l2, POWER(p_size, 2) AS pw, MOD(p_size, 7) AS m, MOD(p_size, 0) AS mz, SIGN(p_size - 10) AS sg, TRUNC(p_retailprice, 1) AS tr, TRUNC(0 - p_retailprice) AS tn, GREATEST(p_size, 10) AS g, LEAST(p_size, NULL, 10) AS le, SQRT(-1) AS bad FROM part", "SELECT p_partkey, abs(p_size) AS a, round(p_retailprice, 1) AS r1, floor(p_retailprice) AS fl, ceil(p_retailprice) AS ce, sqrt(p_size) AS sq, exp(p_size / 50) AS ex, ln(p_size) AS ln, log10(p_size) AS l10, log10(p_size) AS lg, log(2, p_size) AS l2, power(p_size, 2) AS pw, CAST(p_size % 7 AS BIGINT) AS m, CAST(NULL AS BIGINT) AS mz, CAST(sign(p_size - 10) AS BIGINT) AS sg, trunc(p_retailprice * 10) / 10 AS tr, trunc(0 - p_retailprice) AS tn, CAST(greatest(p_size, 10) AS BIGINT) AS g, CAST(least(p_size, 10) AS BIGINT) AS le, CAST(NULL AS DOUBLE) AS bad FROM part"),
    "width_bucket": ("SELECT p_partkey, WIDTH_BUCKET(p_retailprice, 950, 1500, 10) AS b FROM part", "SELECT p_partkey, CAST(CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice >= 1500 THEN 11 ELSE floor((p_retailprice - 950) / 550 * 10) + 1 END AS BIGINT) AS b FROM part"),
    "date_trunc": ("SELECT event_id, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('week', ts) AS w, DATE_TRUNC('quarter', ts) AS q, DATE(ts) AS d FROM events", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS q, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events"),
    "date_bin": ("SELECT DATE_BIN('15 minutes', ts) AS bucket, COUNT(*) AS n, AVG(value) AS mean FROM events GROUP BY bucket", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1"),
    "date_bin_origin": ("SELECT DATE_BIN(INTERVAL '7 hours', ts, CAST('2024-01-01 01:00:00' AS timestamp)) AS bucket, COUNT(*) AS n FROM events GROUP BY 1", "SELECT time_bucket(INTERVAL '7 hours', ts, TIMESTAMP '2024-01-01 01:00:00') AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "extract_parts": ("SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS mo, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s, EXTRACT(DOW FROM ts) AS dow, EXTRACT(DOY FROM ts) AS doy, EXTRACT(EPOCH FROM ts) AS ep FROM events", "SELECT event_id, extract(year FROM ts) AS y, extract(month FROM ts) AS mo, extract(day FROM ts) AS d, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi, (extract(microsecond FROM ts) / 1000000.0)::DOUBLE AS s, extract(dow FROM ts) AS dow, extract(doy FROM ts) AS doy, epoch_us(ts) / 1000000.0::DOUBLE AS ep FROM events"),
    "interval_arith": ("SELECT event_id, ts + INTERVAL '1 day' AS next, ts - INTERVAL '90 minutes' AS prev, DATE_ADD(ts, '1 day 2 hours') AS both FROM events WHERE ts - CAST('2024-01-10' AS timestamp) > INTERVAL '36 hours'", "SELECT event_id, ts + INTERVAL '1 day' AS next, ts - INTERVAL '90 minutes' AS prev, ts + INTERVAL '26 hours' AS both FROM events WHERE epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10') > 36 * 3600000000"),
    "strftime": ("SELECT event_id, STRFTIME('%Y/%m/%d at %H:%M:%S', ts) AS f, STRFTIME('%y-%j %B %b %A %a %I%p 100%%', ts) AS g FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d at %H:%M:%S') AS f, strftime(ts, '%y-%j %B %b %A %a %I%p 100%%') AS g FROM events"),
    "tz_convert": ("SELECT event_id, CONVERT_TZ(ts, 'America/New_York') AS ny, FROM_TZ(ts, '+05:30') AS utc, TO_TIMESTAMP(event_id) AS t, AGE(ts, ts) = INTERVAL '0 seconds' AS zero FROM events", "SELECT event_id, ts - INTERVAL '5 hours' + CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL '1 hour' ELSE INTERVAL '0 hours' END AS ny, ts - INTERVAL '330 minutes' AS utc, make_timestamp(event_id * 1000000) AS t, TRUE AS zero FROM events"),
    "agg_basic": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(NULLIF(l_linenumber, 1)) AS c, SUM(l_quantity) AS q, SUM(l_linenumber) AS s, AVG(l_discount) AS a, MIN(l_shipdate) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(NULLIF(l_linenumber, 1)) AS c, sum(l_quantity) AS q, CAST(sum(l_linenumber) AS DOUBLE) AS s, avg(l_discount) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2"),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0", None),
    "agg_distinct": ("SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n, SUM(DISTINCT o_orderstatus = 'F') AS s, AVG(DISTINCT o_custkey) AS a FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT CAST(o_orderstatus = 'F' AS INT)) AS DOUBLE) AS s, avg(DISTINCT o_custkey) AS a FROM orders GROUP BY 1"),
    "agg_percentile": ("SELECT l_returnflag, MEDIAN(l_extendedprice) AS med, PERCENTILE_CONT(l_extendedprice, 0.95) AS p95, QUANTILE(l_quantity, 0.25) AS q1, PERCENTILE_DISC(l_extendedprice, 0.5) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, median(l_extendedprice) AS med, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_quantity, 0.25) AS q1, quantile_disc(l_extendedprice, 0.5) AS d FROM lineitem GROUP BY 1"),
    "agg_variance": ("SELECT o_orderpriority, STDDEV(o_totalprice) AS sd, STDDEV_POP(o_totalprice) AS sp, VARIANCE(o_totalprice) AS v, VAR_POP(o_totalprice) AS vp FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, stddev_samp(o_totalprice) AS sd, stddev_pop(o_totalprice) AS sp, var_samp(o_totalprice) AS v, var_pop(o_totalprice) AS vp FROM orders GROUP BY 1"),
    "agg_regr": ("SELECT l_returnflag, ROUND(CORR(l_extendedprice, l_quantity), 6) AS c, ROUND(COVAR_POP(l_extendedprice, l_quantity), 4) AS cp, ROUND(COVAR_SAMP(l_extendedprice, l_quantity), 4) AS cs, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 6) AS sl, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 4) AS ic, ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r2, REGR_COUNT(l_extendedprice, l_quantity) AS n, REGR_AVGX(l_extendedprice, l_quantity) AS ax, REGR_AVGY(l_extendedprice, l_quantity) AS ay FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 4) AS cp, round(covar_samp(l_extendedprice, l_quantity), 4) AS cs, round(regr_slope(l_extendedprice, l_quantity), 6) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 4) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, regr_avgx(l_extendedprice, l_quantity) AS ax, regr_avgy(l_extendedprice, l_quantity) AS ay FROM lineitem GROUP BY 1"),
    "agg_first_last": ("SELECT user_id, FIRST(value, ts) AS f, LAST(value, ts) AS l, LAST(event_type, NULLIF(value, value)) AS none FROM events GROUP BY user_id", "SELECT user_id, arg_min(value, ts) AS f, arg_max(value, ts) AS l, CAST(NULL AS VARCHAR) AS none FROM events GROUP BY 1"),
    "string_agg": ("SELECT n_regionkey, STRING_AGG(n_name, ',') AS names, STRING_AGG(DISTINCT LEFT(n_name, 7), '-') AS heads FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(DISTINCT left(n_name, 7), '-' ORDER BY left(n_name, 7)) AS heads FROM nation GROUP BY 1"),
    "string_agg_beside_distinct": ("SELECT n_regionkey, COUNT(DISTINCT LENGTH(n_name)) AS lengths, SUM(DISTINCT n_nationkey) AS s, STRING_AGG(DISTINCT LEFT(n_name, 4), '-') AS heads FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, count(DISTINCT length(n_name)) AS lengths, CAST(sum(DISTINCT n_nationkey) AS DOUBLE) AS s, string_agg(DISTINCT left(n_name, 4), '-' ORDER BY left(n_name, 4)) AS heads FROM nation GROUP BY n_regionkey"),
    "percentile_disc_distinct": ("SELECT l_returnflag, PERCENTILE_DISC(DISTINCT l_quantity, 0.5) AS mid, PERCENTILE_DISC(DISTINCT l_linenumber, 0.9) AS high, PERCENTILE_DISC(DISTINCT l_linenumber, 0) AS low, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY q) FILTER (k = 0) AS DOUBLE) AS mid, CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY q) FILTER (k = 1) AS DOUBLE) AS high, CAST(min(q) FILTER (k = 1) AS DOUBLE) AS low, count(*) FILTER (k = 2) AS n FROM (SELECT DISTINCT l_returnflag, 0 AS k, CAST(l_quantity AS DOUBLE) AS q FROM lineitem UNION ALL SELECT DISTINCT l_returnflag, 1, CAST(l_linenumber AS DOUBLE) FROM lineitem UNION ALL SELECT DISTINCT l_returnflag, 2, CAST(l_suppkey AS DOUBLE) FROM lineitem) GROUP BY l_returnflag"),
    "stddev_samp_var_samp": ("SELECT o_orderpriority, STDDEV_SAMP(o_totalprice) AS sd, VAR_SAMP(o_totalprice) AS v FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, stddev_samp(o_totalprice) AS sd, var_samp(o_totalprice) AS v FROM orders GROUP BY o_orderpriority"),
    "function_aliases": ("SELECT c_custkey, LEN(c_name) AS n, INSTR(c_name, '#') AS at, CEILING(c_acctbal) AS up, POW(c_nationkey, 2) AS sq, NOW() >= CAST('2020-01-01' AS timestamp) AS later, CURRENT_DATE() >= CAST('2020-01-01' AS timestamp) AS today, CURRENT_TIMESTAMP() >= CAST('2020-01-01' AS timestamp) AS here FROM customer", "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n, CAST(instr(c_name, '#') AS BIGINT) AS at, CAST(ceil(c_acctbal) AS DOUBLE) AS up, CAST(c_nationkey * c_nationkey AS DOUBLE) AS sq, true AS later, true AS today, true AS here FROM customer"),
    "having_expr": ("SELECT c_nationkey, COUNT(*) AS n, SUM(c_acctbal) * 100.0 / COUNT(*) AS w FROM customer GROUP BY c_nationkey HAVING SUM(c_acctbal) > 20000 AND n > 4", "SELECT c_nationkey, count(*) AS n, sum(c_acctbal) * 100.0 / count(*) AS w FROM customer GROUP BY 1 HAVING sum(c_acctbal) > 20000 AND count(*) > 4"),
    "ordinals": ("SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2", None),
    "implicit_group": ("SELECT c_mktsegment, COUNT(*) AS n FROM customer", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"),
    "group_by_expression": ("SELECT EXTRACT(YEAR FROM o_orderdate) AS y, SUM(o_totalprice) AS s FROM orders GROUP BY y", "SELECT extract(year FROM o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY 1"),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", None),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000", None),
    "join_full": ("SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 0", None),
    "join_multi_key": ("SELECT a.l_orderkey, a.l_linenumber, b.l_extendedprice FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45", None),
    "join_residual": ("SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_extendedprice > o.o_totalprice / 4", None),
    "join_theta": ("SELECT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON n.n_nationkey < r.r_regionkey * 3", None),
    "semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", None),
    "anti_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "in_subquery": ("SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE'))", None),
    "not_in_subquery": ("SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) * 1.9", None),
    "scalar_subquery_corr": ("SELECT c.c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", None),
    "subquery_then_group": ("SELECT o_orderpriority, SUM(o_totalprice) AS s FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) GROUP BY o_orderpriority", None),
    "asof_backward": ("SELECT e.event_id, p.event_id AS last_id FROM events e ASOF JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts", "SELECT e.event_id, p.event_id AS last_id FROM events e ASOF JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts"),
    "asof_left_strict": ("SELECT e.event_id, p.event_id AS last_id FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') p ON p.ts < e.ts AND e.user_id = p.user_id", "SELECT e.event_id, p.event_id AS last_id FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') p ON e.user_id = p.user_id AND e.ts > p.ts"),
    "asof_forward": ("SELECT e.event_id, p.event_id AS next_id FROM events e ASOF JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') p ON e.user_id = p.user_id AND e.ts <= p.ts", "SELECT e.event_id, p.event_id AS next_id FROM events e ASOF JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') p ON e.user_id = p.user_id AND e.ts <= p.ts"),
    "asof_no_key": ("SELECT o.o_orderkey, e.event_id FROM (SELECT o_orderkey, CAST('2024-01-01' AS timestamp) + INTERVAL '1 minute' * o_orderkey AS at FROM orders) o ASOF JOIN events e ON o.at > e.ts", "SELECT o.o_orderkey, e.event_id FROM (SELECT o_orderkey, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey) AS at FROM orders) o ASOF JOIN events e ON o.at > e.ts"),
    "window_rank": ("SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer", None),
    "window_ntile_dist": ("SELECT c_custkey, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nt, PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS pr, CUME_DIST() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS cd FROM customer", None),
    "window_lag_lead": ("SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts) AS a, LEAD(value, 2) OVER (PARTITION BY user_id ORDER BY ts) AS b, LAG(value, 1, -1) OVER (PARTITION BY user_id ORDER BY ts) AS c FROM events", None),
    "window_agg_default": ("SELECT event_id, SUM(value) OVER (PARTITION BY user_id) AS total, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts) AS running, MAX(value) OVER (PARTITION BY event_type ORDER BY ts) AS top FROM events", None),
    "window_frame_rows": ("SELECT event_id, SUM(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, MIN(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS m FROM events", None),
    "window_frame_range": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS n FROM orders", None),
    "window_frame_range_interval": ("SELECT event_id, SUM(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS s, COUNT(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS n FROM events", None),
    "window_value_nth": ("SELECT event_id, FIRST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts) AS f, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(value, 2) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM events", None),
    "window_first_last": ("SELECT event_id, LAST(value, ts) OVER (PARTITION BY user_id) AS l, FIRST(value, ts) OVER (PARTITION BY user_id) AS f FROM events", "SELECT event_id, arg_max(value, ts) OVER (PARTITION BY user_id) AS l, arg_min(value, ts) OVER (PARTITION BY user_id) AS f FROM events"),
    "window_in_expression": ("SELECT event_id, value - LAG(value) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events ORDER BY ROW_NUMBER() OVER (ORDER BY event_id)", "SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events"),
    "locf": ("SELECT event_id, LOCF(CASE WHEN event_type = 'purchase' THEN value END) OVER (PARTITION BY user_id ORDER BY ts) AS v FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS v FROM events"),
    "delta": ("SELECT event_id, DELTA(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events", "SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events"),
    "rate": ("SELECT event_id, ROUND(RATE(value, ts) OVER (PARTITION BY user_id ORDER BY ts), 8) AS r FROM events", "SELECT event_id, round(CASE WHEN dt > 0 THEN CASE WHEN dx < 0 THEN value ELSE dx END / dt END, 8) AS r FROM (SELECT event_id, value, value - lag(value) OVER w AS dx, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0 AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))"),
    "generate_series_int": ("SELECT g.n, g.n * 2 AS twice FROM generate_series(10, 1, -3) AS g(n)", "SELECT n, n * 2 AS twice FROM generate_series(10, 1, -3) AS g(n)"),
    "generate_series_ts": ("SELECT value AS t FROM generate_series(CAST('2024-01-01' AS timestamp), CAST('2024-01-03' AS timestamp), INTERVAL '6 hours')", "SELECT t FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL '6 hours') AS g(t)"),
    "gap_fill": ("SELECT g.t, r.mean AS measured, LOCF(r.mean) OVER (ORDER BY g.t) AS filled FROM generate_series(CAST('2024-01-01' AS timestamp), CAST('2024-01-05' AS timestamp), INTERVAL '5 minutes') AS g(t) LEFT JOIN (SELECT DATE_BIN('5 minutes', ts) AS bucket, AVG(value) AS mean FROM events WHERE event_type = 'error' GROUP BY bucket) r ON g.t = r.bucket", "SELECT t, mean AS measured, last_value(mean IGNORE NULLS) OVER (ORDER BY t) AS filled FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-05', INTERVAL '5 minutes') AS g(t) LEFT JOIN (SELECT time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, avg(value) AS mean FROM events WHERE event_type = 'error' GROUP BY 1) r ON t = bucket"),
    "union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None),
    "union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "set_precedence": ("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2 UNION SELECT c_nationkey FROM customer INTERSECT SELECT r_regionkey FROM region ORDER BY k", None),
    "cte_reuse": ("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT b.o_custkey, b.o_totalprice, p.n FROM big b JOIN per p ON b.o_custkey = p.o_custkey WHERE p.n > 1", None),
    "derived_table": ("SELECT seg, n FROM (SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment) AS g(seg, n) WHERE n > 100", None),
    "order_limit_offset": ("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5", None),
    "topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20", None),
    "order_nulls": ("SELECT k, p_partkey, ROW_NUMBER() OVER (ORDER BY k, p_partkey) AS place FROM (SELECT NULLIF(p_size, 1) AS k, p_partkey FROM part) x ORDER BY k, p_partkey", "SELECT k, p_partkey, row_number() OVER (ORDER BY k NULLS FIRST, p_partkey) AS place FROM (SELECT NULLIF(p_size, 1) AS k, p_partkey FROM part)"),
    "tpch_q1": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_base, SUM(l_extendedprice * (1 - l_discount)) AS sum_disc, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, AVG(l_quantity) AS avg_qty, AVG(l_discount) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= CAST('1998-09-02' AS timestamp) GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "tpch_q3": ("SELECT l.l_orderkey, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue, o.o_orderdate FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < CAST('1995-03-15' AS timestamp) AND l.l_shipdate > CAST('1995-03-15' AS timestamp) GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10", "SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY 1, 3 ORDER BY revenue DESC, l_orderkey LIMIT 10"),
    "tpch_q5": ("SELECT n.n_name, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = n.n_nationkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name", None),
    "tpch_q6": ("SELECT SUM(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", None),
    "revenue_by_month": ("SELECT r.r_name, DATE_TRUNC('month', o.o_orderdate) AS month, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue, COUNT(DISTINCT o.o_orderkey) AS orders FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name, month HAVING SUM(l.l_extendedprice) > 1000 ORDER BY revenue DESC, r_name, month LIMIT 20", "SELECT r_name, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(DISTINCT o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING sum(l_extendedprice) > 1000 ORDER BY revenue DESC, r_name, month LIMIT 20"),
}

#: name: statements before, then (dialect, DuckDB).
SESSIONS: dict[str, tuple[list[str], str, str]] = {
    "view": (["CREATE VIEW asia AS SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", "CREATE OR REPLACE VIEW asia_customers AS SELECT c.c_custkey, a.n_name FROM customer c JOIN asia a ON c.c_nationkey = a.n_nationkey"], "SELECT n_name, COUNT(*) AS n FROM asia_customers GROUP BY n_name", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"),
    "matview": (["CREATE MATERIALIZED VIEW seg AS SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment WITH NO DATA", "REFRESH MATERIALIZED VIEW seg"], "SELECT c_mktsegment, n FROM seg WHERE n > 100", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 100"),
}
