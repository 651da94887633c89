"""Files, logs, databases, HTTP, plugins and templates."""

import datetime as dt
import http.server
import json
import sqlite3
import threading
import zipfile

import pytest

from sparkloom import templates
from sparkloom.plans.tree import DialectError
from sparkloom.sources import Spec, load, logs, register_source
from sparkloom.sources.files import expanded, sheet_names, yaml_records


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv(engine, tmp_path):
    p = put(tmp_path / "orders.csv", "order_id,amount,region,at\n101,50.50,west,2024-01-01T00:00:00\n102,120.00,east\n103,,\"a, b\",x\n")
    df = engine.query(f"SELECT * FROM csv:{p}")
    assert df.dtypes == [("order_id", "int"), ("amount", "double"), ("region", "string"), ("at", "string")] or df.dtypes[0] == ("order_id", "bigint")
    assert [tuple(r) for r in df.orderBy("order_id").collect()] == [(101, 50.5, "west", "2024-01-01T00:00:00"), (102, 120.0, "east", None), (103, None, "a, b", "x")]
    put(tmp_path / "semi.csv", "a;b\n1;2\n")
    engine.register("semi", "csv:semi.csv", delimiter=";")
    assert engine.query("SELECT a + b AS s FROM semi").first()[0] == 3


def test_json(engine, tmp_path):
    put(tmp_path / "users.json", json.dumps([{"id": 1, "name": "Alice", "age": 30, "tags": {"k": [{"z": "no"}, {"z": "deep"}]}}, {"id": 2, "name": "Bob", "age": 25}], indent=1))
    put(tmp_path / "lines.ndjson", '{"b": 1, "a": "x"}\n{"b": 2}\n')
    put(tmp_path / "empty.json", "")
    engine.register("users", "json:users.json")
    assert engine.query("SELECT * FROM users").columns == ["age", "id", "name", "tags"]
    assert engine.query("SELECT name, JSON_EXTRACT(tags, 'k[1].z') AS z FROM users WHERE age > 28").collect() == [("Alice", "deep")]
    assert engine.query(f"SELECT SUM(b) AS s FROM json:{tmp_path}/lines.ndjson").first()[0] == 3.0
    assert engine.query(f"SELECT * FROM json:{tmp_path}/empty.json").count() == 0


def test_yaml(engine, tmp_path):
    p = put(tmp_path / "p.yaml", "- {id: 1, name: a, price: 1.5, tags: [x, y]}\n- {id: 2, name: b, price: 2}\n---\nid: 3\nname: c\n")
    got = engine.query(f"SELECT id, price FROM yaml:{p} ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, 1.5), (2, 2.0), (3, None)]
    assert yaml_records(b"5") == [{"value": 5}]


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Regions" sheetId="1" r:id="r1"/><sheet name="Q 2" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>region</t></si><si><t>we</t><t>st</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>target</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>10</v></c><c r="C2" t="b"><v>1</v></c></row><row><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="str"><v>q</v></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>')


def test_excel(engine, spark, tmp_path):
    workbook(tmp_path / "r.xlsx")
    got = engine.query(f"SELECT * FROM excel:{tmp_path}/r.xlsx")
    assert got.columns == ["region", "target", "col3"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [("west", 10.0, True), (None, 2.5, None)]
    assert sheet_names((tmp_path / "r.xlsx").read_bytes()) == ["Regions", "Q 2"]
    every = expanded(spark, "r", Spec("excel", "r.xlsx", {"sheet": "*"}), str(tmp_path))
    assert sorted(every) == ["r_q_2", "r_regions"]
    assert load(spark, every["r_q_2"], str(tmp_path)).collect() == [(7,)]


@pytest.fixture
def db(tmp_path):
    with sqlite3.connect(tmp_path / "d.db") as c:
        c.execute("CREATE TABLE readings (station TEXT, ts TIMESTAMP, flow REAL, n INTEGER)")
        c.executemany("INSERT INTO readings VALUES (?, ?, ?, ?)", [("a", "2024-01-01 00:01:00", 1.0, 1), ("a", "2024-01-01 00:07:00", 2.0, None), ("b", "2024-01-01T00:02:00Z", 4.0, 3)])
        c.execute("CREATE VIEW v AS SELECT station FROM readings")
    return tmp_path / "d.db"


def test_sqlite(engine, spark, db):
    engine.register("readings", f"sql:{db}", table="readings")
    assert engine.query("SELECT DATE_BIN('5 minutes', ts) AS b, SUM(flow) AS s FROM readings WHERE station IN ('a', 'b') AND flow >= 1 GROUP BY b ORDER BY b").collect() == [(dt.datetime(2024, 1, 1), 5.0), (dt.datetime(2024, 1, 1, 0, 5), 2.0)]
    assert engine.query("SELECT station FROM readings WHERE n IS NULL").collect() == [("a",)]
    engine.register("q", f"sql:{db}", query="SELECT count(*) AS c FROM readings")
    assert engine.query("SELECT c FROM q").first()[0] == 3
    assert sorted(expanded(spark, "d", Spec("sql", str(db), {"table": "*"}), "/")) == ["d_readings", "d_v"]
    with pytest.raises(DialectError, match="name a table"):
        engine.query(f"SELECT * FROM sql:{db}")


def test_sqlite_filters_are_bound_parameters(db):
    from pyspark.sql.datasource import EqualTo
    from pyspark.sql.types import StringType, StructField, StructType

    from sparkloom.sources.sqlite import PushingReader

    r = PushingReader(str(db), '"readings"', StructType([StructField("station", StringType())]), True)
    assert len(list(r.pushFilters([EqualTo(("station",), "b' OR '1'='1")]))) == 1
    assert r.where == ['"station" = ?'] and list(r.read(r.partitions()[0])) == []


LOGS = {
    "combined": ['10.0.0.1 - bob [10/Oct/2023:13:55:36 +0000] "GET /a HTTP/1.1" 200 512 "-" "curl/8"', '10.0.0.2 - - [10/Oct/2023:13:55:37 +0000] "POST /b HTTP/1.1" 404 - "http://x" "m"'],
    "common": ['10.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "GET /a HTTP/1.0" 200 10'],
    "syslog": ["Oct 11 22:14:15 web sshd[42]: Failed password", "<13>Oct  1 02:14:15 db cron: run"],
    "leveled": ["2024-01-02 03:04:05,250 INFO started", "2024-01-02T03:04:06Z [ERROR] broke"],
    "logfmt": ['sev=low text="pump started" code=17 load=0.25', 'sev=high text=leak code=99 load=3'],
    "json": ['{"level": "info", "port": 80}', '{"level": "warn", "msg": "x"}'],
    "raw": ["anything", "at all"],
}


@pytest.mark.parametrize("form", LOGS)
def test_log_detection(form):
    assert logs.detect(LOGS[form]) == form


def frame(spark, lines, **options):
    return logs.frame(spark.createDataFrame([(x,) for x in lines], "value string"), Spec("log", "", options))


def test_log_rows(spark):
    got = frame(spark, [*LOGS["combined"], "garbage"], format="combined")
    assert got.columns == ["host", "ident", "user", "time", "method", "path", "protocol", "status", "bytes", "referer", "user_agent", "raw"]
    rows = got.collect()
    assert (rows[0]["time"], rows[0]["status"], rows[0]["path"], rows[1]["bytes"], rows[2]["raw"], rows[2]["host"]) == (dt.datetime(2023, 10, 10, 13, 55, 36), 200, "/a", None, "garbage", None)
    a, b = frame(spark, LOGS["logfmt"]).collect()
    assert (a["text"], a["code"], b["load"], b["text"]) == ("pump started", 17, 3.0, "leak")
    a, b = frame(spark, LOGS["leveled"]).collect()
    assert (a["time"], a["level"], b["time"], b["message"]) == (dt.datetime(2024, 1, 2, 3, 4, 5, 250000), "INFO", dt.datetime(2024, 1, 2, 3, 4, 6), "broke")
    assert [r["port"] for r in frame(spark, [*LOGS["json"], "x"], format="json").orderBy("port").collect()] == [None, None, 80]
    assert frame(spark, LOGS["syslog"]).select("host", "app", "pid").collect() == [("web", "sshd", 42), ("db", "cron", None)]
    got = frame(spark, ["u=1 t=ab", "zz"], pattern=r"u=(?P<u>\d+) t=(?P<t>\w+)").collect()
    assert [tuple(r) for r in got] == [(1, "ab", None), (None, None, "zz")]
    for bad in ("(", r"\d+"):
        with pytest.raises(DialectError):
            frame(spark, ["x"], pattern=bad)


def test_late_keys_and_values_are_kept(spark):
    lines = [f"sev=low code={i}" for i in range(300)] + ["sev=high code=none extra=1 extra=2", "no pairs at all", 'sev="a b" code=']
    got = frame(spark, lines, format="logfmt")
    assert got.columns == ["sev", "code", "extra", "raw"] and dict(got.dtypes) == {"sev": "string", "code": "string", "extra": "bigint", "raw": "string"}
    rows = [tuple(r) for r in got.collect()]
    assert rows[0] == ("low", "0", None, None) and rows[300:] == [("high", "none", 1, None), (None, None, None, "no pairs at all"), ("a b", None, None, None)]
    got = frame(spark, [f"n={i}" for i in range(300)] + ["n=x"], pattern=r"n=(?P<n>\w+)")
    assert got.dtypes[0] == ("n", "string") and got.collect()[300][0] == "x"


def test_log_file(engine, tmp_path):
    put(tmp_path / "app.log", "\n".join(LOGS["leveled"]) + "\n\n")
    assert engine.query(f"SELECT level, COUNT(*) AS n FROM log:{tmp_path}/app.log GROUP BY level ORDER BY level").collect() == [("ERROR", 1), ("INFO", 1)]


def test_transcripts(spark, tmp_path):
    lines = [
        {"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "uuid": "u2", "sessionId": "s", "timestamp": "2024-01-01T00:00:01Z", "message": {"role": "assistant", "model": "m-1", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t", "name": "run", "input": {"a": 1}}], "usage": {"input_tokens": 1000000, "output_tokens": 500000}}},
        {"type": "user", "uuid": "u3", "sessionId": "s", "timestamp": "2024-01-01T00:00:02Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": "no"}]}},
    ]
    put(tmp_path / "t.jsonl", "\n".join(map(json.dumps, lines)))
    shape = lambda **o: load(spark, Spec("transcripts", str(tmp_path / "t.jsonl"), o))
    assert shape(prices='{"m": [2, 4, 0, 0]}').orderBy("uuid").select("text", "input_tokens", "cost_usd").collect() == [("hi", None, None), ("ok", 1000000, 4.0), (None, None, None)]
    assert shape(shape="tools").select("tool", "tool_id").collect() == [("run", "t")]
    assert shape(shape="tool_results").select("tool_id", "is_error", "content").collect() == [("t", True, "no")]


@pytest.fixture(scope="module")
def web():
    answers = {
        "/data": {"out": {"items": [{"a": 1, "n": {"x": 2}}, {"a": 2}], "names": ["p", "q"]}},
        "/api/v1/query_range": {"data": {"result": [{"metric": {"__name__": "up", "job": "j"}, "values": [[1700000000, "1"], [1700000060, "NaN"]]}]}},
        "/graphql": {"data": {"issues": {"nodes": [{"id": "1", "title": "t", "state": {"name": "Todo"}}]}}},
        "/1/members/me/boards": [{"id": "b", "name": "B"}],
        "/api/ds/query": {"results": {"A": {"frames": [{"schema": {"fields": [{"name": "t"}, {"name": "v"}]}, "data": {"values": [[1, 2], [3.5, 4.5]]}}]}}},
        "/o/p/_apis/wit/wiql": {"workItems": [{"id": 7}]},
        "/o/p/_apis/wit/workitems": {"value": [{"id": 7, "fields": {"System.Title": "T", "System.AssignedTo": {"displayName": "N"}}}]},
        "/v1/workspaces/w/query": {"tables": [{"columns": [{"name": "a"}], "rows": [[1], [2]]}]},
        "/providers/Microsoft.ResourceGraph/resources": {"data": [{"name": "vm"}]},
        "/res/providers/microsoft.insights/metrics": {"value": [{"id": "r", "name": {"value": "cpu"}, "unit": "Percent", "timeseries": [{"metadatavalues": [], "data": [{"timeStamp": "2024-01-01T00:00:00Z", "average": 5.0}]}]}]},
        "/T()": {"value": [{"PartitionKey": "p"}]},
        "/1/datasets": [{"name": "d"}],
    }

    class Handler(http.server.BaseHTTPRequestHandler):
        def _do(self):
            self.rfile.read(int(self.headers.get("Content-Length") or 0))
            body = json.dumps({"got": self.headers.get("Authorization"), "method": self.command, "x": self.headers.get("X-A")} if self.path == "/echo" else answers[self.path.split("?")[0]]).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = _do

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_http(engine, spark, web):
    engine.register("items", f"{web}/data", path="out.items")
    assert engine.query("SELECT a, JSON_EXTRACT(n, 'x') AS x FROM items ORDER BY a").collect() == [(1, "2"), (2, None)]
    assert sorted(r[0] for r in load(spark, Spec("http", f"{web}/data", {"path": "out.names"})).collect()) == ["p", "q"]
    assert load(spark, Spec("http", f"{web}/echo", {"bearer": "tok", "body": "{}", "header_X_A": "1"})).collect() == [("Bearer tok", "POST", "1")]


@pytest.mark.parametrize(
    "prefix, path, options, expected",
    [
        ("prom", "up", {"start": "1700000000", "end": "1700000060"}, [("j", "up", dt.datetime(2023, 11, 14, 22, 13, 20), 1), ("j", "up", dt.datetime(2023, 11, 14, 22, 14, 20), None)]),
        ("linear", "issues", {"suffix": "/graphql"}, [("1", "Todo", "t")]), ("trello", "boards", {}, [("b", "B")]), ("grafana", "q", {}, [(1, 3.5), (2, 4.5)]), ("azuredevops", "o/p", {}, [("N", 7, "T")]), ("azlogs", "T", {"workspace": "w"}, [(1,), (2,)]),
        ("azrgraph", "Resources", {}, [("vm",)]), ("azmetrics", "/res", {"metric": "cpu"}, [("average", "cpu", "r", "2024-01-01T00:00:00Z", "Percent", 5)]), ("azuretables", "T", {}, [("p",)]), ("honeycomb", "datasets", {}, [("d",)]),
    ],
)
def test_services(spark, web, prefix, path, options, expected):
    options = dict(options)
    got = load(spark, Spec(prefix, path, {"endpoint": web + options.pop("suffix", "")} | options)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(expected, key=repr)


def test_services_that_cannot_be_reached(spark):
    with pytest.raises(DialectError):
        load(spark, Spec("honeycomb", "events/d"))
    with pytest.raises(DialectError):
        load(spark, Spec("dynamodb", "t"))
    with pytest.raises(DialectError):
        load(spark, Spec("nope", "x"))


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_plugin(engine, spark, pushed):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)

    def rows(options, part, filters):
        assert bool(filters) == (pushed == "true")
        least = max([v for op, c, v in filters if op == ">" and c == "n"], default=-1)
        return ((i, f"p{part}") for i in range(part * 5, part * 5 + 5) if i > least)

    register_source("ticks", [("n", "bigint"), ("part", "string")], rows, lambda options: [0, 1])
    assert engine.query("SELECT n, part FROM ticks:all WHERE n > 7 ORDER BY n").collect() == [(8, "p1"), (9, "p1")]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_templates(spark):
    lines = [f"2024-01-02 03:04:{i:02d} user {i} logged in from 10.0.0.{i}" for i in range(9)] + ["disk full on sda", "disk full on sdb", "disk full on sdc"]
    found = templates.mine(lines)
    assert [(t.text(), t.count) for t in found] == [("<time> user <num> logged in from <ip>", 9), ("disk full on <*>", 3)]
    import re

    m = re.match(found[0].pattern(), lines[4])
    assert m and m["user"] == "4" and "10.0.0.4" in m.groups()
    assert templates.common(["a b 1 c", "a b 22 d c"]).text() == "a b <num> <*> c"
    df = spark.createDataFrame([(x,) for x in [*lines, "other"]], "value string")
    assert dict(templates.count(df).collect()) == {"<time> user <num> logged in from <ip>": 9, "disk full on <*>": 3, "other": 1}
    late = spark.createDataFrame([(f"line number {i}",) for i in range(7000)] + [("seen at the very end only",)], "value string").repartition(5)
    assert dict(templates.count(late).collect()) == {"line number <num>": 7000, "seen at the very end only": 1}
