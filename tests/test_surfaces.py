"""Renderers, the command line, the prompt, services, dashboards, configuration and streaming."""

import io
import json
import threading
import urllib.request

import pytest

from sparkloom import config, dashboards, render, streaming
from sparkloom.cli.__main__ import main
from sparkloom.cli.repl import Repl
from sparkloom.cli.server import server
from sparkloom.cli.tools import Tools
from sparkloom.plans.tree import DialectError


@pytest.fixture
def e(engine, spark):
    engine.register("t", spark.createDataFrame([(1, "a,b", None), (2, None, 2.5)], "id bigint, s string, x double"))
    return engine


@pytest.mark.parametrize(
    "how, text",
    [
        ("table", "id | s    | x\n----+------+------\n1  | a,b  | NULL\n2  | NULL | 2.5\n(2 rows)"), ("csv", 'id,s,x\n1,"a,b",\n2,,2.5'), ("ndjson", '{"id": 1, "s": "a,b", "x": null}\n{"id": 2, "s": null, "x": 2.5}'),
        ("json", '[\n  {"id": 1, "s": "a,b", "x": null},\n  {"id": 2, "s": null, "x": 2.5}\n]'), ("yaml", '- id: 1\n  s: "a,b"\n  x: null\n- id: 2\n  s: null\n  x: 2.5'), ("raw", "1\ta,b\t\n2\t\t2.5"),
    ],
)
def test_renderers(e, how, text):
    assert "\n".join(render.lines(e.query("SELECT * FROM t ORDER BY id"), how)) == text


def test_export(e, spark, tmp_path):
    render.export(e.query("SELECT * FROM t"), str(tmp_path / "out"), partition_by=["id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "o.csv").write_text("k,v\nwest,50.5\nwest,15.25\neast,1\n")
    (tmp_path / "sparkloom.yaml").write_text("sources:\n  o: {connector: csv, path: o.csv}\ndefaults: {output: csv}\n")
    assert main(["SELECT k, SUM(v) AS s FROM o GROUP BY k ORDER BY s DESC"], spark) == 0
    assert capsys.readouterr().out == "k,s\nwest,65.75\neast,1.0\n"
    assert main(["-o", "json", "--max-rows", "1", "SELECT v FROM o ORDER BY v"], spark) == 0
    assert json.loads(capsys.readouterr().out) == [{"v": 1.0}]
    assert main(["--explain", "SELECT k FROM o WHERE v > 3"], spark) == 0
    assert "PushedFilters" in capsys.readouterr().out
    (tmp_path / "q.sql").write_text("CREATE VIEW w AS SELECT 1 AS one;")
    assert main(["-f", "q.sql"], spark) == 0 and "created" in capsys.readouterr().out
    assert main(["SELECT nope FROM o"], spark) == 1 and "error:" in capsys.readouterr().err


def test_prompt(e):
    out = io.StringIO()
    said = ".tables\n.schema t\n.output csv\nSELECT id\nFROM t ORDER BY id;\n.functions\n.strict on\nSELECT nope;\n.help\n.quit\nSELECT 1;\n"
    Repl(e, source=io.StringIO(said), out=out).loop()
    text = out.getvalue()
    assert "id int\ns string\nx float" in text and "id\n1\n2\n" in text and "locf" in text and "error:" in text and ".quit" in text and "one" not in text
    assert e.strict


def test_http_service(e):
    with server(e, cap=1) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        root = f"http://127.0.0.1:{s.server_address[1]}"

        def ask(path, body=None, method=None):
            data = body if isinstance(body, bytes) else json.dumps(body).encode() if body is not None else None
            try:
                with urllib.request.urlopen(urllib.request.Request(root + path, data, method=method)) as r:
                    raw = r.read()
                    return json.loads(raw) if "json" in r.headers["Content-Type"] else raw
            except urllib.error.HTTPError as x:
                return x.code, json.loads(x.read())

        assert ask("/api/query", {"query": "SELECT id FROM t ORDER BY id"}) == {"columns": [{"name": "id", "type": "int"}], "rows": [[1]], "truncated": True}
        assert "notice" in ask("/api/query", {"query": "CREATE VIEW vv AS SELECT 1 AS x"})
        assert ask("/api/query", {"query": "SELECT"})[0] == 400 and ask("/nope")[0] == 404
        assert ask("/api/upload?name=Up%20load.csv", b"a,b\n1,2\n") == {"source": "up_load"}
        assert {"name": "up_load", "kind": "csv"} in ask("/api/sources") and ask("/api/schema?source=up_load")[0]["name"] == "a"
        assert "json" in ask("/api/connectors") and "lower" in ask("/api/functions")["scalar"]
        assert ask("/api/loginfer", {"lines": ["a 1", "a 2"]})[0]["template"] == "a <num>"
        assert ask("/api/export?format=csv", {"query": "SELECT id FROM t WHERE id = 2"}) == b"id\n2\n"
        assert ask("/api/export", {"query": "SELECT id FROM t", "format": "parquet"})[:4] == b"PAR1"
        assert ask("/api/snapshot", {"name": "snap", "query": "SELECT id FROM t"}) == {"source": "snap"}
        assert ask("/api/sources?name=snap", method="DELETE") == {"dropped": "snap"}
        assert b"<textarea" in ask("/")
        ask("/api/dashboards", {"name": "d", "yaml": "title: B\npanels: [{title: P, query: 'SELECT id FROM t'}]"})
        assert ask("/api/dashboards") == ["d"] and b"<h2>P</h2>" in ask("/dashboards/d")
        s.shutdown()


def test_tools(e):
    tools = Tools(e)

    def call(tool, /, **a):
        return tools.answer({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": a}})["result"]

    assert tools.answer({"id": 1, "method": "initialize"})["result"]["capabilities"] == {"tools": {}}
    assert {t["name"] for t in tools.answer({"id": 2, "method": "tools/list"})["result"]["tools"]} >= {"query", "describe_source", "render_dashboard"}
    assert json.loads(call("query", query="SELECT id FROM t ORDER BY id", max_rows=1)["content"][0]["text"])["rows"] == [[1]]
    assert call("query", query="SELEC")["isError"]
    assert json.loads(call("describe_source", name="t")["content"][0]["text"])[0] == {"name": "id", "type": "int"}
    call("save_dashboard", name="d", yaml="panels: [{query: 'SELECT id FROM t WHERE id = {{n}}'}]\nvariables: [{name: n, default: 2}]")
    assert json.loads(call("render_dashboard", name="d")["content"][0]["text"])[0]["rows"] == [[2]]
    assert tools.answer({"method": "notifications/initialized"}) is None and "error" in tools.answer({"id": 3, "method": "x"})


def test_dashboards(e):
    assert dashboards.substituted("{{a}} {{ b }} {{c:raw}}", {"a": "it's", "b": 5, "c": "x DESC"}) == "'it''s' 5 x DESC"
    board = dashboards.load("title: T <1>\nvariables: [{name: low, default: 0}]\npanels:\n- {title: A, query: 'SELECT id, s, x FROM t WHERE id > {{low}}'}\n- {title: L, type: line, x: id, y: x, query: 'SELECT id, x FROM t'}\n- {title: P, type: pivot, rows: id, columns: s, query: 'SELECT id, s FROM t WHERE s IS NOT NULL'}\n- {title: E, query: 'SELECT nope FROM t'}")
    made = dashboards.panels(e, board, {"low": 1})
    assert made[0]["rows"] == [[2, None, 2.5]] and made[2]["columns"] == ["id", "a,b"] and "nope" in made[3]["error"]
    page = dashboards.render(e, board)
    assert "T &lt;1&gt;" in page and "<polyline" in page and "class='error'" in page
    for bad in ("[]", "panels: [{title: x}]"):
        with pytest.raises(DialectError):
            dashboards.load(bad)


def test_configuration(engine, tmp_path, monkeypatch):
    monkeypatch.setenv("SPARKLOOM_A", "x")
    assert config.filled({"a": ["${SPARKLOOM_A}-${NO_B:-d}"]}, {"SPARKLOOM_A": "x"}) == {"a": ["x-d"]}
    with pytest.raises(DialectError):
        config.filled("${NO_B}", {})
    (tmp_path / ".env").write_text("# c\nexport FILE_C='o.csv'\nD=1 # no\n")
    assert config.dotenv(str(tmp_path / ".env")) == {"FILE_C": "o.csv", "D": "1"}
    (tmp_path / "o.csv").write_text("a\n1\n")
    (tmp_path / "c.yaml").write_text("sources:\n- {name: o, connector: csv, path: '${FILE_C}'}\n")
    config.load(engine, str(tmp_path / "c.yaml"))
    assert engine.query("SELECT a FROM o").first()[0] == 1
    (tmp_path / "bad.yaml").write_text("sources: {o: {connector: http, url: 'http://x', bearer: open}}\n")
    with pytest.raises(DialectError, match="variable"):
        config.load(engine, str(tmp_path / "bad.yaml"))


def test_streaming_buckets_equal_the_batch(spark, engine, tmp_path):
    src = spark.sql("SELECT id, TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, id * 61) AS ts, id % 3 AS k, CAST(id AS DOUBLE) AS v FROM range(200)")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = streaming.bucketed(stream, "ts", "15 minutes", "1 hour", ["k"], "v").writeStream.format("memory").queryName("buckets").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    engine.register("src", src)
    want = engine.query("SELECT DATE_BIN('15 minutes', ts) AS bucket, k, COUNT(*) AS n, SUM(v) AS total, AVG(v) AS mean FROM src GROUP BY bucket, k")
    assert sorted(map(tuple, spark.table("buckets").collect())) == sorted(map(tuple, want.collect()))
    assert streaming.sessions(src, "ts", "5 minutes", "1 hour", ["k"]).count() == 3
