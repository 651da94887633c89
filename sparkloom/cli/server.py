"""HTTP and JSON: queries, sources, schemas, uploads, functions, templates, dashboards and exports, and a page to type in."""

from __future__ import annotations

import json
import os
import re
import tempfile
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .. import dashboards, render, templates
from ..functions import aggregates, scalar, windows
from ..session import Engine
from ..sources import OPENERS

CAP = 5000
PAGE = """<!DOCTYPE html><meta charset="utf-8"><title>sparkloom</title><style>body{font:14px sans-serif;margin:2em}textarea{width:100%;height:8em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px}</style>
<textarea id=q>SELECT 1 AS one</textarea><p><button onclick=go()>Run</button> <span id=s></span></p><div id=r></div><script>
async function go(){const a=await fetch('/api/query',{method:'POST',body:JSON.stringify({query:q.value})}),j=await a.json();s.textContent=j.error||j.notice||(j.rows.length+' rows'+(j.truncated?' (truncated)':''));r.replaceChildren();if(!j.columns)return;const t=document.createElement('table');for(const row of [j.columns.map(c=>c.name),...j.rows]){const e=t.insertRow();for(const v of row)e.insertCell().textContent=v===null?'':typeof v=='object'?JSON.stringify(v):v}r.append(t)}</script>"""


class Service:
    """What the handlers do, apart from HTTP. Statements that change the session run one at a time."""

    def __init__(self, engine: Engine, cap: int | None = None):
        self.engine, self.cap, self.lock = engine, cap or CAP, threading.Lock()
        self.boards: dict[str, dict] = {}
        self.uploads = os.path.join(tempfile.gettempdir(), f"sparkloom-uploads-{os.getpid()}")

    def query(self, text: str, most: int | None = None) -> dict:
        with self.lock:
            result = self.engine.execute(text)
        if result.frame is None:
            return {"notice": result.notice}
        cap = min(most or self.cap, self.cap)
        rows = result.frame.limit(cap + 1).collect()
        return {"columns": [{"name": n, "type": k} for n, k in result.columns], "rows": [[render.plain(v) for v in r] for r in rows[:cap]], "truncated": len(rows) > cap}

    def functions(self) -> dict:
        return {"scalar": sorted(scalar.SCALARS), "aggregate": sorted(aggregates.AGGREGATES), "window": sorted(windows.NAMES)}

    def upload(self, name: str, content: bytes) -> dict:
        safe = re.sub(r"[^\w.-]", "_", os.path.basename(name)).lstrip(".")
        stem, ext = os.path.splitext(safe)
        prefix = {".csv": "csv", ".json": "json", ".ndjson": "json", ".yaml": "yaml", ".yml": "yaml", ".xlsx": "excel", ".parquet": "parquet", ".log": "log"}.get(ext.lower())
        if not prefix:
            raise ValueError(f"unknown kind of file {ext}")
        os.makedirs(self.uploads, exist_ok=True)
        with open(os.path.join(self.uploads, safe), "wb") as f:
            f.write(content)
        table = re.sub(r"\W+", "_", stem).lower()
        self.engine.register(table, f"{prefix}:{os.path.join(self.uploads, safe)}")
        return {"source": table}

    def mine(self, lines: list[str]) -> list[dict]:
        return [{"template": t.text(), "pattern": t.pattern(), "count": t.count, "examples": t.examples} for t in templates.mine(lines)]

    def snapshot(self, name: str, text: str) -> dict:
        """A result as it is now, as a source."""
        with self.lock:
            self.engine.register(name, self.engine.query(text).cache())
        return {"source": name}

    def handle(self, method: str, path: str, args: dict, body: bytes) -> tuple[int, str, bytes]:
        if path == "/":
            return 200, "text/html; charset=utf-8", PAGE.encode()
        said = {}
        if body and path != "/api/upload":
            said = json.loads(body)
        asked = args | said
        if path == "/api/query":
            out = self.query(asked["query"], asked.get("max_rows"))
        elif path == "/api/sources" and method == "GET":
            out = [{"name": n, "kind": k} for n, k in self.engine.names().items()]
        elif path == "/api/sources" and method == "POST":
            self.engine.register(asked["name"], asked["ref"], **asked.get("options", {}))
            out = {"source": asked["name"]}
        elif path == "/api/sources" and method == "DELETE":
            self.engine.drop_source(asked["name"])
            out = {"dropped": asked["name"]}
        elif path == "/api/schema":
            out = [{"name": n, "type": t} for n, t in self.engine.schema(asked["source"])]
        elif path == "/api/upload":
            out = self.upload(args["name"], body)
        elif path == "/api/functions":
            out = self.functions()
        elif path == "/api/connectors":
            out = sorted(OPENERS)
        elif path == "/api/loginfer":
            out = self.mine(asked["lines"])
        elif path == "/api/snapshot":
            out = self.snapshot(asked["name"], asked["query"])
        elif path == "/api/explain":
            out = {"plan": self.engine.explain(asked["query"])}
        elif path == "/api/dashboards" and method == "GET":
            out = sorted(self.boards)
        elif path == "/api/dashboards" and method == "POST":
            self.boards[asked["name"]] = dashboards.load(asked["yaml"])
            out = {"dashboard": asked["name"]}
        elif path == "/api/dashboards" and method == "DELETE":
            out = {"dropped": bool(self.boards.pop(asked["name"], None))}
        elif path.startswith("/dashboards/"):
            return 200, "text/html; charset=utf-8", dashboards.render(self.engine, self.boards[path.rsplit("/", 1)[-1]], args).encode()
        elif path == "/api/export":
            how = asked.get("format", "csv")
            if how == "parquet":
                return 200, "application/vnd.apache.parquet", self._parquet(asked["query"])
            kinds = {"csv": "text/csv", "json": "application/json", "ndjson": "application/x-ndjson", "yaml": "application/yaml"}
            return 200, kinds.get(how, "text/plain"), "\n".join(render.lines(self.engine.query(asked["query"]), how)).encode() + b"\n"
        else:
            return 404, "application/json", b'{"error": "not found"}'
        return 200, "application/json", json.dumps(out).encode()

    def _parquet(self, text: str) -> bytes:
        import io

        import pyarrow.parquet as pq

        out = io.BytesIO()
        pq.write_table(self.engine.query(text).limit(self.cap).toArrow(), out)
        return out.getvalue()


def server(engine: Engine, host: str = "127.0.0.1", port: int = 0, cap: int | None = None) -> ThreadingHTTPServer:
    service = Service(engine, cap)

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            where = urllib.parse.urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, kind, content = service.handle(self.command, where.path, dict(urllib.parse.parse_qsl(where.query)), body)
            except KeyError as e:
                status, kind, content = 400, "application/json", json.dumps({"error": f"missing {e}"}).encode()
            except Exception as e:
                status, kind, content = 400, "application/json", json.dumps({"error": str(e).splitlines()[0]}).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, host: str, port: int, cap: int | None = None) -> None:
    with server(engine, host, port, cap) as s:
        print(f"http://{host}:{s.server_address[1]}/")
        s.serve_forever()
