"""A tool server: JSON-RPC a line, for programs that call tools by name (Model Context Protocol over standard input and output)."""

from __future__ import annotations

import json

from .. import dashboards
from ..session import Engine
from .server import Service

CAP = 200


def _tool(name: str, text: str, /, **args: str) -> dict:
    needed = [k for k, v in args.items() if not v.endswith("?")]
    return {"name": name, "description": text, "inputSchema": {"type": "object", "properties": {k: {"type": v.rstrip("?")} for k, v in args.items()}, "required": needed}}


TOOLS = [
    _tool("query", "Run a statement; at most max_rows rows come back", query="string", max_rows="integer?"), _tool("list_sources", "All relations"), _tool("describe_source", "A relation's columns", name="string"),
    _tool("add_source", "Register prefix:path under a name", name="string", ref="string", options="object?"), _tool("remove_source", "Drop a source", name="string"), _tool("list_connectors", "All prefixes"), _tool("list_functions", "All functions"),
    _tool("list_dashboards", "All dashboards"), _tool("get_dashboard", "A dashboard", name="string"), _tool("save_dashboard", "Put a dashboard", name="string", yaml="string"), _tool("delete_dashboard", "Drop a dashboard", name="string"), _tool("render_dashboard", "A dashboard's panels", name="string", values="object?"),
]


class Tools:
    def __init__(self, engine: Engine):
        self.engine, self.service = engine, Service(engine)

    def call(self, name: str, a: dict) -> object:
        s = self.service
        if name == "query":
            return s.query(a["query"], min(int(a.get("max_rows") or CAP), s.cap))
        if name == "list_sources":
            return self.engine.names()
        if name == "describe_source":
            return [{"name": n, "type": t} for n, t in self.engine.schema(a["name"])]
        if name == "add_source":
            self.engine.register(a["name"], a["ref"], **(a.get("options") or {}))
            return {"source": a["name"]}
        if name == "remove_source":
            self.engine.drop_source(a["name"])
            return {"dropped": a["name"]}
        if name == "list_connectors":
            from ..sources import OPENERS

            return sorted(OPENERS)
        if name == "list_functions":
            return s.functions()
        if name == "list_dashboards":
            return sorted(s.boards)
        if name == "get_dashboard":
            return s.boards[a["name"]]
        if name == "save_dashboard":
            s.boards[a["name"]] = dashboards.load(a["yaml"])
            return {"dashboard": a["name"]}
        if name == "delete_dashboard":
            return {"dropped": bool(s.boards.pop(a["name"], None))}
        if name == "render_dashboard":
            return dashboards.panels(self.engine, s.boards[a["name"]], a.get("values"), CAP)
        raise ValueError(f"no tool {name}")

    def answer(self, request: dict) -> dict | None:
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        out: dict = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkloom", "version": "1"}}}
        if method == "ping":
            return out | {"result": {}}
        if method == "tools/list":
            return out | {"result": {"tools": TOOLS}}
        if method == "tools/call":
            try:
                text, bad = json.dumps(self.call(params["name"], params.get("arguments") or {}), default=str), False
            except Exception as e:
                text, bad = str(e).splitlines()[0], True
            return out | {"result": {"content": [{"type": "text", "text": text}], "isError": bad}}
        return out | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve_stdio(engine: Engine, source, out) -> None:
    tools = Tools(engine)
    for line in source:
        if line.strip():
            try:
                answer = tools.answer(json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if answer is not None:
                print(json.dumps(answer), file=out, flush=True)
