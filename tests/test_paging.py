"""Services that answer in pages, against a local server that gives two of each."""

import http.server
import json
import threading
import urllib.parse

import pytest

from sparkloom.sources import Spec, load


@pytest.fixture(scope="module")
def paged():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def _do(self):
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            body = json.loads(raw) if raw else {}
            url = urllib.parse.urlsplit(self.path)
            query = dict(urllib.parse.parse_qsl(url.query))
            seen.append((url.path, query, body))
            headers, answer = {}, {}
            if url.path == "/graphql":
                later = body["variables"].get("after") == "c1"
                answer = {"data": {"users": {"nodes": [{"id": "u2" if later else "u1"}], "pageInfo": {"hasNextPage": not later, "endCursor": "c1"}}}}
            elif url.path.startswith("/providers/Microsoft.ResourceGraph"):
                later = body["options"].get("$skipToken") == "s1"
                answer = {"data": [{"name": "b" if later else "a"}]} | ({} if later else {"$skipToken": "s1"})
            elif "CostManagement" in url.path:
                later = "page" in query
                answer = {"properties": {"columns": [{"name": "Cost"}], "rows": [[2.5 if later else 1.5]], "nextLink": None if later else f"http://{self.headers['Host']}{url.path}?page=2"}}
            elif url.path == "/T()":
                later = query.get("NextRowKey") == "r1"
                answer = {"value": [{"RowKey": "2" if later else "1"}]}
                headers = {} if later else {"x-ms-continuation-NextPartitionKey": "p 1", "x-ms-continuation-NextRowKey": "r1"}
            out = json.dumps(answer).encode()
            self.send_response(200)
            for k, v in {**headers, "Content-Length": str(len(out))}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _do

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", seen
    s.shutdown()


@pytest.mark.parametrize("prefix, path, suffix, options, expected", [("linear", "users", "/graphql", {}, ["u1", "u2"]), ("azrgraph", "Resources", "", {}, ["a", "b"]), ("azcost", "subscriptions/x", "", {}, [1.5, 2.5]), ("azuretables", "T", "", {"filter": "RowKey gt '0'"}, ["1", "2"])])
def test_all_pages_are_read(spark, paged, prefix, path, suffix, options, expected):
    web, seen = paged
    assert sorted(r[0] for r in load(spark, Spec(prefix, path, {"endpoint": web + suffix} | options)).collect()) == expected
    if options:
        assert [q["$filter"] for p, q, _ in seen if p == "/T()"] == [options["filter"]] * 2
