"""Dashboards: YAML with variables and panels, rendered as one HTML page."""

from __future__ import annotations

import html
import re

from .operators import pivots
from .plans.tree import DialectError
from .render import cell, plain
from .session import Engine

_VARIABLE = re.compile(r"\{\{\s*([A-Za-z_]\w*)(:raw)?\s*\}\}")


def substituted(query: str, values: dict) -> str:
    """{{name}} as a literal: numbers as they are, texts quoted; {{name:raw}} as it stands."""

    def one(m: re.Match) -> str:
        if m[1] not in values:
            raise DialectError(f"no variable {m[1]}")
        v = values[m[1]]
        if m[2] or (isinstance(v, (int, float)) and not isinstance(v, bool)):
            return str(v)
        return str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    return _VARIABLE.sub(one, query)


def load(text: str) -> dict:
    import yaml

    board = yaml.safe_load(text)
    if not isinstance(board, dict) or not isinstance(board.get("panels"), list):
        raise DialectError("a dashboard has panels")
    for i, p in enumerate(board["panels"]):
        if not p.get("query"):
            raise DialectError(f"panel {i + 1} has no query")
    return board


def panels(engine: Engine, board: dict, values: dict | None = None, cap: int = 5000) -> list[dict]:
    """Each panel's title, kind, columns and rows (cap of them at most), or its error."""
    known = {v["name"]: v.get("default") for v in board.get("variables", [])} | (values or {})
    out = []
    for p in board["panels"]:
        made = {"title": p.get("title", ""), "kind": p.get("type", "table")}
        try:
            df = engine.query(substituted(p["query"], known))
            if made["kind"] == "pivot":
                df = pivots.pivot(df, p["rows"], p["columns"], p.get("agg", "count"), p.get("value"))
            elif made["kind"] in ("line", "bar", "area"):
                df = pivots.series(df, p.get("x", df.columns[0]), p.get("agg", "sum"), p.get("y", df.columns[-1]), p.get("series"))
            elif made["kind"] == "calendar":
                df = pivots.calendar(df, p.get("x", df.columns[0]), p.get("agg", "count"), p.get("y"))
            rows = df.limit(cap + 1).collect()
            made |= {"columns": df.columns, "rows": [[plain(v) for v in r] for r in rows[:cap]], "truncated": len(rows) > cap}
        except Exception as e:  # a panel's error stands in its place
            made["error"] = str(e).splitlines()[0]
        out.append(made)
    return out


def render(engine: Engine, board: dict, values: dict | None = None) -> str:
    body = []
    for p in panels(engine, board, values):
        body.append(f"<section><h2>{html.escape(p['title'])}</h2>")
        if "error" in p:
            body.append(f"<p class='error'>{html.escape(p['error'])}</p>")
        else:
            if p["kind"] in ("line", "bar", "area"):
                body.append(_chart(p))
            body.append("<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in p["columns"]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(cell(v))}</td>" for v in r) + "</tr>" for r in p["rows"]) + "</table>")
        body.append("</section>")
    title = html.escape(board.get("title", "Dashboard"))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title><style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 8px;text-align:left}}.error{{color:#b00}}</style></head><body><h1>{title}</h1>{''.join(body)}</body></html>"


def _chart(p: dict) -> str:
    """Lines or bars of each series, as SVG."""
    wide, high = 640, 200
    xs = sorted({str(r[0]) for r in p["rows"]})
    by: dict[str, dict[str, float]] = {}
    for x, s, v in p["rows"]:
        by.setdefault(str(s), {})[str(x)] = float(v or 0)
    top = max((v for s in by.values() for v in s.values()), default=1) or 1
    at = {x: 20 + i * (wide - 40) / max(len(xs) - 1, 1) for i, x in enumerate(xs)}
    marks = []
    for k, (name, s) in enumerate(sorted(by.items())):
        color = f"hsl({k * 67 % 360},60%,45%)"
        points = [(at[x], high - 10 - (high - 20) * s[x] / top) for x in xs if x in s]
        if p["kind"] == "bar":
            marks += [f"<rect x='{x - 3:.1f}' y='{y:.1f}' width='6' height='{high - 10 - y:.1f}' fill='{color}'><title>{html.escape(name)}</title></rect>" for x, y in points]
        else:
            marks.append(f"<polyline fill='none' stroke='{color}' points='{' '.join(f'{x:.1f},{y:.1f}' for x, y in points)}'><title>{html.escape(name)}</title></polyline>")
    return f"<svg width='{wide}' height='{high}'>{''.join(marks)}</svg>"
