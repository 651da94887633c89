"""Window functions as Spark SQL text. over is the text of the window; whole, running and plain give variants of its frame."""

from __future__ import annotations

from ..plans.tree import DialectError
from . import aggregates
from .scalar import Arg, Result, double, micros

RANKS = {"row_number": "int", "rank": "int", "dense_rank": "int", "percent_rank": "float", "cume_dist": "float"}
NAMES = {*RANKS, "ntile", "lag", "lead", "first_value", "last_value", "nth_value", "locf", "delta", "rate"}
RUNNING = " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _whole(a: Arg) -> int:
    if not isinstance(a.literal, int) or isinstance(a.literal, bool):
        raise DialectError("a window function's count must be an integer")
    return a.literal


def call(name: str, args: list[Arg], distinct: bool, keys: str, ordered: bool, frame: str) -> Result:
    """keys: PARTITION BY and ORDER BY; frame: with a leading space, or empty."""
    plain, framed = f"OVER ({keys})", f"OVER ({keys}{frame})"
    if distinct:
        raise DialectError("DISTINCT isn't supported in a window")
    sizes = {**dict.fromkeys(RANKS, (0, 0)), "ntile": (1, 1), "lag": (1, 3), "lead": (1, 3), "first_value": (1, 1), "last_value": (1, 1), "nth_value": (2, 2), "locf": (1, 1), "delta": (1, 1), "rate": (2, 2)}
    if name in sizes and not sizes[name][0] <= len(args) <= sizes[name][1]:
        raise DialectError(f"{name.upper()} takes {sizes[name][0]} to {sizes[name][1]} arguments")
    if name in NAMES and name not in ("first_value", "last_value", "nth_value") and "ORDER BY" not in keys:
        plain = f"OVER ({keys} ORDER BY 1)"
    if name in RANKS:
        kind = RANKS[name]
        return (f"CAST({name.upper()}() {plain} AS BIGINT)" if kind == "int" else f"{name.upper()}() {plain}"), kind
    if name == "ntile":
        return f"CAST(NTILE({_whole(args[0])}) {plain} AS BIGINT)", "int"
    if name in ("lag", "lead"):
        n = int(args[1].literal) if len(args) > 1 and args[1].literal is not None else 1
        if n < 0:
            name, n = {"lag": "lead", "lead": "lag"}[name], -n
        value = f"{name.upper()}({args[0].sql}, {n}) {plain}"
        if len(args) > 2:  # the default may be any expression: it is taken where there is no row, not where the value is NULL
            there = f"{name.upper()}(1, {n}) {plain}"
            value = f"IF({there} IS NULL, {args[2].sql}, {value})"
        return value, args[0].type
    if name in ("first_value", "last_value"):
        return f"{name.upper()}({args[0].sql}) {framed}", args[0].type
    if name == "nth_value":
        return f"NTH_VALUE({args[0].sql}, {_whole(args[1])}) {framed}", args[0].type
    run = plain[:-1] + RUNNING + ")"
    if name == "locf":
        return f"LAST({args[0].sql}, TRUE) {run}", args[0].type
    if name == "delta":
        x = double(args[0])
        return f"({x} - LAG({x}) {plain})", "float"
    if name == "rate":
        x = double(args[0])
        dx = f"({x} - LAG({x}) {plain})"
        if args[1].type in ("time", "string", "int"):  # whole numbers are subtracted as such: a double of microseconds since 1970 is exact to 0.24 of one only
            t, unit = (f"CAST({args[1].sql} AS DECIMAL(20, 0))", "1D") if args[1].type == "int" else (micros(args[1]), "1000000D")
            dt = f"(CAST({t} - LAG({t}) {plain} AS DOUBLE) / {unit})"
        else:
            t = double(args[1])
            dt = f"({t} - LAG({t}) {plain})"
        return f"CASE WHEN {dt} > 0 THEN CASE WHEN {dx} < 0 THEN {x} ELSE {dx} END / {dt} END", "float"
    if name in aggregates.AGGREGATES:
        sql, kind = aggregates.call(name, args, over=True)
        if "{over}" in sql:
            return sql.replace("{over}", framed), kind
        if name == "corr":
            raise DialectError("CORR isn't supported in a window")
        if sql.startswith("CAST(PERCENTILE_DISC"):
            raise DialectError("PERCENTILE_DISC isn't supported in a window")
        return f"{sql} {framed}", kind
    raise DialectError(f"unknown window function {name.upper()}")
