"""Scalar functions as Spark SQL text.

An argument is (sql, type, literal): its text, its type in the dialect (int, float, string, bool, time, duration, bytes, any
or None where it isn't known), and its value if it is a literal. A function gives (sql, type). Failing operations give NULL,
whatever the session's ANSI setting; times are TIMESTAMP_NTZ throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from ..plans.tree import DialectError, Interval
from .intervals import interval_sql, parse_interval


class Arg(NamedTuple):
    sql: str
    type: str | None = None
    literal: object = None


Result = tuple[str, str | None]
SCALARS: dict[str, tuple[int, int | None, Callable[[list[Arg]], Result]]] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _add(names: str, least: int, most: int | None):
    def put(f):
        for n in names.split():
            SCALARS[n] = (least, most, f)
        return f

    return put


def call(name: str, args: list[Arg]) -> Result:
    if name not in SCALARS:
        raise DialectError(f"unknown function {name.upper()}")
    least, most, f = SCALARS[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise DialectError(f"{name.upper()} takes {least if most == least else f'{least} to {most}' if most else f'{least} or more'} arguments, not {len(args)}")
    return f(args)


def string(a: Arg) -> str:
    if a.type == "any":
        return f"CAST({a.sql} AS STRING)"
    return a.sql if a.type == "string" else f"CAST({a.sql} AS STRING)"


def number(a: Arg) -> str:
    return a.sql if a.type in ("int", "float") else f"CAST({a.sql} AS DOUBLE)" if a.type == "bool" else f"TRY_CAST({a.sql} AS DOUBLE)"


def double(a: Arg) -> str:
    return a.sql if a.type == "float" else f"TRY_CAST({a.sql} AS DOUBLE)"


def time(a: Arg) -> str:
    return a.sql if a.type == "time" else cast_time(a)


def cast_time(a: Arg) -> str:
    """A text with an offset is the instant it names; one without is taken as it stands. Several layouts, with slashes too."""
    if a.type == "time":
        return a.sql
    if a.type in ("int", "float"):
        return f"CAST(TIMESTAMP_MICROS(CAST(ROUND({a.sql} * 1000000) AS BIGINT)) AS TIMESTAMP_NTZ)"
    s = string(a)
    slashes = f"REPLACE({s}, '/', '-')"
    offset = f"REGEXP_REPLACE({slashes}, '([+-][0-9]{{2}})([0-9]{{2}})$', '$1:$2')"
    zoned = f"CAST(TO_UTC_TIMESTAMP(FROM_UTC_TIMESTAMP(TRY_CAST({offset} AS TIMESTAMP), 'UTC'), 'UTC') AS TIMESTAMP_NTZ)"
    return f"COALESCE(IF({slashes} RLIKE '([zZ]|[+-][0-9]{{2}}:?[0-9]{{2}})$' AND {slashes} RLIKE ':', {zoned}, NULL), TRY_CAST({slashes} AS TIMESTAMP_NTZ))"


def micros(a: Arg) -> str:
    return f"UNIX_MICROS(CAST({time(a)} AS TIMESTAMP))"


def from_micros(sql: str) -> str:
    return f"CAST(TIMESTAMP_MICROS({sql}) AS TIMESTAMP_NTZ)"


def stride(a: Arg) -> str:
    """Microseconds of a stride: a text, or an interval."""
    if isinstance(a.literal, str):
        return str(parse_interval(a.literal))
    if isinstance(a.literal, Interval):
        return str(a.literal.micros)
    if a.type == "duration":
        return f"UNIX_MICROS(TIMESTAMP '1970-01-01 00:00:00Z' + {a.sql})"
    raise DialectError("an interval must be INTERVAL '...' or a text")


def _finite(sql: str) -> Result:
    return f"NULLIF(NULLIF(NULLIF({sql}, DOUBLE('NaN')), DOUBLE('Infinity')), DOUBLE('-Infinity'))", "float"


def common(args: list[Arg]) -> str | None:
    kinds = {a.type for a in args} - {"null"}
    return kinds.pop() if len(kinds) == 1 else "float" if kinds and kinds <= {"int", "float"} else None


@_add("coalesce", 1, None)
def _(a):
    return f"COALESCE({', '.join(x.sql for x in a)})", common(a)


@_add("nullif", 2, 2)
def _(a):
    return f"NULLIF({a[0].sql}, {a[1].sql})", a[0].type


@_add("lower", 1, 1)
def _(a):
    return f"LOWER({string(a[0])})", "string"


@_add("upper", 1, 1)
def _(a):
    return f"UPPER({string(a[0])})", "string"


@_add("initcap", 1, 1)
def _(a):
    return f"INITCAP({string(a[0])})", "string"


@_add("reverse", 1, 1)
def _(a):
    return f"REVERSE({string(a[0])})", "string"


@_add("length len", 1, 1)
def _(a):
    return f"CAST(LENGTH({string(a[0])}) AS BIGINT)", "int"


@_add("substr substring", 2, 3)
def _(a):
    start, size = f"GREATEST(CAST({a[1].sql} AS INT), 1)", f", GREATEST(CAST({a[2].sql} AS INT), 0)" if len(a) > 2 else ""
    return f"SUBSTRING({string(a[0])}, {start}{size})", "string"


@_add("trim", 1, 1)
def _(a):
    return f"REGEXP_REPLACE({string(a[0])}, '^[\\\\s\\\\p{{Z}}]+|[\\\\s\\\\p{{Z}}]+$', '')", "string"


@_add("ltrim", 1, 1)
def _(a):
    return f"LTRIM(' \\t\\n\\r', {string(a[0])})", "string"


@_add("rtrim", 1, 1)
def _(a):
    return f"RTRIM(' \\t\\n\\r', {string(a[0])})", "string"


@_add("concat", 1, None)
def _(a):
    return f"CONCAT_WS('', {', '.join(string(x) for x in a)})", "string"


@_add("replace", 3, 3)
def _(a):
    return f"REPLACE({string(a[0])}, {string(a[1])}, {string(a[2])})", "string"


@_add("left", 2, 2)
def _(a):
    s, n = string(a[0]), f"CAST({a[1].sql} AS INT)"
    return f"LEFT({s}, IF({n} < 0, GREATEST(LENGTH({s}) + {n}, 0), {n}))", "string"


@_add("right", 2, 2)
def _(a):
    s, n = string(a[0]), f"CAST({a[1].sql} AS INT)"
    return f"RIGHT({s}, IF({n} < 0, GREATEST(LENGTH({s}) + {n}, 0), {n}))", "string"


@_add("repeat", 2, 2)
def _(a):
    return f"REPEAT({string(a[0])}, CAST({a[1].sql} AS INT))", "string"


@_add("strpos instr", 2, 2)
def _(a):
    return f"CAST(INSTR({string(a[0])}, {string(a[1])}) AS BIGINT)", "int"


@_add("split_part", 3, 3)
def _(a):
    n = f"CAST({a[2].sql} AS INT)"
    return f"IF({n} < 1, '', SPLIT_PART({string(a[0])}, {string(a[1])}, GREATEST({n}, 1)))", "string"


def java_regex(a: Arg) -> str:
    """The pattern's text for Java; named groups are written (?<name>...) there, without underscores."""
    if isinstance(a.literal, str):
        return quoted(re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", a.literal))
    return f"REPLACE({string(a)}, '(?P<', '(?<')"


@_add("regexp_replace", 3, 4)
def _(a):
    s, p, r = string(a[0]), java_regex(a[1]), string(a[2])
    flags = a[3].literal if len(a) > 3 else ""
    if not isinstance(flags, str):
        raise DialectError("REGEXP_REPLACE takes its flags as a text")
    if "i" in flags:
        p = f"CONCAT('(?i)', {p})"
    if "g" in flags:
        return f"REGEXP_REPLACE({s}, {p}, {r})", "string"
    at, found = f"REGEXP_INSTR({s}, {p})", f"REGEXP_SUBSTR({s}, {p})"
    return f"COALESCE(IF({at} > 0, CONCAT(LEFT({s}, {at} - 1), {r}, SUBSTRING({s}, {at} + LENGTH({found}))), NULL), {s})", "string"


@_add("regexp_extract", 2, 3)
def _(a):
    s, p = string(a[0]), java_regex(a[1])
    if len(a) > 2:
        group = f"CAST({a[2].sql} AS INT)"
    elif isinstance(a[1].literal, str):
        group = "1" if re.search(r"(?<!\\)(?:\\\\)*\((?!\?)|\(\?P?<[A-Za-z]", a[1].literal) else "0"
    else:
        group = f"IF({p} RLIKE '(^|[^\\\\\\\\])[(]([^?]|[?]P?<[a-zA-Z])', 1, 0)"
    return f"IF({s} RLIKE {p}, REGEXP_EXTRACT({s}, {p}, {group}), NULL)", "string"


@_add("regexp_matches", 2, 2)
def _(a):
    return call("regexp_extract", a)


@_add("extract_value", 2, 2)
def _(a):
    s = string(a[0])
    key = quoted(re.escape(a[1].literal)) if isinstance(a[1].literal, str) else f"CONCAT('\\\\Q', {string(a[1])}, '\\\\E')"
    pattern = f"CONCAT('(?:^|[\\\\s,;{{(\\\\[&?|\\\"])', {key}, '\\\"?\\\\s*[:=]\\\\s*(?:\\\"([^\\\"]*)\\\"|\\'([^\\']*)\\'|([^\\\\s,;)}}\\\\]&|\\\"]+))')"
    group = lambda n: f"NULLIF(REGEXP_EXTRACT({s}, {pattern}, {n}), '')"
    return f"IF({s} RLIKE {pattern}, COALESCE({group(1)}, {group(2)}, {group(3)}, ''), NULL)", "string"


def json_path(path: str) -> str:
    path = path.strip()
    path = path[1:] if path.startswith("$") else path
    steps = re.findall(r"\['([^']*)'\]|\[\"([^\"]*)\"\]|\[(\d+)\]|\.?([^.\[\]]+)", path)
    return "$" + "".join(f"[{n}]" if n else f"['{a or b or w}']" for a, b, n, w in steps)


@_add("json_extract", 2, 2)
def _(a):
    if not isinstance(a[1].literal, str):
        raise DialectError("JSON_EXTRACT takes its path as a text")
    value = a[0].sql if a[0].type in ("string", "any-text") else f"TO_JSON({a[0].sql})" if a[0].type == "any" else string(a[0])
    return f"GET_JSON_OBJECT({value}, {quoted(json_path(a[1].literal))})", "any-text"


@_add("abs", 1, 1)
def _(a):
    return f"ABS({number(a[0])})", a[0].type if a[0].type == "int" else "float"


@_add("round", 1, 2)
def _(a):
    return f"CAST(ROUND({double(a[0])}{f', {a[1].sql}' if len(a) > 1 else ''}) AS DOUBLE)", "float"


@_add("floor", 1, 1)
def _(a):
    return f"CAST(FLOOR({double(a[0])}) AS DOUBLE)", "float"


@_add("ceil ceiling", 1, 1)
def _(a):
    return f"CAST(CEIL({double(a[0])}) AS DOUBLE)", "float"


for _name in ("sqrt", "exp", "ln", "log10"):
    SCALARS[_name] = (1, 1, lambda a, n=_name: _finite(f"{n.upper()}({double(a[0])})"))


@_add("log", 1, 2)
def _(a):
    return _finite(f"LOG10({double(a[0])})" if len(a) == 1 else f"LOG({double(a[0])}, {double(a[1])})")


@_add("power pow", 2, 2)
def _(a):
    return _finite(f"POWER({double(a[0])}, {double(a[1])})")


@_add("mod", 2, 2)
def _(a):
    whole = a[0].type == a[1].type == "int"
    x, y = (a[0].sql, a[1].sql) if whole else (double(a[0]), double(a[1]))
    return f"TRY_MOD({x}, {y})", "int" if whole else "float"


@_add("sign", 1, 1)
def _(a):
    return f"CAST(SIGNUM({double(a[0])}) AS BIGINT)", "int"


@_add("trunc", 1, 2)
def _(a):
    x, m = double(a[0]), f"POWER(10D, {a[1].sql})" if len(a) > 1 else "1D"
    return f"CAST(IF({x} < 0, CEIL({x} * {m}), FLOOR({x} * {m})) / {m} AS DOUBLE)", "float"


@_add("greatest", 1, None)
def _(a):
    return (a[0].sql if len(a) == 1 else f"GREATEST({', '.join(x.sql for x in a)})"), common(a)


@_add("least", 1, None)
def _(a):
    return (a[0].sql if len(a) == 1 else f"LEAST({', '.join(x.sql for x in a)})"), common(a)


@_add("width_bucket", 4, 4)
def _(a):
    return f"WIDTH_BUCKET({double(a[0])}, {double(a[1])}, {double(a[2])}, CAST({a[3].sql} AS BIGINT))", "int"


@_add("now current_timestamp", 0, 0)
def _(a):
    return "CAST(CURRENT_TIMESTAMP() AS TIMESTAMP_NTZ)", "time"


@_add("current_date", 0, 0)
def _(a):
    return "CAST(CURRENT_DATE() AS TIMESTAMP_NTZ)", "time"


@_add("date", 1, 1)
def _(a):
    return f"CAST(DATE_TRUNC('DAY', {time(a[0])}) AS TIMESTAMP_NTZ)", "time"


@_add("date_trunc", 2, 2)
def _(a):
    unit = a[0].literal
    if not isinstance(unit, str) or unit.lower() not in ("second", "minute", "hour", "day", "week", "month", "quarter", "year"):
        raise DialectError(f"DATE_TRUNC to {unit!r}")
    return f"CAST(DATE_TRUNC({quoted(unit.upper())}, {time(a[1])}) AS TIMESTAMP_NTZ)", "time"


@_add("date_bin", 2, 3)
def _(a):
    at, origin, s = micros(a[1]), micros(a[2]) if len(a) > 2 else "0", stride(a[0])
    return from_micros(f"{at} - PMOD({at} - {origin}, {s})"), "time"


@_add("date_add", 2, 2)
def _(a):
    if isinstance(a[1].literal, str):
        return f"({time(a[0])} + {interval_sql(parse_interval(a[1].literal))})", "time"
    return f"({time(a[0])} + {a[1].sql})", "time"


@_add("age", 1, 2)
def _(a):
    return (f"({time(a[0])} - {time(a[1])})", "duration") if len(a) == 2 else (time(a[0]), "time")


@_add("to_timestamp", 1, 1)
def _(a):
    return from_micros(f"CAST(ROUND({double(a[0])} * 1000000) AS BIGINT)"), "time"


#: The format's directives, and Spark's letters for them.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "p": "a", "I": "hh", "A": "EEEE", "a": "EEE", "B": "MMMM", "b": "MMM", "j": "DDD", "z": "xx", "Z": "VV"}


@_add("strftime", 2, 2)
def _(a):
    fmt = a[0].literal
    if not isinstance(fmt, str):
        raise DialectError("STRFTIME takes its format as a text")
    out, i, plain = "", 0, ""
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt) and (fmt[i + 1] in DIRECTIVES or fmt[i + 1] == "%"):
            if fmt[i + 1] == "%":
                plain += "%"
            else:
                out += (f"''{plain}''" if plain else "") + DIRECTIVES[fmt[i + 1]]
                plain = ""
            i += 2
        else:
            plain += fmt[i]
            i += 1
    out += f"''{plain}''" if plain else ""
    pattern = out.replace("''", "\x00").replace("'", "\\'").replace("\x00", "\\'")
    return f"DATE_FORMAT({time(a[1])}, '{pattern}')", "string"


@_add("convert_tz", 2, 2)
def _(a):
    return f"CAST(FROM_UTC_TIMESTAMP({time(a[0])}, {zone(a[1])}) AS TIMESTAMP_NTZ)", "time"


@_add("from_tz", 2, 2)
def _(a):
    return f"CAST(TO_UTC_TIMESTAMP({time(a[0])}, {zone(a[1])}) AS TIMESTAMP_NTZ)", "time"


def zone(a: Arg) -> str:
    if isinstance(a.literal, str):
        z = "UTC" if a.literal in ("Z", "z") else re.sub(r"^([+-]\d\d)(\d\d)$", r"\1:\2", a.literal)
        return quoted(z)
    return string(a)


@_add("extract", 2, 2)
def _(a):
    part, t = a[0].literal, time(a[1])
    if part == "epoch":
        return f"({micros(a[1])} / 1000000D)", "float"
    if part == "second":
        return f"CAST(EXTRACT(SECOND FROM {t}) AS DOUBLE)", "float"
    if part == "dow":
        return f"CAST(DAYOFWEEK({t}) - 1 AS BIGINT)", "int"
    return f"CAST(EXTRACT({part.upper()} FROM {t}) AS BIGINT)", "int"


for _name in ("lpad", "rpad"):
    SCALARS[_name] = (2, 3, lambda a, n=_name: (f"{n.upper()}({string(a[0])}, CAST({a[1].sql} AS INT), {string(a[2]) if len(a) > 2 else quoted(' ')})", "string"))


def cast(a: Arg, kind: str, strict: bool = False) -> Result:
    how = "CAST" if strict else "TRY_CAST"
    if kind == "int":
        if a.type in ("string", "any", "any-text", None):
            return f"COALESCE(TRY_CAST({string(a)} AS BIGINT), {how}({how}({string(a)} AS DOUBLE) AS BIGINT))", "int"
        return f"{how}({a.sql} AS BIGINT)", "int"
    if kind == "float":
        return (f"{how}({string(a)} AS DOUBLE)" if a.type in ("any", "any-text") else f"{how}({a.sql} AS DOUBLE)"), "float"
    if kind == "bool":
        return f"{how}({a.sql} AS BOOLEAN)", "bool"
    if kind == "time":
        return (f"CAST({a.sql} AS TIMESTAMP_NTZ)" if strict and a.type == "string" else cast_time(a)), "time"
    return string(a) if a.type != "any" else f"TO_JSON({a.sql})", "string"
