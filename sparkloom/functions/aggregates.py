"""Aggregates as Spark SQL text; each keeps Spark's partial and final phases. Sums are of doubles; NULLs are skipped."""

from __future__ import annotations

from ..plans.tree import DialectError
from .scalar import Arg, Result, double, string

#: name: least and most arguments.
AGGREGATES = {
    "count": (1, 1), "sum": (1, 1), "avg": (1, 1), "min": (1, 1), "max": (1, 1), "median": (1, 1), "string_agg": (1, 2), "percentile_cont": (2, 2), "quantile": (2, 2), "percentile_disc": (2, 2),
    "stddev": (1, 1), "stddev_samp": (1, 1), "stddev_pop": (1, 1), "variance": (1, 1), "var_samp": (1, 1), "var_pop": (1, 1), "first": (2, 2), "last": (2, 2),
    "corr": (2, 2), "covar_pop": (2, 2), "covar_samp": (2, 2), "regr_slope": (2, 2), "regr_intercept": (2, 2), "regr_r2": (2, 2), "regr_count": (2, 2), "regr_avgx": (2, 2), "regr_avgy": (2, 2),
}


def _share(a: Arg) -> str:
    if not isinstance(a.literal, (int, float)) or isinstance(a.literal, bool):
        raise DialectError("a percentile's fraction must be a number")
    return repr(min(max(float(a.literal), 0.0), 1.0)) + "D"


def call(name: str, args: list[Arg], distinct: bool = False, over: bool = False) -> Result:
    least, most = AGGREGATES[name]
    if not least <= len(args) <= most:
        raise DialectError(f"{name.upper()} takes {least if least == most else f'{least} to {most}'} arguments, not {len(args)}")
    d = "DISTINCT " if distinct else ""
    x = args[0]
    if name == "count":
        return f"COUNT({d}{x.sql})", "int"
    if name in ("sum", "avg"):
        return f"{name.upper()}({d}{double(x)})", "float"
    if name in ("min", "max"):
        return f"{name.upper()}({x.sql})", x.type
    if name == "string_agg":
        sep = string(args[1]) if len(args) > 1 else "''"
        if over:
            return f"ARRAY_JOIN(ARRAY_SORT(COLLECT_LIST({string(x)}) {{over}}), {sep})", "string"
        if distinct:  # a set of its own, as Spark's LISTAGG(DISTINCT) can't stand beside other DISTINCT aggregates
            return f"CASE WHEN COUNT({string(x)}) > 0 THEN ARRAY_JOIN(ARRAY_SORT(COLLECT_SET({string(x)})), {sep}) END", "string"
        return f"LISTAGG({d}{string(x)}, {sep}) WITHIN GROUP (ORDER BY {string(x)})", "string"
    if name == "median":
        return f"PERCENTILE({d}{double(x)}, 0.5D)", "float"
    if name in ("percentile_cont", "quantile"):
        return f"PERCENTILE({d}{double(x)}, {_share(args[1])})", "float"
    if name == "percentile_disc" and distinct:
        values = f"ARRAY_SORT(COLLECT_SET({double(x)}))"
        return f"TRY_ELEMENT_AT({values}, GREATEST(1, CAST(CEIL({_share(args[1])} * SIZE({values})) AS INT)))", "float"
    if name == "percentile_disc":
        return f"CAST(PERCENTILE_DISC({_share(args[1])}) WITHIN GROUP (ORDER BY {double(x)}) AS DOUBLE)", "float"
    if name in ("stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop"):
        return f"{name.upper()}({d}{double(x)})", "float"
    if name in ("first", "last"):
        # the value at the least or greatest order; of equal orders, the least or greatest value
        v, o = x.sql, args[1].sql
        how = "MIN_BY" if name == "first" else "MAX_BY"
        tie = f"STRUCT({o}, {v})" if x.type not in ("any", None) else o
        return f"{how}({v}, CASE WHEN {o} IS NOT NULL THEN {tie} END)", x.type
    y, x = double(args[0]), double(args[1])
    if name == "corr":
        py, px = f"IF({x} IS NULL, NULL, {y})", f"IF({y} IS NULL, NULL, {x})"
        return f"TRY_DIVIDE(COVAR_POP({y}, {x}), STDDEV_POP({py}) * STDDEV_POP({px}))", "float"
    if name == "regr_count":
        return f"REGR_COUNT({y}, {x})", "int"
    return f"{name.upper()}({y}, {x})", "float"
