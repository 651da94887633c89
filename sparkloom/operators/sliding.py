"""Aggregates over RANGE frames with offsets on both sides, each row of a frame added once or twice in all.

Spark adds up such a frame anew for every row. Here the axis is cut into blocks as long as the frame, so a frame that ends
in a block is the start of this block up to there, and the rest of the block before from the frame's own start on: two
running aggregates, one from each end. For the second, every row stands a frame's length later once more, where it is among
the rows of the block that ask for it. Nothing is subtracted, so sums are as exact as a plain sum of the frame's rows, and
a key with very many rows is dealt out by blocks.

The axis is of whole numbers (integers, or microseconds). Rows that are NULL there have all such rows of their key as frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = ("sum", "count", "avg", "min", "max")
_LAST = (1 << 63) - 1


def _block(at: Column, width: int) -> Column:
    """Whole blocks before at, also of negative ones."""
    return F.call_function("div", at, F.lit(width)) - (at % F.lit(width) < 0).cast("bigint")


def sliding(df: DataFrame, keys: Sequence[str], at: str, low: int, high: int, values: Sequence[tuple[str, str, str]]) -> DataFrame:
    """df with a column for each of values, (name, aggregate, column), over the rows of equal keys from at + low to at + high. low < high; sums are of doubles."""
    width = high - low
    if width <= 0:
        raise ValueError("a frame ends after its start")
    asking = 2 if high else 0  # a row is its own question where the frame ends with it
    own = F.col(at)
    places = [(0, _block(own, width), own), (1, F.try_add(_block(own, width), F.lit(1)), F.coalesce(F.try_add(own, F.lit(width)), F.lit(_LAST)))]
    if high:
        places.append((2, _block(own + F.lit(high), width), own + F.lit(high)))
    stack = df.select("*", F.inline(F.array(*[F.struct(F.lit(kind).alias("__kind"), block.alias("__block"), u.alias("__u")) for kind, block, u in places])))
    # rows without a place are only met where they stand, and nothing asks beyond the last block
    stack = stack.filter(~((F.col("__kind") == 1) & F.col("__block").isNull()))
    kind = F.col("__kind")
    used = {*keys, *(v for _, _, v in values)}
    stack = stack.select(*[F.col(c) if c in used else F.when(kind == asking, F.col(c)).alias(c) for c in df.columns], "__kind", "__block", "__u")
    start = Window.partitionBy(*keys, "__block").orderBy(F.col("__u").asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.partitionBy(*keys, "__block").orderBy(F.col("__u").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    parts, out = {}, []

    def both(f: str, v: str) -> tuple[Column, Column]:
        names = f"__start_{f}_{v}", f"__rest_{f}_{v}"
        for name, k, w in zip(names, (0, 1), (start, rest), strict=True):
            parts[name] = getattr(F, f)(F.when(kind == k, F.col(v))).over(w)
        return F.col(names[0]), F.col(names[1])

    def total(v: str) -> Column:
        a, b = both("sum", v)
        return F.coalesce(a + b, a, b)

    for name, f, v in values:
        if f == "sum":
            c = total(v)
        elif f == "count":
            a, b = both("count", v)
            c = a + b
        elif f == "avg":
            a, b = both("count", v)
            c = total(v) / F.nullif(a + b, F.lit(0))
        else:
            c = (F.least if f == "min" else F.greatest)(*both(f, v))
        out.append(c.alias(name))
    return stack.select("*", *[w.alias(n) for n, w in parts.items()]).filter(kind == asking).select(*df.columns, *out)
