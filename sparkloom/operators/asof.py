"""As-of join: for each left row the nearest right row by one inequality, among those with equal keys.

The sides are stacked and each left row takes the last right row before it in one window over the keys, so there is one
shuffle by the keys, one sort, and no row is multiplied. Rows with a NULL key or time match nothing. Of right rows with the
same keys and time, the backward forms (>=, >) take the one with the greatest further columns, the forward forms the one
with the least: files have no input order in Spark, so ties follow the values.

A key that holds most of the rows is one sorted run in one task. asof_join(..., bins=n) splits such runs: time is cut into n
ranges of equal size, each range is joined by itself, and the last right row of each range is carried into the ranges after
it by a window over at most n rows a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPS = {">=": (False, False), ">": (False, True), "<=": (True, False), "<": (True, True)}  # forward, strict


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], on: tuple[str, str, str], how: str = "inner", bins: int = 0) -> DataFrame:
    """Columns of left, then of right; their names must not clash. keys: (left, right) columns; on: (left column, operator, right column)."""
    if how not in ("inner", "left"):
        raise ValueError("an as-of join is inner or left")
    lt, op, rt = on
    forward, strict = OPS[op]
    lk, rk = [k for k, _ in keys], [k for _, k in keys]
    names = [f"__k{i}" for i in range(len(keys))]
    orderable = [c for c in right.columns if right.schema[c].dataType.typeName() not in ("map", "variant")]
    kind = right.schema[rt].dataType
    some_null = lambda cols: F.lit(False) if not cols else F.greatest(*[F.col(c).isNull() for c in cols]) if len(cols) > 1 else F.col(cols[0]).isNull()
    row = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    tie = F.struct(*[F.col(f"`{c}`") for c in orderable])
    none = F.lit(None)
    r = right.filter(~some_null([*rk, rt])).select(*[F.col(f"`{a}`").alias(n) for a, n in zip(rk, names, strict=True)], F.col(f"`{rt}`").alias("__t"), F.lit(1).alias("__side"), tie.alias("__tie"), row.alias("__r"), none.cast(left.schema).alias("__l"))
    matchable = left.withColumn("__null", some_null([*lk, lt]))
    l_row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    # a left row comes after the right rows of its time unless the operator is strict
    stack = r.unionByName(matchable.filter(~F.col("__null")).select(*[F.col(f"`{a}`").cast(right.schema[b].dataType).alias(n) for (a, b), n in zip(keys, names, strict=True)], F.col(f"`{lt}`").cast(kind).alias("__t"), F.lit(0 if strict else 2).alias("__side"), none.cast(right.select(tie.alias("t")).schema["t"].dataType).alias("__tie"), none.cast(right.select(row.alias("r")).schema["r"].dataType).alias("__r"), l_row.alias("__l")))
    order = [F.col("__t").desc() if forward else F.col("__t").asc(), F.col("__side").asc(), F.col("__tie").desc() if forward else F.col("__tie").asc()]
    if bins > 1:
        micros = F.unix_micros(F.col("__t").cast("timestamp")) if kind.typeName().startswith("timestamp") else F.col("__t").cast("double")
        stack = stack.withColumn("__u", micros.cast("double"))
        ends = sorted(set(stack.approxQuantile("__u", [i / bins for i in range(1, bins)], 0.01)))
        cut = F.lit(0)
        for e in ends:
            cut = cut + (F.col("__u") > e).cast("int")
        stack = stack.withColumn("__bin", cut)
        w = Window.partitionBy(*names, "__bin").orderBy(*order)
        best = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        local = stack.withColumn("__m", best)
        pick = F.max_by if not forward else F.min_by
        lasts = stack.filter("__side = 1").groupBy(*names, "__bin").agg(pick("__r", F.struct("__t", "__tie")).alias("__c"))
        every = stack.select(*names, "__bin").distinct().join(lasts, [*names, "__bin"], "left") if names else stack.select("__bin").distinct().join(lasts, "__bin", "left")
        along = Window.partitionBy(*names).orderBy(F.col("__bin").desc() if forward else F.col("__bin").asc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = every.withColumn("__carried", F.last("__c", ignorenulls=True).over(along)).drop("__c")
        matched = local.filter("__side <> 1").join(carried, [*names, "__bin"], "left").select("__l", F.coalesce("__m", "__carried").alias("__m"))
    else:
        w = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        matched = stack.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).filter("__side <> 1").select("__l", "__m")
    if how == "inner":
        matched = matched.filter(F.col("__m").isNotNull())
    else:
        matched = matched.union(matchable.filter("__null").select(l_row.alias("__l"), none.cast(matched.schema["__m"].dataType).alias("__m")))
    return matched.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__m.`{c}`").alias(c) for c in right.columns])


def asof_lateral(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], on: tuple[str, str, str], how: str = "inner") -> DataFrame:
    """The same by definition, a subquery for each left row: for tests and small tables."""
    lt, op, rt = on
    spark = left.sparkSession
    left.createOrReplaceTempView("__asof_l")
    right.createOrReplaceTempView("__asof_r")
    down = "ASC" if OPS[op][0] else "DESC"
    where = " AND ".join([*(f"l.`{a}` = r.`{b}`" for a, b in keys), f"l.`{lt}` {op} r.`{rt}`"])
    ties = ", ".join(f"r.`{c}` {down}" for c in right.columns)
    kind = "LEFT" if how == "left" else "INNER"
    return spark.sql(f"SELECT l.*, m.* FROM __asof_l l {kind} JOIN LATERAL (SELECT * FROM __asof_r r WHERE {where} ORDER BY r.`{rt}` {down}, {ties} LIMIT 1) m")
