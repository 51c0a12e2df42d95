"""Operators on depth series: masks, resampling, nearest and bracket joins, gap islands. Everything stays in the JVM."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.functions.columns import lerp

COMPARE = {">": lambda c, t: c > t, "<": lambda c, t: c < t, ">=": lambda c, t: c >= t, "<=": lambda c, t: c <= t}


def minmax_normalise(log: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """value scaled to [0, 1] in each group; a constant series becomes zeros; nulls stay."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return log.withColumn(value, F.when(F.col(value).isNull(), None).when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.lit(0.0)))


def mask_with_buffer(log: DataFrame, bad: Column, columns: Sequence[str], by: Sequence[str], order: str, buffer: int) -> DataFrame:
    """Rows where bad holds, and `buffer` rows before and after them, lose the columns' values; a null condition masks nothing."""
    near = F.max(F.coalesce(bad, F.lit(False)).cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-buffer, buffer))
    return log.withColumn("__near", near).withColumns({c: F.when(F.col("__near") == 1, None).otherwise(F.col(c)) for c in columns}).drop("__near")


def threshold(value: str, op: str, limit: float) -> Column:
    return COMPARE[op](F.col(value), F.lit(limit))


def outside(columns: Sequence[str], low: float, high: float) -> Column:
    """Any column at or beyond either limit."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce((F.col(c) <= low) | (F.col(c) >= high), F.lit(False))
    return cond


def two_of_three(r: str, g: str, b: str, low: float, high: float) -> Column:
    """Two channels or more above the upper limit, or two or more below the lower one."""
    count = lambda test: sum((F.coalesce(test(F.col(c)), F.lit(False)).cast("int") for c in (r, g, b)), F.lit(0))
    return (count(lambda c: c > high) >= 2) | (count(lambda c: c < low) >= 2)


def rescale_depth(log: DataFrame, depth: str, by: Sequence[str], length: Column) -> DataFrame:
    """Depths stretched so that the deepest is at `length`."""
    return log.withColumn(depth, F.col(depth) * length / F.max(depth).over(Window.partitionBy(*by)))


def brackets(log: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Consecutive points of each series as (by, x0, x1, y0, y1)."""
    w = Window.partitionBy(*by).orderBy(x)
    return log.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))


def _last(value: Column | str, by: Sequence[str], *order: Column) -> Column:
    """The last known value so far in the given order. A frame that grows at its end is kept up row by row; one that shrinks at its start
    would be read anew for each row, so that looking ahead is looking back in the opposite order."""
    return F.last(value, True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def _carried(both: DataFrame, by: Sequence[str]) -> DataFrame:
    """Nodes and questions (__at, __side 0 or 1, __node) with the nearest node at or before (__lo) and at or after (__hi) each."""
    at, side = F.col("__at"), F.col("__side")
    return both.withColumn("__lo", _last("__node", by, at.asc(), side.asc())).withColumn("__hi", _last("__node", by, at.desc(), side.asc()))


def interpolate(points: DataFrame, log: DataFrame, by: Sequence[str], at: str, x: str, y: str, clamp: bool = False) -> DataFrame:
    """points with the series' value at `at`: linear between neighbours, null (or, with clamp, the end's value) outside.

    A null neighbour makes the open interval null, but a point exactly on a node has the node's value. Found by carrying the nodes on both
    sides along the merged order: a sort for each series instead of a range join.
    """
    by = list(by)
    node = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    nodes = log.select(*by, F.col(x).cast("double").alias("__at"), F.lit(0).alias("__side"), node.alias("__node"), *[F.lit(None).alias(c) for c in points.columns if c not in by])
    asked = points.select(*by, F.col(at).cast("double").alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__node"), *[F.col(c) for c in points.columns if c not in by])
    both = nodes.unionByName(asked)
    both = _carried(both, by).where("__side = 1")
    lo, hi = F.col("__lo"), F.col("__hi")
    inside = F.when(lo["x"] == F.col("__at"), lo["y"]).when(lo.isNull() | hi.isNull(), None).otherwise(lerp(F.col("__at"), lo["x"], hi["x"], lo["y"], hi["y"]))
    value = F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(inside) if clamp else inside
    return both.select(*points.columns, value.alias(y))


def uniform_grid(log: DataFrame, by: Sequence[str], x: str, step: float) -> DataFrame:
    """(by, x) every `step` from the least to the first place at or beyond the largest."""
    span = log.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    count = F.ceil((F.col("hi") - F.col("lo")) / step).cast("int")
    return span.select(*by, "lo", F.explode(F.sequence(F.lit(0), count)).alias("k")).select(*by, (F.col("lo") + F.col("k") * step).alias(x))


def resample_uniform(log: DataFrame, by: Sequence[str], x: str, y: str, step: float) -> DataFrame:
    return interpolate(uniform_grid(log, by, x, step), log, by, x, x, y)


def common_grid(logs: DataFrame, by: Sequence[str], name: str, x: str, y: str, factor: float = 2.0) -> DataFrame:
    """All logs of a group on one grid: from the least to the largest depth, at the coarsest log's mean spacing / factor; ends are held."""
    by = list(by)
    span = logs.groupBy(*by, name).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"))
    grid = span.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.max((F.col("hi") - F.col("lo")) / F.col("n")) / factor).alias("res"))
    grid = grid.withColumn("num", F.when(F.col("res") > 0, ((F.col("hi") - F.col("lo")) / F.col("res")).cast("int") + 1).otherwise(F.lit(1)))
    place = F.when(F.col("num") > 1, F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (F.col("num") - 1)).otherwise(F.col("lo"))
    grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("num") - 1))).select(*by, "k", place.alias(x))
    return interpolate(span.select(*by, name).join(grid, by), logs, [*by, name], x, x, y, clamp=True)


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, tolerance: float) -> DataFrame:
    """left with the value of the nearest right row within tolerance (inclusive); equally near: the earlier; equal keys: the last by value."""
    by = list(by)
    one = right.groupBy(*by, on).agg(F.max(value).alias("__v")).select(*by, F.col(on).cast("double").alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(on).cast("double").alias("x"), F.col("__v").alias("y")).alias("__node"), *[F.lit(None).alias(c) for c in left.columns if c not in by])
    two = left.select(*by, F.col(on).cast("double").alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__node"), *[c for c in left.columns if c not in by])
    both = one.unionByName(two)
    both = _carried(both, by).where("__side = 1")
    down, up = F.col("__at") - F.col("__lo.x"), F.col("__hi.x") - F.col("__at")
    pick = F.when(down.isNotNull() & (up.isNull() | (down <= up)), F.when(down <= tolerance, F.col("__lo.y"))).otherwise(F.when(up <= tolerance, F.col("__hi.y")))
    return both.select(*left.columns, pick.alias(value))


def nearest_index(points: DataFrame, log: DataFrame, by: Sequence[str], at: str, x: str, index: str) -> DataFrame:
    """points with the index of the nearest row of the series; equally near: the lowest index."""
    low = log.groupBy(*by, x).agg(F.min(index).alias("__i")).select(*by, F.col(x).alias("__x"), F.col("__i"))
    nodes = low.select(*by, F.col("__x").cast("double").alias(at), (-F.col("__i")).alias("__v"))
    return asof_nearest(points, nodes, by, at, "__v", float("inf")).withColumn(index, -F.col("__v")).drop("__v")


def outer_fill(a: DataFrame, b: DataFrame, by: Sequence[str], depth: str, columns: Sequence[str]) -> DataFrame:
    """Full outer join on depth; gaps are filled from above, then from below."""
    joined = a.join(b, [*by, depth], "full")
    return joined.withColumns({c: F.coalesce(_last(c, by, F.col(depth).asc()), _last(c, by, F.col(depth).desc())) for c in columns})


def gap_islands(log: DataFrame, by: Sequence[str], index: str, value: str) -> DataFrame:
    """Runs of null values: (by, first, last, n)."""
    w = Window.partitionBy(*by).orderBy(index)
    gaps = log.withColumn("__n", F.row_number().over(w)).where(F.col(value).isNull())
    gaps = gaps.withColumn("__island", F.col("__n") - F.row_number().over(w))
    return gaps.groupBy(*by, "__island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("__island")


def blend_gaps(log: DataFrame, by: Sequence[str], index: str, value: str, predicted: str) -> DataFrame:
    """Predictions in inner gaps drawn to the line between the gap's neighbours: fully at its ends, not at all in its middle.

    adjusted = line + (1 - 2 |x - 1/2|) (predicted - line), x being the place between the neighbours; outer gaps keep their predictions.
    """
    node = F.when(F.col(value).isNotNull(), F.struct(F.col(index).cast("double").alias("x"), F.col(value).alias("y")))
    out = log.withColumn("__lo", _last(node, by, F.col(index).asc())).withColumn("__hi", _last(node, by, F.col(index).desc()))
    x = (F.col(index) - F.col("__lo.x")) / (F.col("__hi.x") - F.col("__lo.x"))
    line = F.col("__lo.y") + x * (F.col("__hi.y") - F.col("__lo.y"))
    blended = F.when(F.col("__lo").isNull() | F.col("__hi").isNull(), F.col(predicted)).otherwise(line + (1 - 2 * F.abs(x - 0.5)) * (F.col(predicted) - line))
    return out.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).otherwise(blended)).drop("__lo", "__hi")


def quantile_fence(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, reach: float = 1.5) -> DataFrame:
    """Rows within reach x (q_high - q_low) of the two quantiles."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__q")).select(*by, F.col("__q")[0].alias("__a"), F.col("__q")[1].alias("__b"))
    span = F.col("__b") - F.col("__a")
    return df.join(q, list(by)).where((F.col(value) >= F.col("__a") - reach * span) & (F.col(value) <= F.col("__b") + reach * span)).drop("__a", "__b")


def bounding_box(pixels: DataFrame, by: Sequence[str], row: str, col: str, value: str, limit: float) -> DataFrame:
    """Least and largest row and column of the pixels above the limit; groups without any are left out."""
    return pixels.where(F.col(value) > limit).groupBy(*by).agg(F.min(row).alias("row0"), F.max(row).alias("row1"), F.min(col).alias("col0"), F.max(col).alias("col1"))


def trim(pixels: DataFrame, by: Sequence[str], row: str, col: str, value: str, limit: float) -> DataFrame:
    """The pixels inside the bounding box of those above the limit, rows and columns counted from its corner; images without any are left out."""
    box = bounding_box(pixels, by, row, col, value, limit)
    inside = pixels.join(box, list(by)).where(F.col(row).between(F.col("row0"), F.col("row1")) & F.col(col).between(F.col("col0"), F.col("col1")))
    return inside.withColumn(row, F.col(row) - F.col("row0")).withColumn(col, F.col(col) - F.col("col0")).drop("row0", "row1", "col0", "col1")


def thresholds(log: DataFrame, rules: Mapping[str, tuple[str, float, int]], by: Sequence[str], order: str, apply_to_all: Sequence[str] = ()) -> DataFrame:
    """Each column of rules loses the values that its (operator, limit, buffer) rules out; what a column of apply_to_all rules out, all lose."""
    near = {c: F.max(F.coalesce(threshold(c, op, limit), F.lit(False)).cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-buffer, buffer)) == 1 for c, (op, limit, buffer) in rules.items()}
    out = log.withColumns({f"__bad_{c}": n for c, n in near.items()})
    bad = lambda c: functools.reduce(lambda x, y: x | y, [F.col(f"__bad_{k}") for k in {c, *apply_to_all}])
    return out.withColumns({c: F.when(bad(c), None).otherwise(F.col(c)) for c in rules}).drop(*[f"__bad_{c}" for c in rules])


def null_ends(log: DataFrame, columns: Sequence[str], by: Sequence[str], order: str, n: int) -> DataFrame:
    """The first and last n rows of each series lose the columns' values."""
    first, last = (F.row_number().over(Window.partitionBy(*by).orderBy(o)) for o in (F.col(order).asc(), F.col(order).desc()))
    out = log.withColumn("__end", (first <= n) | (last <= n))
    return out.withColumns({c: F.when(F.col("__end"), None).otherwise(F.col(c)) for c in columns}).drop("__end")
