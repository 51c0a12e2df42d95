"""Images as rows of pixels: strips, overlaps of sections, stitching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import mask_with_buffer


def pixels(images: DataFrame, row: str, values: str) -> DataFrame:
    """(row, col, v) of scan lines."""
    return images.select(F.col(row).alias("row"), F.posexplode(values).alias("col", "v"))


def strip_stats(px: DataFrame, by: Sequence[str], start: float, end: float, width: int) -> DataFrame:
    """Mean and population deviation of each row, between two parts of the width."""
    inside = px.where((F.col("col") >= int(width * start)) & (F.col("col") < int(width * end)))
    return inside.groupBy(*by, "row").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def bin_profile(px: DataFrame, by: Sequence[str], row: str, channels: Sequence[str], size: int, target: float | None = None) -> DataFrame:
    """Means and deviations of bins of `size` rows for each channel, and luminance; with target, means scaled to that mean luminance."""
    aggs = [f(c).alias(f"{c}{s}") for c in channels for f, s in ((F.avg, ""), (F.stddev_pop, "_std"))]
    out = px.groupBy(*by, F.floor(F.col(row) / size).alias("bin")).agg(*aggs)
    if len(channels) == 3:
        out = out.withColumn("lum", sum((F.col(c) * w for c, w in zip(channels, (0.2126, 0.7152, 0.0722), strict=True)), F.lit(0.0)))
        if target is not None:
            mean = out.groupBy(*by).agg(F.avg("lum").alias("__m")) if by else out.agg(F.avg("lum").alias("__m"))
            out = (out.join(mean, list(by)) if by else out.join(F.broadcast(mean))).withColumns({c: F.col(c) * target / F.col("__m") for c in (*channels, "lum")}).drop("__m")
    return out


def overlap_correlation(a: DataFrame, b: DataFrame, by: Sequence[str], index: str, value: str, least: int, most: int) -> DataFrame:
    """(by, overlap, r): correlation of a's end with b's beginning for every overlap; undefined ones are 0."""
    by = list(by)
    n = lambda x, c: x.groupBy(*by).agg(F.count("*").alias(c))
    sizes = n(a, "na").join(n(b, "nb"), by).withColumn("overlap", F.explode(F.sequence(F.lit(least), F.lit(most)))).where("overlap <= na and overlap <= nb")
    left = sizes.join(a.select(*by, F.col(index).alias("__i"), F.col(value).alias("__x")), by).where("__i >= na - overlap").withColumn("__i", F.col("__i") - (F.col("na") - F.col("overlap")))
    both = left.join(b.select(*by, F.col(index).alias("__i"), F.col(value).alias("__y")), [*by, "__i"])
    r = F.corr("__x", "__y")
    return both.groupBy(*by, "overlap").agg(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("r"))


def best_overlap(correlations: DataFrame, by: Sequence[str]) -> DataFrame:
    """The overlap of the largest correlation; the shortest of equals."""
    return correlations.groupBy(*by).agg(F.max_by("overlap", F.struct("r", -F.col("overlap"))).alias("overlap"), F.max("r").alias("r"))


def stitch(a: DataFrame, b: DataFrame, by: Sequence[str], index: str, value: str, overlap: int) -> DataFrame:
    """One curve: b moved behind a and by the overlap's mean difference; the mean where both are known and not 0, there else null."""
    by = list(by)
    n = a.groupBy(*by).agg(F.count("*").alias("__n"))
    moved = b.join(n, by).select(*by, (F.col(index) + F.col("__n") - overlap).alias(index), F.col(value).alias("__b"))
    one = a.select(*by, index, F.col(value).alias("__a"))
    shift = one.join(moved, [*by, index]).groupBy(*by).agg(F.avg(F.col("__a") - F.col("__b")).alias("__shift"))
    both = one.join(moved, [*by, index], "full").join(shift, by).withColumn("__b", F.col("__b") + F.col("__shift"))
    mean = F.when((F.col("__a") == 0) | (F.col("__b") == 0), None).otherwise((F.col("__a") + F.col("__b")) / 2)
    return both.select(*by, index, F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("__a")).otherwise(mean).alias(value))


def plane(voxels: DataFrame, axis: str, index: int) -> DataFrame:
    """One plane of a volume (x, y, z, v): the voxels at `index` of an axis, without that axis. An index outside the volume raises."""
    ends = voxels.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")).head()
    if ends.lo is None or not ends.lo <= index <= ends.hi:
        raise ValueError(f"{axis} = {index} is outside the volume")
    return voxels.where(F.col(axis) == index).drop(axis)


def middle_plane(voxels: DataFrame, by: Sequence[str], axis: str) -> DataFrame:
    """The middle plane of each volume along an axis."""
    mid = voxels.groupBy(*by).agg(F.floor((F.min(axis) + F.max(axis) + 1) / 2).alias("__mid"))
    return voxels.join(mid, list(by)).where(F.col(axis) == F.col("__mid")).drop("__mid", axis)


def crop_rows(px: DataFrame, by: Sequence[str], row: str, top: int, bottom: int) -> DataFrame:
    """Images without `top` rows above and `bottom` rows below, rows counted from the new top. An image that has no more rows raises."""
    ends = px.groupBy(*by).agg(F.min(row).alias("__lo"), F.max(row).alias("__hi"))
    if not ends.where(F.col("__hi") - F.col("__lo") + 1 <= top + bottom).isEmpty():
        raise ValueError(f"an image has no more than {top} + {bottom} rows")
    inside = px.join(ends, list(by)).where((F.col(row) >= F.col("__lo") + top) & (F.col(row) <= F.col("__hi") - bottom))
    return inside.withColumn(row, F.col(row) - F.col("__lo") - top).drop("__lo", "__hi")


def crop_sides(px: DataFrame, by: Sequence[str], col: str, value: str, least: float) -> DataFrame:
    """Images from the first to the last column with a pixel of `least` or more, columns counted from the first; images without any are left out."""
    ends = px.where(F.col(value) >= least).groupBy(*by).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    inside = px.join(ends, list(by)).where(F.col(col).between(F.col("__lo"), F.col("__hi")))
    return inside.withColumn(col, F.col(col) - F.col("__lo")).drop("__lo", "__hi")


def brightness_trace(px: DataFrame, by: Sequence[str], start: float, end: float, least: float, buffer_mm: float, spacing_mm: float) -> DataFrame:
    """(by, row, mean, std) of the strip between two parts of each image's width; rows of a mean below `least`, and those within buffer_mm of
    one, have neither."""
    by = list(by)
    width = px.groupBy(*by).agg((F.max("col") + 1).alias("__w"))
    inside = px.join(width, by).where((F.col("col") >= F.floor(F.col("__w") * start)) & (F.col("col") < F.floor(F.col("__w") * end)))
    trace = inside.groupBy(*by, "row").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return mask_with_buffer(trace, F.col("mean") < least, ["mean", "std"], by, "row", int(buffer_mm / spacing_mm))


def prominences(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, prominences) of a curve's inner peaks, in one pass from either side: a stack holds the points that are higher than all since, each
    with the lowest point on its way to the one below it. NaN is no ground: it stops nothing and lowers nothing."""

    def lowest(values: np.ndarray) -> np.ndarray:
        low, stack = values.copy(), []
        for k, v in enumerate(values.tolist()):
            if v != v:
                continue
            least = v
            while stack and stack[-1][0] <= v:
                least = min(least, stack.pop()[1])
            stack.append((v, least))
            low[k] = least
        return low

    y = np.asarray(y, float)
    if len(y) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    at = 1 + np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:]))
    left, right = lowest(y), lowest(y[::-1])[::-1]
    return at, y[at] - np.maximum(left[at], right[at])


def _extremes(batches, n_by: int, names: list[str]):
    for batch in batches:
        row, place, height, found = [], [], [], []
        for k, (index, value) in enumerate(zip(batch.column(n_by).to_pylist(), batch.column(n_by + 1).to_pylist(), strict=True)):
            y = np.array([np.nan if v is None else v for v in value], float)
            at, out = prominences(y)
            row.extend([k] * len(at))
            place.extend([index[i] for i in at.tolist()])
            height.extend(y[at].tolist())
            found.extend(out.tolist())
        of = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(n_by)), pa.array(place, batch.schema.field(n_by).type.value_type), pa.array(height, pa.float64()), pa.array(found, pa.float64())], names=names)


def extremes(curve: DataFrame, by: Sequence[str], index: str, value: str, prominence: float) -> DataFrame:
    """Peaks of a curve that stand out by `prominence` or more: (by, index, height, prominence, rank by prominence).

    A peak's prominence is its height above the higher of the two lowest points on the ways to the next higher ground (or the curve's end)
    on either side. A curve (a section of an image, thousands of rows) is one array; the work grows with its length.
    """
    by = list(by)
    one = F.array_sort(F.collect_list(F.struct(F.col(index), F.col(value).cast("double").alias("__y"))))
    curves = curve.groupBy(*by).agg(one.alias("__c")).select(*by, F.transform("__c", lambda x: x[index]).alias("__i"), F.transform("__c", lambda x: x["__y"]).alias("__v"))
    kinds = dict(curve.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + f"`{index}` {kinds[index]}, height double, prominence double"
    found = curves.mapInArrow(lambda it: _extremes(it, len(by), [*by, index, "height", "prominence"]), schema).where(F.col("prominence") >= prominence)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("prominence").desc(), index)))


#: What equal places of peaks and valleys in an overlap add to its correlation, and how near they must be.
BONUS = {"first_peak": 2.0, "first_valley": 1.2, "peak": 0.5, "valley": 0.3}
NEAR = {"peak": 5, "valley": 3}


def matched_overlaps(a: DataFrame, b: DataFrame, by: Sequence[str], index: str, value: str, least: int, most: int, prominence: float = 50.0, peaks: int = 10, valleys: int = 5) -> DataFrame:
    """(by, overlap, r, bonus, score): overlap_correlation with a bonus for prominent peaks and valleys of both curves that lie together.

    The first peak (by place) and the first valley of b that fall on one of a within NEAR rows count most, every other such pair of the
    `peaks` and `valleys` most prominent ones a little. best_overlap of score takes the largest, the shortest of equals.
    """
    by = list(by)
    base = overlap_correlation(a, b, by, index, value, least, most)
    na = a.groupBy(*by).agg(F.count("*").alias("__na"))
    total = None
    for kind, sign, top in (("peak", 1, peaks), ("valley", -1, valleys)):
        turned = lambda x, sign=sign: x.select(*by, index, (F.col(value) * sign).alias(value))
        pa, pb = (extremes(turned(x), by, index, value, prominence).where(F.col("rank") <= top) for x in (a, b))
        first = F.row_number().over(Window.partitionBy(*by).orderBy(index)) == 1
        pb = pb.withColumn("__first", first).select(*by, F.col(index).alias("__j"), "__first")
        spots = base.select(*by, "overlap").join(na, by).join(pb, by).withColumn("__at", F.col("__na") - F.col("overlap") + F.col("__j"))
        near = spots.join(pa.select(*by, F.col(index).alias("__i")), by).where(F.abs(F.col("__at") - F.col("__i")) < NEAR[kind])
        got = near.groupBy(*by, "overlap", "__j", "__first").agg(F.lit(1).alias("__one")).select(*by, "overlap", F.when(F.col("__first"), BONUS[f"first_{kind}"]).otherwise(BONUS[kind]).alias("bonus"))
        total = got if total is None else total.unionByName(got)
    bonus = total.groupBy(*by, "overlap").agg(F.sum("bonus").alias("bonus"))
    return base.join(bonus, [*by, "overlap"], "left").select(*by, "overlap", "r", F.coalesce("bonus", F.lit(0.0)).alias("bonus"), (F.col("r") + F.coalesce("bonus", F.lit(0.0))).alias("score"))


def narrowed(px: DataFrame, width: DataFrame, by: Sequence[str]) -> DataFrame:
    """Images at the width (by, width) or their own where that is less: every new column is the old one nearest below its place."""
    by = list(by)
    own = px.groupBy(*by).agg((F.max("col") + 1).alias("__w")).join(width, by)
    cols = own.where("width < __w").withColumn("__new", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    cols = cols.select(*by, "__new", F.floor(F.col("__new") * F.col("__w") / F.col("width")).cast("int").alias("col"))
    wide = px.join(cols, [*by, "col"]).withColumn("col", F.col("__new").cast("int")).drop("__new")
    return px.join(own.where("width >= __w").select(*by), by, "left_semi").select(*px.columns).unionByName(wide.select(*px.columns))


def stitched_image(a: DataFrame, b: DataFrame, by: Sequence[str], overlap: int) -> DataFrame:
    """b below a, of which the last `overlap` rows go, both at the width of the narrower: (by, row, col, v)."""
    by = list(by)
    size = lambda x, n: x.groupBy(*by).agg((F.max("row") + 1).alias(f"__h{n}"), (F.max("col") + 1).alias(f"__w{n}"))
    both = size(a, 1).join(size(b, 2), by)
    width = both.select(*by, F.least("__w1", "__w2").alias("width"))
    shift = both.select(*by, (F.col("__h1") - overlap).alias("__shift"))
    one = narrowed(a, width, by).join(shift, by).where(F.col("row") < F.col("__shift")).drop("__shift")
    two = narrowed(b, width, by).join(shift, by).withColumn("row", F.col("row") + F.col("__shift")).drop("__shift")
    return one.unionByName(two.select(*one.columns))


def scan_trace(voxels: DataFrame, by: Sequence[str], axis: str, least_side: float, start: float, end: float, least: float, buffer_mm: float, spacing_mm: float) -> DataFrame:
    """One scan to its trace: middle plane, sides cut off, brightness of a strip with the dark rows masked."""
    return brightness_trace(crop_sides(middle_plane(voxels, by, axis), by, "col", "v", least_side), by, start, end, least, buffer_mm, spacing_mm)


def chained_sections(sections: DataFrame, by: Sequence[str], order: str, index: str, values: Sequence[str], buffer: int = 0, upside_down: str | None = None) -> DataFrame:
    """Sections of a core one below the other: (by, section, index, values), index counted from the core's top.

    Each section begins behind the last row of the one before; the last `buffer` rows of a section that another follows lose their values
    and the first `buffer` rows of one that follows another are left out. Sections whose upside_down column holds are turned over; an empty
    section (of nulls) keeps its length.
    """
    by = list(by)
    w = Window.partitionBy(*by, order)
    rows = sections.withColumn("__n", F.count("*").over(w)).withColumn("__k", F.row_number().over(w.orderBy(index)) - 1)
    if upside_down:
        rows = rows.withColumn("__k", F.when(F.col(upside_down), F.col("__n") - 1 - F.col("__k")).otherwise(F.col("__k")))
    size = rows.groupBy(*by, order).agg(F.first("__n").alias("__n"))
    ow = Window.partitionBy(*by).orderBy(order)
    place = size.select(*by, order, (F.row_number().over(ow) == 1).alias("__top"), F.lead(order).over(ow).isNull().alias("__last"), F.col("__n").alias("__size"))
    used = F.col("__size") - F.when(F.col("__top"), F.lit(0)).otherwise(F.lit(buffer))
    place = place.withColumn("__base", F.coalesce(F.sum(used).over(ow.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.join(place, [*by, order]).where(F.col("__top") | (F.col("__k") >= buffer))
    ending = ~F.col("__last") & (F.col("__k") >= F.col("__size") - buffer)
    at = F.col("__base") + F.col("__k") - F.when(F.col("__top"), F.lit(0)).otherwise(F.lit(buffer))
    return out.select(*by, order, at.cast("long").alias(index), *[F.when(ending, None).otherwise(F.col(c)).alias(c) for c in values])


def pixel_depths(log: DataFrame, by: Sequence[str], index: str, total: float) -> DataFrame:
    """log with depth: the row's part of the last row, times the whole length."""
    return log.withColumn("depth", F.col(index) * total / F.max(index).over(Window.partitionBy(*by)))
