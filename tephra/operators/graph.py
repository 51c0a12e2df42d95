"""Segments of cores, their pairs, and the graph of pairs: special nodes, reachability, path counts and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tephra.plans.tables import work_path, written

from . import grid, paths
from .series import nearest_index


def boundaries(picks: DataFrame, log: DataFrame, core: str = "core_id", depth: str = "depth", index: str = "idx", top_depth: float = 0.0, top_bottom: bool = True) -> DataFrame:
    """(core, b, d, index): the picks of a core and, with top_bottom, its top and its last depth, numbered downwards; index is that of the
    nearest row of its log."""
    all_ = picks.select(core, F.col(depth).cast("double").alias("d"))
    if top_bottom:
        span = log.groupBy(core).agg(F.max(depth).alias("hi"))
        all_ = all_.unionByName(span.select(core, F.lit(float(top_depth)).alias("d"))).unionByName(span.select(core, F.col("hi").cast("double").alias("d")))
    at = nearest_index(all_.distinct(), log, [core], "d", depth, index)
    return at.select(core, (F.row_number().over(Window.partitionBy(core).orderBy("d")) - 1).cast("int").alias("b"), "d", index)


def segments(picks: DataFrame, log: DataFrame, core: str = "core_id", depth: str = "depth", index: str = "idx", top_depth: float = 0.0, top_bottom: bool = True) -> DataFrame:
    """(core, seg_id, b0, b1, start_idx, end_idx, is_point): segment 2 i is boundary i itself and 2 i + 1 the interval to the next."""
    at = boundaries(picks, log, core, depth, index, top_depth, top_bottom)
    w = Window.partitionBy(core).orderBy("b")
    b = at.select(core, F.col("b").alias("b0"), F.col(index).alias("start_idx"), F.lead(index).over(w).alias("next"))
    point = b.select(core, (2 * F.col("b0")).alias("seg_id"), "b0", F.col("b0").alias("b1"), "start_idx", F.col("start_idx").alias("end_idx"), F.lit(True).alias("is_point"))
    interval = b.where("next is not null").select(core, (2 * F.col("b0") + 1).alias("seg_id"), "b0", (F.col("b0") + 1).alias("b1"), "start_idx", F.col("next").alias("end_idx"), F.lit(False).alias("is_point"))
    return point.unionByName(interval)


def segment_pairs(a: DataFrame, b: DataFrame, by: str | None = None) -> DataFrame:
    """Every segment of a with every one of b for each value of `by` (or of two cores), but those where both have a single row (points, and
    intervals between picks that are nearer than the log's step): what an alignment of two cores is made of. Joined on `by` by merging, so that every pair of cores is a group of its own, whose rows stay beside each other, and neither side is broadcast."""
    on = by or "__pair"
    a, b = (s if by else s.withColumn(on, F.lit(0)) for s in (a, b))
    side = lambda s, c: s.select(on, *[F.col(x).alias(f"{c}_{x}") for x in ("seg_id", "b0", "b1", "start_idx", "end_idx", "is_point")])
    out = side(a, "a").hint("merge").join(side(b, "b"), on).where((F.col("a_start_idx") < F.col("a_end_idx")) | (F.col("b_start_idx") < F.col("b_end_idx"))).withColumn("key", F.concat_ws(",", "a_seg_id", "b_seg_id"))
    return out if by else out.drop(on)


def edges(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, dst): pairs that begin where another ends in both cores. pairs: by, key, a_b0, a_b1, b_b0, b_b1."""
    by = list(by)
    nxt = pairs.select(*by, F.col("a_b0").alias("a_b1"), F.col("b_b0").alias("b_b1"), F.col("key").alias("dst"))
    return pairs.select(*by, "a_b1", "b_b1", F.col("key").alias("src")).join(nxt, [*by, "a_b1", "b_b1"]).where("src != dst").select(*by, "src", "dst")


def special(pairs: DataFrame, links: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """pairs' keys with is_top, is_bottom, dead_end and orphan; by the boundaries where pairs begin and end, or by given links."""
    by = list(by)
    last = pairs.groupBy(*by).agg(F.max("a_b1").alias("__ma"), F.max("b_b1").alias("__mb"))
    out = pairs.join(last, by) if by else pairs.join(F.broadcast(last))  # one row
    if links is None:
        out = out.join(pairs.select(*by, F.col("a_b0").alias("a_b1"), F.col("b_b0").alias("b_b1"), F.lit(True).alias("__succ")).distinct(), [*by, "a_b1", "b_b1"], "left")
        out = out.join(pairs.select(*by, F.col("a_b1").alias("a_b0"), F.col("b_b1").alias("b_b0"), F.lit(True).alias("__pred")).distinct(), [*by, "a_b0", "b_b0"], "left")
    else:
        out = out.join(links.select(*by, F.col("src").alias("key"), F.lit(True).alias("__succ")).distinct(), [*by, "key"], "left")
        out = out.join(links.select(*by, F.col("dst").alias("key"), F.lit(True).alias("__pred")).distinct(), [*by, "key"], "left")
    top = (F.col("a_b0") == 0) & (F.col("b_b0") == 0)
    bottom = (F.col("a_b1") == F.col("__ma")) & (F.col("b_b1") == F.col("__mb"))
    return out.select(*by, "key", top.alias("is_top"), bottom.alias("is_bottom"), (F.col("__succ").isNull() & ~bottom).alias("dead_end"), (F.col("__pred").isNull() & ~top).alias("orphan"))


def _edges(pairs: DataFrame, by: list[str], mask: Column | None = None) -> DataFrame:
    """pairs as the edges of a grid of boundaries."""
    ends = [F.col(c).cast("long").alias(n) for c, n in (("a_b0", "i"), ("b_b0", "j"), ("a_b1", "i2"), ("b_b1", "j2"))]
    return pairs.select(*by, "key", *ends, (F.lit(-1) if mask is None else mask).cast("long").alias("mask"))


def on_complete_paths(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keys on a way from a top to a bottom; all keys where there is no top or no bottom."""
    by = list(by)
    found = grid.reach(_edges(pairs, by), by, ends=True)
    return found.where("(ahead != 0 and back != 0) or not has_ends").select(*by, "key")


def has_complete_paths(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, complete): whether a bottom can be reached from a top."""
    by = list(by)
    found = grid.reach(_edges(pairs, by), by)
    return found.groupBy(*by).agg(F.coalesce(F.max(F.expr("ahead != 0 and back != 0")), F.lit(False)).alias("complete"))


def count_paths(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_paths decimal(38,0), digits): ways from tops to bottoms, in groups that have any; digits has them in full, n_paths is null from
    10^38 on."""
    by = list(by)
    found = grid.ways(_edges(pairs, by), by)
    return found.select(*by, F.when(F.length("n") <= 38, F.col("n")).cast("decimal(38,0)").alias("n_paths"), F.col("n").alias("digits"))


#: Segment pairs that begin at both tops and are not their points alone: the first steps where a path may only start there.
FIRST_STEPS = ("1,0", "1,1", "0,1")


def complete_paths(pairs: DataFrame, by: Sequence[str] = (), shortest_levels: int | None = None, most: int | None = None, seed: int = 0, starts: Sequence[str] | None = None, mask: str | None = None) -> DataFrame:
    """(by, path, length): paths "key|key|..." from tops (only those keys that starts names, if it names any) to bottoms.

    A level (sum of a pair's end boundaries) is done when all lower ones are; then, of the paths that end in each pair, those of the
    shortest_levels least lengths stay and, but at bottoms, at most `most` of them in a seeded order. Without both limits every path is
    found. Which lengths stay is known without any path (`paths`), so paths are written down once, in parts of bounded size; only grids where
    `most` may cut anything go level by level.

    mask names a long column of pairs whose bits say which of up to 64 searches may use a pair: all are made in one, each path carries the
    bits of the searches that have it (column mask), and both limits hold for every search by itself.
    """
    by = list(by)
    own = mask or "__mask"
    pairs = pairs if mask else pairs.withColumn(own, F.lit(1).cast("long"))
    found = grid.reach(_edges(pairs, by, F.col(own)), by)
    bits = F.col("mask").bitwiseAND(F.col("ahead")).bitwiseAND(F.col("back"))  # what leads nowhere is never begun
    node = F.when(bits != 0, F.struct("key", bits.alias("bits"), "i", "j", "i2", "j2"))
    grids = found.groupBy(*by).agg(F.max("i2").alias("mi"), F.max("j2").alias("mj"), F.collect_list(node).alias("nodes"))  # a grid's
    plans = paths.planned(grids, by, starts, shortest_levels, most)
    if most is None:
        return paths.listed(plans, by, starts, shortest_levels, mask)
    plans = written(plans, "plans")
    out = paths.listed(plans.where("not capped"), by, starts, shortest_levels, mask)
    long = plans.where("capped")
    if long.isEmpty():
        return out
    return out.unionByName(_by_levels(long, by, shortest_levels, most, seed, starts, mask))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _by_levels(grids: DataFrame, by: list[str], shortest_levels: int | None, most: int, seed: int, starts: Sequence[str] | None, mask: str | None) -> DataFrame:
    """The paths of those grids of which some node has more than `most`: level by level, so that the cap is Spark's to take."""
    spark = grids.sparkSession
    node = grids.select(*by, "mi", "mj", F.explode("nodes").alias("n")).select(*by, "n.*", F.expr("n.i2 + n.j2").alias("level"), F.expr("n.i = 0 and n.j = 0").alias("is_top"), F.expr("n.i2 = mi and n.j2 = mj").alias("is_bottom"))
    node = written(node, "nodes")
    after = node.where("not is_bottom").select(*by, F.col("key").alias("src"), F.col("i2").alias("i"), F.col("j2").alias("j")).hint("merge")
    links = written(after.join(node.select(*by, "i", "j", F.col("key").alias("dst"), F.col("bits").alias("__to"), F.col("level").alias("to_level"), F.col("is_bottom").alias("__end")), [*by, "i", "j"]).where("src != dst").drop("i", "j"), "edges")
    # paths wait in a table by level; each level is read once and its successors are appended
    store = work_path(spark, "waiting")
    waiting = node.where("is_top").where(F.col("key").isin(list(starts)) if starts else F.lit(True)).select(*by, F.col("key").alias("last"), F.col("key").alias("path"), F.lit(1).alias("length"), "bits", "is_bottom", "level")
    schema = waiting.drop("level").schema
    waiting.write.partitionBy("level").parquet(store)
    ended = []
    for (now,) in node.select("level").distinct().orderBy("level").collect():  # as many as boundaries in two cores
        if not _there(spark, f"{store}/level={now}"):
            continue
        ranked = spark.read.schema(schema).parquet(f"{store}/level={now}")
        if shortest_levels is not None:
            ranked = _shortest(ranked, [*by, "last"], shortest_levels)
        ranked = ranked.where("is_bottom").unionByName(_capped(ranked.where("not is_bottom"), [*by, "last"], most, seed, bool(mask)))
        ranked = written(ranked, "paths")
        ended.append(ranked.where("is_bottom").select(*by, "path", "length", "bits"))
        more = ranked.where("not is_bottom").select(*by, F.col("last").alias("src"), "path", "length", "bits").hint("merge").join(links, [*by, "src"])
        more = more.withColumn("bits", F.col("bits").bitwiseAND(F.col("__to"))).where("bits != 0")
        more = more.select(*by, F.col("dst").alias("last"), F.concat_ws("|", "path", "dst").alias("path"), (F.col("length") + 1).alias("length"), "bits", F.col("__end").alias("is_bottom"), F.col("to_level").alias("level"))
        more.write.mode("append").partitionBy("level").parquet(store)
    out = ended[0] if ended else spark.createDataFrame([], schema).select(*by, "path", "length", "bits")
    for x in ended[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("bits", mask) if mask else out.drop("bits")


def _shortest(paths: DataFrame, by: list[str], levels: int) -> DataFrame:
    """paths without the bits for which `levels` shorter lengths are there: lengths' bits are united, then counted downwards."""
    held = paths.groupBy(*by, "length").agg(F.bit_or("bits").alias("__m"))
    before = F.collect_list("__m").over(Window.partitionBy(*by).orderBy("length").rowsBetween(Window.unboundedPreceding, -1))  # a row a length
    none = F.array_repeat(F.lit(0).cast("long"), levels)
    # seen[k]: the bits that more than k shorter lengths have
    step = lambda seen, m: F.transform(seen, lambda x, k: x.bitwiseOR(F.when(k == 0, m).otherwise(F.get(seen, k - 1).bitwiseAND(m))))
    full = F.get(F.aggregate(before, none, step), F.lit(levels - 1))
    return paths.hint("merge").join(held.select(*by, "length", full.alias("__full")), [*by, "length"]).withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not("__full"))).where("bits != 0").select(*paths.columns)


def _capped(paths: DataFrame, by: list[str], most: int, seed: int, many: bool) -> DataFrame:
    """At most `most` paths of each group and bit, in a seeded order."""
    order = (F.xxhash64("path", F.lit(seed)), F.col("path"))
    if not many:
        return paths.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= most).drop("__r")
    each = paths.withColumn("__b", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)))
    each = each.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order))).where(F.col("__r") <= most)
    return each.groupBy(*[c for c in paths.columns if c != "bits"]).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__b"))).alias("bits")).select(*paths.columns)


def depth_gaps(intervals: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Ranges that no interval covers, between the first and the last: (by, gap_start, gap_end)."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("__hi", F.max(end).over(w)).where(F.col(start) > F.col("__hi")).select(*by, F.col("__hi").alias("gap_start"), F.col(start).alias("gap_end"))


def chain_breaks(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Why paths break off, one row for each pair of segments: (by, key, kind, n_in, n_out, level, from_top, to_bottom, is_complete).

    kind: top, bottom, dead_end, orphan or inner; level: the sum of the boundaries where it ends, so that of the pairs with from_top but
    without to_bottom those of the largest levels are as deep as broken chains come.
    """
    by = list(by)
    out = grid.reach(_edges(pairs, by), by, degrees=True, ends=True).withColumn("level", (F.col("i2") + F.col("j2")).cast("int"))
    out = out.withColumn("dead_end", F.expr("n_out = 0 and not is_bottom")).withColumn("orphan", F.expr("n_in = 0 and not is_top"))
    name = F.when(F.col("is_top"), "top").when(F.col("is_bottom"), "bottom").when(F.col("dead_end"), "dead_end").when(F.col("orphan"), "orphan").otherwise("inner")
    top, bottom = F.col("ahead") != 0, F.col("back") != 0
    return out.select(*by, "key", name.alias("kind"), "n_in", "n_out", "level", top.alias("from_top"), bottom.alias("to_bottom"), (top & bottom).alias("is_complete"))


def cap_paths(paths: DataFrame, most: int, by: Sequence[str] = (), seed: int = 0, complete: str = "is_complete") -> DataFrame:
    """All complete paths and, of the others, `most` of each group in a seeded order."""
    w = Window.partitionBy(*by, complete).orderBy(F.xxhash64("path", F.lit(seed)), "path")
    return paths.withColumn("__r", F.row_number().over(w)).where(F.col(complete) | (F.col("__r") <= most)).drop("__r")


def dedup_paths(paths: DataFrame, by: Sequence[str] = (), path: str = "path", id_col: str = "mapping_id") -> DataFrame:
    """(by, path, mapping_id, n): every path once, with its least id and how often it was there."""
    return paths.groupBy(*by, path).agg(F.min(id_col).alias(id_col), F.count("*").alias("n"))


def thirds(log: DataFrame, core: str = "core_id", depth: str = "depth") -> DataFrame:
    """Picks for cores without any: at a third and at two thirds of their rows."""
    w = Window.partitionBy(core)
    at = log.withColumn("__k", F.row_number().over(w.orderBy(depth)) - 1).withColumn("__n", F.count("*").over(w))
    return at.where((F.col("__k") == F.floor(F.col("__n") / 3)) | (F.col("__k") == F.floor(2 * F.col("__n") / 3))).select(core, depth)
