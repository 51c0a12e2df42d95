"""Ranking of mappings: cleaning, weighted min-max scores, bed matches, required datums, even samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.functions.columns import clean_bed

LOWER_IS_BETTER = {"norm_dtw", "dtw_ratio"}


def score_mappings(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """df with score: the weighted mean of the metrics scaled to [0, 1], turned where lower is better. Constant metrics drop out; nulls count 0."""
    used = [m for m, w in weights.items() if w]
    ends = df.agg(*[f(m).alias(f"__{f.__name__}_{m}") for m in used for f in (F.min, F.max)])
    out = df.join(F.broadcast(ends))  # one row
    total, weight = F.lit(0.0), F.lit(0.0)
    for m in used:
        lo, hi = F.col(f"__min_{m}"), F.col(f"__max_{m}")
        x = (F.col(m) - lo) / (hi - lo)
        x = 1 - x if m in LOWER_IS_BETTER else x
        total = total + F.when(hi > lo, weights[m] * F.coalesce(x, F.lit(0.0))).otherwise(0.0)
        weight = weight + F.when(hi > lo, F.lit(float(weights[m]))).otherwise(0.0)
    return out.withColumn("score", F.when(weight > 0, total / weight).otherwise(0.0)).drop(*ends.columns)


def best_mappings(df: DataFrame, weights: Mapping[str, float], top: int, shortest: bool = True, needed: tuple = ("corr_coef", "perc_diag", "perc_age_overlap"), tie: str = "mapping_id") -> DataFrame:
    """The `top` best rows with ranking 1 .. top, among the shortest if asked. Infinite metrics count as missing; rows missing a needed one go."""
    clean = df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c in {*weights, *needed} if c in df.columns})
    clean = clean.dropna(subset=[c for c in needed if c in df.columns])
    if shortest:
        clean = clean.join(F.broadcast(clean.agg(F.min("length").alias("__least")))).where("length = __least").drop("__least")
    best = score_mappings(clean, weights).orderBy(F.col("score").desc(), tie).limit(top)  # a report of `top` rows
    return best.withColumn("ranking", F.row_number().over(Window.orderBy(F.col("score").desc(), tie)))


def matching_pairs(a: DataFrame, b: DataFrame, bed: str = "bed", datum: str = "datum", first: bool = False) -> DataFrame:
    """(bed, a, b): datums of two cores with the same bed name; unnamed ones match nothing. With first each of a meets the first of b only."""
    left = a.select(clean_bed(F.col(bed)).alias("bed"), F.col(datum).alias("a"))
    right = b.select(clean_bed(F.col(bed)).alias("bed"), F.col(datum).alias("b"))
    if first:
        right = right.groupBy("bed").agg(F.min("b").alias("b"))
    return left.where("bed != ''").join(right, "bed")


def covering(paths: DataFrame, required: DataFrame) -> DataFrame:
    """Mappings (mapping_id, datum) that have all required datums (datum); if there are none, those with most of them."""
    needed = required.select("datum").distinct()
    hits = paths.select("mapping_id", "datum").distinct().join(needed, "datum").groupBy("mapping_id").agg(F.count("*").alias("n_covered"))
    return hits.join(F.broadcast(hits.agg(F.max("n_covered").alias("m")))).where("n_covered = m").drop("m")


def even_sample(df: DataFrame, order: str, most: int) -> DataFrame:
    """Rows floor(i n / most) of the order for i from 0, if there are more than `most`; all rows otherwise."""
    from tephra.plans.tables import numbered

    rows = numbered(df, order, name="__n")
    n = df.count()
    if n <= most:
        return rows.drop("__n")
    at = F.floor((F.col("__n") * most + n - 1) / n)
    return rows.where((F.floor(at * n / most) == F.col("__n")) & (at < most)).drop("__n")


def path_ends(paths: DataFrame, path: str = "path", by: str = "mapping_id") -> DataFrame:
    """(mapping_id, a, b): the pairs of boundaries that a path "a,b|a,b" of segment numbers comes through: where its steps begin and end.

    Segment 2 i is boundary i itself and 2 i + 1 lies between boundaries i and i + 1.
    """
    step = paths.select(by, F.explode(F.split(path, r"\|")).alias("__s")).select(by, F.split("__s", ",").alias("__s"))
    seg = step.select(by, F.col("__s")[0].cast("int").alias("x"), F.col("__s")[1].cast("int").alias("y"))
    begin = seg.select(by, F.shiftright("x", 1).alias("a"), F.shiftright("y", 1).alias("b"))
    return begin.union(seg.select(by, F.shiftright(F.col("x") + 1, 1), F.shiftright(F.col("y") + 1, 1))).distinct()


def boundary_mappings(mappings: DataFrame, beds_a: DataFrame, beds_b: DataFrame, weights: Mapping[str, float], top: int, valid: DataFrame | None = None, needed: tuple = ("corr_coef", "perc_diag", "perc_age_overlap")) -> DataFrame:
    """The `top` best mappings among those that join the named beds of both cores, with n_covered, score and ranking_datums 1 .. top.

    beds: (b, bed), the names of boundaries; pairs of boundaries with the same name, cleaned of question marks, are to be joined (those in
    valid (a, b) only, if given). Mappings through all of them compete; if there are none, those through most of them, and of these the
    ones with most segments. Without any pair of names every mapping competes, as do shorter and longer ones.
    """
    pairs = matching_pairs(beds_a, beds_b, datum="b").select("a", "b").distinct()
    if valid is not None:
        pairs = pairs.join(valid.select("a", "b").distinct(), ["a", "b"])
    hits = path_ends(mappings).join(pairs, ["a", "b"]).groupBy("mapping_id").agg(F.count("*").alias("n_covered"))
    out = mappings.join(hits, "mapping_id", "left").fillna(0, ["n_covered"])
    most, all_ = out.agg(F.max("n_covered").alias("__m")), pairs.agg(F.count("*").alias("__all"))
    out = out.join(F.broadcast(most)).where("n_covered = __m").join(F.broadcast(all_))  # one row each
    longest = out.agg(F.max("length").alias("__long"))
    out = out.join(F.broadcast(longest)).where("__m = __all or length = __long").drop("__m", "__all", "__long")
    return best_mappings(out, weights, top, shortest=False, needed=needed).withColumnRenamed("ranking", "ranking_datums")


def by_metric(df: DataFrame, metric: str, tie: str = "mapping_id", first: int | None = None) -> DataFrame:
    """Rows by ascending metric, unknown ones last; `first` frames of them where only so many are drawn."""
    out = df.orderBy(F.col(metric).asc_nulls_last(), tie)
    return out if first is None else out.limit(first)


def best_datum(ranked: DataFrame, value: str) -> DataFrame:
    """The value of the mapping that ranks first among those through the named beds; no row if none does."""
    return ranked.where("ranking_datums = 1").select(value)


def is_within(p: Column, q: Column) -> Column:
    """Whether all steps of one path are steps of the other."""
    return (F.size(F.array_except(p, q)) == 0) | (F.size(F.array_except(q, p)) == 0)


#: Paths of most steps that all others are compared with at first.
FIRST = 256


def largest_paths(paths: DataFrame, by: str = "mapping_id", path: str = "path") -> DataFrame:
    """Paths ("a,b|a,b") whose steps are no proper part of another's, and of equal ones that of the least id.

    Paths of equal steps are one set. A set can only lie in a larger one that has its two rarest steps, so sets meet under those alone: every
    set is found by the pairs of its steps that some set has as its rarest two. A signature of 62 bits rules most of what meets out, the
    steps decide.
    """
    from tephra.plans.tables import written

    steps = F.array_sort(F.array_distinct(F.split(path, r"\|")))
    named = written(paths.select(by, steps.alias("__s")), "sets")
    sets = written(named.groupBy("__s").agg(F.min(by).alias("__id")), "sets")
    often = sets.select(F.explode("__s").alias("x")).groupBy("x").agg(F.count("*").alias("f"))
    ranked = sets.select("__id", F.explode("__s").alias("x")).join(often, "x").groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("r"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("x"), F.lit(62)).cast("int"))).alias("sig"))
    ranked = written(ranked.select("__id", "sig", F.transform("r", lambda e: e["x"]).alias("r")), "ranked")
    # the largest sets hold most others, and what lies in a set that lies in one of them lies in that one, too
    able = lambda r, sig, of: (F.size(of["r"]) > F.size(r)) & (F.col(sig).bitwiseAND(F.bitwise_not(of["sig"])) == 0) & (F.size(F.array_except(r, of["r"])) == 0)
    top = ranked.orderBy(F.size("r").desc(), "__id").limit(FIRST).agg(F.collect_list(F.struct("sig", "r")).alias("__top"))
    ranked = written(ranked.join(F.broadcast(top)).where(~F.exists("__top", lambda of: able("r", "sig", of))).drop("__top"), "ranked")  # one row
    small = ranked.select("__id", "sig", "r", F.get("r", F.lit(0)).alias("x"), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0))).alias("y"))
    ends = F.flatten(F.transform("r", lambda e, k: F.transform(F.slice("r", k + 1, F.size("r")), lambda g: F.struct(e.alias("x"), g.alias("y")))))
    large = ranked.select(F.col("__id").alias("__of"), F.col("sig").alias("__sig"), F.col("r").alias("__r"), F.explode(ends).alias("e")).select("__of", "__sig", "__r", "e.x", "e.y")
    large = large.join(small.select("x", "y").distinct(), ["x", "y"], "left_semi")
    inside = small.join(large, ["x", "y"]).where(F.size("__r") > F.size("r")).where(F.col("sig").bitwiseAND(F.bitwise_not("__sig")) == 0).where(F.size(F.array_except("r", "__r")) == 0)
    kept = ranked.join(inside.select("__id").distinct(), "__id", "left_anti")
    return paths.join(kept.select(F.col("__id").alias(by)), by, "left_semi")
