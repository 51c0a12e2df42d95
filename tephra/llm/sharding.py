"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to source partitions by a hash. A matrix says how many rows of each source go to each shard: its rows sum to the
sources' counts, its columns to the shards' sizes, and it is drawn as a uniformly random permutation would make it (multivariate
hypergeometric, source after source). Each source permutes its rows and cuts the permutation by its row of the matrix; the rows are
exchanged, and each shard permutes what it got. The order within a shard is found in blocks, so that no task holds a whole shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, written

#: numpy draws from urns of fewer balls than this.
URN = 10**9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts that differ by one at most; the first shards are the larger."""
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)


def draw(rng: np.random.Generator, urn: np.ndarray, n: int, most: int = URN) -> np.ndarray:
    """How many balls of each colour n draws without replacement take (multivariate hypergeometric, exactly, from urns of any size).

    Beyond numpy's range every ball is first taken or not by a coin of n / N, which gives binomial counts; the surplus, some roots of n,
    is then put back, or what lacks is taken, ball by ball: places drawn evenly among those that are taken (or not), each once.
    """
    total = int(urn.sum())
    if total < most:
        return rng.multivariate_hypergeometric(urn, n, method="marginals")
    taken = rng.binomial(urn, n / total)
    extra = int(taken.sum()) - n
    from_ = taken if extra > 0 else urn - taken
    places = np.zeros(0, np.int64)
    while len(places) < abs(extra):  # each place at most once: repeated ones are drawn again
        more = rng.integers(0, int(from_.sum()), abs(extra) - len(places))
        places = np.concatenate((places, np.setdiff1d(more, places)))
    moved = np.bincount(np.searchsorted(np.cumsum(from_), places, "right"), minlength=len(urn))
    return taken - moved if extra > 0 else taken + moved


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows of each source for each shard, as a uniform permutation of all rows would send them."""
    rng = np.random.default_rng(seed)
    left = sizes.astype(np.int64).copy()
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for k, n in enumerate(counts):
        out[k] = draw(rng, left, n)
        left -= out[k]
    return out


def _numbered(df: DataFrame, seed: int) -> DataFrame:
    """df with __key: a hash of the row and of its number among the rows that are equal to it.

    Only hashes (128 bits of a row) are exchanged to find repeated rows. Of those one copy is kept with its count, and laid out again under
    the numbers 0 to count - 1: no task gets all copies of a row, and it doesn't matter how the input is partitioned.
    """
    names = df.columns
    cells = [F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]
    one, two = row_key(F.lit(seed), *cells)
    keyed = df.withColumn("__k1", one).withColumn("__k2", two)
    again = written(keyed.groupBy("__k1", "__k2").count().where(F.col("count") > 1).select("__k1", "__k2"), "repeated")
    key = lambda n: F.xxhash64("__k1", "__k2", n).alias("__key")
    columns = [F.col(f"`{c}`") for c in names]
    n = again.count()
    if not n:
        return keyed.select(*columns, key(F.lit(0)))
    again = F.broadcast(again) if n <= 100_000 else again
    single = keyed.join(again, ["__k1", "__k2"], "left_anti").select(*columns, key(F.lit(0)))
    copies = keyed.join(again, ["__k1", "__k2"], "left_semi").groupBy("__k1", "__k2").agg(F.first(F.struct(*columns)).alias("__row"), F.count("*").alias("__n"))
    copies = copies.withColumn("__no", F.explode(F.sequence(F.lit(0), F.col("__n").cast("int") - 1)))
    return single.union(copies.select(*[F.col(f"__row.`{c}`") for c in names], key(F.col("__no"))))


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, rows_per_source: int = 5_000, most_sources: int = 50_000, rows_per_block: int = 20_000) -> DataFrame:
    """df with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard), in a uniformly random order.

    Rows per shard differ by one at most. The same rows, shards and seed give the same result, however they are partitioned. Rows that
    are equal in all columns are numbered and scattered like any others. Nulls are values like any other; an
    empty table stays empty. Columns of df named shard or slot are replaced; no other name can clash.

    The driver draws the matrix from one count a source: at most most_sources x shards numbers. All rows are exchanged twice; long texts
    are moved as they are.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    names = df.columns
    total = df.count()
    sources = int(min(most_sources, max(16, -(-total // rows_per_source))))
    blocks = max(1, -(-total // (shards * rows_per_block)))
    rows = _numbered(df, seed)
    source = F.pmod(F.xxhash64(F.lit("source"), "__key"), F.lit(sources)).cast("int")
    counted = dict(rows.select(source.alias("s")).groupBy("s").count().collect())  # at most most_sources numbers
    matrix = communication_matrix([counted.get(k, 0) for k in range(sources)], shard_sizes(total, shards), seed)
    cuts = spark.createDataFrame([(k, [int(x) for x in np.cumsum(matrix[k])]) for k in range(sources)], "__source int, __cuts array<long>")

    def placed(of: DataFrame) -> DataFrame:
        """Permuted in its source and cut: shard, and the block of its random place in the shard."""
        order = Window.partitionBy("__source").orderBy(F.xxhash64(F.lit("local"), "__key"), "__key")
        of = of.withColumn("__source", source).withColumn("__at", F.row_number().over(order).cast("long") - 1)
        of = of.join(F.broadcast(cuts), "__source")  # bounded by most_sources x shards numbers
        return of.withColumn("shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__at")))).withColumn("__place", F.xxhash64(F.lit("final"), "__key")).withColumn("__block", F.pmod("__place", F.lit(blocks)).cast("int"))

    held = placed(rows.select("__key")).groupBy("shard", "__block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("shard", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("shard", "__block").orderBy("__place", "__key")
    out = placed(rows).withColumn("__rank", F.row_number().over(inside))
    out = out.join(base, ["shard", "__block"])
    return out.select(*[F.col(f"`{c}`") for c in names], "shard", (F.col("__base") + F.col("__rank") - 1).cast("long").alias("slot"))
