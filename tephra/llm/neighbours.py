"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact distances.

A table's hash of a vector is the signed axis nearest to it after a pseudo-rotation (three rounds of random signs and a Hadamard
transform); a cell is the axes of `width` such hashes. A question looks into the cells that are nearest to it, in all tables, and every
row found there is measured.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codes import finite, usual_length
from .common import arrow_map, row_key, shuffle_partitions, written

#: Rows a cell has on average, at least, before cells are made of one more hash.
CELL_ROWS = 64


class Hashes:
    """The pseudo-rotations of all tables for vectors of d components, from a seed."""

    def __init__(self, d: int, tables: int, width: int, seed: int = 29):
        self.d, self.tables, self.width = d, tables, width
        self.size = 1 << max(1, (d - 1).bit_length())  # padded to a power of two, 2 at least
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables * width, 3, self.size))

    def turned(self, vectors: np.ndarray, table: int, k: int) -> np.ndarray:
        """Unit vectors after the rotation: its components and, behind them, their negatives."""
        x = np.zeros((len(vectors), self.size))
        x[:, : self.d] = vectors / np.abs(vectors).max(1, keepdims=True)  # no squares of tiny or huge components
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for sign in self.signs[table * self.width + k]:
            x *= sign
            h = 1
            while h < self.size:
                pairs = x.reshape(len(x), -1, 2, h)
                x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), self.size)
                h *= 2
            x /= np.sqrt(self.size)
        return np.concatenate([x, -x], 1)

    def cells(self, vectors: np.ndarray, table: int) -> np.ndarray:
        cell = np.zeros(len(vectors), np.int64)
        for k in range(self.width):
            cell = cell * 2 * self.size + self.turned(vectors, table, k).argmax(1)
        return cell

    def probes(self, vector: np.ndarray, table: int, most: int) -> np.ndarray:
        """The `most` cells whose axes the vector comes nearest to, nearest first."""
        cell, cost = np.zeros(1, np.int64), np.zeros(1)
        for k in range(self.width):
            turned = self.turned(vector[None], table, k)[0]
            behind = (turned.max() - turned) ** 2
            axes = np.argsort(behind, kind="stable")[:most]  # of the best `most` sums none has a later axis
            cost = (cost[:, None] + behind[axes]).ravel()
            cell = (cell[:, None] * 2 * self.size + axes).ravel()
            best = np.argsort(cost, kind="stable")[:most]
            cell, cost = cell[best], cost[best]
        return cell


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def nearest_of(question: np.ndarray, rows: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k nearest rows and any others as near as the k-th: a product of matrices rules rows out, differences decide."""
    rough = squares - 2 * (rows @ question)
    if len(rows) > k:
        slack = 1e-9 * (squares.max() + question @ question)
        places = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + slack)
    else:
        places = np.arange(len(rows))
    away = np.sqrt(((rows[places] - question) ** 2).sum(1))
    if len(places) > k:
        last = np.partition(away, k - 1)[k - 1]
        places, away = places[away <= last], away[away <= last]
    return places, away


def _sample_nearest(batches, d: int, questions: np.ndarray, keys: list[tuple[int, int]], k: int):
    """Of this task's points, the k nearest to each question other than itself."""
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, d))) for _ in keys]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _matrix(batch.column(2), d)
        squares = (rows * rows).sum(1)
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for q, (x, y) in enumerate(keys):
            other = (a != x) | (b != y)
            places, away = nearest_of(questions[q], rows[other], squares[other], k)
            away, found = np.concatenate([best[q][0], away]), np.concatenate([best[q][1], rows[other][places]])
            keep = np.argsort(away, kind="stable")[:k]
            best[q] = away[keep], found[keep]
    for q, (away, rows) in enumerate(best):
        if len(away):
            yield pa.RecordBatch.from_pydict({"question": pa.array([q] * len(away), pa.int32()), "away": away, "vector": pa.array(list(rows), pa.list_(pa.float64()))})


def probes_needed(points: DataFrame, hashes: Hashes, sample: list, k: int, target: float, most: int) -> int:
    """Cells a table that a question must look into so that `target` of the true neighbours of the sample's questions are found.

    The neighbours are found by brute force over all points; the sample bounds the work (rows x sample) and what the driver gets.
    """
    d = hashes.d
    questions = np.array([r.vector for r in sample], np.float64)
    keys = [(r.a, r.b) for r in sample]
    found = arrow_map(points.select("a", "b", "vector"), lambda batches: _sample_nearest(batches, d, questions, keys, k), "question int, away double, vector array<double>")
    order = Window.partitionBy("question").orderBy("away", "vector")
    truth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question", "vector").collect()
    if not truth:
        return 1
    at = np.array([r.question for r in truth])
    vectors = np.array([r.vector for r in truth])
    ranks = np.full(len(truth), most)  # behind all probes
    for t in range(hashes.tables):
        cells = hashes.cells(vectors, t)
        for q in range(len(questions)):
            mine = np.flatnonzero(at == q)
            probed = hashes.probes(questions[q], t, most)
            place = {c: p for p, c in enumerate(probed.tolist())}
            ranks[mine] = np.minimum(ranks[mine], [place.get(c, most) for c in cells[mine].tolist()])
    return int(min(most, np.sort(ranks)[int(np.ceil(target * len(ranks))) - 1] + 1))


def _placed(batches, hashes: Hashes):
    """A row for each table: the cell that a point lies in."""
    for batch in batches:
        if batch.num_rows:
            vectors = _matrix(batch.column(2), hashes.d)
            for t in range(hashes.tables):
                cols = [pa.array(np.full(len(vectors), t, np.int32)), pa.array(hashes.cells(vectors, t)), *batch.columns]
                yield pa.RecordBatch.from_arrays(cols, names=["tab", "cell", "a", "b", "vector", "ids"])


def _probed(batches, hashes: Hashes, probes: int):
    """A row for each table: the cells that a question looks into."""
    for batch in batches:
        if batch.num_rows:
            vectors = _matrix(batch.column(2), hashes.d)
            for t in range(hashes.tables):
                cells = [hashes.probes(v, t, probes) for v in vectors]
                cols = [pa.array(np.full(len(vectors), t, np.int32)), pa.array(cells, pa.list_(pa.int64())), *batch.columns]
                yield pa.RecordBatch.from_arrays(cols, names=["tab", "cells", "a", "b", "vector"])


_FOUND = "a long, b long, vec_id long, score double"


def _measured(batches, d: int, k: int):
    """Rows come sorted by (tab, cell, salt, kind): a cell's points (one salt's are bounded), then the questions, which stream past them."""
    cell, held, ids, ready = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
        kind = batch.column(3).to_numpy()
        vectors = _matrix(batch.column(6), d)
        owners = batch.column(7)
        change = np.flatnonzero((key[1:] != key[:-1]).any(1) | (kind[1:] != kind[:-1])) + 1
        out: list[tuple] = []
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(key)], strict=True):
            if tuple(key[lo]) != cell:
                cell, held, ids, ready = tuple(key[lo]), [], [], None
            if kind[lo] == 0:
                held.append(vectors[lo:hi])
                ids.extend(owners.slice(lo, hi - lo).to_pylist())
                continue
            if not held:
                continue
            if ready is None:
                rows = np.concatenate(held)
                n = np.array([len(x) for x in ids])
                ready = rows, (rows * rows).sum(1), np.repeat(np.arange(len(ids)), n), np.array([i for x in ids for i in x], np.int64), np.concatenate(([0], np.cumsum(n)))
            rows, squares, _, numbers, off = ready
            for q in range(lo, hi):
                places, away = nearest_of(vectors[q], rows, squares, k)
                spans = [numbers[off[p] : off[p + 1]] for p in places.tolist()]
                who, score = np.concatenate(spans), np.repeat(away, [len(s) for s in spans])
                best = np.lexsort((who, score))[:k]
                out.append((q, who[best], score[best]))
        if out:
            at = np.repeat([q for q, _, _ in out], [len(w) for _, w, _ in out])
            yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(at)), batch.column(5).take(pa.array(at)), pa.array(np.concatenate([w for _, w, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))], names=["a", "b", "vec_id", "score"])


def search(df: DataFrame, asks: Column, k: int = 10, tables: int = 4, target: float = 0.95, sample: int = 200, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which `asks` holds, the k rows of least Euclidean distance found, nearest first.

    Every row is indexed, in each of `tables` tables. The number of cells that a question looks into is fitted: `sample` questions (those
    of the smallest hashes) are answered by brute force, and so many cells are taken that `target` of their true neighbours lie in
    them; it may become all cells, never less than that. Cells get one more hash for each factor of 2 x dimension in rows, so that what a
    question looks through grows slower than the rows. Norms play no part in the cells; where they differ much, more cells are needed.

    Equal vectors are one point with its k + 1 smallest ids, and ask once; a cell with more than `block_rows` points is dealt to several
    tasks, which all get its questions. No task holds a cell whole, none sees a pair that isn't measured.

    Ties go to the smaller id. Vectors that are null, empty, zero or hold null, NaN or infinite components take no part, nor do those of
    another length than most, nor rows without an id. Rows equal in id and vector are one row; a row is no neighbour of its own id. An
    id with several vectors asks with each. Fewer than k other rows are all returned if the cells hold them; an empty table has no
    rows. Columns beside those named are left out.
    """
    spark = df.sparkSession
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"  # as they come: half the bytes to exchange
    v = F.col("vector")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(v) & F.exists(v, lambda x: x != 0))
    d = usual_length(rows, "vector")
    schema = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], schema)
    a, b = row_key(v)
    rows = rows.where(F.size("vector") == d).select("*", a.alias("a"), b.alias("b"))

    light = rows.groupBy("a", "b", "vec_id").agg(F.max("asks").alias("asks"))
    low = light.withColumn("nth", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    ids = low.groupBy("a", "b").agg(F.collect_list("vec_id").alias("ids"))
    one = rows.groupBy("a", "b").agg(F.first("vector").alias("vector"), F.max("asks").alias("asks"))
    points = written(one.join(ids, ["a", "b"]), "points")
    asking = written(light.where("asks").select(F.col("vec_id").alias("query_id"), "a", "b"), "asking")

    n = points.count()
    side = Hashes(d, 1, 1).size * 2
    width = 1
    while n >= CELL_ROWS * side ** (width + 1) and side ** (width + 2) < 1 << 62:
        width += 1
    hashes = Hashes(d, tables, width)
    questions = points.where("asks")
    probes = probes_needed(points, hashes, questions.orderBy("a", "b").limit(sample).select("a", "b", "vector").collect(), k, target, side**width if width == 1 else side * side)

    placed = arrow_map(points.select("a", "b", "vector", "ids"), lambda batches: _placed(batches, hashes), f"tab int, cell long, a long, b long, vector {kind}, ids array<long>")
    parts = shuffle_partitions(spark)
    block = max(256, min(block_rows, n * tables // (4 * parts)))  # a task has several blocks, none more than block_rows
    cells = arrow_map(points.select("a", "b", "vector", "ids"), lambda batches: (x.select(["tab", "cell"]) for x in _placed(batches, hashes)), "tab int, cell long")
    large = written(cells.groupBy("tab", "cell").count().where(F.col("count") > block).select("tab", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-cells")
    if large.count() <= 100_000:
        large = F.broadcast(large)
    placed = placed.join(large, ["tab", "cell"], "left").select("tab", "cell", F.coalesce(F.pmod("b", "blocks"), F.lit(0)).cast("int").alias("salt"), F.lit(0).alias("kind"), "a", "b", "vector", "ids")
    probed = arrow_map(questions.select("a", "b", "vector"), lambda batches: _probed(batches, hashes, probes), f"tab int, cells array<long>, a long, b long, vector {kind}")
    probed = probed.withColumn("cell", F.explode("cells")).join(large, ["tab", "cell"], "left")
    probed = probed.select("tab", "cell", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("salt"), F.lit(1).alias("kind"), "a", "b", "vector", F.lit(None).cast("array<long>").alias("ids"))
    sorted_ = placed.union(probed).repartition(parts, "tab", "cell", "salt").sortWithinPartitions("tab", "cell", "salt", "kind")
    found = arrow_map(sorted_, lambda batches: _measured(batches, d, k + 1), _FOUND)

    best = found.repartition(parts, "a", "b").groupBy("a", "b", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("a", "b").orderBy("score", "vec_id")
    best = best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    pairs = asking.join(best, ["a", "b"]).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "a", "b").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
