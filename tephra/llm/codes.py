"""Vector codes: a product quantiser in whole numbers whose sums are kept up to date by the parts that moved (delta-maintained Lloyd)."""

from __future__ import annotations

import uuid
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shuffle_partitions, work_path, written

#: Vectors of a block: a block is one row of the work tables, and what a worker holds at a time.
BLOCK = 2048


def finite(vector: Column) -> Column:
    """Neither null, empty, nor with null, NaN or infinite components."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def usual_length(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have (of equally frequent ones the largest); 0 without vectors."""
    found = vectors.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    return found.n if found else 0


class Codebooks:
    """Whole-numbered entries [part][entry][position]; bounds cut a vector into parts."""

    def __init__(self, books: list[np.ndarray], bounds: list[int]):
        self.books, self.bounds = books, bounds

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector and part: the nearest entry (ties to the lower), and the squared distance."""
        codes = np.empty((len(vectors), len(self.books)), np.uint16)
        errors = np.empty((len(vectors), len(self.books)), np.int64)
        for p, book in enumerate(self.books):
            part = vectors[:, self.bounds[p] : self.bounds[p + 1]]
            top = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
            kind = np.float64 if 4 * part.shape[1] * top * top < 1 << 53 else np.int64  # both exact
            x, c = part.astype(kind), book.astype(kind)
            away = (c * c).sum(1) - 2 * (x @ c.T)
            codes[:, p] = away.argmin(1)
            errors[:, p] = away[np.arange(len(x)), codes[:, p]] + (x * x).sum(1)
        return codes, errors

    def text(self) -> str:
        return ",".join(",".join(map(str, book.ravel().tolist())) for book in self.books)


def _whole(values: np.ndarray, scale: int, most: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int32)


def _blocks(batches, d: int, scale: int, most: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            data = _whole(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), scale, most)
            one = pa.array([0, part.num_rows], pa.int32())
            cols = [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.ListArray.from_arrays(one, part.column(0)), pa.ListArray.from_arrays(one, part.column(1)), pa.array([data.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "ids", "labels", "data"])


_ROUND = "kind int, block long, codes binary, part int, entry int, moved array<long>"


def _round(batches, books: Codebooks):
    """Each block's new codes; at the end a row for each entry that parts of this task joined or left: the change of its count and sums."""
    d, parts, size = books.bounds[-1], len(books.books), len(books.books[0])
    change = [np.zeros((size, books.bounds[p + 1] - books.bounds[p] + 1), np.int64) for p in range(parts)]
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("codes", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("moved", pa.list_(pa.int64()))])
    for batch in batches:
        for block, data, before in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            vectors = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, d)
            now, _ = books.nearest(vectors)
            was = np.frombuffer(before, "<u2").reshape(-1, parts) if before is not None else None
            for p in range(parts):
                rows = np.arange(len(now)) if was is None else np.flatnonzero(now[:, p] != was[:, p])
                part = np.ones((len(rows), change[p].shape[1]), np.int64)
                part[:, 1:] = vectors[rows, books.bounds[p] : books.bounds[p + 1]]
                np.add.at(change[p], now[rows, p], part)
                if was is not None:
                    np.subtract.at(change[p], was[rows, p], part)
            yield pa.RecordBatch.from_pylist([{"kind": 0, "block": block, "codes": now.astype("<u2").tobytes()}], schema)
    rows = [{"kind": 1, "part": p, "entry": int(e), "moved": change[p][e].tolist()} for p in range(parts) for e in np.flatnonzero(change[p].any(1))]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _coded(batches, books: Codebooks, names: list[str]):
    d = books.bounds[-1]
    for batch in batches:
        for k in range(batch.num_rows):
            vectors = np.frombuffer(batch.column(2)[k].as_buffer(), "<i4").reshape(-1, d)
            codes, errors = books.nearest(vectors)
            digits = codes.astype(np.uint8).tobytes().hex()
            step = 2 * codes.shape[1]
            cols = [batch.column(0)[k].values, batch.column(1)[k].values, pa.array([digits[a : a + step] for a in range(0, len(digits), step)], pa.string()), pa.array(errors.sum(1), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def compress(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error) of every kept vector, the codebooks).

    Components become floor(scale * x). A part position's codebook starts as the parts of the `entries` smallest ids (null ids last, equal
    ids by vector); each round assigns all parts to the nearest entry and moves the entries to floor(sum / count); entries without parts
    stay. code: two hex digits a part.

    The vectors are written in blocks, and bucketed by block. A round reads them beside the codes of the round before, bucketed alike,
    so that no vector is exchanged, and writes the new codes and, a row for each task and entry, the counts and sums of the parts that
    moved; only these are shuffled and added to the running totals, which are a table, too. What the driver sees is as large as the
    codebooks.

    Vectors that are null, empty or hold null, NaN or infinite components are left out, and so are those of another length than most
    (of two equally frequent lengths the longer counts). A length that `parts` doesn't divide is cut as evenly as whole numbers allow.
    Components so large that squared distances would not fit a long are cut to where they do (2^27 / scale for 64 components). Rows with
    equal ids, null ids and equal rows are all coded; fewer vectors than entries make smaller codebooks; without vectors there are no rows
    and no codebooks. Columns beside those named are left out.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    kept = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vector")).where(finite(F.col("vector")))
    schema = f"vec_id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"
    d = usual_length(kept, "vector")
    if not d:
        return spark.createDataFrame([], schema), None
    kept = kept.where(F.size("vector") == d)
    bounds = [p * d // parts for p in range(parts + 1)]
    most = isqrt((1 << 62) // d) // 2
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = _whole(np.array([r.vector for r in first]), scale, most).astype(np.int64)
    books = Codebooks([start[:, a:b] for a, b in zip(bounds, bounds[1:])], bounds)

    path, name = work_path(spark, "vectors"), f"tephra_{uuid.uuid4().hex}"
    n = shuffle_partitions(spark)
    # written before they are exchanged: a task that runs again would cut and name its blocks otherwise
    blocks = written(arrow_map(kept, lambda batches: _blocks(batches, d, scale, most), f"block long, ids array<{kinds[id_col]}>, labels array<{kinds[label_col]}>, data binary"), "blocks")
    blocks.repartition(n, "block").write.bucketBy(n, "block").option("path", path).saveAsTable(f"{name}_v")
    vectors = spark.table(f"{name}_v")
    totals = None
    before = None
    for r in range(rounds):
        held = vectors.select("block", "data")
        held = held.withColumn("codes", F.lit(None).cast("binary")) if before is None else held.join(before.hint("merge"), "block", "left")
        done = arrow_map(held, lambda batches, books=books: _round(batches, books), _ROUND)
        done.write.partitionBy("kind").bucketBy(n, "block").option("path", work_path(spark, "codes")).saveAsTable(f"{name}_{r}")
        state = spark.table(f"{name}_{r}")
        before = state.where("kind = 0").select("block", "codes")
        moved = state.where("kind = 1").select("part", "entry", F.posexplode("moved").alias("place", "value"))
        totals = written((moved if totals is None else totals.union(moved)).groupBy("part", "entry", "place").agg(F.sum("value").alias("value")), "totals")
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books.books]
        for part, entry, place, value in totals.collect():
            sums[part][entry, place] = value
        books = Codebooks([np.where(s[:, :1] > 0, s[:, 1:] // np.maximum(s[:, :1], 1), b) for s, b in zip(sums, books.books, strict=True)], bounds)
    for k in ("v", *range(rounds)):  # the names alone: the files go with remove_work
        spark.sql(f"drop table {name}_{k}")
    whole = spark.read.parquet(path).select("ids", "labels", "data")
    return arrow_map(whole, lambda batches: _coded(batches, books, ["vec_id", "label", "code", "error"]), schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error beside each row: the errors of all rows of its label, nulls together."""
    coded = written(coded, "coded")
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    side = sums.withColumnRenamed("label", "of")
    if sums.count() <= 100_000:
        side = F.broadcast(side)
    return coded.join(side, F.col("label").eqNullSafe(F.col("of"))).drop("of")
