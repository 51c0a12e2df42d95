"""What the text operators share: work folders, word hashing in numpy, buckets for packed shuffles."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed together; bounds the memory of a worker.
SLICE_BYTES = 3 << 20
BLOCK_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where it is unset and the master is local, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: tables between stages need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tephra-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/tephra/{tag}-{uuid.uuid4().hex}"
    WORK.append(path)
    return path


#: Work tables and files of this driver; results are read from them, so they stay until remove_work.
WORK: list[str] = []


def remove_work(spark: SparkSession) -> None:
    """Delete the work tables of this driver, when its results are written or no longer needed."""
    while WORK:
        path = spark._jvm.org.apache.hadoop.fs.Path(WORK.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, raw, ...): the text as UTF-8 bytes, so that workers get it undecoded; other columns are left out."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"), *more)


def row_key(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that tell a row apart by these columns: 128 bits together."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


#: What this worker keeps beside a task's own data; each is called at the end of a partition, and lets go what that partition didn't use.
AT_END: list[Callable[[], None]] = []


@functools.cache
def _trim() -> Callable:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: None


def release() -> None:
    """Caches and freed memory go back, so that a worker that serves many tasks holds no more than one that serves its first."""
    for forget in AT_END:
        forget()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; at the end of a partition its worker gives its memory back."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def sliced(ids: list, raws: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of rows of about SLICE_BYTES of text."""
    at, size = 0, 0
    for k, raw in enumerate(raws):
        size += len(raw)
        if size >= SLICE_BYTES:
            yield ids[at : k + 1], raws[at : k + 1]
            at, size = k + 1, 0
    if at < len(raws):
        yield ids[at:], raws[at:]


# --- hashing -----------------------------------------------------------------------------------

U = np.uint64
_SHIFT = (U(30), U(27), U(31))
_MULTIPLY = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves all output bits (splitmix64's finaliser)."""
    x = (x ^ (x >> _SHIFT[0])) * _MULTIPLY[0]
    x = (x ^ (x >> _SHIFT[1])) * _MULTIPLY[1]
    return x ^ (x >> _SHIFT[2])


def seeds(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1_000_003)) * U(GOLDEN))


_BYTE = [seeds(256, 1), seeds(256, 2)]
_LOWERED = [np.array([t[b + 32] if 65 <= b <= 90 else t[b] for b in range(256)], dtype=U) for t in _BYTE]
_IS_WORD = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_P = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            table = np.full(n, base & (2**64 - 1), dtype=U)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=U)
    return _powers


class Words:
    """The words ([^\\x20\\x09-\\x0D]+) of some texts.

    hash: 64 bits a word (a polynomial over per-byte random values, mixed; check=1 takes other values, so that both together are 128
    bits); off: where each text's words begin; start, end: byte places in buf, which holds the texts joined by newlines.
    """

    def __init__(self, raws: list[bytes], lower: bool = False, check: int = 0):
        self.buf = b"\n".join(raws)
        whole = np.frombuffer(self.buf, np.uint8)
        table = (_LOWERED if lower else _BYTE)[check]
        hashes, starts, ends = [], [], []
        at = 0
        while at < len(whole):
            to = min(len(whole), at + BLOCK_BYTES)
            while to < len(whole) and _IS_WORD[whole[to - 1]] and _IS_WORD[whole[to]]:
                gap = np.flatnonzero(~_IS_WORD[whole[to : to + BLOCK_BYTES]])
                to = min(len(whole), to + (int(gap[0]) if len(gap) else BLOCK_BYTES))
            part = whole[at:to]
            inside = np.zeros(len(part) + 2, np.int8)
            inside[1:-1] = _IS_WORD[part]
            step = np.diff(inside)
            s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            up, down = _power_tables(len(part) + 1)
            total = np.zeros(len(part) + 1, U)
            np.cumsum(table[part] * up[: len(part)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(GOLDEN)))
            starts.append(s + at)
            ends.append(e + at)
            at = to
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        begins = np.zeros(len(raws) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raws], out=begins[1:])
        self.off = np.searchsorted(self.start, begins).astype(np.int64)
        self.n = np.diff(self.off)

    def word(self, k: int) -> bytes:
        return self.buf[self.start[k] : self.end[k]]

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n consecutive words of one text, and the place of the first word of each."""
        size = len(self.hash)
        if size < n:
            return np.zeros(0, U), np.zeros(0, np.int64)
        odd = seeds(n, 7) | U(1)
        out = self.hash[: size - n + 1] * odd[0]
        for k in range(1, n):
            out += self.hash[k : size - n + 1 + k] * odd[k]
        left = np.repeat(self.off[1:], self.n) - np.arange(size)
        at = np.flatnonzero(left[: size - n + 1] >= n)
        return mix(out[at]), at


def runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in a sorted array, and its length at the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


# --- files in the shared folder ----------------------------------------------------------------


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, write: Callable) -> None:
    """write(stream) into uri, which appears only when whole: a task that is lost or runs twice leaves no part of a file."""
    import os

    temp = f"{uri}.{uuid.uuid4().hex}.tmp"
    if (path := _local(temp)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            write(out)
        os.replace(path, _local(uri))
    else:
        store, path = _store(temp)
        with store.open_output_stream(path) as out:
            write(out)
        store.move(path, _store(uri)[1])


def open_file(uri: str):
    """uri as a file that can be read and sought."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    store, path = _store(uri)
    return store.open_input_file(path)


def list_files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files in a folder, or of the one file, by name."""
    from pyarrow import fs

    local = _local(uri)
    store, path = (fs.LocalFileSystem(), local) if local is not None else _store(uri)
    info = store.get_file_info(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    head = "file://" if local is not None else uri[: uri.index("://") + 3] + (uri.split("://", 1)[1].split("/", 1)[0] if not uri.startswith("file") else "")
    return sorted((head + x.path if local is not None else f"{head}/{x.path.lstrip('/')}", x.size) for x in found if x.is_file and x.path.endswith(suffix))


# --- packed shuffles ---------------------------------------------------------------------------


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by the upper half of a 64-bit hash."""
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int32)


def packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket: its number, and its part of every column as raw bytes."""
    order = np.argsort(bucket, kind="stable")
    cut = runs(bucket[order])
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if len(order) else []
    data = {"bucket": pa.array(bucket[order[cut[:-1]]] if spans else [], pa.int32())}
    for name, column in columns.items():
        column = column[order]
        data[name] = pa.array([column[a:b].tobytes() for a, b in spans], pa.binary())
    return pa.RecordBatch.from_pydict(data)


def unpacked(batches: Iterable[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """The columns of packed rows, each put together again."""
    parts: dict[str, list[bytes]] = {k: [] for k in kinds}
    for batch in batches:
        for k in kinds:
            parts[k].extend(batch.column(k).to_pylist())
    return {k: np.frombuffer(b"".join(v), kinds[k]) for k, v in parts.items()}


def buckets_for(spark: SparkSession, docs: DataFrame, column: str = "raw", each: int = 64 << 20) -> int:
    """Buckets of about `each` bytes of text, at least as many as there are shuffle partitions: what one holds doesn't grow with the input."""
    size = docs.agg(F.sum(F.octet_length(column))).head()[0] or 0
    return max(shuffle_partitions(spark), -(-size // each))


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    """Every bucket in a task of its own."""
    return df.repartitionById(buckets, F.col("bucket"))
