"""Substring dedup: passages of n words that occur twice or more, found level by level with doubled lengths.

Level 1: k-word windows (k is about n / 4). Of the k-word windows of each n-word window only the one of the least hash is looked up: two
equal n-word windows have it at the same place, so no repeat is lost and an n-th of the windows is exchanged. Level 2: those repeated are
extended to 2k words, leftwards and rightwards; every n-word window around one contains one of the two. Level 3: the n-word windows
around survivors, exactly. A window that is repeated within a task needs no more proof and is sent once, so that the most frequent
passage costs a task no more than a row from each other task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, arrow_map, bucket_of, buckets_for, dealt, mix, row_key, runs, seeds, sliced, texts, written

_PLACE = 28


def lengths(n: int) -> int:
    """k of level 1; n >= 3k - 1, so that each n-word window reaches k words beyond its k-word window on one side."""
    return max(1, min(n // 4 + 1, (n + 1) // 3))


def least(words: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n-word windows begin, and where the k-word window of the least hash in each is (the first of equals)."""
    size = len(words.hash)
    left = np.repeat(words.off[1:], words.n) - np.arange(size)
    at = np.flatnonzero(left >= n)
    if not len(at):
        return at, at
    key = np.full(size, U(2**64 - 1))
    gram, place = words.grams(k)
    key[place] = gram >> U(_PLACE) << U(_PLACE) | place.astype(U)
    span, width = n - k + 1, 1
    low = key
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[at], low[at + span - width])
    return at, (low & U((1 << _PLACE) - 1)).astype(np.int64)


def _again(key: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """Which values (with their checks) occur twice or more."""
    order = np.argsort(key) if check is None else np.lexsort((check, key))
    change = key[order][1:] != key[order][:-1]
    if check is not None:
        change |= check[order][1:] != check[order][:-1]
    cut = np.concatenate(([0], np.flatnonzero(change) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(np.diff(cut) > 1, np.diff(cut))
    return out


def _first(*keys: np.ndarray) -> np.ndarray:
    """A place of each distinct combination."""
    order = np.lexsort(keys)
    change = np.zeros(max(len(order) - 1, 0), bool)
    for k in keys:
        change |= k[order][1:] != k[order][:-1]
    return order[np.concatenate(([True], change))] if len(order) else order


def _local(rows: list, make, keys: list, buckets: int):
    """Sends what a task has gathered: a row for each bucket, and rows marked as known for what is repeated here already.

    keys: pairs of row hashes of the texts that `rows` numbers. A row of a bucket holds the keys of its texts once, and each window's
    number among them.
    """
    if not rows:
        return
    key = np.array(keys, np.int64).reshape(-1, 2)
    doc, place, flags, more = make(rows)
    known = np.flatnonzero(flags)
    sent = _places(key, doc[known], (place[known].astype(np.uint32) << np.uint32(2)) | flags[known].astype(np.uint32), buckets)
    nothing = pa.array([b""] * sent.num_rows, pa.binary())
    yield pa.RecordBatch.from_arrays([*sent.columns, *[nothing] * (len(more) + 1), pa.array([True] * sent.num_rows, pa.bool_())], names=["bucket", "row", "place", *more, "at", "known"])
    some = _first(*more.values())
    bucket = bucket_of(more["hash"][some], buckets)
    order = np.argsort(bucket, kind="stable")
    some, bucket = some[order], bucket[order]
    cut = runs(bucket)
    cols: list[list] = [[] for _ in range(4 + len(more))]
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        here = some[i:j]
        used, at = np.unique(doc[here], return_inverse=True)
        values = (int(bucket[i]), key[used].tobytes(), place[here].astype(np.uint32).tobytes(), *[m[here].tobytes() for m in more.values()], at.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes())
        for c, v in zip(cols, values, strict=True):
            c.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]], pa.array([False] * len(cols[0]), pa.bool_())], names=["bucket", "row", "place", *more, "at", "known"])


def _sides(hash_: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """1 for windows repeated with what is left of them, 2 for those repeated with what is right of them."""
    out = np.zeros(len(hash_), np.uint8)
    some = np.flatnonzero(_again(hash_))
    for bit, side in ((1, left), (2, right)):
        out[some] |= (_again(mix(hash_[some] ^ mix(side[some].astype(U) + U(bit << 40)))) * bit).astype(np.uint8)
    return out


def _send_short(batches, n: int, k: int, buckets: int, most: int):
    """Levels 1 and 2, a task's side."""

    def make(rows):
        hash_, left, right, doc, place = (np.concatenate(c) for c in zip(*rows, strict=True))
        return doc, place, _sides(hash_, left, right), {"hash": hash_, "left": left, "right": right}

    rows, keys, held = [], [], 0
    for batch in batches:
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for some, raws in sliced(names, [r or b"" for r in batch.column(2).to_pylist()]):
            words = Words(raws)
            _, q = least(words, n, k)
            q = np.unique(q)
            if not len(q):
                continue
            doc = words.doc()[q]
            short = np.zeros(len(words.hash), U)
            gram, at = words.grams(k)
            short[at] = gram
            if 2 * k <= n:
                double = mix(np.arange(len(words.hash), dtype=U) ^ seeds(1, 11)[0])  # where there is no such window, a value of no other
                gram, at = words.grams(2 * k)
                double[at] = gram
                before = q - k >= words.off[doc]
                left = np.where(before, double[np.maximum(q - k, 0)], mix(q.astype(U))).astype(np.uint32)
                right = double[q].astype(np.uint32)
            else:
                left = right = np.zeros(len(q), np.uint32)
            rows.append((short[q], left, right, doc + len(keys), q - words.off[doc]))
            keys += some
            held += len(q)
            if held > most:
                yield from _local(rows, make, keys, buckets)
                rows, keys, held = [], [], 0
    yield from _local(rows, make, keys, buckets)


def _send_long(batches, n: int, k: int, buckets: int, most: int):
    """Level 3, a task's side: (row, row2, raw, survivors) in. Windows are compared by 128 bits."""

    def make(rows):
        hash_, check, doc, place = (np.concatenate(c) for c in zip(*rows, strict=True))
        return doc, place, _again(hash_, check).astype(np.uint8), {"hash": hash_, "check": check}

    rows, keys, held = [], [], 0
    for batch in batches:
        survivors = batch.column(3).to_pylist()
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for some, raws in sliced(list(range(batch.num_rows)), _expand(batch.column(2))):
            words = Words(raws)
            at, q = least(words, n, k)
            flag = np.zeros(len(words.hash), np.uint8)
            for j, number in enumerate(some):
                value = np.frombuffer(survivors[number], np.uint32)
                place = words.off[j] + (value >> np.uint32(2)).astype(np.int64)
                np.bitwise_or.at(flag, place, (value & np.uint32(3)).astype(np.uint8))
            offset = q - at
            take = (flag[q] & 1 > 0) & (offset >= k) | (flag[q] & 2 > 0) & (offset <= n - 2 * k)
            if 2 * k > n:
                take = flag[q] > 0
            p = at[take]
            if not len(p):
                continue
            full = []
            for w in (words, Words(raws, check=1)):
                gram, where = w.grams(n)
                hash_ = np.zeros(len(w.hash), U)
                hash_[where] = gram
                full.append(hash_[p])
            doc = words.doc()[p]
            rows.append((*full, doc + len(keys), p - words.off[doc]))
            keys += [names[k] for k in some]
            held += len(p)
            if held > most:
                yield from _local(rows, make, keys, buckets)
                rows, keys, held = [], [], 0
    yield from _local(rows, make, keys, buckets)


def _meet(batches, kinds: dict[str, type], buckets: int):
    """A bucket: which of its windows are repeated; their places out."""
    keys, docs, size = [], [], 0
    parts: dict[str, list[np.ndarray]] = {k: [] for k in (*kinds, "place")}
    for batch in batches:
        known = np.array(batch.column("known").to_pylist(), bool)
        yield batch.filter(pa.array(known)).select(["bucket", "row", "place"])
        rest = batch.filter(pa.array(~known))
        for k in range(rest.num_rows):
            key, at = np.frombuffer(rest.column("row")[k].as_py(), np.int64).reshape(-1, 2), rest.column("at")[k].as_py()
            for c, kind in (*kinds.items(), ("place", np.uint32)):
                parts[c].append(np.frombuffer(rest.column(c)[k].as_py(), kind))
            docs.append(np.frombuffer(at, np.uint16 if len(at) == 2 * len(parts["place"][-1]) else np.uint32).astype(np.int64) + size)
            keys.append(key)
            size += len(key)
    if not docs:
        return
    x = {c: np.concatenate(v) for c, v in parts.items()}
    flags = _sides(x["hash"], x["left"], x["right"]) if "left" in x else _again(x["hash"], x["check"]).astype(np.uint8)
    some = np.flatnonzero(flags)
    yield _places(np.concatenate(keys), np.concatenate(docs)[some], (x["place"][some] << np.uint32(2)) | flags[some].astype(np.uint32), buckets)


def _places(key: np.ndarray, doc: np.ndarray, value: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places by the bucket of their text: (bucket, keys of texts and numbers of places, the places). doc numbers the rows of key."""
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    cut = runs(doc)
    docs, count = doc[cut[:-1]], np.diff(cut)
    bucket = bucket_of(mix(key[docs, 0].astype(U)), buckets)
    order = np.argsort(bucket, kind="stable")
    edge = runs(bucket[order])
    cols: list[list] = [[], [], []]
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        mine = order[i:j]
        cols[0].append(int(bucket[mine[0]]))
        cols[1].append(np.concatenate((key[docs[mine]], count[mine, None]), 1).astype(np.int64).tobytes())
        cols[2].append(b"".join([value[cut[k] : cut[k + 1]].tobytes() for k in mine.tolist()]))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "row", "place"])


def _gathered(batches):
    """A bucket's texts, each with all its places."""
    heads, values = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.uint32)]
    for batch in batches:
        for head, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            heads.append(np.frombuffer(head, np.int64).reshape(-1, 3))
            values.append(np.frombuffer(body, np.uint32))
    head, value = np.concatenate(heads), np.concatenate(values)
    end = np.cumsum(head[:, 2])
    order = np.lexsort((head[:, 1], head[:, 0]))
    head, begin, end = head[order], (end - head[:, 2])[order].tolist(), end[order].tolist()
    cut = np.concatenate(([0], np.flatnonzero((head[1:, :2] != head[:-1, :2]).any(1)) + 1, [len(head)])).tolist() if len(head) else [0]
    for at in range(0, len(cut) - 1, 5000):
        some = list(zip(cut[at : at + 5000], cut[at + 1 : at + 5001]))
        blobs = [b"".join([value[begin[k] : end[k]].tobytes() for k in range(i, j)]) for i, j in some]
        first = [i for i, _ in some]
        yield pa.RecordBatch.from_arrays([pa.array(head[first, 0]), pa.array(head[first, 1]), pa.array(blobs, pa.binary())], names=["row", "row2", "places"])


def _kept(raw: bytes, places: bytes | None, n: int, digests: bool) -> tuple:
    words = raw.split()
    if not places:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest() if digests else raw.decode()
    step = np.zeros(len(words) + 1, np.int32)
    p = np.unique(np.frombuffer(places, np.uint32) >> np.uint32(2)).astype(np.int64)
    np.add.at(step, p, 1)
    np.add.at(step, p + n, -1)
    keep = np.cumsum(step[:-1]) == 0
    kept = b" ".join([w for w, good in zip(words, keep.tolist(), strict=True) if good])
    return len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest() if digests else kept.decode()


@functools.cache
def _zstd():
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _squeeze(batches, at: int):
    """Texts compressed one by one: the joins exchange each of them."""
    for batch in batches:
        made = pa.array([None if r is None else _zstd()[0].compress(r) for r in batch.column(at).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], made, *batch.columns[at + 1 :]], names=batch.schema.names)


def _expand(column: pa.Array) -> list[bytes]:
    return [b"" if z is None else _zstd()[1].decompress(z) for z in column.to_pylist()]


def _remove(batches, n: int, digests: bool):
    """(doc_id, raw, places[, carried])"""
    for batch in batches:
        places = batch.column(2).to_pylist()
        for some, raws in sliced(list(range(batch.num_rows)), _expand(batch.column(1))):
            n_words, removed, last = zip(*[_kept(raw, places[k], n, digests) for k, raw in zip(some, raws, strict=True)], strict=True)
            held = [batch.column(k).take(pa.array(some)) for k in (0, *range(3, batch.num_columns))]
            cols = [held[0], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(last, pa.string()), *held[1:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256" if digests else "kept", "carried"][: len(cols)])


def remove_repeats(df: DataFrame, n: int = 35, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, carry: Sequence[str] = (), held: int = 500_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept[, carried]), or kept_sha256 instead of kept with digests; a row for each row of df.

    Every word goes that is covered by a window of n words whose sequence also starts anywhere else, in the same text or another; all
    occurrences go. kept is the text itself where nothing went, else the rest joined by single spaces; kept_sha256 is always of the words
    left, joined by single spaces; carried holds the columns named in carry, as they are. Null texts count as empty and stay empty;
    repeated rows repeat each other's windows; other columns are left out; an empty table stays empty. Whole texts are taken, however
    long. Windows are compared by two independent 64-bit hashes. A task sends on its windows when it holds `held` of them; a bucket is of
    about 64 MB of text.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    row, row2 = row_key(F.col("doc_id"), F.col("raw"))
    docs = texts(df, id_col, text_col, *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else [])).withColumn("row", row).withColumn("row2", row2)
    k, buckets = lengths(n), buckets_for(spark, docs)
    body = "bucket int, row binary, place binary, hash binary, {} at binary, known boolean"
    met = "bucket int, row binary, place binary"
    short = arrow_map(docs.select("row", "row2", "raw"), lambda b: _send_short(b, n, k, buckets, held), body.format("left binary, right binary,"))
    survivors = written(arrow_map(dealt(short, buckets), lambda b: _meet(b, {"hash": U, "left": np.uint32, "right": np.uint32}, buckets), met), "repeats-short")
    together = arrow_map(dealt(survivors, buckets), _gathered, "row long, row2 long, places binary")
    docs = arrow_map(docs, lambda b: _squeeze(b, 1), ", ".join(f"{c} {t}" for c, t in docs.dtypes))
    long = arrow_map(docs.select("row", "row2", "raw").join(together, ["row", "row2"]), lambda b: _send_long(b, n, k, buckets, held), body.format("check binary,"))
    found = written(arrow_map(dealt(long, buckets), lambda b: _meet(b, {"hash": U, "check": U}, buckets), met), "repeats-long")
    places = arrow_map(dealt(found, buckets), _gathered, "row long, row2 long, places binary")
    joined = docs.join(places, ["row", "row2"], "left").select("doc_id", "raw", "places", *(["carried"] if carry else []))
    return arrow_map(joined, lambda b: _remove(b, n, digests), f"doc_id {kind}, n_words long, n_removed long, " + ("kept_sha256 string" if digests else "kept string") + (f", carried {dict(docs.dtypes)['carried']}" if carry else ""))
