"""Exact Jaccard links between documents' shingle sets, by a partition of the token universe.

Equal sets are one class; what follows works on classes. The universe of shingle hashes is cut into segments, as many as suit a band of
set sizes. Two sets r and t of Jaccard similarity s differ in (1 - s) / (1 + s) * (|r| + |t|) shingles at most; H is the most of it for
r and any t. A set is looked up by whole segments and by segments with their one-deletion neighbourhoods, allotted by cost so that they
cover H + 1 differences (see _allotted): segments that many sets share are left out wherever others are enough. Sets of at most SMALL
shingles are one segment, indexed with its one-deletion neighbourhood (and the two-deletion one where sizes differ by two).

Segments that very many sets index anyway lead to stars instead of pairs: each set meets the segment's leader only. Sets that a star
leaves outside the segment's main component are compared, in blocks, with all sets of such segments, by an inverted index. Every
candidate is verified on the whole sets; candidates whose parity sketches differ in more places than linked sets can are left out before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, Words, arrow_map, bucket_of, buckets_for, dealt, list_files, mix, open_file, packed, row_key, runs, seeds, sliced, texts, unpacked, work_path, written
from .components import components

TOKEN = U(2**56 - 1)
SIG = U(2**55 - 1)
SMALL = 8
#: About so many frequent signatures are told to the workers at most (24 bytes each).
MOST_FREQUENT = 500_000
BLOCK = 2000
SALTS = 32


@dataclass(frozen=True)
class Similarity:
    """At least num / den shared shingles of the union, with shingles of `words` words.

    The rest changes the work, not the result: from `frequent` sets on a segment is frequent; a bucket's group of over `group` sets that
    share a segment is a star too; a task sends on what it holds at `held` signatures.
    """

    num: int = 3
    den: int = 4
    words: int = 5
    frequent: int = 10
    group: int = 200
    held: int = 500_000


class Sets:
    """The shingle sets of some texts: sorted distinct 56-bit hashes; off says where each set begins."""

    def __init__(self, raws: list[bytes], size: int):
        words = Words(raws, lower=True)
        doc = words.doc()
        gram, at = words.grams(size)
        hashes, owner = [gram], [doc[at]]
        for n in range(1, size):  # shorter texts are one shingle
            short = np.flatnonzero(words.n == n)
            if len(short):
                value = np.zeros(len(short), U)
                for k, odd in enumerate(seeds(n, 40 + n) | U(1)):
                    value += words.hash[words.off[short] + k] * odd
                hashes.append(mix(value))
                owner.append(short)
        hash_, owner = np.concatenate(hashes) >> U(8), np.concatenate(owner)
        parts, counts = [], np.zeros(len(raws), np.int64)
        for lo in range(0, len(raws), 256):
            some = (owner >= lo) & (owner < lo + 256) if len(raws) > 256 else slice(None)
            key = np.unique((owner[some] - lo).astype(U) << U(56) | hash_[some])
            counts[lo : lo + 256] = np.bincount((key >> U(56)).astype(np.int64), minlength=min(256, len(raws) - lo))
            parts.append(key & TOKEN)
        self.token = np.concatenate(parts) if parts else np.zeros(0, U)
        self.n = counts
        self.off = np.concatenate(([0], np.cumsum(counts)))
        total = np.concatenate(([U(0)], np.cumsum(mix(self.token + U(1)), dtype=U)))
        self.cls = mix(total[self.off[1:]] - total[self.off[:-1]] + counts.astype(U)).astype(np.int64)

    def of(self, k: int) -> np.ndarray:
        return self.token[self.off[k] : self.off[k + 1]]


def _band(n: np.ndarray) -> np.ndarray:
    """Sizes over SMALL fall into bands (8, 16], (16, 32], ..."""
    return np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64)


def _deletions(token: np.ndarray, tag: int, depth: int) -> np.ndarray:
    """Signatures of a small set, of the set without any one token and, at depth 2, without any two."""
    m = mix(token + U(tag << 57))
    whole = m.sum(dtype=U)
    out = [np.array([whole]), whole - m]
    if depth > 1 and len(m) > 2:
        a, b = np.triu_indices(len(m), 1)
        out.append(whole - m[a] - m[b])
    return mix(np.concatenate(out)) & SIG


def _segments(sets: Sets, band: np.ndarray, use: np.ndarray):
    """The segments of some sets in a band: (signature, set, size), and of segments of several tokens each one-deletion signature with the
    segment's number. The band cuts the universe into 2^band segments (four times as many for small bands), so that a set has many more
    non-empty ones than linked sets can differ in."""
    owner = np.repeat(np.arange(len(sets.n)), sets.n)
    pick = np.flatnonzero(use[owner])
    token, o = sets.token[pick], owner[pick]
    parts = np.where(band <= 6, 4 << band, 1 << band)[o].astype(U)
    part = (token >> U(24)) * parts >> U(32)
    cut = runs(o.astype(U) << U(32) | part)
    first = cut[:-1]
    mixed = mix(token + U(77))
    value = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, U)
    place = mix(part[first] + (band[o[first]].astype(U) << U(40)))
    size = np.diff(cut)
    of = np.repeat(np.arange(len(first)), size)
    several = np.flatnonzero(size[of] > 1)
    fewer = mix(value[of[several]] - mixed[several] + place[of[several]]) & SIG
    return mix(value + place) & SIG, o[first], size, fewer, of[several]


def _allotted(sig, doc, size, fewer, of, apart: np.ndarray, frequent: np.ndarray):
    """What each set indexes of its segments, (signature, set, whether it is frequent): the cheapest of three ways that cover H + 1 differences.

    A segment looked up whole covers one difference, with its one-deletion neighbourhood two, left out none. (1) H + 1 whole segments that
    aren't frequent, the first in one global order. (2) All segments that aren't frequent, with their neighbourhoods; those of which
    nothing is frequent count twice. (3) The frequent segments as well, as members of stars.

    A set of way 1 meets any other in the least segment that both have unchanged: it is among the first H + 1 of the one and at least among
    all of the other. A set of way 2 or 3 has a segment that differs by at most one token less than it is counted for, and the other set,
    of way 2 or 3 too, has that signature: were its segment frequent with the token more, so would be all its deletions, and with them the
    segment here.
    """
    hot, hot_fewer = np.isin(sig, frequent), np.isin(fewer, frequent)
    m = len(apart)
    spoilt = np.bincount(of[hot_fewer], minlength=len(sig)).astype(bool)
    cold = np.bincount(doc[~hot], minlength=m)
    covered = cold + np.bincount(doc[(size > 1) & ~hot & ~spoilt], minlength=m)
    way = np.where(cold > apart, 1, np.where(covered > apart, 2, 3))
    order = np.lexsort((sig, hot, doc))
    begin = runs(doc[order])
    rank = np.empty(len(sig), np.int64)
    rank[order] = np.arange(len(sig)) - np.repeat(begin[:-1], np.diff(begin))
    whole = np.flatnonzero(np.where(way[doc] == 1, rank <= apart[doc], ~hot | (way[doc] == 3)))
    part = np.flatnonzero((way[doc[of]] > 1) & ~hot[of] & ~hot_fewer)
    return np.concatenate((sig[whole], fewer[part])), np.concatenate((doc[whole], doc[of[part]])), np.concatenate((hot[whole], np.zeros(len(part), bool)))


def signatures(sets: Sets, num: int, den: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, whether it is frequent) of what each set indexes; with frequent None, of all it could index."""
    n = sets.n
    if not len(sets.token):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)
    reach = np.floor(n * den / num + 1e-9).astype(np.int64)  # the largest set that n can link with
    least = -(-n * num // den)
    apart = ((den - num) * (n + reach)) // (den + num)  # H
    largest = SMALL * den // num
    sig, doc = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero((n > 0) & (least <= SMALL)).tolist():
        if n[k] <= largest:
            found = np.unique(_deletions(sets.of(k), 1, 2 if apart[k] > 1 else 1)) if apart[k] else _deletions(sets.of(k), 1, 0)[:1]
            sig.append(found)
            doc.append(np.full(len(found), k))
    hot = [np.isin(np.concatenate(sig), frequent if frequent is not None else [])]
    own = np.maximum(_band(n), 4)
    for lower in (0, 1):  # the band of its size, and the one below for smaller partners
        use = (n > SMALL) & (not lower or (least <= 1 << np.maximum(own - 1, 0)) & (own > 4))
        if not use.any():
            continue
        found, of, size, fewer, seg = _segments(sets, own - lower, use)
        if frequent is None:
            found, of = np.concatenate((found, fewer)), np.concatenate((of, of[seg]))
            hot.append(np.zeros(len(found), bool))
        else:
            found, of, h = _allotted(found, of, size, fewer, seg, apart, frequent)
            hot.append(h)
        sig.append(found)
        doc.append(of)
    return np.concatenate(sig), np.concatenate(doc), np.concatenate(hot)


# --- passes over the texts ---------------------------------------------------------------------


def _classes(batches, size: int):
    for batch in batches:
        for some, part in sliced(list(range(batch.num_rows)), [r or b"" for r in batch.column(3).to_pylist()]):
            sets = Sets(part, size)
            held = [batch.column(k).take(pa.array(some)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(sets.n), pa.array(sets.cls, mask=sets.n == 0)], names=["doc_id", "row", "row2", "n", "cls"])


def _counted(batches, s: Similarity):
    """Signatures that two sets or more of a task could index: how many, and the set among them with the most copies."""
    held: list[tuple] = []
    size = 0

    def tell():
        sig, cls, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((cls, sig))
        sig, cls, n = sig[order], cls[order], n[order]
        cut = runs(mix(sig) ^ cls.astype(U))
        copies, sig, cls, n = np.diff(cut), sig[cut[:-1]], cls[cut[:-1]], n[cut[:-1]]
        cut = runs(sig)
        count = np.diff(cut)
        group = np.flatnonzero(count > 1)
        inside = np.repeat(count > 1, count)
        sig, cls, n, copies = sig[inside], cls[inside], n[inside], copies[inside]
        best = np.lexsort((cls, -copies, sig))
        cut = runs(sig)
        lead = best[cut[:-1]] if len(sig) else best
        yield pa.RecordBatch.from_pydict({"sig": sig[lead].astype(np.int64), "sets": count[group], "copies": copies[lead], "lead": cls[lead], "lead_n": n[lead]})

    for batch in batches:
        for _, raws in sliced([None] * batch.num_rows, [r or b"" for r in batch.column(0).to_pylist()]):
            sets = Sets(raws, s.words)
            sig, doc, _ = signatures(sets, s.num, s.den, None)
            held.append((sig, sets.cls[doc], sets.n[doc]))
            size += len(sig)
            if size > s.held:
                yield from tell()
                held, size = [], 0
    if held:
        yield from tell()


_COLUMNS = "bucket int, sig binary, node binary, n binary, at binary, kind int"


def _block(bucket, kind: int, sig, node, n):
    batch = packed(bucket, {"sig": sig, "node": node, "n": n.astype(np.uint32)})
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([b""] * batch.num_rows, pa.binary()), pa.array([kind] * batch.num_rows, pa.int32())], names=[*batch.schema.names, "at", "kind"])


def _compact(sig: np.ndarray, node: np.ndarray, n: np.ndarray, buckets: int):
    """Rows of kind 0: 4 bytes of each signature (the bucket has its upper bits; a chance match costs a verification), and the place of
    its set, 2 or 4 bytes, in the row's table of sets."""
    key = mix(sig)
    bucket = bucket_of(key, buckets)
    order = np.argsort(bucket, kind="stable")
    cut = runs(bucket[order])
    key, node, n = key[order], node[order], n[order].astype(np.uint32)
    cols: list[list] = [[] for _ in range(6)]
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        name, first, at = np.unique(node[i:j], return_index=True, return_inverse=True)
        wide = len(name) > 1 << 16
        row = (int(bucket[order[i]]), key[i:j].astype(np.uint32).tobytes(), name.tobytes(), n[i:j][first].tobytes(), at.astype(np.uint32 if wide else np.uint16).tobytes(), 3 if wide else 0)
        for c, v in zip(cols, row, strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k in (0, 5) else pa.binary()) for k, c in enumerate(cols)], names=["bucket", "sig", "node", "n", "at", "kind"])


def _indexed(batches, s: Similarity, frequent, buckets: int):
    """Kinds 0 and 3: (signature, set) of signatures that aren't frequent. Kind 1: (set, leader) of frequent ones. Kind 2: (frequent signature, set)."""
    frequent = frequent.value
    hot_sig, lead, lead_n = frequent["sig"], frequent["lead"], frequent["lead_n"]
    held: list[tuple] = []
    size = 0

    def tell():
        sig, cls, n, hot = (np.concatenate(c) for c in zip(*held, strict=True))
        first = np.unique(mix(sig) ^ cls.astype(U), return_index=True)[1]  # copies once
        sig, cls, n, hot = sig[first], cls[first], n[first], hot[first]
        cold = ~hot
        yield _compact(sig[cold], cls[cold], n[cold], buckets)
        if hot.any():
            sig, cls, n = sig[hot], cls[hot], n[hot]
            at = np.searchsorted(hot_sig, sig)
            near = (lead[at] != cls) & (np.minimum(n, lead_n[at]) * s.den >= np.maximum(n, lead_n[at]) * s.num)
            pair = np.unique(np.stack([cls[near], lead[at][near]]), axis=1)
            yield _block(bucket_of(mix(pair[0].astype(U)), buckets), 1, pair[1].astype(U), pair[0], np.zeros(pair.shape[1]))
            yield _block(bucket_of(mix(sig), buckets), 2, sig, cls, n)

    for batch in batches:
        for _, raws in sliced([None] * batch.num_rows, [r or b"" for r in batch.column(0).to_pylist()]):
            sets = Sets(raws, s.words)
            sig, doc, hot = signatures(sets, s.num, s.den, hot_sig)
            held.append((sig, sets.cls[doc], sets.n[doc], hot))
            size += len(sig)
            if size > s.held:
                yield from tell()
                held, size = [], 0
    if held:
        yield from tell()


def _met(batches, s: Similarity):
    """A bucket's pairs (a, b, null), and memberships (null, b, signature) of frequent signatures."""
    names = ["a", "b", "sig"]
    cold: list[tuple] = []
    bucket = 0
    pairs: list[np.ndarray] = []
    members: list[np.ndarray] = []
    for batch in batches:
        kind = np.array(batch.column("kind").to_pylist())
        for k in np.flatnonzero((kind == 0) | (kind == 3)).tolist():
            one = {c: batch.column(c)[k].as_py() for c in ("sig", "node", "n", "at", "bucket")}
            at, bucket = np.frombuffer(one["at"], np.uint32 if kind[k] else np.uint16), one["bucket"]
            cold.append((np.frombuffer(one["sig"], np.uint32), np.frombuffer(one["node"], np.int64)[at], np.frombuffer(one["n"], np.uint32)[at]))
        x = unpacked([batch.filter(pa.array(kind == 1))], {"sig": np.int64, "node": np.int64}) if (kind == 1).any() else None
        if x:
            pairs.append(np.stack([np.minimum(x["sig"], x["node"]), np.maximum(x["sig"], x["node"])]))
        if (kind == 2).any():
            x = unpacked([batch.filter(pa.array(kind == 2))], {"sig": np.int64, "node": np.int64})
            members.append(np.stack([x["node"], x["sig"]]))
    sig, node, n = (np.concatenate(c) for c in zip(*cold, strict=True)) if cold else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint32))
    order = np.argsort(sig.astype(U) << U(32) | n)
    sig, node, n = sig[order], node[order], n[order].astype(np.int64)
    cut = runs(sig)
    count = np.diff(cut)
    group = np.repeat(np.arange(len(count)), count)
    big = np.repeat(count > s.group, count)
    near = lambda i, j: (node[i] != node[j]) & (n[i] * s.den >= n[j] * s.num)  # noqa: E731  n[i] <= n[j]
    place = np.flatnonzero(~big)
    step = 1
    while len(place):
        place = place[place + step < len(sig)]
        place = place[group[place] == group[place + step]]
        some = place[near(place, place + step)]
        pairs.append(np.stack([np.minimum(node[some], node[some + step]), np.maximum(node[some], node[some + step])]))
        step += 1
    if big.any():  # frequent after all: a star around the middle of its sizes
        at = np.flatnonzero(big)
        middle = (cut[:-1] + count // 2)[group[at]]
        i, j = np.minimum(at, middle), np.maximum(at, middle)
        some = near(i, j)
        pairs.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])])[:, some])
        members.append(np.stack([node[at], sig[at].astype(np.int64) | 1 << 62 | bucket << 32]))
    if pairs and sum(p.shape[1] for p in pairs):
        found = np.concatenate(pairs, 1)
        found = found[:, np.unique(mix(found[0].astype(U)) + found[1].astype(U), return_index=True)[1]]
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.nulls(found.shape[1], pa.int64())], names=names)
    if members:
        found = np.concatenate(members, 1)
        found = found[:, np.unique(mix(found[0].astype(U)) + found[1].astype(U), return_index=True)[1]]
        yield pa.RecordBatch.from_arrays([pa.nulls(found.shape[1], pa.int64()), pa.array(found[0]), pa.array(found[1])], names=names)


def linked(a: np.ndarray, b: np.ndarray, s: Similarity) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * s.den >= s.num * (len(a) + len(b) - both)


def _squeezed(batches):
    squeeze = zstandard.ZstdCompressor(1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze.compress(r or b"") for r in batch.column(2).to_pylist()], pa.binary())], names=["row", "row2", "raw"])


def _plain(column) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(r) for r in column.to_pylist()]


def _verified(batches, s: Similarity):
    """(a, b, raw_a, raw_b) to the pairs that link."""
    for batch in batches:
        found = []
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            one, two = Sets(_plain(part.column(2)), s.words), Sets(_plain(part.column(3)), s.words)
            found += [(a[k], b[k]) for k in range(len(one.n)) if linked(one.of(k), two.of(k), s)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _tokens(batches, size: int):
    for batch in batches:
        for some, raws in sliced(batch.column(0).to_pylist(), _plain(batch.column(1))):
            sets = Sets(raws, size)
            yield pa.RecordBatch.from_pydict({"cls": pa.array(some, pa.int64()), "token": pa.array([sets.of(k).tobytes() for k in range(len(some))], pa.binary())})


def sketch(token: np.ndarray) -> bytes:
    """A bit for each of about twice as many places as the set has shingles: whether an odd number of them falls there."""
    bits = 1 << max(6, int(2 * len(token) - 1).bit_length())
    return np.packbits((np.bincount((token & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Places where two sketches differ: sets differ in as many shingles or more. The longer sketch is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = np.bitwise_xor.reduce(x.reshape(-1, size), 0), np.bitwise_xor.reduce(y.reshape(-1, size), 0)
    return int(np.bitwise_count(x ^ y).sum())


def _sketches(batches, size: int):
    for batch in batches:
        for some, raws in sliced(batch.column(0).to_pylist(), _plain(batch.column(1))):
            sets = Sets(raws, size)
            yield pa.RecordBatch.from_pydict({"cls": pa.array(some, pa.int64()), "n": pa.array(sets.n), "raw": pa.array([sketch(sets.of(k)) for k in range(len(some))], pa.binary())})


def _possible(batches, s: Similarity):
    """Pairs that their sketches don't rule out."""
    for batch in batches:
        a, b, n, m = (batch.column(c).to_pylist() for c in ("raw_a", "raw_b", "n_a", "n_b"))
        good = [(s.num + s.den) * least_difference(a[k], b[k]) <= (s.den - s.num) * (n[k] + m[k]) for k in range(len(a))]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _scanned(batches, folder: str, s: Similarity):
    """Sets against every block of the odd ones, by the block's inverted index; links that join what this task hasn't joined yet."""
    blocks = [uri for uri, _ in list_files(folder, ".parquet")]
    for batch in batches:
        cls, token = batch.column(0).to_pylist(), [np.frombuffer(t, U) for t in batch.column(1).to_pylist()]
        for uri in blocks:
            with open_file(uri) as f:
                odd = pq.read_table(f, columns=["cls", "token"])
            for lo in range(0, odd.num_rows, BLOCK):
                part = odd.slice(lo, BLOCK)
                name = np.array(part.column(0).to_pylist(), np.int64)
                sets = [np.frombuffer(t, U) for t in part.column(1).to_pylist()]
                size = np.array([len(t) for t in sets])
                index = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets)), size)[np.argsort(index, kind="stable")]
                index = np.sort(index)
                root = {}

                def find(x):
                    while root.get(x, x) != x:  # noqa: B023
                        x = root[x]  # noqa: B023
                    return x

                out = []
                for c, t in zip(cls, token, strict=True):
                    first, last = np.searchsorted(index, t), np.searchsorted(index, t, "right")
                    span = last - first
                    where = np.repeat(first - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
                    both = np.bincount(owner[where], minlength=len(sets))
                    for k in np.flatnonzero((both > 0) & (both * s.den >= s.num * (size + len(t) - both))).tolist():
                        x, y = find(c), find(int(name[k]))
                        if x != y:
                            root[max(x, y)] = min(x, y)
                            out.append((c, int(name[k])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _with_texts(pairs: DataFrame, held: DataFrame) -> DataFrame:
    one = held.select(F.col("cls").alias("a"), F.col("raw").alias("raw_a"))
    two = held.select(F.col("cls").alias("b"), F.col("raw").alias("raw_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "raw_a", "raw_b")


def components_of(df: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of df: documents link when their shingle sets are similar enough.

    Texts are lowered (A-Z) and cut into words; a set holds the distinct runs of similarity.words words, or all words of a shorter text
    as one; null and empty texts have none and are alone. component_id is the least id that links reach (nulls count as the largest).
    Repeated rows and equal ids each get a row; other columns are left out; an empty table gives none. Whole texts are taken, however
    long. Shingles are compared by 56-bit and equal sets by 64-bit hashes.
    """
    return _labelled(df, similarity, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def representatives(df: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay when of each component one goes on: the one of the least id (nulls count as the largest; of equal ids the
    one of the least hash of its text). Texts without words link with nothing and stay, but of rows equal in id and text one stays."""
    found = written(_labelled(df, similarity, id_col, text_col).select("doc_id", "row", "row2", "of"), "jaccard-rows")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "row2")
    kept = found.where("of is not null").groupBy("of").agg(F.min(order).alias("k")).select("k.row", "k.row2").union(found.where("of is null").select("row", "row2")).distinct()
    kept = kept.select(F.col("row").alias("__row"), F.col("row2").alias("__row2"))
    row, row2 = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary"))
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__of"), row.alias("__row"), row2.alias("__row2"))
    return source.join(kept, ["__row", "__row2"]).dropDuplicates(["__row", "__row2"]).select("__of.*")


def _labelled(df: DataFrame, similarity: Similarity, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, row2, n, cls, of, component): each row's class and component; `of` is null for texts without words."""
    spark = df.sparkSession
    s, kind = similarity, dict(df.dtypes)[id_col]
    row, row2 = row_key(F.col("doc_id"), F.col("raw"))
    docs = texts(df, id_col, text_col).withColumn("row", row).withColumn("row2", row2)
    buckets = buckets_for(spark, docs)
    classes = written(arrow_map(docs.select("doc_id", "row", "row2", "raw"), lambda b: _classes(b, s.words), f"doc_id {kind}, row long, row2 long, n long, cls long"), "jaccard-classes")
    frequent = _frequent(spark, docs, s)
    found = written(arrow_map(dealt(arrow_map(docs.select("raw"), lambda b: _indexed(b, s, frequent, buckets), _COLUMNS), buckets), lambda b: _met(b, s), "a long, b long, sig long"), "jaccard-candidates")
    pairs = found.where("a is not null").select("a", "b").distinct()
    members = found.where("a is null").select("sig", F.col("b").alias("cls"))
    pairs = written(pairs, "jaccard-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(members.select("cls")).distinct()
    chosen = classes.where("cls is not null").groupBy("cls").agg(F.min(F.struct("row", "row2")).alias("r")).join(needed, "cls").select("cls", "r.row", "r.row2")
    # texts go through the exchanges compressed; repeated rows leave one
    texts_of = arrow_map(docs.select("row", "row2", "raw"), _squeezed, "row long, row2 long, raw binary").join(chosen, ["row", "row2"]).dropDuplicates(["row", "row2"])
    held = written(texts_of.select("cls", "raw"), "jaccard-texts")
    seen = written(arrow_map(held, lambda b: _sketches(b, s.words), "cls long, n long, raw binary"), "jaccard-sketches")
    side = lambda c: seen.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("raw").alias(f"raw_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "raw_a", "raw_b", "n_a", "n_b")
    pairs = written(arrow_map(both, lambda b: _possible(b, s), "a long, b long"), "jaccard-possible")
    # first each set's pair with the least partner, then the pairs whose ends aren't connected yet
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = written(arrow_map(_with_texts(first, held), lambda b: _verified(b, s), "a long, b long"), "jaccard-links")
    label = components(links)
    at = lambda c, n: label.select(F.col("node").alias(c), F.col("label").alias(n))
    apart = pairs.join(at("a", "of_a"), "a", "left").join(at("b", "of_b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    apart = apart.select("a", "b").join(first, ["a", "b"], "left_anti")
    links = links.union(written(arrow_map(_with_texts(apart, held), lambda b: _verified(b, s), "a long, b long"), "jaccard-links"))
    label = components(links)
    # members of frequent signatures that the stars left outside the main component
    within = written(members.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("label", "cls").alias("label")), "jaccard-members")
    sizes = within.groupBy("sig", "label").agg(F.count("*").alias("m"))
    main = sizes.groupBy("sig").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("sig", F.col("top.label").alias("main"))
    # a signature with very many members is dealt to several tasks
    salted = within.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    odd = salted.join(main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["sig", "salt"]).where("label != main").select("cls").distinct()
    tokens = lambda of: arrow_map(held.join(of, "cls", "left_semi").select("cls", "raw"), lambda b: _tokens(b, s.words), "cls long, token binary")
    folder = work_path(spark, "jaccard-odd")
    tokens(odd).write.parquet(folder)
    if not spark.read.schema("cls long, token binary").parquet(folder).isEmpty():
        more = arrow_map(tokens(members.select("cls").distinct()).repartition(buckets, "cls"), lambda b: _scanned(b, folder, s), "a long, b long")
        label = components(links.union(written(more, "jaccard-more").where("a != b")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id"))
    named = classes.where("cls is not null").groupBy("cls").agg(least.alias("id")).join(label.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "id")
    group = written(named, "jaccard-labels")
    low = group.groupBy("label").agg(F.min("id").alias("id"))
    of = group.select("cls", "label").join(low, "label").select("cls", F.col("label").alias("of"), F.col("id.doc_id").alias("component"))
    of = written(of, "jaccard-components")
    empty = classes.where("cls is null").select("*", F.lit(None).cast("long").alias("of"), F.lit(None).cast(kind).alias("component"))
    return classes.where("cls is not null").join(of, "cls").select(*empty.columns).unionByName(empty)


def _frequent(spark: SparkSession, docs: DataFrame, s: Similarity):
    """The most frequent signatures with a leader each; MOST_FREQUENT bounds what is collected and broadcast."""
    told = arrow_map(docs.select("raw"), lambda b: _counted(b, s), "sig long, sets long, copies long, lead long, lead_n long")
    top = told.groupBy("sig").agg(F.sum("sets").alias("sets"), F.max(F.struct("copies", "lead", "lead_n")).alias("l")).where(F.col("sets") >= s.frequent)
    top = written(top.select("sig", "sets", "l.lead", "l.lead_n"), "jaccard-frequent")
    if (many := top.count()) > MOST_FREQUENT:
        cut = top.approxQuantile("sets", [1 - MOST_FREQUENT / many], 0.001)[0]
        top = top.where(F.col("sets") > cut)  # so whoever shares less than a frequent one is frequent too
    rows = top.select("sig", "lead", "lead_n").toArrow()
    sig = np.asarray(rows.column(0), np.int64).astype(U)
    order = np.argsort(sig)
    return spark.sparkContext.broadcast({"sig": sig[order], "lead": np.asarray(rows.column(1), np.int64)[order], "lead_n": np.asarray(rows.column(2), np.int64)[order]})
