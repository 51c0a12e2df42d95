"""Language model scoring with a probabilistic suffix tree over words.

A text is a sequence of tokens: its words, then END. A state of the tree is a suffix of the token history, of one or two tokens (START
stands before the first), and the empty one. A state needs `least` occurrences; it has the next tokens that follow it twice or more and in
at least `share` of its occurrences, and it is kept if its distribution diverges from that of the next shorter kept state by more than
`divergence` nats over all its occurrences. The longest kept state scores a token:

    p(x | s) = c(s, x) / (n(s) + mu) + rest(s) p(x | shorter state),    p(x | empty) = (c(x) + V / (V + 1)) / (N + V)

where c(s, x) counts the next tokens that s has and rest(s) is what they leave of 1. The rules are the same at every size of the input.

The tree is never in one place. All states that end with a word, and all tokens that follow it, are in the bucket of that word: counts,
divergence tests and scores come from there. Of a word (or pair of words) that follows itself around too often for a bucket, the "wide"
ones, next tokens are counted beforehand with pre-aggregation; its tokens are spread over buckets by the word before (or by text and
place), and each of these buckets is told the counts. The empty state's counts of the most frequent words, at most a million, are broadcast;
rare tokens pass through the bucket of their own word first, which knows its count. A frequent word travels as its rank, so that most take few
bits.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, Words, arrow_map, bucket_of, mix, row_key, runs, seeds, sliced, texts, written

START, END = seeds(2, 77)
_PAIR, _SUB = seeds(2, 78)
FREQUENT = 1_000_000
HELD = 600_000
#: Rare tokens that go on together: rows that go on are not small, as each names the slices that it has tokens of.
TOGETHER = 1 << 19
#: Bytes of text whose tokens a task gets.
PER_TASK = 32 << 20
#: Numbers whose bits are laid out at once.
BITS_OF = 1 << 17


@dataclass(frozen=True)
class Tree:
    """The rules of the tree. wide: occurrences of a context from which on its tokens are spread over buckets (the result is the same)."""

    least: int = 20
    share: float = 0.001
    divergence: float = 10.0
    mu: float = 2.0
    wide: int = 2_000_000


def pair_of(w2: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """The context of two tokens."""
    return mix(w1 + mix(w2 ^ _PAIR))


@dataclass
class Tokens:
    """All tokens of some texts: x, the two before it, and the text of each."""

    x: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(raws: list[bytes]) -> Tokens:
        words = Words(raws, lower=True)
        size = words.n + 1
        x = np.full(int(size.sum()), END)
        x[np.arange(len(words.hash)) + words.doc()] = words.hash
        doc = np.repeat(np.arange(len(raws)), size)
        t = Tokens(x, x, x, doc)
        t.w1, t.w2 = t.before(x, 1, START), t.before(x, 2, START)
        return t

    def before(self, of: np.ndarray, k: int, none) -> np.ndarray:
        """What `of` says of the token k places before each in its text."""
        out = np.full(len(of), none, of.dtype)
        out[k:] = np.where(self.doc[k:] == self.doc[:-k], of[:-k], none)
        return out


def _lookup(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 for those that aren't there."""
    if not len(table):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, at, -1)


# --- counting ----------------------------------------------------------------------------------


def _counts(batches, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, words, counts in training texts), summed over what a task holds; words of held-out texts alone have 0."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def summed():
        key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

    def packed(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = bucket_of(key, buckets)  # rises with the word
        cut = runs(bucket)
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array(_coded(_steps(key, cut[:-1]), cut), pa.binary()), pa.array(_coded(n, cut), pa.binary())], names=["bucket", "word", "n"])

    for batch in batches:
        for some, raws in sliced(batch.column(1).to_pylist(), [r or b"" for r in batch.column(0).to_pylist()]):
            t = Tokens.of(raws)
            key, at = np.unique(t.x, return_inverse=True)
            held.append((key, np.bincount(at, ~np.array(some, bool)[t.doc], len(key)).astype(np.int64)))
            size += len(key)
            if size > 2 * HELD:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD:
                    yield packed(*held[0])
                    held, size = [], 0
    if held:
        yield packed(*summed())


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """(word, n) of a bucket, each word once."""
    words, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for batch in batches:
        for word, n in zip(*(batch.column(f).to_pylist() for f in ("word", "n")), strict=True):
            words.append(np.cumsum(_decoded([word])))
            counts.append(_decoded([n]).astype(np.int64))
    word, at = np.unique(np.concatenate(words), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts), len(word)).astype(np.int64)
    for k in range(0, len(word), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(word[k : k + (1 << 16)].astype(np.int64)), pa.array(n[k : k + (1 << 16)])], names=["word", "n"])


def _next_counts(batches, wide, level: int) -> Iterator[pa.RecordBatch]:
    """(ctx, x, n): what follows wide contexts of `level` tokens in training texts."""
    wide = wide.value
    for batch in batches:
        for some, raws in sliced(batch.column(1).to_pylist(), [r or b"" for r in batch.column(0).to_pylist()]):
            t = Tokens.of(raws)
            ctx = t.w1 if level == 1 else pair_of(t.w2, t.w1)
            use = (_lookup(wide, ctx) >= 0) & ~np.array(some, bool)[t.doc]
            if level == 2:
                use &= t.w1 != START
            ctx, x = ctx[use], t.x[use]
            order = np.lexsort((x, ctx))
            ctx, x = ctx[order], x[order]
            change = np.flatnonzero((ctx[1:] != ctx[:-1]) | (x[1:] != x[:-1])) + 1
            cut = np.concatenate(([0], change, [len(x)])) if len(x) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ctx[cut[:-1]].astype(np.int64)), pa.array(x[cut[:-1]].astype(np.int64)), pa.array(np.diff(cut))], names=["ctx", "x", "n"])


# --- buckets -----------------------------------------------------------------------------------

_FIELDS = ("key", "n", "w1", "run", "w2", "x", "c", "doc", "target")
_SUM_FIELDS = ["bucket", "key", "w1", "doc", "n", "c", "w2", "x"]
_SCHEMA = "bucket int, kind int, " + ", ".join(f"{f} binary" for f in _FIELDS)
#: kinds of rows: tokens of the bucket of their context; rare tokens in the bucket of their word; counts of wide contexts; counts of rare
#: words; sums of texts, which pass through
_TOKENS, _RARE, _WIDE, _WORDS, _SUM = range(5)
_NEW = U(1 << 63)
#: The code of words before the last one that are too rare for a state of two tokens.
_NONE = _NEW
#: Stands for _NONE where numbers are coded: it takes no bits.
_NO_BITS = 65


def _squeezed(values: np.ndarray) -> bytes:
    """An array's bytes, all first ones together, then all second ones and so on, compressed: small numbers take little more than they say."""
    values = np.ascontiguousarray(values)
    return _zstd()[0].compress(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes())


def _expanded(data: bytes, kind) -> np.ndarray:
    data = _zstd()[1].decompress(data)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _coded(values: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Whole numbers from 0, as bytes for each of the rows that begin at cut (with their end): how many bits each has, compressed, then the bits
    below the highest one. Ranks of words fall off so evenly that hardly more is needed than their entropy."""
    return [row for i, j in _portions(cut) for row in _bits(np.ascontiguousarray(values[cut[i] : cut[j]]).astype(U), cut[i : j + 1] - cut[i])]


def _portions(cut: np.ndarray) -> list[tuple[int, int]]:
    """Rows that begin at cut, by some that have together about BITS_OF numbers."""
    part = np.flatnonzero(np.diff(cut[:-1] // BITS_OF, prepend=-1)).tolist()
    return list(zip(part, [*part[1:], len(cut) - 1], strict=True)) if part else []


def _bits(values: np.ndarray, cut: np.ndarray) -> list[bytes]:
    size = np.minimum(np.frexp(values.astype(np.float64))[1], 64)
    size -= (size > 0) & (values >> np.maximum(size - 1, 0).astype(U) == 0)  # floats of over 53 bits may round up
    below = np.where(values == _NONE, 0, np.maximum(size - 1, 0))
    size = np.where(values == _NONE, _NO_BITS, size).astype(np.uint8)
    beyond = below & 7  # bits beyond whole bytes, which are laid out one by one; then the bytes, lowest first
    bits = np.unpackbits((values >> (below - beyond).astype(U)).astype(np.uint8)[:, None], axis=1)[np.arange(8) >= 8 - beyond[:, None]]
    at = np.concatenate(([0], np.cumsum(beyond)))[cut].tolist()
    whole = []
    for k in range(8, int(below.max(initial=0)) + 1, 8):
        has = below >= k
        whole.append(((values[has] >> U(k - 8)).astype(np.uint8), np.concatenate(([0], np.cumsum(has)))[cut].tolist()))
    out = []
    for r, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        head = _zstd()[0].compress(size[i:j].tobytes())
        out.append(b"".join((len(head).to_bytes(4, "little"), head, np.packbits(bits[at[r] : at[r + 1]]).tobytes(), *(v[c[r] : c[r + 1]].tobytes() for v, c in whole))))
    return out


def _decoded(rows: list[bytes]) -> np.ndarray:
    """The numbers of rows of `_coded`, one row after the other."""
    begin = [4 + int.from_bytes(data[:4], "little") for data in rows]
    sizes = [_zstd()[1].decompress(data[4:b]) for data, b in zip(rows, begin, strict=True)]
    told = [_numbers(rows[i:j], begin[i:j], sizes[i:j]) for i, j in _portions(np.cumsum([0, *[len(x) for x in sizes]]))]
    return np.concatenate([np.zeros(0, U), *told])


def _numbers(rows: list[bytes], begin: list[int], sizes: list[bytes]) -> np.ndarray:
    size = np.frombuffer(b"".join(sizes), np.uint8)
    none = size == _NO_BITS
    below = np.where(none, 0, np.maximum(size.astype(np.int64) - 1, 0))
    cut = np.cumsum([0, *[len(x) for x in sizes]])
    beyond = below & 7
    raw = [np.frombuffer(data, np.uint8) for data in rows]
    told = np.diff(np.concatenate(([0], np.cumsum(beyond)))[cut]).tolist()
    bits = np.zeros((len(size), 8), np.uint8)
    bits[np.arange(8) >= 8 - beyond[:, None]] = np.concatenate([np.unpackbits(x[b:], count=n) for x, b, n in zip(raw, begin, told, strict=True)])
    values = np.packbits(bits, axis=1).reshape(-1).astype(U) << (below - beyond).astype(U)
    begin = [b + (n + 7) // 8 for b, n in zip(begin, told, strict=True)]
    for k in range(8, int(below.max(initial=0)) + 1, 8):
        has = below >= k
        told = np.diff(np.concatenate(([0], np.cumsum(has)))[cut]).tolist()
        values[has] |= np.concatenate([x[b : b + n] for x, b, n in zip(raw, begin, told, strict=True)]).astype(U) << U(k - 8)
        begin = [b + n for b, n in zip(begin, told, strict=True)]
    return np.where(none, _NONE, np.where(size > 0, values | U(1) << below.astype(U), U(0)))


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers that rise from one place of `first` to the next, as what each adds to the one before."""
    out = np.diff(values, prepend=values[:1])
    out[first] = values[first]
    return out


def _risen(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The numbers of `_steps`."""
    total = np.cumsum(steps)
    return total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(steps))))


@functools.cache
def _zstd():
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _row(bucket: int, kind: int, **fields) -> tuple:
    return (bucket, kind, *[fields.get(f, b"") for f in _FIELDS])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * (2 + len(_FIELDS))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(cols)], names=["bucket", "kind", *_FIELDS])


def _grouped(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = runs(bucket[order])
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(bucket[order[i]]), order[i:j]


# A text is named by its slice (the texts that a task takes together, named by a hash of their keys) and its place there: `doc` is
# the slice's number in the row's list << 32 | the place. So a text's long key travels once, with its slice. In a row the last bit says
# whether the text is one to learn from.


def _packed(bucket: np.ndarray, kind: int, slices: np.ndarray, doc: np.ndarray, train: np.ndarray, w1: np.ndarray, w2: np.ndarray, x: np.ndarray, c: np.ndarray | None = None, target: np.ndarray | None = None) -> list[tuple]:
    """Rows of tokens: those of a bucket together, sorted by context; a word before stands once for all its tokens."""
    order = np.lexsort((doc, w1, bucket))
    bucket, doc, train, w1 = bucket[order], doc[order], train[order], w1[order]
    cut = runs(bucket)
    run = np.union1d(cut, runs(w1))  # where a word's tokens begin
    of = np.searchsorted(run, cut)
    place = doc & 0xFFFFFFFF
    wide = int(place.max(initial=0)).bit_length()
    names, at = [slices] * (len(cut) - 1), doc >> 32 << wide | place
    if len(slices) > 1:  # those that a row has tokens of
        names = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            used, number = np.unique(doc[i:j] >> 32, return_inverse=True)
            names.append(slices[used])
            at[i:j] = number << wide | place[i:j]
    fields = {"w1": _coded(_steps(w1[run[:-1]], of[:-1]), of), "run": _coded(np.diff(run), of), "doc": _coded(_steps(at, run[:-1]) << 1 | train, cut)}
    fields |= {f: _coded(v[order], cut) for f, v in (("w2", w2), ("x", x))}
    fields |= {f: _coded(v[order], cut) for f, v in (("c", c), ("target", None if target is None else target + 1)) if v is not None}
    rows = []
    for k, b in enumerate(bucket[cut[:-1]].tolist()):
        rows.append(_row(b, kind, key=names[k].tobytes(), n=np.array([cut[k + 1] - cut[k], wide]).tobytes(), **{f: v[k] for f, v in fields.items()}))
    return rows


def _unpacked(rows: list[tuple[pa.RecordBatch, int]]) -> dict[str, np.ndarray]:
    """Rows of tokens as one: slices are numbered through."""
    raw = {f: [batch.column(f)[k].as_py() for batch, k in rows] for f in _FIELDS}
    n, wide = np.array([np.frombuffer(x, np.int64) for x in raw["n"]]).T
    begin = np.cumsum(n) - n  # where a row's tokens begin
    run, doc = _decoded(raw["run"]).astype(np.int64), _decoded(raw["doc"]).astype(np.int64)
    first = np.cumsum(run) - run
    at, wide = _risen(doc >> 1, first), np.repeat(wide, n)
    named = [np.frombuffer(x, U) for x in raw["key"]]
    slices, number = np.unique(np.concatenate(named), return_inverse=True)
    of = number[np.repeat(np.cumsum([0, *[len(x) for x in named[:-1]]]), n) + (at >> wide)]
    out = {"key": slices, "doc": of << 32 | at & ((1 << wide) - 1), "train": (doc & 1).astype(bool)}
    out |= {"w1": np.repeat(_risen(_decoded(raw["w1"]), np.searchsorted(first, begin)), run), "w2": _decoded(raw["w2"]), "x": _decoded(raw["x"])}
    for f, none in (("c", -1), ("target", 0)):  # rows without them are of tokens that their context's bucket knows the rest of
        told = np.repeat([bool(x) for x in raw[f]], n)
        out[f] = np.full(len(told), none)
        if told.any():
            out[f][told] = _decoded([x for x in raw[f] if x]).astype(np.int64) - (f == "target")
    return out


def _together(found: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums as one: slices are numbered through."""
    slices, at = np.unique(np.concatenate([t["key"] for t in found]), return_inverse=True)
    begin = 0
    for t in found:
        t["doc"] = at[begin + (t["doc"] >> 32)] << 32 | t["doc"] & 0xFFFFFFFF
        begin += len(t["key"])
    return {"key": slices, **{f: np.concatenate([t[f] for t in found]) for f in found[0] if f != "key"}}


_SUMS = np.dtype([("place", "<u4"), ("n_tokens", "<i4"), ("n_known", "<i4"), ("base", "<f8"), ("score", "<f8")])
#: A task's sum of a text's scores travels as a whole number of this many parts of 1, which has fewer bits than a float: it is off by 3e-8 at most.
_PARTS = 2.0**24


def _sums(slices: np.ndarray, doc: np.ndarray, buckets: int, n_tokens=None, n_known=None, base=None, score=None, keys: np.ndarray | None = None) -> list[tuple]:
    """Rows of what is known of some texts, a row for each slice, by the slice's bucket; with keys also those of the (one) slice's texts."""
    used, at = np.unique(doc, return_inverse=True)
    cut = runs(used >> 32)
    bucket = bucket_of(mix(slices), buckets)
    total = lambda v: np.bincount(at, v, len(used))
    fields = {"doc": _coded(_steps(used & 0xFFFFFFFF, cut[:-1]), cut)}
    if n_tokens is not None:
        fields["n"] = _coded(np.rint(total(n_tokens)), cut)
    if n_known is not None:
        fields["c"] = _coded(np.rint(total(n_known)), cut)
    if base is not None:
        base = total(base)
        fields["w2"] = [_squeezed(base[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    if score is not None:  # never above 0
        fields["x"] = _coded(np.rint(np.maximum(-total(score), 0) * _PARTS), cut)
    if keys is not None:
        fields["w1"] = [keys.tobytes()]
    return [_row(int(bucket[s]), _SUM, key=slices[s : s + 1].tobytes(), **{f: v[k] for f, v in fields.items()}) for k, s in enumerate((used[cut[:-1]] >> 32).tolist())]


def _summands(doc: bytes, n_tokens: bytes, n_known: bytes, base: bytes, score: bytes) -> np.ndarray:
    """The numbers of a row of `_sums`."""
    place = np.cumsum(_decoded([doc]))
    out = np.zeros(len(place), _SUMS)
    out["place"] = place
    for name, data in (("n_tokens", n_tokens), ("n_known", n_known)):
        if data:
            out[name] = _decoded([data])
    if base:
        out["base"] = _expanded(base, np.float64)
    if score:
        out["score"] = -_decoded([score]).astype(np.float64) / _PARTS
    return out


@dataclass
class Known:
    """What every task knows: frequent words with their counts and ranks, wide contexts with their counts, and the corpus' numbers."""

    word: np.ndarray
    count: np.ndarray
    rank: np.ndarray
    ranked: np.ndarray
    wide1: np.ndarray
    wide1_n: np.ndarray
    wide2: np.ndarray
    wide2_n: np.ndarray
    wide2_first: np.ndarray
    wide2_last: np.ndarray
    n: int
    v: int
    ends: int
    often: int
    tree: Tree
    buckets: int

    def empty(self, c: np.ndarray) -> np.ndarray:
        """The empty state's probability of tokens with these counts."""
        return (c + self.v / (self.v + 1)) / (self.n + max(self.v, 1))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + self.v + 1))

    def parts(self, n: np.ndarray) -> np.ndarray:
        """Buckets of a wide context."""
        return np.minimum(self.buckets, -(-n // self.tree.wide)).astype(U)

    def code(self, word: np.ndarray) -> np.ndarray:
        """A frequent word's rank, or a rare one's hash."""
        return self.code_at(_lookup(self.word, word), word)

    def code_at(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.rank[np.maximum(at, 0)] if len(self.rank) else U(0), word | _NEW)

    def count_at(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often a word was seen in training; of a rare one, how often at most."""
        return np.where(word == START, self.ends, np.where(at >= 0, self.count[np.maximum(at, 0)] if len(self.count) else 0, self.often))

    def codes_before(self, t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the two words before each token, at being the tokens' places in the table of words."""
        at1, at2 = t.before(at, 1, -1), t.before(at, 2, -1)
        return self.code_at(at1, t.w1), np.where(self.count_at(at2, t.w2) >= self.tree.least, self.code_at(at2, t.w2), _NONE)

    def targets(self, t: Tokens, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The bucket of each token's context; -1 where no state is possible. at: the tokens' places in the table of words."""
        n1 = self.count_at(t.before(at, 1, -1), t.w1)
        bucket = bucket_of(mix(t.w1), self.buckets)
        one = _lookup(self.wide1, t.w1)
        some = np.flatnonzero(one >= 0)
        if len(some):
            bucket[some] = sub_bucket(t.w1[some], mix(t.w2[some]) % self.parts(self.wide1_n[one[some]]), self.buckets)
            ctx2 = pair_of(t.w2[some], t.w1[some])
            two = np.where(t.w1[some] != START, _lookup(self.wide2, ctx2), -1)
            ctx2, some, two = ctx2[two >= 0], some[two >= 0], two[two >= 0]
            if len(some):
                place = mix(keys[t.doc[some], 0].astype(U) + some.astype(U))
                bucket[some] = sub_bucket(ctx2, place % self.parts(self.wide2_n[two]), self.buckets)
        return np.where(n1 >= self.tree.least, bucket, -1).astype(np.int32)


def sub_bucket(ctx: np.ndarray, sub: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mix(ctx + mix(sub.astype(U) ^ _SUB)), buckets)


def _questions(batches, known, rare: bool):
    """Tokens to buckets: rare ones to that of their word, others to that of their context. Where no state is possible, and for what else
    the task knows itself, sums in place of tokens."""
    known: Known = known.value
    for batch in batches:
        held = batch.column(3).to_pylist()
        rows = np.stack([np.asarray(batch.column(k)) for k in (0, 1)], 1) if batch.num_rows else np.zeros((0, 2), np.int64)
        for some, raws in sliced(list(range(batch.num_rows)), [r or b"" for r in batch.column(2).to_pylist()]):
            t, keys, train = Tokens.of(raws), rows[some], ~np.array([held[k] for k in some], bool)
            slices = np.array([mix(np.cumsum(mix(keys.astype(U).ravel() + np.arange(keys.size, dtype=U)))[-1:])[0]], U)
            at = _lookup(known.word, t.x)
            take = np.flatnonzero(at < 0) if rare else np.flatnonzero(at >= 0)
            target = known.targets(t, at, keys)[take]
            before = [w[take] for w in known.codes_before(t, at)]
            doc = t.doc[take]
            train = train[doc]
            if rare:
                go = target >= 0  # no context is told where none is needed
                w1, w2 = (np.where(go, w, U(0)) for w in before)
                x = t.x[take] | _NEW
                yield _batch(_packed(bucket_of(mix(x), known.buckets), _RARE, slices, doc, train, w1, w2, x, target=target))
                continue
            c = known.count[at[take]]
            direct = target < 0
            n = np.bincount(t.doc, minlength=len(keys))
            score = np.bincount(doc[direct], np.log10(known.empty(c[direct])), len(keys))
            sums = _sums(slices, np.arange(len(keys)), known.buckets, n, np.bincount(doc, c > 0, len(keys)), np.bincount(doc, known.base(c), len(keys)), score, keys)
            go = np.flatnonzero(~direct)
            yield _batch(sums + _packed(target[go], _TOKENS, slices, doc[go], train[go], before[0][go], before[1][go], known.rank[at[take][go]]))


def _own_words(batches, known):
    """The bucket of rare words: their counts go on with the tokens to their contexts, or into sums where no state is possible."""
    known: Known = known.value
    words, counts, asked = [np.zeros(0, U)], [np.zeros(0, np.int64)], []
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column("kind")[k].as_py() == _WORDS:
                words.append(np.frombuffer(batch.column("x")[k].as_py(), U))
                counts.append(np.frombuffer(batch.column("c")[k].as_py(), np.int64))
            else:
                asked.append((batch, k))
    word, count = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(word)
    word, count = word[order], count[order]
    size = np.cumsum([0, *[np.frombuffer(batch.column("n")[k].as_py(), np.int64)[0] for batch, k in asked]])
    for some in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(size[:-1] // TOGETHER)) + 1) if asked else ():
        t = _unpacked([asked[k] for k in some])
        at = _lookup(word, t["x"])
        c = np.where(at >= 0, count[np.maximum(at, 0)] if len(count) else 0, 0)
        go = np.flatnonzero(t["target"] >= 0)
        score = np.where(t["target"] < 0, np.log10(known.empty(c)), 0.0)
        sums = _sums(t["key"], t["doc"], known.buckets, None, c > 0, known.base(c), score)
        yield _batch(sums + _packed(t["target"][go], _TOKENS, t["key"], t["doc"][go], t["train"][go], t["w1"][go], t["w2"][go], t["x"][go], c[go]))


def _told(batches, known):
    """Counts of wide contexts (ctx, level, x, n, c0 arrays) to the buckets of their tokens. A pair's last word is told wherever it is."""
    known: Known = known.value
    for batch in batches:
        rows = []
        for ctx, level, x, c, c0 in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            key = np.array([ctx], np.int64).astype(U)
            if level == 1:
                spread, w1, w2 = [(key, known.wide1_n[_lookup(known.wide1, key)])], key, np.zeros(1, U)
                spread += [(known.wide2[k : k + 1], known.wide2_n[k : k + 1]) for k in np.flatnonzero(known.wide2_last == key[0]).tolist()]
            else:
                k = int(_lookup(known.wide2, key)[0])
                spread, w1, w2 = [(key, known.wide2_n[k : k + 1])], known.wide2_last[k : k + 1], known.wide2_first[k : k + 1]
            places = set()
            for s, m in spread:
                sub = np.arange(int(known.parts(m)[0]))
                places |= set(sub_bucket(np.repeat(s, len(sub)), sub, known.buckets).tolist())
            fields = {"w1": known.code(w1), "w2": known.code(w2), "run": np.array([level]), "n": spread[0][1], "x": known.code(np.array(x, np.int64).astype(U)), "c": np.array(c, np.int64), "target": np.array(c0, np.int64)}
            rows += [_row(b, _WIDE, **{f: v.tobytes() for f, v in fields.items()}) for b in sorted(places)]
        yield _batch(rows)


def _states(ctx: np.ndarray, x: np.ndarray, train: np.ndarray, p: np.ndarray, tree: Tree, wide: dict[int, tuple]) -> np.ndarray:
    """p(x | state) for tokens x behind contexts, p being what the shorter states give them; wide: ((n, x, c), what the shorter states
    give those x) of contexts that are counted elsewhere."""
    order = np.lexsort((x, ctx))
    ctx, x, train, p = ctx[order], x[order], train[order], p[order]
    cut = np.concatenate(([0], np.flatnonzero((ctx[1:] != ctx[:-1]) | (x[1:] != x[:-1])) + 1, [len(x)]))
    first = cut[:-1]
    c = np.add.reduceat(train.astype(np.int64), first)  # of each (context, next token)
    group = runs(ctx[first])
    begin, size = group[:-1], np.diff(group)
    n = np.add.reduceat(c, begin)
    of = np.repeat(np.arange(len(begin)), size)
    have = (c >= 2) & (c >= tree.share * n[of]) & (n[of] >= tree.least)
    own = np.where(have, c, 0)
    rest = 1 - np.add.reduceat(own, begin) / (n + tree.mu)
    new = own / (n[of] + tree.mu) + rest[of] * p[first]
    gain = np.add.reduceat(np.where(have, own * np.log(np.where(have, new / p[first], 1.0)), 0.0), begin)
    new = np.where((gain > tree.divergence)[of], new, p[first])
    for k in np.flatnonzero(np.isin(ctx[first[begin]], np.array(list(wide), U))).tolist() if wide else ():
        here = slice(begin[k], begin[k] + size[k])
        told, before = wide[int(ctx[first[begin[k]]])]
        new[here] = _beyond(told, before, x[first[here]], p[first[here]], tree)
    out = np.empty(len(x))
    out[order] = np.repeat(new, np.diff(cut))
    return out


def _beyond(told: tuple, shorter: np.ndarray, x: np.ndarray, p: np.ndarray, tree: Tree) -> np.ndarray:
    """p(x | a wide state): told are its (n, next tokens, counts), shorter what the shorter states give those, p what they give x."""
    n, xs, cs = told
    left = 1 - cs.sum() / (n + tree.mu)
    if (cs * np.log((cs / (n + tree.mu) + left * shorter) / shorter)).sum() <= tree.divergence:
        return p
    at = _lookup(xs, x)
    return np.where(at >= 0, cs[np.maximum(at, 0)] if len(cs) else 0.0, 0.0) / (n + tree.mu) + left * p


def _scored(batches, known):
    """Buckets of contexts: their tokens' probabilities, summed by text. Sums pass through."""
    known: Known = known.value
    tree = known.tree
    packed: dict[int, list[tuple]] = defaultdict(list)
    all_told: dict[int, dict[tuple, tuple]] = defaultdict(dict)
    for batch in batches:
        kind, bucket = np.asarray(batch.column("kind")), np.asarray(batch.column("bucket")).tolist()
        yield batch.filter(pa.array(kind == _SUM)).select(_SUM_FIELDS)
        for k in np.flatnonzero(kind == _WIDE).tolist():
            get = lambda f, t, batch=batch, k=k: np.frombuffer(batch.column(f)[k].as_py(), t)
            x = get("x", U)
            order = np.argsort(x)
            all_told[bucket[k]][int(get("run", np.int64)[0]), int(get("w1", U)[0]), int(get("w2", U)[0])] = ((int(get("n", np.int64)[0]), x[order], get("c", np.int64)[order]), known.empty(get("target", np.int64)[order]))
        for k in np.flatnonzero(kind == _TOKENS).tolist():
            packed[bucket[k]].append((batch.slice(k, 1), 0))
    found = []
    for b in sorted(packed):  # one bucket of the task's after the other: the others stay compressed
        found.append(_scored_bucket(_unpacked(packed.pop(b)), all_told.get(b, {}), known, tree))
    if found:  # a text that several buckets know of has one sum
        t = _together(found)
        yield _batch(_sums(t["key"], t["doc"], known.buckets, score=t["score"])).select(_SUM_FIELDS)


def _scored_bucket(t: dict[str, np.ndarray], told: dict[tuple, tuple], known: Known, tree: Tree) -> dict[str, np.ndarray]:
    """The sums of a bucket's texts."""
    w1, w2, x, doc, train = (t[f] for f in ("w1", "w2", "x", "doc", "train"))
    number = np.where(t["c"] < 0, x, U(0)).astype(np.int64)
    c = np.where(t["c"] < 0, known.ranked[number] if len(known.ranked) else 0, t["c"])
    p = known.empty(c)
    one = {w: (counts, before) for (level, w, _), (counts, before) in told.items() if level == 1}
    p1 = _states(w1, x, train, p, tree, one)
    second = np.flatnonzero((w1 != known.code(np.array([START]))[0]) & (w2 != _NONE))
    if len(second):
        name = lambda a, b: mix(a) ^ mix(mix(b) + U(1))
        two = {}
        for (level, a, b), (counts, before) in told.items():
            if level == 2:  # what the last word alone gives the pair's next tokens
                before = _beyond(*one[a], counts[1], before, tree) if a in one else before
                two[int(name(np.array([a], U), np.array([b], U))[0])] = (counts, before)
        p1[second] = _states(name(w1[second], w2[second]), x[second], train[second], p1[second], tree, two)
    doc, at = np.unique(doc, return_inverse=True)
    return {"key": t["key"], "doc": doc, "score": np.bincount(at, np.log10(p1), len(doc))}


def _summed(batches):
    """A bucket's slices: the sums of each text; of each how many rows of sums name it, which is the number of equal rows."""
    keys: dict[int, np.ndarray] = {}
    parts: dict[int, list[np.ndarray]] = defaultdict(list)
    for batch in batches:
        for key, names, *data in zip(*(batch.column(f).to_pylist() for f in _SUM_FIELDS[1:]), strict=True):
            at = int.from_bytes(key, "little")
            parts[at].append(_summands(*data))
            if names:
                keys[at] = np.frombuffer(names, np.int64).reshape(-1, 2)
    for at, some in parts.items():
        if at not in keys:
            raise ValueError("the table's partitions hold other rows at the second read: write it before it is scored")
        all_, names = np.concatenate(some), keys[at]
        add = lambda c, t: np.bincount(all_["place"], all_[c], len(names)).astype(t)  # noqa: B023, E731
        m = np.bincount(all_["place"], all_["n_tokens"] > 0, len(names)).astype(np.int64)
        cols = [names[:, 0], names[:, 1], m, np.rint(add("n_tokens", float)).astype(np.int64), np.rint(add("n_known", float)).astype(np.int64), add("base", float), add("score", float)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "row2", "m", "n_tokens", "n_known", "base", "score"])


def _word_rows(batches, buckets: int):
    """Counts of rare words, packed by bucket."""
    for batch in batches:
        word, n = np.asarray(batch.column(0)).astype(U), np.asarray(batch.column(1))
        word = word | _NEW
        yield _batch([_row(b, _WORDS, x=word[here].tobytes(), c=n[here].tobytes()) for b, here in _grouped(bucket_of(mix(word), buckets))])


def _often(counted: DataFrame) -> int:
    """The count from which on, itself not included, there are at most FREQUENT words."""
    words, often = 0, 0
    for n, m in counted.where("n > 0").groupBy("n").agg(F.count("*")).orderBy(F.desc("n")).collect():  # of all tokens' number N: under sqrt(2 N) rows
        words += m
        if words > FREQUENT:
            often = n
            break
    return often


def _to_tasks(df: DataFrame, tasks: int) -> DataFrame:
    return df.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)))


def score_texts(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", tree: Tree = Tree()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of df.

    Tokens are the words (A-Z lowered) and one end. Counts are of all rows that aren't held out (a null held_out counts as no). base_score
    adds log10((c + 1) / (N + (V + 1))) over tokens; score is the tree's log10 probability of the token sequence, any unknown word being
    one token more than the V known ones. A null text is empty: its only token is the end. Whole texts are scored, however long. Repeated
    rows each get a row; other columns are left out; an empty table gives none. The table is read several times, each partition's rows in
    any order. Words and contexts are compared by 64-bit hashes.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    row, row2 = row_key(F.col("doc_id"), F.col("raw"))
    docs = texts(df, id_col, text_col, out).withColumn("row", row).withColumn("row2", row2)
    size = docs.agg(F.sum(F.octet_length("raw"))).head()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // PER_TASK))  # each knows something of each text: not more than are needed
    buckets = tasks * 16  # a task has sixteen, one after the other
    partly = arrow_map(docs.select("raw", "held_out"), lambda b: _counts(b, tasks), "bucket int, word binary, n binary")
    counted = written(arrow_map(_to_tasks(partly, tasks), _counted, "word long, n long"), "lm-words")
    total, v = counted.where("n > 0").agg(F.sum("n"), F.count("*")).head()
    total = total or 0
    often = _often(counted)
    cap = max(tree.wide, total // 1_000_000)  # so there are at most a million wide contexts
    tree = Tree(tree.least, tree.share, tree.divergence, tree.mu, cap)

    def table(rows) -> tuple[np.ndarray, np.ndarray]:
        key, n = np.asarray(rows.column(0), np.int64).astype(U), np.asarray(rows.column(1), np.int64)
        order = np.argsort(key)
        return key[order], n[order]

    word, count = table(counted.where(F.col("n") > often).toArrow())
    ends = int(count[_lookup(word, np.array([END]))][0]) if len(word) and _lookup(word, np.array([END]))[0] >= 0 else int((counted.where(F.col("word") == int(np.int64(END.astype(np.int64)))).agg(F.sum("n")).head()[0]) or 0)
    is_wide = (count > cap) & (word != END)
    w1, w1_n = word[is_wide], count[is_wide]
    if ends > cap:
        w1, w1_n = np.append(w1, START), np.append(w1_n, ends)
        order = np.argsort(w1)
        w1, w1_n = w1[order], w1_n[order]
    w2 = first = last = np.zeros(0, U)
    w2_n = np.zeros(0, np.int64)
    counts = []

    def following(keys: np.ndarray, level: int) -> DataFrame:
        held = spark.sparkContext.broadcast(keys)
        some = arrow_map(docs.select("raw", "held_out"), lambda b: _next_counts(b, held, level), "ctx long, x long, n long")
        return written(some.groupBy("ctx", "x").agg(F.sum("n").alias("n")), "lm-next")

    def kept(pairs: DataFrame, keys: np.ndarray, n: np.ndarray, level: int) -> DataFrame:
        size = spark.createDataFrame([(int(k), int(m)) for k, m in zip(keys.astype(np.int64), n, strict=True)], "ctx long, m long")
        some = pairs.join(F.broadcast(size), "ctx").where((F.col("n") >= 2) & (F.col("n") >= F.col("m") * tree.share))  # at most a million contexts
        some = some.join(counted.select(F.col("word").alias("x"), F.col("n").alias("c0")), "x")
        of = F.array_sort(F.collect_list(F.struct("x", "n", "c0")))  # at most 1 / share of them
        some = some.groupBy("ctx").agg(of.alias("e"))
        return size.join(some, "ctx", "left").select("ctx", F.lit(level).alias("level"), *[F.coalesce(F.col(f"e.{c}"), F.array().cast("array<long>")).alias(c) for c in ("x", "n", "c0")])

    if len(w1):
        pairs = following(w1, 1)
        counts.append(kept(pairs, w1, w1_n, 1))
        often_pairs = pairs.where(F.col("n") > cap).toArrow()  # fewer than total / cap
        a, b, n = (np.asarray(often_pairs.column(k), np.int64) for k in range(3))
        a, b = a.astype(U), b.astype(U)
        use = b != END
        if use.any():
            w2, first, last, w2_n = pair_of(a[use], b[use]), a[use], b[use], n[use]
            order = np.argsort(w2)
            w2, first, last, w2_n = w2[order], first[order], last[order], w2_n[order]
            counts.append(kept(following(w2, 2), w2, w2_n, 2))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(word), U)
    rank[order] = np.arange(len(word), dtype=U)
    known = spark.sparkContext.broadcast(Known(word, count, rank, count[order], w1, w1_n, w2, w2_n, first, last, total, int(v), ends, int(often), tree, buckets))
    # read twice: sorted, so that a task cuts the same slices however its rows come, also when it runs again
    source = docs.select("row", "row2", "raw", "held_out").sortWithinPartitions("row", "row2", "held_out")
    rare = arrow_map(source, lambda b: _questions(b, known, True), _SCHEMA)
    words = arrow_map(counted.where(F.col("n") <= often), lambda b: _word_rows(b, buckets), _SCHEMA)
    asked = arrow_map(source, lambda b: _questions(b, known, False), _SCHEMA)
    asked = asked.unionByName(arrow_map(_to_tasks(rare.unionByName(words), tasks), lambda b: _own_words(b, known), _SCHEMA))
    for more in counts:
        asked = asked.unionByName(arrow_map(more, lambda b: _told(b, known), _SCHEMA))
    sums = arrow_map(_to_tasks(asked, tasks), lambda b: _scored(b, known), "bucket int, " + ", ".join(f"{f} binary" for f in _SUM_FIELDS[1:]))
    found = written(arrow_map(_to_tasks(sums, tasks), _summed, "row long, row2 long, m long, n_tokens long, n_known long, base double, score double"), "lm-sums")
    # equal rows may be in several slices: their sums are added up
    found = found.groupBy("row", "row2").agg(*[F.sum(c).alias(c) for c in ("m", "n_tokens", "n_known", "base", "score")])
    ids = docs.select("doc_id", "held_out", "row", "row2")
    share = lambda c: F.col(c) / F.col("m")  # noqa: E731  equal rows have the sums of all
    return ids.join(found, ["row", "row2"]).select("doc_id", "held_out", share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("score").alias("score"))
