"""Benchmark passages in documents, also edited ones: CGK embedding, bit sampling, exact verification.

Words (without punctuation, in lower case) are the symbols. A CGK walk copies a sequence out step by step and goes on in it or stays,
by a random bit of the step and the symbol: sequences of small edit distance come out with small Hamming distance. Bit sampling hashes a
few steps of a walk; `walks` walks, each sampled `tables` times, find nearly all windows within the distance. Windows begin at every word
of every document, and at every word of an item that leaves room for one; they have the item's size up to the next lower one of SIZES,
so that a long item has many, of which some have few edits. Candidates are verified by exact edit distance over the whole item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, arrow_map, mix, runs, seeds, sliced, texts

_SIGNS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_CLEAN = bytes.maketrans(_SIGNS, b" " * len(_SIGNS))
#: Words of a window: the first for items of up to LONG words, the second for longer ones.
SIZES, LONG = (8, 16), 40
#: Items of fewer words are besides cut into one piece more than they may have edits: one piece is whole wherever the edits are.
SHORT = 12
CHUNK = 1 << 17


def plain(raw: bytes) -> bytes:
    """A-Z lowered, ASCII punctuation as white space."""
    return raw.translate(_CLEAN)


@dataclass(frozen=True)
class Search:
    """A window matches an item at max_edits of its words or fewer (insertions, deletions, replacements; rounded down).

    Recall is set by `walks` walks, `tables` samples of each and `bits` steps a sample; exact copies are always found. Items of fewer
    than min_words words are left out.
    """

    max_edits: float = 0.1
    min_words: int = 1
    walks: int = 2
    tables: int = 5
    bits: int = 7
    seed: int = 1


class Table:
    """The windows of one sample: their hashes in order, with item and offset, behind a filter of the upper bits."""

    def __init__(self, hash_: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.argsort(hash_, kind="stable")
        self.hash, self.item, self.offset = hash_[order], item[order].astype(np.int32), offset[order].astype(np.int32)
        self.shift = U(64 - min(24, max(16, int(64 * len(hash_)).bit_length())))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filter[self.hash >> self.shift] = True

    def find(self, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in hash_, item, offset) of all equal hashes."""
        some = np.flatnonzero(self.filter[hash_ >> self.shift])
        first, last = np.searchsorted(self.hash, hash_[some]), np.searchsorted(self.hash, hash_[some], "right")
        n = last - first
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else first
        return np.repeat(some, n), self.item[at], self.offset[at]


class Walks:
    """The walks of one window size, and which steps each sample takes."""

    def __init__(self, size: int, how: Search):
        self.size, self.steps = size, 2 * size
        rng = np.random.default_rng((how.seed, size))
        self.samples = [[np.sort(rng.choice(self.steps, min(how.bits, self.steps), replace=False)) for _ in range(how.tables)] for _ in range(how.walks)]
        self.salt = seeds(how.walks, how.seed + 100 * size)
        self.odd = seeds(how.tables * how.bits, how.seed + 7) | U(1)

    def hashes(self, words: np.ndarray, start: np.ndarray, reached: list | None = None):
        """(walk, sample, hash of each window) of the windows that begin at start; words goes on for self.steps words behind the last."""
        for walk, samples in enumerate(self.samples):
            wanted = {int(k) for s in samples for k in s}
            bits = mix(words ^ self.salt[walk])
            at, seen = start.copy(), {}
            for step in range(max(wanted) + 1):
                if step in wanted:
                    seen[step] = words[at]
                at += (bits[at] >> U(step) & U(1)).astype(at.dtype)
            if reached is not None:
                reached.append(at)
            for t, steps in enumerate(samples):
                h = np.zeros(len(start), U)
                for k, step in enumerate(steps):
                    h += seen[int(step)] * self.odd[t * len(steps) + k]
                yield walk, t, h ^ (h >> U(29))


class Items:
    """The benchmark, ready for search: word hashes of each item, its windows' samples, and whole hashes where no edit is allowed."""

    def __init__(self, ids: list, raws: list[bytes], how: Search):
        words = Words([plain(r) for r in raws], lower=True)
        keep = [k for k in range(len(ids)) if words.n[k] >= max(1, how.min_words)]
        self.ids = [ids[k] for k in keep]
        self.words = [words.hash[words.off[k] : words.off[k + 1]] for k in keep]
        self.sorted = [np.unique(w) for w in self.words]
        self.edits = [int(how.max_edits * len(w) + 1e-9) for w in self.words]
        exact = {k for k, e in enumerate(self.edits) if not e or len(self.words[k]) < SIZES[0]}
        self.walks, self.tables = {}, {}
        for size in SIZES:
            some = [k for k, w in enumerate(self.words) if k not in exact and (size == SIZES[1]) == (len(w) > LONG)]
            if not some:
                continue
            walks = self.walks[size] = Walks(size, how)
            pad = np.zeros(walks.steps, U)
            flat = np.concatenate([np.concatenate((self.words[k], pad)) for k in some])
            long = np.array([len(self.words[k]) for k in some])
            begin = np.cumsum(long + walks.steps) - long - walks.steps
            count = np.maximum(long - size, 0) + 1
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item, start = np.repeat(np.array(some), count), np.repeat(begin, count) + offset
            reached: list[np.ndarray] = []
            self.tables[size] = {(walk, t): Table(h, item, offset) for walk, t, h in walks.hashes(flat, start, reached)}
            inside = np.min([r for r in reached], axis=0) <= np.repeat(begin + long, count)
            exact |= set(some) - set(item[inside].tolist())  # none of whose walks stays within the item
        pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, words_ in enumerate(self.words):
            if self.edits[k] and len(words_) < SHORT:
                cut = [len(words_) * p // (self.edits[k] + 1) for p in range(self.edits[k] + 2)]
                for a, b in zip(cut, cut[1:]):
                    if b > a:
                        pieces[b - a].append((k, a, int(run_hash(words_[a:b], b - a)[0])))
        self.pieces = {n: Table(np.array([h for _, _, h in some], U), np.array([k for k, _, _ in some]), np.array([a for _, a, _ in some])) for n, some in pieces.items()}
        self.whole: dict[int, Table] = {}
        for n in sorted({len(self.words[k]) for k in exact}):
            some = [k for k in exact if len(self.words[k]) == n]
            self.whole[n] = Table(np.array([run_hash(self.words[k], n)[0] for k in some], U), np.array(some), np.zeros(len(some), np.int64))


def run_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    size = len(words) - n + 1
    out = np.zeros(max(size, 0), U)
    for k in range(n if size > 0 else 0):
        out += words[k : size + k] * U(0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1) | 1)
    return mix(out)


def window_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of a text that is nearest to an item (the first, and the shortest, of equals), if within `most`."""
    row = np.zeros(len(text) + 1, np.int64)
    start = np.arange(len(text) + 1)
    place = np.arange(len(text) + 1)
    for w in item:
        diagonal = row[:-1] + (text != w)
        cost, begin = row + 1, start.copy()  # the item's word left out
        better = diagonal <= cost[1:]
        cost[1:], begin[1:] = np.where(better, diagonal, cost[1:]), np.where(better, start[:-1], begin[1:])
        # a word of the text more: least of what is to the left, plus the way from there
        low = np.minimum.accumulate(cost - place)
        source = np.maximum.accumulate(np.where(cost - place == low, place, 0))
        row, start = low + place, begin[source]
    end = int(np.argmin(row))
    return (int(row[end]), int(start[end]), end) if row[end] <= most else None


def candidates(text: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, where it would begin) of all windows of a run of words whose sample equals one of an item's."""
    found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    for size, walks in items.walks.items():
        padded = np.concatenate((text, np.zeros(walks.steps, U)))
        for lo in range(0, len(text), CHUNK):
            hi = min(len(text), lo + CHUNK)
            for walk, t, h in walks.hashes(padded[lo : hi + walks.steps], np.arange(hi - lo)):
                at, item, offset = items.tables[size][walk, t].find(h)
                if len(at):
                    found.append(np.stack([item.astype(np.int64), at + lo - offset]))
    for n, table in [*items.whole.items(), *items.pieces.items()]:
        at, item, offset = table.find(run_hash(text, n))
        found.append(np.stack([item.astype(np.int64), at - offset]))
    item, begin = np.concatenate(found, 1)
    key = np.unique(item << 40 | begin + (1 << 39))
    item, begin = key >> 40, (key & (1 << 40) - 1) - (1 << 39)
    good = np.zeros(len(key), bool)
    cut = runs(item)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # the words that need no edit are all around there
        words, room = items.words[item[lo]], items.edits[item[lo]]
        known = items.sorted[item[lo]]
        span = np.arange(-room, len(words) + room)
        for at in range(lo, hi, 4096):
            value = text[np.clip(begin[at : min(hi, at + 4096), None] + span, 0, len(text) - 1)]
            good[at : min(hi, at + 4096)] = (known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value).sum(1) >= len(words) - room
    return item[good], begin[good]


def search(text: np.ndarray, off: np.ndarray, items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(document, item number) to (edits, start, end) of the item's best match; text holds the documents' word hashes one behind the other."""
    item, begin = candidates(text, items)
    size, room = (np.array([f(k) for k in range(len(items.ids))] or [0])[item] for f in (lambda k: len(items.words[k]), lambda k: items.edits[k]))
    middle = np.clip(begin + size // 2, 0, max(len(text) - 1, 0))
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    spans: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
    for doc in {0, 1}:  # a window across a border belongs to either side
        near = np.searchsorted(off, middle if not doc else np.clip(begin, 0, max(len(text) - 1, 0)), "right") - 1
        for k, d, b, n, r in zip(item.tolist(), near.tolist(), begin.tolist(), size.tolist(), room.tolist(), strict=True):
            spans[d, k].append([max(int(off[d]), b - r), min(int(off[d + 1]), b + n + r)])
    for (d, k), some in spans.items():
        merged: list[list[int]] = []
        for a, b in sorted(some):  # overlapping windows are verified together
            if b - a < len(items.words[k]) - items.edits[k]:
                continue
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        best = None
        for a, b in merged:
            got = window_distance(items.words[k], text[a:b], items.edits[k])
            if got is not None and (best is None or (got[0], got[1] + a - off[d]) < best[:2]):
                best = (got[0], int(got[1] + a - off[d]), int(got[2] + a - off[d]))
        if best is not None:
            found[d, k] = best
    return found


def _matches(raws: list[bytes], items: Items):
    words = Words([plain(r) for r in raws], lower=True)
    return search(words.hash, words.off, items) if len(words.hash) else {}


def _search(batches, items):
    items = items.value
    for batch in batches:
        rows: list[tuple] = []
        for some, raws in sliced(list(range(batch.num_rows)), [r or b"" for r in batch.column(1).to_pylist()]):
            rows += [(some[d], items.ids[k], *m, len(items.words[k])) for (d, k), m in sorted(_matches(raws, items).items())]
        of = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6)]], names=["doc_id", "item_id", "edits", "start", "end", "item_words"])


def _clean(batches, items):
    items = items.value
    for batch in batches:
        good = np.ones(batch.num_rows, bool)
        for some, raws in sliced(list(range(batch.num_rows)), [r or b"" for r in batch.column(0).to_pylist()]):
            for d, _ in _matches(raws, items):
                good[some[d]] = False
        yield batch.select([1]).filter(pa.array(good))


def _parts(benchmark: DataFrame, how: Search, item_col: str, item_text: str, most_bytes: int):
    """The benchmark as broadcasts of most_bytes of text at most (about; a longer item is one)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("binary").alias("raw")).where("raw is not null")
    size = items.agg(F.sum(F.octet_length("raw"))).head()[0] or 0
    parts = max(1, -(-size // most_bytes))
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("id", "raw"), F.lit(parts)) == part).orderBy("id", "raw").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r.id for r in some], [bytes(r.raw) for r in some], how))


def find_leaks(df: DataFrame, benchmark: DataFrame, how: Search = Search(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, edits, start, end, item_words): documents with benchmark items that they hold within how.max_edits.

    A row for each document and item: the nearest window (words start to end - 1, counted without punctuation), its word edits. Equal items
    each get rows, as do repeated documents. Null and empty texts match nothing; null items and items without words are left out; other
    columns are ignored; an empty table on either side gives no rows. Whole texts are searched, however long. The benchmark is broadcast;
    its size is checked, and a larger one is searched for in parts of most_bytes, each over all documents.
    """
    out = None
    for held in _parts(benchmark, how, item_col, item_text, most_bytes):
        found = arrow_map(texts(df, id_col, text_col), lambda b, held=held: _search(b, held), f"doc_id {dict(df.dtypes)[id_col]}, item_id long, edits long, start long, end long, item_words long")
        out = found if out is None else out.union(found)
    return out


def without_leaks(df: DataFrame, benchmark: DataFrame, how: Search = Search(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_bytes: int = 4 << 20, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of df that hold no benchmark item, as find_leaks finds them; all columns (or those named) stay as they are."""
    columns = list(columns or df.columns)
    for held in _parts(benchmark, how, item_col, item_text, most_bytes):
        row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
        source = df.select(F.col(f"`{text_col}`").cast("binary").alias("raw"), row)
        df = arrow_map(source, lambda b, held=held: _clean(b, held), f"row {dict(source.dtypes)['row']}").select("row.*")
    return df
