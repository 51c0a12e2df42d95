"""Alignment of two tokenizers over the same texts: groups between common token ends, links of overlapping tokens, counts of id pairs.

Both tokenizers break before white space that follows something else (but for what single pieces hold), so a text is a chain of chunks ("white space, then a word") that
are encoded, and aligned, each for itself; a worker remembers the chunks it has met.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import AT_END, arrow_map, runs, sliced, texts, written
from .pieces import SPACE

#: Characters of a text that are cut into chunks at a time.
_STRETCH = 1 << 19


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones of Latin-1 themselves, others 256 and on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def merge_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, whether both end there) of each link, in order, for the ascending ends of two sequences of tokens over the same bytes.

    The two are merged: between any two neighbouring ends, of either, lies one token of each, and every overlapping pair of tokens has one
    such stretch.
    """
    ends = np.union1d(a, b)
    at_a, at_b = np.searchsorted(a, ends), np.searchsorted(b, ends)
    return at_a, at_b, a[at_a] == b[at_b]


def group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each group begins) of groups written `a1,a2|b1;a3|b2,b3;`: ids and the ascending groups that they lie in."""
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)  # behind all of b in earlier groups
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    n = len(a) + len(b)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[np.flatnonzero(np.diff(group_a, append=-1))]] = ord("|")
    mark[place_b[np.flatnonzero(np.diff(group_b, append=-1))]] = ord(";")
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
    start = np.concatenate(([0], np.cumsum(digits + 1)))
    out = np.empty(start[-1], np.uint8)
    out[start[1:] - 1] = mark
    for k in range(int(digits.max(initial=0))):
        some = np.flatnonzero(digits > k)
        out[start[some] + digits[some] - 1 - k] = ord("0") + ids[some] // 10**k % 10
    first = place_a[np.flatnonzero(np.diff(group_a, prepend=-1))]
    return out, np.concatenate((start[first], start[-1:]))


class Aligner:
    """Chunks of text under a byte-level tokenizer (a, a tokenizers file) and a piece vocabulary (b, a sentencepiece model).

    For chunk k: written[k] its groups as text, sizes[k] (tokens of a, of b, groups, links), whole[k] whether both give its bytes back,
    and pairs[off[k]:off[k + 1]], its links as a * size_b + b.
    """

    def __init__(self, a_path: str, b_path: str, most_bytes: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without a normaliser or a space before texts are read")
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # in a text their strings are plain text
        byte = _byte_characters()
        value = {t: bytes([byte[c] for c in t]) for t in said["model"]["vocab"]}
        self.bytes_a = [b""] * (max(said["model"]["vocab"].values()) + 1)
        for t, k in said["model"]["vocab"].items():
            self.bytes_a[k] = value[t]
        # where every merge makes the next id, the ids are the merges' ranks, and the faster library gives the same tokens
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        ranked = all(said["model"]["vocab"].get(x + y) == 256 + k for k, (x, y) in enumerate(merges))
        ranks = {v: k for k, v in enumerate(self.bytes_a) if k < 256 + len(merges)}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        n = self.size_b = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(n))]
        inner = {p[k : k + 2] for p in map(self.b.id_to_piece, range(n)) for k in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] for x in inner):
            raise ValueError("a piece goes on behind a space: texts can't be cut there")
        # white space that some piece has behind something else, such as the first half of a line end: no cut before it
        joined = "".join({re.escape(x[1]) for x in inner if x[1].isspace() and not x[0].isspace() and x[0] != SPACE})
        self.chunk = re.compile(rf"\s*\S+(?:[{joined}]\s*\S*)*|\s+" if joined else r"\s*\S+|\s+")
        self.cut = re.compile(rf"\S(?=[^\S{joined}])")
        self.width_a, self.width_b = (np.array([len(v) for v in x]) for x in (self.bytes_a, self.bytes_b))
        self.guard = len(self.b.encode("a"))  # what stands before a chunk keeps the mark of a text's beginning away
        self.most_bytes = most_bytes
        self.used = False
        self.forget()
        AT_END.append(self.rest)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.written: list[bytes] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.whole = np.zeros(0, bool)
        self.pairs, self.off = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.held = 0

    def rest(self) -> None:
        """What the next partition of the same work may use stays; another kind of work lets it go."""
        if not self.used:
            self.forget()
        self.used = False

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row. A very long word goes to the library whose merges don't take the square of its length."""
        plain = self.fast is not None and max(map(len, text.split()), default=0) < 2000
        a = self.fast.encode_ordinary(text) if plain else self.a.encode(text, add_special_tokens=False).ids
        return np.array(a, np.int64), np.array(self.b.encode("a" + text)[self.guard :], np.int64)

    def _tokens(self, chunks: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """(chunks, their ends in bytes, and of each side ids) of the chunks that both tokenizers give back; encoded in a row, by halves where
        that fails."""
        text = "".join(chunks)
        data = text.encode()
        a, b = self._ids(text)
        ends = np.cumsum([len(c.encode()) for c in chunks])
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        good = b"".join([self.bytes_a[k] for k in a.tolist()]) == data and b"".join([self.bytes_b[k] for k in b.tolist()]) == data
        if good and np.isin(ends, ends_a).all() and np.isin(ends, ends_b).all():
            return [(chunks, ends, a, b)]
        if len(chunks) == 1:
            return []
        half = len(chunks) // 2
        return self._tokens(chunks[:half]) + self._tokens(chunks[half:])

    def _learn(self, new: list[str]) -> None:
        # a chunk that ends in white space, a text's last, would run on into the next one's
        alone = [c for c in new if c[-1].isspace()]
        rest = [c for c in new if not c[-1].isspace()]
        blocks = [*([c] for c in alone), *(rest[k : k + 1000] for k in range(0, len(rest), 1000))]
        known = set()
        for block in blocks:
            for chunks, ends, a, b in self._tokens(block):
                self._keep(chunks, ends, a, b)
                known.update(chunks)
        if bad := [c for c in new if c not in known]:
            for c in bad:
                self.place[c] = len(self.written)
                self.written.append(b"")
                self.held += 300 + len(c)
            self.sizes = np.concatenate([self.sizes, np.zeros((len(bad), 4), np.int64)])
            self.whole = np.concatenate([self.whole, np.zeros(len(bad), bool)])
            self.off = np.concatenate([self.off, np.full(len(bad), self.off[-1])])

    def _keep(self, chunks: list[str], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """What is remembered of chunks in a row, for all of them at once."""
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        at_a, at_b, both = merge_ends(ends_a, ends_b)
        common = ends_a[at_a[both]]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        text, begins = group_texts(a, b, group_a, group_b)
        last = np.searchsorted(common, ends)  # each chunk ends where a group does
        cuts = np.concatenate(([0], begins[last + 1])).tolist()
        data = text.tobytes()
        base = len(self.written)
        self.place.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.written.extend([data[x : y - 1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
        counts = [np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (ends_a, ends_b, common, np.minimum(ends_a[at_a], ends_b[at_b]))]
        self.sizes = np.concatenate([self.sizes, np.stack(counts, 1)])
        self.whole = np.concatenate([self.whole, np.ones(len(chunks), bool)])
        self.pairs = np.concatenate([self.pairs, a[at_a] * self.size_b + b[at_b]])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(counts[3])])
        self.held += 300 * len(chunks) + int(ends[-1]) + len(data) + 8 * len(at_a)

    def stretches(self, text: str) -> Iterator[str]:
        """The text behind a space in stretches of whole chunks."""
        text = " " + text
        at = 0
        while at < len(text):
            cut = self.cut.search(text, at + _STRETCH) if at + _STRETCH < len(text) else None
            to = cut.end() if cut else len(text)
            yield text[at:to]
            at = to

    def chunks(self, texts: list[str]) -> list[np.ndarray]:
        """For each stretch the places of its chunks; what was remembered may go first, so places hold until the next call."""
        self.used = True
        if self.held > self.most_bytes:
            self.forget()
        cut = [self.chunk.findall(t) for t in texts]
        place = self.place
        if new := {c for chunks in cut for c in chunks if c not in place}:
            self._learn(list(new))
        return [np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks)) for chunks in cut]

    def links(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, how often) of chunks, each pair once."""
        seen, often = np.unique(places, return_counts=True)
        n = self.off[seen + 1] - self.off[seen]
        at = np.repeat(self.off[seen] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return summed(self.pairs[at], np.repeat(often, n))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = runs(keys)[:-1] if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(counts[order], cut) if len(keys) else counts[:0]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    return _ALIGNERS.get(paths) or _ALIGNERS.setdefault(paths, Aligner(*paths))


def _parted(aligner: Aligner, raws: list[bytes]) -> Iterator[list[tuple[int, bool, np.ndarray]]]:
    """Lists of (which text, whether that is its end, places of chunks), in order: small texts together, a large one in stretches. A list's
    places hold until the next list is asked for."""
    small: list[tuple[int, str]] = []

    def together():
        places = aligner.chunks([" " + t for _, t in small])
        done = [(k, True, p) for (k, _), p in zip(small, places, strict=True)]
        small.clear()
        return done

    for k, raw in enumerate(raws):
        text = raw.decode("utf-8", "replace")
        if len(text) <= _STRETCH:
            small.append((k, text))
            continue
        yield together()
        parts = list(aligner.stretches(text))
        for i, part in enumerate(parts):
            yield [(k, i == len(parts) - 1, aligner.chunks([part])[0])]
    yield together()


def _align(batches, paths: tuple[str, str], digests: bool, arrow: pa.Schema):
    aligner = _aligner(paths)
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for ids, raws in sliced(batch.column(0).to_pylist(), [r or b"" for r in batch.column(1).to_pylist()]):
            done: list[tuple] = []
            whole, sums, made, links = True, np.zeros(4, np.int64), None, []
            for k, last, places in (x for group in _parted(aligner, raws) for x in group):
                whole = whole and bool(raws[k]) and bool(aligner.whole[places].all())
                if whole:
                    sums += aligner.sizes[places].sum(0)
                    text = b";".join(map(aligner.written.__getitem__, places.tolist()))
                    if made is None:
                        made = hashlib.sha256(text) if digests else [text]
                    elif digests:
                        made.update(b";" + text)
                    else:
                        made.append(text)
                    links.append(aligner.links(places))
                if last:
                    if whole:
                        keys, often = links[0] if len(links) == 1 else summed(*(np.concatenate(x) for x in zip(*links)))
                        done.append((*sums.tolist(), made.hexdigest() if digests else b";".join(made).decode(), keys.astype("<u8").tobytes(), often.astype("<u4").tobytes()))
                    else:
                        done.append((0, 0, 0, 0, "", b"", b""))
                    whole, sums, made, links = True, np.zeros(4, np.int64), None, []
            cols = [pa.array(range(row, row + len(ids)), pa.int64()), pa.array(ids, arrow.field(1).type), *(pa.array([d[i] for d in done], arrow.field(i + 2).type) for i in range(7))]
            row += len(ids)
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)


def aligned_texts(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, keys, often) as a table: each text once; keys and often are its distinct links
    (a * size of b + b) and how often it has each, packed."""
    paths = (a_path, b_path)
    schema = f"row long, doc_id {dict(df.dtypes)[id_col]}, n_a long, n_b long, n_groups long, n_links long, {'groups_sha256' if digests else 'groups'} string, keys binary, often binary"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return written(arrow_map(texts(df, id_col, text_col), lambda batches: _align(batches, paths, digests, arrow), schema), "aligned")


#: Pairs that a task counts before it hands them on.
_PAIRS = 1 << 21


def _count(batches):
    """The pairs of this task's texts with their counts."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        kinds = {"keys": "<u8", "often": "<u4"}
        held = [np.frombuffer(b"".join(batch.column(k).to_pylist()), kinds[n]).astype(np.int64) for k, n in enumerate(kinds)]
        keys, counts = summed(np.concatenate([keys, held[0]]), np.concatenate([counts, held[1]]))
        if len(keys) > _PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, n, best_a, best_b) as a table: how many links of all aligned texts join the two ids; whether no pair of its a (b) has more."""
    found = arrow_map(aligned.select("keys", "often"), _count, "pair long, n long")
    counts = written(found.groupBy("pair").agg(F.sum("n").alias("n")).select("pair", F.expr(f"cast(pair div {size_b} as int)").alias("a"), F.expr(f"cast(pair % {size_b} as int)").alias("b"), "n"), "pair-counts")
    most_a = counts.groupBy("a").agg(F.max("n").alias("most_a"))  # a row for each id of a vocabulary
    most_b = counts.groupBy("b").agg(F.max("n").alias("most_b"))
    joined = counts.join(F.broadcast(most_a), "a").join(F.broadcast(most_b), "b")
    return written(joined.select("pair", "a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b")), "pairs")


def _scored(batches, told, names: list[str]):
    """n_best and count_sum of the links that told has; rest and often, the others."""
    known, n, best = told.value
    empty = pa.array([], pa.int64())
    for batch in batches:
        packed = batch.column(batch.num_columns - 2).to_pylist()
        size = np.array([len(p) // 8 for p in packed], np.int64)
        keys = np.frombuffer(b"".join(packed), "<u8").astype(np.int64)
        often = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        there = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        cut = np.concatenate(([0], np.cumsum(size)))
        total = lambda x, cut=cut: np.diff(np.concatenate(([0], np.cumsum(x)))[cut])
        sums = total(np.where(there, often * n[at], 0)) if len(known) else np.zeros(len(size), np.int64)
        bests = total(np.where(there & best[at], often, 0)) if len(known) else np.zeros(len(size), np.int64)
        lacking = np.concatenate(([0], np.cumsum(total(~there)))).astype(np.int32)
        more = [pa.ListArray.from_arrays(pa.array(lacking), pa.array(x[~there]) if (~there).any() else empty) for x in (keys, often)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(bests), pa.array(sums), *more], names=names)


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, told: int = 1 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of df, with digests groups_sha256 instead of groups.

    Space + text is encoded by a, text by b (which adds the space); groups are written `a1,a2|b1;a3|b2,b3`. n_best: links whose pair is
    the most frequent one of its b id, ties included; count_sum: the counts of all links.

    Null and empty texts, and texts that one of the two doesn't give back byte by byte, have no tokens: zeros and ''. Null ids and equal
    rows stay, each with its row; an empty table stays empty; columns beside those named are left out. Texts are taken whole, in
    stretches of half a million characters; what a worker remembers of chunks is bounded in bytes.

    Each text is read once and its distinct links are kept, packed. They are counted within each task, and then by Spark; the most
    frequent pairs, `told` at most, go to all workers. Links of the others are joined by a shuffle, so the result doesn't depend on `told`.
    """
    import sentencepiece

    spark = df.sparkSession
    aligned = aligned_texts(df, a_path, b_path, id_col, text_col, digests)
    pairs = pair_counts(aligned, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    step = F.floor(4 * F.log2("n"))
    sizes = {r.step: r["count"] for r in pairs.groupBy(step.alias("step")).count().collect()}  # some 250 rows at most
    least, room = max(sizes, default=0) + 1, told
    for s in sorted(sizes, reverse=True):
        if (room := room - sizes[s]) < 0:
            break
        least = s
    known = pairs.where(step >= least).select("pair", "n", "best_b").toArrow().sort_by("pair")
    share = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "n", "best_b")))
    kept = [c for c in aligned.columns if c not in ("keys", "often")]
    schema = ", ".join(f"{c} {t}" for c, t in aligned.dtypes if c in kept) + ", n_best long, count_sum long, rest array<long>, times array<long>"
    found = arrow_map(aligned, lambda batches: _scored(batches, share, [*kept, "n_best", "count_sum", "rest", "times"]), schema)
    columns = [*kept[1:-1], "n_best", "count_sum", kept[-1]]
    if room >= 0:
        return found.select(columns)
    found = written(found, "scored")
    links = found.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
    more = links.join(pairs, "pair").groupBy("row").agg(F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum"))
    whole = found.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("sum", F.lit(0)))
    return whole.select(columns)
