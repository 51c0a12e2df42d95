"""Token ids in binary files: every document is compressed alone with one shared zstandard dictionary.

File: MAGIC, a header (id width in bytes, SHA-256 of the dictionary), the documents' frames, an index (doc ids, null flags, frame
offsets, token counts as little-endian arrays), and a footer (place of the index, number of documents, MAGIC). Any document is read with
two seeks. The dictionary lies beside the files as dictionary-<SHA-256>.zdict.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT_END, arrow_map, open_file, shuffle_partitions, sliced, texts, work_path, write_file, written

MAGIC = b"TPHTOK01"
_HEAD = struct.Struct("<8sI32s")
_FOOT = struct.Struct("<QQ8s")


class WordEncoder:
    """Ids of a tokenizer that drops white space, by word: white space never joins two words' tokens, so a word's ids are looked up.

    At most `most` words (some 200 bytes each) are kept; then the table starts anew, which changes no result. ASCII capitals are lowered first (the tokenizer
    lowers them anyway), except where a special token's string could arise.
    """

    def __init__(self, path: str, dtype: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.most, self.known = Tokenizer.from_file(path), dtype, most, {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        self.last[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.used = False
        AT_END.append(self.rest)

    def rest(self) -> None:
        """What the next partition of the same work may use stays; another kind of work lets it go."""
        if not self.used:
            self.known.clear()
        self.used = False

    @staticmethod
    def _words(raw: bytes) -> list[bytes]:
        return raw.split() if b"<|" in raw else raw.lower().split()

    @staticmethod
    def _letters(word: bytes) -> bool:
        return word.isalpha() or (s := word.decode()).isalpha() and s.lower().isalpha() and max(s) < "ɐ"

    def _learn(self, new: set[bytes]) -> None:
        """A plain word with one end mark is two pre-tokens: the word's ids, then the mark's."""
        known, whole, ended = self.known, set(), []
        for w in new:
            core, mark = w[:-1], w[-1:]
            if mark in (b".", b",", b"!", b"?", b";", b":") and core and self._letters(core):
                ended.append((w, core, mark))
                whole.update(x for x in (core, mark) if x not in known)
            else:
                whole.add(w)
        # words of letters alone are a pre-token each, so that many go through the library in a row and are told apart by their last tokens
        letters = [w for w in whole if self._letters(w)]
        for at in range(0, len(letters), 500):
            some = letters[at : at + 500]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                known.update((w, x.tobytes()) for w, x in zip(some, np.split(ids, ends[:-1]), strict=True))
        todo = [w for w in whole if w not in known]
        for w, e in zip(todo, self.tokenizer.encode_batch_fast([w.decode() for w in todo], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, self.dtype).tobytes()
        for w, core, mark in ended:
            known[w] = known[core] + known[mark]

    def encode(self, raws: list[bytes], end_id: int) -> list[bytes]:
        """Each text's ids and the end id as little-endian integers."""
        self.used = True
        split = [self._words(r) for r in raws]
        if len(self.known) > self.most:
            self.known.clear()
        new: set[bytes] = set()
        for words in split:
            new.update(words)
        if new := new.difference(self.known):
            self._learn(new)
        get, end = self.known.__getitem__, np.array([end_id], self.dtype).tobytes()
        return [b"".join(map(get, words)) + end for words in split]


#: Of this worker: its tasks share the words that they have learnt.
_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


@dataclass(frozen=True)
class TokenStore:
    """Where the files are and what each holds: (part, uri, documents, tokens), in ascending order of doc_id."""

    folder: str
    dictionary: str
    files: list[tuple[int, str, int, int]]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: its bytes serve as they are
        return b"".join(samples)[:size] or b"\0" * 8


def _write(batches, tokenizer_path: str, width: str, end_id: int, trained: bytes, folder: str, level: int):
    """A partition's documents as one file; yields its row of the manifest."""
    part = TaskContext.get().partitionId()
    encoder = _ENCODERS.get((tokenizer_path, width)) or _ENCODERS.setdefault((tokenizer_path, width), WordEncoder(tokenizer_path, width))
    squeeze = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(trained))
    ids, counts, sizes = [], [], []
    uri = f"{folder}/part-{part:06d}.tok"

    def fill(out):
        out.write(_HEAD.pack(MAGIC, int(width[-1]), hashlib.sha256(trained).digest()))
        for batch in batches:
            for some, raws in sliced(batch.column(0).to_pylist(), [r or b"" for r in batch.column(1).to_pylist()]):
                for doc, data in zip(some, encoder.encode(raws, end_id), strict=True):
                    frame = squeeze.compress(data)
                    out.write(frame)
                    ids.append(doc)
                    counts.append(len(data) // int(width[-1]))
                    sizes.append(len(frame))
        at = _HEAD.size + sum(sizes)
        out.write(np.array([d or 0 for d in ids], "<i8").tobytes() + np.array([d is None for d in ids], "<u1").tobytes())
        out.write((_HEAD.size + np.cumsum([0, *sizes])).astype("<u8").tobytes() + np.array(counts, "<u8").tobytes())
        out.write(_FOOT.pack(at, len(ids), MAGIC))

    write_file(uri, fill)
    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "docs": pa.array([len(ids)], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64())})


def write_tokens(
    df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, sample_docs: int = 2000, dictionary_bytes: int = 65536, level: int = 3
) -> TokenStore:
    """Write every text's ids (and end_id after each) in ascending order of doc_id; nulls first, equal ids by text.

    A null or empty text has only the end id. Extra columns are ignored. An empty table gives no files. Whole texts are written, however
    long. Ids are integers (others raise: the index holds 8 bytes for each). The dictionary, which changes how well frames compress and
    nothing else, is trained on sample_docs documents at most (those of the smallest hash), of each 16 KiB of text from any place.
    """
    spark = df.sparkSession
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} is no column of integers")
    folder = folder or work_path(spark, "tokens")
    docs = texts(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    # first the hashes alone, then the texts of those below the bound: no task sends the driver more than it needs
    least = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample_docs)
    bound = least.agg(F.max("h")).head()[0]
    sample = docs.where(F.xxhash64("doc_id") <= F.lit(bound if bound is not None else 0)).select(F.expr("substring(raw, cast(1 + pmod(xxhash64(raw), greatest(octet_length(raw) - 16384, 0) + 1) as int), 16384)").alias("raw")).limit(sample_docs)
    encoder = WordEncoder(tokenizer_path, width)
    trained = _dictionary([x[:16384] for x in encoder.encode([(r.raw or b"").decode("utf-8", "ignore").encode() for r in sample.collect()], end_id)], dictionary_bytes)
    digest = hashlib.sha256(trained).hexdigest()
    write_file(f"{folder}/dictionary-{digest}.zdict", lambda out: out.write(trained))
    ordered = docs.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "raw")

    manifest = written(arrow_map(ordered, lambda batches: _write(batches, tokenizer_path, width, end_id, trained, folder, level), "part int, uri string, docs long, tokens long"), "token-manifest")
    return TokenStore(folder, digest, sorted(tuple(r) for r in manifest.collect() if r.docs))  # a row for each file


class TokenFile:
    """One file, opened: its index, and any document's ids by its place."""

    def __init__(self, uri: str, trained: bytes | None = None):
        self.file = open_file(uri)
        magic, self.width, digest = _HEAD.unpack(self.file.read(_HEAD.size))
        end = self.file.seek(0, 2)
        self.file.seek(end - _FOOT.size)
        at, n, last = _FOOT.unpack(self.file.read(_FOOT.size))
        if magic != MAGIC or last != MAGIC:
            raise ValueError(f"{uri} is no token file, or is cut off")
        if trained is None:
            with open_file(f"{uri.rsplit('/', 1)[0]}/dictionary-{digest.hex()}.zdict") as f:
                trained = f.read()
        if hashlib.sha256(trained).digest() != digest:
            raise ValueError(f"{uri} was written with another dictionary")
        self.file.seek(at)
        index = self.file.read(end - _FOOT.size - at)
        null = np.frombuffer(index, "<u1", n, 8 * n)
        self.ids = [None if z else int(d) for d, z in zip(np.frombuffer(index, "<i8", n), null, strict=True)]
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.counts = np.frombuffer(index, "<u8", n, 9 * n + 8 * (n + 1))
        self.expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, k: int) -> np.ndarray:
        self.file.seek(int(self.offsets[k]))
        return np.frombuffer(self.expand.decompress(self.file.read(int(self.offsets[k + 1] - self.offsets[k]))), f"<u{self.width}").astype("<u4")


def _read(batches, value, name: str, arrow: pa.DataType):
    for batch in batches:
        for uri, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            held = TokenFile(uri)
            for lo in range(0, len(held), 2000):
                hi = min(len(held), lo + 2000)
                made = [held.read(k) for k in range(lo, hi)]
                counts = np.array([len(x) for x in made], np.int64)
                starts = at + np.concatenate(([0], np.cumsum(counts)[:-1]))
                at += int(counts.sum())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(held.ids[lo:hi], pa.int64()), "start": starts, "n_tokens": counts, name: pa.array([value(x) if value else x for x in made], arrow)})


def read_tokens(spark: SparkSession, store: TokenStore, value: Callable[[np.ndarray], object] | None = None, column: str = "ids array<long>") -> DataFrame:
    """(doc_id, start, n_tokens, column): read back from the files; start counts the ids of all documents before it, in the files' order.

    value makes the column from a document's ids (by default the ids themselves).
    """
    base, rows = 0, []
    for part, uri, docs, tokens in store.files:
        rows.append((part, uri, base))
        base += tokens
    name, kind = column.split(" ", 1)
    schema = f"doc_id long, start long, n_tokens long, {column}"
    arrow = {"array<long>": pa.list_(pa.int64()), "long": pa.int64(), "string": pa.string()}[kind]
    files = spark.createDataFrame(rows, "part int, uri string, base long").repartition(max(1, len(rows)))
    return arrow_map(files, lambda batches: _read(batches, value, name, arrow), schema)
