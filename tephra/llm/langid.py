"""Language identification by bit-sliced Bloom filters of n-grams.

One table of words, each with a bit for every language, is all languages' Bloom filters at once: the bitwise and of an n-gram's K words
has the bits of the languages that (seem to) contain it. A text's bits are counted language by language, the counts are freed of the
false positives to be expected of each language's filter, and the largest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, arrow_map, mix, runs, texts

K = 3
MOST_LANGUAGES = 10_000
NONE = "und"


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER


_LETTER: np.ndarray | None = None


def grams(text: str) -> np.ndarray:
    """The text's runs of 2 and 3 characters as numbers: lower case, everything but letters a single space; none without a letter."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, U)
    code = np.where(letter, code, 32)[letter | np.concatenate(([True], letter[:-1]))].astype(U)
    two = code[:-1] | code[1:] << U(21)
    return np.concatenate((two, two[:-1] | code[2:] << U(42)))


@dataclass(frozen=True)
class LanguageFilters:
    """table: 2^bits rows of as many words as the languages need bits for (one byte for up to eight languages)."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def build(languages: list[str], gram: np.ndarray, lang: np.ndarray, least_bits: int = 16, most_bytes: int = 1 << 27) -> LanguageFilters:
        """From pairs of n-gram and language number. About 16 rows an n-gram, up to most_bytes; beyond that the false positives grow and
        are still allowed for."""
        kind, wide = (np.uint8, 8) if len(languages) <= 8 else (U, 64)
        words = max(1, -(-len(languages) // wide))
        most = int(np.log2(most_bytes / (words * wide // 8)))
        bits = min(most, max(least_bits, int(np.ceil(np.log2(16 * max(len(np.unique(gram)), 1))))))
        table = np.zeros((1 << bits, words), kind)
        bit = np.left_shift(np.ones(len(lang), kind), (lang % wide).astype(kind))
        for k in range(K):
            np.bitwise_or.at(table, (LanguageFilters._places(gram, k, bits), lang // wide), bit)
        fill = np.array([np.mean(table[:, b // wide] >> kind(b % wide) & kind(1)) for b in range(len(languages))])
        return LanguageFilters(languages, table, fill**K)

    @staticmethod
    def _places(gram: np.ndarray, k: int, bits: int) -> np.ndarray:
        return (mix(gram + U(k * 0x3C6EF372FE94F82B & (2**64 - 1))) >> U(64 - bits)).astype(np.int64)

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits of a row of words."""
        bits = len(self.table).bit_length() - 1
        out = self.table[self._places(gram, 0, bits)]
        for k in range(1, K):
            out &= self.table[self._places(gram, k, bits)]
        return out

    def predict(self, text: str, piece: int = 1 << 20) -> tuple[str, float]:
        """The language of the largest corrected count (the first by name of equals) and its part of all counts; NONE and 0 without letters.

        A long text is counted in pieces, so that its n-grams are never in memory together; two characters join one piece to the next.
        """
        hits, total = np.zeros(len(self.languages)), 0
        kind = self.table.dtype.type
        wide = 8 * self.table.dtype.itemsize
        for gram in text_grams(text, piece):
            total += len(gram)
            if not self.languages:
                continue
            found = self.masks(gram)
            hits += [np.count_nonzero(found[:, b // wide] & kind(1 << b % wide)) for b in range(len(hits))]
        if not total or not self.languages:
            return NONE, 0.0
        counts = np.maximum(0, (hits - total * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9))
        best, all_ = int(np.argmax(counts)), counts.sum()
        return self.languages[best], float(counts[best] / all_) if all_ > 0 else 0.0


def text_grams(text: str, piece: int = 1 << 20):
    """The n-grams of a text, piece by piece. Pieces are cut before a white space; of a million characters one n-gram, that of two letters
    on both sides of such a space, isn't counted."""
    at = 0
    while at < len(text):
        to = at + piece
        while to < len(text) and not text[to].isspace():
            to += 1
        yield grams(text[at:to])
        at = to


def _count(batches, languages: list[str]):
    index = {x: k for k, x in enumerate(languages)}
    for batch in batches:
        key = []
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, n = np.unique(grams((raw or b"").decode()), return_counts=True)
            key.append((found, n, np.full(len(found), index[lang], np.int32)))
        gram, n, lang = (np.concatenate(c) for c in zip(*key, strict=True))
        order = np.lexsort((lang, gram))
        gram, n, lang = gram[order], n[order], lang[order]
        cut = runs(gram << U(0) ^ mix(lang.astype(U)))
        yield pa.RecordBatch.from_pydict({"gram": gram[cut[:-1]].astype(np.int64), "lang": lang[cut[:-1]], "n": np.add.reduceat(n, cut[:-1]) if len(gram) else n})


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 4000, least: int = 3, part: float = 0.2) -> LanguageFilters:
    """Filters from the labelled rows of df: about docs_per_language rows of each language (those of the smallest hashes), whole texts.

    A language contains an n-gram that it has `least` times or more and, for its length, at least `part` times as often as the language
    that has it most. Rows without label or text are passed over; without any row the filters know no language. Any number of languages;
    over MOST_LANGUAGES, more than a driver holds counts of, raise.
    """
    known = df.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("raw")).where("lang is not null and raw is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return LanguageFilters([], np.zeros((1, 1), np.uint8), np.zeros(0))
    share = df.sparkSession.createDataFrame([(x, docs_per_language / counts[x]) for x in languages], "lang string, share double")
    some = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("raw", F.lit(5)), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "raw")
    told = arrow_map(some, lambda b: _count(b, languages), "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    rows = told.where(F.col("n") >= least).toArrow()
    gram, lang, n = (np.asarray(rows.column(k)) for k in range(3))
    rate = n / np.maximum(np.bincount(lang, n, len(languages)), 1)[lang]
    order = np.argsort(gram, kind="stable")
    gram, lang, rate = gram[order].astype(U), lang[order], rate[order]
    cut = runs(gram)
    top = np.repeat(np.maximum.reduceat(rate, cut[:-1]), np.diff(cut)) if len(gram) else rate
    held = rate >= part * top
    return LanguageFilters.build(languages, gram[held], lang[held].astype(np.int64))


def _predict(batches, filters):
    for batch in batches:
        found = [filters.value.predict(r.decode() if r else "") for r in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of df; filters are trained on the labelled rows that aren't held out.

    A prediction uses the whole text alone. lang_pred is "und" (score 0) for null texts, texts without a letter, and if nothing could be
    learnt. A null id is held out or not as the expression says (null: no). Other columns are left out; an empty table stays empty.
    """
    out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    filters = df.sparkSession.sparkContext.broadcast(train(df.where(~out), text_col, lang_col, **how))  # 2^24 words at most
    kind = dict(df.dtypes)[id_col]
    return arrow_map(texts(df, id_col, text_col, out), lambda b: _predict(b, filters), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
