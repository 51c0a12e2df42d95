"""Quality rules, line first: bad lines go, then documents that lost too much text or fail the base rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, arrow_map, runs, sliced, texts

#: What ends a sentence, and what may stand behind it.
END_MARKS = tuple(m.encode() for m in (".", "!", "?", "…", "。", "！", "？", "।", "؟"))
CLOSING = tuple(m.encode() for m in ('"', "'", ")", "]", "”", "’", "»", "」"))
INNER_MARKS = tuple(m + b" " for m in END_MARKS)
#: Words of notices in English, German, French and Spanish that are no part of a text (a parameter of the rules).
NOTICES = (
    "javascript", "lorem ipsum", "cookie policy", "cookies to", "cookies help", "all rights reserved", "copyright (c)", "terms of use", "terms of service",
    "privacy policy", "click here", "licensed under", "released under the", "spdx-license", "permission is hereby granted", "as is basis",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "lizenziert unter", "hier klicken",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "sous licence", "cliquez ici",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "bajo la licencia", "haga clic aquí",
)
SYMBOLS = b"#*$%&|<>"
SEPARATORS = (b" | ", b" > ", b" \xc2\xbb ", b" / ")


@dataclass(frozen=True)
class QualityRules:
    """Line rules: a line goes if it doesn't end a sentence (a menu, a heading, a table row, a list of tags, code; one of long_line words
    or more may break off, if a sentence ends within it), holds a notice (boilerplate), has over max_line_symbols symbols, max_separators separators or max_line_marks exclamation and question marks a word,
    over max_same_neighbours of its words equal to the word before, or repeats an earlier line of at least min_repeat_words words.
    Document rules: fewer than min_words words or over max_repeat_pct percent of words in repeated 8-word windows (the base rules); after
    the line rules less than min_left of the words left, or fewer than min_words."""

    min_words: int = 20
    window: int = 8
    max_repeat_pct: int = 30
    max_line_symbols: float = 0.5
    max_separators: float = 0.2
    max_line_marks: float = 0.5
    max_same_neighbours: float = 0.3
    min_repeat_words: int = 3
    min_left: float = 0.6
    long_line: int = 10
    notices: tuple[str, ...] = NOTICES


def ends_sentence(line: bytes, n_words: int, rules: QualityRules) -> bool:
    line = line.rstrip()
    if n_words >= rules.long_line and any(m in line for m in INNER_MARKS):
        return True
    while line.endswith(CLOSING):
        line = line[: -next(len(c) for c in CLOSING if line.endswith(c))]
    return line.endswith(END_MARKS)


def bad_line(line: bytes, n_words: int, rules: QualityRules, notice: re.Pattern[bytes]) -> bool:
    """Navigation, boilerplate, or symbols, marks and stutter instead of prose."""
    if not ends_sentence(line, n_words, rules) or notice.search(line.lower()):
        return True
    if sum(line.count(s) for s in SEPARATORS) >= max(3, rules.max_separators * n_words) or sum(line.count(s) for s in SYMBOLS) > rules.max_line_symbols * n_words:
        return True
    if line.count(b"!") + line.count(b"?") > rules.max_line_marks * max(n_words, 4):
        return True
    parts = line.split()
    return n_words >= 6 and sum(a == b for a, b in zip(parts, parts[1:])) > rules.max_same_neighbours * n_words


def may_have_bad_lines(raw: bytes, stutters: bool, notice: re.Pattern[bytes]) -> bool:
    """False only if no line that ends a sentence can fail bad_line: one look at the whole text instead of one at each line."""
    return stutters or any(c in raw for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!", b"?", b"\xc2\xbb", b" / ")) or bool(notice.search(raw.lower()))


def _repeated(words: Words, n: int) -> np.ndarray:
    """For each text, how many of its words lie in an n-word window that the text has twice or more."""
    covered = np.zeros(len(words.hash) + 1, np.int32)
    gram, at = words.grams(n)
    if len(gram):
        doc = words.doc()
        for lo in range(0, len(words.n), 256):  # the text takes 8 bits of the sort key
            a, b = np.searchsorted(at, (words.off[lo], words.off[min(lo + 256, len(words.n))]))
            key = (doc[at[a:b]] - lo).astype(U) << U(56) | gram[a:b] >> U(8)
            order = np.argsort(key)
            cut = runs(key[order])
            again = np.repeat(np.diff(cut) > 1, np.diff(cut))
            place = at[a:b][order[again]]
            np.add.at(covered, place, 1)
            np.add.at(covered, place + n, -1)
    inside = np.cumsum(covered[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(inside)))
    return total[words.off[1:]] - total[words.off[:-1]]


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_words_left long, kept boolean, cleaned string"


def judged(raw: bytes, n: int, repeat_words: int, stutters: bool, rules: QualityRules, notice: re.Pattern[bytes]) -> tuple:
    """The fields of one text of n words."""
    chars = len(b"".join(raw.split()).decode("utf-8", "replace"))
    failed = n < rules.min_words or 100 * repeat_words > rules.max_repeat_pct * n
    doubtful = may_have_bad_lines(raw, stutters, notice)
    seen: set[bytes] = set()
    good, left, dups = [], 0, 0
    for line in raw.split(b"\n"):
        m = len(line.split())
        if not m:
            good.append(line)
            continue
        again = line in seen
        dups += again
        seen.add(line)
        if again and m >= rules.min_repeat_words or (bad_line(line, m, rules, notice) if doubtful else not ends_sentence(line, m, rules)):
            continue
        good.append(line)
        left += m
    kept = not failed and left >= max(rules.min_left * n, rules.min_words)
    return n, chars, sum(raw.count(s) for s in SYMBOLS), dups, repeat_words, failed, left, kept, b"\n".join(good)


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules(), with_text: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left, kept[, cleaned][, carried]), a row for each row of df.

    cleaned is the text without the lines that fail a rule; carried holds the columns named in carry, as they are. A null text counts as
    an empty one: no words, base_failed, not kept. A null id stays null; equal rows each get a row; other columns of df are left out, so
    that none can clash; an empty table stays empty. Every text is judged whole, however long. Nothing is shuffled.
    """
    fields = FIELDS if with_text else FIELDS.removesuffix(", cleaned string")
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    source = texts(df, id_col, text_col, *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    notice = "|".join(re.escape(x) for x in rules.notices) or "(?!)"

    def run(batches):
        found = re.compile(notice.encode())
        for batch in batches:
            raws = [r or b"" for r in batch.column(1).to_pylist()]
            for part, some in sliced(list(range(batch.num_rows)), raws):
                words = Words(some)
                repeats = _repeated(words, rules.window).tolist()
                twice = np.concatenate(([0], np.cumsum(words.hash[1:] == words.hash[:-1]), [0]))[: len(words.hash) + 1]
                stutters = twice[np.maximum(words.off[1:] - 1, 0)] - twice[np.minimum(words.off[:-1], np.maximum(words.off[1:] - 1, 0))] > 1
                rows = [judged(raw, int(words.n[k]), repeats[k], stutters[k], rules, found) for k, raw in enumerate(some)]
                cols = [pa.array(c, kinds[f.split()[1]] if f != "cleaned string" else pa.binary()).cast(kinds[f.split()[1]]) for f, c in zip(fields.split(", "), zip(*rows, strict=True), strict=False)]
                held = [batch.column(k).take(pa.array(part)) for k in (0, *([2] if carry else []))]
                yield pa.RecordBatch.from_arrays([held[0], *cols, *held[1:]], names=["doc_id", *(f.split()[0] for f in fields.split(", ")), *(["carried"] if carry else [])])

    return arrow_map(source, run, "doc_id " + dict(df.dtypes)[id_col] + ", " + fields + (f", carried {dict(source.dtypes)['carried']}" if carry else ""))
