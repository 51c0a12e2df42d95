import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tephra.llm import common, quality

from .conftest import words_text


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def base(text):
    w = plain_words(text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    repeated = len({j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)})
    lines = [x for x in (text or "").split("\n") if plain_words(x)]
    failed = len(w) < 20 or 100 * repeated > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated, failed


def test_base_columns_against_brute_force(spark, odd_docs, no_docs):
    extra = [(900, "a b c d e f g h " * 9), (901, "one two three four five six seven eight nine ten. " * 3 + "\n\nx\nx\n x\nx"), (902, "w " * 19), (903, " ".join(f"w{k}" for k in range(20)))]
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.assess(df).collect()), key=str)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=str)
    assert all(not r.kept for r in quality.assess(df).collect() if r.base_failed)
    assert quality.assess(no_docs).collect() == []


def test_lines_go_and_clean_documents_stay(spark):
    rng = random.Random(1)
    prose = "\n".join(words_text(rng, 14, 5000).capitalize() + "." for _ in range(8))
    bad = ["Home", "a | b | c | d | e", "Copyright (c) 2020 all rights reserved", "BUY!! NOW!! IT!! IS!! CHEAP!!", "te te te te te te te te", "x$$$ y%%% z*** w### v$$$", "if (x) {"]
    df = spark.createDataFrame([(1, prose), (2, prose + "\n" + "\n".join(bad)), (3, "\n".join(f"{b} {k}" for k, b in enumerate(bad * 4))), (4, prose + "\n" + prose.split("\n")[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert got[1].kept and got[1].cleaned == prose and got[2].kept and got[2].cleaned == prose and not got[3].kept
    assert got[4].cleaned == prose and got[4].n_dup_lines == 1


def verdict(text):
    """kept and cleaned, rule by rule and line by line, plainly."""
    rules, good = quality.QualityRules(), []
    n = len(plain_words(text or ""))
    seen = set()
    for line in (text or "").split("\n"):
        w = plain_words(line)
        if not w:
            good.append(line)
            continue
        again, low = line in seen and len(w) >= 3, "".join(c.lower() if c.isascii() else c for c in line)
        seen.add(line)
        inside = len(w) >= 10 and any(x + " " in line.strip(" \t\n\r\x0b\x0c") for x in ".!?…。！？।؟")
        ends = inside or bool(re.search(r"[.!?…。！？।؟][\"')\]”’»」]*[\x20\x09-\x0D]*$", line))
        notice = any(x in low for x in rules.notices)
        separators = line.count(" | ") + line.count(" > ") + line.count(" » ") + line.count(" / ")
        symbols = sum(c in "#*$%&|<>" for c in line)
        marks = line.count("!") + line.count("?")
        stutter = sum(a == b for a, b in zip(w, w[1:]))
        if again or not ends or notice or separators >= max(3, 0.2 * len(w)) or symbols > 0.5 * len(w) or marks > 0.5 * max(len(w), 4) or len(w) >= 6 and stutter > 0.3 * len(w):
            continue
        good.append(line)
    left = len(plain_words("\n".join(good)))
    return not base(text)[-1] and left >= max(0.6 * n, 20), "\n".join(good)


def test_verdict_against_brute_force(spark, odd_docs):
    rng = random.Random(6)
    line = lambda: rng.choice([
        words_text(rng, rng.randrange(1, 20), 5000) + rng.choice([".", "", "!", '."', "…", "?)", " .  "]), "Home", "a | b | c | d.", "Tous droits réservés.", "ALL RIGHTS reserved.",
        "te " * rng.randrange(1, 9) + "te.", "x$$$ y%%% z.", "wow! wow! wow!", "", "  ", "same line over here.",
    ])
    rows = [(k, "\n".join(line() for _ in range(rng.randrange(1, 14)))) for k in range(400)]
    rows += [(500, " ".join(f"w{k}" for k in range(30)) + ".\n" + " ".join(f"v{k}" for k in range(19))), (501, " ".join(f"w{k}" for k in range(25)) + ".\n" + " ".join(f"v{k}" for k in range(19)))]
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.kept, r.cleaned) for r in quality.assess(df).collect()), key=str)
    assert got == sorted(((r.doc_id, *verdict(r.text)) for r in df.collect()), key=str)
    assert 20 < sum(k for _, k, _ in got) < 380


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbzZ \t\n\x0b\x1c\x85é　日"), max_size=40), max_size=6))
def test_words_are_those_of_the_pattern(some):
    words = common.Words([t.encode() for t in some], lower=True)
    split = [plain_words(t) for t in some]
    assert words.n.tolist() == [len(w) for w in split]
    flat = [w.encode() for t in split for w in t]
    assert [words.word(k) for k in range(len(flat))] == flat
    assert len(set(words.hash.tolist())) == len({w.lower() for w in flat})
    gram, at = words.grams(3)
    want = [tuple(w.encode().lower() for w in t[i : i + 3]) for t in split for i in range(len(t) - 2)]
    assert len(gram) == len(want) and len(set(gram.tolist())) == len(set(want))


def test_long_texts_are_cut_at_white_space_only():
    block = common.BLOCK_BYTES
    raw = b"x" * (block + 5) + b" y " + b"z" * (2 * block) + b"\n" + b"ab " * block
    whole = common.Words([raw, b"x" * (block + 5)])
    assert whole.n.tolist() == [3 + block, 1] and whole.hash[0] == whole.hash[-1] and len(set(whole.hash.tolist())) == 4
