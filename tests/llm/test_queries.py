"""Every registered query over the smallest tables: against its SQL, or against the libraries and plain Python."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest

from tephra.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, text, lang from documents order by doc_id").fetchall()


def rows(spark, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in queries.queries()[name](spark, SF).collect()), key=str)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(spark, name, *columns) == sorted(want.fetchall(), key=str)


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, t, _ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert rows(spark, "op1_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_op2(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    coded = [(d, library.encode(t or "", add_eos=True)) for d, t, _ in docs]
    want = [(d, len(i), sha(" ".join(map(str, i))), sha(library.decode(i))) for d, i in coded]
    assert rows(spark, "op2_pieces", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_op3(spark, docs):
    got = {r[0]: r[1:] for r in rows(spark, "op3_language_id", "doc_id", "held_out", "lang_pred", "score")}
    assert len(got) == len(docs) and all(0 <= s <= 1 for _, _, s in got.values())
    for d, t, _ in docs:
        assert got[d][0] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert (got[d][1] == "und") == (not any(c.isalpha() for c in t or ""))
    held = [(d, x) for d, t, x in docs if got[d][0] and x and len(words(t)) > 20]
    assert sum(got[d][1] == x for d, x in held) >= 0.95 * len(held)


def test_op4(spark, docs):
    got = rows(spark, "op4_sharding", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    plain = {d: (t or "").encode() for d, t, _ in docs}
    assert sorted(r[0] for r in got) == sorted(plain)
    assert all((r[1], r[2], r[3], r[6]) == (len(plain[r[0]]) + 16, zlib.crc32(plain[r[0]]), "rows", None) for r in got)
    count = Counter(r[4] for r in got)
    assert set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r[5] for r in got if r[4] == s) == list(range(n)) for s, n in count.items())


def test_op7_finds_exact_copies(spark, duck, docs):
    plain = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t or "").lower().split()
    text = {d: f" {' '.join(plain(t))} " for d, t, _ in docs}
    items = duck.execute("select item_id, text from benchmark").fetchall()
    want = {(d, i) for i, x in items for d, t in text.items() if plain(x) and f" {' '.join(plain(x))} " in t}
    got = {(d, i): e for d, i, e in rows(spark, "op7_decontamination", "doc_id", "item_id", "edits")}
    assert want == {k for k, e in got.items() if e == 0} and want


def test_op8(spark, docs):
    import math

    low = lambda t: words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(x for d, t, _ in docs if not out(d) for x in [*low(t), None])
    n, v = sum(count.values()), len(count)
    got = {r[0]: r[1:] for r in rows(spark, "op8_suffix_tree_scores", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
    for d, t, _ in docs:
        c = [count[x] for x in [*low(t), None]]
        base = sum(math.log10((k + 1) / (n + v + 1)) for k in c)
        assert got[d][:4] == (out(d), len(c), sum(k > 0 for k in c), n) and got[d][4] == pytest.approx(base, rel=1e-7) and got[d][5] < 0


def test_op10(spark, docs):
    got = {r[0]: r[1:] for r in rows(spark, "op10_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
    for d, t, _ in docs:
        w = words(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = Counter(windows)
        repeated = len({j for i, x in enumerate(windows) if twice[x] > 1 for j in range(i, i + 8)})
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        assert got[d][:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeated, failed)
        assert not (failed and got[d][6])


def test_op11(spark, docs):
    from .test_alignment import brute

    found, _, _ = brute([t or "" for _, t, _ in docs])
    want = [(d, *f[:6], hashlib.sha256(f[6].encode()).hexdigest() if f[6] else "") for (d, _, _), f in zip(docs, found)]
    assert rows(spark, "op11_alignment", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == sorted(want, key=str)


def test_op12(spark, duck):
    from .test_codes import brute

    vectors = duck.execute(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall()
    coded, books = brute(vectors)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    label, total = {i: y for i, _, y in vectors}, Counter()
    for i, _, error in coded:
        total[label[i]] += error
    want = [(i, code, error, total[label[i]], sha) for i, code, error in coded]
    assert rows(spark, "op12_vector_codes", "vec_id", "code", "error", "label_error", "codebooks_sha256") == sorted(want, key=str)


def test_op13(spark, duck):
    from .test_neighbours import brute

    vectors = duck.execute(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    want, got = brute(vectors, 100), {}
    for q, rank, i, score in sorted(rows(spark, "op13_neighbours", "query_id", "rank", "vec_id", "score"), key=lambda r: r[:2]):
        got.setdefault(q, []).append((i, score))
        assert rank == len(got[q])
    true = {q: dict(w) for q, w in brute(vectors, 100, len(vectors)).items()}
    assert set(got) == set(want) and all(len(g) == 10 and all(abs(true[q][i] - s) < 1e-12 for i, s in g) for q, g in got.items())
    assert sum(len({i for i, _ in w} & {i for i, _ in got[q]}) for q, w in want.items()) >= 0.9 * 10 * len(want)
