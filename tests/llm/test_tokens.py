import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tephra.llm import pieces, tokenstore

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_key(rows):
    return sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens))


def test_round_trip_of_token_files(spark, odd_docs):
    library = Tokenizer.from_file(WORDS)
    store = tokenstore.write_tokens(odd_docs, WORDS, 2)
    got = by_key(tokenstore.read_tokens(spark, store).collect())
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = [(d, library.encode(t, add_special_tokens=False).ids + [2]) for d, t in rows]
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(d), i) for d, i in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    uri = store.files[-1][1]
    held = tokenstore.TokenFile(uri)
    assert len(held.read(len(held) - 1)) == held.counts[-1]
    with pytest.raises(ValueError):
        tokenstore.TokenFile(uri, b"other")


def test_digest_and_empty_table(spark, odd_docs, no_docs):
    store = tokenstore.write_tokens(odd_docs, WORDS, 2)
    plain = {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in tokenstore.read_tokens(spark, store).collect()}
    crc = tokenstore.read_tokens(spark, store, lambda x: zlib.crc32(x.tobytes()), "ids_crc32 long")
    assert {(r.doc_id, r.start): r.ids_crc32 for r in crc.collect()} == plain
    assert tokenstore.read_tokens(spark, tokenstore.write_tokens(no_docs, WORDS, 2)).collect() == []


@functools.cache
def word_encoders():
    return tokenstore.WordEncoder(WORDS, "<u2", 50), Tokenizer.from_file(WORDS)


@functools.cache
def small_model():
    return pieces.PieceModel(PIECES, 20_000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAéé'sß.,!1<|>endoftx \t\n  İΣ日"), max_size=30), max_size=4))
def test_words_encode_as_whole_texts(some):
    encoder, library = word_encoders()
    for text, data in zip(some, encoder.encode([t.encode() for t in some], 2), strict=True):
        assert np.frombuffer(data, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def check_pieces(model, text):
    ids = list(map(int, model.encode(text).split()))
    assert ids == model.library.encode(text, add_eos=True), text
    assert model.library.decode(ids) == model.decode(ids), text


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("abetionhs ▁.\n1é"), max_size=80)))
def test_pieces_equal_the_library(text):
    check_pieces(small_model(), text)


def test_pieces_over_tables(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in pieces.encode(odd_docs, PIECES).collect())
    want = [(str(r.doc_id), library.encode(r.text or "", add_eos=True)) for r in odd_docs.collect()]
    assert got == sorted((d, i, library.decode(i)) for d, i in want)
    assert pieces.encode(no_docs, PIECES).collect() == []
    model = pieces.PieceModel(PIECES)
    for ids in ([3 + 0xC3, 3 + 0xA9], [3 + 0xC3, 5000], [2, 1, 5000, 2], [], [29871, 29871]):
        assert model.decode(ids) == library.decode(ids)


def test_characters_alone_and_words_alone_cost_no_memory():
    model = pieces.PieceModel(PIECES)
    want = model.library.encode("qzxvkwjq9b nation nation, ça")
    assert model.encode("qzxvkwjq9b nation nation, ça").decode() == " ".join(map(str, [*want, model.end_id]))
    assert all(len(right) > 1 for _, right in model.apart)  # a character alone is the last token where no longer one is
    assert "▁nation" in model.known and "," in model.known and "▁qzxvkwjq9b" in model.known
