"""SentencePiece BPE (merge type) by a prefix table, and its decoding.

For every prefix of a word the last token of its encoding is unique: it is the one token t, among those that end there, that stays
unmerged beside the last token of the prefix before t. An automaton finds the tokens that end at each place, a memo of pairs tells which
two tokens stay apart, and the ids are read off backwards. Encoding is cut before each run of white space, which no piece of such a
vocabulary crosses (checked when the model is loaded).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import AT_END, arrow_map, sliced, texts

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    def __init__(self, path: str, most_bytes: int = 160 << 20):
        import ahocorasick
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most_bytes, self.end_id = most_bytes, sp.eos_id()
        special = {k for k in range(sp.get_piece_size()) if sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k)}
        self.id = {sp.id_to_piece(k): k for k in range(sp.get_piece_size()) if k not in special}
        self.score = {p: sp.get_score(k) for p, k in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.value = [b""] * sp.get_piece_size()
        for p, k in self.id.items():
            self.value[k] = p.replace(SPACE, " ").encode()
        for b, k in enumerate(self.byte):
            self.value[k] = bytes([b])
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece goes on after white space: texts can't be cut there")
        if sp.normalize("é Ω  a") != f"{SPACE}é{SPACE}Ω{SPACE * 2}a" or min(self.byte) <= 0:
            raise ValueError("only models with the identity normaliser, a dummy prefix and byte pieces are read")
        self.inner = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1:
                self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.coded = {p: str(k).encode() for p, k in self.id.items()}
        self.valued = {str(k).encode(): v for k, v in enumerate(self.value)}
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.held, self.used = 0, False
        AT_END.append(self.rest)

    def rest(self) -> None:
        """What the next partition of the same work may use stays; another kind of work lets it go."""
        if not self.used:
            self.forget()
        self.used = False

    def forget(self) -> None:
        self.known.clear()
        self.apart.clear()
        self.held = 0

    def _merged(self, symbols: str) -> list[str]:
        """The definition, for a few characters: join the pair of the best score, leftmost first, until none is a piece."""
        parts, score, low = list(symbols), self.score.get, float("-inf")
        joint = [score(x + y, low) for x, y in zip(parts, parts[1:])]
        while joint and (best := max(joint)) > low:
            k = joint.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joint[k]
            if k:
                joint[k - 1] = score(parts[k - 1] + parts[k], low)
            if k < len(joint):
                joint[k] = score(parts[k] + parts[k + 1], low)
        return parts

    def _stay(self, left: str, right: str) -> bool:
        found = self.apart[left, right] = self._merged(left + right) == ([left, right] if left else [right])
        return found

    def tokens(self, chunk: str) -> list[str]:
        """The chunk's pieces; characters that no piece has stay as they are."""
        known, stay = self.apart.get, self._stay
        last, done = [""] * (len(chunk) + 1), 0  # the token that ends at each place, found up to there
        for at, (size, piece) in self.automaton.iter(chunk):  # by their ends; the character alone is the last token where none of them is
            if at < done:
                continue
            while done < at:
                last[done + 1] = chunk[done]
                done += 1
            left = last[at + 1 - size]
            if (found := known((left, piece))) is None:
                found = stay(left, piece)
            if found:
                done = at + 1
                last[done] = piece
        while done < len(chunk):
            last[done + 1] = chunk[done]
            done += 1
        out = []
        while done:
            out.append(last[done])
            done -= len(last[done])
        return out[::-1]

    def _code(self, token: str) -> bytes:
        return " ".join([str(self.byte[b]) for b in token.encode()]).encode()

    def _chunk(self, chunk: str) -> bytes:
        """Cut where two characters are together in no piece, as before an end mark: the parts are encoded, and kept, one by one."""
        if chunk[1:].isalnum():  # a word alone has hardly any
            return self._part(chunk)
        inner = self.inner
        cuts = [0, *[k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in inner], len(chunk)]
        if len(cuts) > 2:
            get = self.known.get
            return self._keep(chunk, b" ".join([get(p) or self._part(p) for p in (chunk[a:b] for a, b in zip(cuts, cuts[1:]))]))
        return self._part(chunk)

    def _part(self, part: str) -> bytes:
        get, code = self.coded.get, self._code
        return self._keep(part, b" ".join([get(t) or code(t) for t in self.tokens(part)]))

    def _keep(self, part: str, made: bytes) -> bytes:
        """made, remembered: a text of over a thousand characters is not worth it. Entries and pairs take some 200 bytes beside their own."""
        if len(part) < 1000:
            self.known[part] = made
            self.held += 200 + len(part) + len(made)
        return made

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE))

    def encode(self, text: str) -> bytes:
        """The ids with the end id as decimal numbers joined by a space."""
        self.used = True
        if self.held + 250 * len(self.apart) > self.most_bytes:
            self.forget()
        get, make = self.known.get, self._chunk
        return b" ".join([*[get(c) or make(c) for c in self.chunks(text)], str(self.end_id).encode()])

    def decode(self, ids: list[int]) -> str:
        """The library's decode for any ids: white space for its mark, bytes joined to characters, no space for the dummy prefix."""
        return self.decode_coded([str(k).encode() for k in ids])

    def decode_coded(self, ids: list[bytes]) -> str:
        """decode for ids as encode has them, decimal numbers."""
        try:
            text = b"".join(map(self.valued.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.library.decode(list(map(int, ids)))
        if text[:1] != " ":
            return text
        first = next(k for k in ids if self.valued[k])
        return text if int(first) in self.byte else text[1:]


_MODEL: dict[str, PieceModel] = {}


def _encode(batches, model_path: str, digests: bool, names: list[str]):
    model = _MODEL.get(model_path) or _MODEL.setdefault(model_path, PieceModel(model_path))
    for batch in batches:
        for ids, raws in sliced(batch.column(0).to_pylist(), [r or b"" for r in batch.column(1).to_pylist()]):
            n, coded, decoded = [], [], []
            for raw in raws:  # one text at a time: only its digests or its ids stay
                made = model.encode(raw.decode())
                numbers = made.split()
                text = model.decode_coded(numbers)
                n.append(len(numbers))
                coded.append(hashlib.sha256(made).hexdigest() if digests else np.array(list(map(int, numbers)), np.int32))
                decoded.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            n = pa.array(n, pa.int64())
            cols = [pa.array(coded, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), n, *cols], names=names)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with digests (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of df.

    ids end with the end id; a null or empty text has no other. decoded is what the ids themselves decode to. Other columns are left out;
    null ids and equal rows stay; an empty table stays empty. A text is encoded and decoded whole, however long; what a worker remembers
    of words and pairs is bounded in bytes and let go by the next other work. Nothing is shuffled.
    """
    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    return arrow_map(texts(df, id_col, text_col), lambda batches: _encode(batches, model_path, digests, [f.split()[0] for f in schema.split(", ")]), schema)
