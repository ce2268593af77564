"""SentencePiece merge-type encoding and decoding, exact, by backtracking.

An encoding is right exactly when every token re-merges to itself and every pair of neighbours re-merges to that
pair. So the encoder walks left to right with the longest token at each position (Aho-Corasick over the
reversed vocabulary), checks each token against its left neighbour by re-merging the two (remembered per pair), falls
back to the next shorter prefix token, and marks positions from which no continuation fits in a bitfield, so
that none is tried twice. Characters outside the vocabulary become byte tokens.

Text is first cut where no token can reach across (a character pair that no piece holds, such as a letter before
a word mark); the cuts are exact, and the encodings of the parts are remembered in a table of bounded size.

Defined results: a null text counts as empty; an empty text has no tokens and decodes to itself; the word mark character
itself decodes to a space, as the library does; row order, repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.common import text_of, trimmed

MARK = "▁"
#: Remembered words, and parts of words, in one Python worker; a table is emptied when full.
CACHE_WORDS, CACHE_PARTS = 600_000, 200_000
#: Rows whose texts, ids and digests a worker holds at a time; an Arrow batch may have ten times as many.
SLICE_ROWS = 1_000


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = b[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, b[i : i + n]
            i += n


class _Follow(dict):
    """Sets by character; a character without one has the empty set and is not added."""

    def __missing__(self, key: str) -> frozenset:
        return frozenset()


class PieceCodec:
    """Encoder and decoder of one merge-type model with byte fallback and the identity normaliser."""

    def __init__(self, model: bytes):
        import struct

        pieces, self.dummy_prefix = [], True
        for field, value in _fields(model):
            if field == 1:
                part = dict(_fields(value))
                score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
                pieces.append((part[1].decode(), score, part.get(3, 1)))
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("the model is not of the merge type")
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only the identity normaliser that keeps white space is supported")
                self.dummy_prefix = bool(spec.get(3, 1))
        self.pieces = [p for p, _, _ in pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i, (_, _, kind) in enumerate(pieces) if kind in (2, 3)}
        self.rank = {p: (-score, i) for i, (p, score, kind) in enumerate(pieces) if kind in (1, 4)}
        self.id_of = {p: i for p, (_, i) in self.rank.items()}
        self.follow = _Follow()  # characters that stand after a character in some piece
        for p in self.rank:
            for a, b in zip(p, p[1:]):
                self.follow.setdefault(a, set()).add(b)
        whole = [p for p in self.rank if self._merge(p) == [p]]
        self.tokens = set(whole)
        self.bytes_of = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.shorter: dict[str, str | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.tokens), None)
            self.automaton.add_word(p[::-1], p)
        self.automaton.make_automaton()
        self._fits: dict[str, dict[str, bool]] = {}  # by left and right token
        self._n_fits = 0
        self._parts: dict[str, tuple[str, str]] = {}
        self._words: dict[str, str] = {}  # ids of words that decode to themselves

    def _merge(self, text: str) -> list[str]:
        """Merging by rank, leftmost first on ties: the definition, used on one token or a pair of tokens only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                got = self.rank.get(parts[k] + parts[k + 1])
                if got is not None and (best is None or got[0] < best):
                    best, at = got[0], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, a: str, b: str) -> bool:
        self._n_fits += 1
        if self._n_fits > 300_000:
            self._fits.clear()
            self._n_fits = 0
        return b[0] not in self.follow[a[-1]] or self._merge(a + b) == [a, b]

    def tokenize(self, text: str) -> list[str]:
        """Tokens of a text without white space handling, by backtracking; an unknown character is a token of its own."""
        n = len(text)
        if n == 0:
            return []
        if text in self.tokens:  # the longest token, and no neighbours
            return [text]
        longest: list[str | None] = [None] * n
        seen = -1
        for end, piece in self.automaton.iter(text[::-1]):
            if end != seen:  # the longest match comes first
                longest[n - 1 - end] = piece
                seen = end
        open_ = bytearray(b"\x01") * (n + 1)  # bitfield: from here the rest may still be encoded
        tokens: list[str] = []
        shorter, fits, compatible = self.shorter, self._fits, self._compatible
        row: dict[str, bool] | None
        at, token = 0, longest[0] or text[0]
        while True:
            if tokens:
                last = tokens[-1]
                row = fits.get(last)
                if row is None:
                    row = fits[last] = {}
            else:
                row = None
            while True:
                end = at + len(token)
                if open_[end]:
                    ok = True if row is None else row.get(token)
                    if ok is None:
                        ok = row[token] = compatible(last, token)
                    if ok:
                        tokens.append(token)
                        at = end
                        if at == n:
                            return tokens
                        token = longest[at] or text[at]
                        break
                less = shorter.get(token)
                if less is None:
                    open_[at] = 0
                    token = tokens.pop()
                    at -= len(token)
                    break
                token = less

    def _cut(self, text: str) -> list[str]:
        """Parts that no token can reach across."""
        follow, parts, a = self.follow, [], 0
        for k, (left, right) in enumerate(zip(text, text[1:]), 1):
            if right not in follow[left]:
                parts.append(text[a:k])
                a = k
        if text:
            parts.append(text[a:])
        return parts

    def _part_ids(self, part: str) -> list[int]:
        ids: list[int] = []
        for t in self.tokenize(part):
            got = self.id_of.get(t)
            ids.extend([got] if got is not None else [self.byte_ids[b] for b in t.encode()])
        return ids

    def _spaced(self, text: str) -> str:
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str) -> list[int]:
        return [i for part in self._cut(self._spaced(text)) for i in self._part_ids(part)]

    def _raw(self, ids: list[int]) -> str:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in ids]).decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        text = self._raw(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def _word(self, word: str) -> tuple[str, str]:
        """Comma-joined ids and decoded text of a word with its mark; whole encodings are remembered."""
        ids, text = [], []
        for part in self._cut(MARK + word):
            got = self._parts.get(part)
            if got is None:
                nums = self._part_ids(part)
                got = ",".join(map(str, nums)), self._raw(nums)
                if len(part) <= 64 and len(part) <= len(word):  # a whole word is remembered by the caller
                    if len(self._parts) >= CACHE_PARTS:
                        self._parts.clear()
                    self._parts[part] = got
            ids.append(got[0])
            text.append(got[1])
        return ",".join(ids), "".join(text)

    def forget(self) -> None:
        """Empty the tables of remembered encodings: a worker outlives its task, and the next one may be of another stage."""
        self._words.clear(), self._parts.clear(), self._fits.clear()
        self._n_fits = 0

    def digest(self, text: str) -> tuple[str, str]:
        """Comma-joined ids and decoded text."""
        if not text:
            return "", ""
        if not self.dummy_prefix or "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            ids = self.encode(text)
            return ",".join(map(str, ids)), self.decode(ids)
        words, parts = self._words, text.split(" ")
        out = list(map(words.get, parts))
        if None in out:
            for k, got in enumerate(out):
                if got is None:
                    word = parts[k]
                    got = words.get(word)
                    if got is None:
                        got, decoded = self._word(word)
                        if decoded != " " + word:
                            ids = self.encode(text)
                            return ",".join(map(str, ids)), self.decode(ids)
                        if len(word) <= 64:
                            if len(words) >= CACHE_WORDS:
                                words.clear()
                            words[word] = got
                    out[k] = got
        return ",".join(out), " ".join(parts)  # each word's ids decode to a space and the word


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec per worker and model file; the file belongs to an installed package and is read where the code runs."""
    with open(path, "rb") as f:
        return PieceCodec(f.read())


def encode_documents(docs: DataFrame, path: str, keep: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: column ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids themselves."""
    kind = docs.schema[keep].dataType.simpleString()
    schema = f"{keep} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            n_tokens, id_hash, text_hash, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids, decoded = own.digest(text)
                n_tokens.append(ids.count(",") + 1 if ids else 0)
                id_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
            cols = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *map(len, all_ids)], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        own.forget()

    return docs.select(docs[keep], text_of(docs).alias("text")).mapInArrow(trimmed(run), schema)
