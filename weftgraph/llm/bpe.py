"""Byte-level BPE through a sentencepiece model serialised directly from a rank file.

Every piece is a vocabulary entry with its bytes mapped to printable characters and
minus its rank as score; the normalisation is the identity. Pre-tokens are encoded one
by one, as characters mapped the same way, and ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernels import column_bytes, pieces

#: Distinct words a worker remembers, and the words it joins and learns at once.
_REMEMBERED = 200_000
_JOINED = 1 << 16
_LEARNED = 1 << 13


def byte_characters() -> list[str]:
    """One printable character for each byte: its own where it is printable Latin-1, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised(entries: list[bytes]) -> bytes:
    """A sentencepiece ModelProto (type BPE) in which the id of a piece is its rank."""
    shown = byte_characters()
    out = bytearray()
    for rank, entry in enumerate(entries):
        piece = "".join(shown[b] for b in entry).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -rank))
    out += _field(1, _field(1, "▁unknown▁".encode()) + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(40, len(entries)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file (base64, rank) in order of rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, lines)}
    return [found[r] for r in range(len(found))]


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.entries = read_ranks(path)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.entries))
        self._split = regex.compile(pattern)
        self._shown = byte_characters()
        inverse = {c: b for b, c in enumerate(self._shown)}
        self._bytes = [bytes(inverse[c] for c in self._model.id_to_piece(i)) for i in range(len(self.entries))]
        self._table = {b: c for b, c in enumerate(self._shown)}
        self._known: dict[str, tuple[str, int, bytes]] = {}

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, by the inverse of the mapping of bytes to characters."""
        return b"".join([self._bytes[i] for i in ids])

    def _entries(self, chunks: list[str], spaced: bool) -> list[tuple[str, int, bytes]]:
        """Ids of each chunk as text, their number and their bytes; all pre-tokens go to the model in one call.

        spaced: each chunk stands after one space and holds no other, so that one pass of the
        pattern over all of them will do, a pre-token with a space first beginning each chunk.
        """
        if spaced:
            flat = self._split.findall(" " + " ".join(chunks)) if chunks else []
            sizes = [0] * len(chunks)
            at = -1
            for token in flat:
                at += token[0] == " "
                sizes[at] += 1
        else:
            tokens = [self._split.findall(chunk) for chunk in chunks]
            flat, sizes = [t for of_chunk in tokens for t in of_chunk], [len(x) for x in tokens]
        coded = self._model.encode([t.encode().decode("latin-1").translate(self._table) for t in flat], num_threads=1) if flat else []
        out, first = [], 0
        for size in sizes:
            ids = coded[first] if size == 1 else [i for x in coded[first : first + size] for i in x]
            first += size
            out.append((" ".join(map(str, ids)), len(ids), self.decode(ids)))
        return out

    def _learn(self, words: set[str], needed: set[str]) -> None:
        """Remember what words mean with one space before them; needed: those in use now."""
        known = self._known
        if len(known) + len(words) > _REMEMBERED:
            known.clear()
            words = needed
        plain = [w for w in words if " " not in w]
        for i in range(0, len(plain), _LEARNED):
            part = plain[i : i + _LEARNED]
            known.update(zip(part, self._entries(part, True), strict=True))
        rest = [w for w in words if " " in w]
        for i in range(0, len(rest), _LEARNED):
            part = rest[i : i + _LEARNED]
            known.update(zip(part, self._entries([" " + w for w in part], False), strict=True))

    def _words(self, text: str) -> list[str]:
        """A text cut at single spaces between other characters.

        No pre-token reaches over such a cut and none depends on what follows one: a
        match holds a space only as its first character or among white space.
        """
        parts = text.split(" ")
        known = self._known
        if all(p in known or p and not p[0].isspace() and not p[-1].isspace() for p in set(parts)):
            return parts
        kept = parts[:1]
        for part in parts[1:]:
            if part and not part[0].isspace() and kept[-1] and not kept[-1][-1].isspace():
                kept.append(part)
            else:
                kept[-1] = f"{kept[-1]} {part}"
        return kept

    def _chunks(self, texts: list[str]) -> Iterator[Iterator[list[tuple[str, int, bytes]]]]:
        """For each text the entries of its words, a bounded number at a time."""
        cut = [self._words(t) for t in texts]
        for words, first in zip(cut, self._entries([w[0] for w in cut], False), strict=True):
            yield self._of_text(words, first)

    def _of_text(self, words: list[str], first: tuple[str, int, bytes]) -> Iterator[list[tuple[str, int, bytes]]]:
        yield [first]
        for i in range(1, len(words), _JOINED):
            part = words[i : i + _JOINED]
            needed = set(part)
            if new := needed.difference(self._known):
                self._learn(new, needed)
            known = self._known
            yield [known[p] for p in part]

    def prepare(self, texts: list[str]) -> None:
        """Learn the words of many texts in one call of the model."""
        needed: set[str] = set()
        for t in texts:
            needed.update(self._words(t)[1:])
        if new := needed.difference(self._known):
            self._learn(new, needed)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for part in parts for ids, _, _ in part if ids for i in ids.split(" ")] for parts in self._chunks(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of tokens, SHA-256 of the ids joined by spaces, SHA-256 of the decoded bytes."""
        out = []
        for parts in self._chunks(texts):
            ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
            for part in parts:
                shown = " ".join([k[0] for k in part])
                if shown:
                    ids.update((" " if n else "").encode() + shown.encode())
                    decoded.update(b"".join([k[2] for k in part]))
                    n += sum([k[1] for k in part])
            out.append((n, ids.hexdigest(), decoded.hexdigest()))
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _digested(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in pieces(batches, "text", 1 << 19):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            own.prepare(texts)
            rows = own.digests(texts)
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _coded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in pieces(batches, "text", 1 << 19):
            ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
            texts = [own.decode(i) for i in ids]
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded), one row for each row of docs; null counts as empty, with no ids.

    The vocabulary file must be readable under `path` on every executor. Other columns of
    docs are not read; repeated rows and null ids give rows like any other.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_coded(path, pattern), "doc_id long, ids array<int>, decoded binary")


def encoding_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what `encoded` gives, as digests, made in one pass."""
    return _rows(docs, id_col, text_col).mapInArrow(_digested(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
