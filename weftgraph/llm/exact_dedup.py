"""Exact duplicates by a cuckoo-filter index of live digests.

1. Every piece of a map task's rows goes through an index that verifies hits on the
   normalised texts themselves, so that copies leave it as one entry, however many.
2. The entries of all tasks meet by digest, in order, in indexes of at most _HELD digests
   that verify hits on digest and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import numbered, scope, stored
from .textkernels import column_bytes, pieces

_SLOTS = 4
_KICKS = 200
#: Digests that an index of the second round holds before it passes them on.
_HELD = 200_000


class CuckooIndex:
    """Digests, their contents and what is kept with them, found through 16-bit fingerprints in two candidate buckets.

    Bucket i of the filter and bucket i of the content move together. A fingerprint
    that matches is verified against the digest and the content stored beside it, so that
    lookups are exact: two contents of one digest would be two entries. When an insertion
    finds no room after _KICKS moves, the index doubles and is filled again from the
    stored digests.
    """

    def __init__(self, buckets: int = 256) -> None:
        self._size = 1 << max(1, (buckets - 1).bit_length())
        self._clear()
        self.count = 0

    def _clear(self) -> None:
        self._prints: list[list[int]] = [[] for _ in range(self._size)]
        self._content: list[list[tuple[bytes, object, object]]] = [[] for _ in range(self._size)]

    def __len__(self) -> int:
        return self.count

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") | 1 << 16
        first = int.from_bytes(digest[2:10], "little") & (self._size - 1)
        return mark, first, self._partner(first, mark)

    def _partner(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 + 0x9E3779B1)) & (self._size - 1)

    def _find(self, digest: bytes, content: object = None) -> tuple[int, int] | None:
        mark, first, second = self._places(digest)
        for bucket in (first, second) if first != second else (first,):
            for slot, there in enumerate(self._prints[bucket]):
                if there == mark and self._content[bucket][slot][:2] == (digest, content):
                    return bucket, slot
        return None

    def get(self, digest: bytes, content: object = None) -> object | None:
        at = self._find(digest, content)
        return self._content[at[0]][at[1]][2] if at else None

    def delete(self, digest: bytes, content: object = None) -> bool:
        at = self._find(digest, content)
        if not at:
            return False
        del self._prints[at[0]][at[1]], self._content[at[0]][at[1]]
        self.count -= 1
        return True

    def insert(self, digest: bytes, kept: object, content: object = None) -> None:
        """Store a digest that is not live, or replace what is kept with a live one."""
        at = self._find(digest, content)
        if at:
            self._content[at[0]][at[1]] = (digest, content, kept)
            return
        self.count += 1
        left = self._placed((digest, content, kept))
        if left is not None:
            self._grow(left)

    def _grow(self, left: tuple[bytes, object, object]) -> None:
        """Double the index until all live digests and the one left over have room."""
        live = [*self.items(), left]
        while True:
            self._size *= 2
            self._clear()
            if all(self._placed(x) is None for x in live):
                return

    def _placed(self, entry: tuple[bytes, object, object]) -> tuple[bytes, object, object] | None:
        """Put an entry in place, moving others; the entry left over if there is no room."""
        mark, first, second = self._places(entry[0])
        for bucket in (first, second):
            if len(self._prints[bucket]) < _SLOTS:
                self._prints[bucket].append(mark)
                self._content[bucket].append(entry)
                return None
        bucket = second
        for kick in range(_KICKS):
            slot = kick % _SLOTS
            mark, self._prints[bucket][slot] = self._prints[bucket][slot], mark
            entry, self._content[bucket][slot] = self._content[bucket][slot], entry
            bucket = self._partner(bucket, mark)
            if len(self._prints[bucket]) < _SLOTS:
                self._prints[bucket].append(mark)
                self._content[bucket].append(entry)
                return None
        return entry

    def items(self) -> Iterator[tuple[bytes, object, object]]:
        for bucket in self._content:
            yield from bucket

    def meet(self, digest: bytes, content: object, row: tuple, members: list | int) -> None:
        """Add members of a digest, lists or counts; the row that comes last in order stays live."""
        live = self.get(digest, content)
        if live is None:
            self.insert(digest, (row, members), content)
            return
        keep, others = live
        if row > keep:
            self.delete(digest, content)  # the row that was live is so no longer
            keep = row
        self.insert(digest, (keep, others + members), content)


def _order(number: int | None, row: int) -> tuple:
    return (number is not None, number or 0, row)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 8 << 20):
        data, offsets = column_bytes(batch.column(2))
        view = memoryview(data)
        index = CuckooIndex()
        for number, row, i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            content = bytes(view[i:j]).lower()
            index.meet(hashlib.sha256(content).digest(), content, _order(number, row), [(number, row)])
        found = list(index.items())
        columns = [
            pa.array([d for d, _, _ in found], pa.binary()), pa.array([len(c) for _, c, _ in found], pa.int64()),
            pa.array([[{"id": i, "row": r} for i, r in members] for _, _, (_, members) in found], pa.list_(pa.struct([("id", pa.int64()), ("row", pa.int64())]))),
            *_live_columns([k for _, _, (k, _) in found]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["digest", "length", "members", "keep_id", "keep_row"])


def _live_columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([i if known else None for known, i, _ in rows], pa.int64()), pa.array([r for _, _, r in rows], pa.int64())]


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of their digests to one row for each."""

    def out() -> pa.RecordBatch:
        found = list(index.items())
        columns = [pa.array([d for d, _, _ in found], pa.binary()), pa.array([c for _, c, _ in found], pa.int64()), *_live_columns([k for _, _, (k, _) in found]), pa.array([n for _, _, (_, n) in found], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["digest", "length", "keep_id", "keep_row", "group_size"])

    index, last = CuckooIndex(), None
    for batch in batches:
        for digest, length, number, row, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(index) >= _HELD and digest != last:
                yield out()
                index = CuckooIndex()
            index.meet(digest, length, _order(number, row), size)
            last = digest
    yield out()


def _decided(rows: DataFrame) -> DataFrame:
    """rows(id, row, text), row being a different number for every row, to (id, row, keep_id, keep_row, group_size, digest)."""
    entries = stored(rows.select("id", "row", "text").mapInArrow(_digested, "digest binary, length long, members array<struct<id: long, row: long>>, keep_id long, keep_row long"), "digests")
    dealt = entries.select("digest", "length", "keep_id", "keep_row", F.size("members").cast("long").alias("size")).repartition("digest").sortWithinPartitions("digest")
    live = stored(dealt.mapInArrow(_live, "digest binary, length long, keep_id long, keep_row long, group_size long"), "live")
    # Copies travel as one entry of a piece, and are rows again behind the join.
    met = entries.select("digest", "length", "members").join(live, ["digest", "length"])
    return met.select(F.explode("members").alias("m"), "keep_id", "keep_row", "group_size", "digest").select("m.id", "m.row", "keep_id", "keep_row", "group_size", "digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. The row
    with the largest id of a group stays; a row without an id stays only if none of its
    group has one (keep_id is then null). Rows that repeat both id and text share one
    decision and each counts in group_size. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return _decided(rows).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, but for exact copies: of equal texts one row stays.

    It is one with the largest id, or, if none has an id, any. Decisions are made for rows:
    what repeats only the id of another row, or has none, is as safe as all others.
    """
    rows, row = numbered(docs)
    with scope() as own:
        decided = _decided(rows.select(F.col(id_col).cast("long").alias("id"), F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")))
        kept = stored(decided.where("row = keep_row").select(F.col("row").alias(row)), "kept")
        own.delete(docs.sparkSession, kept)
    return rows.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


EXACT_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h)
"""
