"""Vectors as codes of parts: integer codebooks, and nearest entries by a VA file.

A vector's components become integers and its parts the indexes of the nearest entries
of each part position's codebook. A codebook is a VA file: in every dimension its entries
fall into cells of a few bits. For a part, a table for each dimension holds the least
and the most that a cell can add to the squared distance; sums of those bound the
distance of every entry from both sides. Entries whose lower bound is above the smallest
upper bound are out; the distances of the others alone are worked out, in integers.

Codebooks have a fixed size and go to the tasks; sums and counts of their entries come
back added up by Spark, a row for each component of an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Bits of a cell in each dimension.
BITS = 3
#: Numbers in a table of bounds.
_TABLE = 1 << 20
#: Bits of the pieces in which sums travel, so that longs hold them whatever the size.
_PIECE = 40
_WHOLE = 2.0**52


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as integers: of 64 bits, or Python's where one is too large."""
    if not x.size or np.abs(x).max() < _WHOLE:
        return np.floor(256.0 * x).astype(np.int64)
    out = np.empty(x.shape, object)
    out[...] = [int(v) * 256 if abs(v) >= _WHOLE else int(np.floor(256.0 * v)) for v in x.ravel().tolist()] if x.ndim == 1 else np.array([whole(row).astype(object) for row in x], object)
    return out


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


class CellFile:
    """The entries of one part position, found by bounds of cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries = entries
        count, width = entries.shape
        cells = 1 << bits
        self.cell = np.zeros((count, width), np.int64)
        #: Smallest and largest component in each cell of a dimension; cells without entries are never looked up.
        self.low, self.high = np.zeros((width, cells), entries.dtype), np.zeros((width, cells), entries.dtype)
        for d in range(width):
            values, at = np.unique(entries[:, d], return_inverse=True)
            self.cell[:, d] = (np.arange(len(values)) * cells // max(1, len(values)))[at]
            for c in np.unique(self.cell[:, d]):
                inside = entries[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = inside.min(), inside.max()

    def candidates(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, entry) in order: every entry that the bounds leave in."""
        n, count = len(parts), len(self.entries)
        least, most = np.zeros((n, count), parts.dtype), np.zeros((n, count), parts.dtype)
        for d in range(parts.shape[1]):
            q = parts[:, d : d + 1]
            below, above = self.low[d][None, :] - q, q - self.high[d][None, :]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least += (near * near)[:, self.cell[:, d]]
            most += (far * far)[:, self.cell[:, d]]
        return np.nonzero((least <= most.min(axis=1)[:, None]).astype(bool))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part the nearest entry, the first of those as near, and its squared distance."""
        index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
        step = max(1, _TABLE // (len(self.entries) + 1))
        for a in range(0, len(parts), step):
            q = parts[a : a + step]
            i, j = self.candidates(q)
            away = q[i] - self.entries[j]
            d = (away * away).sum(axis=1)
            least = np.minimum.reduceat(d, np.searchsorted(i, np.arange(len(q))))
            at = np.flatnonzero((d == least[i]).astype(bool))[::-1]
            distance[a : a + step] = least
            index[a + i[at]] = j[at]  # the first is written last
        return index, distance


@dataclass
class Codebooks:
    """Entries by part position; `width` components a part, `length` of a vector with its padding."""

    entries: list[np.ndarray]
    width: int

    @property
    def length(self) -> int:
        return self.width * len(self.entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integers that a code stands for."""
        return [int(x) for k, book in enumerate(self.entries) for x in book[int(code[2 * k : 2 * k + 2], 16)].tolist()]

    def files(self) -> list[CellFile]:
        return [CellFile(e) for e in self.entries]

    def fits(self, parts: np.ndarray) -> bool:
        """Whether distances to all entries fit into 64 bits."""
        return parts.dtype != object and all(e.dtype != object for e in self.entries) and max(1, self.width) * (_largest(parts) + max(map(_largest, self.entries), default=0)) ** 2 < 1 << 62


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of a column as rows, with zeros behind those that are shorter."""
    size = np.array(pc.list_value_length(column).to_pylist(), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == length).all():
        return values.reshape(len(size), length)
    out = np.zeros((len(size), length))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _assigned(column: pa.Array, books: Codebooks, files: list[CellFile]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, parts, entries, squared distances) of the vectors of a column."""
    rows = whole(_matrix(column, books.length))
    if not books.fits(rows):
        rows = rows.astype(object)
        books = Codebooks([e.astype(object) for e in books.entries], books.width)
        files = books.files()
    for k, file in enumerate(files):
        parts = rows[:, k * books.width : (k + 1) * books.width]
        yield (k, parts, *file.nearest(parts))


def _summed(books: Codebooks):
    """Vectors to (slot, piece, value): the sums of the parts of each entry, and behind them their number, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = books.files()
        held = len(books.entries[0])
        total = np.zeros((len(files), held, books.width + 1), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, parts, index, _ in _assigned(batch.column(0), books, files):
                sums = np.zeros((held, books.width), parts.dtype)
                np.add.at(sums, index, parts)
                total[k, :, : books.width] += sums.astype(object)
                total[k, :, books.width] += np.bincount(index, minlength=held).astype(object)
        slots, pieces, values = [], [], []
        for slot, x in enumerate(total.ravel().tolist()):
            piece, x = 0, int(x)
            while x:
                small = abs(x) < 1 << _PIECE
                slots.append(slot)
                pieces.append(piece)
                values.append(x if small else x & ((1 << _PIECE) - 1))
                x = 0 if small else x >> _PIECE
                piece += 1
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(pieces, pa.int32()), pa.array(values, pa.int64())], names=["slot", "piece", "value"])

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str, *more) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), *more, v.alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def learned(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of kept(id, v), or None if there are no vectors.

    They start as the parts of the vectors with the smallest ids and move to the floor of
    the mean of what is nearest to them in each round.
    """
    length = kept.agg(F.max(F.size("v"))).first()[0]
    if length is None:
        return None
    width = -(-length // parts)
    first = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()
    start = whole(_matrix(first.column("v").combine_chunks(), width * parts))
    books = Codebooks([start[:, k * width : (k + 1) * width] for k in range(parts)], width)
    for _ in range(rounds):
        found = kept.select("v").mapInArrow(_summed(books), "slot long, piece int, value long").groupBy("slot", "piece").agg(F.sum("value").alias("value"))
        total = [0] * (parts * len(start) * (width + 1))
        for slot, piece, value in zip(*(c.to_pylist() for c in found.toArrow().columns), strict=True):
            total[slot] += value << (_PIECE * piece)
        moved = []
        for k, book in enumerate(books.entries):
            rows = book.tolist()
            for e in range(len(rows)):
                *sums, n = total[(k * len(start) + e) * (width + 1) : (k * len(start) + e + 1) * (width + 1)]
                rows[e] = [int(s) // n for s in sums] if n else rows[e]
            small = all(abs(x) < 1 << 62 for row in rows for x in row)
            moved.append(np.array(rows, np.int64 if small else object).reshape(len(rows), width))
        books = Codebooks(moved, width)
    return books


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = books.files()
        for batch in batches:
            code = np.zeros((batch.num_rows, len(files)), np.uint8)
            error = np.zeros(batch.num_rows, object)
            for k, _, index, distance in _assigned(batch.column(2), books, files) if batch.num_rows else ():
                code[:, k] = index
                error += distance.astype(object)
            columns = [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    return run


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each vector without null or non-finite components.

    Components count as floor(256 x), exactly however large; an error or a sum of errors
    that a long cannot hold is null. Vectors that are shorter than the longest, or than
    what 16 equal parts need, count as if zeros followed. Rows that repeat an id stand for
    themselves; for the start of the codebooks they are in the order of their vectors, and
    rows without an id come last. Fewer than 64 vectors make as many entries.
    """
    kept = stored(_usable(vectors, id_col, vector_col, F.col(label_col).alias("label")), "vectors")
    books = learned(kept)
    kind = kept.schema["label"].dataType.simpleString()
    shape = f"id long, label {kind}, code string, error long"
    codes = stored(kept.mapInArrow(_coded(books), shape), "codes") if books else kept.sparkSession.createDataFrame([], shape)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = codes.groupBy("label").agg(F.when(F.count("error") == F.count("*"), total).alias("total")).select(F.col("label").alias("of"), F.when(F.col("total") < F.lit("9223372036854775808").cast("decimal(38,0)"), F.col("total")).cast("long").alias("label_error"))
    out = codes.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    """Every round as tables of parts, pairs and entries."""
    rounds, entries = "", "e0"
    pairs = "SELECT p.vec_id, p.k, e.j, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - e.x[i]) * (p.x[i] - e.x[i]))) AS d FROM p JOIN {} e ON e.k = p.k"
    nearest = "SELECT vec_id, k, j, d FROM ({}) QUALIFY row_number() OVER (PARTITION BY vec_id, k ORDER BY d, j) = 1"
    for r in range(1, ROUNDS + 1):
        rounds += f"""
a{r} AS ({nearest.format(pairs.format(entries))}),
s{r} AS (SELECT k, j, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a.k, a.j, unnest(p.x) AS x, generate_subscripts(p.x, 1) AS i FROM a{r} a JOIN p ON p.vec_id = a.vec_id AND p.k = a.k) GROUP BY k, j, i),
m{r} AS (SELECT k, j, list(x ORDER BY i) AS x FROM s{r} GROUP BY k, j),
e{r} AS (SELECT e.k, e.j, coalesce(m.x, e.x) AS x FROM {entries} e LEFT JOIN m{r} m ON m.k = e.k AND m.j = e.j),"""
        entries = f"e{r}"
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, k, x[k * len(x) // {PARTS} + 1 : (k + 1) * len(x) // {PARTS}] AS x FROM v CROSS JOIN (SELECT unnest(range({PARTS})) AS k)),
e0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS j, x FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY vec_id) <= {ENTRIES}),{rounds}
f AS ({nearest.format(pairs.format(entries))}),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', j)), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, j)) AS codebooks_sha256 FROM {entries})
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v ON v.vec_id = c.vec_id CROSS JOIN h
"""


CODES_SQL = _sql()
