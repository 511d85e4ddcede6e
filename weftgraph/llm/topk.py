"""Exact top-k inner products by a three-phase uniform threshold.

The components are cut into LISTS groups; a vector's partial products over one group
form a score list, and a score is the sum over the lists.

1. Every list of the blocks of a share gives its k best entries for each query. Their
   exact scores give the query's k-th best so far, a cutoff no result can be under: any
   k exact scores would do, so that one block in PILOT is enough.
2. The cutoff goes to all blocks. A vector that reaches it has a partial product of at
   least cutoff / LISTS in some list (whatever the signs), so each list gives the
   entries at or above that uniform threshold, less what rounding may have taken.
3. The scores of those entries alone are worked out, exactly, and the k best are kept.

Lists are products of float64 matrices, scores are sums of integers. Vectors are dealt
into blocks by the size of their components, which a block scales by a power of two, so
that nothing overflows and rounding is judged by the block's own numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

LISTS = 2
#: Rows of a block of vectors or of queries (fewer if they are long): a score list has 8 MB.
ROWS = 2048
QUERIES = 512
BLOCK_BYTES = 32 << 20
#: One block in so many gives the lists of the first phase.
PILOT = 4
#: Exact scores worked out at once.
_CHUNK = 1 << 15
#: Blocks hold vectors whose largest components differ by less than 2 ** _SPREAD, and scale them below 2 ** _TOP.
_SPREAD, _TOP = 16, 400
_WHOLE = 2.0**52


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x) / 256, exactly: from 2**52 on x is whole already."""
    big = np.abs(x) >= _WHOLE
    return np.where(big, x, np.floor(256.0 * np.where(big, 0.0, x)) / 256.0)


def integers(u: np.ndarray) -> list[int]:
    """256 u as Python integers."""
    return [int(x) * 256 if abs(x) >= _WHOLE else int(x * 256.0) for x in u.tolist()]


def order_key(score: int) -> bytes:
    """Bytes that are in the order of the integers they stand for, however large."""
    size = abs(score).to_bytes((score.bit_length() + 7) // 8, "big")
    body = len(size).to_bytes(2, "big") + size
    return b"\1" + body if score >= 0 else b"\0" + bytes(255 - x for x in body)


def of_key(key: bytes) -> int:
    return int.from_bytes(key[3:], "big") if key[0] else -int.from_bytes(bytes(255 - x for x in key[3:]), "big")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, parts, dims, sizes = [], [], [], [], []
        column = batch.column(2)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum([0, *(x or 0 for x in pc.list_value_length(column).to_pylist())])
        for r, (number, row, there) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column.is_valid().to_pylist(), strict=True)):
            v = values[ends[r] : ends[r + 1]]
            if number is not None and there and np.isfinite(v).all():
                u = quantised(v)
                ids.append(number)
                rows.append(row)
                parts.append(u.tobytes())
                dims.append(len(u))
                sizes.append(max(0, int(np.frexp(np.abs(u).max(initial=0.0))[1])) // _SPREAD)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, rows, parts, dims, sizes), kinds, strict=True)], names=["id", "row", "v", "dim", "size"])


def _blocks(table: pa.Table) -> pa.Table:
    return pa.table({
        **{c: table.column(c).slice(0, 1) for c in ("dim", "size", "block")},
        **{f"{c}s": pa.array([np.array(table.column(c).to_pylist(), np.int64).tobytes()], pa.binary()) for c in ("id", "row")},
        "vs": pa.array([b"".join(table.column("v").to_pylist())], pa.binary()),
    })


class Block:
    """Vectors of one length: exact (u), scaled down by a power of two (near) and, where they fit, as integers of 64 bits."""

    def __init__(self, ids: bytes, rows: bytes, vs: bytes, size: int) -> None:
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.u = np.frombuffer(vs, np.float64).reshape(len(self.ids), -1)
        self.scale = max(0, (size + 1) * _SPREAD - _TOP)
        self.near = np.ldexp(self.u, -self.scale)
        self.norm = np.sqrt((self.near * self.near).sum(axis=1))
        self.top = float(np.abs(self.u).max(initial=0.0)) * 256.0 if self.scale == 0 else np.inf
        self.whole = (256.0 * self.u).astype(np.int64) if self.top < 2.0**62 else None


def exact_scores(q: Block, c: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The integer inner products of queries i and vectors j: of 64 bits if no sum can be larger, else Python integers."""
    if q.whole is not None and c.whole is not None and q.top * c.top * max(1, q.u.shape[1]) < 2.0**62:
        return np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", q.whole[i[a : a + _CHUNK]], c.whole[j[a : a + _CHUNK]]) for a in range(0, len(i), _CHUNK))])
    left, right = {x: integers(q.u[x]) for x in np.unique(i)}, {x: integers(c.u[x]) for x in np.unique(j)}
    out = np.empty(len(i), object)
    out[:] = [sum(map(int.__mul__, left[a], right[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    return out


def _below(key: bytes | None, scale: int) -> float:
    """A float at or under (within a few roundings) the score of a key, in units of 2 ** scale / 65536."""
    if key is None:
        return -np.inf
    score, spare = of_key(key), 0
    if abs(score).bit_length() > 64:
        spare = abs(score).bit_length() - 64
        score >>= spare
    return float(np.ldexp(np.nextafter(float(score), -np.inf), spare - 16 - scale))


def _scored(k: int, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                q, c = Block(x["q_ids"], x["q_rows"], x["q_vs"], x["q_size"]), Block(x["ids"], x["rows"], x["vs"], x["size"])
                dim = q.u.shape[1]
                cuts = [round(dim * n / LISTS) for n in range(LISTS + 1)]
                place = np.argsort(c.rows)
                at = place[np.minimum(np.searchsorted(c.rows, q.rows, sorter=place), len(place) - 1)]
                own = np.flatnonzero(c.rows[at] == q.rows)  # queries that stand in this block themselves
                if cut:
                    slack = 4.0 * (dim + 2) * 2.0**-53 * q.norm * c.norm.max(initial=0.0) + 1e-300
                    uniform = np.array([_below(key, q.scale + c.scale) for key in x["cutoff"]]) / LISTS
                    # A cutoff out of the floats' range is above or below all that this block can give.
                    uniform = np.nan_to_num(uniform, nan=-np.inf, posinf=np.inf, neginf=-np.inf) - slack
                mask = np.zeros((len(q.ids), len(c.ids)), bool)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = q.near[:, a:b] @ c.near[:, a:b].T
                    if cut:  # phase 2: what the list has at or above the uniform threshold
                        mask |= part >= uniform[:, None]
                    else:  # phase 1: the k best of the list
                        part[own, at[own]] = -np.inf
                        best = np.argpartition(-part, min(k, len(c.ids)) - 1, axis=1)[:, :k]
                        np.put_along_axis(mask, best, True, axis=1)
                mask[own, at[own]] = False
                i, j = np.nonzero(mask)
                score = exact_scores(q, c, i, j)  # phase 3
                if score.dtype == object:
                    order = np.array(sorted(range(len(i)), key=lambda r: (i[r], -score[r], c.ids[j[r]], c.rows[j[r]])), np.int64)
                else:
                    order = np.lexsort((c.rows[j], c.ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j, score = i[keep], j[keep], score[keep].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(i), x["q_block"]), pa.int64()), pa.array(q.rows[i]), pa.array(q.ids[i]), pa.array(c.ids[j]), pa.array(c.rows[j]),
                        pa.array([s if -(1 << 63) <= s < 1 << 63 else None for s in score], pa.int64()), pa.array([order_key(s) for s in score], pa.binary()),
                    ],
                    names=["q_block", "query_row", "query_id", "vec_id", "row", "score", "key"],
                )

    return run


_QUERY = ("dim", "q_size", "q_block", "q_ids", "q_rows", "q_vs")


def _cutoffs(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Query blocks with, for each of their queries, the k-th best score known (none: null)."""
    best = dict(zip(right.column("query_row").to_pylist(), right.column("key").to_pylist(), strict=True))
    found = [[best.get(int(r)) for r in np.frombuffer(rows, np.int64)] for rows in left.column("q_rows").to_pylist()]
    return left.select(list(_QUERY)).append_column("cutoff", pa.array(found, pa.list_(pa.binary())))


def top_inner_products(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, its k best partners.

    A component x counts as floor(256 x); the score is the integer inner product, ranked
    exactly however large, and null where a long cannot hold it. Ties go to the smaller
    id; with fewer than k partners, all are given. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part. Only vectors of one length
    are compared; empty ones score 0. A row is no partner of itself; rows that repeat an id
    are queries and partners each, and repeat the query's id in the result. Other columns
    are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(vector_col).cast("array<double>").alias("v"))
    packed = stored(rows.where("v is not null and not exists(v, x -> x is null)").mapInArrow(_packed, "id long, row long, v binary, dim long, size int"), "vectors")
    query = F.col("id") % every == 0
    counts = packed.agg(F.count("*"), F.sum("dim"), F.count(F.when(query, 1)), F.sum(F.when(query, F.col("dim")))).first()

    def cut(df: DataFrame, n: int, components: int | None, size: int) -> DataFrame:
        blocks = max(1, -(-n // size), -(-8 * (components or 0) // BLOCK_BYTES))
        keyed = df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long"))
        return keyed.groupBy("dim", "size", "block").applyInArrow(_blocks, "dim long, size int, block long, ids binary, rows binary, vs binary")

    blocks = stored(cut(packed, counts[0], counts[1], ROWS), "blocks")
    asked = cut(packed.where(query), counts[2], counts[3], QUERIES)
    asked = stored(asked.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("size", "block", "ids", "rows", "vs"))), "queries")

    def against(queries: DataFrame, vectors: DataFrame, cut: bool) -> DataFrame:
        """Each block of queries against each block of vectors: the k best of every pair, ranked over all."""
        side = ["dim", "size", "block"], ["dim", "q_size", "q_block"]
        pairs = vectors.select(*side[0]).join(queries.select(*side[1]), "dim").repartition(*side[0], *side[1][1:])
        found = pairs.join(vectors, side[0]).join(queries, side[1]).mapInArrow(_scored(k, cut), "q_block long, query_row long, query_id long, vec_id long, row long, score long, key binary")
        order = Window.partitionBy("query_row").orderBy(F.col("key").desc(), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = against(asked, blocks.where(F.col("block") % PILOT == 0), False).where(F.col("rank") == k).select("q_block", "query_row", "key")
    shape = "dim long, q_size int, q_block long, q_ids binary, q_rows binary, q_vs binary, cutoff array<binary>"
    cutting = stored(asked.groupBy("q_block").cogroup(first.groupBy("q_block")).applyInArrow(_cutoffs, shape), "cutoffs")
    return against(cutting, blocks, True).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
