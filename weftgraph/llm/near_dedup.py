"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function maps a document's shingles to 64-bit values; the SKETCH smallest are
its sketch. Inverted lists are of the INDEXED smallest of them. Two sets at the threshold
have at least `least_common` of these in common, but for a chance below MISSED (sets of
fewer shingles: always), so of a document only the values are listed that stay when that
many less one, the most frequent of the corpus, are left out: two linked documents still
meet in the list of the rarest value they share, and a passage that many documents hold
makes no list unless it is most of a document.

1. In each list every member is tried against the most central one, the member that
   meets the most others over all lists.
2. Lists that still hold members of different components are worked through in whole:
   overlaps of the retained values are counted for all members at once, in blocks of
   at most BLOCK members, and pairs of different components go on. Two documents are
   weighed in the first list they share and in no other.

A pair goes on if the estimate from the union of the two sketches is within
SLACK standard deviations of the threshold; sketches that hold their whole set give the
similarity itself. Then the full sets decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .blocks import release
from .components import connected
from .storage import numbered, stored
from .textkernels import column_bytes, pieces, shingle_sets

SKETCH = 512
INDEXED = 64
MISSED = 1e-9
BLOCK = 1024
SLACK = 5.0
_PACK = 4096


def least_common(values: int, share: float, missed: float = MISSED) -> int:
    """What two sketches of `values` values have in common at least, each with probability `share`, but for a chance of missed."""
    below = 0.0
    for n in range(values + 1):
        below += math.comb(values, n) * share**n * (1 - share) ** (values - n)
        if below > missed:
            return max(1, n)
    return values


def listed(n: Column, numerator: int, denominator: int) -> Column:
    """How many of the indexed values of a set of n shingles are listed, the rarest first.

    All partners of a set of at most INDEXED * threshold shingles have their whole sets
    indexed, and share the threshold's part of the larger one.
    """
    whole = INDEXED * numerator // denominator
    sure = F.floor((n * numerator + (denominator - 1)) / denominator)
    return F.when(n <= whole, n - sure + 1).otherwise(F.least(n, F.lit(INDEXED)) - least_common(INDEXED, numerator / denominator) + 1)


def _long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def _profile(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingle_sets(*column_bytes(batch.column(1)), n=words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                    _lists([_long(x[:INDEXED]) for x in sets]),
                ],
                names=["id", "n", "digest", "keys"],
            )

    return run


def _sets(words: int):
    """Whole sets, their smallest values first: a sketch is the beginning of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingle_sets(*column_bytes(batch.column(1)), n=words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "n", "whole"])

    return run


def union_estimate(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Share of common values among the k smallest of the union of two sorted sketches."""
    common = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)[:k]
    return float(np.searchsorted(common, union[-1], side="right")) / len(union) if len(union) else 0.0


def _cutoff(share: float) -> float:
    return share - SLACK * (share * (1 - share) / SKETCH) ** 0.5


def _passes(a: np.ndarray, b: np.ndarray, na: int, nb: int, share: float) -> bool:
    whole = na <= SKETCH and nb <= SKETCH
    if whole:
        c = len(np.intersect1d(a, b, assume_unique=True))
        return c >= share * (na + nb - c) - 1e-9
    return union_estimate(a, b) >= _cutoff(share)


def _estimated(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            keep = [
                _passes(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), m, n, share)
                for p, q, m, n in zip(x["a_sketch"], x["b_sketch"], x["a_n"], x["b_n"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("a_whole"), batch.column("b_whole"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                c = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(c > 0 and denominator * c >= numerator * (len(x) + len(y) - c))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _overlaps(sketches: list[np.ndarray]) -> np.ndarray:
    """Common retained values of every two members, by products of blocks of the inverted lists."""
    m = len(sketches)
    owner = np.repeat(np.arange(m), [len(x) for x in sketches])
    values, at, count = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    owner, at = owner[keep], shared[at[keep]]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, [low, low + 4096])
        block = np.zeros((m, 4096), np.float32)
        block[owner[i:j], at[i:j] - low] = 1
        out += block @ block.T
    return out


def _within(ids: np.ndarray, component: np.ndarray, n: np.ndarray, half: np.ndarray, sketches: list[np.ndarray], earlier: list[np.ndarray], share: float) -> Iterator[tuple[int, int]]:
    """Pairs of one block of a list that may be links between different components.

    earlier: each member's lists that come before this one; pairs that share one are left to it.
    """
    own = component[:, None] != component[None, :]
    if half.any():
        own &= half[:, None] != half[None, :]
    if own.any():
        own &= _overlaps(earlier) == 0
    if not own.any():
        return
    o = _overlaps(sketches)
    size = np.minimum(n, SKETCH)
    small, large = np.minimum.outer(n, n), np.maximum.outer(n, n)
    whole = large <= SKETCH
    exact = o >= share * (small + large - o) - 1e-6
    union = np.minimum(SKETCH, np.add.outer(size, size) - o)
    maybe = np.where(whole, exact, o >= _cutoff(share) * union - 1e-6) & (small >= share * large - 1e-6)
    for i, j in np.argwhere(np.triu(maybe & own, 1)):
        if whole[i, j] or union_estimate(sketches[i], sketches[j]) >= _cutoff(share):
            yield int(ids[i]), int(ids[j])


def _residual(share: float):
    def run(table: pa.Table) -> pa.Table:
        x = table.to_pydict()
        order = sorted(range(table.num_rows), key=lambda r: (x["list"][r], x["part"][r]))
        found: set[tuple[int, int]] = set()
        first = 0
        while first < len(order):
            last = first
            while last < len(order) and (x["list"][order[last]], x["part"][order[last]]) == (x["list"][order[first]], x["part"][order[first]]):
                last += 1
            rows = order[first:last]
            key = x["list"][rows[0]]
            earlier = [np.array([k for k in x["lists"][r] if k < key], np.int64) for r in rows]
            take = lambda name: np.array([x[name][r] for r in rows], dtype=np.int64)  # noqa: B023, E731
            found.update(_within(take("id"), take("component"), take("n"), take("half"), [np.frombuffer(x["sketch"][r], np.uint64) for r in rows], earlier, share))
            first = last
        pairs = sorted(found)
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})

    return run


def _links(pairs: DataFrame, involved: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Of the pairs (a, b), those whose sketches and then whose full sets reach the threshold."""
    share = numerator / denominator
    side = lambda s, *more: involved.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in more))
    near = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").mapInArrow(_estimated(share), "a long, b long")
    return near.join(side("a", "whole"), "a").join(side("b", "whole"), "b").mapInArrow(_verified(numerator, denominator), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, numerator: int = 85, denominator: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Two documents are linked if the Jaccard similarity of their sets of distinct
    shingles of `words` words, A-Z lower-cased, is at least numerator / denominator.
    component_id is the smallest id reachable over links; kept says whether it is the
    document's own.

    Null, empty and blank texts have an empty set and no link. A text with fewer words
    than a shingle has one shingle, its whole sequence. Rows without an id are linked
    with nothing: component_id is null and kept true. Rows that repeat an id count as
    linked with each other. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = stored(rows.mapInArrow(_profile(words), "id long, n long, digest binary, keys array<long>"), "profiles")
    known = profile.where("id is not null and digest is not null")
    copies = known.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    copies = stored(copies.withColumn("set", F.xxhash64("digest")), "copies")
    postings = copies.select(F.col("first").alias("id"), "set", "n", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    common = F.row_number().over(Window.partitionBy("id", "set").orderBy(F.col("m").desc(), F.col("key").desc()))
    rare = postings.join(shared, "key").withColumn("common", common).where(F.col("common") > F.least("n", F.lit(INDEXED)) - listed(F.col("n"), numerator, denominator))
    listings = stored(rare.select("key", "id").distinct(), "listings")
    members = stored(listings.join(listings.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"), "members")
    del postings, shared, rare
    release(docs.sparkSession)
    central = members.groupBy("id").agg(F.sum("m").alias("met"))
    placed = members.join(central, "id")
    pivots = placed.groupBy("key").agg(F.max(F.struct(F.col("met"), (-F.col("id")).alias("minus"))).alias("x")).select("key", (-F.col("x.minus")).alias("pivot"))
    star = members.join(pivots, "key").where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    involved = stored(rows.join(central.select("id"), "id", "left_semi").mapInArrow(_sets(words), "id long, n long, whole binary"), "sets")
    release(docs.sparkSession)  # the texts that were dealt for their sets
    involved = involved.withColumn("sketch", F.substring("whole", 1, 8 * SKETCH))
    links = stored(_links(star, involved, numerator, denominator), "links")
    first = connected(links)
    release(docs.sparkSession)

    # Lists that still hold different components, each set of members once.
    now = members.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = now.groupBy("key").agg(
        F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("id", F.lit(7)).cast("decimal(38,0)")).alias("s2"),
    ).where("lo < hi").groupBy("m", "s1", "s2").agg(F.min("key").alias("key"))
    chunks = F.ceil(F.col("m") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.col("chunks")).cast("int")
    open_lists = now.join(mixed.select("key", "m", chunks.alias("chunks")), "key").withColumn("own", part)
    # A block is a list, or two of its chunks: every pair meets in one block.
    blocks = open_lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        F.col("key").alias("list"), "id", "component", (F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")).alias("part"),
        (F.col("own") > F.col("other")).cast("int").alias("half"),
    )
    total = open_lists.count()
    if not total:
        final = first
    else:
        packs = max(1, total // _PACK)
        pack = F.when(F.col("m") > BLOCK, F.xxhash64("list", "part")).otherwise(F.pmod(F.xxhash64("list"), F.lit(packs)))
        own_lists = open_lists.groupBy("id").agg(F.collect_set("key").alias("lists"))
        about = involved.select("id", "n", "sketch").join(own_lists, "id")
        tasks = blocks.join(mixed.select(F.col("key").alias("list"), "m"), "list").join(about, "id").withColumn("pack", pack)
        pairs = tasks.groupBy("pack").applyInArrow(_residual(numerator / denominator), "a long, b long").distinct()
        more = stored(_links(pairs, involved, numerator, denominator), "links")
        final = connected(links.unionByName(more)) if more.head(1) else first
    # Copies follow the first of them; a component's smallest id is that of some first copy.
    ids = known.join(copies.where("rows > 1").select("digest", "first"), "digest").where("id <> first").select("id", "first")
    labels = final.withColumnRenamed("node", "first").withColumnRenamed("component", "root")
    of_copy = ids.join(labels, "first", "left").select("id", F.coalesce("root", "first").alias("c"))
    of_first = labels.select(F.col("first").alias("id"), F.col("root").alias("c"))
    label = of_copy.unionByName(of_first).groupBy("id").agg(F.min("c").alias("c"))
    return (
        profile.select("id", "n").join(label, "id", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(F.col("c"), F.col("id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """The rows of docs, all columns, but for near copies: of each component one row stays, one with the smallest id.

    Links are those of near_duplicates, between rows: what repeats only the id of another
    row, or has none, is as safe as all others. A row without an id stays only if no row of
    its component has one.
    """
    rows, row = numbered(docs)
    with storage.scope() as own:
        found = near_duplicates(rows, row, text_col, words, numerator, denominator).select(F.col("doc_id").alias("node"), "component_id")
        about = rows.select(F.col(row).alias("node"), F.col(id_col).cast("long").alias("id"))
        first = found.join(about, "node").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("x"))
        kept = stored(first.select(F.col("x.node").alias(row)), "kept")
        # Sets and lists go before the texts are dealt once more.
        own.delete(docs.sparkSession, kept)
    release(docs.sparkSession)
    # Not broadcast: files of such numbers are many times smaller than what they are in memory, and Spark goes by the files.
    return rows.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
