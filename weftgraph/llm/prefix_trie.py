"""A trie of conversations: what turns they begin with in common, and what that saves.

Texts become labels of 16 bytes at once; nothing below moves a text.

1. Turns meet by families of conversations, sorted, and a task streams them into rebuilt
   conversations: the labels of their turns, end to end.
2. Equal conversations become one path. Its members' ids, which only their digest needs
   one by one, are dealt by ranges, so that a path that everybody takes fills many.
3. Paths are dealt into shards by prefix. A prefix with too many paths is cut deeper, so
   that no shard has more of them, and the levels above are merged for themselves.
4. A shard is a succinct level-order trie: a LOUDS bitvector and the labels of its nodes.
   Members, leaves and savings are summed up from the last level to the first.
5. The heavy upper levels are sums over the shards below them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import word_count
from .storage import stored

#: Conversations of a family share the first turns of the one whose id FAMILY divides; at most HEAD - 1 turns.
FAMILY = 20
HEAD = 4
#: Bytes of a label.
LABEL = 16
#: Paths of a shard at most.
PATHS = 256
#: Turns of the shards that a task builds as one forest, about.
_FOREST = 1 << 16
#: Ids of one row, while the members of a path are gathered.
_IDS = 1 << 13
_NOBODY = hashlib.sha256(b"").hexdigest()


class Louds:
    """A forest of tries in level order.

    bits has, for each node in that order behind one super-root, a 1 for each child and
    then a 0; labels has a node's last label, and words what goes with it. The nodes of a
    level are in the order of their parents, then labels.
    """

    def __init__(self, bits: np.ndarray, labels: np.ndarray, words: np.ndarray, levels: np.ndarray) -> None:
        self.bits, self.labels, self.words, self.levels = bits, labels, words, levels

    @classmethod
    def built(cls, paths: list[np.ndarray], words: list[np.ndarray], trees: np.ndarray) -> tuple[Louds, np.ndarray]:
        """A trie for each tree (0, 1, ...) of its paths, arrays of labels (two numbers each), and the node at which each path ends.

        All paths of a tree have their first label in common.
        """
        size = np.array([len(p) for p in paths], np.int64)
        at = np.cumsum(size) - size
        flat = np.concatenate(paths) if paths else np.zeros((0, 2), np.uint64)
        spent = np.concatenate(words) if words else np.zeros(0, np.int64)
        node = trees.astype(np.int64)  # of each path its last node, by its number within the level
        alive = np.arange(len(paths))
        degrees, labels, counts, levels, end, before = [], [], [], [0], np.zeros(len(paths), np.int64), 0
        width = int(trees.max()) + 1 if len(trees) else 0
        depth = 0
        while len(alive):
            place = at[alive] + depth
            high, low = flat[place, 0], flat[place, 1]
            order = np.lexsort((low, high, node[alive]))
            alive, place, high, low = alive[order], place[order], high[order], low[order]
            parent = node[alive]
            fresh = np.ones(len(alive), bool)
            fresh[1:] = (parent[1:] != parent[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            number = np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            degrees.append(np.bincount(parent[first], minlength=width) if depth else np.array([len(first)]))
            labels.append(np.stack([high[first], low[first]], axis=1))
            counts.append(spent[place[first]])
            node[alive] = number
            end[alive] = before + number
            before += len(first)
            levels.append(before)
            width, depth = len(first), depth + 1
            alive = alive[size[alive] > depth]
        degrees.append(np.zeros(width, np.int64))
        degree = np.concatenate(degrees)
        bits = np.ones(int(degree.sum()) + len(degree), bool)
        bits[np.cumsum(degree + 1) - 1] = False
        label = np.concatenate(labels) if labels else np.zeros((0, 2), np.uint64)
        return cls(bits, label, np.concatenate(counts) if counts else np.zeros(0, np.int64), np.array(levels)), end

    def __len__(self) -> int:
        return len(self.labels)

    def parents(self) -> np.ndarray:
        """The parent of each node: as many zeros stand before its 1 as there are nodes before the parent; -1 for roots."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros) - 1

    def child(self, node: int, label: tuple[int, int]) -> int | None:
        """The child of a node (-1: a root) with a label."""
        zeros = np.flatnonzero(~self.bits)
        first = 0 if node < 0 else int(zeros[node]) + 1 - (node + 1)
        last = int(zeros[node + 1]) - (node + 1)
        found = np.flatnonzero((self.labels[first:last] == np.array(label, np.uint64)).all(axis=1))
        return first + int(found[0]) if len(found) else None

    def rolled_up(self, values: np.ndarray, merge: np.ufunc = np.add) -> np.ndarray:
        """What each node and all below it have, from the last level to the first."""
        out, parent = values.copy(), self.parents()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            merge.at(out, parent[a:b], out[a:b])
        return out


def _turns(conversations: DataFrame) -> DataFrame:
    """(family, own, conv_id, turn, label, words) of conversations; own is false for the conversation that the family begins with."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    rows = conversations.where(conv.isNotNull()).select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), label_of(role, text).alias("label"), word_count(text).alias("words"))
    return rows.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), (F.col("conv_id") % FAMILY != 0).alias("own"), "*")


def label_of(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of families to (conv_id, labels, words): those of a conversation's first turns that the family's has instead, then its own.

    One conversation is held at a time.
    """
    family, head, conv, labels, words = None, ([], []), None, [], []
    out: list[tuple[int, bytes, list[int]]] = []

    def done() -> None:
        h = zlib.crc32(str(conv).encode()) % HEAD
        both = ((a[:h] + b[h:]) for a, b in zip(head, (labels, words), strict=True))
        out.append((conv, b"".join(next(both)), next(both)))

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["conv_id", "labels", "words"])
        out.clear()
        return batch

    for batch in batches:
        for f, own, c, label, n in zip(*(batch.column(x).to_pylist() for x in ("family", "own", "conv_id", "label", "words")), strict=True):
            if c != conv:
                if conv is not None:
                    done()
                if f != family:
                    family, head = f, ([], [])
                conv, labels, words = c, [], []
            labels.append(label)
            words.append(n)
            if not own and len(labels) < HEAD:
                head = (list(labels), list(words))
        yield flushed()
    if conv is not None:
        done()
        yield flushed()


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, labels, words, path): each conversation rebuilt, and the digest of its labels.

    A conversation c takes the first h turns of c - c % 20 (all if it has fewer) for its
    own first h, h being crc32 of its decimal id, modulo 4.
    """
    order = ["family", "own", "conv_id", F.col("turn").asc_nulls_first(), "label"]
    rows = _turns(conversations).repartition("family").sortWithinPartitions(*order).drop("turn")
    out = rows.mapInArrow(_rebuilt, "conv_id long, labels binary, words array<long>")
    return out.withColumn("path", F.unhex(F.sha2("labels", 256)))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range of (path, conv_id, labels, words) to rows of up to _IDS ids of one path, compressed."""
    current, carried, held = None, (), []

    def row() -> tuple:
        return (current, *carried, held[0], len(held), zlib.compress(",".join(map(str, held)).encode()))

    def emitted(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "labels", "words", "first", "n", "ids"])

    for batch in batches:
        rows = []
        for path, conv, *more in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "labels", "words")), strict=True):
            if held and (path != current or len(held) == _IDS):
                rows.append(row())
                held = []
            current, carried = path, more
            held.append(conv)
        yield emitted(rows)
    if held:
        yield emitted([row()])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs by path, in order, to a row for each path: its members' number, smallest id and digest."""
    current, carried, n, first, digest = None, (), 0, None, None

    def row() -> tuple:
        return (current, *carried, n, first, digest.hexdigest())

    def emitted(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "labels", "words", "n", "conv_id", "ends"])

    for batch in batches:
        rows = []
        for path, labels, words, least, some, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != current:
                if digest is not None:
                    rows.append(row())
                current, carried, n, first, digest = path, (labels, words), 0, least, hashlib.sha256()
            elif n:
                digest.update(b",")
            digest.update(zlib.decompress(ids))
            n += some
        yield emitted(rows)
    if digest is not None:
        yield emitted([row()])


def paths_of(rebuilt: DataFrame) -> DataFrame:
    """rebuilt(conv_id, labels, words, path) to (path, labels, words, n, conv_id, ends): each different conversation with its members."""
    ranges = int(rebuilt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rebuilt.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    packs = dealt.mapInArrow(_packs, "path binary, labels binary, words array<long>, first long, n long, ids binary")
    met = packs.repartition("path").sortWithinPartitions("path", "first")
    return met.mapInArrow(_members, "path binary, labels binary, words array<long>, n long, conv_id long, ends string")


def _prefix(labels: Column, depth: Column | int) -> Column:
    """What names the node at a depth of a path."""
    return F.unhex(F.md5(F.substring(labels, F.lit(1), (F.lit(LABEL) * depth).cast("int"))))


def _depths() -> list[int]:
    """Depths at which paths may be cut into shards: each about half as deep again as the one before."""
    out = [1]
    while out[-1] < 1 << 26:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def with_shards(paths: DataFrame, most: int = PATHS) -> DataFrame:
    """paths with `cut`, the least depth at which no more than `most` paths have their prefix in common, and `shard`, that prefix; null if there is none."""
    length = F.octet_length("labels") / LABEL
    depths = F.filter(F.array(*map(F.lit, _depths())), lambda d: d <= length)
    marks = paths.select("path", F.explode(F.transform(depths, lambda d: F.struct(d.alias("depth"), _prefix(F.col("labels"), d).alias("mark")))).alias("x")).select("path", "x.depth", "x.mark")
    heavy = marks.groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mark")
    cuts = marks.join(heavy, "mark", "left_anti").groupBy("path").agg(F.min("depth").alias("cut"))
    return paths.join(cuts, "path", "left").withColumn("shard", F.when(F.col("cut").isNotNull(), _prefix(F.col("labels"), F.col("cut"))))


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, prefix binary, prefix_words array<long>"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths in the order of their shards to the nodes of the shards' tries; roots carry the labels and words above them."""

    def nodes(rows: list[tuple]) -> pa.RecordBatch:
        shards = {s: i for i, s in enumerate(dict.fromkeys(r[0] for r in rows))}
        tree = np.array([shards[r[0]] for r in rows], np.int64)
        order = np.argsort(tree, kind="stable")
        rows, tree = [rows[i] for i in order], tree[order]
        cuts = [r[1] - 1 for r in rows]
        trie, end = Louds.built([np.frombuffer(r[2], np.uint64).reshape(-1, 2)[c:] for r, c in zip(rows, cuts, strict=True)], [np.array(r[3][c:], np.int64) for r, c in zip(rows, cuts, strict=True)], tree)
        count, least = np.zeros(len(trie), np.int64), np.full(len(trie), np.iinfo(np.int64).max)
        count[end], least[end] = [r[4] for r in rows], [r[5] for r in rows]
        count, least = trie.rolled_up(count), trie.rolled_up(least, np.minimum)
        parent, degree = trie.parents(), trie.degrees()
        saved = trie.rolled_up((count - 1) * trie.words)
        leaves = trie.rolled_up((degree == 0).astype(np.int64))
        ends = [_NOBODY] * len(trie)
        for e, r in zip(end.tolist(), rows, strict=True):
            ends[e] = r[6]
        roots = len(shards)
        first = np.searchsorted(tree, np.arange(roots))
        above = np.array(cuts, np.int64)[first]
        top = np.arange(len(trie))  # the root of each node
        for a, b in zip(trie.levels[1:-1], trie.levels[2:], strict=True):
            top[a:b] = top[parent[a:b]]
        depth = above[top] + np.repeat(np.arange(1, len(trie.levels)), np.diff(trie.levels))
        none = [None] * (len(trie) - roots)
        columns = [
            pa.array(least), pa.array(depth, pa.int64()), pa.array(np.where(parent >= 0, least[parent], 0), pa.int64(), mask=parent < 0), pa.array(count), pa.array(degree, pa.int64()), pa.array(leaves), pa.array(saved),
            pa.array(ends, pa.string()), pa.array([*(rows[i][2][: LABEL * c] for i, c in zip(first, above, strict=True)), *none], pa.binary()),
            pa.array([*(rows[i][3][:c] for i, c in zip(first, above, strict=True)), *none], pa.list_(pa.int64())),
        ]  # fmt: skip
        return pa.RecordBatch.from_arrays(columns, names=[x.strip().split(" ")[0] for x in _NODE.split(",")])

    held: list[tuple] = []
    turns = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "cut", "labels", "words", "n", "conv_id", "ends")), strict=True):
            if turns >= _FOREST and row[0] != held[-1][0]:
                yield nodes(held)
                held, turns = [], 0
            held.append(row)
            turns += len(row[3])
    if held:
        yield nodes(held)


def _upper(units: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes above the shards, from units(labels, words, n, conv_id, leaves, saved, ends), shards' roots (with the labels above them) and paths that end above all shards, and roots(prefix)."""
    depth = (F.octet_length("labels") / LABEL).cast("int")
    every = units.withColumn("k", F.explode(F.sequence(F.lit(0), depth)))
    here = F.col("k") == depth
    nodes = every.groupBy(_prefix(F.col("labels"), F.col("k")).alias("key"), F.col("k").alias("depth")).agg(
        F.any_value(F.substring("labels", F.lit(1), F.col("k") * LABEL)).alias("labels"), F.any_value(F.when(F.col("k") > 0, F.get("words", F.col("k") - 1)).otherwise(0)).alias("words"),
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(here, F.col("ends"))).alias("ends"),
    )  # fmt: skip
    nodes = stored(nodes, "upper")
    own = nodes.where("depth > 0").select(_prefix(F.col("labels"), F.col("depth") - 1).alias("key"))
    children = own.unionByName(roots.select(F.unhex(F.md5("prefix")).alias("key"))).groupBy("key").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"own": (F.col("n_convs") - 1) * F.col("words"), "leaf": (F.col("n_children") == 0).cast("long")})
    nodes = stored(nodes, "upper")
    above = nodes.select("own", "leaf", F.explode(F.transform(F.sequence(F.lit(0), "depth"), lambda k: _prefix(F.col("labels"), k))).alias("key"))
    sums = above.groupBy("key").agg(F.sum("own").alias("below_saved"), F.sum("leaf").alias("below_leaves"))
    out = nodes.join(sums, "key")
    parent = F.when(F.col("depth") > 0, F.substring("labels", F.lit(1), (F.col("depth") - 1) * LABEL))
    return out.select(
        "key", "conv_id", F.col("depth").cast("long").alias("depth"), "n_convs", "n_children", (F.col("leaves") + F.col("below_leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("below_saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NOBODY)).alias("ends"), parent.alias("prefix"),
    )  # fmt: skip


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each node.

    conversations(conv_id, turn, role, text); other columns are not read. Turns go by
    number, null first; those of one number by the MD5 of their length of role, role and
    text, by which turns are told apart too. A null role or text is empty; rows without a
    conv_id belong to no conversation. An empty table has no nodes, not even a root. A
    task holds one conversation's labels (24 bytes a turn) at a time, or a shard's.
    """
    rebuilt = stored(rebuilt_conversations(conversations), "rebuilt")
    paths = stored(with_shards(stored(paths_of(rebuilt), "paths")), "paths")
    dealt = paths.where("shard is not null").repartition("shard").sortWithinPartitions("shard")
    lower = stored(dealt.mapInArrow(_forest, _NODE), "nodes")
    roots = lower.where("prefix is not null")
    units = roots.select(F.col("prefix").alias("labels"), F.col("prefix_words").alias("words"), F.col("n_convs").alias("n"), "conv_id", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"))
    short = paths.where("shard is null").select("labels", "words", "n", "conv_id", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "ends")
    upper = stored(_upper(units.unionByName(short), roots), "upper")
    first = rebuilt.agg(F.min("conv_id")).first()[0]  # one number

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    # Nodes whose parents are in another table: those right below the root know it, the others ask for it.
    lost = roots.drop("parent_conv_id").unionByName(upper.where("depth > 0").drop("key"), allowMissingColumns=True)
    known = upper.select(F.col("key").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    deep = lost.where("depth > 1").withColumn("of", F.unhex(F.md5("prefix"))).join(known, "of")
    shallow = lost.where("depth = 1").withColumn("parent_conv_id", F.lit(first).cast("long"))
    top = upper.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = lower.where("prefix is null")
    for part in (deep, shallow, top):
        out = out.select(*columns).unionByName(part.select(*columns))
    return out.withColumnRenamed("ends", "ends_sha256")


# CRC-32 of the decimal digits of an id, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: list_transform(range(8), lambda i: (ascii(x) >> CAST(i AS INTEGER)) & 1)))), lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN 3988292384 ELSE 0 END)))"

TRIE_SQL = rf"""
WITH x AS (SELECT conv_id, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS label, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, label, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, label) AS i FROM x),
c AS (SELECT conv_id, h, (SELECT count(*) FROM t WHERE t.conv_id = q.conv_id - q.conv_id % {FAMILY} AND t.i <= h) AS g FROM (SELECT DISTINCT conv_id, CAST({_CRC} % {HEAD} AS BIGINT) AS h FROM t) q),
r AS (SELECT c.conv_id, t.i AS d, label, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.i - c.h + c.g, label, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
k AS (SELECT conv_id, d, words, md5(string_agg(label, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key, max(d) OVER (PARTITION BY conv_id) AS last FROM r
  UNION ALL SELECT conv_id, 0, 0, '', (SELECT coalesce(max(d), 0) FROM r WHERE r.conv_id = c.conv_id) FROM c),
u AS (SELECT k.*, p.key AS parent FROM k LEFT JOIN k p ON p.conv_id = k.conv_id AND p.d = k.d - 1),
n AS (SELECT key, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = last), '')) AS ends_sha256 FROM u GROUP BY key),
e AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.parent = n.key) AS n_children FROM n),
s AS (SELECT k.key, count(CASE WHEN n_children = 0 THEN 1 END) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM e JOIN k ON k.conv_id = e.conv_id AND k.d <= e.depth GROUP BY k.key)
SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256 FROM e JOIN s ON s.key = e.key LEFT JOIN n p ON p.key = e.parent
"""
