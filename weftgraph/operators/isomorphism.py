"""Whether graphs are equal but for the names of their blank nodes.

A blank node is known by what it says: the hash of its predicates and objects, where
blank objects stand for their own hashes. Nodes that hold no blank ones are named first,
then those that hold named ones alone, and so on, so that a round has only what is not
named yet. Cycles and what holds them are left; rounds of joins refine their hashes until
no more of them can be told apart. Graphs are equal if they have the same names and
triples, each as often.

Where blank nodes are known to be local to parts of a graph that a task can hold, such as
schemas, the same is worked out part by part, and nothing but differences is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import kept, let_go


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def _name() -> Column:
    """What a node says itself and the names that it holds, as its own name."""
    held = F.transform("below", lambda b: F.concat(b["p"], F.lit(" "), F.hex(b["name"])))
    return _sha(F.concat(F.hex("own"), F.lit("\n"), F.array_join(F.array_sort(held), "\n")))


def _held(pending: DataFrame, named: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pending with the names that what its nodes hold has in named, besides those it has already."""
    rows = pending.select(*keys, "node", "own", "n", F.explode("below").alias("b")).select(*keys, "node", "own", "n", "b.p", "b.o", F.col("b.name").alias("before"))
    found = rows.join(named.select(*keys, F.col("node").alias("o"), F.col("name").alias("found")), [*keys, "o"], "left")
    below = F.collect_list(F.struct("p", "o", F.coalesce("before", "found").alias("name")))
    return found.groupBy(*keys, "node").agg(F.any_value("own").alias("own"), F.any_value("n").alias("n"), below.alias("below"))


def names(triples: DataFrame, keys: Sequence[str] = ("graph", "doc")) -> DataFrame:
    """(keys, node, name, n): the hash of every blank node that says anything, and the number of its triples, in each graph that keys tell.

    Blank nodes that say the same have one name, as in trees they may: which of them is
    meant makes no difference to what holds them. Those that say nothing are held as an empty name.
    """
    c, blank = F.col, triples.where("s_kind = 'bnode'")
    said = F.when(c("o_kind") != "bnode", F.to_json(F.struct("p", "o_kind", "o", "o_dt")))
    holds = F.when(c("o_kind") == "bnode", F.struct("p", "o", F.lit(None).cast("binary").alias("name")))
    own = _sha(F.array_join(F.array_sort(F.collect_list(said)), "\n"))
    nodes = kept(blank.groupBy(*keys, c("s").alias("node")).agg(own.alias("own"), F.count("*").alias("n"), F.collect_list(holds).alias("below")))
    row = (*keys, "node", _name().alias("name"), "n")
    last, pending = nodes.where(F.size("below") == 0).select(*row), nodes.where(F.size("below") > 0)
    silent = pending.select(*keys, F.explode("below.o").alias("node")).distinct().join(nodes.select(*keys, "node"), [*keys, "node"], "left_anti")
    made, given = [last], last.drop("n").unionByName(silent.select(*keys, "node", F.lit("").cast("binary").alias("name")))
    while True:
        step = kept(_held(pending, given, keys))
        ready = F.forall("below", lambda b: b["name"].isNotNull())
        given, pending = step.where(ready).select(*row), step.where(~ready)
        if given.isEmpty():
            break
        made.append(given)
    if not pending.isEmpty():
        now, known = pending.select(*keys, "node", F.lit("cycle").cast("binary").alias("name")), 0
        while True:
            before, now = now, kept(_held(pending, now, keys).select(*row))
            count = now.select(*keys, "name").distinct().count()
            if known:
                let_go(before)
            if count == known:
                break
            known = count
        made.append(now)
    return reduce(DataFrame.unionByName, made)


def compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """(graph, doc, same, only_one, only_two): whether both have each graph of each document alike, and how many triples only one of them has."""
    columns, c = ("graph", "doc", "s", "s_kind", "p", "o", "o_kind", "o_dt"), F.col
    # Both at once, so that the names of both are of the same round.
    both = one.select(*columns, F.lit(1).alias("side")).unionByName(two.select(*columns, F.lit(-1).alias("side")))
    keys = ("side", "graph", "doc")
    named = names(both, keys)
    # Nodes of one name have the same triples.
    blank = named.groupBy("graph", "doc", "name").agg(F.sum(c("side") * c("n")).alias("n")).drop("name")
    iris = both.where("s_kind <> 'bnode'")
    held = iris.where("o_kind = 'bnode'").join(named.select(*keys, c("node").alias("o"), "name"), [*keys, "o"], "left").withColumn("o", F.coalesce(F.hex("name"), F.lit(""))).drop("name")
    rest = iris.where("o_kind <> 'bnode'").unionByName(held).groupBy(*columns).agg(F.sum("side").alias("n")).select("graph", "doc", c("n").cast("long"))
    return _told(blank.unionByName(rest))


def _told(counts: DataFrame) -> DataFrame:
    """What `compared` gives, of counts(graph, doc, n): by how many triples of some name one has more than two."""
    c, more = F.col, lambda x: F.sum(F.greatest(x, F.lit(0)))
    x = counts.groupBy("graph", "doc").agg(more(c("n")).alias("only_one"), more(-c("n")).alias("only_two"))
    return x.select("graph", "doc", ((c("only_one") == 0) & (c("only_two") == 0)).alias("same"), "only_one", "only_two")


def compared_by_parts(both: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The same as `compared` of triples whose side is 1 or -1, where names of blank nodes are local to a part of a graph, which columns tell.

    A part of both sides is held by one task. Names that both sides have as often within a
    part go no further; parts need not be the same on both sides. Triples that lie in
    partitions of doc and parts, or some of these, are not shuffled.
    """
    c, blank = F.col, lambda x: c(f"{x}_kind") == "bnode"
    said = F.to_json(F.struct(*[F.when(~blank("s"), c(x)).alias(x) for x in ("s_kind", "s")], "p", *[F.when(~blank("o"), c(x)).alias(x) for x in ("o_kind", "o", "o_dt")]))
    # The window brings the triples of a part together and says how many there are.
    size = F.count("*").over(Window.partitionBy("graph", "doc", *parts))
    rows = both.select("graph", "doc", "side", F.when(blank("s"), c("s")).alias("node"), F.when(blank("o"), c("o")).alias("held"), said.alias("said"), size.alias("size"))
    left = rows.mapInArrow(_left, "graph string, doc string, name binary, n long")
    return _told(left.groupBy("graph", "doc", "name").agg(F.sum("n").alias("n")))


def _left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(graph, doc, name, n) of the rows of parts, one part after another: what one side has more often, and every graph once at least."""
    part, out, last = [], [], None
    names, types = ("graph", "doc", "name", "n"), (pa.string(), pa.string(), pa.binary(), pa.int64())
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
    for b in batches:
        graphs, docs = b.column("graph"), b.column("doc")
        rows, sizes, at = list(zip(*[b.column(x).to_pylist() for x in ("side", "node", "held", "said")])), b.column("size"), 0
        while at < len(rows):
            end = min(len(rows), at + sizes[at].as_py() - len(part))
            part += rows[at:end]
            if len(part) == sizes[at].as_py():
                graph, doc = graphs[at].as_py(), docs[at].as_py()
                out += [(graph, doc, bytes.fromhex(name), n) for name, n in _netted(part).items() if n]
                if last != (graph, doc):
                    last = (graph, doc)
                    out.append((graph, doc, b"", 0))
                part = []
                if len(out) >= 10000:
                    yield batch()
                    out = []
            at = end
    if out:
        yield batch()


def _netted(part: Iterable[tuple[int, str | None, str | None, str]]) -> dict[str, int]:
    """Of the rows (side, node, held, said) of a part, how many more triples of a name the first side has.

    The name of a blank node stands for its triples, any other triple is its own name.
    """
    sides, net = {1: ({}, []), -1: ({}, [])}, defaultdict(int)
    for side, node, held, said in part:
        nodes, rest = sides[side]
        (rest if node is None else nodes.setdefault(node, [])).append((said, held))
    for side, (nodes, rest) in sides.items():
        names = _named(nodes)
        for node, lines in nodes.items():
            net[names[node]] += side * len(lines)
        for line in rest:
            net[_hash([line], names)] += side
    return net


def _hash(lines: Iterable[tuple[str, Hashable | None]], names: Mapping[Hashable, str]) -> str:
    """The hash of lines (said, held), in which names stand for what is held. JSON has no line breaks."""
    return sha256("\n".join(sorted([said if held is None else f"{said} {names.get(held, '')}" for said, held in lines])).encode()).hexdigest()


def _named(nodes: Mapping[Hashable, list[tuple[str, Hashable | None]]]) -> dict[Hashable, str]:
    """The names of nodes, each with its lines (said, held); what is no node itself is held as an empty name.

    Cycles are the strongly connected components (Tarjan), which come after all that they
    hold. The nodes of one are refined until no more of them can be told apart; then each
    is named by its own hash and those of the whole component, since nodes of two
    components may look alike for as many rounds and not for one more.
    """
    below = {node: [o for _, o in lines if o is not None and o in nodes] for node, lines in nodes.items()}
    names, seen, low, open_ = {node: _hash(nodes[node], {}) for node, more in below.items() if not more}, {}, {}, []
    for start in below:
        if start in names:
            continue
        seen[start] = low[start] = len(seen)
        open_.append(start)
        path = [(start, iter(below[start]))]
        while path:
            node, more = path[-1]
            for o in more:
                if o in names:
                    continue
                if o not in seen:
                    seen[o] = low[o] = len(seen)
                    open_.append(o)
                    path.append((o, iter(below[o])))
                    break
                low[node] = min(low[node], seen[o])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == seen[node]:
                    at = len(open_) - 1
                    while open_[at] != node:
                        at -= 1
                    ring = open_[at:]
                    del open_[at:]
                    if len(ring) == 1 and node not in below[node]:
                        names[node] = _hash(nodes[node], names)
                    else:
                        names |= _ring(ring, nodes, names)
    return names


def _ring(ring: Sequence[Hashable], nodes: Mapping[Hashable, list[tuple[str, Hashable | None]]], names: Mapping[Hashable, str]) -> dict[Hashable, str]:
    """The names of the nodes of a strongly connected component; names has those of what it holds."""
    below = {o: names[o] for node in ring for _, o in nodes[node] if o in names}
    now, known = dict.fromkeys(ring, "cycle"), 0
    while True:
        held = below | now
        now = {node: _hash(nodes[node], held) for node in ring}
        count = len(set(now.values()))
        if count == known:
            break
        known = count
    every = "".join(sorted(now.values()))
    return {node: sha256(f"cycle {name} {every}".encode()).hexdigest() for node, name in now.items()}
