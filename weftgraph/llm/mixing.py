"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

_BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources(source, source_size, weight) with target, a double.

    The targets are what repeated clamping comes to: each source gets weight times one
    level, sources above max_epochs times their size are held there, and their excess
    raises the level of the others. In the order of size by weight the held sources come
    first, so that one running sum over the table of sources finds the level. A source
    of size 0 gets 0; the budget is a share of all sizes.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    total = F.sum("source_size").over(every) * F.lit(float(budget))
    x = sources.withColumns({
        "held": F.coalesce(F.sum(cap).over(below), F.lit(0.0)),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0)),
        "total": total,
    })
    x = x.withColumn("level", (F.col("total") - F.col("held")) / F.col("weights"))
    # Up to the first source whose share at its own level stays within its cap, sources are held.
    x = x.withColumn("free", (F.col("level") * F.col("weight") <= cap).cast("int"))
    level = F.max(F.when(F.col("free") == 1, F.col("level"))).over(every)  # levels rise while sources are held, then fall
    return x.withColumn("target", F.coalesce(F.least(cap, level * F.col("weight")), cap)).drop("held", "weights", "total", "level", "free")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17, carry: bool = False,
) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, repeats, taken, source; with carry also `row`, all its columns.

    Sources in code-point order, null last, weigh by `weights` in turn. Of a source whose
    target is e times its size every document is taken floor(e) times, and once more
    those that a seeded order puts first, until the words come nearest to the target.
    The order is by a hash of seed, id and text: reruns agree, and rows that repeat both
    are in or out by the hash of all of them (ties are taken together). Every decision is
    made for a row, so that rows that repeat only an id, or have none, stand for themselves.
    Null ids and null sources are values like any other. An empty text has size 0.

    The order is not sorted as a whole: sizes are summed for each of 4096 ranges of the
    hash, and only documents of the range in which the target falls are ranked.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("u"), *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    base = stored(base.withColumn("bin", F.shiftrightunsigned("u", 52).cast("int")), "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(place) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    plan = water_filled(sums.withColumn("weight", weight), budget, max_epochs)
    size = F.col("source_size")
    plan = plan.withColumn("whole", F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(int(max_epochs)))).otherwise(0).cast("int"))
    plan = stored(plan.withColumn("need", F.col("target") - F.col("whole") * size), "plan")

    bins = base.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("q.source"))
    edge = (
        bins.alias("q").join(plan.alias("p"), same)
        .where((F.col("below") < F.col("need")) & (F.col("below") + F.col("words") >= F.col("need")))
        .select("p.source", "q.bin", "q.below", "p.need")
    )
    edge = stored(edge, "edges")
    inside = base.alias("p").join(edge.alias("q"), same & (F.col("p.bin") == F.col("q.bin"))).select("p.source", "p.u", "p.size", "q.below", "q.need")
    ties = inside.groupBy("source", "below", "need", "u").agg(F.sum("size").alias("size"))
    run = F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("u"))
    ranked = ties.withColumn("run", run).select("source", "below", "u", F.abs(F.col("run") - F.col("need")).alias("off"), F.abs(F.col("below") - F.col("need")).alias("none"))
    nearest = ranked.groupBy("source").agg(F.min(F.struct("off", "u")).alias("x"), F.min("none").alias("none"))
    cut = edge.select("source", "bin").alias("p").join(nearest.alias("q"), same).select(
        F.col("p.source").alias("source"), "bin", F.when(F.col("x.off") < F.col("none"), F.col("x.u")).alias("last"),
    )
    plan = plan.alias("p").join(cut.alias("q"), same, "left").select("p.*", "q.bin", "q.last").withColumnRenamed("bin", "edge")
    plan = stored(plan.select("source", "source_size", "target", "whole", "edge", "last"), "plan")
    extra = F.when(F.col("q.edge").isNull(), 0).when(F.col("p.bin") < F.col("q.edge"), 1).when(F.col("p.bin") > F.col("q.edge"), 0).otherwise(
        F.coalesce((F.col("p.u") <= F.col("q.last")).cast("int"), F.lit(0))
    )
    out = base.alias("p").join(plan.alias("q"), same).select("p.doc_id", "p.size", "q.source_size", "q.target", (F.col("q.whole") + extra).alias("repeats"), F.col("p.source").alias("source"), *(["p.row"] if carry else []))
    return out.withColumn("repeats", F.least("repeats", F.lit(int(max_epochs)))).withColumn("taken", (F.col("repeats") * F.col("size")).cast("long"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; options are those of `mixed`."""
    taken = mixed(docs, carry=True, **options).where("repeats > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("repeats"))).alias("row")).select("row.*")
