"""Mixing sources to target weights by capped water-filling, DataFrame operations only.

A source's target is min(cap, level * weight), where cap is the most epochs times its size and the one level is set
so that the targets add up to the budget: what repeated clamping and proportional redistribution arrives at. Sources
fill up in the order of cap / weight, so the level follows from one running sum over the table of sources.

Each text is taken floor(target / size) whole times. The rest of the target is met by a seeded order of the source's
texts: those whose running size stays within the rest are taken once more, and the one text at the boundary in part.
The order is dealt into hash slots, whose sizes are summed first; only the slot at the boundary needs an order within,
so a source with a third of all rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SLOTS = 65_536
GROUP = 256  # slots of a group
BROADCAST = 10_000  # sources up to which their table is broadcast


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: Column, most_epochs: float) -> DataFrame:
    """Adds `target` to (source, source_size, weight, budget columns...): one row per source, a table of the size of the list of sources.

    A budget beyond what all caps allow fills every cap. Sources of size zero have target zero.
    """
    s = sources.withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs))).withColumn("_budget", budget)
    order = [F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_open", F.sum("weight").over(onward))
    s = s.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
    # the level is that of the first source that it does not fill
    first = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level"))))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_level", first.over(whole)["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("weight")))
    return s.withColumn("target", target).drop("_cap", "_budget", "_full", "_open", "_level")


def _slot(seed: str) -> Column:
    """A seeded number of 32 bits of the id, from MD5 so that any engine can repeat it. Rows without an id go by their size."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.col("size").cast("string")))
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")


def mix(
    sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: tuple[int, int] = (150, 100), most_epochs: int = 2, seed: str = "mix"
) -> DataFrame:
    """Adds source_size, target and taken to rows (doc_id, source, size).

    Sources in code point order, null last, take the weights in turn. taken: the words of the text that the mix takes,
    repeats counted, at most `most_epochs` times its size; each source's sum is its target rounded down. Rows that
    repeat an id are ordered by size; equal rows share one fate up to the one cut in part.
    """
    r = sized.withColumn("_slot", _slot(seed)).withColumn("_fine", F.col("_slot"))
    r = r.withColumn("_slot", F.expr(f"_slot div {2**32 // SLOTS}"))
    scratch = Scratch(sized.sparkSession, "mixing")
    slots = scratch.save(r.groupBy("source", "_slot").agg(F.sum("size").alias("_size")))  # at most SLOTS rows a source
    groups = slots.groupBy("source", F.expr(f"_slot div {GROUP}").alias("_group")).agg(F.sum("_size").alias("_sum"))
    sources = groups.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy())
    filled = water_fill(sources.withColumn("weight", w), total * share[0] / share[1], most_epochs)
    filled = filled.withColumn("_want", F.floor("target").cast("long"))
    filled = filled.withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_want div source_size")).otherwise(F.lit(0)).cast("long"))
    filled = filled.withColumn("_rest", F.col("_want") - F.col("_whole") * F.col("source_size")).drop("_want", "weight")
    # running sums in two steps, over groups of slots and over the slots of a group: a window's rows are at most
    # SLOTS / GROUP and GROUP, whatever the source's share of all rows
    over_groups = Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source", "_group").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "_group", F.coalesce(F.sum("_sum").over(over_groups), F.lit(0)).alias("_start"))
    slots = slots.withColumn("_group", F.expr(f"_slot div {GROUP}")).withColumn("_inner", F.coalesce(F.sum("_size").over(inside), F.lit(0)))

    def by_source(left: DataFrame, right: DataFrame, how: str = "inner", *more: str) -> DataFrame:
        right = right.withColumnsRenamed({c: "_r" + c for c in ("source", *more)})
        test = F.col("source").eqNullSafe(F.col("_rsource"))
        for c in more:
            test = test & (F.col(c) == F.col("_r" + c))
        return left.join(right, test, how).drop(*("_r" + c for c in ("source", *more)))

    slots = by_source(slots, groups, "inner", "_group").withColumn("_before", F.col("_start") + F.col("_inner"))
    filled = scratch.save(filled)
    few = filled.count() <= BROADCAST
    plan = by_source(slots, F.broadcast(filled) if few else filled)
    edge = plan.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_size") > F.col("_rest")))
    # without an edge the rest is a whole number of slots
    last = plan.where(F.col("_before") + F.col("_size") <= F.col("_rest"))
    ends = edge.select("source", F.col("_slot").alias("_edge"), "_before", F.lit(None).cast("long").alias("_last")).union(
        last.select("source", F.lit(None).cast("long"), F.lit(None).cast("long"), "_slot")
    )
    ends = ends.groupBy("source").agg(F.max("_edge").alias("_edge"), F.max("_before").alias("_before"), F.max("_last").alias("_last"))
    known = scratch.save(by_source(filled, ends, "left"))
    rows = by_source(r, F.broadcast(known) if few else known)
    at_edge = F.col("_slot") == F.col("_edge")
    cut = rows.where(F.coalesce(at_edge, F.lit(False)))
    inner = Window.partitionBy("source").orderBy("_fine", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(inner), F.lit(0))))
    cut = cut.withColumn("_more", part.cast("long"))
    rest = rows.where(~F.coalesce(at_edge, F.lit(False))).withColumn(
        "_more", F.when(F.coalesce(F.col("_slot") <= F.col("_last"), F.lit(False)), F.col("size")).otherwise(F.lit(0)).cast("long")
    )
    both = rest.unionByName(cut)
    keep = [c for c in sized.columns]
    return both.select(*keep, "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_more")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (columns doc_id, text, source)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = Scratch(docs.sparkSession, "sizes").save(sized)  # ids and sizes only: the texts are read once
    return mix(sized, **how).select("doc_id", "size", "source_size", "target", "taken")


def expand(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each text whole as often as it is taken whole, then its first words where it is taken in part.

    A text of size zero is not taken. Columns are those of docs, whatever their names; n_chars follows the text where
    it is cut. An empty table stays empty.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    m = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), whole), **how).where("taken > 0")
    m = m.withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    m = m.withColumn("words", F.col("taken") - (F.col("part") - 1) * F.col("size"))
    short = F.col("words") < F.col("size")
    first = F.expr("array_join(slice(filter(split(row.text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> ''), 1, cast(words as int)), ' ')")
    out = {"text": F.when(short, first).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(short, F.length(first).cast(kind)).otherwise(F.col("row.n_chars"))
    return m.select(*(out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
