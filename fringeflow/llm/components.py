"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps are one grouped minimum and one join, so no vertex's neighbours are ever gathered in one place
beyond a sorted, spillable run, and the number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex's neighbours are tied to the least vertex of its neighbourhood."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.distinct()
    m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(m, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            m.where("u <> m").select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Rows (u, v): every vertex that is not the least of its component, and that least vertex."""
    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        nxt = scratch.save(_star(_star(now, True), False))
        scratch.drop(now)
        now = nxt
        state = now.agg(
            F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.count_distinct("u")
        ).first()
        if tuple(state) == seen and state[0] == state[2]:
            return now
        seen = tuple(state)
