"""Document fingerprints by consistent weighted sampling, DataFrame operations only.

Terms are the words of the text and weights their numbers. Of a term of weight w, the pairs (term, i) with 1 <= i <= w
are candidates, and each of SLOTS samples keeps the candidate of least hash: every unit of weight is as likely to be
kept, and the same pairs are asked in every text, so the sample is uniform and consistent. Two texts keep the same pair
with a probability equal to the generalised Jaccard similarity of their term weights, sum of minima over sum of maxima,
and the share of equal slots estimates it. For whole weights this is exact and needs no logarithms, unlike samples by
Gamma variates, which real weights need. A slot is the least of one long per candidate, whose lower bits are its name,
so a plain grouped minimum over numbers does the work.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

SLOTS = 128
TAG = 16  # bits of a slot
PACKED = 64 // TAG  # slots of one long of a signature
TOGETHER = 16  # slots of which one row takes care
_random = random.Random(7)
SALTS = [_random.getrandbits(62) for _ in range(TOGETHER)]
BLANK = r"[\x20\x09-\x0D]+"
CHARACTERS = 8_000_000  # of the texts of one task


def signatures(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sig (array of longs, PACKED slots in each) from rows (keys, h long, n int), one row per term and its weight.

    A candidate is repeated once for each TOGETHER slots, whose minima are kept side by side: the expressions of all
    slots at once would be too large a method to be compiled.
    """
    pairs = terms.select(*keys, "h", F.explode(F.expr("sequence(1, n)")).alias("i")).select(*keys, F.xxhash64("h", "i").alias("x"))
    rows = pairs.select(*keys, "x", F.explode(F.sequence(F.lit(0), F.lit(SLOTS // TOGETHER - 1))).alias("g")).select(*keys, "g", F.xxhash64("x", "g").alias("y"))
    least = rows.groupBy(*keys, "g").agg(*(F.expr(f"min(xxhash64(y ^ {salt}L))").alias(f"m{j}") for j, salt in enumerate(SALTS)))

    def packed(at: int) -> Column:
        return F.expr(" | ".join(f"shiftleft(m{at + k} & {(1 << TAG) - 1}L, {TAG * (PACKED - 1 - k)})" for k in range(PACKED)))

    part = F.struct("g", F.array(*(packed(j) for j in range(0, TOGETHER, PACKED))).alias("s"))
    return least.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"])).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots; two texts without terms are alike, one without is unlike any other."""
    low = (1 << TAG) - 1

    def equal(z: Column) -> Column:
        lanes = (F.when(F.shiftrightunsigned(z, TAG * k).bitwiseAND(F.lit(low)) == 0, 1).otherwise(0) for k in range(PACKED))
        return sum(lanes, F.lit(0))

    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, z: n + equal(z)) / F.lit(SLOTS)
    return F.when(a.isNull() | b.isNull(), F.when(a.isNull() & b.isNull(), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(same)


def _hex(sig: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def term_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (keys, h, n): the distinct words of each text and how often it has them. No shuffle where the rows are dealt by the first key."""
    words = texts.select(*keys, F.explode(F.split(text, BLANK)).alias("w")).where("w <> ''").select(*keys, F.xxhash64("w").alias("h"))
    return words.groupBy(*keys, "h").agg(F.count("*").cast("int").alias("n"))


KEY = ["k_known", "k_id", "k_text"]  # whether there is an id, the id, a hash of the text


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.isNotNull().alias("k_known"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("k_id"), F.xxhash64(text).alias("k_text"), text.alias("text"))


def neighbours(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds next and prev (structs of KEY and n) to rows (KEY, n, c), unique and in ascending order, the last one followed by the first.

    Rows are dealt by ranges of their order and saved; inside a range a window tells, and of every range the first and
    last rows are carried to its neighbours: a table of one row a range, however the ids lie.
    """
    me = F.struct(*KEY, "n")
    dealt = scratch.save(ids.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*KEY)
    inner = dealt.withColumn("next", F.lead(me).over(inside)).withColumn("prev", F.lag(me).over(inside))
    ends = dealt.groupBy("part").agg(F.min(me).alias("lo"), F.max(me).alias("hi"))
    order, whole = Window.orderBy("part"), Window.partitionBy()
    ends = ends.select(
        "part",
        F.coalesce(F.lead("lo").over(order), F.min("lo").over(whole)).alias("after"),
        F.coalesce(F.lag("hi").over(order), F.max("hi").over(whole)).alias("before"),
    )
    return inner.join(F.broadcast(ends), "part").select(*KEY, "n", "c", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def _measured(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """KEY, c (equal rows), next, n_chars, own (signature), and of the last of the equal rows sha and edit, of the others
    inner_sha and inner_edit."""
    texts = _keyed(docs)
    ids = texts.select(*KEY, F.length("text").alias("n")).groupBy(*KEY).agg(F.first("n").alias("n"), F.count("*").alias("c"))
    near = scratch.save(neighbours(ids, scratch))
    chars = near.agg(F.sum("n")).first()[0] or 0
    # what a task holds grows with its texts' words, so tasks are cut by the number of characters
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + chars // CHARACTERS)
    # the texts are shuffled once; equal rows are one from here on
    one = F.row_number().over(Window.partitionBy(*KEY).orderBy("k_id"))
    rows = texts.repartition(parts, *KEY).withColumn("copy", one).where("copy = 1").drop("copy").join(near, KEY)
    heads = rows.select(*(F.col(f"prev.{k}").alias(k) for k in KEY), F.expr("substring(text, 1, cast(prev.n div 2 as int))").alias("head"))
    both = rows.join(heads.repartition(parts, *KEY), KEY).withColumn("half", F.expr("cast(n div 2 as int)"))
    kept = F.expr("substring(text, 1, n - half)")
    # of rows that repeat each is followed by the next copy, and the last copy by the next text
    inner = F.when(F.col("c") > 1, F.concat(kept, F.expr("substring(text, 1, half)")))
    both = both.select(*KEY, "c", "next", "n", "text", F.concat(kept, F.col("head")).alias("edited"), inner.alias("inner"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    told = both.select(*KEY, "c", "next", F.col("n").cast("long").alias("n_chars"), sha("edited").alias("sha"), sha("inner").alias("inner_sha"))
    parted = both.select(*KEY, F.posexplode(F.array("text", "edited", "inner")).alias("kind", "t")).where("t is not null")
    sig = signatures(term_rows(parted, [*KEY, "kind"], "t"), [*KEY, "kind"])
    pair = sig.groupBy(*KEY).agg(*(F.max(F.when(F.col("kind") == i, F.col("sig"))).alias(n) for i, n in enumerate(("own", "edit", "inner_edit"))))
    return told.join(pair, KEY, "left")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's, in ascending order of ids, the last document being followed by the first; a single document follows
    itself. A null text is empty; its fingerprint is the empty string. Rows without an id come first; rows that share an
    id follow one another by a hash of their texts, and equal rows each other. An empty table gives no rows. Other
    columns are not read.
    """
    # saved once, with what the texts are still needed for: it is read for a document and for the one before it
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = scratch.save(_measured(docs, scratch))
    scratch.tidy()  # the shuffled texts
    following = rows.select(*(F.col(c).alias("n_" + c) for c in KEY), F.col("own").alias("following"))
    met = rows.select("*", *(F.col(f"next.{c}").alias("n_" + c) for c in KEY)).join(following, ["n_" + c for c in KEY], "left")

    def shown(sha: str, edit: str, near_next: Column) -> tuple:
        return (
            F.when(F.col("k_known"), F.col("k_id")).alias("doc_id"), "n_chars", F.col(sha).alias("edited_sha256"), _hex(F.col("own")).alias("fingerprint"),
            _hex(F.col(edit)).alias("edited_fingerprint"), likeness(F.col("own"), F.col(edit)).alias("near_edited"), near_next.alias("near_next"),
        )

    last = met.select(*shown("sha", "edit", likeness(F.col("own"), F.col("following"))))
    others = rows.where("c > 1").withColumn("again", F.explode(F.sequence(F.lit(2), F.col("c").cast("int"))))
    return last.union(others.select(*shown("inner_sha", "inner_edit", F.lit(1.0))))
