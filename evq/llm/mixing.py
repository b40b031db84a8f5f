"""Mixing sources to target weights: capped water-filling and a seeded sample of whole and fractional repetitions.

Targets: every source asks for its share of the mix by weight, and may not be repeated more than ``max_epochs`` times.
Sources whose share is above that are clamped; what they leave goes to the others by weight, until none is above. Each
round is one aggregate over the table of sources, and only its two sums reach the driver.

Sample: a document of a source with target rate 1.3 is taken once, and 0.3 of the source's words are taken once more. Which
ones is decided by a seeded digest of the row: in the order of digests, documents are taken until the words are reached
(the last one where that comes nearer). The order is cut at the first hexadecimal digits of the digest, so that sums per
(source, digits) decide all documents but those of one small bucket per source, and no task sees a whole source.

A null source is a source of its own, the last one; a null text has no words; an empty table gives no rows. Rows are
documents, also where ids repeat; equal rows are interchangeable. Reruns agree, whatever the partitions. Words are runs of
characters other than U+0020 and U+0009-000D. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.operators.ordering import split_row_number
from evq.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Hexadecimal digits of the digest that make a bucket.
DIGITS = 4


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null, in the order of the sources with null last."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("2"))


def measured(docs: DataFrame, key: str, text: str, source: str, size: Column | None, seed: int) -> DataFrame:
    """id, key of the source, size and digest of every document, without its text."""
    own = word_count(F.col(text).cast("string")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")),
                               F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    return docs.select(F.col(key).alias("id"), source_key(F.col(source)).alias("source"), own.alias("size"), digest.alias("digest"))


def weighed(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight``: the weights in turn, over the sources in their order."""
    numbered = split_row_number(sizes, [], [F.col("source").asc()], "place")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    return numbered.withColumn("weight", F.get(turn, (F.pmod(F.col("place") - 1, F.lit(len(weights)))).cast("int"))).drop("place")


def fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: capped shares of ``total`` words.

    Rounds go on until no free source is above its cap; each one clamps a source at least. If all are clamped, the mix is
    smaller than ``total``. The level of a round is that of all sources clamped before, so it only rises.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        free = cap > F.col("weight") * F.lit(level) if clamped >= 0 else F.lit(True)
        state = sources.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight"))), F.count(F.when(~free, 1))).first()
        held, weight, now = state[0] or 0.0, state[1] or 0.0, state[2]
        if now == clamped or not weight:
            break
        level, clamped = (total - held) / weight, now
    target = F.least(cap, F.col("weight") * F.lit(level)) if weight else cap
    return sources.withColumn("target", target)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None,
        weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """id, size, source_size, target (of the source) and repeats (how often the mix takes the document).

    ``share``: words of the mix in words of all sources; ``size``: a measure of rows (words by default); ``weights`` are
    positive and given to the sources in turn.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    rows = materialize(measured(docs, key, text, source, size, seed).withColumn("bucket", F.substring("digest", 1, DIGITS)), "mix-rows")
    buckets = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    sizes = materialize(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    plan = fill(materialize(weighed(sizes, weights), "mix-weights"), share * total, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(rate)).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    # The bucket of every source in which its quota is reached, and the words before it.
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = buckets.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(plan.select("source", "quota"), "source")
    ends = ends.where("before <= quota and quota < before + size").select("source", F.col("bucket").alias("end"), "before")
    plan = materialize(plan.join(ends, "source", "left"), "mix-plan")
    planned = rows.join(plan, "source")
    columns = ["id", "size", "source_size", "target"]
    # Away from that bucket all is decided; sources whose quota is all of their words have no such bucket.
    once = F.when(F.col("quota") <= 0, 0).when(F.col("end").isNull() | (F.col("bucket") < F.col("end")), 1).otherwise(0)
    clear = planned.where("end is null or bucket <> end").select(*columns, (F.col("whole") + once).alias("repeats"))
    within = Window.partitionBy("source").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    last = planned.where("bucket = end").withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    near = (2 * F.col("before") + F.col("size") <= 2 * F.col("quota")).cast("int")
    return clear.unionByName(last.select(*columns, (F.col("whole") + near).alias("repeats")))
