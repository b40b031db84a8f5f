"""Row-selection build: membership, plausibility, dedupe, score, best rows per group, ids, audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.functions import policy
from evq.functions.text import pin
from evq.operators import ordering


@dataclass(frozen=True)
class SelectSpec:
    member_key: str  # column that must be in the member table
    group: str  # at most per_group rows per value of this column
    identity: str  # one row per (group, identity)
    seq: str  # unique column that says which row came first
    reasons: Sequence[Column]  # first non-NULL reason rejects a row
    signals: Sequence[Column]  # one confidence point each
    prefer: Sequence[Column]  # ranking conditions, before 'high confidence'
    per_group: int = 10
    limit: int = 500
    prefix: str = "FOC_"
    not_member: str = "firm not in curated firm list"
    duplicate: str = "duplicate person within firm"


@dataclass(frozen=True)
class Selection:
    selected: DataFrame
    audit: DataFrame


def select_rows(rows: DataFrame, members: DataFrame, spec: SelectSpec) -> Selection:
    """Selected rows with ids, and the audit of every rejected row.

    ``members`` holds each member key once.
    """
    listed = members.select(spec.member_key).withColumn("_member", F.lit(True))
    joined = rows.join(listed, spec.member_key, "left")
    reason = F.coalesce(F.when(F.col("_member").isNull(), F.lit(spec.not_member)), *spec.reasons)
    judged = pin(joined, reason=reason).drop("_member")
    kept = judged.where(F.col("reason").isNull()).drop("reason")

    scored = ordering.keep_first(kept, [spec.group, spec.identity], [F.col(spec.seq)]).withColumn(
        "confidence", policy.additive_bucket(spec.signals))
    order = [c.desc() for c in spec.prefer] + [(F.col("confidence") == "high").desc(), F.col(spec.seq)]
    ranked = ordering.top_n_per_group(scored, [spec.group], order, spec.per_group)
    # The result is capped by spec.limit rows, so one ordered task numbers them.
    final = ordering.page(ranked, [F.col(spec.group), F.col("rank")], spec.limit, max_limit=10_000)
    numbered = ordering.sequential_ids(final, [F.col(spec.group), F.col("rank")], spec.prefix, bounded=True)

    flagged = ordering.flag_first(kept.select(spec.group, spec.identity, spec.seq), [spec.group, spec.identity], spec.seq)
    copies = flagged.where(~F.col("is_first")).select(spec.seq, F.lit(spec.duplicate).alias("reason"))
    audit = judged.where(F.col("reason").isNotNull()).select(spec.seq, "reason").unionByName(copies)
    return Selection(numbered, audit)
