"""Exact vector retrieval for a table of queries, with refusal gates and evidence bindings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions import intents, policy
from evq.functions.text import contains_any, text_or_empty

# Distance above which a query is refused, and the bonus of a title hit.
REFUSE_DISTANCE = 0.50
TITLE_BONUS = 0.15


@dataclass(frozen=True)
class TopK:
    """Shape of a top-k search: column names, k, queries of one pass over the corpus (and their bytes), queries of a block, records of a tile."""

    k: int = 10
    query_id: str = "query_id"
    query_vec: str = "query_vec"
    phrase: str | None = None  # query column: phrase that earns the bonus
    record_id: str = "record_id"
    record_vec: str = "record_vec"
    title: str | None = None  # record column searched for the phrase
    bonus: float = TITLE_BONUS
    digits: int = 6
    pass_rows: int = 16_384
    pass_bytes: int = 64 << 20
    block_rows: int = 1024
    tile_rows: int = 2048


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two array columns, in double; vectors need not be normalised."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def usable(vector: Column) -> Column:
    """Has a vector a direction: no null or non-finite component, and not all of them zero?"""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x.cast("double")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.asarray(vectors.tolist(), dtype=np.float64)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # squares of very small or large components stay in range
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _tile(query: pd.DataFrame, unit: np.ndarray, record: pd.DataFrame, spec: TopK) -> pd.DataFrame:
    """Top k records of one tile for every query, by (rounded effective distance, record id)."""
    distance = 1.0 - unit @ _unit(record["vec"]).T
    effective = distance.copy()
    if spec.phrase:
        titles = record["title"].fillna("").str.lower()
        for phrase in query["phrase"].dropna().unique():
            hit = titles.str.contains(phrase, regex=False).to_numpy()
            effective[np.ix_((query["phrase"] == phrase).to_numpy(), hit)] -= spec.bonus
    effective = np.round(effective, spec.digits) + 0.0
    ids = record["id"].to_numpy()
    keep = min(spec.k, len(ids))
    limits = np.partition(effective, keep - 1, axis=1)[:, keep - 1]
    rows, cols = np.nonzero(effective <= limits[:, None])
    out = pd.DataFrame({
        "query_id": query["id"].to_numpy()[rows], "record_id": ids[cols],
        "distance": np.round(distance[rows, cols], spec.digits) + 0.0, "effective_distance": effective[rows, cols]})
    return _cut(out, spec.k)


def _cut(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["query_id", "effective_distance", "record_id"], kind="stable")
    return ordered[ordered.groupby("query_id").cumcount() < k]


def cosine_topk(queries: DataFrame, corpus: DataFrame, spec: TopK) -> DataFrame:
    """The k nearest records of every query: query_id, record_id, distance, effective_distance, rank.

    The corpus stays where it is. Queries are dealt into passes of bounded rows and bytes; those of a pass are sent to every
    task, which works through its records in tiles and keeps only the best k per query, so that k rows per query and task
    are shuffled. Vectors without a direction (see ``usable``) take no part, nor do pairs of different lengths.
    """
    q = queries.select(
        F.col(spec.query_id).alias("id"), F.col(spec.query_vec).alias("vec"),
        (F.lower(spec.phrase) if spec.phrase else F.lit(None).cast("string")).alias("phrase")).where(usable(F.col("vec")))
    c = corpus.select(
        F.col(spec.record_id).alias("id"), F.col(spec.record_vec).alias("vec"),
        (F.col(spec.title) if spec.title else F.lit(None).cast("string")).alias("title")).where(usable(F.col("vec")))
    schema = (
        f"query_id {q.schema['id'].dataType.simpleString()}, record_id {c.schema['id'].dataType.simpleString()}, "
        "distance double, effective_distance double")
    rows, size = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("vec") + F.coalesce(F.octet_length("phrase"), F.lit(0))), F.lit(0))).first()
    passes = max(1, -(-rows // spec.pass_rows), -(-size // spec.pass_bytes))
    found = None
    for i in range(passes):
        block = q.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).toPandas()  # about pass_rows and pass_bytes
        part = c.mapInPandas(_search(q.sparkSession.sparkContext.broadcast(block), spec), schema)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("effective_distance", "record_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.k).withColumn(
        "rank", F.col("rank").cast("bigint"))


def _search(sent, spec: TopK):
    def run(batches):
        asked = sent.value
        blocks = []  # (length, queries, unit vectors)
        for length, same in asked.groupby(asked["vec"].map(len)):
            for i in range(0, len(same), spec.block_rows):
                some = same[i:i + spec.block_rows]
                blocks.append((length, some, _unit(some["vec"])))
        best = None
        for batch in batches:
            for length, same in batch.groupby(batch["vec"].map(len)):
                for i in range(0, len(same), spec.tile_rows):
                    tile = same[i:i + spec.tile_rows]
                    found = [_tile(some, unit, tile, spec) for n, some, unit in blocks if n == length]
                    if found:
                        best = _cut(pd.concat([*([best] if best is not None else []), *found]), spec.k)
        if best is not None:
            yield best

    return run


def gate(hits: DataFrame, requests: DataFrame, records: DataFrame, stored_fields=("email",), refuse: float = REFUSE_DISTANCE) -> DataFrame:
    """Decision per request from its ranked hits.

    ``requests``: query_id, requested_field (NULL if none). ``records``:
    record_id plus the field columns and confidence. A request without hits, or
    whose best effective distance is above the threshold, is refused; so is one
    that asks for a field that is not stored or is blank on the best hit.
    """
    best = hits.where(F.col("rank") == 1).select("query_id", "record_id", F.col("effective_distance").alias("top_distance"))
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    joined = requests.join(best, "query_id", "left").join(sizes, "query_id", "left").join(records, "record_id", "left")
    wanted = F.col("requested_field")
    stored = F.coalesce(*[F.when(wanted == f, text_or_empty(f)) for f in stored_fields], F.lit(""))
    far = F.col("top_distance").isNull() | (F.col("top_distance") > refuse)
    missing = wanted.isNotNull() & (F.trim(stored) == "")
    status = F.when(far, "refuse_no_match").when(missing, "refuse_field_missing").otherwise("ok")
    weak = policy.yes(F.col("confidence") == "low") & (F.coalesce("hits", F.lit(0)) < 2)
    return joined.select(
        "query_id", "requested_field", "top_distance", F.when(~far, F.col("record_id")).alias("record_id"),
        status.alias("status"), ((status == "ok") & ~weak).alias("can_answer"))


def evidence_bindings(hits: DataFrame, records: DataFrame, requests: DataFrame, top: int = 5) -> DataFrame:
    """Up to four claim rows per leading hit: identity, title, email (if asked for), profile.

    ``records``: record_id, person, title, firm, email, linkedin, source_url,
    confidence. ``requests``: query_id, text.
    """
    asked = contains_any(intents.low("text"), ["email", "contact", "reach"])
    rows = hits.where(F.col("rank") <= top).join(records, "record_id").join(requests.select("query_id", "text"), "query_id")

    def claim(field: str, claim_text: Column, value: Column, condition: Column | None = None) -> Column:
        item = F.struct(F.lit(field).alias("field"), claim_text.alias("claim"), value.alias("field_value"))
        return item if condition is None else F.when(condition, item)

    person = F.col("person")
    has = lambda c: text_or_empty(c) != ""
    claims = F.array_compact(F.array(
        claim("identity", F.concat(person, F.lit(" works at "), "firm"),
              F.concat(person, F.lit(" — "), text_or_empty("title"), F.lit(" at "), "firm")),
        claim("title", F.concat(person, F.lit(" holds title: "), "title"), F.col("title"), has("title")),
        claim("email", F.concat(person, F.lit(" email: "), "email"), F.col("email"), has("email") & asked),
        claim("linkedin", F.concat(person, F.lit(" LinkedIn: "), "linkedin"), F.col("linkedin"), has("linkedin"))))
    return rows.select("query_id", "rank", "record_id", "source_url", "confidence", F.inline(claims))


def pack_evidence(hits: DataFrame, records: DataFrame, top: int = 5) -> DataFrame:
    """Leading hits per query as one ordered array; ``top`` bounds its size."""
    rows = hits.where(F.col("rank") <= top).join(records, "record_id")
    names = [c for c in records.columns if c != "record_id"]
    item = F.struct("rank", "record_id", *names, F.round("distance", 3).alias("distance"))
    return rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(item)).alias("evidence"), F.count(F.lit(1)).alias("evidence_count"))
