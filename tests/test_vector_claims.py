import dataclasses

import numpy as np
from pyspark.sql import functions as F

from evq.functions import intents
from evq.operators import claims, relational, vector


def test_search_by_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    q, c = rng.normal(size=(23, 8)), rng.normal(size=(400, 8))
    queries = spark.createDataFrame([(i, v.tolist(), f"p{i % 3}") for i, v in enumerate(q)], "query_id long, query_vec array<double>, phrase string")
    corpus = spark.createDataFrame([(i, v.tolist(), f"x P{i % 5}") for i, v in enumerate(c)], "record_id long, record_vec array<double>, title string")
    spec = vector.TopK(k=4, phrase="phrase", title="title")
    small = vector.cosine_topk(queries, corpus, spec)
    large = vector.cosine_topk(queries, corpus, dataclasses.replace(spec, pass_rows=9, block_rows=5, tile_rows=20))
    assert relational.difference_counts(small, large).first() == (0, 0)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit(q) @ unit(c).T - 0.15 * (np.arange(23)[:, None] % 3 == np.arange(400)[None, :] % 5)
    want = {i: sorted(range(400), key=lambda j: (round(d[i, j], 6), j))[:4] for i in range(23)}
    got = {}
    for r in small.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.record_id)
    assert got == want
    pair = queries.where("query_id = 0").crossJoin(corpus.where("record_id = 1"))
    assert abs(pair.select(vector.cosine_distance(F.col("query_vec"), F.col("record_vec"))).first()[0] - (1 - unit(q)[0] @ unit(c)[1])) < 1e-9


def test_vectors_without_a_direction_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0, 0.0], [1e-200, 0.0], [3.0, 4.0]]
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "record_id long, record_vec array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "query_id long, query_vec array<double>")
    got = {(r.query_id, r.record_id): (r["rank"], r.distance) for r in vector.cosine_topk(queries, corpus, vector.TopK(k=3)).collect()}
    assert got == {(6, 6): (1, 0.0), (7, 7): (1, 0.0), (7, 8): (2, 0.4), (8, 8): (1, 0.0), (8, 7): (2, 0.4)}
    for q, c in ((queries.limit(3), corpus), (queries, corpus.limit(3)), (queries.limit(0), corpus.limit(0))):
        assert vector.cosine_topk(q, c, vector.TopK(k=3)).collect() == []


def test_gates(spark):
    hits = spark.createDataFrame([(1, 10, 0.2, 0.2, 1), (2, 10, 0.9, 0.9, 1), (3, 11, 0.1, 0.1, 1), (4, 10, 0.1, 0.1, 1), (5, 11, .1, .1, 1)],
                                 "query_id long, record_id long, distance double, effective_distance double, rank long")
    requests = spark.createDataFrame([(1, "email"), (2, None), (3, "email"), (4, "phone"), (5, None), (6, None)], "query_id long, requested_field string")
    records = spark.createDataFrame([(10, "a@b.co", "high"), (11, " ", "low")], "record_id long, email string, confidence string")
    got = {r.query_id: (r.status, r.can_answer) for r in vector.gate(hits, requests, records).collect()}
    assert got == {1: ("ok", True), 2: ("refuse_no_match", False), 3: ("refuse_field_missing", False), 4: ("refuse_field_missing", False),
                   5: ("ok", False), 6: ("refuse_no_match", False)}


def test_answers_are_checked_against_their_evidence(spark):
    evidence = spark.createDataFrame([("r", "FOC_001", "John A Doe", "Partner", "Test Office", "john@test.com", "")],
                                     "request_id string, record_id string, person string, title string, firm string, email string, linkedin string")
    answers = spark.createDataFrame([
        ("r", 1, "John Doe is at Test Office, john@test.com [FOC_001]"), ("r", 2, "mail fake@x.com [FOC_001]"), ("r", 3, "see [FOC_999]"),
        ("r", 4, "Mary Jones works there"), ("r", 5, None)], "request_id string, n int, answer string")
    got = {r.n: r.violation for r in claims.post_check(answers, claims.evidence_values(evidence), ["request_id", "n"], ["request_id"]).collect()}
    assert got == {1: None, 2: "email:fake@x.com", 3: "record_id:FOC_999", 4: "name:Mary Jones", 5: None}
    requests = spark.createDataFrame([("r", "John's email?"), ("s", "email of Jo"), ("r2", "who is the partner")], "request_id string, text string")
    pre = {r.request_id: r.missing_field for r in claims.pre_check(requests, evidence).collect()}
    assert pre == {"r": None, "s": "email", "r2": "title"}


def test_claims_and_decisions(spark):
    records = spark.createDataFrame([("A", "a@b.co", "Managing Partner", "Acme")], "record_id string, email string, job_title string, firm_name string")
    made = spark.createDataFrame([("A", "email a@b.co"), ("A", "email x@b.co"), ("A", "hello"), ("B", "email a@b.co"), ("A", "role partner at firm Acme")],
                                 "record_id string, claim string")
    got = [r.verdict for r in claims.verify_claims(made, records).orderBy("record_id", "claim").collect()]
    assert sorted(got) == sorted(["verified", "rejected", "unchecked", "record_missing", "verified"])
    flags = spark.createDataFrame([(True, False, True, True), (False, True, True, True), (False, False, True, False), (False, False, False, False)],
                                  "d boolean, u boolean, c boolean, a boolean")
    decision = claims.render_decision(F.col("d"), F.col("u"), F.col("c"), F.col("a"))["decision"]
    assert [r[0] for r in flags.select(decision).collect()] == ["refuse", "refuse", "render", "abstain"]


def test_requests(spark):
    text = "Find United States lower-middle-market healthcare contacts with email and show source mix"
    row = spark.createDataFrame([(text,)], "t string").select(
        intents.request_filters("t").alias("f"), intents.request_terms("t").alias("w"), intents.request_aggregates("t").alias("a"),
        intents.requested_field("t").alias("r")).first()
    assert row.f == {"has_email": "true", "country": "united states"}
    assert set(row.w) == {"healthcare", "lower-middle-market", "lower middle market"} and row.a == ["records", "source_mix"] and row.r == "email"
    cases = {"How many people have email": "count_people:has_email", "bonus plan": "search_people", "count firms": "count_firms",
             "in the US": "count_firms:United States", "the CIO": "search_people:chief investment officer"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", intents.structured_route("t").alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases
    splits = {"Acme vs Beta and Co": ["acme", "beta co"], "list firms and count people": ["list firms", "count people"],
              "show emails for Acme": ["show emails", "for acme"], "Who is Jane": ["Who is Jane"]}
    rows = spark.createDataFrame([(k,) for k in splits], "t string").select("t", intents.split_request("t").alias("s")).collect()
    assert {r.t: r.s for r in rows} == splits
