"""Trust refresh of stored records, and tables stored by key."""

import os

from conftest import evidence, golden, route
from pyspark.sql import functions as F

from evq.plans import refresh
from evq.sources import files

CHECKED = "2024-06-01T00:00:00Z"
SUPPORTS = ["person.name", "route.ownership", "route.value"]


def on(url, person="Jane Smith", last="2024-01-01", state="publish", source="official_firm_site", **changes):
    """A record whose only route rests on ``url``."""
    value = changes.pop("value", f"{person.split()[0].lower()}@example.com")
    own = route(value=value, evidence=evidence(f"{person} {value}", SUPPORTS, url=url, source_class=source), **changes)
    if source == "professional_profile":
        own |= {"type": "linkedin", "value": url.split("?")[0], "current_status": "profile_link_currently_published"}
    record = golden(firm=f"Office {url} {person}", person=person, lifecycle_status=state, contact_routes=[own])
    record["freshness"] |= {"last_evidence_check_at": last, "trust_state": "supported_with_limitations"}
    return record


def tables(spark, pages=(), searches=(), stored=()):
    return (spark.createDataFrame(list(pages), "url string, text string, content_sha256 string, error string"),
            spark.createDataFrame(list(searches), "record_id string, results array<string>, error string"),
            spark.createDataFrame(list(stored), "url string, content_sha256 string, checked_at string, record_id string, present boolean"))


def stored_records(spark, frame, tmp_path, *records, buckets=8):
    path = str(tmp_path / "records")
    files.write_keyed(frame(*records), path, "record_id", buckets)
    return path, files.read_keyed(spark, path)


def test_every_outcome(spark, frame, tmp_path):
    link = "https://www.linkedin.com/in/{}?x=1"
    made = {
        "here": on("https://a.example.com/1"), "moved": on("https://a.example.com/2"), "down": on("https://a.example.com/3"),
        "unseen": on("https://a.example.com/4"), "shared": on("https://a.example.com/5", value="info@example.com"),
        "held": on("https://a.example.com/1", state="quarantine", person="Ann Other"),
        "found": on(link.format("a"), source="professional_profile"), "lost": on(link.format("b"), source="professional_profile"),
        "failed": on(link.format("c"), source="professional_profile"), "unasked": on(link.format("d"), source="professional_profile")}
    ids = {k: r["record_id"] for k, r in made.items()}
    path, records = stored_records(spark, frame, tmp_path, *made.values())
    before = {r["record_id"]: r for r in records.collect()}
    pages, searches, stored = tables(
        spark,
        [("https://a.example.com/1", "JANE SMITH writes from Jane@Example.com", "h1", None), ("https://a.example.com/2", "Jane Smith left", "h2", ""),
         ("https://a.example.com/3", None, None, "x" * 500)],
        [(ids["found"], ["https://www.linkedin.com/in/a?y"], None), (ids["lost"], None, None), (ids["failed"], None, "timeout")],
        [("https://a.example.com/1", "h1", "t", "r", True), ("https://a.example.com/2", "old", "t", "r", True), ("https://z.example.com", "z", "t", "r", True)])
    done = refresh.refresh(path, 8, records, pages, searches, stored, CHECKED)
    outcome = {r["record_id"]: r for r in done.outcome.collect()}
    assert {k: outcome[i]["outcome"] for k, i in ids.items() if i in outcome} == {
        "here": "confirmed", "moved": "quarantined", "down": "quarantined", "unseen": "deferred", "shared": "quarantined",
        "found": "confirmed", "lost": "quarantined", "failed": "deferred", "unasked": "deferred"}
    assert outcome[ids["shared"]]["reason"] == refresh.NO_ROUTE and outcome[ids["moved"]]["reason"] == refresh.MISSING
    assert {k for k, i in ids.items() if i in outcome and outcome[i]["content_changed"]} == {"moved"}
    after = {r["record_id"]: r for r in files.read_keyed(spark, path).collect()}
    assert len(after) == len(made)
    for k in ("unseen", "held", "failed", "unasked"):
        assert after[ids[k]] == before[ids[k]]
    fresh = after[ids["here"]].freshness
    assert (fresh.trust_state, fresh.last_evidence_check_at, after[ids["here"]].lifecycle_status) == ("supported_current", CHECKED, "publish")
    assert fresh.basis_evidence_ids == before[ids["here"]].freshness.basis_evidence_ids
    assert after[ids["down"]].freshness.reason == "required_source_unavailable:" + "x" * 200
    assert after[ids["shared"]].freshness == before[ids["shared"]].freshness and after[ids["shared"]].lifecycle_status == "quarantine"
    seen = {r["url"]: (r["content_sha256"], r["action"], r["present"]) for r in done.observations.collect()}
    assert seen == {
        "https://a.example.com/1": ("h1", "updated", True), "https://a.example.com/2": ("h2", "updated", False), "https://z.example.com": ("z", "kept", True),
        link.format("a"): (refresh.FOUND, "inserted", True), link.format("b"): (refresh.ABSENT, "inserted", False)}
    events = {(r["record_id"], r["event"]) for r in done.events.collect()}
    assert {e for i, e in events if i == ids["moved"]} == {"trust.refresh.started", "trust.source_content_changed", "trust.state_changed"}
    assert {e for i, e in events if i == ids["failed"]} == {"trust.refresh.started", "trust.refresh.deferred"}
    assert ids["shared"] not in {i for i, _ in events}


def test_a_shared_source_changes_once_and_batches_take_the_oldest(spark, frame, tmp_path):
    many = [on("https://hot.example.com/", person=f"Jane {chr(65 + i)}mith", last=f"2024-01-{20 - i:02d}") for i in range(12)]
    path, records = stored_records(spark, frame, tmp_path, *many)
    pages, searches, stored = tables(spark, [("https://hot.example.com/", " ".join(r["person"]["name"] + " jane@example.com" for r in many), "new", None)], (),
                                     [("https://hot.example.com/", "old", "t", "r", True)])
    some = refresh.refresh(path, 8, records, pages, searches, stored, CHECKED, batch_size=5)
    assert {r["record_id"] for r in some.outcome.collect()} == {r["record_id"] for r in many[-5:]}
    changed = [r["record_id"] for r in some.outcome.where("content_changed").collect()]
    assert changed == [many[-1]["record_id"]]
    latest = some.observations.first()
    assert (latest["record_id"], latest["content_sha256"]) == (many[-5]["record_id"], "new")
    rest = refresh.refresh(path, 8, files.read_keyed(spark, path), pages, searches, some.observations, CHECKED)
    assert rest.outcome.count() == 12 and rest.outcome.where("content_changed").count() == 0


def test_updates_rewrite_only_the_folders_of_their_keys(spark, tmp_path):
    path = str(tmp_path / "keyed")
    files.write_keyed(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, "k", 10)
    names = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
    before = names()
    touched = spark.createDataFrame([(3,), (3,), (7,)], "k long")
    hit = files.update_keyed(spark, path, "k", 10, touched, lambda rows: rows.withColumn("v", F.when(F.col("k").isin(3, 7), "new").otherwise(F.col("v"))))
    after = names()
    assert 1 <= len(hit) <= 2
    assert {d for d in before if before[d] != after[d]} == {f"bucket={b}" for b in hit}
    rows = files.read_keyed(spark, path).collect()
    assert len(rows) == 200 and {r["k"] for r in rows if r["v"] == "new"} == {3, 7}
    assert files.update_keyed(spark, path, "k", 10, touched.where("false"), lambda rows: rows) == []


def test_refresh_of_empty_tables(spark, frame, tmp_path):
    path, records = stored_records(spark, frame, tmp_path, on("https://a.example.com/1"))
    empty = refresh.refresh(path, 8, records.where("false"), *tables(spark), CHECKED)
    assert empty.outcome.collect() == [] and empty.observations.collect() == [] and empty.events.collect() == []
    alone = refresh.refresh(path, 8, records, *tables(spark), CHECKED)
    assert [r["outcome"] for r in alone.outcome.collect()] == ["deferred"]
