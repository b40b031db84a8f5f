import glob
import json
import os

import pandas as pd
import pytest
from __spark_entry__ import queries
from conftest import OBSERVED, enrichment, golden, route
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evq.operators import state
from evq.plans import cycles, migration, release
from evq.sources import files
from evq.streaming import jobs, keyed

NOW = "2024-05-02T00:00:00Z"


def test_strict_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType())])
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n\n{"b": "é\\n"}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(good), schema)
    assert sorted((r.a, r.b) for r in rows.fillna(0).collect()) == [(0, "é\n"), (1, "x")]
    assert files.read_jsonl(spark, str(tmp_path / "absent"), schema).count() == 0
    for bad in ('{"a": 1', "[1]", "3"):
        (tmp_path / "bad.jsonl").write_text('{"a": 1}\n' + bad + "\n")
        with pytest.raises(Exception, match="bad.jsonl: expected a JSON object"):
            files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    files.write_jsonl(rows, str(tmp_path / "out"), "b")
    lines = [line for f in sorted((tmp_path / "out").glob("part*")) for line in f.read_text(encoding="utf-8").splitlines()]
    assert lines == ['{"a":1,"b":"x"}', '{"a":null,"b":"é\\n"}']


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'say "hi",\nbye', ""), ("2", " x ", None)], "id string, note string, e string")
    files.write_csv(rows, str(tmp_path / "c"), ["id", "note", "e"], ["id"])
    got = files.read_csv(spark, str(tmp_path / "c"), ["id", "note", "e"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", 'say "hi",\nbye', ""), ("2", " x ", "")]


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    """Splits fall into headers, quotes and quoted line breaks."""
    notes = ['say "hi",\nbye', "", " x ", 'a\n\n\n"b"\r\n', "é,;\"", "plain", '"', "\n", '""']
    rows = spark.createDataFrame([(f"{i:04d}", notes[i % len(notes)], None if i % 3 else "z") for i in range(700)], "id string, note string, e string")
    files.write_csv(rows.coalesce(1), str(tmp_path / "c"), ["id", "note", "e"], ["id"])
    session = spark.newSession()
    for name, value in (("maxPartitionBytes", "150"), ("openCostInBytes", "0")):
        session.conf.set(f"spark.sql.files.{name}", value)
    lines = files.placed_lines(session, str(tmp_path / "c"))
    assert lines.select("block").distinct().count() > 40
    got = files.read_csv(session, str(tmp_path / "c"), ["id", "note", "e"]).collect()
    assert sorted(map(tuple, got)) == sorted((r.id, r.note, r.e or "") for r in rows.collect())
    numbers = files.numbered(lines).select("n").orderBy("n").collect()
    assert [r.n for r in numbers] == list(range(len(numbers)))
    split = files.tree_digests(files.numbered(lines).withColumn("digest", F.sha2("value", 256))).collect()
    whole = files.tree_digests(files.numbered(files.placed_lines(spark, str(tmp_path / "c"))).withColumn("digest", F.sha2("value", 256))).collect()
    assert split == whole and len(split) == 1, "the digest does not depend on the splits"
    with pytest.raises(Exception, match="header differs"):
        files.read_csv(spark, str(tmp_path / "c"), ["id", "other", "e"]).collect()


def test_snapshots_and_logs(spark, tmp_path):
    base = str(tmp_path / "s")
    assert files.read_snapshot(spark, base) is None
    assert [files.write_snapshot(spark.range(n), base) for n in (3, 5)] == [1, 2]
    spark.range(9).write.parquet(f"{base}/version=3")  # never published
    assert files.read_snapshot(spark, base).count() == 5
    events = spark.createDataFrame([("c", 2, "k2"), ("c", 1, "k1"), ("d", 1, "k3")], "cycle_id string, at int, event_key string")
    files.append_events(events, str(tmp_path / "log"))
    got = {(r.cycle_id, r.event_key): r.sequence for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {("c", "k1"): 1, ("c", "k2"): 2, ("d", "k3"): 1}
    with pytest.raises(ValueError, match="missing"):
        files.append_run(spark.range(1), str(tmp_path / "runs"), ["id", "status"])


def test_release_round_trip_and_drift(spark, frame, tmp_path):
    built = release.export_release(frame(golden(), golden(person="Mary Jones")), str(tmp_path / "r"), NOW)
    manifest = built.manifest.first()
    assert (manifest.record_count, manifest.firm_count, manifest.qualifying_email_count, manifest.release_ready) == (2, 1, 2, False)
    assert manifest.readiness_failures == ["record_count 2 < 500", "qualifying_email_count 2 < 200"]
    rows = files.read_csv(spark, f"{built.path}/csv", release.schemas.RELEASE_COLUMNS).collect()
    assert {r["Primary Route Value"] for r in rows} == {"jane.smith@example.com"}
    again = release.export_release(frame(golden(person="Mary Jones"), golden()), str(tmp_path / "r2"), "2025-01-01T00:00:00Z")
    assert again.release_id == built.release_id  # content alone
    with open(f"{built.path}/jsonl/part-extra.txt", "w") as handle:
        handle.write(json.dumps({"record_id": "INJECTED"}) + "\n")
    with pytest.raises(ValueError, match="jsonl checksum.*row counts.*record IDs.*release IDs"):
        release.check_release(spark, built)


def part_with_rows(folder):
    """Path and lines of the part file that holds the most lines; its checksum file goes."""
    path = max(glob.glob(f"{folder}/part-*"), key=os.path.getsize)
    for crc in glob.glob(f"{folder}/.*.crc"):
        os.remove(crc)
    with open(path) as handle:
        return path, handle.read().splitlines(keepends=True)


@pytest.mark.parametrize(("kind", "edit", "problem"), [
    ("jsonl", lambda lines: lines[::-1], "jsonl checksum differs from manifest; record IDs or ordering disagree"),
    ("csv", lambda lines: [lines[0], lines[2], lines[1]], "csv checksum differs from manifest; record IDs or ordering disagree"),
    ("csv", lambda lines: [x.replace("Jane", '"Jane"', 1) if "Jane Smith" in x and '"Jane' not in x else x + "\n" for x in lines],
     "csv checksum differs from manifest"),
])
def test_edited_files_do_not_reconcile(spark, frame, tmp_path, kind, edit, problem):
    rows = frame(golden(), golden(person="Mary Jones")).coalesce(1)
    built = release.export_release(rows, str(tmp_path / "r"), NOW)
    path, lines = part_with_rows(f"{built.path}/{kind}")
    if len(lines) < 2 + (kind == "csv"):  # one row per part file: swap the files instead
        other = min(set(glob.glob(f"{built.path}/{kind}/part-*")) - {path}, key=lambda f: -os.path.getsize(f))
        a, b = open(path).read(), open(other).read()
        open(path, "w").write(b if problem.endswith("disagree") else a + "\n")
        open(other, "w").write(a if problem.endswith("disagree") else b)
    else:
        with open(path, "w") as handle:
            handle.write("".join(edit(lines)))
    with pytest.raises(ValueError, match=problem):
        release.check_release(spark, built)


def test_blocked_releases(frame, tmp_path):
    with pytest.raises(ValueError, match="requested publication but failed policy"):
        release.export_release(frame(golden(contact_routes=[route(inferred=True)])), str(tmp_path / "a"), NOW)
    with pytest.raises(ValueError, match="record.duplicate_id,record.duplicate_identity"):
        release.export_release(frame(golden(), golden()), str(tmp_path / "b"), NOW)
    with pytest.raises(ValueError, match="record_count 1 < 500"):
        release.export_release(frame(golden()), str(tmp_path / "c"), NOW, final_gate=True)


def test_gate_outcome_depends_on_the_minimums_alone(spark):
    rows = spark.createDataFrame([(3822, 2222)], "record_count long, qualifying_email_count long")
    asked = [{"record_count": 500, "qualifying_email_count": 200}, {"record_count": F.col("record_count") + 1}, {}]
    assert list(rows.select(*[release.gate_outcome(m).alias(str(i)) for i, m in enumerate(asked)]).first()) == ["", "final release gate failed", ""]


def test_merge_keeps_newer_base_and_adds_what_it_lacks(frame):
    old = golden(contact_routes=[route(), route(value="j@example.com"), route(value="info@example.com")],
                 enrichments=[enrichment("sector", "Energy")])
    old["freshness"] |= {"last_evidence_check_at": "2024-01-01T00:00:00Z", "basis_evidence_ids": ["EV_0"]}
    merged = state.merge_records(frame(old).drop("seq"), frame(golden()).drop("seq"))
    row = merged.first()
    assert [r.value for r in row.contact_routes] == ["jane.smith@example.com", "j@example.com"]
    assert [e.value for e in row.enrichments] == ["Healthcare services", "Energy"]
    assert row.freshness.basis_evidence_ids == ["EV_0", "EV_1"] and row.freshness.last_evidence_check_at == OBSERVED
    assert row.lifecycle_status == "publish"
    columns = frame(golden()).drop("seq").columns
    again = state.merge_records(merged.select(columns), frame(golden()).drop("seq")).first()
    assert again.contact_routes == row.contact_routes and again.enrichments == row.enrichments


def test_batch_cycle(spark, frame, tmp_path):
    base = str(tmp_path / "state")
    cycles.run_batch(base, frame(golden(), golden(person="Mary Jones", enrichments=[])).drop("seq"))
    published, quarantined = cycles.run_batch(base, frame(golden(person="Mary Jones")).drop("seq"))
    assert (published.count(), quarantined.count()) == (2, 0)
    assert files.current_version(spark, base + "/records") == 2


def test_trust_and_health(spark):
    rows = spark.createDataFrame([(True, None), (False, None), (False, "timeout"), (None, None)], "present boolean, failure string").withColumns({
        "trust_state": F.lit("old"), "lifecycle_status": F.lit("publish"), "last_evidence_check_at": F.lit("t0")})
    got = state.refresh_trust(rows, F.col("present"), F.lit("t1"), F.col("failure")).collect()
    assert [(r.trust_state, r.lifecycle_status, r.last_evidence_check_at) for r in got] == [
        ("supported_current", "publish", "t1"), ("stale_evidence_missing", "quarantine", "t0"),
        ("stale_evidence_missing", "quarantine", "t0"), ("old", "publish", "t0")]
    assert got[2].reason == "timeout" and got[3].reason is None
    health = spark.createDataFrame([(200, "", True), (200, "", None), (404, "", True), (None, "", True), (200, "x", True)], "s int, e string, d boolean")
    assert [r[0] for r in health.select(state.page_health(F.col("s"), F.col("e"), F.col("d"))).collect()] == [
        "ok", "content_changed", "source_gone", "source_gone", "fetch_error"]


def test_migration_quarantines(spark):
    rows = spark.createDataFrame([("F1", "Acme", "Jane Smith", None)], "id string, firm string, person string, none string")
    names = {k: "none" for k in ("title", "country", "firm_url", "person_url", "notes", "verified_on")}
    moved = migration.migrate(rows, {"legacy_id": "id", "firm_name": "firm", "person_name": "person", **names}).first()
    assert moved.lifecycle_status == "quarantine" and "route.missing" in moved.reasons and "freshness.never_checked" in moved.reasons
    assert moved.person.role_evidence.support == "unresolved"


def test_event_streams_do_not_depend_on_the_files_of_the_events(spark, tmp_path):
    events = spark.range(3000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 14 as int), 0)").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.when(F.hash("id") % 3 == 0, "view").otherwise("click").alias("event_type"), F.lit(1.5).alias("value"))
    for day, parts in ((11, 9), (32, 2)):  # the first arrival has many files, the others few
        rows = events.where(F.dayofmonth("ts").between(0 if day == 11 else 11, day - 1))
        for part in range(parts):
            rows.where(F.pmod(F.hash("event_id"), F.lit(parts)) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a task for each file
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    try:
        got = {name: sorted(tuple(r) for r in queries()[name](spark, str(tmp_path)).collect()) for name in ("stream_change_state", "stream_dedup")}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    changed, kept, before, last = [], [], {}, {}
    for r in events.orderBy("event_id").collect():
        if before.get(r.user_id, r.event_type) != r.event_type:
            changed.append((r.user_id, r.event_id, before[r.user_id], r.event_type))
        before[r.user_id] = r.event_type
        key = (r.user_id, r.event_type)
        if key not in last or (r.ts - last[key]).total_seconds() >= 5 * 86400:
            kept.append((*key, r.event_id, r.value))
            last[key] = r.ts
    assert got == {"stream_change_state": sorted(changed), "stream_dedup": sorted(kept)}


def test_keyed_functions_follow_every_key_of_a_bucket_on_its_own():
    class State:
        exists = hasTimedOut = False
        getCurrentWatermarkMs = lambda self: self.mark
        getCurrentProcessingTimeMs = lambda self: self.mark

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, at):  # noqa: N802
            self.alarm = at

        setTimeoutDuration = setTimeoutTimestamp  # noqa: N815

    state, first = State(), keyed.FirstWithin(10_000, ["n"])
    rows = pd.DataFrame([("a", 9_000, 1, "a9"), ("b", 3_000, 2, "b3"), ("a", 2_000, 3, "a2"), ("a", 12_000, 4, "a12")], columns=["key", "at_us", "n", "whole"])
    state.mark = 0
    assert list(first((0,), iter([rows]), state)) == [] and state.alarm == 3
    state.mark, state.hasTimedOut = 4, True
    assert sorted(pd.concat(first((0,), iter([]), state)).whole) == ["a2", "b3"] and state.alarm == 10
    state.mark = 20
    assert list(pd.concat(first((0,), iter([]), state)).whole) == ["a12"] and state.exists and state.alarm == 23
    state.mark = 30
    assert list(first((0,), iter([]), state)) == [] and not state.exists
    state, follow = State(), keyed.LastValue(100)
    state.mark = 1_000
    batch = pd.DataFrame([("a", 2, "y"), ("b", 1, "x"), ("a", 1, "x")], columns=["key", "at", "value"])
    assert pd.concat(follow((0,), iter([batch]), state)).values.tolist() == [["a", 2, "x", "y"]] and state.alarm == 100
    state.mark, late = 1_200, pd.DataFrame([("b", 5, "z")], columns=["key", "at", "value"])
    assert list(follow((0,), iter([late]), state)) == [], "a key is forgotten after its time"


def test_streams_over_many_batches_equal_the_batch_answer(spark, tmp_path):
    events = spark.range(600).select(
        (F.col("id") % 7).alias("url"), F.col("id").alias("seq"), (F.floor(F.col("id") / 50) % 3).cast("string").alias("hash"),
        F.timestamp_seconds(F.col("id") * 60 + 1_000_000_000).alias("at"))
    folder = str(tmp_path / "in")
    for part in range(4):
        events.where(F.floor(F.col("seq") / 150) == part).coalesce(1).write.mode("append").parquet(folder)
    read = lambda settings=None: jobs.read_stream(spark, folder, events.schema, "*.parquet", 2, settings)
    windows = jobs.Job(str(tmp_path / "windows"), {"availableNow": True})
    count = [F.count("*").alias("n")]
    jobs.run_to_end(lambda: jobs.event_windows(jobs.with_end_mark(read(), windows), "at", ["url"], "1 hour", "1 day", count, windows),
                    events.schema, "at", windows)
    assert spark.read.parquet(windows.table).agg(F.sum("n")).first()[0] == 600
    active = jobs.Job(str(tmp_path / "sessions"), {"availableNow": True})
    jobs.run_to_end(lambda: jobs.sessions(jobs.with_end_mark(read(jobs.LOCAL_SESSIONS), active), "at", ["url"], "8 minutes", "1 day", count, active),
                    events.schema, "at", active)
    assert sorted((r.url, r.n) for r in spark.read.parquet(active.table).collect()) == sorted(
        (u, n) for u, n in events.groupBy("url").count().collect())

    job = jobs.Job(str(tmp_path / "changes"), {"availableNow": True})
    follow = lambda: jobs.changes(read(jobs.KEYED_STATE).select("url", "seq", "hash"), "url", "seq", "hash", job)
    first = follow()
    first.awaitTermination()
    more = spark.createDataFrame([(3, 900, "new"), (3, 901, None), (3, 902, "new"), (77, 903, "x"), (3, 5, "late")], "url long, seq long, hash string")
    all_events = events.unionByName(more, allowMissingColumns=True)
    more.withColumn("at", F.lit("2024-03-01").cast("timestamp")).select(*events.columns).coalesce(1).write.mode("append").parquet(folder)
    again = follow()  # from the checkpoint: only what is new
    again.awaitTermination()
    assert sum(p["numInputRows"] for p in again.recentProgress) == 5
    assert sum(o["numRowsUpdated"] for p in again.recentProgress for o in p["stateOperators"]) == 2, "a batch writes the state of its own keys"
    got = spark.read.parquet(job.table)
    assert got.columns == ["url", "seq", "previous", "current"]
    want = state.content_changes(all_events.where("hash is null or hash <> 'late'"), "url", [F.col("seq")], "hash").where("changed")
    assert {tuple(r) for r in got.collect()} == {(r.url, r.seq, r.previous, r.hash) for r in want.collect()}
    followed = spark.read.parquet(folder).orderBy("at", "seq").collect()

    dedup = jobs.Job(str(tmp_path / "dedup"), {"availableNow": True})
    jobs.run_to_end(lambda: jobs.dedup(
        jobs.with_end_mark(read(jobs.KEYED_STATE), dedup), ["url"], "at", "7 minutes", ["seq"], "100 days", dedup), events.schema, "at", dedup)
    kept, last = [], {}
    for r in followed:
        if r.url not in last or (r["at"] - last[r.url]).total_seconds() >= 420:
            kept.append(tuple(r))
            last[r.url] = r["at"]
    assert sorted(map(tuple, spark.read.schema(events.schema).parquet(dedup.table).collect()), key=str) == sorted(kept, key=str)

    base = str(tmp_path / "totals")
    for number, n in ((0, 5), (1, 9), (1, 9)):
        files.write_snapshot(spark.range(n), base, number + 1)
    assert files.current_version(spark, base) == 2
    assert files.read_snapshot(spark, base).count() == 9


def test_scratch_tables_can_be_removed(spark):
    from evq import session

    kept = session.materialize(spark.range(5), "numbers")
    assert kept.count() == 5
    session.remove_scratch(spark)
    assert not files.exists(spark, session.scratch_dir(spark))
