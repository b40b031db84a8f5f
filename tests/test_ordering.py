import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from evq.operators import ordering, relational

LAWS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROWS = st.lists(st.tuples(st.sampled_from(["hot", "hot", "a", None]), st.integers(0, 9)), min_size=1, max_size=40)


@pytest.fixture
def skewed(spark):
    """9000 rows of which two thirds carry one key."""
    key = F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id") % 50)).otherwise("hot")
    return spark.range(9000).select(key.alias("k"), (F.col("id") * 7919 % 9001).alias("o"), F.col("id"))


def test_split_row_number_equals_the_plain_window(skewed):
    order = [F.col("o"), F.col("id")]
    split = ordering.split_row_number(skewed, ["k"], order, "n")
    plain = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    assert relational.difference_counts(split.select("k", "id", "n"), plain.select("k", "id", "n")).first() == (0, 0)
    whole = ordering.split_row_number(skewed, [], order, "n")
    assert whole.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (1, 9000, 9000)


def test_split_lag_equals_the_plain_window(skewed):
    order = [F.col("o"), F.col("id")]
    split = ordering.split_lag(skewed, ["k"], order, F.col("id"), "p")
    plain = skewed.withColumn("p", F.lag("id").over(Window.partitionBy("k").orderBy(*order)))
    assert relational.difference_counts(split.select("k", "id", "p"), plain.select("k", "id", "p")).first() == (0, 0)


def test_round_robin_is_fair_and_complete(skewed):
    fair = ordering.round_robin(skewed, "k", [F.col("id")])
    turn = skewed.withColumn("turn", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    plain = turn.withColumn("position", F.row_number().over(Window.orderBy("turn", "k")).cast("bigint"))
    assert relational.difference_counts(fair.select("id", "position"), plain.select("id", "position")).first() == (0, 0)
    head = [r.k for r in fair.orderBy("position").limit(18).collect()]
    assert len(set(head[:17])) == 17 and head[:17] == sorted(head[:17])


def test_sequential_ids(skewed):
    ids = ordering.sequential_ids(skewed, [F.col("o"), F.col("id")])
    assert [r.record_id for r in ids.orderBy("o").limit(2).collect()] == ["FOC_001", "FOC_002"]
    assert ids.agg(F.max(F.length("record_id"))).first()[0] == len("FOC_9000")


@LAWS
@given(rows=ROWS)
def test_dedupe_laws(spark, rows):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "seq long, k string, v long")
    once = ordering.keep_first(df, ["k"], [F.col("seq")])
    first = {}
    for i, (k, v) in enumerate(rows):
        first.setdefault(k, (i, v))
    assert {(r.k, r.seq, r.v) for r in once.collect()} == {(k, i, v) for k, (i, v) in first.items()}
    assert ordering.keep_first(once, ["k"], [F.col("seq")]).count() == once.count()
    flags = ordering.flag_first(df, ["k"], "seq").where("is_first").count()
    assert flags == len(first)
    last = {r.k: r.seq for r in ordering.keep_last(df, ["k"], "seq").collect()}
    assert last == {k: max(i for i, (kk, _) in enumerate(rows) if kk == k) for k in last}


@LAWS
@given(rows=ROWS)
def test_equal_frames_have_no_difference_and_an_edit_shows(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long")
    assert relational.difference_counts(df, df.orderBy("v")).first() == (0, 0)
    edited = spark.createDataFrame([(rows[0][0], rows[0][1] + 100), *rows[1:]], "k string, v long")
    assert relational.difference_counts(df, edited).first() == (1, 1)


def test_priority_and_ties(spark):
    df = spark.createDataFrame([(1, "a", "low"), (2, "a", "high"), (3, "a", "high"), (4, "b", None)], "seq long, k string, c string")
    kept = ordering.keep_by_priority(df, ["k"], "c", {"high": 5, "low": 1}, ["seq"]).collect()
    assert {r.k: r.seq for r in kept} == {"a": 2, "b": 4}


def test_page_bounds(spark):
    df = spark.range(10)
    assert [r.id for r in ordering.page(df, [F.desc("id")], 3, 2).collect()] == [7, 6, 5]
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            ordering.page(df, [F.col("id")], limit, offset)


def test_ranges_grow_with_the_rows_and_cut_hot_groups(spark, skewed):
    settings_ = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k",
                 "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k, None) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        small, large = (ordering._ranged(skewed.where(f"id < {n}"), ["k"], [F.col("id")]) for n in (500, 9000))
        few, many = (x.select("_range").distinct().count() for x in (small, large))
        assert many > 2 * few
        assert large.where("k = 'hot'").select("_range").distinct().count() > 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_keys_with_several_entries_do_not_multiply_rows(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    listed = spark.createDataFrame([("a", "first", 1), ("a", "again", 2)], "k string, reason string, seq long")
    got = relational.allow_or_reject(rows, rows.limit(0), "k", listed, seq="seq").orderBy("k").collect()
    assert [(r.k, r.reason) for r in got] == [("a", "again"), ("b", relational.DEFAULT_REJECTION)]
    aliases = spark.createDataFrame([("a", "A", 2), ("a", "B", 1)], "raw string, name string, seq long")
    assert [r.canonical_name for r in relational.canonical_names(rows, aliases, "k", "raw", "name", "seq").orderBy("k").collect()] == ["A", None]


def test_curation_joins(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    allowed = spark.createDataFrame([("a",), ("a",)], "k string")
    listed = spark.createDataFrame([("b", "closed")], "k string, reason string")
    got = {r.k: (r.decision, r.reason) for r in relational.allow_or_reject(rows, allowed, "k", listed).collect()}
    assert got == {"a": ("kept", None), "b": ("rejected", "closed"), "c": ("rejected", "Not in curated allowlist for final build.")}
    blocked = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r.k for r in relational.blocklist(rows, blocked, "k", exempt=F.col("k") == "b").orderBy("k").collect()] == ["b", "c"]
    old = spark.createDataFrame([("a", 3)], "k string, n int")
    assert {r.k: r.n for r in relational.carry_over(rows, old, "k", {"n": 0}).collect()} == {"a": 3, "b": 0, "c": 0}


def test_pages_seek_in_an_ordered_table(spark, tmp_path):
    from evq.operators import paging

    rows = spark.range(5_000).select((F.col("id") % 37).alias("g"), F.col("id"), F.when(F.col("id") % 11 > 0, F.col("id") % 5).alias("v"))
    path = str(tmp_path / "ordered")
    paging.write_ordered(rows, path, {"k1": F.col("v"), "k2": F.col("id")}, stretch=400)
    want = sorted(((r.v is not None, r.v or 0, r.id) for r in rows.collect()))
    got = paging.read_ordered(spark, path).orderBy("position").collect()
    assert [(r.v is not None, r.v or 0, r.id) for r in got] == want and [r.position for r in got] == list(range(1, 5_001))
    for offset in (0, 399, 1_234, 4_990, 9_000):
        page = paging.page_at(spark, path, offset, 50, stretch=400)
        assert [r.id for r in page.collect()] == [w[2] for w in want[offset:offset + 50]]
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(stretch" in plan, "a page reads only its folders"
    for key in ((0, 10), (0, -1), (3, 10**9), (2, 7), (9, 9), (None, -5)):
        place = sum(w <= (key[0] is not None, key[0] or 0, key[1]) for w in want)
        assert [r.id for r in paging.page_after(spark, path, key, 30, stretch=400).collect()] == [w[2] for w in want[place:place + 30]]
