"""Language model, quality rules, near duplicates, top-k: against brute force and SQL."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_DIR
from oracle import compare, duck
from pyspark.sql import functions as F

from evq.llm import minhash, ngram_lm, pivots, quality
from evq.llm import queries as llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, source string, key long, kept string, n int, node string, bands int"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 7, "x", 1, "y", 2) for i, t, s in rows], COLUMNS)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_query_matches_its_oracle(spark, name):
    ok, note = compare(spark, name, SF_DIR, duck(SF_DIR))
    assert ok, note
    assert "EMPTY" not in note


# --- language model ---------------------------------------------------------

def kneser_ney(train, order):
    """A plain dictionary model; returns p(word, context)."""
    texts = [["<s>"] * (order - 1) + words(t) + ["</s>"] for t in train]
    raw = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        for i in range(order - 1, len(t)):
            for k in raw:
                raw[k][tuple(t[i - k + 1:i + 1])] += 1
    count = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in raw[k + 1])
    steps = {k: ngram_lm.discounts(*(sum(c == i for c in count[k].values()) for i in range(1, 5))) for k in count}
    followers = {k: defaultdict(list) for k in count}
    for k in count:
        for g, c in count[k].items():
            followers[k][g[:-1]].append(c)
    size = len(raw[1])

    def p(k, gram):
        lower = 1 / (size + 1) if k == 1 else p(k - 1, gram[1:])
        own = followers[k].get(gram[:-1])
        if not own:
            return 1.0 if k == 1 and not size else lower
        c, total = count[k].get(gram, 0), sum(own)
        less = [0.0, *steps[k]]
        left = sum(less[min(x, 3)] for x in own)
        return max(c - less[min(c, 3)], 0) / total + left / total * lower

    return lambda context, word: p(order, (*context, word)), raw[1]


@pytest.mark.parametrize("order", [2, 3])
def test_model_equals_a_plain_one(spark, order):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdeFGH"), rng.integers(0, 30))) for _ in range(60)] + ["a b a b", None, "", "é x\ty " * 50]
    train = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] * 2)
    model = ngram_lm.fit(train, order=order, shard_bytes=200)
    assert model.shards > 3
    assert ngram_lm.load(model.folder) == model
    p, unigrams = kneser_ney(texts * 2, order)
    assert (model.tokens, model.vocabulary) == (sum(unigrams.values()), len(unigrams))
    asked = [*texts[:10], "new a new", None, "", "c " * 300]
    got = {r["doc_id"]: r for r in ngram_lm.score(frame(spark, [(i, t, "s") for i, t in enumerate(asked)]), model, keep=("kept",)).collect()}
    for i, text in enumerate(asked):
        tokens = [*words(text), "</s>"]
        padded = ["<s>"] * (order - 1) + tokens
        want = sum(math.log10(p(tuple(padded[k:k + order - 1]), t)) for k, t in enumerate(tokens))
        base = sum(math.log10((unigrams.get((t,), 0) + 1) / (model.tokens + model.vocabulary + 1)) for t in tokens)
        assert got[i]["score"] == pytest.approx(want, rel=1e-9)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert got[i]["n_tokens"] == len(tokens)
        assert got[i]["n_known"] == sum((t,) in unigrams for t in tokens)
        assert got[i]["kept"] == "x"
    every = [t for (t,) in unigrams] + ["unknown"]
    for context in (("a",) * (order - 1), ("<s>",) * (order - 1)):
        assert sum(p(context, t) for t in every) == pytest.approx(1)


def test_empty_training_table(spark):
    model = ngram_lm.fit(frame(spark, []))
    got = ngram_lm.score(frame(spark, [(1, "a b", "s")]), model).first()
    assert (model.tokens, got["n_tokens"], got["n_known"]) == (0, 3, 0)
    assert got["base_score"] == pytest.approx(0)
    assert ngram_lm.score(frame(spark, []), model).count() == 0


def test_held_out_texts_are_likelier_under_the_model(spark):
    rows = llm_queries.QUERIES["op1_lm_scoring"](spark, SF_DIR).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert rows[2] > 10
    assert rows[0] > rows[1]


# --- quality rules ----------------------------------------------------------

def test_quality_edges_and_hosts(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good, "good") for i in range(30)] + [(100 + i, "too short", "bad") for i in range(30)]
    rows += [(200, good, "bad"), (201, None, "good"), (202, "", None), (203, good, None), (204, "a b c d e f g h i j " * 5000, "good"),
             (205, " ".join(f"w{i} ###" for i in range(40)), "good"), (None, good, "good"), (0, good, "good")]
    judged = quality.judge(frame(spark, rows))
    assert not re.search("Python|Pandas|Arrow", judged._jdf.queryExecution().executedPlan().toString())
    got = {r["doc_id"]: r for r in judged.collect()}
    assert judged.columns[:8] == [c.split()[0] for c in COLUMNS.split(", ")]
    assert got[1]["__q_kept"] and got[None]["__q_kept"] and not got[100]["__q_kept"]
    assert not got[200]["__q_kept"], "a good document of a bad host"
    assert (got[201]["__q"]["n_words"], got[201]["__q_kept"]) == (0, False)
    assert not got[202]["__q_kept"]
    assert got[204]["__q"]["n_repeat_words"] == 50000
    assert got[205]["__q"]["symbols"] and got[205]["__q"]["n_symbols"] == 120
    assert quality.judge(frame(spark, [])).count() == 0


def test_repeated_windows_by_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in range(0, 40, 3)] + ["x y z\n" * 7, "a b c d e f\x0bg a b c d e"]
    got = quality.measure(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    for r in got:
        w = WORD.findall(texts[r["doc_id"]])
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        many = {g for g, n in Counter(grams).items() if n > 1}
        assert r["__q"]["n_repeat_words"] == len({i + k for i, g in enumerate(grams) if g in many for k in range(5)})
        lines = [x for x in texts[r["doc_id"]].split("\n") if WORD.search(x)]
        assert r["__q"]["n_dup_lines"] == len(lines) - len(set(lines))


def test_beta_prior_shrinks_small_hosts():
    mean, strength = quality.beta_prior(2, 2000, 1000, 900.0)
    assert mean == 0.5
    assert 1 <= strength < 10
    assert quality.beta_prior(3, 30, 0, 0.0) == (0.0, 30.0)
    assert quality.beta_prior(0, 0, 0, 0.0) == (0.5, 1.0)


# --- near duplicates --------------------------------------------------------

def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in sets}


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts, base = [], None
    for i in range(240):
        if i % 12 == 0:
            base = [f"w{x}" for x in rng.integers(0, 500, rng.integers(3, 120))]
            own = list(base)
        else:  # a walk: near texts whose ends are not near
            own = list(own)
            own[int(rng.integers(len(own)))] = f"v{i}"
        texts.append(" ".join(own))
    shared = " ".join(f"p{x}" for x in range(60))
    texts += [f"{shared} {' '.join(f'q{i}_{k}' for k in range(40))}" for i in range(40)]  # one passage in many texts
    texts += [texts[0].upper()] * 3 + [None, "", " \n", "a", "a", "A", "a b c d", "a b c d e", "a b c d e"]
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    want = components(sets)
    got = {r["doc_id"]: r for r in minhash.groups(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (want[d] == d) for d, r in got.items())
    assert len(set(want.values())) < len(texts) - 100


def test_no_pair_of_a_large_bucket_is_left_out(spark):
    """Pairs among texts of one template, in buckets of far more texts than leaders; blocks of any size give the same."""
    shared = " ".join(f"p{x}" for x in range(60))
    texts = [f"{shared} {' '.join(f'q{i}_{k}' for k in range(25))} end{v}" for i in range(40) for v in range(2)]
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    want = components(sets)
    assert len(set(want.values())) == 40
    got = minhash.groups(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), bands=6, rows=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    rows = [(1, i, len(s), len(texts), i, [hash(x) for x in s]) for i, s in sets.items()]
    both = spark.createDataFrame(rows, "bucket long, node long, n long, m long, component long, items array<long>")
    near = {(2 * i, 2 * i + 1) for i in range(40)}
    for block in (7, 1024):
        assert {tuple(r) for r in minhash.across(both.drop("items"), both.select("node", "items"), 75, block).collect()} == near


def test_group_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "s"), (5, text, "s"), (None, text, "s"), (9, text + " more", "s"), (7, None, "s"), (8, "x " * 60000, "s"), (9, "other words here", "s")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, None, True), (9, 5, False), (9, 5, False), (7, 7, True), (8, 8, True)], key=str)
    assert minhash.groups(frame(spark, [])).count() == 0


def test_components_of_long_chains(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(1000, 1001), (1000, 1000)], "a long, b long"))
    got = {r["node"]: r["component"] for r in minhash.components(chain).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


# --- exact top-k ------------------------------------------------------------

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(400)] + [(1000 + i, [2, 2, 2, 2, 2, 2]) for i in range(60)]
    rows += [(500, None), (501, [1, None, 1, 1, 1, 1]), (None, [9] * 6), (502, [1, 2]), (503, [3, 4]), (504, [2**31] * 6), (505, [-(2**29)] * 6)]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, vector array<long>, score int, id int")
    queries = vectors.where("vec_id % 20 = 0 or vec_id in (502, 505)")
    got = defaultdict(list)
    for r in pivots.top_k(queries.union(queries.where("vec_id = 20")), vectors, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, v) for i, v in rows if i is not None and v and None not in v]
    for q, v in usable:
        if q % 20 and q not in (502, 505):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))[:20]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert pivots.top_k(queries, vectors.limit(0), 3).count() == 0
    assert pivots.top_k(queries.limit(0), vectors, 3).count() == 0


def test_bounds_spare_candidates():
    rng = np.random.default_rng(0)
    centres = rng.integers(-500, 500, (40, 16))
    vectors = (centres[rng.integers(0, 40, 8000)] + rng.integers(-9, 10, (8000, 16))).astype(np.int64)
    chosen = pivots.spread_pivots(vectors[:500], 24)
    squares, table = pivots.table_of(vectors, chosen)
    query = (0, vectors[0], squares[0], table[:, 0], np.iinfo(np.int64).min)
    ids, scores, looked_at = pivots.search(query, (np.arange(8000), vectors, squares, table), 20)
    assert sorted(scores.tolist()) == sorted((vectors[1:] @ vectors[0]).tolist())[-20:]
    assert looked_at < 4000


def test_quantise(spark):
    rows = spark.createDataFrame([([0.5, -0.01],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([float("-inf")],), ([],)], "v array<float>")
    assert [r[0] for r in rows.select(pivots.quantise(F.col("v"))).collect()] == [[32, -1], None, None, None, None, []]
