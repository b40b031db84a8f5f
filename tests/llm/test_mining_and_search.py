"""Phrase mining, source mixing, ranked lexical search: against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evq.llm import lexical, mixing, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Further columns carry names that the operators use themselves.
COLUMNS = "doc_id long, text string, lang string, source string, chunk string, n int, words int, place int, size int, bucket string, m int, tf int"


def frame(spark, rows):
    """Documents (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "y", 5, 6) for r in rows], COLUMNS)


def prose(seed, n, vocabulary="a b c d eé f Gh i".split(), marks=(" ", " ", " ", "  ", "\t", ", ", ".", "\n")):
    draw = random.Random(seed)
    return ["".join(draw.choice(vocabulary) + draw.choice(marks) for _ in range(draw.randrange(0, 60))) for _ in range(n)]


# --- phrases ----------------------------------------------------------------

def counted(rows):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    return counts, totals


def expected_phrases(rows, least, first):
    counts, totals = counted(rows)
    out = []
    for lang, f in counts.items():
        f = {g: c for g, c in f.items() if c >= least}
        kept = []
        for g, a in f.items():
            if len(g) == 1:
                continue
            longer = [c for h, c in f.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))]
            if any(100 * c >= 80 * a for c in longer):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, g, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, g.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("modulus", "bits"), [(2, 13), (16, 27), (1, 13)])
def test_phrases_equal_brute_force(spark, modulus, bits):
    texts = [*prose(1, 150), None, "", " \t\n.,", "one", "a b c d eé f gh i " * 400, "zz " * 3000, "w" * 200_000]
    rows = [(i, t, ("en", "de", None, "und")[i % 4], "s") for i, t in enumerate(texts)]
    rows += [(900, "the same passage of many words, again and again", "en", "s")] * 40
    found = phrases.collocations(frame(spark, rows), least=5, first=40, modulus=modulus, most_bits=bits, shard_entries=500)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == expected_phrases(rows, 5, 40)
    assert {r[0] for r in got} == {"en", "de", "und"}


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None, None), (2, " ", "en", "s")]), least=1).collect() == []


def test_chunks_cover_every_word_once_and_do_not_begin_each_other():
    texts = [t.encode() for t in prose(3, 300)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    chunks, rows = phrases.parse(np.frombuffer(b"".join(texts), np.uint8), offsets, modulus=3)
    chunks = chunks.to_pylist()
    words = sum(len(c.split()) - (0 if c.endswith("\n") else phrases.OVERLAP) for c in chunks)
    assert words == sum(len(p.split()) for t in texts for p in re.split("[.,\n]", t.decode()))
    distinct = sorted(set(chunks))
    assert not any(b.startswith(a) for a, b in zip(distinct, distinct[1:], strict=False))
    assert sum(not c.endswith("\n") for c in chunks) > 100
    assert len(rows) == len(chunks)


def test_products_beyond_64_bits(spark):
    big = 2 ** 61
    counts = spark.createDataFrame([("en", 1, "a", big + 5), ("en", 1, "b", big), ("en", 2, "a b", big - 1), ("en", 3, "a b a", big - 2)],
                                   "lang string, words int, phrase string, n long")
    found = {r["phrase"]: r for r in phrases.scored(counts).collect()}
    assert found["a b"]["score"] == 2_000_000 * (big - 1) // (2 * big + 5)
    assert found["a b a"]["score"] == 2_000_000 * (big - 2) // (2 * big + 4) == found["a b a"]["score"]
    assert {(r["phrase"], r["longest"]) for r in phrases.inside_longer(counts).collect()} == {("a b", big - 2), ("b a", big - 2)}


# --- mixing -----------------------------------------------------------------

def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_targets(sizes, weights, total, most):
    """Clamp and reshare, as the definition says."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            return target | {s: weight[s] * level for s in free}
        target |= {s: most * sizes[s] for s in above}
        free -= above


def mixed_rows(seed=5):
    draw = random.Random(seed)
    rows = []
    for i in range(3000):
        source = draw.choice(["hot", "hot", "b", "a", "é", None, "", "small" if i < 400 else "hot"])
        text = None if i % 97 == 0 else " ".join("w" * draw.randrange(1, 4) for _ in range(int(draw.paretovariate(1.2))))
        rows.append((i, text, "en", source))
    rows += [(5000, None, "en", "nothing"), (5001, "", "en", "nothing"), (5002, "one giant " * 3000, "en", "giant")]
    rows += [(6000, "a repeated row of seven whole words", "en", "hot")] * 30
    return rows


@pytest.mark.parametrize(("share", "most", "weights"), [(1.5, 2.0, (3, 1, 2)), (0.3, 2.0, (1, 5)), (2.5, 2.0, (1,)), (1.0, 1.5, (1, 1, 100))])
def test_mixing_keeps_targets_and_caps(spark, share, most, weights):
    rows = mixed_rows()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += words_of(text)
    targets = expected_targets(sizes, weights, share * sum(sizes.values()), most)
    found = mixing.mix(frame(spark, rows), share=share, max_epochs=most, weights=weights).collect()
    assert sorted((r["id"], r["size"]) for r in found) == sorted((i, words_of(t)) for i, t, _, _ in rows)
    source_of, taken = {i: s for i, _, _, s in rows}, Counter()
    for r in found:
        source = source_of[r["id"]]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(targets[source])
        rate = targets[source] / sizes[source] if sizes[source] else 0
        assert math.floor(rate + 1e-9) <= r["repeats"] <= math.ceil(rate - 1e-9)
        taken[source] += r["repeats"] * r["size"]
    longest = defaultdict(int)
    for i, text, _, source in rows:
        longest[source] = max(longest[source], words_of(text))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= longest[source] / 2 + 1e-6


def test_mixing_agrees_between_runs_and_partitionings(spark):
    rows = mixed_rows(6)
    one = sorted((r["id"], r["size"], r["repeats"]) for r in mixing.mix(frame(spark, rows)).collect())
    random.Random(1).shuffle(rows)
    assert sorted((r["id"], r["size"], r["repeats"]) for r in mixing.mix(frame(spark, rows).repartition(13)).collect()) == one
    assert sorted((r["id"], r["size"], r["repeats"]) for r in mixing.mix(frame(spark, rows), seed=8).collect()) != one


def test_mixing_of_empty_tables(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    only = mixing.mix(frame(spark, [(1, None, None, None), (None, "", None, None)])).collect()
    assert {(r["id"], r["size"], r["source_size"], r["target"], r["repeats"]) for r in only} == {(1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)}
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(frame(spark, []), weights=(1, 0))


def test_mixing_has_no_python_workers(spark):
    plan = mixing.mix(frame(spark, mixed_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- lexical search ---------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def expected_ranks(items, docs, k):
    own = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n = sum(bool(c) for _, c in own)
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        found = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // max(total, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.fixture
def collection():
    draw = random.Random(9)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)] + ["Éa", "naïve", "x1", "日本"]
    docs = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(0, 80)))) for i in range(600)]
    docs += [(None, "w1 w2 x1"), (700, None), (701, ""), (702, "-- ,,"), (703, "naïve " * 20_000), (704, "A_b-c\x00d"), (705, "ABC abc")]
    docs += [(800 + i % 3, "a hot copy of w1 w2 w3") for i in range(60)]
    many = " ".join(f"w{i}" for i in range(1, 150))
    items = [(1, "w1 w2 w3"), (2, "naïve ÉA éa x1"), (3, None), (4, ""), (5, "unseen words"), (6, many), (7, "w1 " * 5), (7, "hot COPY"), (None, "日本 b")]
    return items, docs


@pytest.mark.parametrize(("k", "block"), [(20, 4 << 20), (3, 60)])
def test_search_equals_brute_force(spark, collection, monkeypatch, k, block):
    items, docs = collection
    monkeypatch.setattr(lexical, "STEP", 2)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    found = lexical.search(asked, frame(spark, [(i, t, "en", "s") for i, t in docs]), k=k, block_bytes=block).drop("scored")
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(tuple(r) for r in found.collect()) == ordered(expected_ranks(items, docs, k))


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = frame(spark, [(1, "a c", "en", "s")])
    assert lexical.search(items, frame(spark, [])).collect() == []
    assert lexical.search(items.where("false"), docs).collect() == []
    assert lexical.search(items, frame(spark, [(1, None, "en", "s")])).collect() == []


def test_masks_are_scored_from_the_highest_bound_down_until_no_document_can_enter():
    draw = np.random.default_rng(4)
    sizes = draw.integers(0, 12, 5000)
    terms = np.concatenate([draw.choice(40, s, replace=False, p=np.arange(40, 0, -1) / 820) for s in sizes]).astype(np.int64)
    tf, m = draw.integers(1, 4, len(terms)), draw.integers(80, 140, len(sizes))
    block = lexical.Block(m, sizes, terms, tf, 40)
    own, weights = np.arange(0, 40, 3), draw.integers(100, 6000, 14)
    scores = np.zeros(len(sizes), np.int64)
    for t, w in zip(own, weights, strict=True):
        scores += w * np.where((f := block.frequencies(t, np.arange(len(sizes)))) > 0, lexical.part_score(np.maximum(f, 1), m), 0)
    docs, got, seen = block.best(own, weights, 0, 10)
    first = lexical.firsts(got, pa.array(docs), 10)
    assert [(int(docs[i]), int(got[i])) for i in first] == sorted(enumerate(scores.tolist()), key=lambda x: (-x[1], x[0]))[:10]
    assert seen < len(sizes) / 4
    assert block.best(own, weights, int(scores.max()) + 1, 10)[2] < 20
