"""Interpolated modified Kneser-Ney n-gram model (Chen and Goodman 1999; Heafield et al. 2013 for the counts).

Counting is a Spark job: every task hashes the n-grams of its texts, adds equal ones up and sends sorted, packed runs
to hash shards; a shard merges its runs into one sorted hash array with a count array. Shards follow the hash, so a
frequent n-gram or context is one entry per task and never makes a shard large. Continuation counts and context
statistics need no further n-gram shuffle: each occurrence of an n-gram that was counted c times adds 1/c, so that one
pass over the texts sums them by key. The arrays live in the shared folder; workers map them into memory and look up
sorted queries, so their memory does not grow with the model.

Texts: null or empty is the empty text (its only token is the end). Repeated rows count repeatedly. Equal 64-bit hashes
are taken for equal n-grams.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.flat import expand, join_hash, mix, slices, text_bytes, word_hashes
from evq.llm.shared import mounted_folder, open_array, save_array

END = mix(np.uint64(0xE0D))
BEGIN = mix(np.uint64(0xB0B))
#: Tokens that a task gathers before it adds equal n-grams up.
FLUSH = 3_000_000
#: Bytes of training text for each hash shard.
SHARD_BYTES = 8 << 20


@dataclass(frozen=True)
class Model:
    """Where the arrays are and the few numbers that hold for all texts."""

    folder: str
    order: int
    shards: int
    tokens: int
    vocabulary: int
    discounts: tuple[tuple[float, float, float], ...]  # by order, the lowest first
    base_total: float  # distinct bigrams, the sum of the unigram continuation counts
    base_mass: float  # probability that the unigram level leaves to the uniform one


# --- n-grams of a batch -----------------------------------------------------

def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(n-gram hashes by order, context hashes by order, tokens per row); the end counts as a token.

    ``contexts[k]`` belongs to ``grams[k]``; contexts[0] is unused. Before the first word stand begin marks.
    """
    words, counts = word_hashes(data, offsets)
    lengths = counts + 1
    row, at = expand(lengths)
    tokens = np.full(len(row), END, dtype=np.uint64)
    tokens[at < counts[row]] = words
    level, contexts = [tokens], [np.zeros(0, np.uint64)]
    pad = BEGIN
    for _ in range(1, order):
        before = np.empty_like(tokens)
        before[1:] = level[-1][:-1]
        before[at == 0] = pad
        contexts.append(before)
        level.append(join_hash(before, tokens))
        pad = join_hash(pad, BEGIN)
    return level, contexts, lengths


# --- packed runs between the tasks ------------------------------------------

def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


RUN = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])
RUN_DDL = "kind string, shard int, keys binary, sums binary"


def runs(kind: str, keys: np.ndarray, sums: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row per shard for sorted distinct keys and their sums (n x m)."""
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    used = np.flatnonzero(np.diff(cuts))
    packed = [(squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(sums[a:b].reshape(-1)))
              for a, b in zip(cuts[used], cuts[used + 1], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array([p[0] for p in packed], pa.binary()),
         pa.array([p[1] for p in packed], pa.binary())], schema=RUN)


def add_up(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their values (n x m), or their number."""
    if values is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(first, append=len(keys)).astype(np.uint32).reshape(-1, 1)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first, axis=0) if len(keys) else values


def merge_runs(table: pa.Table, dtype, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(unsqueeze(x.as_py(), np.uint64), dtype=np.uint64) for x in table["keys"]])
    sums = np.concatenate([unsqueeze(x.as_py(), dtype).reshape(-1, width) for x in table["sums"]])
    return add_up(keys, sums.astype(np.float64))


# --- lookups ----------------------------------------------------------------

class Arrays:
    """Sorted hash arrays of one kind, mapped shard by shard."""

    def __init__(self, folder: str, kind: str, shards: int):
        self.shards, self.paths = shards, [os.path.join(folder, f"{kind}-{i}") for i in range(shards)]

    @lru_cache(maxsize=4096)  # noqa: B019  lives as long as the worker
    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray] | None:
        if not os.path.exists(f"{self.paths[i]}.keys.npy"):
            return None
        return open_array(f"{self.paths[i]}.keys.npy"), open_array(f"{self.paths[i]}.sums.npy")

    def find(self, keys: np.ndarray, width: int = 1) -> np.ndarray:
        """The sums of the keys, which may repeat; 0 for keys that are not there."""
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
        distinct = ordered[first]
        found = np.zeros((len(distinct), width))
        cuts = np.searchsorted(shard_of(distinct, self.shards), np.arange(self.shards + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            if (have := self.shard(int(i))) is None:
                continue
            asked = distinct[cuts[i]:cuts[i + 1]]
            at = np.minimum(np.searchsorted(have[0], asked), len(have[0]) - 1)
            hit = have[0][at] == asked
            found[cuts[i]:cuts[i + 1]][hit] = have[1][at[hit]]
        out = np.empty((len(keys), width))
        out[order] = found[np.cumsum(first) - 1]
        return out


def narrow(sums: np.ndarray) -> np.ndarray:
    whole = np.rint(sums)
    top = whole.max() if whole.size else 0
    return whole.astype(np.uint8 if top < 256 else np.uint32 if top < 2**32 else np.uint64)


# --- fitting ----------------------------------------------------------------

def _count(order: int, shards: int):
    def run(batches):
        kept: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0

        def flush():
            for k in range(order):
                keys, sums = add_up(np.concatenate(kept[k]))
                kept[k].clear()
                yield runs(f"n{k + 1}", keys, sums, shards)

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                level, _, _ = grams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], order)
                for k in range(order):
                    kept[k].append(level[k])
                size += len(level[0])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return run


def _weigh(folder: str, order: int, shards: int, contexts_of: tuple[int, ...], continuations: tuple[int, ...]):
    """Runs of continuation counts ("a<k>") and of context statistics ("h<k>": total, n1, n2, n3 and more)."""

    def run(batches):
        raw = {k: Arrays(folder, f"n{k}", shards) for k in {*contexts_of, *(k + 1 for k in continuations)}}
        adjusted = {k: Arrays(folder, f"a{k}", shards) for k in contexts_of if k < order}
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush():
            for kind, parts in kept.items():
                keys, sums = add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield runs(kind, keys, sums, shards)
            kept.clear()

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                level, contexts, _ = grams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], order)
                share = {k: 1.0 / a.find(level[k - 1])[:, 0] for k, a in raw.items()}
                for k in continuations:
                    kept.setdefault(f"a{k}", []).append(add_up(level[k - 1], share[k + 1].reshape(-1, 1)))
                for k in contexts_of:
                    count = adjusted[k].find(level[k - 1])[:, 0] if k < order else np.rint(1.0 / share[k])
                    stats = np.stack([count, count == 1, count == 2, count >= 3], axis=1) * share[k][:, None]
                    kept.setdefault(f"h{k}", []).append(add_up(contexts[k - 1], stats))
                size += len(level[0])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return run


FACTS_DDL = "kind string, n long, total double, n1 long, n2 long, n3 long, n4 long"
FACTS = pa.schema([("kind", pa.string()), ("n", pa.int64()), ("total", pa.float64()), *((f"n{i}", pa.int64()) for i in range(1, 5))])


def _store(folder: str, dtype):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, shard = key[0].as_py(), key[1].as_py()
        keys, sums = merge_runs(table, dtype, 4 if kind[0] == "h" else 1)
        sums = narrow(sums)
        path = os.path.join(folder, f"{kind}-{shard}")
        save_array(f"{path}.sums.npy", sums)
        save_array(f"{path}.keys.npy", keys)
        tally = np.bincount(np.minimum(sums[:, 0], 5).astype(np.int64), minlength=6)
        return pa.Table.from_arrays(
            [pa.array([kind]), pa.array([len(keys)]), pa.array([float(sums[:, 0].sum(dtype=np.float64))]),
             *(pa.array([int(tally[i])]) for i in range(1, 5))], schema=FACTS)

    return run


def _facts(runs_of: DataFrame, folder: str, dtype) -> dict[str, dict]:
    """Store the shards and return a few totals per kind."""
    per_shard = runs_of.groupBy("kind", "shard").applyInArrow(_store(folder, dtype), FACTS_DDL)
    total = per_shard.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n", "total", "n1", "n2", "n3", "n4")))
    return {r["kind"]: r.asDict() for r in total.collect()}  # one row per order


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney; 0.5, 1 and 1.5 where the counts of counts don't define one."""
    out = [0.5, 1.0, 1.5]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4))):
            if a and b:
                out[i] = min(max(i + 1 - (i + 2) * y * b / a, 1e-3), i + 1 - 1e-3)
    return tuple(out)


def fit(docs: DataFrame, text: str = "text", order: int = 2, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the model over all rows of ``docs``; an empty table gives a model that knows only the end.

    The arrays are written below the shared folder, which must be a mounted path.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    docs = docs.select(F.col(text).cast("string").alias("text"))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(volume / shard_bytes))
    folder = mounted_folder(spark, "ngram-lm")
    facts = _facts(docs.mapInArrow(_count(order, shards), RUN_DDL), folder, np.uint32)
    for contexts_of, continuations in [((order,), tuple(range(1, order)))] + [(tuple(range(2, order)), ())] * (order > 2):
        facts |= _facts(docs.mapInArrow(_weigh(folder, order, shards, contexts_of, continuations), RUN_DDL), folder, np.float64)
    none = dict.fromkeys(("n", "n1", "n2", "n3", "n4"), 0) | {"total": 0.0}
    kinds = [*(f"a{k}" for k in range(1, order)), f"n{order}"]
    steps = tuple(discounts(*((facts.get(k) or none)[f"n{i}"] for i in range(1, 5))) for k in kinds)
    base, words = facts.get("a1") or none, facts.get("n1") or none
    rest = base["n"] - base["n1"] - base["n2"]
    mass = (steps[0][0] * base["n1"] + steps[0][1] * base["n2"] + steps[0][2] * rest) / base["total"] if base["total"] else 1.0
    model = Model(folder, order, shards, int(words["total"]), int(words["n"]), steps, base["total"], mass)
    with open(os.path.join(folder, "model.json"), "w") as f:
        json.dump(model.__dict__, f)
    return model


def load(folder: str) -> Model:
    with open(os.path.join(folder, "model.json")) as f:
        found = json.load(f)
    return Model(**found | {"discounts": tuple(map(tuple, found["discounts"]))})


# --- scoring ----------------------------------------------------------------

class Scorer:
    """Looks texts up in the mapped arrays."""

    def __init__(self, model: Model):
        kinds = [*(f"a{k}" for k in range(1, model.order)), f"n{model.order}"]
        self.model = model
        self.words = Arrays(model.folder, "n1", model.shards)
        self.counts = [Arrays(model.folder, k, model.shards) for k in kinds]
        self.contexts = [Arrays(model.folder, f"h{k}", model.shards) for k in range(2, model.order + 1)]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Per row: number of tokens, of known tokens, log10 under add-one unigrams and under the model."""
        m = self.model
        level, contexts, lengths = grams(data, offsets, m.order)
        row, n = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
        seen = self.words.find(level[0])[:, 0]
        base = np.log10((seen + 1) / (m.tokens + (m.vocabulary + 1)))

        def less(count, d):
            return np.maximum(count - np.select([count == 0, count == 1, count == 2], [0.0, d[0], d[1]], d[2]), 0.0)

        count = self.counts[0].find(level[0])[:, 0]
        p = less(count, m.discounts[0]) / max(m.base_total, 1.0) + m.base_mass / (m.vocabulary + 1)
        for k in range(1, m.order):
            count, stats = self.counts[k].find(level[k])[:, 0], self.contexts[k - 1].find(contexts[k], 4)
            total, d = stats[:, 0], m.discounts[k]
            there = np.maximum(total, 1.0)
            p = np.where(total > 0, less(count, d) / there + (stats[:, 1:] @ np.array(d)) / there * p, p)
        return {"n_tokens": lengths, "n_known": np.bincount(row, seen > 0, n).astype(np.int64),
                "base_score": np.bincount(row, base, n), "score": np.bincount(row, np.log10(p), n)}


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns of ``keep``, n_tokens, n_known, base_score, score and perplexity of every row.

    Scores are log10 probabilities; perplexity is 10 ** (-score / n_tokens).
    """
    kept = [key, *keep]
    source = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    parts = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            data, offsets = text_bytes(batch.column("__text"))
            for i, j in slices(offsets):
                found = scorer.score(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[i:j] for c in kept), *(pa.array(found[c], t) for c, t in parts)], names=[*kept, *(c for c, _ in parts)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]),
                        "n_tokens long, n_known long, base_score double, score double"])
    return source.mapInArrow(run, schema).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
