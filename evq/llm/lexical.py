"""Ranked lexical search: the documents of every item, by presence masks.

The texts are read once: a task turns them into arrays, keeps the terms that some item asks for, and writes one row per
document with the numbers and frequencies of its terms (the postings). Document frequencies are counted from these rows.
Then, item by item, a task puts the documents of a block into a bitmap per term, joins the bitmaps of the item's terms into
one mask per document and groups documents by mask. A mask has a highest possible score: that of the greatest term
frequencies and the least length factor that occur in its group. Masks are scored from the highest bound down, until the
bound is below the score of the k-th best document that the task has seen so far. A document of an unscored mask cannot be
among the first k, so the result is exact. Tasks return k documents per item, and Spark ranks these.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text (one item at least), each a job of its own, so what is
broadcast (the distinct terms of a block and their weights) is bounded whatever the number of items; documents are never
broadcast, joined or collected.

Null and empty texts have no terms; items without terms give no rows. Rows of items are items, also where their ids repeat;
rows of documents are documents. Equal scores go by ascending id, null first. An empty table gives no rows. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.flat import LOWER, expand, slices, text_bytes
from evq.operators.ordering import top_n_per_group
from evq.session import materialize

BLOCK_BYTES = 4 << 20
#: Documents whose bitmaps a task holds at once.
BLOCK_DOCS = 16_384
#: Masks that are scored in one step; steps grow from here.
STEP = 16

_ASCII = np.arange(256)
#: Bytes of terms: digits, letters and all bytes of characters beyond ASCII.
TERM = (_ASCII >= 0x80) | ((_ASCII >= 0x30) & (_ASCII <= 0x39)) | ((_ASCII >= 0x41) & (_ASCII <= 0x5A)) | ((_ASCII >= 0x61) & (_ASCII <= 0x7A))


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, number of terms per row) of texts given as bytes."""
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    head = inside & edge[:-1]
    head[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(head)
    letters = LOWER[data[inside]]
    places = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(letters)))
    return terms, np.diff(np.searchsorted(starts, offsets))


# --- postings ---------------------------------------------------------------

def _post(asked: pa.Array):
    """Per document: the number of its terms, and which asked terms it holds how often."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets, 8 << 20):
                terms, counts = terms_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                number = pc.index_in(terms, value_set=asked)
                known = number.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(j - i), counts)[known]
                pair, often = np.unique(row * len(asked) + number.drop_null().to_numpy().astype(np.int64), return_counts=True)
                ends = np.searchsorted(pair, np.arange(j - i + 1) * len(asked)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % max(len(asked), 1), often)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.array(counts.astype(np.int64)), *lists], names=["id", "n", "terms", "tf"])

    return run


def postings(docs: DataFrame, key: str, text: str, asked: pa.Array) -> DataFrame:
    """id, n (terms with repeats), terms (numbers in ``asked``) and tf of every document."""
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_post(asked), f"id {kind}, n long, terms array<int>, tf array<int>")


# --- masks ------------------------------------------------------------------

def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of a term in a score before its weight; rises with tf, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Block:
    """The postings of some documents by term, with a bitmap of documents per term."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, vocabulary: int):
        doc, _ = expand(sizes)
        order = np.argsort(terms, kind="stable")
        self.m, self.docs, self.tf = m, doc[order], tf[order]
        self.ends = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, term: int) -> np.ndarray:
        if term not in self.bitmaps:
            there = np.zeros(len(self.m), dtype=bool)
            there[self.docs[self.ends[term]:self.ends[term + 1]]] = True
            self.bitmaps[term] = np.packbits(there)
        return self.bitmaps[term]

    def frequencies(self, term: int, of: np.ndarray) -> np.ndarray:
        """Frequency of a term in the given documents, which ascend; 0 where it is absent."""
        docs, tf = self.docs[self.ends[term]:self.ends[term + 1]], self.tf[self.ends[term]:self.ends[term + 1]]
        if len(docs) == 0:
            return np.zeros(len(of), np.int64)
        at = np.minimum(np.searchsorted(docs, of), len(docs) - 1)
        return np.where(docs[at] == of, tf[at], 0)

    def groups(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents with a term, grouped by mask; starts of the groups; mask per group as one row of booleans).

        A mask is a number while the item has up to 64 terms, else a string of bytes.
        """
        maps = np.stack([self.bitmap(t) for t in terms])
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(maps), count=len(self.m)))
        bits = np.unpackbits(maps, axis=1, count=len(self.m))[:, docs]
        packed = np.packbits(bits, axis=0).T
        width = 8 * -(-packed.shape[1] // 8)
        padded = np.zeros((len(docs), width), np.uint8)
        padded[:, :packed.shape[1]] = packed
        names = padded.view(np.uint64 if width == 8 else np.dtype((np.void, width))).reshape(-1)
        order = np.argsort(names, kind="stable")
        ordered = names[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(docs) else np.zeros(0, np.int64)
        return docs[order], starts, bits[:, order[starts]].T.astype(bool)

    def best(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents scored): all of the block that may be among the first ``k`` with ``least`` as k-th score so far.

        ``weights`` are those of the terms times their repeats in the item.
        """
        docs, starts, masks = self.groups(terms)
        if len(docs) == 0:
            return docs, np.zeros(0, np.int64), 0
        shortest = np.minimum.reduceat(self.m[docs], starts)
        most = np.array([self.tf[self.ends[t]:self.ends[t + 1]].max(initial=1) for t in terms])
        bounds = (np.where(masks, part_score(most[None, :], shortest[:, None]), 0) * weights).sum(axis=1)
        ends = np.append(starts[1:], len(docs))
        order, at, step = np.argsort(-bounds, kind="stable"), 0, STEP
        found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while at < len(order) and bounds[order[at]] >= least:
            turn = order[at:at + step]
            turn = turn[bounds[turn] >= least]
            row, place = expand(ends[turn] - starts[turn])
            some = np.sort(docs[starts[turn][row] + place])
            score = sum(w * part_score(self.frequencies(t, some), self.m[some]) for t, w in zip(terms, weights, strict=True))
            found.append(some)
            scores.append(score)
            every = np.concatenate(scores)
            if len(every) >= k:
                least = max(least, int(np.partition(every, len(every) - k)[len(every) - k]))
            at, step = at + step, 2 * step
        found, scores = np.concatenate(found), np.concatenate(scores)
        good = (scores >= least) & (scores > 0)
        return found[good], scores[good], len(found)


def firsts(scores: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; equal ones by ascending id, null first."""
    order = np.argsort(-scores, kind="stable")[:]
    if len(order) > k:
        order = np.flatnonzero(scores >= scores[order[k - 1]])
    table = pa.table({"s": scores[order], "i": ids.take(pa.array(order))})
    place = pc.sort_indices(table, sort_keys=[("s", "descending"), ("i", "ascending")], null_placement="at_start")
    return order[place.to_numpy()[:k]]


def _rank(items: list[tuple[int, np.ndarray, np.ndarray]], weight_of: np.ndarray, k: int, kind: pa.DataType):
    """Of a task: the first ``k`` documents per item, and how many documents were scored for it."""

    def blocks(batches):
        """Postings in blocks of BLOCK_DOCS documents."""
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += len(batch)
            if size >= BLOCK_DOCS:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, size = [], 0
        if kept:
            yield pa.Table.from_batches(kept).combine_chunks()

    def run(batches):
        empty = (pa.array([], kind), np.zeros(0, np.int64))
        best = [empty] * len(items)
        scored = np.zeros(len(items), np.int64)
        for table in blocks(batches):
            ids, terms, tf = (table[c].combine_chunks() for c in ("id", "terms", "tf"))
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (terms, tf)]
            block = Block(table["m"].to_numpy(), terms.value_lengths().to_numpy(zero_copy_only=False), flat[0], flat[1].astype(np.int64), len(weight_of))
            for x, (_, own, times) in enumerate(items):
                least = int(best[x][1][-1]) if len(best[x][1]) == k else 0
                docs, scores, seen = block.best(own, weight_of[own] * times, least, k)
                scored[x] += seen
                if len(docs):
                    names = pa.concat_arrays([best[x][0], ids.take(pa.array(docs))])
                    scores = np.concatenate([best[x][1], scores])
                    first = firsts(scores, names, k)
                    best[x] = names.take(pa.array(first)), scores[first]
        for x, (place, _, _) in enumerate(items):
            n = len(best[x][0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, place, np.int64)), best[x][0], pa.array(best[x][1]), pa.array(np.full(n, scored[x]))],
                names=["place", "id", "score", "scored"])

    return run


# --- search -----------------------------------------------------------------

def weights_of(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def length_factor(n: int, total: int) -> Column:
    """100 - 25 + (25 * own terms * documents) div all terms, in decimals, as the product may pass 64 bits."""
    wide = f"cast(n as decimal(19, 0)) * cast({25 * n} as decimal(19, 0)) div cast({max(total, 1)} as decimal(19, 0))"
    return F.expr(f"cast(75 + {wide} as long)")


def item_blocks(items: DataFrame, key: str, text: str, limit: int) -> list[DataFrame]:
    """The items (id, text) dealt by hash into as few blocks as hold ``limit`` bytes each."""
    source = items.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    volume = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(volume / limit))
    return [source.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) for i in range(n)]


def search(items: DataFrame, docs: DataFrame, k: int = 20, item_key: str = "item_id", item_text: str = "text", key: str = "doc_id",
           text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score, scored (documents that the task of this row scored): the first ``k`` documents per item."""
    out = [_search_block(b, docs, k, key, text) for b in item_blocks(items, item_key, item_text, block_bytes)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _search_block(items: DataFrame, docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = items.toArrow()  # a block of bounded size
    terms, counts = terms_of(*text_bytes(rows["text"]))
    asked = pc.unique(terms)
    numbers = np.split(pc.index_in(terms, value_set=asked).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts)[:-1])
    plan = []
    for place, own in enumerate(numbers):
        if len(own):
            times = Counter(own.tolist())
            plan.append((place, np.array(list(times), np.int64), np.array(list(times.values()), np.int64)))
    posted = materialize(postings(docs, key, text, asked), "postings")
    n, total = posted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    df = np.zeros(len(asked), np.int64)
    for row in posted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # the terms of the block
        df[row["term"]] = row["count"]
    kind = docs.schema[key].dataType
    source = posted.where(F.size("terms") > 0).select("id", length_factor(n, total or 0).alias("m"), "terms", "tf")
    run = _rank(plan, weights_of(n, df), k, rows_type(posted))
    found = source.mapInArrow(run, f"place long, id {kind.simpleString()}, score long, scored long")
    ranked = top_n_per_group(found, ["place"], [F.col("score").desc(), F.col("id")], k)
    named = spark.createDataFrame(pa.table({"place": pa.array(range(len(rows)), pa.int64()), "item_id": rows["id"]}))
    return ranked.join(F.broadcast(named), "place").select("item_id", "rank", F.col("id").alias("doc_id"), "score", "scored")


def rows_type(frame: DataFrame) -> pa.DataType:
    """The Arrow type of the ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema["id"].dataType)
