"""Collocations of two to four words, counted inside the distinct chunks of a prefix-free parse.

A text falls into pieces (at marks and line breaks) and a piece into words. Where the hash of ``OVERLAP`` words in a row
meets a fixed condition, a new chunk of the piece begins and the chunk before it runs on over these words, so that cuts
depend on content alone and repeated passages give the same chunks wherever they lie. Every chunk ends in a mark: the last
one of a piece differs from one that runs on, so no chunk is the beginning of another. Spark adds equal chunks up; all
further work is on the distinct chunks, each with its frequency. An n-gram belongs to the chunk in which it starts before
the overlap, so that one in the overlap is counted once.

Counting takes two passes over the dictionary of chunks. The first adds hashes of n-grams up in hash shards, where only
those that reach ``least`` leave a bit in a table of at most ``2 ** MOST_BITS`` bits. The second adds up the words of
n-grams whose bit is set, by their text. Equal hashes only let more n-grams through, so counts are exact, and a table too
small for the corpus costs time, not results.

Null or empty texts have no words; a null group is ``und``; repeated rows count repeatedly; an empty table gives no rows.
Only A-Z are lowered. Further columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.flat import LOWER, SPACE, join_hash, slices, text_bytes, word_hashes
from evq.llm.ngram_lm import RUN_DDL, add_up, merge_runs, runs
from evq.operators.ordering import top_n_per_group
from evq.session import materialize

MARKS = [ord(c) for c in ".,;:!?\n\v\f\r"]
#: Words that neighbouring chunks share: all but one word of the longest phrase.
LONGEST = 4
OVERLAP = LONGEST - 1
#: One of so many places begins a chunk.
MODULUS = 16
#: Bytes of chunks that a task works on at once, and entries of a hash shard.
SLICE = 6 << 20
SHARD_ENTRIES = 4 << 20
MOST_BITS = 27

#: Piece ends become line feeds, tabs become blanks, A-Z are lowered.
FOLD = LOWER.copy()
FOLD[MARKS], FOLD[9] = 10, 32


# --- parsing ----------------------------------------------------------------

def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the given slices, one after the other."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)], offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, buffers[1], buffers[2])


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of folded text."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    head, tail = inside & edge[:-1], inside & edge[1:]
    head[1:] |= inside[1:] & ~inside[:-1]
    tail[:-1] |= inside[:-1] & ~inside[1:]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(offsets, starts, side="right") - 1


def parse(data: np.ndarray, offsets: np.ndarray, modulus: int = MODULUS) -> tuple[pa.Array, np.ndarray]:
    """(chunks, their rows). Words of a chunk end in a blank, the last word of a piece in a line feed."""
    data = FOLD[data]
    starts, ends, row = word_places(data, offsets)
    if len(starts) == 0:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    hashes, _ = word_hashes(data, offsets)
    broken = np.cumsum(data == 10)[starts]
    opens = np.concatenate([[True], (broken[1:] != broken[:-1]) | (row[1:] != row[:-1])])
    n = len(starts)
    piece_end = np.append(np.flatnonzero(opens), n)[np.cumsum(opens)]
    window = hashes
    for k in range(1, OVERLAP):
        window = join_hash(window, np.roll(hashes, -k))
    triggered = (window % np.uint64(modulus) == 0) & (np.arange(n) + OVERLAP <= piece_end)
    first = np.flatnonzero(opens | triggered)
    following = np.append(first[1:], n)
    final = following == piece_end[first]
    last = np.where(final, following, following + OVERLAP)
    # Words one after the other, each with one byte behind it.
    text, places = cut(np.append(data, np.uint8(32)), starts, ends + 1)
    text[places[1:] - 1] = 32
    chunks, bounds = cut(text, places[first], places[last])
    chunks[bounds[1:] - 1] = np.where(final, 10, 32)
    return strings(chunks, bounds), row[first]


CHUNK_DDL = "lang string, chunk string, n long"


def _parse_batches(modulus: int):
    def run(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                chunks, rows = parse(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], modulus)
                found = chunks.dictionary_encode()
                keys = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(names) + codes[i:j][rows]
                keys, counts = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(keys % len(names))).cast(pa.string()), found.dictionary.take(pa.array(keys // len(names))).cast(pa.string()),
                     pa.array(counts, pa.int64())], names=["lang", "chunk", "n"])

    return run


def dictionary(docs: DataFrame, text: str = "text", group: str = "lang", modulus: int = MODULUS) -> DataFrame:
    """The distinct chunks per group with their frequency in the parse: lang, chunk, n."""
    source = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    parsed = source.mapInArrow(_parse_batches(modulus), CHUNK_DDL)
    return parsed.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


# --- n-grams of chunks ------------------------------------------------------

def gathered(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.Table]:
    """Batches put together until they hold ``limit`` bytes."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(kept)
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


class Grams:
    """The n-grams that the chunks of a table own: hashes by length, and their places."""

    def __init__(self, table: pa.Table):
        self.data, offsets = text_bytes(table["chunk"])
        self.langs = table["lang"].combine_chunks().dictionary_encode()
        codes = self.langs.indices.to_numpy(zero_copy_only=False)
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                          for x in self.langs.dictionary.to_pylist()], dtype=np.uint64)
        self.starts, self.ends, row = word_places(self.data, offsets)
        self.hashes, counts = word_hashes(self.data, offsets)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        final = self.data[offsets[1:] - 1] == 10
        self.owned = at < np.where(final, counts, counts - OVERLAP)[row]
        self.left = counts[row] - at  # words from here to the end of the chunk
        self.lang = codes[row]
        self.weight = table["n"].to_numpy()[row]
        self.seed = seeds[self.lang]

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, where an n-gram starts, its hash) for n from 1 to LONGEST."""
        at, key = np.flatnonzero(self.owned), None
        for n in range(1, LONGEST + 1):
            fits = self.left[at] >= n
            at = at[fits]
            key = join_hash(self.seed[at] if key is None else key[fits], self.hashes[at + n - 1])
            yield n, at, key


def _hash_runs(shards: int, least: int):
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches):
        for table in gathered(batches):
            grams = Grams(table)
            ones, more, weights = [], [], []
            for _, at, key in grams.levels():
                weight = grams.weight[at]
                ones.append(key[weight == 1])
                more.append(key[weight > 1])
                weights.append(weight[weight > 1])
            for keys, sums in (add_up(np.concatenate(ones)), add_up(np.concatenate(more), np.concatenate(weights).reshape(-1, 1))):
                yield runs("", keys, np.minimum(sums, least).astype(kind), shards)  # enough to tell who reaches ``least``

    return run


def _reached(shards: int, least: int, bits: int):
    """Of a shard: which places of its slice of the bit table hold a hash that reaches ``least``."""
    width = (1 << bits) // shards

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, sums = merge_runs(table, np.uint8 if least < 256 else np.uint32, 1)
        there = np.zeros(width, dtype=bool)
        there[((keys[sums[:, 0] >= least] >> np.uint64(64 - bits)) % np.uint64(width)).astype(np.int64)] = True
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(there).tobytes()], pa.binary())})

    return run


def _firsts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of equal keys in it, rank of every key among the distinct ones)."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return order, np.flatnonzero(fresh), rank


GRAM_DDL = "lang string, words int, phrase string, n long"


def _phrases(table_of_bits, bits: int):
    def run(batches):
        passing = np.frombuffer(table_of_bits.value, np.uint8)
        for table in gathered(batches):
            grams = Grams(table)
            places = np.concatenate([[0], np.cumsum(grams.ends - grams.starts)])
            ids = strings(grams.data[~SPACE[grams.data]], places).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.int64(ids.max() + 1) if len(ids) else np.int64(1)
            for n, at, key in grams.levels():
                place = (key >> np.uint64(64 - bits)).astype(np.int64)
                at = at[(passing[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
                if len(at) == 0:
                    continue
                exact = grams.lang[at].astype(np.int64) * size + ids[at]
                for k in range(1, n):
                    exact = _firsts(exact)[2] * size + ids[at + k]
                order, first, _ = _firsts(exact)
                one = at[order[first]]
                phrase = strings(*cut(grams.data, grams.starts[one], grams.ends[one + n - 1]))
                yield pa.RecordBatch.from_arrays(
                    [grams.langs.dictionary.take(pa.array(grams.lang[one])).cast(pa.string()), pa.array(np.full(len(one), n, np.int32)), phrase.cast(pa.string()),
                     pa.array(np.add.reduceat(grams.weight[at][order], first))], names=["lang", "words", "phrase", "n"])

    return run


def frequent(chunks: DataFrame, least: int, total: int, shard_entries: int = SHARD_ENTRIES, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, words, phrase, n: the n-grams of one to LONGEST words with at least ``least`` occurrences.

    ``chunks`` is read twice, so it should be a written table; ``total`` is its number of words, which sets the number of
    hash shards and the size of the bit table (two bits per word, never more than ``2 ** most_bits``).
    """
    spark = chunks.sparkSession
    bits = min(max(math.ceil(math.log2(2 * total + 2)), 13), most_bits)
    shards = 1 << min(max(math.ceil(math.log2(LONGEST * total / shard_entries + 1)), 3), bits - 3)
    sums = chunks.mapInArrow(_hash_runs(shards, least), RUN_DDL)
    slices_of = sums.groupBy("shard").applyInArrow(_reached(shards, least, bits), "shard int, bits binary")
    width = (1 << bits) // shards // 8
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for part in slices_of.toLocalIterator():  # 2 ** most_bits bits at most
        whole[part["shard"] * width:(part["shard"] + 1) * width] = np.frombuffer(part["bits"], np.uint8)
    counted = chunks.mapInArrow(_phrases(spark.sparkContext.broadcast(whole.tobytes()), bits), GRAM_DDL)
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- ranking ----------------------------------------------------------------

def _parts(lowest: int, highest: int) -> Column:
    """The shorter runs of words inside a phrase (its words are ``w``), of at least ``lowest`` words."""
    places = [(n, i) for n in range(lowest, highest) for i in range(1, highest - n + 2)]
    runs_of = [F.when((F.size("w") > n) & (F.size("w") >= n + i - 1), F.array_join(F.slice("w", i, n), " ")) for n, i in places]
    return F.array_distinct(F.array_compact(F.array(*runs_of)))


def scored(counts: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more: its weakest cut, the first of equal ones.

    All parts of a frequent phrase are frequent, so both sides of every cut are in ``counts``.
    """
    phrases = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    wide = "cast({} as decimal(20, 0))"
    score = F.expr(f"cast({scale} * {wide.format('a')} div ({wide.format('l')} + {wide.format('r')}) as long)")
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("c"))
    return weakest.select("lang", "phrase", *(f"c.{x}" for x in ("a", "l", "r", "score")))


def inside_longer(counts: DataFrame) -> DataFrame:
    """lang, phrase, longest: the greatest count of a longer phrase that holds the words of this one in a row."""
    longer = counts.where("words > 2").select("lang", F.col("n").alias("longest"), F.split("phrase", " ").alias("w"))
    parts = longer.select("lang", "longest", F.explode(_parts(2, LONGEST)).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = 30, first: int = 2000, share: tuple[int, int] = (80, 100),
                 modulus: int = MODULUS, shard_entries: int = SHARD_ENTRIES, most_bits: int = MOST_BITS) -> DataFrame:
    """The ``first`` collocations per group: lang, rank, phrase, a, l, r, n, score.

    A phrase that lies in a longer one with at least ``share`` of its occurrences is left out. Ranks go by score and count,
    both falling, then by the bytes of the phrase.
    """
    chunks = materialize(dictionary(docs, text, group, modulus), "chunks")
    words = F.length("chunk") - F.length(F.translate("chunk", " \n", ""))
    owned = words - F.when(F.col("chunk").endswith("\n"), 0).otherwise(OVERLAP)
    totals = materialize(chunks.groupBy("lang").agg(F.sum(F.col("n") * owned).alias("total")), "totals")
    total = totals.agg(F.sum("total")).first()[0] or 0
    counts = materialize(frequent(chunks, least, total, shard_entries, most_bits), "phrases")
    kept = scored(counts).join(inside_longer(counts), ["lang", "phrase"], "left")
    over = F.expr(f"cast({share[1]} as decimal(17, 0)) * cast(longest as decimal(20, 0)) >= cast({share[0]} as decimal(17, 0)) * cast(a as decimal(20, 0))")
    kept = kept.where(~F.coalesce(over, F.lit(False)))
    ranked = top_n_per_group(kept, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
