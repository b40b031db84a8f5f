"""Near-duplicate groups: one-permutation MinHash with optimal densification, bands and star-shaped candidate edges.

The set of a text is its distinct five-word shingles; a text of fewer words is one shingle, one without words has an
empty set and no links. Sets are kept as 64-bit hashes of their shingles.

1. One hash per shingle gives all signature slots (Li, Owen and Zhang 2012): a slot keeps the least hash in its part of
   the hash range; an empty slot takes the value of a slot drawn by a hash of (slot, attempt), the first that is not empty
   (Shrivastava 2017). Texts with equal sets form a class; only one text of a class goes on.
2. Slots are joined to bands, classes with an equal band share a bucket.
3. In a bucket, edges form a star: from one member, the leader, to the others, as many edges as members, and each edge is
   confirmed on the full sets. Members that no confirmed link has joined to a leader of the bucket, through whatever
   texts, are loose: one of them, drawn by a hash of bucket and member, is the leader of the next star, which reaches for
   the loose ones. In a bucket of at most SMALL members they are compared with every member instead.
4. The stars only spare work. After STARS of them all members of a larger bucket that are still in different components,
   loose or led, are compared with each other: a bucket is dealt into cells of two blocks of about BLOCK members, and a
   task counts what the sets of a cell have in common on 31-bit folds of their hashes. The count, with what folding may
   have merged added, is no less than the true one, so only pairs that cannot reach the limit are dropped; the others are
   confirmed on the full sets. So every pair over the limit that shares a bucket ends in one component.
5. Components of the confirmed links come from alternating large and small stars (Kiveris et al. 2014).

Every table of a round is written to the shared folder. Nothing is collected but sums.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.flat import expand, join_hash, mix, slices, text_bytes, word_hashes
from evq.session import materialize

_U = np.uint64
SHINGLE = 5
BANDS, ROWS = 90, 7
#: Stars per bucket, the bucket size up to which loose members are compared with all, and the members in a block of a larger one.
STARS, SMALL, BLOCK = 3, 8, 1024


# --- sets and signatures of a batch -----------------------------------------

def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each row; their number per row)."""
    words, counts = word_hashes(data, offsets)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row, at = expand(made)
    first = (np.cumsum(counts) - counts)[row] + at
    width = np.minimum(counts, size)[row]
    hashes = mix(width.astype(_U))
    for k in range(size):
        part = k < width
        hashes[part] = join_hash(hashes[part], words[first[part] + k])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(counts))


@lru_cache(maxsize=100_000)
def _donors(slots: int, attempt: int) -> np.ndarray:
    seed = np.arange(slots, dtype=_U) + (_U(attempt) << _U(32))
    return ((mix(seed) >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64)


def signatures(hashes: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """Rows x slots, for rows with at least one hash (sorted within the row)."""
    row, _ = expand(counts)
    slot = ((hashes >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64)
    cell = row * slots + slot
    least = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # slots are ranges, so the first is the least
    out = np.zeros(len(counts) * slots, _U)
    full = np.zeros(len(counts) * slots, bool)
    out[cell[least]], full[cell[least]] = hashes[least], True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        donor = empty - empty % slots + _donors(slots, attempt)[empty % slots]
        found = full[donor]
        out[empty[found]] = out[donor[found]]
        empty, attempt = empty[~found], attempt + 1
    return out.reshape(-1, slots)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), parts.shape[:2])
    for k in range(rows):
        out = join_hash(out, parts[:, :, k])
    return out.view(np.int64)


# --- on DataFrames ----------------------------------------------------------

def sketch(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n_shingles, digest of the set, bands (none for an empty set)."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets, 2 << 20):
                hashes, counts = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                cuts = np.concatenate([[0], np.cumsum(counts)])
                digests = [hashlib.md5(hashes[a:b].tobytes(), usedforsecurity=False).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                some = np.flatnonzero(counts)
                flat, lengths = [], np.where(counts > 0, bands, 0)
                for a in range(0, len(some), 1000):
                    part = some[a:a + 1000]
                    own = hashes[cuts[part[0]]:cuts[part[-1] + 1]]
                    flat.append(bands_of(signatures(own, counts[part], bands * rows), bands, rows).reshape(-1))
                values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key")[i:j], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["key", "n_shingles", "digest", "bands"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """node, items: the whole set of every row."""
    source = docs.select(F.col(key).alias("node"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets, 2 << 20):
                hashes, counts = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node")[i:j], pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], names=["node", "items"])

    return source.mapInArrow(run, f"node {source.schema['node'].dataType.simpleString()}, items array<long>")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node in the links (a, b)."""
    def least(pairs: DataFrame) -> DataFrame:
        """Every pair with the least neighbour of its first node (the node itself counts)."""
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(low, "u")

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "stars")
        # Done when every node points to one other that points nowhere.
        out = edges.groupBy("u").agg(F.count("*").alias("n"))
        if out.where("n > 1").select("u").union(edges.join(out.select(F.col("u").alias("v")), "v", "left_semi").select("u")).isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets have at least ``percent`` hundredths of their union in common."""
    def side(x: str) -> DataFrame:
        return sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))

    both = edges.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
    total = F.size("items_a") + F.size("items_b") - F.col("common")
    return both.where(100 * F.col("common") >= percent * total).select("a", "b").distinct()


def near_cells(cell: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of block i, of block j) of a cell that are in different components and may reach the limit."""
    side, i, j = (cell.column(c).to_numpy() for c in ("block", "i", "j"))
    component = np.unique(cell.column("component").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    left, right = np.flatnonzero(side == i[0]), np.flatnonzero(side == j[0])
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right) or component.max() == 0:
        return none, none
    n, items = cell.column("n").to_numpy(), cell.column("items").combine_chunks()
    row, _ = expand(np.diff(items.offsets.to_numpy()))
    _, value, times = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
    width = len(times)
    own = np.unique(row * width + value)  # distinct folds of each row
    row, value = own // width, own % width
    merged = n - np.bincount(row, minlength=len(n))
    often = np.bincount(value, minlength=width) > 1
    place = np.cumsum(often) - 1
    row, value = row[often[value]], place[value[often[value]]]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    at = np.zeros((2, len(n)), np.int64) - 1
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(often.sum()), 4096):
        x, y = np.searchsorted(value, [start, start + 4096])
        parts = []
        for k, rows in enumerate((left, right)):
            part = np.zeros((len(rows), 4096), np.float32)
            mine = at[k, row[x:y]] >= 0
            part[at[k, row[x:y][mine]], value[x:y][mine] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    most = common + np.minimum(merged[left][:, None], merged[right][None, :])
    good = (100 + percent) * most >= percent * (n[left][:, None] + n[right][None, :])
    good &= component[left][:, None] != component[right][None, :]
    if i[0] == j[0]:
        good = np.triu(good, 1)
    a, b = np.nonzero(good)
    return left[a], right[b]


def across(known: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) that share a bucket of ``known`` (bucket, node, m, component), are in different components and may reach the limit."""
    mixed = known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    blocks = F.ceil(F.col("m") / block).cast("int")
    rest = known.join(mixed, "bucket", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("bucket", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rest = materialize(rest, "cells")
    folds = sets.join(rest.select("node").distinct(), "node", "left_semi").select(
        "node", F.size("items").alias("n"), F.transform("items", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("items"))

    def run(cell: pa.Table) -> pa.Table:
        x, y = near_cells(cell, percent)
        node = cell.column("node")
        return pa.table([node.take(pa.array(x)), node.take(pa.array(y))], names=["a", "b"])

    kind = known.schema["node"].dataType.simpleString()
    found = rest.join(folds, "node").groupBy("bucket", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, bands: int = BANDS, rows: int = ROWS,
           stars: int = STARS) -> DataFrame:
    """Per row: key, n_shingles, component_id (least key of its group), kept (it is that key).

    A row with a null key is no document that others can point to: its component is null and it is kept. Rows that
    repeat a key count as one document: their texts' links are joined. An empty set is linked with nothing.
    """
    own = materialize(sketch(docs, key, text, bands, rows), "sketch")
    classes = own.where("n_shingles > 0 and key is not null").groupBy("digest").agg(
        F.min("key").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    entries = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("m")).where("m > 1")
    members = materialize(entries.join(shared, "bucket"), "members")
    nodes = members.select("node").distinct()
    sets = materialize(shingle_sets(docs.join(nodes, docs[key] == nodes["node"], "left_semi"), key, text), "sets")

    # Links between texts of one class hold already; rows with one key but different texts start as one component.
    same = own.where("n_shingles > 0 and key is not null").join(classes.select("digest", "node"), "digest")
    many = same.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    links = same.join(many.select("key", "a"), "key").select("a", F.col("node").alias("b")).where("a <> b").distinct()

    def edges(of: DataFrame) -> DataFrame:
        return of.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()

    pairs = materialize(edges(members.where("node <> centre")), "pairs")
    leaders = members.where("node = centre").select("bucket", "node")
    looked_at = pairs
    for turn in range(1, stars + 1):
        links = materialize(links.union(confirmed(pairs, sets, percent)), "links")
        labels = materialize(components(links), "labels")

        def labelled(of: DataFrame, labels=labels) -> DataFrame:
            return of.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

        if turn == stars:
            break

        # Members of a bucket that no confirmed link joins to one of its leaders.
        led = labelled(leaders).select("bucket", "component").distinct()
        known = labelled(members.select("bucket", "node", "n", "m"))
        loose = materialize(known.join(led, ["bucket", "component"], "left_anti"), "loose")
        if loose.isEmpty():
            break
        drawn = loose.groupBy("bucket").agg(F.min_by("node", F.xxhash64("bucket", "node", F.lit(turn))).alias("leader"))
        every = known.where(F.col("m") <= SMALL).join(drawn, "bucket", "left_semi")
        new = loose.where(F.col("m") > SMALL).join(drawn, "bucket").where("node = leader")
        centres = materialize(every.union(new.select(every.columns)), "leaders")
        on = centres.select("bucket", F.col("node").alias("centre"), F.col("n").alias("centre_n"), F.col("component").alias("centre_component"))
        near = loose.join(on, "bucket").where(
            (F.col("component") != F.col("centre_component"))
            & (100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")))
        pairs = materialize(edges(near).join(looked_at, ["a", "b"], "left_anti"), "pairs")
        looked_at, leaders = looked_at.union(pairs), leaders.union(centres.select("bucket", "node"))

    # What the stars left: members of a bucket in different components. Smaller buckets were compared whole.
    rest = labelled(members.select("bucket", "node", "m").where(F.col("m") > (SMALL if stars > 1 else 1)))
    pairs = materialize(across(rest, sets, percent).join(looked_at, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = materialize(links.union(confirmed(pairs, sets, percent)), "links")
        labels = materialize(components(links), "labels")

    named = own.join(classes.select("digest", "node"), "digest", "left").join(labels, "node", "left")
    group = F.when(F.col("key").isNotNull(), F.coalesce("component", "node", "key"))
    return named.select(
        F.col("key").alias(key), "n_shingles", group.alias("component_id"), F.coalesce(F.col("key") == group, F.lit(True)).alias("kept"))
