"""Packing of tokenised documents into sequences of bounded length: dominance reduction, then best fit.

Bins only differ by the lengths in them, so the plan is made on the histogram of lengths, which has at most
``capacity`` entries whatever the number of documents, and is applied to the pieces as a Spark job.

- Dominance reduction (Martello and Toth 1990): a set of pieces that contains x dominates another one with x if the
  other's remaining pieces fit into the first one's pieces. {x, y} with y = capacity - x dominates every set with x, and
  so does {x, y} with the longest y that fits when no two pieces fit beside x, and {x} when none does. Such sets are
  fixed for all copies at once, which shrinks the instance and can make further sets dominate.
- The remaining pieces, longest first, go where the least room is left that still holds them.

Defined results: an empty table gives no rows; a piece longer than the capacity is an error; a null text is a document
with only its end id; repeated rows are packed once each; equal lengths are interchangeable and placed in scan order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evq.llm.flat import slices, text_bytes
from evq.llm.tokens import KEPT, tokenizer
from evq.session import materialize

PIECES = "part int, place long, doc_id {key}, piece int, start long, length long, ids_crc32 long"
#: Bytes of text that a worker cuts into words at once.
SLICE = 4 << 20


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, key: str = "doc_id", text: str = "text", end_id: int = 0,
           with_ids: bool = False, kept: int = KEPT) -> DataFrame:
    """The pieces of every document: its ids and one end id, cut only where it is longer than ``capacity``.

    ``part`` is the task and ``place`` the number of equally long pieces before it in that task: together with the
    length they number the pieces, so the table must be written before it is used twice. A worker remembers the ids of
    ``kept`` words at most, which decides its memory and not its results.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["part", "place", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        part, met = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for i, j in slices(text_bytes(batch.column("text"))[1], SLICE):
                rows, owner = [], []
                ids, bounds = tokenizer(tokenizer_path, kept).encode_column(batch.column("text")[i:j], end)
                for k, (first, last) in enumerate(pairwise(bounds.tolist())):
                    for number, a in enumerate(range(first, last, 4 * capacity)):
                        piece = ids[a:min(a + 4 * capacity, last)]
                        n = len(piece) // 4
                        rows.append((met[n], number, (a - first) // 4, n, zlib.crc32(piece), piece))
                        owner.append(k)
                        met[n] += 1
                place, number, start, length, crc, data = zip(*rows, strict=True)
                columns = [pa.array([part] * len(rows), pa.int32()), pa.array(place, pa.int64()),
                           batch.column("key")[i:j].take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in data], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, PIECES.format(key=kind) + ", ids array<int>" * with_ids)


# --- the plan ---------------------------------------------------------------

class Plan:
    """Where the pieces of each length go, as runs over their numbers.

    A run puts pieces ``first .. first + bins * each - 1`` of a length into ``bins`` sequences from ``sequence`` on,
    ``each`` per sequence, at ``offset`` and the places after it.
    """

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64)
        self.used = np.zeros_like(self.left)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.fixed = 0

    def put(self, length: int, bins: int, each: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), each, bins, sequence, offset))
        self.used[length] += bins * each
        self.left[length] -= bins * each

    def fix(self, lengths: tuple[int, ...], bins: int) -> None:
        """``bins`` sequences with these pieces and no others."""
        offset = 0
        for n in lengths:
            self.put(n, bins, 1, self.sequences, offset)
            offset += n
        self.sequences += bins
        self.fixed += bins


def reduce(plan: Plan) -> None:
    """Fix sets that dominate all others with one of their pieces, until none is left."""
    left, capacity, changed = plan.left, plan.capacity, True

    def smallest(besides: int) -> list[int]:
        """Lengths of the two shortest pieces without one of length ``besides``."""
        out: list[int] = []
        for n in np.flatnonzero(left)[:3].tolist():
            out += [n] * min(2, int(left[n]) - (n == besides))
        return out[:2]

    while changed:
        changed = False
        for x in np.flatnonzero(left)[::-1].tolist():
            while left[x]:
                room = capacity - x
                two = smallest(x)
                if not two or two[0] > room:
                    plan.fix((x,), int(left[x]) if x > room else 1)
                elif left[room] - (room == x) > 0:
                    plan.fix((x, room), int(left[x]) // 2 if room == x else int(min(left[x], left[room])))
                elif len(two) < 2 or sum(two) > room:
                    fits = np.flatnonzero(left[:room + 1])
                    mate = int(fits[fits != x][-1]) if left[x] < 2 or x > room else int(fits[-1])
                    plan.fix((x, mate), 1 if mate == x else int(min(left[x], left[mate])))
                else:
                    break
                changed = True


def best_fit(plan: Plan) -> None:
    """Longest first, into the open sequence with the least sufficient room; equal pieces of a step go in together."""
    capacity = plan.capacity
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, number)
    some = np.zeros(capacity + 1, bool)

    def keep(room: int, first: int, bins: int) -> None:
        if bins and room:
            open_[room].append((first, bins))
            some[room] = True

    for x in np.flatnonzero(plan.left)[::-1].tolist():
        while n := int(plan.left[x]):
            room = x + int(np.argmax(some[x:])) if some[x:].any() else capacity
            fresh = not some[room]
            each = room // x
            if fresh:
                first, bins = plan.sequences, -(-n // each)
                plan.sequences += bins
            else:
                first, bins = open_[room].pop()
                some[room] = bool(open_[room])
            full = min(bins, n // each)
            if full:
                plan.put(x, full, each, first, capacity - room)
                keep(room - each * x, first, full)
            rest = n - full * each if full < bins else 0
            if rest:
                plan.put(x, 1, rest, first + full, capacity - room)
                keep(room - rest * x, first + full, 1)
            if not fresh:
                keep(room, first + full + (rest > 0), bins - full - (rest > 0))


def plan_for(counts: np.ndarray) -> Plan:
    """The plan for ``counts[length]`` pieces of each length; the capacity is the largest index."""
    plan = Plan(counts)
    reduce(plan)
    best_fit(plan)
    return plan


# --- on DataFrames ----------------------------------------------------------

def pack(made: DataFrame, capacity: int) -> DataFrame:
    """``made`` (pieces as written by ``pieces``) with sequence_id and offset instead of part and place."""
    sums = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if sums and not 0 < min(sums) <= max(sums) <= capacity:
        raise ValueError(f"pieces must have 1 to {capacity} ids")
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in sums.items():
        counts[n] = k
    runs = np.array(plan_for(counts).runs, np.int64).reshape(-1, 6)
    runs = made.sparkSession.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])  # a few runs per length

    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = made.join(before, ["part", "length"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("place")).drop("part", "place", "before")
    names = [c for c in numbered.columns if c != "number"]

    def run(batches):
        table = runs.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            r = table[np.searchsorted(keys, length << 44 | number, side="right") - 1]
            at, each = number - r[:, 1], r[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(r[:, 4] + at // each), pa.array(r[:, 5] + at % each * length)],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name != "number")
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text",
                   end_id: int = 0, with_ids: bool = False, kept: int = KEPT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    made = materialize(pieces(docs, tokenizer_path, capacity, key, text, end_id, with_ids, kept), "pieces")
    return pack(made, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The id sequences themselves, from a packing with ids: sequence_id, ids. A group holds ``capacity`` ids at most."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("x")).select("sequence_id", F.flatten("x.ids").alias("ids"))
