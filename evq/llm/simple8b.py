"""Token ids in Simple-8b words (Anh and Moffat 2010), written and read as one Spark job each.

A 64-bit word has a selector in its top four bits and holds as many ids as fit in the other 60, each in equal width.
Ids are cut into blocks; every block starts a new word and its first word is in the block's offset table, so all blocks
are coded at once: the encoder walks one word per step in all blocks together, the decoder unpacks all words of one
selector together, and any block can be read alone. Values of more than 60 bits are escapes: 0 in the words, and place
and value in a list.

A table of token files is a Parquet folder with one binary file per row: (shard, part, first, n_ids, data), where
``first`` counts the ids of the shard before the file. Shards are ranges of the key, files in a shard follow each other.
Parquet is the container because every Spark store can hold it and its commit survives lost tasks.
"""

from __future__ import annotations

import struct
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm.flat import slices, text_bytes
from evq.llm.tokens import tokenizer

# Fixed values of the code: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC, VERSION = b"S8B", 1
BLOCK = 512
HEAD = struct.Struct("<3sBIQQQQ")
_U = np.uint64


SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; one more at most for values that a double rounds up."""
    if len(values) and int(values.max()) < len(SHORT):
        return SHORT[values]
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and the end, places of escapes, their values) of unsigned integers."""
    values = np.asarray(ids, dtype=_U).copy()
    n = len(values)
    escaped = np.flatnonzero(values >> _U(60))
    escapes = values[escaped]
    values[escaped] = 0
    blocks = -(-n // block)
    if not blocks:
        return np.zeros(0, _U), np.zeros(1, np.int64), escaped, escapes
    pad = int(COUNTS[0])
    grid = np.zeros((blocks, block + pad), _U)  # zeros behind every block
    whole = np.zeros(blocks * block, _U)
    whole[:n] = values
    grid[:, :block] = whole.reshape(blocks, block)
    width = np.zeros(grid.shape, np.uint8)
    width[:, :block] = widths(whole).reshape(blocks, block)
    # Maximum width over windows of 1, 2, 4, ... ids; a window of any length is two of them.
    spans = [width]
    while 2 ** len(spans) <= pad:
        half, last = 2 ** (len(spans) - 1), spans[-1]
        spans.append(np.maximum(last[:, :-half], last[:, half:]))
    least = [int(x[:, :block].min()) for x in spans]
    chosen = np.full((blocks, block), 15, np.uint8)
    for s in range(14, -1, -1):
        count, k = int(COUNTS[s]), int(COUNTS[s]).bit_length() - 1
        if least[k] <= BITS[s]:
            most = np.maximum(spans[k][:, :block], spans[k][:, count - 2**k:count - 2**k + block])
            np.copyto(chosen, s, where=most <= BITS[s])
    lengths = np.full(blocks, block)
    lengths[-1] = n - (blocks - 1) * block
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    rows, places, selectors = [], [], []
    while len(row):
        s = chosen[row, at]
        rows.append(row)
        places.append(at)
        selectors.append(s)
        at = at + COUNTS[s]
        more = at < lengths[row]
        row, at = row[more], at[more]
    rows, places, selectors = np.concatenate(rows), np.concatenate(places), np.concatenate(selectors)
    order = np.argsort(rows, kind="stable")
    rows, places, selectors = rows[order], places[order], selectors[order]
    words = selectors.astype(_U) << _U(60)
    flat, first = grid.reshape(-1), rows * (block + pad) + places
    for s in range(2, 16):
        here = np.flatnonzero(selectors == s)
        if len(here):
            packed, start = words[here], first[here]
            for k in range(int(COUNTS[s])):
                packed |= flat[start + k] << _U(k * BITS[s])
            words[here] = packed
    return words, np.searchsorted(rows, np.arange(blocks + 1)), escaped, escapes


def decode(words: np.ndarray, starts: np.ndarray, n: int, escaped=(), escapes=(), block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks. One block k alone: ``decode(words[starts[k]:starts[k + 1]], [0], its length)``."""
    out = np.zeros(n, _U)
    if n:
        starts = np.asarray(starts, np.int64)
        selectors = (words >> _U(60)).astype(np.int64)
        before = np.cumsum(COUNTS[selectors]) - COUNTS[selectors]
        blocks = -(-n // block)
        owner = np.searchsorted(starts[:blocks], np.arange(len(words)), side="right") - 1
        place = before - before[starts[owner]] + owner * block
        end = np.minimum((owner + 1) * block, n)
        for s in range(2, 16):
            here = np.flatnonzero(selectors == s)
            mask = _U((1 << int(BITS[s])) - 1)
            for k in range(int(COUNTS[s]) if len(here) else 0):
                here = here[place[here] + k < end[here]]
                out[place[here] + k] = words[here] >> _U(k * BITS[s]) & mask
        out[np.asarray(escaped, np.int64)] = escapes
    return out


def pack(keys: list, ids: list[np.ndarray]) -> bytes:
    """One token file: keys (integers or None), ids per key, words, block offsets and escapes."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    words, starts, escaped, escapes = encode(flat)
    head = HEAD.pack(MAGIC, VERSION, BLOCK, len(keys), len(flat), len(words), len(escaped))
    parts = [np.array([0 if k is None else k for k in keys], "<i8"), np.array([k is None for k in keys], "u1"),
             np.array([len(x) for x in ids], "<u8"), starts.astype("<u8"), words.astype("<u8"), escaped.astype("<u8"), escapes.astype("<u8")]
    return head + b"".join(p.tobytes() for p in parts)


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(keys, number of ids per key, all ids) of a token file."""
    magic, version, block, n_keys, n_ids, n_words, n_escapes = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    at = HEAD.size

    def take(kind, n):
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    keys, null, counts = take("<i8", n_keys), take("u1", n_keys), take("<u8", n_keys).astype(np.int64)
    starts, words = take("<u8", -(-n_ids // block) + 1), take("<u8", n_words)
    escaped, escapes = take("<u8", n_escapes), take("<u8", n_escapes)
    ids = decode(words, starts, n_ids, escaped, escapes, block)
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], counts, ids


FILES = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def write(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
          file_ids: int = 1 << 20) -> None:
    """Encode all whole texts in ascending key order (null keys first) into token files below ``path``.

    A null text is empty and has only the end id. Rows with the same key follow each other in the order of their texts.
    ``key`` must be an integer column. Other columns are not read.
    """
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    source = source.repartitionByRange("key").sortWithinPartitions("key", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        shard, part, first = TaskContext.get().partitionId(), 0, 0
        keys, ids, size = [], [], 0

        def flush():
            data = pack(keys, ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([data], pa.binary())], schema=FILES)

        for batch in batches:
            for i, j in slices(text_bytes(batch.column("text"))[1]):
                keys += batch.column("key")[i:j].to_pylist()
                found, bounds = tokenizer(tokenizer_path).encode_column(batch.column("text")[i:j], end)
                ids += [np.frombuffer(found[a:b], "<u4") for a, b in pairwise(bounds.tolist())]
                size += len(found) // 4
                if size >= file_ids:
                    yield flush()
                    part, first = part + 1, first + size
                    keys, ids, size = [], [], 0
        if keys:
            yield flush()

    source.mapInArrow(run, "shard int, part int, first long, n_ids long, data binary").write.parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per text of the token files: key, start (ids of all texts before it), n_tokens, ids_crc32, and its ids if asked.

    ids_crc32 is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema("shard int, part int, first long, n_ids long, data binary").parquet(path)
    # One row per shard, of which there are as many as the writing job had tasks.
    sizes = sorted(files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before = np.cumsum([0, *(r["n"] for r in sizes)])
    starts = spark.sparkContext.broadcast({r["shard"]: int(b) for r, b in zip(sizes, before, strict=False)})
    names = ["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts, ids = unpack(row["data"])
                ends = np.cumsum(counts)
                plain = ids.astype("<u4")
                crc = [zlib.crc32(plain[a:b].tobytes()) for a, b in zip(ends - counts, ends, strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(starts.value[row["shard"]] + row["first"] + ends - counts, pa.int64()),
                           pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = files.select("shard", "first", "data").mapInArrow(run, schema)
    return found.withColumnRenamed("key", key)
