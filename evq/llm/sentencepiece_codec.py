"""SentencePiece BPE encoding by vectorised merge rounds, and decoding by a byte table.

Symbols of all distinct words of a batch lie in one flat numpy array. A round finds the best pair of every word
(a segmented minimum over rank and place), merges it in all words at once and drops finished words, until no pair
remains. If no piece that contains the merged one ranks before it, the round merges all its occurrences in the word,
leftmost first; otherwise only the leftmost, since the next best pair may then be a new one.

Words are spaces followed by other characters. They are independent of each other as long as no piece has a space after
another character; a model with such pieces is encoded with the whole text as one word.
Models must be BPE with byte fallback, identity normalisation and a dummy prefix; others are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evq.llm.tokens import PieceMemory, texts_of

SPACE = "▁"
RUNS = re.compile(" +[^ ]*")
NONE = np.int64(1) << 30


def _next_byte(error):
    """One replacement character for each byte that is not part of a character."""
    return "�", error.start + 1


codecs.register_error("evq_each_byte", _next_byte)


class Codec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if (train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix or norm.precompiled_charsmap
                or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces):
            raise ValueError("a BPE model with byte fallback, identity normalisation and dummy prefix is needed")
        self.size = len(model.pieces)
        kinds = [p.type for p in model.pieces]
        if 4 in kinds:
            raise ValueError("user-defined symbols are not handled")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if kinds[i] in (1, 5)}
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if kinds[i] == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        # Symbols: ids of pieces, and after them every character that is no piece by itself.
        self.char = np.arange(0x110000, dtype=np.int64) + self.size
        for text, i in normal.items():
            if len(text) == 1:
                self.char[ord(text)] = i
        self.width = np.int64(self.size + 0x110000)
        scores = np.array([p.score for p in model.pieces])
        order, rank = np.unique(-scores, return_inverse=True)
        shared = np.bincount(rank[list(normal.values())], minlength=len(order)) > 1
        alone = ~shared[rank]
        pairs = {}
        for text, i in normal.items():
            for k in range(1, len(text)):
                halves = [normal.get(x, self.char[ord(x)] if len(x) == 1 else None) for x in (text[:k], text[k:])]
                if None in halves:
                    continue
                pairs[int(halves[0]) * int(self.width) + int(halves[1])] = i
                for x in halves:
                    if x < self.size and rank[x] >= rank[i]:
                        alone[x] = False
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.merged = np.append(np.array([pairs[k] for k in keys], dtype=np.int64), 0)
        self.rank, self.alone = rank.astype(np.int64), alone
        self.whole = any(SPACE in p.lstrip(SPACE) for p in normal)
        # Decoding: bytes of every id.
        plain = [b"" if k == 3 else train.unk_surface.encode() if k == 2 else bytes([int(p.piece[1:-1], 16)]) if k == 6
                 else p.piece.replace(SPACE, " ").encode() for p, k in zip(model.pieces, kinds, strict=True)]
        self.bytes_length = np.array(list(map(len, plain)), np.int64)
        self.bytes_start = np.cumsum(self.bytes_length) - self.bytes_length
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.control = np.array([k == 3 for k in kinds])
        self.spaced = np.array([k in (1, 5) and p.piece.startswith(SPACE) for p, k in zip(model.pieces, kinds, strict=True)])
        self.memory = PieceMemory(self._words)

    # --- encoding ---

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; an empty text has none."""
        return self.memory.of([self._split(t) for t in texts])

    def _split(self, text: str) -> list[str]:
        """Words without the space they begin with."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.whole:
            return [text]
        if text[0] == " " or text[-1] == " " or "  " in text:
            return [x[1:] for x in RUNS.findall(f" {text}")]
        return text.split(" ")

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that a pair of symbols makes, or -1."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 100_000):
            out += self._merge(words[i:i + 100_000])
        return out

    def _merge(self, words: list[str]) -> list[bytes]:
        text = [f" {w}".replace(" ", SPACE) for w in words]
        lengths = np.array(list(map(len, text)), np.int64)
        symbols = self.char[np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.arange(len(words))
        starts = np.cumsum(lengths) - lengths
        last = np.zeros(len(symbols), bool)
        last[starts + lengths - 1] = True
        made = np.full(len(symbols), -1, np.int64)
        inner = np.flatnonzero(~last)
        made[inner] = self._pair(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            ranks = np.where(made >= 0, self.rank[made], NONE)
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(ranks)), starts)
            rank, at = best >> 32, best & 0xFFFFFFFF
            over = rank == NONE
            if over.any():  # compaction: finished words leave
                gone = np.repeat(over, lengths)
                done.append((word[over], lengths[over], symbols[gone]))
                move = np.cumsum(~gone) - 1
                symbols, made, last, ranks = symbols[~gone], made[~gone], last[~gone], ranks[~gone]
                word, lengths, rank, at = word[~over], lengths[~over], rank[~over], move[at[~over]]
                if not len(word):
                    break
                starts = np.cumsum(lengths) - lengths
            chosen = np.zeros(len(symbols), bool)
            every = self.alone[made[at]]
            same = (ranks == np.repeat(np.where(every, rank, -1), lengths))
            hits = np.flatnonzero(same)
            if len(hits):  # in a run of overlapping pairs every second one
                head = np.flatnonzero(np.concatenate([[True], np.diff(hits) != 1]))
                place = np.arange(len(hits)) - np.repeat(head, np.diff(head, append=len(hits)))
                chosen[hits[place % 2 == 0]] = True
            chosen[at] = True
            pick = np.flatnonzero(chosen)
            symbols[pick] = made[pick]
            last[pick] = last[pick + 1]
            stay = np.ones(len(symbols), bool)
            stay[pick + 1] = False
            lengths = lengths - np.add.reduceat(chosen, starts, dtype=np.int64)
            starts = np.cumsum(lengths) - lengths
            here = (np.cumsum(stay) - 1)[pick]
            symbols, made, last = symbols[stay], made[stay], last[stay]
            again = np.unique(np.concatenate([here, np.maximum(here - 1, 0)]))
            made[again[last[again]]] = -1
            again = again[~last[again]]
            made[again] = self._pair(symbols[again], symbols[again + 1])
        return self._bytes(len(words), done)

    def _bytes(self, n: int, done: list) -> list[bytes]:
        """Ids of the words in their order; characters that are no piece become their bytes."""
        if not done:
            return []
        word, lengths, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        owner = np.repeat(np.arange(len(word)), lengths)
        loose = np.flatnonzero(symbols >= self.size)
        if len(loose):
            chars, which = np.unique(symbols[loose] - self.size, return_inverse=True)
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in chars]
            wide = np.ones(len(symbols), np.int64)
            wide[loose] = np.array(list(map(len, spelled)))[which]
            first = np.cumsum(wide) - wide
            ids = np.repeat(symbols, wide)
            for k in range(4):
                more = np.array([self.byte_id[s[k]] if len(s) > k else -1 for s in spelled])[which]
                ids[first[loose][more >= 0] + k] = more[more >= 0]
            symbols, owner = ids, np.repeat(owner, wide)
        cuts = np.searchsorted(owner, np.arange(len(word) + 1)) * 4
        data = symbols.astype("<u4").tobytes()
        out = [b""] * n
        for w, a, b in zip(word.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[w] = data[a:b]
        return out

    # --- decoding ---

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of id sequences; an id outside the model raises an IndexError."""
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        if len(flat) == 0:
            return [""] * len(ids)
        wide = self.bytes_length[flat]
        ends = np.cumsum(wide)
        data = self.bytes[np.repeat(self.bytes_start[flat] - (ends - wide), wide) + np.arange(ends[-1])].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        first = np.cumsum(counts) - counts
        out = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            own = flat[first[k]:first[k] + counts[k]]
            heads = own[:1] if len(own) and not self.control[own[0]] else own[~self.control[own]][:1]
            skip = len(heads) and self.spaced[heads[0]]  # the dummy prefix
            out.append(data[a + bool(skip):b].decode("utf-8", "evq_each_byte"))
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process and file."""
    return Codec(path)


# --- on DataFrames ----------------------------------------------------------

def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text in the array<int> column ``into``; a null text is empty.

    An existing column named ``into`` is replaced. Rows are independent: repeated rows give repeated rows.
    """
    def work(batch):
        ids = [x for _, _, texts in texts_of(batch, "__text") for x in codec(path).encode(texts)]
        sizes = np.cumsum([0, *(len(x) // 4 for x in ids)])
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))

    return _with(docs, F.col(text).cast("string"), "__text", into, "array<int>", work)


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``docs`` with the text of the array<int> column ``ids`` in ``into``; a null array is empty, null ids are skipped."""
    def work(batch):
        rows = [np.array([i for i in x or [] if i is not None], "<u4").tobytes() for x in batch.column("__ids").to_pylist()]
        return pa.array(codec(path).decode(rows), pa.string())

    return _with(docs, F.col(ids), "__ids", into, "string", work)


def _with(docs: DataFrame, source, name: str, into: str, kind: str, work) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name != into]
    frame = docs.select(*(F.col(f"`{f.name}`") for f in kept), source.alias(name))

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, work(batch)], names=[*(f.name for f in kept), into])

    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.IntegerType()) if kind == "array<int>" else T.StringType())])
    return frame.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_tokens, and SHA-256 of the decimal ids (joined by commas) and of the text decoded from them."""
    def run(batches):
        coder = codec(path)
        for batch in batches:
            for i, j, texts in texts_of(batch, "text"):
                ids = coder.encode(texts)
                plain = [",".join(map(str, np.frombuffer(x, "<u4").tolist())).encode() for x in ids]
                back = coder.decode(ids)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key")[i:j], pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in plain]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    found = source.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("key", key)
