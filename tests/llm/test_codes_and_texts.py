"""Packing, codecs, secrets, licenses, preferences and the pipeline: against brute force, libraries and round trips."""

import base64
import hashlib
import json
import random
import re
import zlib
from bisect import bisect_left

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF_DIR
from test_models_and_rules import COLUMNS, components, frame, shingle_set

import corpus_pipeline
from __spark_entry__ import queries
from evq.llm import licenses, packing, preferences, quality, secrets, sentencepiece_codec, simple8b
from evq.llm import queries as llm_queries
from evq.llm.tokens import PieceMemory, Tokenizer, tokenizer

ODD = ["", " ", "  a", "a  ", "a   b", "▁x ▁", "日本語 漢字", "é́ ñ", "\n\n", "\0 a", "😀😀 x", "a" * 3000, "=" * 999, "<s> </s> <unk> <0x0A>",
       "\tx \n y", "abab" * 50, "ſK", "it's don't WE'LL 'tis x's.", "a b c", "x 　 y", "́ a", "<|endoftext|> a<|startoftext|>",
       "word, word. word.\nWord word", "a,b, .c, d. 1, 2.", "a \n" * 40]
DOCUMENTS = [(None, "null key", "s"), (3, None, "s"), (1, "b b", "s"), (1, "a a", "t"), (1, "a a", "s"), *((10 + i, t, "s") for i, t in enumerate(ODD))]


def odd_texts(n=600):
    rnd = random.Random(1)
    letters = "ab \n.,é日́'st▁😀\x1c\x85 1×"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def backend(name):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return found


def ids_of(name, text):
    return [*backend_of[name].encode(text or "", add_special_tokens=False).ids, 0]


backend_of = {n: backend(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("name", sorted(backend_of))
def test_pieces_between_spaces_give_the_ids_of_the_text(name):
    texts = odd_texts(4000)
    got = tokenizer(public_tokenizers.path(name)).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert [*np.frombuffer(ids, "<u4").tolist(), 0] == ids_of(name, text), text


def test_the_memory_of_pieces_is_bounded_and_keeps_frequent_ones():
    asked = []

    def encode(new):
        asked.extend(new)
        return [x.encode() for x in new]

    memory = PieceMemory(encode, kept=50)
    for k in range(40):
        text = ["often", *(f"{k}-{i}" for i in range(20))]
        assert memory.of([text, text[::-1]]) == ["".join(text).encode(), "".join(text[::-1]).encode()]
        assert len(memory.known) <= 50
    assert asked.count("often") == 1
    many = [f"x{i}" for i in range(80)]
    assert memory.of([many]) == ["".join(many).encode()]
    assert len(memory.known) <= 50


@pytest.mark.parametrize("name", sorted(backend_of))
def test_ids_do_not_depend_on_what_is_kept(name):
    texts, small = odd_texts(2000), Tokenizer(public_tokenizers.path(name), kept=100)
    got = []
    for i in range(0, len(texts), 50):
        got += small.encode(texts[i:i + 50])
        assert max(len(small.heads.known), len(small.rest.known)) <= 100
    assert got == tokenizer(public_tokenizers.path(name)).encode(texts)


@pytest.mark.parametrize("name", sorted(backend_of))
def test_pieces_between_any_blanks_and_signs_give_the_ids_of_the_text(name):
    blanks = [" ", "\n", "\r", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000", " \n", "\n\n", "  "]
    parts = ["a", "É", "İ", "×", "÷", "ß", "don't", "'s", "'", ",", ".", "...", "###", "“", "”", "日本", "\u0301", "12", "x_y", "<", "\u0338"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(parts) + rng.choice(blanks + ["", " "] * 6) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += ["İ.", "x İ, y", "a\n", "\na", " a ", "a\nb\nc"]
    column = pa.array([None, *texts, ""])[1:]
    data, bounds = Tokenizer(public_tokenizers.path(name), kept=200).encode_column(column, end=bytes(4))
    for text, a, b in zip(column.to_pylist(), bounds[:-1], bounds[1:], strict=True):
        assert np.frombuffer(data[a:b], "<u4").tolist() == ids_of(name, text), text


def test_words_that_end_in_signs_or_lines_share_their_entry():
    asked = []
    encoder = Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    plain = encoder.rest.encode
    encoder.rest.encode = lambda new: asked.extend(new) or plain(new)
    encoder.encode([f"x word{sign} word" for sign in ("", ",", ".", "!", "###", ").", ".\nThen")])
    assert sorted(asked) == ["\nThen", " word"]


def test_packing_remembers_few_words_where_it_is_asked_to(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(odd_texts(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    path = public_tokenizers.path("word_bpe_49k.json")
    few, plain = (packing.pack_documents(docs, path, capacity=64, **x).select(columns).sort(columns).collect() for x in ({"kept": 5}, {}))
    assert few == plain
    asked = {}
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **b: asked.update(b))
    corpus_pipeline.best_fit_packing(spark, docs, None)
    assert asked["kept"] <= 200_000


def test_token_files_of_the_word_file_hold_the_ids_of_the_library(spark, tmp_path):
    name, texts = "word_bpe_49k.json", ["x İ.", "İ, a", "word. word!\nWord", "", "a\u2003b c\u3000d"]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    simple8b.write(docs, str(tmp_path / "files"), public_tokenizers.path(name))
    got = {r["doc_id"]: r["ids"] for r in simple8b.read(spark, str(tmp_path / "files"), with_ids=True).collect()}
    assert got == {k: ids_of(name, t) for k, t in enumerate([*texts, None])}


# --- SentencePiece ----------------------------------------------------------

def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, codec, texts = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path), odd_texts(3000)
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library.encode(texts)
    assert codec.decode(got) == [library.decode(x) for x in library.encode(texts)]
    rnd = random.Random(2)
    loose = [[rnd.randrange(0, 400) for _ in range(rnd.randint(0, 12))] for _ in range(2000)]
    assert codec.decode([np.array(x, "<u4").tobytes() for x in loose]) == [library.decode(x) for x in loose]

    docs = frame(spark, DOCUMENTS)
    for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path, into="key"), path, ids="key", into="kept").collect():
        assert r["key"] == library.encode(r["text"] or "")
        assert r["kept"] == library.decode(r["key"])
    for r in sentencepiece_codec.round_trip(docs.where("doc_id > 5"), path).collect():
        ids = library.encode(ODD[r["doc_id"] - 10])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.round_trip(frame(spark, []), path).count() == 0


# --- Simple-8b --------------------------------------------------------------

def test_simple8b_round_trip_at_every_width():
    rng = np.random.default_rng(1)
    for trial in range(260):
        n, bits = int(rng.integers(0, 3000)), trial % 65
        values = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) >> np.uint64(64 - max(bits, 1))
        values = values * np.uint64(bits > 0)
        if trial % 3 == 0:
            values[rng.random(n) < 0.8] = 0
        words, starts, escaped, escapes = simple8b.encode(values)
        assert (simple8b.decode(words, starts, n, escaped, escapes) == values).all()
        assert (len(escaped) > 0) <= (bits > 60)
        if n > 1024 and not len(escaped):
            assert (simple8b.decode(words[starts[1]:starts[2]], [0], 512) == values[512:1024]).all()
    assert len(simple8b.encode(np.zeros(480, np.uint64))[0]) == 2


def test_token_files(spark, tmp_path):
    path, name = f"file://{tmp_path}/files", "byte_bpe_50k.json"
    simple8b.write(frame(spark, DOCUMENTS), path, public_tokenizers.path(name), file_ids=500)
    got = sorted(simple8b.read(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    order = sorted(DOCUMENTS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    assert [r["doc_id"] for r in got] == [d[0] for d in order]
    start = 0
    for r, (_, text, _) in zip(got, order, strict=True):
        ids = ids_of(name, text)
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    simple8b.write(frame(spark, []), f"{path}-none", public_tokenizers.path(name))
    assert simple8b.read(spark, f"{path}-none").count() == 0
    with pytest.raises(ValueError, match="not a token file"):
        simple8b.unpack(bytes(100))


# --- packing ----------------------------------------------------------------

def laid_out(plan, counts):
    """Contents of the sequences of a plan; checks that every piece is placed once and without gaps."""
    fill, seen = {}, {}
    for length, first, each, bins, sequence, offset in sorted(plan.runs):
        assert seen.get(length, 0) == first
        seen[length] = first + each * bins
        for b in range(bins):
            fill.setdefault(sequence + b, []).extend((offset + k * length, length) for k in range(each))
    assert all(seen.get(n, 0) == c for n, c in enumerate(counts))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= plan.capacity
    assert len(fill) == plan.sequences
    return fill


def fewest(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1:]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum_and_best_fit_is_near():
    rng = np.random.default_rng(0)
    extra = 0
    for _ in range(250):
        capacity = int(rng.integers(5, 30))
        items = sorted(rng.integers(1, capacity + 1, rng.integers(0, 10)).tolist(), reverse=True)
        counts = np.bincount(np.array(items, int), minlength=capacity + 1)
        best = fewest(items, capacity)
        part = packing.Plan(counts)
        packing.reduce(part)
        left = [n for n in range(capacity, 0, -1) for _ in range(int(part.left[n]))]
        assert part.sequences + fewest(left, capacity) == best
        plan = packing.plan_for(counts)
        laid_out(plan, counts)
        extra += plan.sequences - best
    assert extra <= 5
    counts = np.bincount(np.clip(rng.lognormal(6.3, 1, 30000).astype(int), 1, 2048), minlength=2049)
    plan = packing.plan_for(counts)
    laid_out(plan, counts)
    assert plan.sequences <= 1.002 * -(-int(counts @ np.arange(2049)) // 2048)
    assert plan.fixed > 0.3 * plan.sequences


def test_packed_documents(spark):
    name, rows = "word_bpe_49k.json", [*DOCUMENTS, (90, "long words " * 400, "s"), (91, "long words " * 400, "s")]
    packed = packing.pack_documents(frame(spark, rows), public_tokenizers.path(name), capacity=64, with_ids=True)
    got = packed.collect()
    by_doc = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["piece"], r["ids"]))
    for key, pieces in by_doc.items():
        whole = sorted(ids_of(name, t) for k, t, _ in rows if k == key)
        if len(whole) == 1:
            pieces.sort()
            assert [p[1] for p in pieces] == list(range(len(pieces)))
            assert sum((p[2] for p in pieces), []) == whole[0]
            assert all(len(p[2]) == 64 for p in pieces[:-1])
        else:
            assert sorted(p[2] for p in pieces) == whole
    assert set(by_doc) == {k for k, _, _ in rows}
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in got:
        assert made[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, made.values())) == sum(r["length"] for r in got)
    assert len(made) == -(-sum(map(len, made.values())) // 64)
    assert packing.pack_documents(frame(spark, []), public_tokenizers.path(name)).count() == 0


# --- secrets ----------------------------------------------------------------

def tlv(tag, *parts):
    data = b"".join(parts)
    n = len(data)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2)) + data


RSA = tlv(0x30, tlv(2, b"\0"), *(tlv(2, bytes([i + 1]) * 40) for i in range(8)))
PKCS8 = tlv(0x30, tlv(2, b"\0"), tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), b"\x05\0"), tlv(4, RSA))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4) + x for x in (b"none", b"none", b"")) + (1).to_bytes(4) + b"".join(
    len(x).to_bytes(4) + x for x in (b"public" * 5, b"private" * 9))


def b64(data):
    return base64.b64encode(data).decode()


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


JWT = f"{url64(json.dumps({'alg': 'HS256'}).encode())}.{url64(json.dumps({'sub': '1'}).encode())}.c2lnbmF0dXJl"
CASES = [
    ("key in text " + b64(PKCS8) + " end", ["key"]), (b64(RSA), ["key"]), (RSA.hex(), ["hex", "key"]), (b64(SSH), ["key"]),
    (b64(RSA[:-3]), []), (b64(RSA + b"x"), []), (b64(bytes(range(200))), []), (f"see {JWT}, ok", ["jwt"]),
    (url64(b'{"typ": 1}') + "." + url64(b'{"a": 1}') + ".abc", []), ("file.name.with-dots.and.more-dots-here-and-there", []),
    ("-----BEGIN PRIVATE KEY-----\n" + b64(PKCS8)[:64] + "\n" + b64(PKCS8)[64:] + "\n-----END PRIVATE KEY-----", ["pem"]),
    ("-----BEGIN PRIVATE KEY-----\nbm90IGEga2V5\n-----END PRIVATE KEY-----", []),
    ("api_key = 'abcdef'", ["assign"]), ("password: abc", []), ("AKIA" + "Z" * 16, ["access"]), ("AKIA" + "Z" * 15, []), ("f" * 24, ["hex"]), ("f" * 23, []),
]


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_structures_are_confirmed_before_they_are_reported(text, kinds):
    assert [secrets.KINDS[k] for _, k, _ in secrets.spans(text)] == kinds


LEGACY = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n" + b64(bytes(range(96)))


@pytest.mark.parametrize(("kind", "body"), [
    ("RSA PRIVATE KEY", f"\n{LEGACY}\n"), ("RSA PRIVATE KEY", f"\n{LEGACY}\n\n".replace("\n", "\r\n")), ("RSA PRIVATE KEY", f"\n{LEGACY}\n".replace("\n", "\\n")),
    ("PRIVATE KEY", f"\\n{b64(PKCS8)[:64]}\\n{b64(PKCS8)[64:]}\\n"), ("PRIVATE KEY", f"\\r\\n{b64(PKCS8)}\\r\\n".replace("/", "\\/")),
    ("PRIVATE KEY", "\n" + "\n".join(b64(PKCS8)[i:i + 16] for i in range(0, len(b64(PKCS8)), 16)) + "\n")])
def test_key_blocks_with_headers_and_escaped_line_breaks(kind, body):
    block = f"-----BEGIN {kind}-----{body}-----END {kind}-----"
    text = f"-----BEGIN {kind}----- cut, {{{block}}}"
    start = text.index(block)
    assert [s for s in secrets.spans(text) if s[1] >= 3] == [(start, 4, start + len(block))]


def test_short_tokens_are_not_gated():
    text = f"{url64(b'{"alg":"none"}')}.{url64(b'{"a":1}')}."
    assert max(map(len, text.split("."))) == 19 and secrets.spans(text) == [(0, 3, len(text))]


def base_spans(text):
    """The base kinds as defined: leftmost matches, failing ones dropped."""
    rules = [(re.compile(r"""(?i:([Pp]assword|passwd|[s]ecret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
             (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    return sorted((m.start(), k, m.end()) for k, (rule, good) in enumerate(rules) for m in rule.finditer(text) if good(m))


def test_base_spans_equal_plain_patterns(spark):
    rnd = random.Random(3)
    parts = ["password", "Token", "ſecret", "SECRET", "apikey", "api_key", "api-toKen", "=", ":", " ", '"', "'", "abc", "0123456789abcdef0123456789", "AKIA",
             "ABCDEFGHIJKLMNOP", "é", "\n", "x.y", "😀"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(4000)]
    for text in texts:
        assert [s for s in secrets.spans(text) if s[1] < 3] == base_spans(text), text
    rows = [*DOCUMENTS, (500, f"😀 token = {'a' * 9} {JWT}", "s"), (501, "x " * 100000 + "f" * 30, "s")]
    got = {r["doc_id"]: r["spans"] for r in secrets.find(frame(spark, rows)).collect()}
    assert [(s["kind"], s["start"]) for s in got[500]] == [("assign", 2), ("jwt", 20)]
    assert (got[501][0]["start"], got[3], got[10]) == (200000, [], [])
    clean = secrets.redact(frame(spark, rows))
    assert clean.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert (text[500], text[3], text[None]) == ("😀 [secret] [secret]", None, "null key")
    assert secrets.find(frame(spark, [])).count() == secrets.redact(frame(spark, [])).count() == 0


# --- licenses ---------------------------------------------------------------

def test_increasing_is_longest():
    rnd = random.Random(4)
    for _ in range(300):
        values = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 9))]
        got = [values[i] for i in licenses.increasing(values)]
        assert all(a < b for a, b in zip(got, got[1:], strict=False))
        tails = []
        for v in values:
            k = bisect_left(tails, v)
            tails[k:k + 1] = [v]
        assert len(got) == len(tails)


def test_licenses_are_found_whole_and_changed(spark):
    known = licenses._templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        body = f"some words before.\n{text.upper()}\nand after it"
        assert [(m[2], m[4]) for m in licenses.matches(body, known)] == [(name, 1.0)], name
        assert [m[2] for m in licenses.matches(f"{text} {text}\n{text}", known)] == [name] * 3, name
    changed = licenses.TEMPLATES["MIT-notice"].replace("restriction", "any limit").replace("to deal in", "to really deal in")
    (found,) = licenses.matches(f"é {changed} x", known)
    assert found[2] == "MIT-notice" and 0.9 < found[4] < 1
    assert licenses.matches("the license of this car and the public version of it", known) == []
    pairs = licenses.align("a x b c y d".split(), "x b q c d".split())
    assert pairs == [(1, 0), (2, 1), (3, 3), (5, 4)]
    rows = [*DOCUMENTS, (700, "w " * 50000 + licenses.TEMPLATES["GPL-3.0"] + " w" * 50000, "s")]
    (row,) = licenses.find(frame(spark, rows)).collect()
    assert (row["doc_id"], row["license"], row["start"], row["coverage"]) == (700, "GPL-3.0", 100000, 1.0)
    assert licenses.find(frame(spark, [])).count() == 0


def test_windows_open_from_any_part_of_a_template():
    known = licenses._templates(licenses.TEMPLATES)
    mit, bsd = licenses.TEMPLATES["MIT-notice"], licenses.TEMPLATES["BSD-3-Clause"]
    inserted = mit.replace("including", "x " * 40 + "including")
    for name, text in (("MIT-notice", mit.replace("Permission is", "Permissions are")), ("MIT-notice", mit.partition(" ")[2]), ("MIT-notice", inserted),
                       ("BSD-3-Clause", bsd.replace("permitted", "per mitted")), ("GPL-3.0", licenses.TEMPLATES["GPL-3.0"].replace("licens", "licenc").replace("Licens", "Licenc"))):
        (found,) = licenses.matches(f"the words of the software before. {text} and of it after", known)
        assert found[2] == name and found[4] >= 0.8, text


# --- preferences ------------------------------------------------------------

def test_pairs_share_the_longest_prefix(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "yes", 9), (1, 2, None, None, 9), (2, 1, "assistant", "no", 9), (2, 0, "user", "hi", 9),
            (3, 0, "user", "hi", 9), (None, 0, "user", "x", 9), (4, 0, "user", "é" * 100000, 9), (4, 0, "user", "é" * 100000, 9)]
    own = preferences.conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, prompt int"))
    turns = {r["conv_id"]: r["turns"] for r in own.collect()}
    assert len(turns[4]) == 2
    schema = "pair_id long, chosen_turns array<struct<role:string,text:string>>, rejected_turns array<struct<role:string,text:string>>, prompt int"
    pairs = spark.createDataFrame([(1, turns[1], turns[2], 0), (2, turns[1], turns[1], 0), (3, turns[3], turns[1], 0), (4, None, turns[2], 0),
                                   (5, [], [], 0), (None, turns[1], turns[2], 0), (6, turns[4], turns[3], 0)], schema)
    got = {r["pair_id"]: r for r in preferences.format_pairs(pairs).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[1]["chosen"] == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"
    assert [(m["length"], m["trained"]) for m in got[1]["chosen_mask"]] == [(22, False), (14, True), (20, False), (11, False)]
    assert sum(m["length"] for m in got[1]["rejected_mask"]) == len(got[1]["rejected"])
    assert [got[i]["n_prompt_turns"] for i in (1, 2, 3, 4, 5, 6)] == [1, 3, 1, 0, 0, 0]
    assert [got[i]["usable"] for i in (1, 2, 3, 4, 5, 6)] == [True, False, False, False, False, False]
    assert preferences.format_pairs(pairs.limit(0)).count() == 0


# --- pipeline ---------------------------------------------------------------

def test_stages_do_what_their_operators_say(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scans", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    secret = " ".join(f"word{i}" for i in range(20)) + f" token = {'a1' * 20} and {JWT}"
    docs = docs.union(spark.createDataFrame([(10**6, secret, "en", "src0", len(secret))], docs.schema))
    before, columns = {r["doc_id"]: r for r in docs.collect()}, docs.columns
    kept = {r["doc_id"] for r in quality.judge(docs).where("__q_kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name == "quality_rules":
            assert 0 < len(rows) < len(before)
            assert {r["doc_id"] for r in rows} == kept
            groups = components({r["doc_id"]: shingle_set(r["text"]) for r in rows})
        elif name == "near_dedup":
            assert {r["doc_id"] for r in rows} == set(groups.values())
            assert len(rows) < len(groups)
        elif name == "secret_scans":
            found = {i for i in set(groups.values()) if secrets.spans(before[i]["text"])}
            assert found
            for r in rows:
                assert (r["text"] != before[r["doc_id"]]["text"]) == (r["doc_id"] in found)
                assert not secrets.spans(r["text"])
                assert r["n_chars"] == len(r["text"])
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert docs.dtypes == spark.read.parquet(f"{SF_DIR}/documents.parquet").dtypes
            texts = {r["doc_id"]: r["text"] for r in rows}
    assert {r["doc_id"] for r in rows} == set(texts)
    assert sum(r["length"] for r in rows) == sum(len(ids_of("word_bpe_49k.json", t)) for t in texts.values())
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(rows) - 1  # without the added document


def test_pipeline_edges(spark):
    rows = [(None, "null key " * 9, "s"), (1, None, "s"), (2, "", None), (3, "w " * 30, None)] + [(10 + i, " ".join(f"w{k}" for k in range(30)), "s") for i in range(4)]
    for kept in (rows, []):
        docs = frame(spark, kept)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
        assert docs.count() == (1 if kept else 0)


def test_queries_are_registered():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == list(range(1, 11))
    assert "pipeline" in queries()


def test_conversations_without_a_neighbour_stay(spark, tmp_path):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (6, 0, "user", "alone"), (6, 1, "assistant", "c")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made = {r["pair_id"]: r for r in llm_queries.QUERIES["op8_preference_formatting"](spark, str(tmp_path)).collect()}
    assert sorted(made) == [0, 1, 6]
    assert [made[i]["usable"] for i in (0, 1, 6)] == [True, True, False]
    assert made[6]["n_prompt_turns"] == 1 and made[6]["rejected_mask"] == ""
