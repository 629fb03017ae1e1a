"""Byte-level BPE against the tiktoken library, and edits of stored tables against encoding anew."""

import hashlib
import random
import sys
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.queries import op11_byte_bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
KNOWN = bpe.Vocabulary.read(PATH)
PIECES = bpe.PieceIds(KNOWN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=KNOWN.ranks, special_tokens={})
ODD = ["'s", "'ll", "'", "  ", " ", "\n", "\t \n", "\x1c", "\x85", " ", "é", "é", "漢字", "😀", "12", "1", "<|endoftext|>", "hello", "Hello", " world", "aaaa", "ᛔ", "Ᲊ", "\x00"]
TEXTS = st.lists(st.sampled_from(ODD) | st.text(max_size=8), max_size=14).map("".join)


def ids(text):
    return np.frombuffer(b"".join(map(PIECES.__getitem__, bpe.split(text))), "<u4").tolist()


def table(text):
    last = array("i")
    for piece in bpe.split(text):
        last.extend(KNOWN.last_tokens(piece.encode()))
    return np.array(last, np.int32)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_every_character_is_split_as_the_library_does():
    """Characters after a letter, a number and spaces, each at the end of one text: equal ids only if equal pieces."""
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for before in ("a", "1", " "):
        ranks = {bytes([i]): i for i in range(256)}
        for c in points:
            ranks.setdefault((before + c).encode(), len(ranks))
        whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for i in range(0, len(points), 50_000):
            for c in points[i : i + 50_000 : 7]:
                assert (len(whole.encode_ordinary(before + c)) == 1) == (bpe._any_text().findall(before + c) == [before + c])


def test_every_letter_and_number_is_the_librarys():
    points = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x1C80, 0x1C90)] + [chr(c) for c in range(0xA7C0, 0xA7E0)] + [chr(c) for c in range(0x10D40, 0x10D90)] + [chr(c) for c in range(0x11380, 0x113E0)]
    for c in points:
        assert ids(f"a{c}1{c} {c}") == LIBRARY.encode_ordinary(f"a{c}1{c} {c}")


def test_long_pieces_without_any_place_to_split():
    rng = random.Random(5)
    for text in ("a" * 30_000, " " * 20_000 + "x", "".join(rng.choice("acgt") for _ in range(40_000)), "ab" * 9_000 + "!" * 5000):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_tokens_that_merging_does_not_reach():
    """A piece that is a token is that token, though merging gives others; inside longer pieces merging rules."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"abcd": 259, b"cd": 260}
    odd, library = bpe.Vocabulary(ranks), tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = bpe.PieceIds(odd)
    rng = random.Random(2)
    for _ in range(600):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(12)))
        assert np.frombuffer(b"".join(map(pieces.__getitem__, bpe.split(text))), "<u4").tolist() == library.encode_ordinary(text), text


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_random_vocabularies(seed):
    """Ranks in any order, so that a longer token may go before its parts."""
    rng = random.Random(seed)
    made = {bytes([i]) for i in range(256)}
    while len(made) < 290:
        made.add(b"".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(2, 6))))
    order = sorted(made - {bytes([i]) for i in range(256)})
    rng.shuffle(order)
    ranks = {bytes([i]): i for i in range(256)} | {b: 256 + i for i, b in enumerate(order)}
    library, pieces = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.PieceIds(bpe.Vocabulary(ranks))
    for _ in range(20):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(30)))
        assert np.frombuffer(b"".join(map(pieces.__getitem__, bpe.split(text))), "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6), TEXTS), max_size=3))
def test_edits_give_what_encoding_anew_gives(text, edits):
    last = table(text)
    for begin, length, new in edits:
        text, last, _ = bpe.replaced(KNOWN, text, last, begin, begin + length, new)
        assert list(KNOWN.read_back(last)) == LIBRARY.encode_ordinary(text)


def test_edits_work_on_bytes_near_them_only():
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("aeinst") for _ in range(6)) for _ in range(5000))
    _, _, redone = bpe.replaced(KNOWN, prose, table(prose), 17_000, 17_002, "xyz")
    assert redone < 60
    dna = "".join(rng.choice("acgt") for _ in range(20_000))
    said, last, redone = bpe.replaced(KNOWN, dna, table(dna), len(dna), len(dna), "acca")
    assert redone <= 8 and list(KNOWN.read_back(last)) == LIBRARY.encode_ordinary(said)


ROWS = [(1, "Hello world, it's 12 o'clock"), (2, None), (3, ""), (4, " "), (None, "no id"), (5, "<|endoftext|> x"), (6, "é漢😀\x00\x85"), (7, "word " * 30_000), (1, "Hello world, it's 12 o'clock"), (8, "z" * 9000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "last", "decoded")})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_operator_over_nulls_empties_repeats_and_long_texts(spark, docs):
    got = sorted(map(tuple, bpe.encode(docs, PATH, decoded=True).collect()), key=str)
    want = sorted(((d, len(x := LIBRARY.encode_ordinary(t or "")), np.array(x, "<u4").tobytes(), (t or "").encode()) for d, t in ROWS), key=str)
    assert [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got] == [tuple(r) for r in want]
    assert bpe.encode(docs.limit(0)).count() == 0
    assert {bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, PATH)).collect()} == {(t or "").encode() for _, t in ROWS}
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first().decoded == b""


def test_changed_rows(spark, docs):
    edits = bpe.encode(docs, PATH, tables=True).withColumns({"begin": F.when(F.col("doc_id") % 2 == 0, 3), "stop": F.lit(5), "new": F.when(F.col("doc_id") != 3, " and's more")})
    for r in bpe.change(edits, PATH).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode_ordinary(r.text)
        before = next(t or "" for d, t in ROWS if d == r.doc_id)
        begin = min(3, len(before)) if r.doc_id is not None and r.doc_id % 2 == 0 else len(before)
        new = " and's more" if r.doc_id is not None and r.doc_id != 3 else ""
        assert r.text == before[:begin] + new + before[max(begin, 5) :]


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        x = LIBRARY.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(x), sha(np.array(x, "<u4").tobytes()), sha((r.text or "").encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_byte_bpe(spark, sf).collect()} == want
