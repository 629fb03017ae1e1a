"""Byte-level BPE by dynamic programming over prefixes.

Leaving out the last token of a BPE encoding leaves the encoding of a shorter prefix, so every prefix
of a piece has one last token, and the table of these tokens is the whole encoding: it is read
backwards from the end. A token may follow another where merging the bytes of both gives just these two.
More bytes only add entries, and an edit only changes entries near it.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import worker_cache

SLICE = 256  # rows of a batch that are encoded before their results leave the worker
# Letters and numbers that Unicode 16 has and Python's Unicode 15.1 has not. The splitting pattern means those of Unicode 16.
NEW_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def _class(kind: str, more: str) -> str:
    """All characters of a general category as ranges of a character class."""
    points = {c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind}
    for part in more.split():
        a, _, b = part.partition("-")
        points.update(range(int(a, 16), int(b or a, 16) + 1))
    ranges: list[list[int]] = []
    for c in sorted(points):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges)


def _pattern(letters: str, numbers: str, spaces: str) -> re.Pattern:
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


_ASCII = _pattern("A-Za-z", "0-9", "\t\n\x0b\x0c\r ")


@lru_cache(1)
def _any_text() -> re.Pattern:
    return _pattern(_class("L", NEW_LETTERS), _class("N", NEW_NUMBERS), SPACES)


def split(text: str) -> list[str]:
    """The pieces that are encoded separately; together they are the text."""
    return (_ASCII if text.isascii() else _any_text()).findall(text)


class Vocabulary:
    """Ranks of byte strings, and what the dynamic program asks of them."""

    most_pairs = 2_000_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {t: b for b, t in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple | None] = {}
        self.finder = ahocorasick.Automaton()
        for b, t in ranks.items():
            self.finder.add_word(b.decode("latin-1"), (len(b), t))
        self.finder.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))})

    def history(self, token: int) -> tuple[list[tuple[int, bytes, bytes]], bytes, bytes] | None:
        """How merging makes a token of its bytes: (rank, first part, last part) of every step; with the first and last part before.

        None if merging doesn't make it. The pair of the lowest rank goes first, of equal ones the leftmost.
        """
        if token in self.histories:
            return self.histories[token]
        data = self.bytes[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        steps = []
        while len(parts) > 1:
            known = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get(a + b)) is not None]
            if not known:
                break
            rank, i = min(known)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append((rank, parts[0], parts[-1]))
        self.histories[token] = (steps, data[:1], data[-1:]) if len(parts) == 1 else None
        return self.histories[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may stand right after ``before`` (-1: at the start of a piece).

        Both are made step by step, the lower rank first and ``before`` first where they are equal. They stay
        apart if at no time the pair across their border goes before the next step of either.
        """
        key = before << 32 | token
        found = self.pairs.get(key)
        if found is None:
            found = self._apart(before, token)
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _apart(self, before: int, token: int) -> bool:
        right = self.history(token)
        left = self.history(before) if before >= 0 else None
        if right is None or left is None:
            return right is not None and before < 0
        (mine, _, end), (theirs, start, _) = left, right
        i = k = 0
        ranks, never = self.ranks, 1 << 40
        across = ranks.get(end + start, never)
        while True:
            a = mine[i][0] if i < len(mine) else never
            b = theirs[k][0] if k < len(theirs) else never
            if across < a and across <= b:
                return False
            if a == b == never:
                return True
            if a <= b:
                changed, end, i = mine[i][2] is not end, mine[i][2], i + 1
            else:
                changed, start, k = theirs[k][1] is not start, theirs[k][1], k + 1
            if changed:
                across = ranks.get(end + start, never)

    def extend(self, piece: bytes, last: array) -> None:
        """Add to ``last``, which has the last tokens of a piece's first prefixes, those of all its longer ones."""
        done, held = len(last), [-1]
        begin = max(0, done - self.longest + 1)
        last.extend(held * (len(piece) - done))
        follows = self.follows
        for end, (length, token) in self.finder.iter(piece[begin:].decode("latin-1")):
            end += begin
            if end >= done and last[end] < 0:
                at = end - length
                before = last[at] if at >= 0 else -1
                if (before >= 0 or at < 0) and follows(before, token):
                    last[end] = token
        if any(t < 0 for t in last[done:]):
            raise ValueError("the vocabulary can't say this text")

    def last_tokens(self, piece: bytes) -> array:
        last = array("i")
        if piece in self.ranks:  # as merging gives them, but for a token that merging doesn't reach
            self.extend(piece[:-1], last)
            last.append(self.ranks[piece])
        else:
            self.extend(piece, last)
        return last

    def read_back(self, last: array | np.ndarray) -> array:
        """The tokens of a text from its table."""
        out, at = array("i"), len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes[last[at - 1]])
        out.reverse()
        return out


class PieceIds(dict):
    """Ids of pieces as little-endian bytes; two generations of at most ``most`` pieces of up to ``longest`` characters are kept."""

    most = 250_000
    longest = 64

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            tokens = [whole] if whole is not None else self.vocabulary.read_back(self.vocabulary.last_tokens(data))
            ids = np.array(tokens, "<u4").tobytes()
        if len(piece) <= self.longest:
            self[piece] = ids
        return ids


def edge(text: str, at: int, step: int) -> int:
    """The nearest place from ``at`` in direction ``step`` where a piece begins whatever stands beyond it; else the text's end there.

    A lone space between two characters that are no white space always begins a piece.
    """
    while 0 < at < len(text) - 1:
        if text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at += step
    return 0 if step < 0 else len(text)


def replaced(vocabulary: Vocabulary, text: str, last: np.ndarray, begin: int, stop: int, new: str) -> tuple[str, np.ndarray, int]:
    """(text, table, bytes worked out anew) after ``text[begin:stop]`` has become ``new``; appending is ``begin = stop = len(text)``.

    Only pieces between the lone spaces around the edit are split and encoded again, and of the one in which the
    edit begins only prefixes that reach into it.
    """
    begin, stop = max(0, min(begin, len(text))), max(0, min(stop, len(text)))
    stop = max(begin, stop)
    a, b = edge(text, begin - 2, -1), edge(text, stop + 1, 1)
    head, tail = len(text[:a].encode()), len(text[b:].encode())
    same = len(text[a:begin].encode())
    olds, at = set(), 0
    for piece in split(text[a:b]):
        olds.add(at)
        at += len(piece.encode())
    table, at, redone = array("i"), 0, 0
    for piece in split(text[a:begin] + new + text[stop:b]):
        data = piece.encode()
        kept = min(len(data), same - at) - 1 if at in olds and at < same else 0  # the last of them may be a token that only stands alone
        if kept > 0 and data not in vocabulary.ranks:
            mine = array("i", last[head + at : head + at + kept].tolist())
            vocabulary.extend(data, mine)
        else:
            kept, mine = 0, vocabulary.last_tokens(data)
        table.extend(mine)
        redone += len(data) - kept
        at += len(data)
    joined = np.concatenate([last[:head], np.array(table, np.int32), last[len(last) - tail :]])
    return text[:begin] + new + text[stop:], joined, redone


def _path(ranks: str | None) -> str:
    if ranks is None:
        import public_tokenizers

        ranks = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks


def _pieces_of(path: str) -> PieceIds:
    return worker_cache(("bpe", path), lambda: PieceIds(Vocabulary.read(path)))


def _in_slices(make, schema: pa.Schema):
    """Rows of each slice of a batch through ``make``, which gives one list a column."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                columns = make(*(c.to_pylist() for c in batch.slice(first, SLICE).columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def encode(docs: DataFrame, ranks: str | None = None, decoded: bool = False, tables: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row of ``docs`` (doc_id, text); ``ids`` are little-endian unsigned 32-bit integers.

    Each piece of a whole text is encoded separately, without special tokens: what looks like one is text.
    ``decoded`` adds the bytes that the ids say, ``tables`` the text and ``last``, the last token of every
    byte prefix, for ``change``. A null text is as an empty one: no ids. Repeated rows are encoded each; a
    null doc_id is carried along; other columns are ignored. An empty table gives no rows. A text without any
    place to split takes memory of a few times its size. ``ranks`` is a path that executors can read.
    """
    path = _path(ranks)
    names = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.binary())] * decoded + [("text", pa.string()), ("last", pa.binary())] * tables

    def make(docs, texts):
        pieces = _pieces_of(path)
        said = pieces.vocabulary.bytes.__getitem__
        ids = [b"".join(map(pieces.__getitem__, split(t or ""))) for t in texts]
        out = [docs, [len(x) // 4 for x in ids], ids]
        if decoded:
            out.append([b"".join(map(said, np.frombuffer(x, "<u4").tolist())) for x in ids])
        if tables:
            whole = [array("i") for _ in texts]
            for table, t in zip(whole, texts, strict=True):
                for piece in split(t or ""):
                    table.extend(pieces.vocabulary.last_tokens(piece.encode()))
            out += [[t or "" for t in texts], [np.array(t, "<i4").tobytes() for t in whole]]
        return out

    ddl = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded + ", text string, last binary" * tables
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_in_slices(make, pa.schema(names)), ddl)


def decode(rows: DataFrame, ranks: str | None = None) -> DataFrame:
    """``(doc_id, decoded)``: the bytes that the ids of every row (doc_id, ids) say; null ids say nothing. An unknown id is an error."""
    path = _path(ranks)

    def make(docs, ids):
        said = _pieces_of(path).vocabulary.bytes.__getitem__
        return [docs, [b"".join(map(said, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]]

    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_in_slices(make, schema), "doc_id long, decoded binary")


def change(rows: DataFrame, ranks: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids, text, last, redone)`` after one edit of every row (doc_id, text, last, begin, stop, new).

    Characters from ``begin`` (from 0) up to ``stop`` become ``new``; places outside the text are its ends, null
    is the end, a null ``new`` is empty. ``redone`` says how many bytes were worked out anew: those near the edit.
    """
    path = _path(ranks)

    def make(docs, texts, tables, begins, stops, news):
        vocabulary = _pieces_of(path).vocabulary
        out: list[list] = [[] for _ in range(6)]
        for doc, text, table, begin, stop, new in zip(docs, texts, tables, begins, stops, news, strict=True):
            text, end = text or "", len(text or "")
            said, last, redone = replaced(vocabulary, text, np.frombuffer(table or b"", "<i4"), end if begin is None else begin, end if stop is None else stop, new or "")
            ids = np.array(vocabulary.read_back(last), "<u4").tobytes()
            for column, value in zip(out, (doc, len(ids) // 4, ids, said, last.astype("<i4").tobytes(), redone), strict=True):
                column.append(value)
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.string()), ("last", pa.binary()), ("redone", pa.int64())])
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", "last", F.col("begin").cast("long").alias("begin"), F.col("stop").cast("long").alias("stop"), "new"]
    return rows.select(*columns).mapInArrow(_in_slices(make, schema), "doc_id long, n_tokens long, ids binary, text string, last binary, redone long")
