"""Best-fit packing of tokenised documents into fixed-size sequences, planned on a length histogram.

The plan is best-fit-decreasing over counts of pieces of each length: a run of bins with the same
room left is filled at once, so planning costs the same for a thousand documents as for 10^12.
Each planned slot run says which ranks within a length go to which bins; a piece finds its slot by
its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.words import worker_cache
from weftline.staging import stage

CAPACITY = 2048
END = 0
PER_BUCKET = 10_000
TRAILING = b".,;:!?#%&*$"


class TokenBytes(dict):
    """Ids of each chunk between ASCII white space, as little-endian bytes.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of
    its chunks in order. Two generations of at most ``most`` chunks of up to ``longest`` bytes are kept.
    """

    most = 250_000
    longest = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode, self.old = Tokenizer.from_file(path).encode, {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(chunk)
        if ids is None:
            word = chunk.rstrip(TRAILING)
            # An ASCII letter or digit and a mark after it never share a token. Other letters may: one whose
            # lower case ends in a combining mark goes on into the marks after it.
            if word and len(word) < len(chunk) and word[-1:].isalnum():
                ids = self[word] + self[chunk[len(word) :]]
            else:
                ids = array("I", self.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
        if len(chunk) <= self.longest:
            self[chunk] = ids
        return ids


def text_ids(text: bytes | None, tokens: TokenBytes) -> bytes:
    """A text's ids as little-endian unsigned 32-bit bytes, with the end id."""
    text = text or b""
    if b"<|" not in text:  # else special tokens, which are told by case
        text = text.lower()
    return b"".join(map(tokens.__getitem__, text.split())) + END.to_bytes(4, "little")


def _pieces(path: str, capacity: int, with_ids: bool):
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(names + [("ids", pa.list_(pa.uint32()))] * with_ids)
    if with_ids:
        schema = schema.set(5, pa.field("ids", pa.list_(pa.int32())))

    def run(batches):
        tokens = worker_cache(("tokens", path), lambda: TokenBytes(path))
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                out = [[] for _ in schema]
                for doc, text in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                    ids = text_ids(text, tokens)
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        row = (doc, i, at // 4, len(piece) // 4, zlib.crc32(piece), np.frombuffer(piece, "<i4"))
                        for column, value in zip(out, row):  # noqa: B905
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slot runs (length, first rank, count, first bin, pieces a bin, offset), best fit, longest first.

    The i-th piece of a run goes to bin ``first bin + i // pieces a bin`` at
    ``offset + i % pieces a bin * length``. The number of runs depends on the capacity, not on counts.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # bins (first, count) by room left
    runs, bins = [], 0
    for length in sorted((x for x, c in histogram.items() if c > 0), reverse=True):
        rank, left, r = 0, histogram[length], length
        while left:
            while r < capacity and not room[r]:
                r += 1
            each = r // length
            if room[r] and r < capacity:
                first, n = room[r].pop()
            else:
                first, n, r = bins, -(-left // (capacity // length)), capacity
                each = capacity // length
                bins += n
            take = min(left, n * each)
            runs.append((length, rank, take, first, each, capacity - r))
            full, rest = divmod(take, each)
            if full:
                room[r - each * length].append((first, full))
            if rest:
                room[r - rest * length].append((first + full, 1))
            used = full + (rest > 0)
            if used < n:
                room[r].append((first + used, n - used))
            rank, left = rank + take, left - take
    return runs


def _place(runs: list[tuple]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            i = rank - row[:, 1]
            sequence, offset = row[:, 3] + i // row[:, 4], row[:, 5] + i % row[:, 4] * length
            kept = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    Rows: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. A document is its
    tokens and an end id; only one longer than the capacity is cut. A null or empty text is the end
    id alone. Repeated rows are packed each time they occur; a null doc_id is carried along; other
    columns are ignored. An empty table gives no rows. ``tokenizer`` is a path that executors can read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    run, schema = _pieces(tokenizer, capacity, with_ids)
    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
    # Numbers of rows that are written with them, so that rows which say the same are told apart.
    pieces = stage(cut.withColumn("nr", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    # Rank within a length: what the earlier buckets hold and the place within the own bucket.
    spread = pieces.sparkSession.createDataFrame([(x, -(-c // PER_BUCKET)) for x, c in counts.items()], "of int, buckets long")
    mixed = pieces.withColumn("mixed", F.xxhash64("doc_id", "piece", "nr")).join(F.broadcast(spread), F.col("length") == F.col("of")).withColumn("bucket", F.pmod("mixed", "buckets"))
    before = mixed.groupBy("length", "bucket").agg(F.count("*").alias("c"))
    before = before.select("length", "bucket", (F.sum("c").over(W.partitionBy("length").orderBy("bucket")) - F.col("c")).alias("before"))
    ranked = mixed.withColumn("place", F.row_number().over(W.partitionBy("length", "bucket").orderBy("mixed", "nr"))).join(before, ["length", "bucket"])
    ranked = ranked.select(*cut.columns, (F.col("before") + F.col("place") - 1).alias("rank"))
    return ranked.mapInArrow(_place(plan(counts, capacity)), schema + ", sequence_id long, offset long")
