"""Substring dedup: passages that repeat across documents, by paragraph MinHash banding.

Paragraphs are lines of some length and, as passages also stand inside longer lines, windows of 50 words or a few more in these.
Windows overlap and are content-aligned: they begin where a hash of three words is the least for 16 words around, and end at the first
place after 50 words where one is the least for 4, so a passage has the same windows wherever it stands. All
are banded by MinHash of their word shingles. Paragraphs that collide in
a band are compared with the band's leader by exact Jaccard, those that this leaves out of their leader's
component with all that their leader stands for, and verified links are closed into components. So a changed word doesn't split a passage.

What repeats exactly is also found where it is shorter than a window, and to the word: texts are cut once more, into
the segments between the finer places, equal ones are one class, and where a repeated segment's neighbour is
not repeated, the words beside it are added as far as another document goes on alike. Repeated paragraphs, segments and
those words are joined into runs; the document with the smallest id of a component or class keeps its copy.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.components import connected_components
from weftline.llm.jaccard import PART, compare_groups, leader_pairs
from weftline.llm.jaccard import _spans as spans_of_sizes
from weftline.llm.meetings import meetings
from weftline.llm.words import SHINGLE, bounds_of_words, hashes_of_words, minhash_keys, mix, shingles
from weftline.staging import release, stage, unstage

BANDS, ROWS = 8, 3  # a pair at 0.8 meets in a band with probability 0.997
PARAGRAPH = 16  # words of a banded line, at least
WINDOW = 50  # words of a window inside a line of more than LONG words, at least
LONG = 75
WIDE = 16  # words on either side that the hash where a window begins is the least of
RADIUS = 4  # words on either side that a cut's hash is the least of
MOST = 64  # paragraphs of a text that share a key, of which all pairs are compared where they stand
RUN = 20  # words of a run that is reported, at least
STEP = 16  # words beside a segment that are compared at first; twice as many in each later round
SEGMENT, LINE, INSIDE = 0, 1, 3
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def cuts(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the segments of texts that stand side by side, each text's own (``begins``) among them, and those of windows."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = np.iinfo(np.uint64).max
    with np.errstate(over="ignore"):
        g = mix(mix(hashes[:-2] * np.uint64(_P) + hashes[1:-1]) * np.uint64(_P) + hashes[2:])
    # Texts are padded, so no hash is held against those of another text, and none goes over a text's end.
    ends = np.append(begins[1:], len(hashes))
    pads = WIDE * np.repeat(np.arange(1, len(begins) + 1), ends - begins)
    whole = np.ones(len(hashes), bool)
    whole[ends - 1] = whole[np.maximum(ends - 2, 0)] = False
    of = np.flatnonzero(whole)
    padded = np.full(len(hashes) + WIDE * (len(begins) + 1), most, np.uint64)
    padded[of + pads[of]] = g[of]
    n = len(padded) - 2 * RADIUS
    least = np.full(n, most, np.uint64)
    for i in (*range(RADIUS), *range(RADIUS + 1, 2 * RADIUS + 1)):
        np.minimum(least, padded[i : i + n], out=least)
    near = np.zeros(len(padded), bool)
    near[RADIUS : RADIUS + n] = padded[RADIUS : RADIUS + n] < least
    at = of[near[of + pads[of]]]
    # Few of these are the least of the words farther off.
    wide = at
    if len(at):
        around = np.lib.stride_tricks.sliding_window_view(padded, 2 * WIDE + 1)[at + pads[at] - WIDE]
        wide = at[(around.min(1) == g[at]) & ((around == g[at][:, None]).sum(1) == 1)]
    first = np.zeros(len(hashes), bool)
    first[at] = first[begins] = True
    return np.flatnonzero(first), wide


def windows(at: np.ndarray, wide: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of the windows in lines from ``first`` to ``last``, of which each begins at a wide cut or is its line's first."""
    lo, hi = np.searchsorted(wide, first + 1), np.searchsorted(wide, last - WINDOW, side="right")
    n = 1 + np.maximum(hi - lo, 0)
    begin = np.cumsum(n) - n
    starts = np.append(wide, 0)[np.minimum(np.arange(n.sum()) - np.repeat(begin + 1 - lo, n), len(wide))]
    starts[begin] = first
    last = np.repeat(last, n)
    ends = np.append(at, len(at) and at[-1] + (1 << 40))[np.searchsorted(at, starts + WINDOW)]
    ends = np.minimum(ends, last)
    keep = ends - starts >= WINDOW
    return starts[keep], ends[keep]


def _spans_hash():
    """A function of word hashes and spans' first and end words that hashes each span, alike wherever it stands."""
    table = {"p": powers(_P, 1 << 12), "inv": powers(_PINV, 1 << 12)}

    def spans_hash(h, lo, hi):
        if len(h) > len(table["p"]):
            table.update(p=powers(_P, 2 * len(h)), inv=powers(_PINV, 2 * len(h)))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * table["p"][: len(h)], dtype=np.uint64)])
            return mix((sums[hi] - sums[lo]) * table["inv"][lo] + (hi - lo).astype(np.uint64) * np.uint64(_P)).view(np.int64)

    return spans_hash


def _met(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of the same owner (a number) that share a key in a band, and the owners that have too many rows with one key."""
    with np.errstate(over="ignore"):
        tagged = (keys ^ mix((owners + 1).astype(np.uint64) * np.uint64(_P))[:, None]).ravel()
    order = np.argsort(tagged)
    tagged, rows = tagged[order], order // keys.shape[1]
    many = np.unique(owners[rows[MOST:][tagged[MOST:] == tagged[:-MOST]]])
    free = ~np.isin(owners[rows], many)
    tagged, rows = tagged[free], rows[free]
    pairs = [np.zeros(0, np.int64)]
    for d in range(1, MOST):
        same = tagged[d:] == tagged[:-d]
        if not same.any():
            break
        x, y = rows[:-d][same], rows[d:][same]
        pairs.append(np.minimum(x, y) * len(keys) + np.maximum(x, y))
    pairs = np.unique(np.concatenate(pairs))
    return pairs // len(keys), pairs % len(keys), many


def _similar(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of the hashes from ``lo`` to ``hi`` of rows x and y, which lie in one text, are similar."""
    order = np.argsort(s, kind="stable")
    again = np.flatnonzero(s[order[1:]] == s[order[:-1]])
    before = np.full(len(s), -1)
    before[order[again + 1]] = order[again]
    first, end = np.minimum(lo[x], lo[y]), np.maximum(hi[x], hi[y])
    # Where no hash comes twice from the first to the end of both, sizes are lengths and what they share is where they overlap.
    both = np.maximum(np.minimum(hi[x], hi[y]) - np.maximum(lo[x], lo[y]), 0)
    out = 100 * both >= percent * (hi[x] - lo[x] + hi[y] - lo[y] - both)
    repeats = np.flatnonzero(before >= 0)
    at, stop = np.searchsorted(repeats, first), np.searchsorted(repeats, end)
    for i in np.flatnonzero(at < stop).tolist():
        if (before[repeats[at[i] : stop[i]]] >= first[i]).any():
            a, b = np.unique(s[lo[x[i]] : hi[x[i]]]), np.unique(s[lo[y[i]] : hi[y[i]]])
            n = len(np.intersect1d(a, b, assume_unique=True))
            out[i] = 100 * n >= percent * (len(a) + len(b) - n)
    return out


def _paragraphs(bands: int, percent: int = 80):
    """Segments, lines and windows, as the last two bits of fp say; beside has 16 bits of the hash of the word before and of the word after,
    and keys are those of all bands of a paragraph that the task meets for the first time.

    Windows overlap, so most of those that share a key stand in one text. These are compared here: near has the paragraphs of its text
    that a paragraph links with. Keys that only paragraphs with one owner have need no comparison elsewhere; the owner is the text's hash,
    or the paragraph itself in a text of which too many paragraphs share a key.
    """
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("points", pa.int64()), ("words", pa.int64()), ("beside", pa.int32()), ("owner", pa.int64()), ("keys", longs), ("near", longs)])

    def run(batches):
        seen: set[int] = set()
        spans_hash = _spans_hash()
        for batch in batches:
            batch = batch.filter(pc.greater(pc.binary_length(batch.column(1)), 0))
            text = batch.column(1)
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
            ids = batch.column(0).to_numpy()
            for start, stop in spans_of_sizes(np.diff(offsets), PART, 500):
                bounds = (offsets[start : stop + 1] - offsets[start]).astype(np.int64)
                raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[start] : offsets[stop]]
                c0, c1 = bounds_of_words(raw, bounds)
                if not len(c0):
                    continue
                h = hashes_of_words(raw, c0, c1)
                doc = np.searchsorted(bounds, c0, side="right") - 1
                begins = np.flatnonzero(np.diff(doc, prepend=-1))
                point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                line = np.cumsum(raw == 10)[c0]
                lo, wide = cuts(h, begins)
                hi = np.append(lo[1:], len(h))
                n_segments = len(lo)
                opens = np.diff(line, prepend=-1) != 0
                opens[begins] = True
                first = np.flatnonzero(opens)
                last = np.append(first[1:], len(h))
                long, longer = last - first >= PARAGRAPH, last - first > LONG
                inside = windows(lo, wide, first[longer], last[longer])
                lo, hi = (np.concatenate(c) for c in ((lo, first[long], inside[0]), (hi, last[long], inside[1])))
                kinds = np.repeat([SEGMENT, LINE, INSIDE], [n_segments, long.sum(), len(inside[0])])
                # Paragraphs and segments are different classes even where they say the same.
                fp = (spans_hash(h, lo, hi) & ~3) | kinds
                of = doc[lo]
                begin, base = np.zeros(len(bounds), np.int64), point[bounds]
                begin[doc[begins]] = begins
                at_end = np.zeros(len(h) + 1, bool)
                at_end[begins] = at_end[-1] = True
                low = np.append(h & np.uint64(0xFFFF), np.uint64(0)).astype(np.uint32)
                beside = (np.where(at_end[lo], 0, low[lo - 1]).astype(np.uint32) << np.uint32(16)) | np.where(at_end[hi], 0, low[hi]).astype(np.uint32)
                columns = [ids[start:stop][of], fp, ((point[c0[lo]] - base[of]) << 32) + point[c1[hi - 1]] - base[of], ((lo - begin[of]) << 32) + hi - begin[of]]

                values, new = np.unique(fp[n_segments:], return_index=True)
                new = n_segments + np.sort(new[[v not in seen for v in values.tolist()]])
                seen.update(fp[new].tolist())
                n, count = len(fp), np.zeros(len(fp), np.int64)
                keys, owner, near, links = np.zeros((0, bands), np.int64), np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
                if len(new) and bands:
                    s = shingles(h)
                    begin, end, of = lo[new], hi[new] - SHINGLE + 1, of[new]
                    pool = np.append(s, np.uint64(0))  # so that the last end is in the pool
                    keys = minhash_keys(pool, np.stack([begin, end], 1).ravel(), bands, ROWS, 2)
                    x, y, many = _met(keys, of)
                    link = _similar(s, begin, end, x, y, percent)
                    x, y = x[link], y[link]
                    own = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64).view(np.int64)
                    owner[new] = np.where(np.isin(of, many), fp[new], own[of])
                    count[new] = bands
                    near = fp[new[y]]  # by x, as pairs are
                    links[new] = np.bincount(x, minlength=len(new))
                lists = []
                for sizes, flat in ((count, keys.view(np.int64).ravel()), (links, near)):
                    there = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(sizes == 0, False))
                    lists.append(pa.ListArray.from_arrays(there, pa.array(flat, pa.int64())))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(beside.view(np.int32)), pa.array(owner, mask=count == 0), *lists], schema=schema)

    return run


_ASKED = "doc_id long, fp long, w0 long, w1 long, right boolean, edge boolean, done long"


def _beside(step: int):
    """The next ``step`` words beside segments: hashes of the segment and all words up to each, and code points."""
    names = [c.split()[0] for c in _ASKED.split(", ")]
    fields = [*names[1:], "key"]  # of what a document is asked for

    def run(batches):
        spans_hash = _spans_hash()
        for batch in batches:
            text = batch.column(1)
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
            ids = batch.column(0).to_numpy()
            for start, stop in spans_of_sizes(np.diff(offsets), PART, 500):
                bounds = (offsets[start : stop + 1] - offsets[start]).astype(np.int64)
                raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[start] : offsets[stop]]
                c0, c1 = bounds_of_words(raw, bounds)
                h = hashes_of_words(raw, c0, c1)
                begin = np.searchsorted(c0, bounds)
                point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                first = np.repeat(point[bounds[:-1]], np.diff(begin))
                c0, c1 = point[c0] - first, point[c1] - first
                lists = batch.column(2).slice(start, stop - start)
                wanted = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten(), strict=True))
                of = np.repeat(np.arange(stop - start), lists.value_lengths().to_numpy())
                e = np.stack([ids[start:stop][of], *(wanted[f].cast(pa.int64()).to_numpy() for f in fields), begin[of], begin[of + 1]], 0)
                e = e[:, e[3] <= e[9] - e[8]]
                e = e[:, (spans_hash(h, e[8] + e[2], e[8] + e[3]) & ~3) == e[1]]  # other texts may have the same id
                n = np.clip(np.where(e[4] == 1, e[9] - e[8] - e[3], e[2]) - e[6], 0, step)
                e, n = e[:, n > 0], n[n > 0]
                key, keys, points = e[7].view(np.uint64), np.zeros((len(n), step), np.uint64), np.zeros((len(n), step), np.int64)
                for i in range(n.max(initial=0)):
                    at = np.where(n > i, e[8] + np.where(e[4] == 1, e[3] + e[6] + i, e[2] - 1 - e[6] - i), 0)
                    with np.errstate(over="ignore"):
                        keys[:, i] = key = mix(key * np.uint64(_P) + h[at])
                    points[:, i] = (c0[at] << 32) + c1[at]
                there, ends = np.arange(step) < n[:, None], pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[there].view(np.int64))) for x in (keys, points)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c == 1 if f in ("right", "edge") else c) for c, f in zip(e, names, strict=False)), *lists], names=[*names, "keys", "points"])

    return run


def _extended(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Words beside repeated segments (``hits``) that another document has there too, as further hits.

    A segment is extended on a side where its neighbour is not repeated, against all documents that have it.
    Of those that go on with the same two repeated segments, the smallest and the largest stand for all:
    a neighbour that isn't repeated differs within them, and the others' segments there are removed anyhow. Rounds go on while words agree, so the length
    is not bounded.
    """
    order = W.partitionBy("doc_id").orderBy("w0", "w1")
    marked = hits.where(f"fp & 3 = {SEGMENT}")
    for name, step, near, far in (("l", F.lag, "w0", "w1"), ("r", F.lead, "w1", "w0")):
        marked = marked.withColumn(f"{name}_edge", F.coalesce(step(far).over(order) != F.col(near), F.lit(True)))
        second = F.coalesce(step(near).over(order) == step(far, 2).over(order), F.lit(False))
        alone = F.xxhash64("doc_id", "w0", F.lit(name))
        marked = marked.withColumn(f"{name}_on", F.when(F.col(f"{name}_edge") | ~second, alone).otherwise(F.xxhash64(step("fp").over(order), step("fp", 2).over(order))))
    side = lambda right, name, bits: F.struct(F.lit(right).alias("right"), F.col(f"{name}_edge").alias("edge"), F.col(f"{name}_on").alias("on"), bits.alias("bits"))
    sides = F.array(side(False, "l", F.shiftrightunsigned("beside", 16)), side(True, "r", F.expr("beside & 65535")))
    each = marked.select("doc_id", "fp", "w0", "w1", F.inline(sides))
    # Nothing is asked where one document has a segment and word, or all have a repeated segment there.
    by = W.partitionBy("fp", "right", "bits")
    each = each.withColumns({"least": F.min("doc_id").over(by), "most": F.max("doc_id").over(by), "open": F.max("edge").over(by)}).where("least != most and open")
    one = F.struct("doc_id", "w0", "w1", "edge")
    asked = each.groupBy("fp", "right", "bits", "on").agg(F.min(one).alias("low"), F.max(one).alias("high")).select("fp", "right", F.inline(F.array_distinct(F.array("low", "high"))))
    asked = stage(asked.select("doc_id", "fp", "w0", "w1", "right", "edge", F.lit(0).cast("long").alias("done"), F.xxhash64("fp", "right").alias("key")), "asked")
    step, out, texts = STEP, [], texts.where("text is not null")
    while asked.limit(1).count():
        if len(out) == 1:  # few documents go on after the first round; Spark broadcasts their ids if they are small
            texts = stage(texts.join(stage(asked.select("doc_id").distinct(), "going-on"), "doc_id", "left_semi"), "texts")
        wanted = asked.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("fp", "w0", "w1", "right", "edge", "done", "key")).alias("wanted"))
        rows = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("of")).select("doc_id", F.col("text").cast("binary").alias("text"), "wanted")
        rows = stage(rows.mapInArrow(_beside(step), f"{_ASKED}, keys array<long>, points array<long>"), "beside")
        unstage(asked)
        by = W.partitionBy("key")  # keys are moved once
        each = rows.select("doc_id", "fp", "w0", "right", "edge", F.posexplode("keys").alias("at", "key"))
        each = each.withColumns({"low": F.min("doc_id").over(by), "high": F.max("doc_id").over(by), "open": F.max("edge").over(by)})
        reach = each.where("low != high and open").groupBy("doc_id", "fp", "w0", "right").agg(F.max("at").alias("far"), F.max(F.when(F.col("low") < F.col("doc_id"), F.col("at"))).alias("cut"))
        same = stage(rows.join(reach, ["doc_id", "fp", "w0", "right"]).withColumn("cut", F.coalesce("cut", F.lit(-1))), "alike")
        unstage(rows)
        parts = F.array(F.struct(F.lit(True).alias("removed"), F.lit(0).alias("a"), F.col("cut").alias("b")), F.struct(F.lit(False).alias("removed"), (F.col("cut") + 1).alias("a"), F.col("far").alias("b")))
        spans = same.select("*", F.inline(parts)).where("a <= b")
        out.append(spans.selectExpr("doc_id", "fp as component", "removed", "if(right, w1 + done + a, w0 - 1 - done - b) as w0", "if(right, w1 + done + b + 1, w0 - done - a) as w1", "shiftright(points[if(right, a, b)], 32) as c0", "points[if(right, b, a)] & 4294967295 as c1"))
        asked = stage(same.where(F.col("far") == step - 1).selectExpr("doc_id", "fp", "w0", "w1", "right", "edge", f"done + {step} as done", f"keys[{step - 1}] as key").distinct(), "asked")
        step *= 2
        release(texts.sparkSession)  # the texts of this round
    return reduce(DataFrame.unionByName, out) if out else hits.select("doc_id", "component", "removed", "w0", "w1", "c0", "c1").limit(0)


def _clip(doc, w0, w1, c0, c1, window, wide):
    """First and end words and code points of hits, clipped; ``doc`` counts documents and ``wide`` passes all words."""
    exact, asked = np.flatnonzero(~window), np.flatnonzero(window)
    w0, w1, c0, c1 = (c.copy() for c in (w0, w1, c0, c1))
    if not len(exact) or not len(asked):
        return w0, w1, c0, c1
    d, a0, a1 = doc[asked], w0[asked], w1[asked]
    by = exact[np.lexsort((c0[exact], w0[exact], doc[exact]))]
    at = np.searchsorted(doc[by] * wide + w0[by], d * wide + a0)  # exact hits before it begin earlier
    most = np.maximum.accumulate(doc[by] * wide + w1[by])
    covered = (at > 0) & (most[at - 1] > d * wide + a0)
    first = by[np.minimum(at, len(by) - 1)]
    left = (at < len(by)) & (doc[first] == d) & ~covered & (w0[first] < a1)
    by = exact[np.lexsort((c1[exact], w1[exact], doc[exact]))]
    at = np.searchsorted(doc[by] * wide + w1[by], d * wide + a1, side="right")  # exact hits from it on end later
    least = np.minimum.accumulate((doc[by] * wide + w0[by])[::-1])[::-1]
    after = np.minimum(at, len(by) - 1)
    covered = (at < len(by)) & (least[after] < d * wide + a1)
    last = by[np.maximum(at - 1, 0)]
    right = (at > 0) & (doc[last] == d) & ~covered & (w1[last] > a0)
    w0[asked[left]], c0[asked[left]] = w0[first[left]], c0[first[left]]
    w1[asked[right]], c1[asked[right]] = w1[last[right]], c1[last[right]]
    return w0, w1, c0, c1


_CLIPPED = "doc_id long, component long, removed boolean, w0 long, w1 long, c0 long, c1 long"


def _by_document(least: int | None):
    """Clipped hits of documents that come one after the other; with ``least``, the runs of as many words that they join to."""
    names = ("doc_id", "component", "removed", "w0", "w1", "c0", "c1", "window")

    def work(batch):
        ids, component, removed, w0, w1, c0, c1, window = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
        doc, wide = np.cumsum(np.diff(ids, prepend=ids[:1]) != 0), int(w1.max()) + 2
        w0, w1, c0, c1 = _clip(doc, w0, w1, c0, c1, window, wide)
        if least is None:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, component, removed, w0, w1, c0, c1)], names=list(names[:-1]))
        group = 2 * doc + removed
        order = np.lexsort((w1, w0, group))
        ids, component, removed, w0, w1, c0, c1, group = (c[order] for c in (ids, component, removed, w0, w1, c0, c1, group))
        opens = np.ones(len(ids), bool)
        opens[1:] = group[1:] * wide + w0[1:] > np.maximum.accumulate(group * wide + w1)[:-1]
        at = np.flatnonzero(opens)
        n_words = np.maximum.reduceat(w1, at) - w0[at]
        columns = [ids[at], np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at), n_words, removed[at], np.minimum.reduceat(component, at)]
        return pa.RecordBatch.from_arrays([pa.array(c[n_words >= least]) for c in columns], names=["doc_id", "start", "stop", "n_words", "removed", "component_id"])

    def run(batches):
        held = []  # hits of the document that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_numpy()
            at = int(np.searchsorted(ids, ids[-1]))
            if held and (at or held[0].column("doc_id")[0].as_py() != ids[0]):
                done = pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks().to_batches()
                held = []
                yield work(done[0])
            elif at:
                yield work(batch.slice(0, at))
            held.append(batch.slice(at))
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _dealt(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", "component", "removed", "w0", "w1", "c0", "c1", "window").repartition("doc_id").sortWithinPartitions("doc_id")


def _clipped(hits: DataFrame) -> DataFrame:
    """Hits, of windows only the words between the first and the last that repeat exactly.

    A window that is near another may begin or end with a few words beyond what they share. A changed word lies between
    words that repeat; a window without any stays whole.
    """
    return _dealt(hits).mapInArrow(_by_document(None), _CLIPPED)


def repeated_runs(docs: DataFrame, least: int = RUN, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """``(doc_id, start, stop, n_words, removed, component_id)``: runs of words that other documents repeat.

    start and stop are code points of the text, stop exclusive. A run is removed unless its document has
    the smallest id among those that hold its paragraphs. component_id is shared by what is near or equal.
    Runs of fewer than ``least`` words are not reported. A document is all rows with its doc_id, so
    repeated rows repeat nothing; rows with a null doc_id, text or words have no runs. Case of A-Z is
    ignored, other columns are. An empty table gives no rows. With no ``bands`` only what repeats exactly is found.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    paragraphs = stage(texts.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_paragraphs(bands, percent), "doc_id long, fp long, points long, words long, beside int, owner long, keys array<long>, near array<long>"), "paragraphs")
    repeated = stage(meetings(paragraphs.select("fp", "doc_id")).select(F.col("key").alias("fp"), F.col("least").alias("first")), "repeated")

    lines = paragraphs.where("keys is not null")
    leaders = stage(leader_pairs(lines), "leaders")
    local = stage(lines.where("near is not null").select(F.col("fp").alias("a"), F.explode("near").alias("b")).distinct(), "local")
    ends = leaders.select("a", "b").unionByName(local).select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    found = lines.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min_by("points", "doc_id").alias("points"))
    found = stage(found.select("fp", "doc_id", F.shiftright("points", 32).cast("int").alias("start"), F.expr("cast(points & 4294967295 as int)").alias("stop")), "line-classes")
    members = leaders.select(F.col("a").alias("grp"), F.col("b").alias("fp"))
    star = compare_groups(texts, found, leaders.select(F.col("a").alias("grp"), F.col("a").alias("fp")), members, percent).unionByName(local)
    # Of two lines in a band, both are joined with its leader, or one of them is held against the other.
    reached = stage(connected_components(star, "a", "b"), "reached")
    own, led = (reached.select(F.col("node").alias(k), F.col("component").alias(c)) for k, c in (("fp", "own"), ("grp", "led")))
    apart = members.join(own, "fp", "left").join(led, "grp", "left").where("not coalesce(own = led, false)").select("grp", "fp")
    # One that has its leader for itself has been held against it.
    several = members.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1")
    apart = stage(apart.join(several, "grp", "left_semi"), "apart")
    inner = compare_groups(texts, found, apart, members.join(apart.select("grp").distinct(), "grp", "left_semi"), percent)
    joined = connected_components(star.unionByName(inner), "a", "b").join(found.select(F.col("fp").alias("node"), "doc_id"), "node")
    several = joined.groupBy("component").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high").drop("high")
    near = joined.join(several, "component").select(F.col("node").alias("fp"), "component", F.col("low").alias("near_first"))
    repeated = repeated.join(near, "fp", "full").select("fp", F.coalesce("component", "fp").alias("component"), F.least("first", "near_first").alias("keeper"))
    repeated = stage(repeated, "repeated")

    release(texts.sparkSession)  # what the comparison of lines has moved
    hits = paragraphs.join(repeated.hint("shuffle_hash"), "fp").select("fp", "beside", "doc_id", "component", (F.col("doc_id") != F.col("keeper")).alias("removed"), F.shiftright("words", 32).alias("w0"), F.expr("words & 4294967295").alias("w1"), F.shiftright("points", 32).alias("c0"), F.expr("points & 4294967295").alias("c1"))
    hits = stage(hits, "hits")
    unstage(paragraphs)
    hits = hits.withColumn("window", F.col("fp").bitwiseAND(3) == INSIDE).drop("fp", "beside").unionByName(_extended(texts, hits).withColumn("window", F.lit(False)))
    # Hits are clipped as _clipped says, and joined where they touch.
    return _dealt(hits).mapInArrow(_by_document(least), "doc_id long, start long, stop long, n_words long, removed boolean, component_id long")


def strip_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` with the removed runs cut out of their texts; all columns stay, rows without runs as they are."""
    cut = runs.where("removed").groupBy(F.col("doc_id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_gone"))
    kept = F.expr("""concat(aggregate(_gone, struct(0L as at, '' as kept), (s, x) -> struct(greatest(s.at, x.stop) as at,
        concat(s.kept, if(x.start > s.at, substring(text, cast(s.at as int) + 1, cast(x.start - s.at as int)), '')) as kept), s -> s.kept),
        substring(text, cast(array_max(transform(_gone, x -> x.stop)) as int) + 1))""")
    joined = docs.join(cut, docs["doc_id"] == cut["_of"], "left")
    return joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
