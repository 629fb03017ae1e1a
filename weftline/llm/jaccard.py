"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

Similar documents are first brought into groups: each MinHash key names as leader the document
whose keys are the most common, and verified links to leaders are closed into components. The
matrix then holds, for every group, the union of its members' prefix tokens. A document's overlap
with a group's union bounds its overlap with each member, so only groups whose bound suffices are
opened, and only their members are compared, shingle by shingle.

Prefixes. In any order of the tokens, two sets that share at least ``o`` tokens share at least
``1 + s`` of their first ``size - o + 1 + s``. Order is by hash here, ``o`` is ``ceil(t * size)``
and ``s`` is ``SLACK`` of the size. Tokens that more than ``COMMON`` groups hold are left out of
the first matrix; a document that holds so many of them that it could share nothing else goes to a
second matrix over whole sets, where the rarest tokens come first. Together they miss no link.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.components import connected_components
from weftline.llm.meetings import meetings
from weftline.llm.words import WordHashes, fingerprint, minhash_keys, mix, shingle_set, shingle_sets
from weftline.staging import release, stage, unstage

THRESHOLD = 80  # per cent
SLACK = 4  # per cent
COMMON = 32
KEYS = 5
LOOSE = 2  # keys shared with a leader that bring a document into its group
BLOCK = 256  # queries held at a time
SLICE = 500  # members that stream by them
PART = 1 << 19  # bytes of text that are compared at once
MEETINGS = 1 << 20  # tokens that queries and members share, counted at once


def need(size: int, percent: int = THRESHOLD) -> int:
    """Fewest shared tokens of a set of that size with a set that it links with."""
    return -(-percent * size // 100)


def prefix_length(size: int, percent: int = THRESHOLD) -> int:
    return size - need(size, percent) + 1 + SLACK * size // 100


def _sets(percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        cache, seen = WordHashes(), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sizes, fps, prefixes, new, pool = [], [], [], [], []
                for i, text in enumerate(part[2].to_pylist()):
                    s = shingle_set(text, cache)
                    fp = fingerprint(s) if len(s) else None
                    sizes.append(len(s))
                    fps.append(fp)
                    if fp is None or fp in seen:  # copies within a task carry their tokens once
                        prefixes.append(None)
                    else:
                        seen.add(fp)
                        prefixes.append(s[: prefix_length(len(s), percent)].view(np.int64))
                        new.append(i)
                        pool.append(s)
                keys: list = [None] * part.num_rows
                if pool:
                    first = np.cumsum([0, *map(len, pool[:-1])])
                    for i, row in zip(new, minhash_keys(np.concatenate(pool), first, KEYS).view(np.int64), strict=True):
                        keys[i] = row
                columns = [part[0], part[1], *(pa.array(v, schema.field(k).type) for k, v in (("n", sizes), ("fp", fps), ("keys", keys), ("prefix", prefixes)))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _spans(sizes: np.ndarray, most: int, rows: int | None = None) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` or so, or that are one row; of no more than ``rows`` rows."""
    out, done, ends = [], 0, np.cumsum(sizes)
    while done < len(sizes):
        end = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, side="right")))
        out.append((done, min(end, done + rows) if rows else end))
        done = out[-1][1]
    return out


def _overlaps(tokens: np.ndarray, owners: np.ndarray, sizes: np.ndarray, members: np.ndarray, counts: np.ndarray, percent: int):
    """(member, query) of all pairs that link, by member, then query; tokens and members' tokens of different deals differ."""
    order = np.argsort(tokens, kind="stable")
    owners = owners[order]
    index, first, several = np.unique(tokens[order], return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(index, members), len(index) - 1)
    hit = index[at] == members
    at, rows = at[hit], np.repeat(np.arange(len(counts)), counts)[hit]
    met = np.bincount(rows, several[at], len(counts)).astype(np.int64)
    ends = np.searchsorted(rows, np.arange(len(counts) + 1))
    for lo, hi in _spans(met, MEETINGS, max(1, MEETINGS // len(sizes))):
        part = at[ends[lo] : ends[hi]]
        n = several[part]
        where = np.repeat(first[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(np.repeat((rows[ends[lo] : ends[hi]] - lo) * len(sizes), n) + owners[where])
        pairs = np.flatnonzero(both)
        both, m, q = both[pairs], lo + pairs // len(sizes), pairs % len(sizes)
        links = 100 * both >= percent * (sizes[q] + counts[m] - both)
        yield from zip(m[links].tolist(), q[links].tolist(), strict=True)


def _compare(percent: int):
    """Each deal's queries come first and are held; its members stream by. All deals of a part are compared at once.

    Of the links found, only those are kept that join what the deal has not yet joined: no more than
    its rows, however many of its pairs are similar.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def find(root, x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def run(batches):
        # Of the deal that may go on: its key, what is joined, and its queries' nodes, tokens and sizes.
        last, root, nodes, held, sizes = None, {}, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            found = []
            text = batch.column("text").fill_null(b"")
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            for lo, hi in _spans(np.diff(offsets), PART, 2000):
                part = batch.slice(lo, hi - lo)
                *key, member, node = (part.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "block", "slice", "member", "fp"))
                raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[lo] : offsets[hi]]
                tokens, counts = shingle_sets(raw, offsets[lo : hi + 1] - offsets[lo])
                new = np.ones(len(node), bool)
                new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
                starts = np.flatnonzero(new)
                keys = [tuple(int(k[i]) for k in key) for i in starts]
                if keys[0] != last:
                    root, nodes, held, sizes = {}, nodes[:0], held[:0], sizes[:0]
                deal = np.cumsum(new) - 1
                roots = [root, *({} for _ in starts[1:])]
                # A deal's number goes into its tokens, so only those of the same deal meet.
                tags = mix((np.arange(len(starts), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                asks = np.repeat(~member, counts)
                q_deal = np.concatenate([np.zeros(len(nodes), np.int64), deal[~member]])
                q_nodes, q_sizes, q_tokens = np.concatenate([nodes, node[~member]]), np.concatenate([sizes, counts[~member]]), np.concatenate([held, tokens[asks]])
                owners = np.repeat(np.arange(len(q_nodes)), q_sizes)
                m_deal, m_nodes, m_counts = deal[member], node[member], counts[member]
                if len(q_tokens) and len(m_nodes):
                    tagged = tokens[~asks] ^ np.repeat(tags[m_deal], m_counts)
                    for m, q in _overlaps(q_tokens ^ tags[q_deal[owners]], owners, q_sizes, tagged, m_counts, percent):
                        root, a, b = roots[m_deal[m]], int(q_nodes[q]), int(m_nodes[m])
                        x, y = find(root, a), find(root, b)
                        if x != y:
                            root[x] = y
                            found.append((a, b))
                last, root, on = keys[-1], roots[-1], q_deal == len(starts) - 1
                nodes, held, sizes = q_nodes[on], q_tokens[on[owners]], q_sizes[on]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)

    return run


def _cut(batches):
    """Each wanted part of a text as a row."""
    for batch in batches:
        for start in range(0, batch.num_rows, 50):
            part = batch.slice(start, 50)
            lists = part.column("parts")
            fields = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten(), strict=True))
            lengths = lists.value_lengths().to_pylist()
            pieces, at, begins, ends = [], 0, fields["start"].to_pylist(), fields["stop"].to_pylist()
            for text, n in zip(part.column("text").to_pylist(), lengths, strict=True):
                pieces += [text[a:b] for a, b in zip(begins[at : at + n], ends[at : at + n], strict=True)] if text is not None else [None] * n
                at += n
            yield pa.RecordBatch.from_arrays([*(fields[k] for k in ("grp", "block", "slice", "member", "fp")), pa.array(pieces, pa.string())], names=["grp", "block", "slice", "member", "fp", "text"])


def compare_groups(texts: DataFrame, classes: DataFrame, queries: DataFrame, members: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that join the ``queries`` of each group with its ``members`` (both grp, fp).

    A group is dealt out as blocks of queries against slices of members, so texts are moved once a
    block or slice, never once a pair, and one large group is compared by many tasks. ``classes`` has fp
    and the columns by which its text is found in ``texts``, and start and stop if it is a part of it.
    """
    sides = {}
    for name, rows, most in (("q", queries, BLOCK), ("m", members, SLICE)):
        rows = stage(rows.select("grp", "fp").distinct(), "side")
        sides[name] = rows, rows.groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias(f"{name}_parts"))
    parts = stage(sides["q"][1].join(sides["m"][1], "grp"), "parts")
    own = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = sides["q"][0].join(parts, "grp").select("grp", own("q_parts").alias("block"), each("m_parts").alias("slice"), F.lit(False).alias("member"), "fp")
    m = sides["m"][0].join(parts, "grp").select("grp", each("q_parts").alias("block"), own("m_parts").alias("slice"), F.lit(True).alias("member"), "fp")
    keys = [c for c in classes.columns if c in texts.columns]
    wanted = q.unionByName(m).join(classes, "fp").withColumnsRenamed({k: f"want_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"want_{k}")) for k in keys])
    if "start" in classes.columns:  # a text comes once, however many of its parts are wanted
        parts = F.struct("grp", "block", "slice", "member", "fp", "start", "stop")
        wanted = wanted.groupBy(*[f"want_{k}" for k in keys]).agg(F.collect_list(parts).alias("parts"))
        rows = texts.join(wanted.hint("shuffle_hash"), same).select(F.col("text").cast("string").alias("text"), "parts").mapInArrow(_cut, "grp long, block int, slice int, member boolean, fp long, text string")
    else:
        rows = texts.join(wanted.hint("shuffle_hash"), same)
    dealt = rows.select("grp", "block", "slice", "member", "fp", F.col("text").cast("binary").alias("text")).repartition("grp", "block", "slice").sortWithinPartitions("grp", "block", "slice", "member")
    return stage(dealt.mapInArrow(_compare(percent), "a long, b long"), "links")


def leader_pairs(sets: DataFrame) -> DataFrame:
    """(leader, member, keys they share) for the leaders of all MinHash keys that several classes hold.

    Where sets have an ``owner``, keys that only rows of one owner hold are left out: the owner has compared these itself.
    """
    # Keys are moved once: what is distinct, counted and joined lies by key.
    if "owner" in sets.columns:
        keys = meetings(sets.where("keys is not null").select("keys", "owner", "fp")).select(F.col("item").alias("fp"), "key").repartition("key")
    else:
        keys = sets.where("keys is not null").select("fp", F.explode("keys").alias("key")).repartition("key").distinct()
    common = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = stage(keys.join(common.hint("shuffle_hash"), "key"), "keys")
    fame = shared.groupBy("fp").agg(F.sum("c").alias("fame"))
    leaders = shared.join(fame, "fp").groupBy("key").agg(F.max(F.struct("fame", "fp"))["fp"].alias("a"))
    return shared.join(leaders, "key").where("a != fp").groupBy("a", F.col("fp").alias("b")).agg(F.count("*").alias("keys"))


def _opened(matrix: DataFrame, least: str) -> DataFrame:
    """(fp, other): a document and a group to compare, by its tokens in the union of each larger group.

    The matrix has token, fp, n, g, members (of g) and common. Of two groups, the one with fewer members
    asks, so stragglers of a large group are held against it and not its members against each of them.
    ``least`` is the fewest shared tokens (an expression over n and common) that opens a group.
    """
    unions = matrix.select("token", F.struct("members", "g").alias("union")).distinct()
    bound = matrix.join(unions, "token").where(F.struct("members", "g") < F.col("union")).withColumn("other", F.col("union.g")).groupBy("fp", "other").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("common").alias("common"))
    return bound.where(F.expr(f"shared >= {least}")).select("fp", "other")


def _full_tokens(percent: int):
    schema = pa.schema([("fp", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sets = [shingle_set(t, cache).view(np.int64) for t in part[1].to_pylist()]
                yield pa.RecordBatch.from_arrays([part[0], pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def jaccard_components(docs: DataFrame, percent: int = THRESHOLD, common: int = COMMON, keep_hash: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (doc_id, text).

    n_shingles is the size of the row's set of distinct 5-word shingles, component_id the smallest
    doc_id that chains of links (Jaccard of at least ``percent``/100) reach.

    A null, empty or blank text has an empty set, links with nothing and keeps its own doc_id. Rows
    with equal sets are one class and always linked, so repeated rows and copies cost one comparison
    of fingerprints. A null doc_id gets the smallest id of its component, null if it has none. Other
    columns are ignored; an empty table gives no rows. ``keep_hash`` adds ``th``, the text's hash. Sets
    are compared by 64-bit shingle hashes and classes by a 64-bit
    fingerprint.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    source = texts.select("doc_id", "th", F.col("text").cast("binary").alias("text"))
    sets = stage(source.mapInArrow(_sets(percent), "doc_id long, th long, n long, fp long, keys array<long>, prefix array<long>"), "sets")
    narrow = stage(sets.select("doc_id", "th", "n", "fp"), "rows")
    if narrow.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        texts = stage(texts.dropDuplicates(["doc_id", "th"]), "texts")  # rows that repeat are read and moved once
    classes = stage(narrow.where("fp is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"), F.max("n").alias("n")), "classes")
    found_by = classes.select("fp", "rep.doc_id", "rep.th")
    leaders = stage(leader_pairs(sets), "leaders")
    star = compare_groups(texts, found_by, leaders.select(F.col("a").alias("grp"), F.col("a").alias("fp")), leaders.select(F.col("a").alias("grp"), F.col("b").alias("fp")), percent)
    # A group: what verified links join, and those that share keys with a leader though no link.
    alone = leaders.where(F.col("keys") >= LOOSE).join(star.select(F.explode(F.array("a", "b")).alias("b")).distinct(), "b", "left_anti")
    loose = stage(alone.groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a")), "loose")
    groups = stage(connected_components(star.unionByName(loose.select("a", "b")), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("g")), "groups")
    inner = compare_groups(texts, found_by, groups.join(loose, F.col("fp") == F.col("b"), "left_semi").withColumnRenamed("g", "grp"), groups.withColumnRenamed("g", "grp"), percent)

    release(texts.sparkSession)  # the texts that were moved for comparison

    tokens = sets.where("prefix is not null").select("fp", F.explode("prefix").alias("token")).repartition("token")
    crossing = tokens.groupBy("token").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x != y").select(F.col("token").alias("t"))
    shared = tokens.join(crossing.hint("shuffle_hash"), F.col("token") == F.col("t")).select("token", "fp").distinct()
    shared = shared.join(groups, "fp", "left").join(classes.select("fp", "n"), "fp").select("token", "fp", "n", F.coalesce("g", "fp").alias("g"))
    shared = stage(shared, "shared")
    del tokens, crossing
    unstage(sets)
    release(texts.sparkSession)  # the tokens of all documents
    per_token = shared.select("token", "g").distinct().groupBy("token").agg(F.count("*").alias("in_groups")).where("in_groups > 1")
    matrix = stage(shared.join(per_token, "token"), "matrix")
    unstage(shared)

    counts = groups.groupBy("g").agg(F.count("*").alias("members"))
    sized = lambda rows: rows.join(counts, "g", "left").fillna(1, ["members"])
    held = matrix.where(F.col("in_groups") > common).groupBy("fp").agg(F.count("*").alias("common"))
    light = matrix.where(F.col("in_groups") <= common).join(held, "fp", "left").fillna(0, ["common"])
    fewest = f"1 + ({SLACK} * (({percent} * n + 99) div 100)) div 100"
    opened = _opened(sized(light), f"greatest(1, {fewest} - common)")

    full = stage(held.join(classes.select("fp", "n"), "fp").where(F.expr(f"common >= {fewest}")).select("fp", "n"), "full")
    if full.limit(1).count():
        opened = opened.unionByName(_full_opened(texts, classes, full, groups, sized, percent))
    opened = stage(opened.distinct(), "opened")
    release(texts.sparkSession)
    members = classes.join(groups, "fp", "left").select(F.coalesce("g", "fp").alias("grp"), "fp")
    links = compare_groups(texts, found_by, opened.select(F.col("other").alias("grp"), "fp"), members.join(opened.select(F.col("other").alias("grp")).distinct(), "grp", "left_semi"), percent)

    linked = connected_components(star.unionByName(inner).unionByName(links), "a", "b").select(F.col("node").alias("fp"), "component")
    known = classes.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    final = known.join(lowest, "component").select(F.col("fp").alias("class"), "component_id")
    unstage(matrix)
    return narrow.join(final, F.col("fp") == F.col("class"), "left").select("doc_id", *["th"] * keep_hash, F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _full_opened(texts: DataFrame, classes: DataFrame, full: DataFrame, groups: DataFrame, sized, percent: int) -> DataFrame:
    """(fp, other) for the classes in ``full``, from prefixes of whole sets, rarest tokens first."""
    want = full.join(classes.select("fp", "rep"), "fp").select("fp", F.col("rep.doc_id").alias("want_id"), F.col("rep.th").alias("want_th"))
    rows = texts.join(want.hint("shuffle_hash"), F.col("th").eqNullSafe(F.col("want_th")) & F.col("doc_id").eqNullSafe(F.col("want_id")))
    whole = rows.select("fp", F.col("text").cast("binary").alias("text")).mapInArrow(_full_tokens(percent), "fp long, tokens array<long>")
    each = stage(whole.select("fp", F.explode("tokens").alias("token")).distinct().join(groups, "fp", "left").select("fp", "token", F.coalesce("g", "fp").alias("g")), "full-tokens")
    frequency = each.select("token", "g").distinct().groupBy("token").agg(F.count("*").alias("df"))
    # With the slack, two documents that link share so many tokens of their prefixes that a group must hold.
    fewest = f"1 + ({SLACK} * (({percent} * n + 99) div 100)) div 100"
    ordered = each.join(frequency, "token").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order"), F.min("g").alias("g"))
    first = ordered.join(full, "fp").select("fp", "n", "g", F.explode(F.expr(f"slice(`order`, 1, cast(n - ({percent} * n + 99) div 100 + 1 + {SLACK} * n div 100 as int))")).alias("e")).where("e.df > 1")
    return _opened(stage(sized(first.select(F.col("e.token").alias("token"), "fp", "n", "g", F.lit(0).alias("common"))), "full-matrix"), fewest)
