"""Keys that rows of several owners hold. Tasks deal rows to shuffle partitions in packs, not one by one, as most hold a key of their own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACK = 1 << 18  # rows that a task deals at once

_LONGS = pa.list_(pa.int64())


def _packed(parts: int, items: bool):
    """Packs of (key, owner) or (key, owner, item) by ranges of keys; of equal keys in a pack, one row for each item or for the least and the largest owner."""
    names = ["part", "keys", "owners", *["items"] * items]

    def pack(held):
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.lexsort((*columns[1:], columns[0].view(np.uint64)))
        columns = [c[order] for c in columns]
        same = columns[0][1:] == columns[0][:-1]
        if items:
            keep = np.append(True, ~(same & (columns[1][1:] == columns[1][:-1]) & (columns[2][1:] == columns[2][:-1])))
        else:
            keep = np.append(True, ~same) | np.append(~same, True)
        columns = [c[keep] for c in columns]
        part = (((columns[0].view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        ends = pa.array(np.append(first, len(part)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(part[first]), *(pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns)], names=names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            key, *others = batch.columns
            others = [c.to_numpy() for c in others]
            if pa.types.is_list(key.type):
                n = key.value_lengths().to_numpy()
                key, others = key.flatten(), [np.repeat(c, n) for c in others]
            if len(key):
                held.append([key.to_numpy(), *others])
                rows += len(key)
            if rows >= PACK:
                yield pack(held)
                held, rows = [], 0
        if held:
            yield pack(held)

    return run


def _met(items: bool):
    """Of keys with several owners: (key, least owner); or all (key, item) of those that have several items, too."""

    def work(held):
        key, *others = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key)
        key, *others = (c[order] for c in (key, *others))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        least = np.minimum.reduceat(others[0], first)
        several = np.logical_and.reduce([np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first) for c in others])
        if not items:
            return [key[first][several], least[several]]
        there = np.repeat(several, np.diff(np.append(first, len(key))))
        key, item = key[there], others[1][there]
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        new = np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]))[: len(key)]
        return [key[new], item[new]]

    def run(batches):
        names = ["key", "item" if items else "least"]
        out = lambda held: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in work(held)], names=names)
        held, last = [], None
        for batch in batches:
            part = batch.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for lo, hi in zip(first, [*first[1:], len(part)], strict=False):
                if held and part[lo] != last:
                    yield out(held)
                    held = []
                last = part[lo]
                held.append([c.slice(lo, hi - lo).flatten().to_numpy() for c in batch.columns[1:]])
        if held:
            yield out(held)

    return run


def meetings(rows: DataFrame) -> DataFrame:
    """``(key, least)``: keys that rows of several owners hold, and the least owner, for rows of (key, owner).

    For rows of (key, owner, item), ``(key, item)``: the distinct items of keys that have several owners and several items. The key may be an array
    of keys, and must be a hash. A range of keys is held at a time, as many ranges as there are shuffle partitions; one key's distinct items are held by one task.
    """
    items = len(rows.columns) > 2
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(_packed(parts, items), "part int, keys array<long>, owners array<long>" + ", items array<long>" * items)
    dealt = dealt.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(_met(items), "key long, item long" if items else "key long, least long")
