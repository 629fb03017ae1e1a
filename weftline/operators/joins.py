"""Keyed reconciliation: merges, drift, staleness and set differences as joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in key])


def merge_keyed(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``new`` over ``old`` by key: new rows win, but for the ``keep`` columns, which an old row's value holds."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    both = o.join(n, on, "full")
    fresh = reduce(lambda a, b: a | b, [F.col(f"n.{k}").isNotNull() for k in key])
    value = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep or c in key else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[value(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` and those of ``new`` whose key it lacks, one a key."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti").select(old.columns))


def replace_keyed(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new, list(key), "left_anti").select(old.columns).unionByName(new)


def sweep(rows: DataFrame, seen: DataFrame, key: str, in_scope: Column) -> DataFrame:
    """Rows within the scope that were seen, and all rows outside it."""
    return rows.where(~F.coalesce(in_scope, F.lit(False))).unionByName(rows.where(in_scope).join(seen, key, "left_semi").select(rows.columns))


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, Sequence[str]]], key: str) -> dict[str, DataFrame]:
    """Each table without the rows that refer to a deleted key by any of the named columns."""
    ids = gone.select(F.col(key).alias("gone")).distinct()
    cut = lambda df, c: df.join(ids, F.col(c) == F.col("gone"), "left_anti")
    return {name: reduce(cut, columns, df) for name, (df, columns) in tables.items()}


def drift(local: DataFrame, server: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert, ids to delete): what each side lacks."""
    return local.join(server, key, "left_anti"), server.join(local, key, "left_anti").select(key)


def diff_snapshots(old: DataFrame, new: DataFrame, path: str = "path", content: str = "hash") -> DataFrame:
    """(path, change, old_path): added, modified, deleted, and renamed where a deleted content is added elsewhere once."""
    o = old.select(F.col(path).alias("p"), F.col(content).alias("was"))
    n = new.select(F.col(path).alias("q"), F.col(content).alias("now"))
    both = o.join(n, F.col("p") == F.col("q"), "full")
    change = F.when(F.col("p").isNull(), "added").when(F.col("q").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    rows = both.select(F.coalesce("q", "p").alias("path"), change.alias("change"), F.coalesce("now", "was").alias("content")).where("change is not null")
    added, gone = rows.where("change = 'added'"), rows.where("change = 'deleted'")
    first = lambda df, name: df.groupBy("content").agg(F.min("path").alias(name))
    moved = first(added, "new_path").join(first(gone, "old_path"), "content")
    out = rows.join(moved.select(F.col("new_path").alias("path"), "old_path"), "path", "left")
    out = out.join(moved.select(F.col("old_path").alias("dropped")), (F.col("path") == F.col("dropped")) & (F.col("change") == "deleted"), "left_anti")
    return out.select("path", F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), "old_path")


def anchor_state(anchors: DataFrame, current: DataFrame) -> DataFrame:
    """Each anchor (path, hash) against current (path, hash): fresh, changed or deleted."""
    now = current.select(F.col("path").alias("at"), F.col("hash").alias("now"))
    state = F.when(F.col("at").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("hash")), "fresh").otherwise("changed")
    return anchors.join(now, F.col("path") == F.col("at"), "left").select(*anchors.columns, state.alias("state"))


def delta(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value is another one than before, with both; a key that is new was ``(new)``."""
    old = before.select(F.col(key).alias("k"), F.col(value).alias("old"), F.lit(True).alias("known"))
    rows = now.join(old, F.col(key) == F.col("k"), "left").where(F.col("known").isNull() | ~F.col("old").eqNullSafe(F.col(value)))
    return rows.select(key, F.when(F.col("known").isNull(), F.lit("(new)")).otherwise(F.col("old")).alias("was"), F.col(value).alias("now"))


def upsert_commits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Commits (hash, authored_at, subject, topo_order): new ones win, but an old order stays where the new one has none."""
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    fresh = F.col("n.hash").isNotNull()
    own = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return o.join(n, F.col("o.hash") == F.col("n.hash"), "full").select(pick("hash"), own("authored_at"), own("subject"), pick("topo_order"))


def orphan_sweep(rows: DataFrame, path: str, scope: Sequence[str], active: Sequence[str]) -> DataFrame:
    """Rows but those below a scope root and below no active root; nothing goes where either list is empty."""
    if not scope or not active:
        return rows
    under = lambda roots: reduce(lambda a, b: a | b, [F.col(path).startswith(r.rstrip("/") + "/") for r in roots])
    return rows.where(F.coalesce(~under(scope) | under(active), F.lit(True)))


def create_links(links: DataFrame, new: DataFrame, artifacts: DataFrame, now: int) -> dict[str, DataFrame]:
    """Links (src, dst, rel) added where both ends exist; ``supersedes`` marks dst and logs an event on src.

    Gives links, rejected, artifacts and events.
    """
    ids = artifacts.select("id")
    good = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "rel")
    over = good.where("rel = 'supersedes'")
    marked = over.select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(True))
    kept = artifacts.join(marked, "id", "left").withColumn("status", F.when(F.col("hit"), "superseded").otherwise(F.col("status"))).select(artifacts.columns)
    return {
        "links": insert_ignore(links, good, ["src", "dst", "rel"]),
        "rejected": new.join(good, ["src", "dst", "rel"], "left_anti"),
        "artifacts": kept,
        "events": over.select(F.col("src").alias("artifact_id"), F.lit("superseded_by").alias("kind"), F.to_json(F.struct(F.col("dst").alias("target_artifact_id"))).alias("payload"), F.lit(now).alias("created_at")),
    }


def create_events(events: DataFrame, new: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) of new events (id, artifact_id, kind, payload, created_at, resolves).

    Kind and payload must be in order; a verdict resolves an intent that exists and that no earlier verdict has
    resolved. Accepted ones get the event before them on their artifact as parent.
    """
    from pyspark.sql import Window as W

    from weftline.operators.events import payload_error

    taken = edges.where("rel = 'resolves'").select(F.col("dst_event_id").alias("resolves"), F.lit(True).alias("taken")).distinct()
    intents = events.where("kind = 'intent'").select(F.col("id").alias("resolves"), F.lit(True).alias("known"))
    first = F.row_number().over(W.partitionBy("resolves").orderBy("created_at", "id"))
    rows = new.withColumn("nth", first).join(taken, "resolves", "left").join(intents, "resolves", "left")
    verdict = F.col("kind") == "verdict"
    reason = F.coalesce(payload_error(), F.when(verdict & F.col("resolves").isNotNull() & F.col("known").isNull(), "no such intent").when(verdict & F.col("resolves").isNotNull() & (F.col("taken").isNotNull() | (F.col("nth") > 1)), "resolved before"))
    judged = rows.withColumn("reason", reason)
    columns = [c for c in new.columns if c != "resolves"]
    log = events.select(*columns, F.lit(None).cast("string").alias("_new")).unionByName(judged.where("reason is null").select(*columns, F.lit("x").alias("_new")))
    chained = log.withColumn("parent_event_id", F.lag("id").over(W.partitionBy("artifact_id").orderBy("created_at", "id"))).where("_new is not null").drop("_new")
    return chained, judged.where("reason is not null").select(*columns, "reason")


def first_seen_union(*parts: DataFrame) -> DataFrame:
    """Ids of several lists (id, position) in the order in which they are first seen."""
    rows = None
    for i, p in enumerate(parts):
        part = p.select("id", F.struct(F.lit(i).alias("list"), "position").alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.min("at").alias("at")).select("id", "at")


def group_candidates(rows: DataFrame) -> DataFrame:
    """Candidates (key, defect, defect_rank, tier, tokens, lines, score) as one a key: defects by rank, largest measures, best tier and score first."""
    out = rows.groupBy("key").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("defect_rank", "defect"))), lambda d: d["defect"]).alias("defects"), F.min("tier").alias("tier"),
        F.max("tokens").alias("tokens"), F.max("lines").alias("lines"), F.max("score").alias("score"),
    )
    return out.orderBy("tier", F.desc("score"), F.desc("tokens"), "key")
