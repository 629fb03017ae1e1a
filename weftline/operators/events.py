"""An append-only event log: folds as of a moment, freshness, timelines and links between events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("note", "status_change", "field_patch", "reviewed", "superseded_by", "intent", "verdict", "mutation")
REQUIRED = {"status_change": ("to",), "field_patch": ("field", "to"), "superseded_by": ("target_artifact_id",), "intent": ("text",), "verdict": ("outcome",)}
HORIZON = 50


def _text(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def fold(events: DataFrame, until: Column | None = None) -> DataFrame:
    """What the events (id, artifact_id, kind, payload, created_at) of each artifact up to a moment add up to.

    Columns: artifact_id, status (last change), patches (map of field to last value), reviewed_at,
    superseded_by (last target), latest_kind, latest_id, latest_at. Events at the same moment go by id. Two
    map-side combined aggregates; no event list is gathered.
    """
    at = F.struct("created_at", "id")
    kept = events if until is None else events.where(F.col("created_at") <= until)
    kept = kept.withColumns({"to": _text("to"), "field": F.when(F.col("kind") == "field_patch", _text("field")), "target": _text("target_artifact_id"), "at": at})
    last = lambda value, when: F.max_by(value, F.when(when, F.col("at")))
    facts = kept.groupBy("artifact_id").agg(
        last("to", (F.col("kind") == "status_change") & F.col("to").isNotNull()).alias("status"),
        F.max(F.when(F.col("kind") == "reviewed", F.col("created_at"))).alias("reviewed_at"),
        last("target", F.col("kind") == "superseded_by").alias("superseded_by"),
        F.max_by("kind", "at").alias("latest_kind"), F.max_by("id", "at").alias("latest_id"), F.max("created_at").alias("latest_at"),
    )
    patches = kept.where("field is not null and to is not null").groupBy("artifact_id", "field").agg(F.max_by("to", "at").alias("to"))
    patches = patches.groupBy("artifact_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "to")))).alias("patches"))
    return facts.join(patches, "artifact_id", "left")


def freshness(latest_kind: Column, reviewed_at: Column, changed_at: Column, distance: Column | None = None, horizon: int = HORIZON) -> Column:
    """superseded, unknown (never reviewed), stale (changed since, or too far behind) or fresh, in that order."""
    out = F.when(latest_kind == "superseded_by", "superseded").when(reviewed_at.isNull(), "unknown").when(changed_at > reviewed_at, "stale")
    if distance is not None:
        out = out.when(distance > horizon, "stale")
    return out.otherwise("fresh")


def state_at(artifacts: DataFrame, events: DataFrame, until: Column) -> DataFrame:
    """Artifacts (id, status, file_mtime) with their state as of a moment: fields that no event had patched hold their present value."""
    was = fold(events, until)
    rows = artifacts.join(was.select(F.col("artifact_id").alias("id"), F.col("status").alias("status_then"), "patches", "reviewed_at", "superseded_by", "latest_kind", "latest_id"), "id", "left")
    patched = F.try_element_at("patches", F.lit("status"))
    rows = rows.withColumn("status_as_of", F.coalesce("status_then", patched, "status"))
    return rows.withColumn("freshness", freshness(F.col("latest_kind"), F.col("reviewed_at"), F.col("file_mtime")))


def timeline(events: DataFrame, artifact: object, kinds: Sequence[str] = (), until: object = None, since: object = None, limit: int = 50) -> DataFrame:
    """Newest first. ``since`` is applied after the limit, as readers of the log expect."""
    rows = events.where(F.col("artifact_id") == F.lit(artifact))
    if kinds:
        rows = rows.where(F.col("kind").isin(list(kinds)))
    if until is not None:
        rows = rows.where(F.col("created_at") <= F.lit(until))
    rows = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return rows if since is None else rows.where(F.col("created_at") >= F.lit(since))


def with_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with what their edges (src_event_id, dst_event_id, dst_artifact_id, dst_source_id, rel) say by relation."""
    first = lambda rel, column: F.min(F.when(F.col("rel") == rel, F.col(column)))
    out = edges.groupBy(F.col("src_event_id").alias("id")).agg(
        first("parent", "dst_event_id").alias("parent_event_id"), first("triggered_by", "dst_source_id").alias("triggered_by_source"),
        F.array_sort(F.collect_set(F.when(F.col("rel") == "mutates", F.col("dst_artifact_id")))).alias("mutates"), first("resolves", "dst_event_id").alias("resolves_intent_id"),
    )
    back = edges.where("rel = 'resolves'").groupBy(F.col("dst_event_id").alias("id")).agg(F.min("src_event_id").alias("resolved_by_verdict_id"))
    return rows.join(out, "id", "left").join(back, "id", "left")


def parents(events: DataFrame) -> DataFrame:
    """Each event with the one before it on its artifact."""
    return events.withColumn("parent_id", F.lag("id").over(W.partitionBy("artifact_id").orderBy("created_at", "id")))


def open_intents(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Intents that no verdict resolves."""
    return events.where("kind = 'intent'").join(edges.where("rel = 'resolves'").select(F.col("dst_event_id").alias("id")), "id", "left_anti")


def orphan_verdicts(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Verdicts that resolve nothing."""
    return events.where("kind = 'verdict'").join(edges.where("rel = 'resolves'").select(F.col("src_event_id").alias("id")), "id", "left_anti")


def payload_error() -> Column:
    """What is wrong with an event's kind or payload; null if nothing is."""
    k = F.col("kind")
    out = F.when(~k.isin(*KINDS) | k.isNull(), F.concat(F.lit("unknown kind "), F.coalesce(k, F.lit("null"))))
    for name, needed in REQUIRED.items():
        for key in needed:
            out = out.when((k == name) & _text(key).isNull(), F.lit(f"{name} needs {key}"))
    return out


def cutoff_of_commit(commits: DataFrame, prefix: str) -> DataFrame:
    """One row (matches, cutoff): the time of the commit with a hash prefix, null unless exactly one fits."""
    hits = commits.where(F.col("hash").startswith(prefix))
    return hits.agg(F.count("*").alias("matches"), F.when(F.count("*") == 1, F.max("authored_at")).alias("cutoff"))


def topo_distance(commits: DataFrame, a: str, b: str) -> DataFrame:
    """One row (distance): how far apart two commits are in topological order; null if either is unknown."""
    at = lambda h: F.max(F.when(F.col("hash") == h, F.col("topo_order")))
    return commits.where(F.col("hash").isin(a, b)).agg(F.abs(at(a) - at(b)).alias("distance"))
