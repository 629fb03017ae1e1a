"""Bounded breadth-first traversals, a level at a time, over edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.staging import stage


def link_bfs(links: DataFrame, seed: object, depth: int = 1, rels: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``depth`` out-edges of a seed over links (src, dst, rel).

    nodes are (id, depth); an edge to a node already met is reported all the same. The edge table is read
    once a level, joined with that level's new nodes; levels are staged.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth is from 1 to 3")
    kept = links.where(F.col("rel").isin(list(rels))) if rels else links
    seen = kept.sparkSession.createDataFrame([(seed, 0)], f"id {dict(links.dtypes)['src']}, depth int")
    edges, frontier = None, seen
    for level in range(1, depth + 1):
        out = stage(kept.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "rel"), "hop")
        edges = out if edges is None else edges.unionByName(out)
        frontier = stage(out.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(level).alias("depth")), "level")
        seen = seen.unionByName(frontier)
    return seen, edges


def call_bfs(calls: DataFrame, seed: str, direction: str = "callees", depth: int = 3, max_edges: int = 200, key: Sequence[str] = ("caller", "callee")) -> tuple[DataFrame, dict]:
    """(edges with depth and paths, report) from a seed along calls (caller, callee, ...).

    Equal edges of a level are one, with the number of times it was met as paths. A level that would bring
    the edges over ``max_edges`` is dropped whole and ends the walk, but the first is always kept.
    """
    if depth > 10:
        raise ValueError("depth is at most 10")
    here, there = ("caller", "callee") if direction == "callees" else ("callee", "caller")
    kind = dict(calls.dtypes)[here]
    seen = frontier = calls.sparkSession.createDataFrame([(seed,)], f"n {kind}")
    edges, total, report = None, 0, {"truncated": False, "truncated_at_depth": None, "max_depth": 0}
    for level in range(1, depth + 1):
        met = calls.join(frontier.withColumnRenamed("n", here), here, "left_semi").groupBy(*key).agg(F.count("*").alias("paths")).withColumn("depth", F.lit(level))
        met = stage(met, "hop")
        size = met.count()
        if level > 1 and total and total + size > max_edges:
            report.update(truncated=True, truncated_at_depth=level)
            break
        edges, total = met if edges is None else edges.unionByName(met), total + size
        report["max_depth"] = level
        frontier = stage(met.select(F.col(there).alias("n")).distinct().join(seen, "n", "left_anti"), "level")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return edges, report


def histogram(edges: DataFrame) -> DataFrame:
    """Edges by depth."""
    return edges.groupBy("depth").agg(F.count("*").alias("edges"), F.sum("paths").alias("paths"))


def neighbours(links: DataFrame, anchor: object) -> DataFrame:
    """(id, direction) one hop either way."""
    return links.where(F.col("src") == anchor).select(F.col("dst").alias("id"), F.lit("out").alias("direction")).unionByName(links.where(F.col("dst") == anchor).select(F.col("src").alias("id"), F.lit("in").alias("direction"))).distinct()


def unique_match(symbols: DataFrame, name: str) -> DataFrame:
    """One row (verdict, name_path): ok, ambiguous or missing for a symbol name, an exact path winning over the rest."""
    hits = symbols.where((F.col("name_path") == name) | F.col("name_path").endswith("/" + name)).agg(
        F.count("*").alias("n"), F.count_if(F.col("name_path") == name).alias("exact"), F.min("name_path").alias("first"))
    return hits.select(F.when(F.col("n") == 0, "missing").when(F.col("exact") == 1, "ok").when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("verdict"), F.when(F.col("exact") == 1, F.lit(name)).when(F.col("n") == 1, F.col("first")).alias("name_path"))


def with_events(nodes: DataFrame, edges: DataFrame, events: DataFrame, event_edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A link graph with the events of its artifacts, their out-edges, and the sources that these reach, each once."""
    mine = events.join(nodes.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")
    out = event_edges.join(mine.select(F.col("id").alias("src_event_id")), "src_event_id", "left_semi")
    text = lambda c: F.col(c).cast("string")
    reached = out.where("dst_event_id is null and dst_artifact_id is null and dst_source_id is not null").select(F.col("dst_source_id").alias("id")).distinct()
    rows = nodes.select(F.lit("artifact").alias("node_type"), text("id").alias("id")).unionByName(mine.select(F.lit("event").alias("node_type"), text("id").alias("id")).distinct())
    rows = rows.unionByName(sources.join(reached, "id", "left_semi").select(F.lit("source").alias("node_type"), text("id").alias("id")))
    more = out.select(text("src_event_id").alias("src"), F.coalesce(text("dst_event_id"), text("dst_artifact_id"), text("dst_source_id")).alias("dst"), "rel")
    return rows, edges.select(text("src").alias("src"), text("dst").alias("dst"), "rel").unionByName(more)


def rendered(edges: DataFrame, total: int, full: bool = False, most: int = 30) -> DataFrame:
    """The edges themselves if they are few or asked for, else their histogram."""
    return edges if full or total <= most else histogram(edges)


def directed(links: DataFrame, anchor: object, direction: str = "both", rels: Sequence[str] = ()) -> DataFrame:
    """Links out of, into, or on either side of an anchor, of the named relations."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    kept = links.where(F.col("rel").isin(list(rels))) if rels else links
    test = {"out": F.col("src") == anchor, "in": F.col("dst") == anchor, "both": (F.col("src") == anchor) | (F.col("dst") == anchor)}
    return kept.where(test[direction])


def successor(events: DataFrame) -> DataFrame:
    """(id, superseded_by): the direct successor that the last such event names; chains are not followed."""
    rows = events.where("kind = 'superseded_by'")
    return rows.groupBy(F.col("artifact_id").alias("id")).agg(F.max_by(F.get_json_object("payload", "$.target_artifact_id"), F.struct("created_at", "id")).alias("superseded_by"))
