"""Remembered items and gathered sources: recall, lists, context packs, staleness, index state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordering import budget_prefix
from weftline.operators.retrieval import knn


def recall(items: DataFrame, query: DataFrame, k: int = 5, bucket: str | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): nearest items (id, bucket, embedding), of one bucket if it is named, 2 decimals."""
    pool = items if bucket is None else items.where(F.col("bucket") == bucket)
    return knn(pool.select("id", "embedding"), query, k, "cosine").withColumn("similarity", F.round(1 - F.col("distance"), 2))


def listed(items: DataFrame, bucket: str | None = None, anchor: str | None = None, limit: int = 50) -> DataFrame:
    """Items by newest update, of a bucket and with an anchor path if they are named."""
    rows = items if bucket is None else items.where(F.col("bucket") == bucket)
    if anchor is not None:
        rows = rows.where(F.exists("anchors", lambda a: a["path"] == anchor))
    return rows.orderBy(F.desc("updated_at"), "id").limit(limit)


def context_pack(candidates: DataFrame, max_tokens: int) -> DataFrame:
    """Candidates (id, kind, augmented, position, body) by priority, trackers, augmented, then the rest, within a budget of 4 characters a token."""
    first = candidates.groupBy("id").agg(F.min_by(F.struct("kind", "augmented", "body", "position"), "position").alias("c")).select("id", "c.*")
    priority = F.when(F.col("kind") == "tracker", 0).when(F.col("augmented"), 1).otherwise(2)
    rows = first.withColumns({"priority": priority, "part": F.lit(0)})
    return budget_prefix(rows, ["part"], [F.col("priority"), F.col("position"), F.col("id")], F.length("body"), 4 * max_tokens).drop("part")


def memory_staleness(states: DataFrame) -> DataFrame:
    """(id, state): stale if any anchor (id, state) changed or is gone, fresh if all hold, untracked without anchors."""
    tracked = F.col("state").isNotNull()
    s = F.when(F.count_if(tracked) == 0, "untracked").when(F.count_if(F.col("state").isin("changed", "deleted")) > 0, "stale").otherwise("fresh")
    return states.groupBy("id").agg(s.alias("state"))


def library_stale(indexed: Column, version_indexed: Column, version_now: Column) -> Column:
    return F.coalesce(indexed & (version_indexed != version_now), F.lit(False))


def index_state(indexed: DataFrame, commits: DataFrame) -> DataFrame:
    """(project, status, behind): how many commits (project, hash, topo_order) came after the one indexed; 0 if it is unknown."""
    at = commits.select("project", F.col("hash").alias("indexed_commit"), F.col("topo_order").alias("at"))
    heads = commits.groupBy("project").agg(F.max_by("hash", "topo_order").alias("head"), F.max("topo_order").alias("top"))
    rows = indexed.join(heads, "project").join(at, ["project", "indexed_commit"], "left")
    same = F.col("head") == F.col("indexed_commit")
    status = F.when(F.col("indexed_commit").isNull() | (F.col("indexed_commit") == ""), "unknown").when(same, "up_to_date").otherwise("behind")
    return rows.select("project", status.alias("status"), F.when(same, 0).otherwise(F.coalesce(F.col("top") - F.col("at"), F.lit(0))).cast("long").alias("behind"))


def stale_augmentations(augmented: DataFrame, artifacts: DataFrame, now: Column, hours: int, limit: int = 50) -> DataFrame:
    """Augmented artifacts not refreshed for some hours, never refreshed ones first, with their age in whole hours."""
    rows = augmented.join(artifacts, "id").where(F.col("last_refreshed_at").isNull() | (F.col("last_refreshed_at") < now - F.make_dt_interval(hours=F.lit(hours))))
    age = F.expr("timestampdiff(HOUR, last_refreshed_at, now)")
    return rows.withColumn("now", now).withColumn("age_hours", age).drop("now").orderBy(F.asc_nulls_first("last_refreshed_at"), "id").limit(limit)


def gather(sources: dict[str, DataFrame], wanted: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    """(rows of the wanted sources as (source, payload), names that are unknown)."""
    known = [w for w in wanted if w in sources]
    rows = None
    for w in known:
        part = sources[w].select(F.lit(w).alias("source"), F.to_json(F.struct("*")).alias("payload"))
        rows = part if rows is None else rows.unionByName(part)
    return rows, [w for w in wanted if w not in sources]


def git_log(commits: DataFrame, since: Column | None = None, pattern: str | None = None, limit: int = 20) -> DataFrame:
    """Newest commits after a moment whose subject a pattern finds."""
    rows = commits if since is None else commits.where(F.col("authored_at") > since)
    rows = rows if pattern is None else rows.where(F.col("subject").rlike(pattern))
    return rows.orderBy(F.desc("authored_at"), "hash").limit(limit)


def observations(rows: DataFrame, artifact: object = None, since: Column | None = None, limit: int = 50) -> DataFrame:
    """Newest observations, of one artifact and after a moment if they are given."""
    out = rows if artifact is None else rows.where(F.col("artifact_id") == F.lit(artifact))
    out = out if since is None else out.where(F.col("created_at") > since)
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def workspace_state(artifacts: DataFrame, states: DataFrame, freshness: str | None = None, cap: int = 200) -> DataFrame:
    """The first artifacts by newest change that are not archived or superseded, then those of a freshness: the cap comes first."""
    rows = artifacts.where(~F.coalesce(F.col("status").isin("archived", "superseded"), F.lit(False))).orderBy(F.desc("updated_at"), "id").limit(cap)
    rows = rows.join(states.select("id", "freshness"), "id")
    return rows if freshness is None else rows.where(F.col("freshness") == freshness)


def entry_filter(artifacts: DataFrame, collection: str, predicate: Column) -> DataFrame:
    """(id, entries, entry_total): entries of a params array (JSON text) that a predicate over ``entry`` (a map) admits."""
    rows = artifacts.select("id", F.explode_outer(F.from_json(F.get_json_object("params", f"$.{collection}"), "array<map<string,string>>")).alias("entry"))
    return rows.groupBy("id").agg(F.count_if(F.col("entry").isNotNull() & predicate).alias("entries"), F.count("entry").alias("entry_total"))


def trim_history(sections: DataFrame, cap: int) -> DataFrame:
    """Sections (id, line, text) without the dated ones past the first ``cap`` of each id."""
    from pyspark.sql import Window as W

    dated = F.col("text").rlike(r"^## \d{4}-\d{2}-\d{2}")
    nth = F.sum(dated.cast("int")).over(W.partitionBy("id").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    return sections.withColumn("nth", nth).where(~dated | (F.col("nth") <= cap)).drop("nth")


def merge_anchors(old: DataFrame, new: DataFrame, current: DataFrame) -> DataFrame:
    """Anchors (path, hash): the new paths and the old ones, with the hashes that files (path, hash) have now; missing files go."""
    paths = new.select("path").unionByName(old.select("path")).distinct()
    return paths.join(current, "path").select("path", "hash")


def append_history(sections: DataFrame, text: str) -> DataFrame:
    """Sections (id, line, text) with a dated one ahead of all."""
    added = sections.select("id").distinct().select("id", F.lit(0).cast(dict(sections.dtypes)["line"]).alias("line"), F.lit(text).alias("text"))
    return added.unionByName(sections)


def topo_order(commits: DataFrame) -> DataFrame:
    """Commits (project, hash, position) with topo_order, their place from 0 in each project, parents first by position."""
    from pyspark.sql import Window as W

    return commits.withColumn("topo_order", F.row_number().over(W.partitionBy("project").orderBy("position", "hash")) - 1)


def embed(rows: DataFrame, model, batch: int = 8) -> DataFrame:
    """Rows (id, text) with the vectors that a callable gives for lists of texts; all must have one length.

    The callable goes to the Python workers and is called with at most ``batch`` texts.
    """
    import pyarrow as pa

    kind = dict(rows.dtypes)["id"]

    def run(batches):
        width = None
        for part in batches:
            texts, vectors = part[1].to_pylist(), []
            for i in range(0, len(texts), batch):
                vectors += [[float(x) for x in v] for v in model([t or "" for t in texts[i : i + batch]])]
            lengths = {len(v) for v in vectors} | ({width} if width is not None else set())
            if len(vectors) != len(texts) or len(lengths) > 1:
                raise ValueError("a vector of one length is wanted for each text")
            width = next(iter(lengths), None)
            yield pa.RecordBatch.from_arrays([part[0], pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

    return rows.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<float>")
