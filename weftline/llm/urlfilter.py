"""URL filters: block and allow rules by host and path, and trust propagated over links for the rest.

Hosts whose pages the rules allow are trusted seeds, those whose pages they block are distrusted ones.
Trust runs from seeds along links as personalised PageRank; distrust runs against the links, to the
hosts that link to blocked ones. A host is blocked where its distrust passes its trust.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.staging import stage, unstage

DAMPING = 0.85
CLOSE = 1e-9  # scores that differ by less, relatively, are equal: the order of a sum is not fixed
TOLERANCE = 1e-10  # part of its score that may still reach a host when walks end
MERGED = 8  # rounds after which what has arrived is added up
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str  # without the leading slash

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


RULES = (
    UrlRule("block", "com", "en/"),
    UrlRule("allow", "example.com", "en/7"),
    UrlRule("allow", "net", "de/"),
    UrlRule("block", "example.net", "de/8"),
    UrlRule("block", "org", "es/"),
)
HREF = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of equal ones the first listed."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith("/" + rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links from a host to another one, over all pages (host, html)."""
    to = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))).alias("raw")
    found = pages.where("host != ''").select(F.col("host").alias("src"), to).select("src", F.translate("raw", UPPER, UPPER.lower()).alias("dst")).where("src != dst")
    return found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): personalised PageRank from seeds (host, weight) along edges (src, dst, weight).

    A score is the sum of all that arrives at a host over walks of every length. A round moves only what arrived in the
    one before, by a join with the edges of those hosts and a map-side combined sum for each, and is staged. Walks end when nothing moves, or
    when at no host more than ``tolerance`` of its score has arrived, so no host that links reach is left out, however
    far. Scores of one walk add up to at most 1; what reaches a host without links ends there.
    """
    whole = seeds.agg(F.sum("weight")).first()[0] or 1.0
    start = seeds.where("weight > 0").select("host", (F.col("weight") / F.lit(whole) * (1 - damping)).alias("score"))
    out = edges.groupBy(F.col("src").alias("of")).agg(F.sum("weight").alias("all"))
    steps = stage(edges.join(out, F.col("src") == F.col("of")).select("src", "dst", (F.col("weight") / F.col("all") * damping).alias("part")), "steps")
    scores = stage(start, "scores")
    if not steps.limit(1).count():
        return scores
    moving, arrived = scores, []
    while True:
        moving = stage(moving.join(steps, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("part")).alias("score")), "moving")
        arrived.append(moving)
        empty = not moving.limit(1).count()
        if empty or len(arrived) == MERGED:
            old = scores
            scores = stage(reduce(DataFrame.unionByName, arrived, scores).groupBy("host").agg(F.sum("score").alias("score")), "scores")
            unstage(old, *arrived[:-1])
            arrived = []
            most = moving.join(scores.select(F.col("host").alias("of"), F.col("score").alias("now")), F.col("host") == F.col("of")).where(F.col("score") > tolerance * F.col("now"))
            if empty or not most.limit(1).count():
                return scores


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, ratio: float = 1.0, tolerance: float = TOLERANCE) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row of ``pages`` (page_id, url, html).

    A url that a rule fits gets that rule's verdict. Any other one is blocked where its host's distrust
    is more than ``ratio`` times its trust, by more than ``CLOSE`` of it, and allowed otherwise, so a host that neither walk reaches is
    allowed. A null url, or one without ``://``, has empty host and path and no rule, and is allowed. A
    null html has no links. Repeated rows count each; a null page_id is carried along; other columns are
    ignored. An empty table gives no rows.
    """
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    found = hosts.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = stage(found.where("hit is not null and host != ''").groupBy("host").agg(F.count_if(F.col("hit.verdict") == "allow").alias("allow"), F.count_if(F.col("hit.verdict") == "block").alias("block")), "ruled")
    edges = stage(links(hosts), "links")
    trust = propagate(edges, ruled.select("host", F.col("allow").cast("double").alias("weight")), tolerance=tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, ruled.select("host", F.col("block").cast("double").alias("weight")), tolerance=tolerance)
    scores = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    scores = stage(scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "host-scores").withColumnRenamed("host", "of")
    out = found.drop("html").join(scores, F.col("host") == F.col("of"), "left").fillna(0.0, ["trust", "distrust"])
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("distrust") > ratio * (1 + CLOSE) * F.col("trust"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
