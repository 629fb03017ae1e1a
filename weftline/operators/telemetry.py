"""Windowed statistics over a log of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOWS = {"1h": "1 hour", "24h": "24 hours", "7d": "7 days", "30d": "30 days"}


def window_start(now: Column, window: str) -> Column:
    """Start of a named window that ends at ``now``; an unknown name means 30 days."""
    return now - F.expr(f"interval {WINDOWS.get(window, WINDOWS['30d'])}")


def nearest_ranks(df: DataFrame, key: str, value: str, percents: dict[str, int]) -> DataFrame:
    """(key, a column for each percent): nearest-rank percentiles, the ceil(n * percent / 100)-th smallest non-null value.

    Ranks are computed in integers over counts of equal values, by a window that spills. A key without
    values has nulls.
    """
    per = W.partitionBy(key)
    counts = df.groupBy(key, value).agg(F.count(value).alias("_c"))
    ranked = counts.withColumns({"_upto": F.sum("_c").over(per.orderBy(F.col(value).asc_nulls_first())), "_n": F.sum("_c").over(per)})
    at = lambda p: F.min(F.when((F.col("_c") > 0) & (F.col("_upto") >= F.greatest(F.expr(f"(_n * {p} + 99) div 100"), F.lit(1))), F.col(value)))
    return ranked.groupBy(key).agg(*[at(p).alias(name) for name, p in percents.items()])


def percentile_disc(value: str, percent: int) -> Column:
    """Nearest-rank percentile by Spark's own aggregate, which counts equal values once and spills; exact for 50, 95 and 99."""
    return F.expr(f"percentile_disc({percent / 100}) within group (order by {value})")


def usage_stats(calls: DataFrame, window: str = "7d") -> DataFrame:
    """Per tool over a window that ends at the latest call: calls, errors, overflows, rates in per cent, p50 and p99 latency.

    ``calls`` has tool_name, called_at, latency_ms, outcome and overflowed.
    """
    latest = calls.agg(F.max("called_at").alias("now"))
    recent = calls.join(F.broadcast(latest)).where(F.col("called_at") >= window_start(F.col("now"), window))
    grouped = recent.groupBy("tool_name").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("outcome").isin("error", "recoverable_error")).alias("errors"),
        F.sum(F.coalesce(F.col("overflowed"), F.lit(0))).cast("long").alias("overflows"),
        F.coalesce(percentile_disc("latency_ms", 50), F.lit(0)).alias("p50"),
        F.coalesce(percentile_disc("latency_ms", 99), F.lit(0)).alias("p99"),
    )
    rate = lambda part: F.round(F.col(part) * 100.0 / F.col("calls"), 4)
    return grouped.withColumns({"error_rate_pct": rate("errors"), "overflow_rate_pct": rate("overflows")})


def lsp_stats(starts: DataFrame) -> DataFrame:
    """Per language of (language, reason, outcome, handshake_ms, first_response_ms): counts, mean handshake of
    successes rounded half away, and p95 of their first responses, 0 where there is none."""
    ok = F.col("outcome") == "success"
    return starts.groupBy("language").agg(
        F.count("*").alias("starts"), F.count_if(ok).alias("successes"), F.count_if(F.col("outcome") == "error").alias("failures"),
        F.count_if(F.col("reason") == "crash").alias("crashes"), F.coalesce(F.round(F.avg(F.when(ok, F.col("handshake_ms")))), F.lit(0)).cast("long").alias("mean_handshake"),
        F.coalesce(percentile_disc("CASE WHEN outcome = 'success' THEN first_response_ms END", 95), F.lit(0)).alias("p95_first"),
    )


def recent_errors(calls: DataFrame, n: int = 20) -> DataFrame:
    """The latest n calls that failed."""
    return calls.where(F.col("outcome").isin("error", "recoverable_error")).orderBy(F.desc("called_at"), F.desc("id")).limit(n)


def unused_tools(registered: DataFrame, calls: DataFrame) -> DataFrame:
    """Registered tools without a call."""
    return registered.join(calls.select("tool_name").distinct(), "tool_name", "left_anti")


def prune_candidates(calls: DataFrame, fewest: int = 5) -> DataFrame:
    """Tools that were called, but fewer times than that."""
    return calls.groupBy("tool_name").agg(F.count("*").alias("calls")).where(F.col("calls") < fewest)


def retained(calls: DataFrame, days: int = 30) -> DataFrame:
    """Calls of the last days before the latest one."""
    latest = calls.agg(F.max("called_at").alias("now"))
    return calls.join(F.broadcast(latest)).where(F.col("called_at") >= F.col("now") - F.expr(f"interval {days} days")).drop("now")  # one row
