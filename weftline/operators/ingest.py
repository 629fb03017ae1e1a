"""Embedding of texts in batches that can be taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.memory import embed
from weftline.streaming import _folder

BATCH = 1_000_000  # texts that are embedded before they are written


def embedded(spark, where: str) -> DataFrame | None:
    """``(hash, embedding)`` of all finished batches in a folder; None if there is none."""
    return spark.read.parquet(*[f"{where}/{b}" for b in _folder(spark, where)]) if _folder(spark, where) else None


def ingest(rows: DataFrame, model: Callable[[list[str]], list], where: str, dim: int, call: int = 8, batch: int = BATCH) -> DataFrame:
    """``(id, hash, embedding)`` of rows (id, text), by the sha256 of their texts.

    Only texts that no finished batch in ``where`` has are given to the model, each once, however often it occurs;
    batches of about ``batch`` texts are written one by one, so after a failure only the one at work is done again.
    A vector that hasn't ``dim`` components, or a model that gives too few, is an error and leaves its batch unfinished.
    A null text has no vector and is left out.
    """
    spark = rows.sparkSession
    hashed = rows.where("text is not null").select("id", "text", F.sha2("text", 256).alias("hash"))
    known = embedded(spark, where)
    new = hashed.select("hash", "text") if known is None else hashed.select("hash", "text").join(known.select("hash"), "hash", "left_anti")
    parts = -(-new.select("hash").distinct().count() // batch)

    def checked(texts: list[str]) -> list:
        vectors = model(texts)
        if len(vectors) != len(texts) or any(len(v) != dim for v in vectors):
            raise ValueError(f"a vector of {dim} components is wanted for each text")
        return vectors

    done = len(_folder(spark, where))
    for i in range(parts):
        mine = new.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == i).groupBy("hash").agg(F.first("text").alias("text"))
        embed(mine.select(F.col("hash").alias("id"), "text"), checked, call).withColumnRenamed("id", "hash").write.mode("overwrite").parquet(f"{where}/{done + i:06d}")
    vectors = embedded(spark, where)
    if vectors is None:
        return hashed.select("id", "hash", F.array().cast("array<float>").alias("embedding")).limit(0)
    return hashed.select("id", "hash").join(vectors, "hash").select("id", "hash", "embedding")
