"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. No stage drops a document that the ones before it left clean: the first drops those
whose language can't be told, the second all but one of each group of near-duplicates; the third
replaces secrets in texts, the fourth repeats or leaves out documents so that sources come near their
weights, and the last packs what is left. SQL can't express compression or tokenising, so there is no
``ORACLE_SQL``; tests hold the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import jaccard, langid, mixing, packing, secrets
from weftline.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can tell."""
    return langid.predict(docs, langid.fit(docs), COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, and one row of repeated rows.

    A row with a null id goes if its group has an id; groups of null ids only lose exact repeats.
    """
    docs = docs.select(*COLUMNS)
    groups = jaccard.jaccard_components(docs, keep_hash=True)
    gone = groups.where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).distinct()
    twice = groups.groupBy("doc_id", "th").count().where("count > 1").limit(1).count()
    hashed = docs.withColumn("th", F.xxhash64("text"))
    kept = hashed.join(stage(gone, "gone"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left_anti")
    if twice:
        kept = kept.dropDuplicates(["doc_id", "th"])
    return kept.select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    found = secrets.scan(docs.where("text is not null"), keep=("doc_id", "lang", "source", "n_chars"))
    masked = found.withColumn("text", secrets.redact()).withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*COLUMNS).unionByName(docs.where("text is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's weight gives it: none, one or two."""
    key = mixing.KEY
    rows = docs.select(*COLUMNS, mixing.words("text").alias("size"), F.spark_partition_id().alias("part"))
    cells = stage(mixing.sizes(docs).groupBy(*key, "part").agg(F.count("*").alias("c")), "sizes")
    plan = stage(mixing.rounded(cells), "copies").select(*[F.col(c).alias(f"of_{c}") for c in key], "m", "base", "more")
    # The plan has a row for each document, so it is never sent to all tasks, however small it is; texts aren't sorted.
    rows = rows.join(plan.hint("shuffle_hash"), mixing.same_row())
    single = rows.where("m = 1").withColumn("copies", F.col("base") + F.col("more"))
    if plan.where("m > 1").limit(1).count():
        # Repeated rows are told apart by the task that read them and their place there.
        many = stage(rows.where("m > 1"), "repeated")
        held = many.groupBy(*key, "part").agg(F.count("*").alias("c"))
        held = held.select(*[F.col(c).alias(f"in_{c}") for c in (*key, "part")], mixing.before(held).alias("before"))
        many = many.withColumn("i", F.row_number().over(W.partitionBy(*key, "part").orderBy("text", "lang")))
        many = many.join(held, mixing.same_row("in_") & (F.col("part") == F.col("in_part")))
        many = many.withColumn("copies", F.col("base") + (F.col("before") + F.col("i") <= F.col("more")).cast("long"))
        single = single.unionByName(many.select(*single.columns))
    copies = F.col("copies").cast("int")
    return single.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where("copies > 0").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
