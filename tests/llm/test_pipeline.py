"""The stages of the corpus pipeline against plain versions, each on its own input."""

import collections

import corpus_pipeline as pipeline

from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_spans, docs, none  # noqa: F401

from weftline.llm import langid, mixing

SF = "/root/testdata/sf0.001"


def whole(df):
    return collections.Counter(tuple(r[c] for c in pipeline.COLUMNS) for r in df.collect())


def test_shape(spark, docs, none):  # noqa: F811
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "secret_scan", "mix_sources", "best_fit_packing"]
    for _, step in pipeline.STAGES[:-1]:
        for df in (docs, none):
            out = step(spark, df, SF)
            assert tuple(out.columns) == pipeline.COLUMNS and out.count() >= 0


def test_language_stage_keeps_what_it_can_tell(spark):  # noqa: F811
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in langid.identify(real).where("rejected").collect()}
    assert whole(pipeline.identify_language(spark, real, SF)) == whole(real.where(~F.col("doc_id").isin(list(rejected)))) and len(rejected) < 10


def test_one_document_of_each_group_stays(spark, docs):  # noqa: F811
    source = [tuple(r[c] for c in pipeline.COLUMNS) for r in docs.collect()]
    least = [x[1] for x in brute_components([(r[0], r[1]) for r in source])]
    want = {(r[0], r[1]) for r, c in zip(source, least, strict=True) if r[0] == c}
    got = whole(pipeline.drop_near_duplicates(spark, docs, SF))
    assert {k[:2] for k in got} == want and set(got.values()) == {1} and set(got) <= set(source)


def test_secrets_are_masked(spark, docs):  # noqa: F811
    extra = spark.createDataFrame([(900, 'my token = "abcdefgh12" and on', "en", "a", 30), (901, None, None, None, None)], docs.select(*pipeline.COLUMNS).schema)
    got = {(r.doc_id, r.text, r.n_chars) for r in pipeline.mask_secrets(spark, docs.select(*pipeline.COLUMNS).unionByName(extra), SF).collect()}
    assert (900, 'my [secret]" and on', 19) in got and (901, None, None) in got
    assert all(t is None or not brute_spans(t) for _, t, _ in got)
    clean = {(r.doc_id, r.text, r.n_chars) for r in docs.collect() if r.text is not None and not brute_spans(r.text)}
    assert clean <= got


def test_mixing_repeats_documents(spark, docs):  # noqa: F811
    copies = collections.Counter()
    for r in mixing.mix(docs.select(*pipeline.COLUMNS)).collect():
        copies[r.doc_id, r.size] += r.copies
    got = collections.Counter()
    for k, n in whole(pipeline.mix_sources(spark, docs, SF)).items():
        got[k[0], len((k[1] or "").split())] += n
    assert got == +copies
    assert set(whole(pipeline.mix_sources(spark, docs, SF))) <= set(whole(docs))


def test_run_is_its_stages(spark):  # noqa: F811
    out = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in pipeline.STAGES:
        out = step(spark, out, SF)
    piece = lambda df: collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert piece(pipeline.run(spark, SF)) == piece(out)
