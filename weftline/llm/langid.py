"""Language identification by compression: the language whose text helps most to encode a document.

Each language has a zstandard raw-content dictionary, made of sample texts in it. A document's
letters, in lower case, are encoded block by block against every dictionary; the smallest total names the language. Where the
runner-up comes nearly as close, the document is rejected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.words import worker_cache

SAMPLE_DOCS = 128  # labelled documents a language, at most
DICTIONARY = 256 * 1024  # bytes a language, at most, which its documents share equally
ALL_DOCS = 12_800  # labelled documents of all languages, which share them equally
ALL_BYTES = 64 * 1024 * 1024  # of all dictionaries, likewise
BLOCK = 4 * 1024
LEVEL = 3
NARROW = 0.005  # margin under which a document is rejected


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters_of(text: Column) -> Column:
    """The text in lower case with one space for each stretch without letters; empty if it has none."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary of every language from a bounded sample of rows that are not held out, the commonest first.

    The sample is, of each language, the distinct (doc_id, text) that hash lowest: ``SAMPLE_DOCS``, or an
    equal share of ``ALL_DOCS`` where there are more than a hundred languages (one at least). Dictionaries
    share ``ALL_BYTES`` in the same way, and the documents of a language its dictionary: of a longer text, the
    stretch of that many bytes that begins at a hashed place of the whole of it. Rows are counted
    map-side, and a threshold of the hash for each language, with room to spare, says which rows travel.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    limits = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("texts")).collect()  # a row for each language
    if not limits:
        return {}
    limits = sorted(limits, key=lambda r: (-r["n"], r["lang"]))
    docs_each = max(1, min(SAMPLE_DOCS, ALL_DOCS // len(limits)))
    bytes_each = max(1, min(DICTIONARY, ALL_BYTES // len(limits)))
    most = [(r["lang"], min((1 << 63) - 1, int((min(1, (1.5 * docs_each + 20) / max(1, r["texts"])) - 0.5) * (1 << 64)))) for r in limits]
    low = docs.sparkSession.createDataFrame(most, "of string, most long")
    # The rows come from the driver, so they are no more than it holds.
    near = known.join(F.broadcast(low), (F.col("lang") == F.col("of")) & (F.col("h") <= F.col("most")))
    each = max(1, bytes_each // docs_each - 1)
    letters = near.select("lang", "h", letters_of(F.col("text")).alias("text"))
    begin = F.pmod("h", F.greatest(F.length("text") - each + 1, F.lit(1)))
    stretch = F.substring("text", (begin + 1).cast("int"), F.lit(each))
    by: dict[str, list] = {row["lang"]: [] for row in limits}
    for row in letters.groupBy("lang", "h").agg(F.first(stretch).alias("text")).toLocalIterator():
        by[row["lang"]].append((row["h"], row["text"]))
    return {lang: b"\n".join(_fitted(t, each) for _, t in sorted(rows)[:docs_each]) for lang, rows in by.items()}


def _fitted(text: str, most: int) -> bytes:
    """The text in UTF-8, without the characters that lie beyond ``most`` bytes."""
    return text.encode()[:most].decode(errors="ignore").encode()


def compressors(dictionaries: dict[str, bytes]) -> dict:
    """One compressor a language."""
    import zstandard

    made = {}
    for lang, raw in dictionaries.items():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return made


def classify(text: bytes, by_lang: dict) -> tuple[str, float]:
    """Language of the smallest encoding (ties: the first in ``by_lang``) and the margin to the next, 0 to 1."""
    sizes = dict.fromkeys(by_lang, 0)
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        for lang, compress in by_lang.items():
            sizes[lang] += len(compress(block))
    order = sorted(sizes.items(), key=lambda x: x[1])
    return order[0][0], 1 - order[0][1] / order[1][1] if len(order) > 1 else 1.0


def _predict(dictionaries: dict[str, bytes]):
    def run(batches):
        by_lang = worker_cache(("compressors", tuple(dictionaries.items())), lambda: compressors(dictionaries))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                *kept, letters = batch.slice(start, 1000).columns
                langs, scores, rejected = [], [], []
                for text in letters.to_pylist():
                    lang, score = classify(text, by_lang) if text and by_lang else ("und", 0.0)
                    langs.append(lang)
                    scores.append(score)
                    rejected.append(lang == "und" or score < NARROW)
                columns = [*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns of ``docs``, which has a text, and lang_pred, score and rejected."""
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(*keep, letters_of(F.col("text")).cast("binary").alias("_letters")).mapInArrow(_predict(dictionaries), schema)


def identify(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every row of ``docs`` (doc_id, text, lang).

    lang_pred is a learned language, or ``und`` with score 0 for a text that is null or has no letter
    and for every text if nothing could be learned. score is the margin between the two smallest
    encodings; below ``NARROW``, or for ``und``, the row is rejected, however short its text. Whole texts are encoded. Equal sizes go to the language with more labelled documents.
    Repeated rows are judged each; other columns are ignored; an empty table gives no rows.
    """
    dictionaries = fit(docs) if dictionaries is None else dictionaries
    rows = predict(docs, dictionaries, ("doc_id",))
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
