"""Secret scans: an inverted trigram index picks the texts that each rule is run on.

Each rule's pattern is turned into a Boolean query over the trigrams that any match contains. The
index holds postings of texts for the trigrams that the rules ask for; postings of a rule are
intersected and united as its query says, and only the candidates are searched. A rule whose pattern
has no mandatory trigram is run on every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.trigrams import as_sql, quoted, trigram_query, vocabulary
from weftline.staging import stage

CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches, which group is measured, and its fewest characters."""

    kind: str
    pattern: str
    group: int
    least: int
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of the class are maximal, so those of 24 or more are found by asking for 24.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, trigram): the inverted index of texts (key, text), for the trigrams that rules ask for."""
    words = sorted(set().union(*(vocabulary(trigram_query(r.pattern)) for r in rules)))
    if not words:
        return texts.select("key", F.lit("").alias("trigram")).where("false")
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(w)), F.lit(w)) for w in words]))
    return texts.select("key", F.lower("text").alias("folded")).select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, and a Boolean column for each rule that has mandatory trigrams) of texts worth searching."""
    indexed = [(r, q) for r in rules if (q := trigram_query(r.pattern)) is not True]
    per_text = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))  # no more than the rules' trigrams
    flags = per_text.select("key", *[F.expr(as_sql(q, "held")).alias(f"try_{r.kind}") for r, q in indexed])
    return flags.where(" or ".join([f"try_{r.kind}" for r, _ in indexed]) or "false")


def _found(rule: Rule, order: int, tried: Column | None) -> Column:
    """Spans of a rule in ``text``, from the pieces between its matches; null lists are empty."""
    text = "text" if tried is None else f"if(try_{rule.kind}, text, null)"
    pattern = quoted(rule.java)
    match = f"regexp_extract_all({text}, {pattern}, 0)"
    inner = f"regexp_extract_all({text}, {pattern}, {rule.group})"
    parts = f"zip_with(zip_with(slice(split({text}, {pattern}, -1), 1, size({match})), {match}, (p, m) -> struct(length(p) as gap, length(m) as len)), {inner}, (x, g) -> struct(x.gap as gap, x.len as len, length(g) >= {rule.least} as good))"
    span = f"struct(cast(s.at + x.gap as bigint) as start, {order} as ord, {quoted(rule.kind)} as kind, cast(s.at + x.gap + x.len as bigint) as stop)"
    none = "cast(array() as array<struct<start: bigint, ord: int, kind: string, stop: bigint>>)"
    # A fold over every CHUNK matches, from where the matches before them end: chunks' lengths are added up first.
    ends = f"aggregate(sequence(0, cast((size(parts) - 1) div {CHUNK} as int)), array(0L), (a, c) -> array_append(a, element_at(a, -1) + aggregate(slice(parts, c * {CHUNK} + 1, {CHUNK}), 0L, (t, x) -> t + x.gap + x.len)))"
    fold = f"""aggregate(slice(parts, c * {CHUNK} + 1, {CHUNK}), struct(ends[c] as at, {none} as spans),
        (s, x) -> struct(s.at + x.gap + x.len as at, concat(s.spans, if(x.good, array({span}), {none})) as spans), s -> s.spans)"""
    chunks = f"flatten(transform(array({ends}), ends -> flatten(transform(sequence(0, cast((size(parts) - 1) div {CHUNK} as int)), c -> {fold}))))"
    return F.expr(f"coalesce(transform(array({parts}), parts -> if(size(parts) > 0, {chunks}, {none}))[0], {none})")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): the ``keep`` columns, ``found`` and a count of each kind.

    found lists (start, ord, kind, stop) by start, then by the order of the rules; offsets are code
    points, stop exclusive. Matches of a kind are leftmost and do not overlap; those shorter than the
    rule's least are dropped. A null text is empty. Texts are searched whole. Copies of a text share
    their postings; repeated rows and null ids are scanned each; other columns are ignored.
    """
    # Empty texts have keys of their own, so that they don't meet.
    key = F.when(F.length("text") > 0, F.xxhash64("text")).otherwise(F.xxhash64("doc_id", F.spark_partition_id()))
    texts = docs.select("doc_id", *[c for c in keep if c != "doc_id"], F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key)
    index = stage(postings(texts.select("key", "text"), rules).distinct(), "postings")
    # Texts stay where they are as long as Spark finds the candidates small enough to be sent to them.
    worth = stage(candidates(index, rules), "candidates").withColumnRenamed("key", "of")
    rows = texts.join(worth, F.col("key") == F.col("of"), "left")
    lists = [_found(r, i, F.col(f"try_{r.kind}") if f"try_{r.kind}" in worth.columns else None).alias(f"list_{i}") for i, r in enumerate(rules)]
    rows = rows.select(*keep, "text", *lists)
    return rows.select(*keep, "text", *[F.size(f"list_{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules)], F.array_sort(F.flatten(F.array(*[f"list_{i}" for i in range(len(rules))]))).alias("found"))


def span_text(found: str = "found") -> Column:
    """``kind:start:stop`` of all spans, comma-joined."""
    return F.expr(f"array_join(transform({found}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')")


def redact(found: str = "found", text: str = "text") -> Column:
    """The text with each stretch that spans cover replaced by ``[secret]``."""
    # Code points from the furthest stop so far up to each span's start, then the rest; a fold over every CHUNK spans.
    chunks = f"sequence(0, cast((size({found}) - 1) div {CHUNK} as int))"
    own = f"slice({found}, c * {CHUNK} + 1, {CHUNK})"
    stops = f"aggregate({chunks}, array(0L), (a, c) -> array_append(a, greatest(element_at(a, -1), array_max(transform({own}, x -> x.stop)))))"
    # A chunk's stretch of the text is cut out once, so that each piece is looked for near its place.
    step = "struct(greatest(s.at, x.stop) as at, if(x.start >= s.at, concat(s.kept, array(substring(part, cast(s.at - stops[c] as int) + 1, cast(x.start - s.at as int)), '[secret]')), s.kept) as kept)"
    part = f"substring({text}, cast(stops[c] as int) + 1, cast(stops[c + 1] - stops[c] as int))"
    fold = f"transform(array({part}), part -> aggregate({own}, struct(stops[c] as at, cast(array() as array<string>) as kept), (s, x) -> {step}, s -> array_join(s.kept, '')))[0]"
    whole = f"transform(array({stops}), stops -> concat(array_join(transform({chunks}, c -> {fold}), ''), substring({text}, cast(element_at(stops, -1) as int) + 1)))[0]"
    return F.expr(f"if(size({found}) = 0, {text}, {whole})")
