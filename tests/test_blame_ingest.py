"""Blame of values along parents, embedding in batches, and paged vectors."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import blame, ingest
from weftline.sources import paged


def test_blame_over_merges_renames_and_deletions(spark):
    # a - b - d - f(head), a - c - d: d merges b (first) and c; e is on no way to the head.
    commits = spark.createDataFrame([("a", [], 1), ("b", ["a"], 9), ("c", ["a"], 3), ("d", ["b", "c"], 2), ("e", ["d"], 99), ("f", ["d"], 5)], "commit string, parents array<string>, at long")
    texts = {
        "a": '{"x": 1, "old": {"k": [1, "z"]}, "gone": true, "s": "1"}', "b": '{"x": 2, "old": {"k": [1, "z"]}, "gone": true, "s": "1"}', "c": '{"x": 1, "new": {"k": [1, "z"]}, "gone": true, "back": 1, "s": "1"}',
        "d": '{"x": 2, "new": {"k": [1, "z"]}, "gone": true, "both": 7, "s": "1"}', "e": '{"x": 5}', "f": '{"x": 2, "new": {"k": [1, "y"]}, "both": 7, "s": "1"}',
    }
    versions = spark.createDataFrame([("c.json", c, t) for c, t in texts.items()] + [("n.toml", "b", "[t]\nv = 1"), ("n.toml", "d", "[t]\nv = 1"), ("n.toml", "f", "[t]\nv = 1\n[t.u]\nw = 'q'"), ("bad.json", "f", "{")], "file string, commit string, text string")
    values = blame.key_values(versions)
    heads = spark.createDataFrame([("c.json", "f"), ("n.toml", "f")], "file string, head string")
    got = {(r.file, r.key): (r.value, r.commit, r.at) for r in blame.last_changes(commits, versions, values, heads).collect()}
    assert got == {
        ("c.json", "x"): ("2", "b", 9), ("c.json", "old.k.0"): (None, "c", 3), ("c.json", "old.k.1"): (None, "c", 3), ("c.json", "new.k.0"): ("1", "c", 3), ("c.json", "new.k.1"): ("y", "f", 5),
        ("c.json", "gone"): (None, "f", 5), ("c.json", "back"): (None, "a", 1), ("c.json", "both"): ("7", "d", 2), ("c.json", "s"): ("1", "a", 1), ("n.toml", "t.v"): ("1", "b", 9), ("n.toml", "t.u.w"): ("q", "f", 5),
    }


def test_blame_walks_only_where_a_value_stays(spark, monkeypatch):
    """No round moves or writes rows of commits that changed the value."""
    commits = spark.createDataFrame([(f"c{i:02}", [f"c{i - 1:02}"] if i else [], i) for i in range(40)], "commit string, parents array<string>, at long")
    values = spark.createDataFrame([("a.json", f"c{i:02}", k, v) for i in range(40) for k, v in (("x", str(i)), ("y", "1" if i < 35 else "2"))], "file string, commit string, key string, value string")
    sizes = []
    plain = blame.stage
    monkeypatch.setattr(blame, "stage", lambda df, name: (out := plain(df, name), name == "walks" and sizes.append(out.count()))[0])
    found = blame.last_changes(commits, values.select("file", "commit"), values, spark.createDataFrame([("a.json", "c39")], "file string, head string"))
    assert {(r.key, r.value, r.commit) for r in found.collect()} == {("x", "39", "c39"), ("y", "2", "c35")}
    assert sizes and set(sizes) == {34 + 4}


def test_key_values_of_yaml(spark):
    text = "# c\na: 1\nb:\n  c: 'x y'  # note\n  d:\n    e: 2\nf: z\n"
    rows = spark.createDataFrame([("x.yml", "1", text), ("x.yaml", "2", None), ("x.txt", "3", "a: 1")], "file string, commit string, text string")
    assert {(r.key, r.value) for r in blame.key_values(rows).collect()} == {("a", "1"), ("b.c", "x y"), ("b.d.e", "2"), ("f", "z")}


def test_ingest_skips_what_is_known_and_goes_on(spark, tmp_path):
    log, where = tmp_path / "log", str(tmp_path / "vectors")

    def model(texts, bad=None):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if bad in texts:
            raise ValueError("down")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, f"t{i % 7}") for i in range(30)] + [(99, None)], "id long, text string")
    with pytest.raises(Exception, match="down"):
        ingest.ingest(rows, lambda t: model(t, "t5"), where, 2, call=1, batch=2)
    held = ingest.embedded(spark, where)
    before = held.count() if held else 0
    log.unlink()
    got = ingest.ingest(rows, model, where, 2, batch=2).collect()
    asked = log.read_text().split()
    assert len(asked) == len(set(asked)) == 7 - before and len(got) == 30 and all(r.embedding == [2.0, 1.0] for r in got)
    log.unlink()
    more = rows.unionByName(spark.createDataFrame([(100, "new"), (101, "t1")], rows.schema))
    assert ingest.ingest(more, model, where, 2).count() == 32 and log.read_text().split() == ["new"]
    with pytest.raises(Exception, match="2 components"):
        ingest.ingest(spark.createDataFrame([(1, "other")], rows.schema), lambda t: [[1.0]] * len(t), where, 2)
    assert ingest.ingest(rows.limit(0), model, str(tmp_path / "none"), 2).count() == 0


def test_paged_vectors(spark):
    def fetch(shard, cursor, limit):
        at = int(cursor or 0)
        mine = [(i, [float(i), 0.5]) for i in range(shard, 1003, 4)]
        return mine[at : at + limit], str(at + limit) if at + limit < len(mine) else None

    got = paged.paged(spark, fetch, "id long, embedding array<float>", shards=4, page=50)
    assert got.count() == 1003 and got.agg(F.sum("id")).first()[0] == sum(range(1003))
    with pytest.raises(Exception, match="twice"):
        paged.paged(spark, lambda s, c, n: ([], "same"), "id long", shards=1, name="stuck_vectors").count()
