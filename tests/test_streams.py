"""Streams with state over several batches and starts, against what a batch makes of all rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline import streaming
from weftline.streaming import stateful

SCHEMA = "user_id long, event_id long, event_type string, value string, ts timestamp"


@pytest.fixture
def source(spark, tmp_path):
    """Adds rows (user, id, type, seconds) as a file, and reads the files, one a batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    count = iter(range(100))

    def add(rows):
        data = [(u, i, k, f"v{i}", float(s)) for u, i, k, s in rows]
        df = spark.createDataFrame(data, "user_id long, event_id long, event_type string, value string, s double")
        # A second after the epoch, as what is no later than the first watermark is dropped.
        df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1)).drop("s").coalesce(1).write.parquet(f"{tmp_path}/part")
        part = next((tmp_path / "part").glob("*.parquet"))
        part.rename(folder / f"{next(count):03d}.parquet")
        for x in (tmp_path / "part").glob(".*"):
            x.unlink()
        for x in (tmp_path / "part").iterdir():
            x.unlink()
        (tmp_path / "part").rmdir()
        time.sleep(0.01)

    return add, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def events(n, seed, span=100_000, kinds=("view", "buy", "other")):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(span * 10), n))
    return [(rng.randrange(4), i, rng.choice(kinds), t / 10) for i, t in enumerate(times)]


def chunks(rows, n):
    return [rows[i : i + n] for i in range(0, len(rows), n)]


def test_rows_expire_across_batches_and_starts(spark, source, tmp_path):
    add, read = source
    rows = [*events(60, 1), (9, 900, "view", 0.0), (9, 901, "view", 0.0)]
    rows.sort(key=lambda r: r[3])
    where, days = str(tmp_path / "w"), 20_000 / 86_400
    for part in chunks(rows, 17):  # every start goes on from the checkpoint
        add(part)
        log = streaming.run_to_table(stateful.retained(read(), "user_id", "event_id", days=days, late="0 seconds"), "kept", where=where).collect()
        latest = max(s for _, _, _, s in rows[: rows.index(part[-1]) + 1])
        gone = {r.id for r in log if not r.held}
        assert {r.id for r in log if r.held} - gone == {i for _, i, _, s in rows[: rows.index(part[-1]) + 1] if s >= latest - 20_000}
    assert len(log) == len({(r.id, r.held) for r in log}) and gone


def test_rows_expire_to_the_millisecond(spark, source, tmp_path):
    """Of pages that are over in part a row goes as soon as a batch would drop it."""
    add, read = source
    where, days = str(tmp_path / "w"), 10_000 / 86_400_000
    first = [(1, i, "view", s) for i, s in enumerate([0.0, 0.0, 0.0, 0.0, 1.0, 1.499, 1.5, 2.5, 2.5, 3.0, 9.0])]
    then = [(1, 20 + i, "view", s) for i, s in enumerate([9.1, 9.1, 9.5, 9.7, 9.8, 9.9, 11.5])] + [(2, 40, "view", 11.5)]
    last = [(1, 50, "view", 12.0), (1, 51, "view", 19.001), (3, 52, "view", 12.5)]
    seen = []
    for part, latest in ((first, 9.0), (then, 11.5), (last, 19.001)):
        add(part)
        seen += part
        log = streaming.run_to_table(stateful.retained(read(), "user_id", "event_id", days=days, late="0 seconds"), "kept", where=where).collect()
        assert len(log) == len({(r.id, r.held) for r in log})
        assert {r.id for r in log if not r.held} == {i for _, i, _, s in seen if round(s * 1000) < round(latest * 1000) - 10_000}
        assert {r.id for r in log if r.held} == {i for _, i, _, s in seen}


class State:
    """State, timers and times of one key, with a list of the calls."""

    def __init__(self):
        self.pages, self.timers, self.calls, self.now, self.due = {}, set(), [], 0, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls.append("get")
        return self.pages.get(key)

    def containsKey(self, key):
        self.calls.append("has")
        return key in self.pages

    def updateValue(self, key, value):
        self.calls.append("put")
        self.pages[key] = value

    def removeKey(self, key):
        self.calls.append("remove")
        del self.pages[key]

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.due

    def advance(self, processor, now):
        """Ids that go as the watermark moves on."""
        self.now, gone = now, []
        for self.due in sorted(t for t in self.timers if t <= now):
            gone += [r["id"] for r in processor.handleExpiredTimer((7,), self, self)]
            self.timers.remove(self.due)  # as Spark does, afterwards
        return gone


def test_state_is_asked_a_few_times_for_many_rows():
    """100 rows of a key cost a page and a timer, not some calls for each row."""
    state, processor = State(), stateful._Retention(5_000)
    processor.init(state)
    rows = [{"at": 100 + i * 10, "id": i} for i in range(100)]
    assert len(list(processor.handleInputRows((7,), iter(rows), state))) == 100 and len(state.calls) <= 4
    state.calls.clear()
    assert state.advance(processor, 5_501) == list(range(41)) and len(state.calls) <= 6
    assert sorted(state.advance(processor, 9_000)) == list(range(41, 100)) and not state.pages and not state.timers


def test_pages_meet_and_are_cut(monkeypatch):
    monkeypatch.setattr(stateful, "PAGE", 3)
    monkeypatch.setattr(stateful, "ROWS", 5)
    rng = random.Random(3)
    state, processor, held, gone, n = State(), stateful._Retention(40), {}, [], 0
    processor.init(state)
    for now in range(0, 400, 7):
        rows = [{"at": now + rng.randrange(12) - 3, "id": n + i} for i in range(rng.choice([0, 1, 4, 17]))]
        n += len(rows)
        held |= {r["id"]: r["at"] for r in rows}
        assert len(list(processor.handleInputRows((7,), iter(rows), state))) == len(rows)
        gone += state.advance(processor, now)
        assert sorted(gone) == sorted(i for i, at in held.items() if at + 40 < now)
        assert all(page[0][0] == first and sorted(page[0]) == page[0] and (len(page[0]) <= 3 or page[0][2] == page[0][-1]) for (first,), page in state.pages.items())


def test_answers_that_are_late_missing_or_repeated(spark, source, tmp_path):
    add, read = source
    where, late = str(tmp_path / "w"), "500 seconds"
    is_ = lambda k: F.col("event_type") == k

    def run():
        s = stateful.two_phase(read(), "user_id", "event_id", is_("view"), is_("buy"), 100_000, late=late)
        return {(r.id, r.began, r.ended, r.answered) for r in streaming.run_to_table(s, "answers", where=where).collect()}

    add([(1, 1, "view", 0), (2, 2, "view", 10), (3, 3, "buy", 60), (4, 4, "view", 5), (4, 5, "view", 5)])
    assert run() == set()
    add([(1, 10, "buy", 50), (1, 11, "buy", 40), (1, 12, "buy", 101), (3, 13, "view", 20), (4, 14, "buy", 106), (5, 15, "buy", 3)])  # an answer came before what it answers
    assert run() == set()
    add([(7, 20, "view", 1000)])
    done = {(1, 1000, 41_000, True), (2, 11_000, None, False), (13, 21_000, 61_000, True), (4, 6000, None, False), (5, 6000, None, False)}
    assert run() == done
    add([(1, 30, "buy", 30), (7, 31, "buy", 1099), (2, 32, "view", 10)])  # too late for what has been given out
    assert run() == done
    add([(8, 40, "other", 1), (8, 41, "view", 5000)])
    assert run() == done | {(20, 1_001_000, 1_100_000, True)}


def test_answers_equal_those_of_a_batch(spark, source, tmp_path):
    add, read = source
    rows = events(300, 3, span=20_000)
    for part in chunks(rows, 60):
        random.Random(4).shuffle(part)
        add(part)
    is_ = lambda k: F.col("event_type") == k
    s = stateful.two_phase(read(), "user_id", "event_id", is_("view"), is_("buy"), 300_000, late="5000 seconds")
    got = {(r.id, r.ended) for r in streaming.run_to_table(s, "answers", where=str(tmp_path / "w")).collect()}
    last = max(t for _, _, k, t in rows if k != "other") - 5000
    want = {(i, min((round(t * 1000) + 1000 for v, _, j, t in rows if v == u and j == "buy" and b <= t <= b + 300), default=None)) for u, i, k, b in rows if k == "view" and b + 300 < last}
    assert got == want and len(got) > 50


def test_fold_by_field_over_starts(spark, source, tmp_path):
    add, read = source
    rows = events(80, 5)
    mixed = rows[:]
    random.Random(6).shuffle(mixed)
    where = str(tmp_path / "w")
    for part in chunks(mixed, 30):
        add(part)
        s = stateful.fold_fields(read().select(F.col("user_id").alias("artifact_id"), F.col("event_type").alias("field"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), "value"))
        out = streaming.run_to_table(s, "fold", mode="update", where=where)
    newest = {}
    for r in out.collect():
        newest[r.artifact_id, r.field] = max(newest.get((r.artifact_id, r.field), (-1, -1, "")), (r.at, r.id, r.value))
    assert {k: v[1] for k, v in newest.items()} == {(u, k): i for u, i, k, _ in rows}


@pytest.mark.parametrize("compact", [2, 100])
def test_upserts_go_on_after_a_restart(spark, source, tmp_path, compact):
    add, read = source
    rows = events(90, 8)
    mixed = rows[:]
    random.Random(9).shuffle(mixed)
    where, seen = str(tmp_path / "w"), []
    for k, part in enumerate(chunks(mixed, 15)):
        add(part)
        seen += part
        table = streaming.upsert_each_batch(read(), ["user_id", "event_type"], ["ts", "event_id"], where=where, compact=compact)
        if k % 2:
            newest = {}
            for u, i, kind, s in seen:
                newest[u, kind] = max(newest.get((u, kind), (-1, -1)), (s, i))
            assert {(r.user_id, r.event_type): r.event_id for r in table.collect()} == {x: i for x, (_, i) in newest.items()}
    held = [x for x in (tmp_path / "w" / "changes").iterdir() if x.is_dir()]
    assert len(held) <= (4 if compact == 2 else 6)


def test_a_batch_that_is_run_again_changes_nothing(spark, source, tmp_path):
    add, read = source
    where = str(tmp_path / "w")
    for part in chunks(events(40, 10), 20):
        add(part)
        streaming.upsert_each_batch(read(), ["user_id"], ["ts", "event_id"], where=where, compact=1)
    before = sorted(map(tuple, streaming.upserted(spark, where, SCHEMA, ["user_id"], ["ts", "event_id"]).collect()))
    newest = max((tmp_path / "w" / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()  # as if the driver had been lost before it noted the batch as done
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    table = streaming.upsert_each_batch(read(), ["user_id"], ["ts", "event_id"], where=where, compact=1)
    assert sorted(map(tuple, table.collect())) == before
