"""Conversation repair against all edits in order of cost, and over stretches of every size."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import turnrepair as tr
from weftline.llm.queries import ORACLES

WS = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(WS)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest edits by Dijkstra's search over (rows done, state of the grammar), whole audits in the queue."""
    faults = plain_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, said = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(said)
        done.add((i, state))
        for c, name in (("u", "user"), ("a", "assistant")):
            if (state, c) in NEXT:
                heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state, c], (*said, f"{name}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, NEXT[state, role[:1]], (*said, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (state, c) in NEXT:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, NEXT[state, c], (*said, f"{name}:{text}")))
    raise AssertionError


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain(rows, damaged):
    want = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        said = [(r[2], r[3]) for r in mine]
        faults, turns = plain_faults(said), [r[1] for r in mine if r[1] is not None]
        cost, audit, text = plain_repair(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        want[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return want


def test_solve_gives_the_cheapest_and_least_audit():
    rng = random.Random(1)
    for n in range(4000):
        kinds = [(rng.choice(["s", "u", "a", "t", ""]) if n % 2 else rng.choice("sua"), rng.choice([tr.FINE, tr.FINE, tr.BLANK, tr.TRUNCATED])) for _ in range(rng.randrange(9))]
        texts = {tr.FINE: "ok{}.", tr.BLANK: " ", tr.TRUNCATED: "ok{}"}
        want = plain_repair([(initial, texts[state].format(i)) for i, (initial, state) in enumerate(kinds)])[:2]
        route = tr.Route()
        at = 0
        while at < len(kinds):  # stretches of any length
            size = rng.randrange(1, 5)
            table = {w: tr.solve(kinds[at : at + size], w) for w in (tr.STATES if at else "-")}
            route.follow(table)
            at += size
        assert route.finish() == want, kinds


def made_rows():
    rng = random.Random(7)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), rng.choice(["yes.", "no", "why? ", "", None, " \t", "a.\n", f"t{turn}!", "é。", "x" * 70 + "1.", "x" * 70 + "2."])))
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(900)] + [(100, 5, "user", "again and again.")] * 300  # a hot one, with one row many times
    rows += [(101, 2**62, "user", "far."), (101, -(2**62), "user", "off."), (102, 0, "user", "long " * 20_000)]
    dropped = next(i for i in range(200, 400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone."), rows[0], rows[3]]


@pytest.mark.parametrize("stretch", [1, 7, 200_000])
def test_repair_against_the_search(spark, stretch):
    rows = made_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(3) for c in ("state", "fault", "frag", "audit", "same", "least", "initial")})
    want = plain(rows, plain_damage(rows))
    got = {r.conv_id: tuple(r)[1:] for r in tr.repair(tr.damage(df.repartition(7)), stretch).collect()}
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv
    assert tr.repair(tr.damage(df.limit(0))).count() == 0


def test_repaired_turns_are_what_is_digested(spark):
    rows = [r for r in made_rows() if r[0] != 100]
    damaged = tr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    digests = {r.conv_id: r.repaired_sha256 for r in tr.repair(damaged).collect()}
    by: dict = {}
    for r in tr.repaired_turns(damaged, 5).orderBy("conv_id", "place").collect():
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(by.get(c, [])).encode()).hexdigest() for c in digests} == digests


def test_sql_says_the_same_of_nulls_and_ties(spark, tmp_path):
    rows = [r for r in made_rows() if r[0] not in (100, 101, 102) and not (r[3] or "").startswith("x" * 70)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = con.execute(ORACLES["op12_turn_repair"]).fetchall()
    mine = [tuple(r) for r in tr.repair(tr.damage(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).collect()]
    assert sorted(got, key=str) == sorted(mine, key=str)
