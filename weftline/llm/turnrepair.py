"""Repair of conversations: the cheapest edits after which turns alternate, as a program over the turns that stay.

Turns stay as they are, or with another role, or go; empty turns may be put in. What ends in a turn that
stays costs what the best earlier turn that stays costs, all deletions between them (a difference of two prefix
sums) and what has to be put in between their two roles. Prefix sums leave one running minimum for each role.
Of equal costs the first audit in ASCII order wins; the minima keep their order, so no audits are held to be
compared. A stretch of a conversation is summed up by what it costs from each role before it to each role
after it, so a conversation of any length is worked on in stretches of bounded size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.staging import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
STATES = "-sua"  # initial of the last turn that stays; "-": none does
PUT_IN = {("-", "s"): "", ("-", "u"): "", ("-", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
AT_END = {"-": "", "s": "ua", "u": "a", "a": ""}
GONE, FINE, BLANK, TRUNCATED = 0, 1, 2, 3  # what a row is; GONE: dropped, only its conversation is known
STRETCH = 200_000  # rows of a stretch, at most


@dataclass
class Best:
    """What is cheapest up to a row for one last role: its cost without the deletions so far, and its place in ASCII order among the others."""

    cost: int
    order: int


def solve(rows: list[tuple[str, int]], start: str) -> dict[str, tuple[int, str]]:
    """For each role that may be last: (cost, audit) of the cheapest edits of rows (initial, BLANK, FINE or TRUNCATED) after ``start``.

    Turns put in are counted with the turn that stays after them. BLANK stands for all that has to go.
    """
    least = {start: Best(0, 0)}
    gone = 0  # deletions so far, were all rows deleted
    taken: list[dict[str, tuple[str, str]]] = []  # of each row: by role, the role before it and the letters
    for initial, state in rows:
        found: dict[str, tuple[int, int, str, str]] = {}
        if state != BLANK:
            extra = TRUNCATED_COST if state == TRUNCATED else 0
            for role in "sua":
                if role == "s" and initial != "s":
                    continue
                own, letter = (0, KEEP) if initial == role else (REROLE_COST, REROLE)
                for before, best in least.items():
                    put = PUT_IN.get((before, role))
                    if put is not None:
                        # Deletions up to the row before are in `gone` already, the one of this row isn't.
                        new = (best.cost + INSERT_COST * len(put) + own + extra - DELETE_COST, best.order, before, INSERT * len(put) + letter)
                        found[role] = min(found.get(role, new), new)
        gone += DELETE_COST
        step, next_least = {}, {}
        for role in STATES:
            old = least.get(role)
            new = found.get(role)
            # The old best goes on with a deletion, which comes before all other letters.
            if new and (not old or (new[0], new[1]) < (old.cost, old.order)):
                step[role] = (new[2], new[3])
                next_least[role] = (new[0], new[1], new[3])
            elif old:
                step[role] = (role, DELETE)
                next_least[role] = (old.cost, old.order, DELETE)
        order = {r: k for k, r in enumerate(sorted(next_least, key=lambda r: next_least[r][1:]))}
        least = {r: Best(c, order[r]) for r, (c, _, _) in next_least.items()}
        taken.append(step)
    out = {}
    for role, best in least.items():
        letters, at = [], role
        for step in reversed(taken):
            at, said = step[at]
            letters.append(said)
        out[role] = (best.cost + gone, "".join(reversed(letters)))
    return out


class Route:
    """What is cheapest for each last role over the stretches so far: (cost, place in ASCII order, audits as a chain)."""

    def __init__(self):
        self.best: dict[str, tuple[int, int, tuple | None]] = {"-": (0, 0, None)}

    def follow(self, table: dict[str, dict[str, tuple[int, str]]]) -> None:
        """One more stretch: what it costs from each role to each role, with the audit."""
        found: dict[str, tuple[int, int, str, tuple | None]] = {}
        for was, (cost, order, chain) in self.best.items():
            for role, (more, audit) in table[was].items():
                new = (cost + more, order, audit, chain)
                if role not in found or new[:2] < found[role][:2]:
                    found[role] = new
        order = {r: k for k, r in enumerate(sorted(found, key=lambda r: found[r][1:3]))}
        self.best = {r: (cost, order[r], (chain, audit)) for r, (cost, _, audit, chain) in found.items()}

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest whole, with what has to be put in at its end."""
        cost, _, role = min((cost + INSERT_COST * len(AT_END[role]), order, role) for role, (cost, order, _) in self.best.items())
        pieces, chain = [INSERT * len(AT_END[role])], self.best[role][2]
        while chain:
            chain, audit = chain
            pieces.append(audit)
        return cost, "".join(reversed(pieces))


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, kept, again)``: rows (conv_id, turn, role, text) with the faults that a checksum of their key gives them.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (it stays, with ``kept`` false), 1 empties its text, 2 takes
    all ``.!?`` out of it, 3 repeats it (``again``), 4 makes its role user. A null id, turn, role or text is one space there.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(space("role"))
    again = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    return rows.withColumn("fault", fault).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("kept"), again.alias("again"))


def row_state(text: Column, kept: Column) -> Column:
    """GONE, BLANK (no character but white space), TRUNCATED (the last such one is no ``.!?``) or FINE; duplicates aside."""
    end = F.rtrim(text, F.lit(SPACES))
    return F.when(~kept, GONE).when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


LEGAL = ("su", "ua", "au")
MOST = (1 << 63) - 1
STATS = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<struct<was: string, role: string, cost: long, audit: string>>')}" for f in schema)


class _Rows:
    """Rows on their way out of a worker."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def full(self) -> bool:
        return len(self.rows) >= 2000

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


STRETCHES = pa.schema(
    [("conv_id", pa.int64()), ("at", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())]
    + [("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("routes", pa.list_(pa.struct([("was", pa.string()), ("role", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])))]
)


def _stretches(longest: int):
    """Rows (conv_id, frag, at, initial, state, again, turn) in order to one row for each stretch of a conversation."""

    def summed(held: list[tuple], whole: bool) -> tuple:
        kept = [r for r in held if r[2] != GONE]
        initials = [r[1] for r in kept]
        turns = [r[4] for r in kept if r[4] is not None]
        rows = [(i, BLANK if again else state) for _, i, state, again, _ in kept]
        # Where a conversation begins no role can come before.
        routes = [{"was": w, "role": r, "cost": c, "audit": a} for w in ("-" if whole else STATES) for r, (c, a) in solve(rows, w).items()]
        blank = sum(r[2] == BLANK for r in kept)
        duplicate = sum(r[3] and r[2] != BLANK for r in kept)
        truncated = sum(r[2] == TRUNCATED and not r[3] for r in kept)
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        ends = (initials[0], initials[-1]) if kept else (None, None)
        return held[0][0], *ends, illegal, blank, duplicate, truncated, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), routes

    def run(batches):
        out, key, begins, held = _Rows(STRETCHES), None, False, []
        for batch in batches:
            for conv, frag, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv, frag) or len(held) >= longest:
                    if held:
                        out.rows.append((key[0], *summed(held, begins)))
                    # After another conversation of the same range this one begins here.
                    begins = key is not None and key[1] == frag and key[0] != conv
                    key, held = (conv, frag), []
                held.append(tuple(row))
            if out.full():
                yield out.batch()
        if held:
            out.rows.append((key[0], *summed(held, begins)))
        if out.rows:
            yield out.batch()

    return run


REPAIRS = pa.schema([("conv_id", pa.int64()), *STATS, ("audit", pa.string())])


def _repairs():
    """Stretches in order to one row a conversation: what is wrong with it and its cheapest edits."""

    def run(batches):
        out, key, s = _Rows(REPAIRS), None, None

        def close():
            cost, audit = s["route"].finish()
            gaps = 0 if s["low"] is None else min(MOST, s["high"] - s["low"] + 1 - s["turns"])
            out.rows.append((key[0], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit))

        for batch in batches:
            for conv, _, first, last, illegal, blank, duplicate, truncated, low, high, turns, routes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or key[0] != conv:
                    if key is not None:
                        close()
                    key, s = (conv,), {"route": Route(), "last": None, "low": None, "high": None, "turns": 0, "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0}
                if first is not None:
                    s["illegal"] += illegal + (s["last"] is not None and s["last"] + first not in LEGAL)
                    s["last"] = last
                for name, n in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
                    s[name] += n
                if low is not None:
                    s["turns"] += turns - (s["high"] == low)
                    s["low"], s["high"] = low if s["low"] is None else s["low"], high
                table: dict[str, dict] = {}
                for r in routes:
                    table.setdefault(r["was"], {})[r["role"]] = (r["cost"], r["audit"])
                s["route"].follow(table)
            if out.full():
                yield out.batch()
        if key is not None:
            close()
        if out.rows:
            yield out.batch()

    return run


REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
DIGESTS = pa.schema([*REPAIRS, ("repaired_sha256", pa.string())])


def apply_edits(rows, audit: str):
    """(role, text, letter) of the turns that an audit leaves of rows (role, text), read one by one."""
    state, letters = "-", iter(audit)
    for letter in letters:
        if letter == INSERT:
            state = "a" if state == "u" else "u"
            yield NAMES[state], "", letter
            continue
        role, text = next(rows)
        if letter == KEEP:
            state = role[0]
            yield role, text, letter
        elif letter == REROLE:
            state = "a" if state == "u" else "u"
            yield NAMES[state], text, letter


def _read(schema: pa.Schema, whole: bool):
    """Rows of a conversation, its repair first, to its repaired turns, or to one row with their digest; streamed, whatever its length."""

    def streamed(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                yield from zip(*(c.to_pylist() for c in batch.slice(first, 1000).columns), strict=True)

    def run(batches):
        out, rows = _Rows(schema), streamed(batches)
        while (head := next(rows, None)) is not None:
            conv, _, _, _, *repair = head
            # Every row that isn't a repair has a letter, so a conversation ends with its audit.
            turns = apply_edits(((r[2], r[3]) for r in rows), repair[-1])
            if whole:
                digest = hashlib.sha256()
                for i, (role, text, _) in enumerate(turns):
                    digest.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
                out.rows.append((conv, *repair, digest.hexdigest()))
            else:
                for place, (role, text, letter) in enumerate(turns):
                    out.rows.append((conv, place, role, text, letter))
                    if out.full():
                        yield out.batch()
            if out.full():
                yield out.batch()
        if out.rows:
            yield out.batch()

    return run


def _with_repairs(rows: DataFrame, stretch: int) -> DataFrame:
    """Rows of each conversation with its repair before them, in order, a conversation in one partition."""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", row_state(F.col("text"), F.col("kept")).alias("state"), F.unhex(key).alias("same"))
    # The last column only tells apart rows that say the same, so that they can go to several tasks.
    order = ["conv_id", "turn", "role", F.left("text", F.lit(64)), "same", "nr"]
    dealt = rows.withColumn("nr", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.drop("nr").withColumn("at", F.monotonically_increasing_id()), "turns")
    kept = dealt.where(F.col("state") != GONE)
    often = kept.groupBy("conv_id", "same").agg(F.count("*").alias("n"), F.min("at").alias("least")).where("n > 1").select(F.col("conv_id").alias("of"), F.col("same").alias("as"), "least")
    marked = dealt.join(often, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("as")), "left")
    again = F.coalesce((F.col("at") > F.col("least")) & (F.col("state") != GONE), F.lit(False))
    marked = marked.select("conv_id", F.shiftright("at", 33).alias("frag"), "at", F.left("role", F.lit(1)).alias("initial"), "state", again.alias("again"), "turn")
    stretches = marked.repartition("frag").sortWithinPartitions("frag", "at").mapInArrow(_stretches(stretch), _ddl(STRETCHES))
    repairs = stretches.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_repairs(), _ddl(REPAIRS))
    none = [F.lit(None).cast("string" if n == "audit" else "long").alias(n) for n in REPAIRS.names[1:]]
    texts = kept.select("conv_id", "at", "role", "text", *none)
    heads = repairs.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *REPAIRS.names[1:])
    return texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repair(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of conversations (conv_id, turn, role, text, kept).

    Rows come by turn, nulls first; of one turn by role, then by text (its first 64 characters, then its digest), so
    what is said twice stands together. Roles and texts are not null. A row is blank, or a duplicate of an earlier
    role and text of its conversation, or truncated; the first that holds counts. Kept turns cost nothing, a new role
    3, a deletion 4 (blank and duplicate rows have to go), an empty turn put in 3, a truncated row that stays 3 more.
    The audit has the letters of the cheapest edits after which initials of roles read ``(s?(ua)+)?``; of equally
    cheap ones the first in ASCII order. A conversation none of whose rows is ``kept`` has zeros and an empty audit.
    A null conv_id is a conversation; ``gaps`` beyond 64 bits is held at their end. Other columns are ignored; an empty table gives no rows.

    Rows are sorted over all tasks, and a conversation may lie in many of them; at most ``stretch`` rows are worked on
    at once. Only its digest, which is sequential, passes the rows of a conversation through one task, as a stream.
    """
    return _with_repairs(rows, stretch).mapInArrow(_read(DIGESTS, True), _ddl(DIGESTS))


def repaired_turns(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(conv_id, place, role, text, edit)``: the turns of the repaired conversations; see ``repair``. ``edit`` is K, R or I."""
    return _with_repairs(rows, stretch).drop(*REPAIRS.names[1:-1]).mapInArrow(_read(REPAIRED, False), _ddl(REPAIRED))
