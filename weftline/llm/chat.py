"""Chat formatting: records of many layouts to canonical turns, and turns to marked training text.

A record is a JSON object. Its fingerprint is a hash of those paths of its fields that any mapping asks for, so ids
and other fields don't matter; fingerprints select declarative mappings, each found once for all records that share it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def paths(value: object, at: str = "") -> set[str]:
    """Paths of a value's leaves; all items of a list share ``[]``, an empty list is ``[0]``, null is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[0]"}
    return {at}


def fingerprint(field_paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How records of one layout become turns.

    ``turns`` gives a role and the fields that make its text, joined by a blank line, for each turn of
    a record with fixed fields. ``items`` names a list field with the role and text fields of each item
    instead; "" is the record itself as the only item. ``roles`` renames roles. ``optional`` fields may
    be missing.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    def required(self) -> set[str]:
        if self.items:
            at, role, text = self.items
            return {f"{at}[].{role}" if at else role, f"{at}[].{text}" if at else text}
        return {f for _, fields in self.turns for f in fields} - set(self.optional)

    def known(self) -> set[str]:
        """All paths that it asks for; an empty list of items is one."""
        return self.required() | set(self.optional) | ({f"{self.items[0]}[0]"} if self.items and self.items[0] else set())

    def fits(self, found: set[str]) -> bool:
        return self.required() <= found or bool(self.items and self.items[0] and f"{self.items[0]}[0]" in found)

    def apply(self, record: dict) -> list[tuple[str, str]]:
        if self.items:
            at, role, text = self.items
            rows = [(r.get(role), r.get(text)) if isinstance(r, dict) else (None, r) for r in ([record] if not at else record[at])]
        else:
            rows = [(role, "\n\n".join(str(record[f]) for f in fields if record.get(f) not in (None, ""))) for role, fields in self.turns if any(f in record for f in fields)]
        return [(self.roles.get(r, r) if r is not None else "", "" if t is None else str(t)) for r, t in rows]


NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn", items=("", "role", "text")),
    Mapping("message", items=("", "role", "content")),
    Mapping("messages", items=("messages", "role", "content"), roles=NAMES),
    Mapping("conversations", items=("conversations", "from", "value"), roles=NAMES),
    Mapping("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping("prompt-completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt-response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("question-answer", turns=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)


class Registry:
    """Mappings by the fingerprints of records that they are for.

    Of the mappings whose required paths a record has (or whose list it has, empty), the one that requires most is taken,
    of equal ones the first listed. That is found once for each fingerprint; ``most`` of them are kept.
    """

    most = 100_000

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings, self.found = mappings, {}
        self.known = set().union(*(m.known() for m in mappings))

    def find(self, found: set[str]) -> Mapping | None:
        mine = found & self.known
        key = fingerprint(mine)
        if key not in self.found:
            if len(self.found) >= self.most:
                self.found.clear()
            self.found[key] = max((m for m in self.mappings if m.fits(mine)), key=lambda m: len(m.required()), default=None)
        return self.found[key]


def canonical(record: str | None, by: Registry) -> tuple[str | None, list[tuple[str, str]], list[str]]:
    """(name of the mapping, turns, paths that it doesn't ask for) of a JSON record; None and no turns for one that no mapping is for."""
    try:
        value = json.loads(record) if record is not None else None
    except (ValueError, RecursionError):
        value = None
    if not isinstance(value, dict):
        return None, [], []
    found = paths(value)
    mapping = by.find(found)
    return (mapping.name, mapping.apply(value), sorted(found - mapping.known())) if mapping else (None, [], sorted(found))


def escape(text: str) -> str:
    """No control string is left in the text; ``unescape`` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """Pairs from a backslash are read from the left: ``n`` is a line break, any other character itself."""
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out.append(text[i:j] + text[j + 1 : j + 2].replace("n", "\n"))
        i = j + 2
    return "".join(out) + text[i:]


def render(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn and the stretch of it under the loss mask (empty for roles that aren't trained on)."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    on = role == TRAINED
    return head + body + END + "\n", len(head), len(head) + len(body) * on


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) of one marked turn."""
    if not (piece.startswith(START) and piece.endswith(END + "\n")):
        raise ValueError("not a marked turn")
    role, _, body = piece[len(START) : -len(END) - 1].partition("\n")
    return unescape(role), unescape(body)


def _turns(mappings: tuple[Mapping, ...]):
    schema = pa.schema([("id", pa.int64()), ("position", pa.int64()), ("item", pa.int32()), ("layout", pa.string()), ("role", pa.string()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("extra", pa.list_(pa.string()))])

    def run(batches):
        by = Registry(mappings)
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for at, position, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, turns, extra = canonical(record, by)
                for i, (role, text) in enumerate(turns):
                    piece, a, b = render(role, text)
                    for column, value in zip(out, (at, position, i, name, role, piece, a, b, extra if i == 0 else []), strict=True):
                        column.append(value)
                if not turns:
                    for column, value in zip(out, (at, position, None, name, None, None, None, None, extra), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return run


def format_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Marked turns of records (id, position, record: JSON text), one row a turn.

    Rows: id, position, item (place within the record), layout, role, formatted, loss_from, loss_to
    (code points of ``formatted`` under the loss mask, escaped text of assistants only), extra (at the first item, the paths that
    the layout doesn't ask for). The text of a
    sequence is its rows' ``formatted`` by position and item. A record that is null, no JSON object or of
    an unknown layout gives one row with a null layout and no text, so none is lost; one with an empty list has its layout and no text. Items that
    are no objects are texts without a role. A null role or text
    within a known layout is empty. Other columns are ignored; an empty table gives no rows.
    """
    rows = records.select(F.col("id").cast("long").alias("id"), F.col("position").cast("long").alias("position"), "record")
    return rows.mapInArrow(_turns(mappings), "id long, position long, item int, layout string, role string, formatted string, loss_from long, loss_to long, extra array<string>")


def _digest():
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        # Rows of a sequence follow one another, across batches too; only its running digests are held.
        key, state, done = None, None, []

        def close():
            if state is not None:
                n, turns, chars, loss, length = state
                done.append((key[0], n, turns.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            for at, piece, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or key[0] != at:
                    close()
                    key, state = (at,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if piece is None:
                    continue
                role, text = read_turn(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape(piece[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(piece)
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return run


def digest(turns: DataFrame) -> DataFrame:
    """What each sequence says when it is read back: counts and digests of its turns and its loss mask.

    Turns with equal positions come by role, then by formatted text, nulls first. A sequence is streamed
    through its digests in order; it is never held as a whole, however many turns it has.
    """
    order = ["id", F.col("position").asc_nulls_first(), F.col("item").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("formatted").asc_nulls_first()]
    rows = turns.repartition("id").sortWithinPartitions(*order).select("id", "formatted", "loss_from", "loss_to")
    return rows.mapInArrow(_digest(), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
