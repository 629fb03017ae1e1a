"""JSON and other structured text as Column expressions."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRICTION_KEYS = ("name_path", "symbol", "name", "query", "path", "pattern")
# Commands that only filter what a pipe gives them.
FILTERS = ("grep", "egrep", "fgrep", "rg", "head", "tail", "sed", "awk", "cut", "wc", "sort", "uniq", "tr")
MEMORY_NAMESPACE = uuid.NAMESPACE_OID


class JsonPathError(ValueError):
    """A path of another form than ``$.key[0][-1][-2:]``."""


def segments(path: str) -> list[tuple[str, object]]:
    """(key, name), (at, index) and (last, count) steps of a path."""
    out: list[tuple[str, object]] = []
    for part in re.sub(r"^\$\.?", "", path).split("."):
        m = re.fullmatch(r"([^\[\]]*)((?:\[[^\]]*\])*)", part)
        if not m:
            raise JsonPathError(path)
        if m[1]:
            out.append(("key", m[1]))
        for inner in re.findall(r"\[([^\]]*)\]", m[2]):
            if re.fullmatch(r"-?\d+", inner):
                out.append(("at", int(inner)))
            elif re.fullmatch(r"-\d+:", inner):
                out.append(("last", -int(inner[:-1])))
            else:
                raise JsonPathError(f"[{inner}] in {path}")
    return out


def json_at(doc: Column, path: str) -> Column:
    """JSON text of what a path leads to, strings without quotes; null where it leads nowhere.

    Steps forward go to Spark's own path reader; only indexes from the end split an array.
    """
    forward = "$"
    now = doc
    for kind, x in segments(path):
        if kind == "key":
            forward += f"['{x}']"
        elif kind == "at" and x >= 0:
            forward += f"[{x}]"
        else:
            items = F.from_json(F.get_json_object(now, forward), "array<string>")
            if kind == "at":
                now = F.try_element_at(items, F.lit(x))
            else:
                # Elements that are no objects or numbers are quoted again, so that the slice is JSON.
                part = F.slice(items, F.greatest(F.size(items) - x, F.lit(0)) + 1, F.lit(x))
                quoted = F.transform(part, lambda e: F.when(e.rlike(r'^(?:[\[{].*|-?\d[\d.eE+-]*|true|false|null)$'), e).otherwise(F.concat(F.lit('"'), e, F.lit('"'))))
                now = F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))
            forward = "$"
    return now if forward == "$" else F.get_json_object(now, forward)


def json_type(doc: Column) -> Column:
    """object, array, string, number, boolean or null."""
    return (
        F.when(doc.rlike(r"^\s*\{"), "object").when(doc.rlike(r"^\s*\["), "array").when(doc.rlike(r'^\s*"'), "string")
        .when(doc.rlike(r"^\s*(true|false)\s*$"), "boolean").when(doc.rlike(r"^\s*null\s*$"), "null").when(doc.rlike(r"^\s*-?\d"), "number")
    )


def json_shape(doc: Column, most: int = 30) -> Column:
    """(type, count, keys): of an object its number of keys and the first of them, of an array its length."""
    keys = F.json_object_keys(doc)
    count = F.when(keys.isNotNull(), F.size(keys)).otherwise(F.json_array_length(doc))
    return F.struct(json_type(doc).alias("type"), count.alias("count"), F.slice(keys, 1, most).alias("keys"))


def outcome(is_error: Column, result: Column) -> Column:
    """(outcome, overflowed) of a call: error, recoverable_error for a result with an error text, else success."""
    recoverable = F.get_json_object(result, "$.error").isNotNull()
    return F.struct(F.when(is_error, "error").when(recoverable, "recoverable_error").otherwise("success").alias("outcome"), (~is_error & ~recoverable & F.get_json_object(result, "$.output_id").isNotNull()).alias("overflowed"))


def friction_target(call: Column) -> Column:
    """The first of a call's keys that says what it was about."""
    return F.coalesce(*[F.nullif(F.get_json_object(call, f"$.{k}"), F.lit("")) for k in FRICTION_KEYS])


def uuid5(project: Column, bucket: Column, title: Column, namespace: uuid.UUID = MEMORY_NAMESPACE) -> Column:
    """Version 5 UUID of the three names, joined by the unit separator."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.concat_ws("\u001f", project, bucket, title).cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def meets(value: Column, op: Column, threshold: Column) -> Column:
    """Whether a value holds against a threshold by ``>=``, ``>``, ``<=``, ``<`` or ``==``; equality within rounding."""
    return F.when(op == ">=", value >= threshold).when(op == ">", value > threshold).when(op == "<=", value <= threshold).when(op == "<", value < threshold).when(op == "==", F.abs(value - threshold) < 2.220446049250313e-16)


def first_line_preview(content: Column) -> Column:
    """The first line, or of one over 50 characters the first 47 bytes that are whole characters and ``...``."""
    line = F.trim(F.regexp_replace(F.substring_index(content, "\n", 1), "\r$", ""))
    raw = line.cast("binary")
    # The cut goes back to the start of a character: bytes 10xxxxxx continue one.
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")
    inside = lambda i: byte(i).bitwiseAND(F.lit(0xC0)) == 0x80
    end = F.when(~inside(48), 47).when(~inside(47), 46).when(~inside(46), 45).otherwise(44)
    return F.when(F.length(line) > 50, F.concat(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"), F.lit("..."))).otherwise(line)


def terminal_filter(command: str) -> int | None:
    """Where the last pipe outside of quotes stands if a filter follows it."""
    at, quote, i = None, "", 0
    while i < len(command):
        c = command[i]
        if c == "\\" and quote != "'":
            i += 1
        elif c in "'\"" and quote in ("", c):
            quote = "" if quote else c
        elif c == "|" and not quote and "|" not in (command[i - 1 : i], command[i + 1 : i + 2]):
            at = i
        i += 1
    if at is None:
        return None
    words = command[at + 1 :].split()
    return at if words and words[0].rsplit("/", 1)[-1] in FILTERS else None


@F.pandas_udf(T.LongType())
def terminal_filter_at(command: pd.Series) -> pd.Series:
    """``terminal_filter`` of each command; quotes make it no regular language."""
    return command.map(lambda c: None if c is None else terminal_filter(c)).astype("Int64")


def schema_errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of a value breaks a JSON Schema: type, enum, required, properties, items, minimum and maximum are known."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
    wanted = schema.get("type")
    if wanted is not None:
        names = wanted if isinstance(wanted, list) else [wanted]
        if not any(isinstance(value, kinds[n]) and (not isinstance(value, bool) or n == "boolean") for n in names):
            return [f"{at}: not of type {' or '.join(names)}"]
    out = [f"{at}: not one of the allowed values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        for k, inner in schema.get("properties", {}).items():
            if k in value:
                out += schema_errors(value[k], inner, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: under the minimum"] * (value < schema.get("minimum", value)) + [f"{at}: over the maximum"] * (value > schema.get("maximum", value))
    return out


def schema_problem(doc: Column, schema: dict) -> Column:
    """The first thing in a JSON text that breaks a schema; null if nothing does."""
    import json

    @F.pandas_udf("string")
    def check(docs: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                found = schema_errors(json.loads(text), schema) if text is not None else []
            except ValueError:
                return "$: no JSON"
            return found[0] if found else None

        return docs.map(one)

    return check(doc)


def render(template: str, values: Column) -> Column:
    """A template with ``{{ name }}`` and ``{{ name | upper }}`` (lower, length, default("x")) filled in from a map of text."""
    out = []
    at = 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*(?:\|\s*(upper|lower|length|default\(\s*[\"']([^\"']*)[\"']\s*\)))?\s*\}\}", template):
        out.append(F.lit(template[at : m.start()]))
        value = F.coalesce(F.try_element_at(values, F.lit(m[1])), F.lit(""))
        if m[2] in ("upper", "lower"):
            value = getattr(F, m[2])(value)
        elif m[2] == "length":
            value = F.length(value).cast("string")
        elif m[2]:
            value = F.when(value == "", F.lit(m[3])).otherwise(value)
        out.append(value)
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


