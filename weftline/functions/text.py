"""Text, path and hash functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists of the semantic buckets, file suffixes that count as code, and the
# ordered message fragments of error families.
CODE_WORDS = ("function", "method", "struct", "class", "trait", "impl", "pattern", "api", "endpoint", "convention", "naming", "import", "module", "crate", "package", "type", "interface", "refactor", "abstraction", "generic", "lifetime", "async", "iterator", "closure", "macro", "enum", "variant")
SYSTEM_WORDS = ("build", "deploy", "ci", "config", "environment", "docker", "infra", "database", "migration", "permission", "secret", "credential", "server", "port", "host", "pipeline", "cargo test", "npm", "pip", "github actions", "dockerfile", "kubernetes", "nginx", "ssl", "certificate")
PREFERENCE_WORDS = ("prefer", "always", "never", "style", "habit", "default to", "next time", "remember to", "i like", "i want", "don't use", "snake_case", "camelcase", "tabs", "spaces", "indentation")
CODE_SUFFIXES = (".rs", ".ts", ".py", ".go", ".java", ".js", ".kt")
ERROR_FAMILIES = (
    ("index is locked", "lsp_index_locked"),
    ("Failed to spawn mux", "mux_startup_fail"),
    ("mux startup failed", "mux_startup_fail"),
    ("LSP server is not running", "lsp_not_running"),
    ("LSP server disconnected", "lsp_disconnect"),
    ("overlaps named symbol", "il1_read_overlaps_symbol"),
    ("Use read_markdown", "il4_read_markdown_routing"),
    ("Use edit_markdown", "il5_edit_markdown_routing"),
    ("contains a symbol definition", "il2_structural_edit"),
    ("is blocked for structural edits", "il2_structural_edit"),
    ("shell access to source files is blocked", "il3_shell_on_source"),
    ("IL3 violation", "il3_pipe_to_trimmer"),
    ("write denied", "write_scope_denied"),
    ("unsupported json_path", "json_path_unsupported"),
    ("old_string not found", "edit_stale_match"),
    ("AST parse failed", "ast_extent_fail"),
    ("cannot determine end of", "ast_extent_fail"),
    ("ambiguous name_path", "ambiguous_name_path"),
    ("dropped sibling", "replace_dropped_sibling"),
    ("dropped the symbol", "replace_dropped_sibling"),
    ("symbol not found", "symbol_not_found"),
)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def artifact_id(path: Column) -> Column:
    """First 16 hex digits of the path's SHA-256, with forward slashes."""
    return F.substring(F.sha2(F.replace(path, F.lit("\\"), F.lit("/")), 256), 1, 16)


def chunk_id(project: Column, path: Column, content: Column) -> Column:
    return F.concat_ws(":", project, path, content_hash(content))


def token_estimate(text: Column) -> Column:
    """Bytes over four, whole."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def over_inline_limit(text: Column, limit: int = 2500) -> Column:
    return token_estimate(text) > limit


def _count_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def classify_bucket(content: Column) -> Column:
    """preferences, code, system or unstructured by the number of keywords that occur; ties in that order."""
    low = F.lower(content)
    code = _count_of(low, CODE_WORDS) + F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in CODE_SUFFIXES]), 2).otherwise(0)
    system, preference = _count_of(low, SYSTEM_WORDS), _count_of(low, PREFERENCE_WORDS)
    return (
        F.when(F.greatest(code, system, preference) == 0, "unstructured")
        .when((preference > 0) & (preference >= code) & (preference >= system), "preferences")
        .when(code >= system, "code")
        .otherwise("system")
    )


def error_family(message: Column) -> Column:
    """Family of the first fragment that a message holds, else null."""
    out = F.lit(None).cast("string")
    for fragment, family in reversed(ERROR_FAMILIES):
        out = F.when(F.contains(message, F.lit(fragment)), family).otherwise(out)
    return out


def friction_score(truncations: Column, recoverable: Column, errors: Column, overflows: Column) -> Column:
    return truncations * 3 + recoverable * 2 + errors * 2 + overflows


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds none, and a carriage return before one goes too."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def strip_ansi(text: Column) -> Column:
    """Without control sequences: escape, bracket, up to the next letter."""
    return F.regexp_replace(text, "\u001b\\[[^A-Za-z]*[A-Za-z]?", "")


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters; a longer text ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def slugify(heading: Column) -> Column:
    """Anchor of a heading: lower case, letters, digits, - and _ kept, spaces to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def heading_level(line: Column) -> Column:
    """1 to 6 for a line of that many # and a space, else null."""
    hashes = F.regexp_extract(line, r"^(#{1,6})\s", 1)
    return F.when(F.length(hashes) > 0, F.length(hashes))


# Language of each file extension.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "scala": "scala", "sh": "bash", "md": "markdown", "html": "html", "css": "css"}


def language_of(path: Column) -> Column:
    """Language by extension, null for an unknown one."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def whole_word(text: Column, word: str) -> Column:
    """Whether a word occurs with no identifier character on either side."""
    return text.rlike(rf"(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])")


def path_matches(found: Column, expected: Column) -> Column:
    """Equal paths, or one the end of the other after a slash."""
    return (found == expected) | found.endswith(F.concat(F.lit("/"), expected)) | expected.endswith(F.concat(F.lit("/"), found))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def relative_path(path: Column, root: Column) -> Column:
    """A path below a root, from there; others as they are. Backslashes count as slashes."""
    p, r = F.translate(path, "\\", "/"), F.rtrim(F.translate(root, "\\", "/"), F.lit("/"))
    return F.when(p == r, F.lit("")).when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p))).otherwise(p)


def common_folder(paths: Column) -> Column:
    """The folder, with its slash, that all of an array's paths are in; empty if there is none.

    What the least and the greatest path share, all share.
    """
    folders = lambda x: F.slice(F.split(x, "/"), F.lit(1), F.size(F.split(x, "/")) - 1)
    both = F.arrays_zip(folders(F.array_min(paths)).alias("a"), folders(F.array_max(paths)).alias("b"))
    at = F.array_position(F.transform(both, lambda x: F.coalesce(x["a"] == x["b"], F.lit(False))), False)
    kept = F.when(at > 0, F.slice(both, F.lit(1), (at - 1).cast("int"))).otherwise(both)
    return F.coalesce(F.array_join(F.transform(kept, lambda x: F.concat(x["a"], F.lit("/"))), ""), F.lit(""))


def strip_inline(text: Column) -> Column:
    """Inline markdown without its marks: code spans, then bold and italic, then white space folded."""
    out = F.regexp_replace(text, "(?s)`(.*?)`", "$1")
    for mark in (r"\*\*", "__", r"\*", "_"):
        out = F.regexp_replace(out, f"(?s){mark}(.*?){mark}", "$1")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
