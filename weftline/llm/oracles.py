"""SQL, for DuckDB, of the operators that SQL can express over whole tables."""

from __future__ import annotations

from weftline.llm.chat import END, START, TRAINED
from weftline.llm.secrets import RULES as SECRET_RULES
from weftline.llm.urlfilter import CLOSE, DAMPING
from weftline.llm.urlfilter import RULES as URL_RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _either_case(pattern: str) -> str:
    """Letters outside of classes in either case, of A-Z alone."""
    out, depth, escaped = "", 0, False
    for c in pattern:
        depth += (c == "[") - (c == "]" and depth > 0)
        plain = c.isascii() and c.isalpha() and not depth and not escaped
        out += f"[{c.lower()}{c.upper()}]" if plain else c
        escaped = c == "\\" and not escaped
    return out


def secret_scan() -> str:
    parts = []
    for i, r in enumerate(SECRET_RULES):
        p = _quoted(_either_case(r.pattern) if r.ignore_case else r.pattern)
        parts.append(
            f"SELECT rid, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[1:len(ms)]) AS p "
            f"FROM (SELECT rid, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {r.group}) AS gs, string_split_regex(t, {p}) AS ps FROM d)"
        )
    spans = "coalesce(string_agg(kind || ':' || CAST(begins AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY begins, ord), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in SECRET_RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), e AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY rid, ord ORDER BY i) AS BIGINT) AS stop FROM e),
f AS (SELECT rid, kind, ord, stop - length(m) AS begins, stop FROM s WHERE length(g) >= least)
SELECT d.doc_id, {counts}, sha256({spans}) AS base_sha256, {spans} AS spans FROM d LEFT JOIN f ON d.rid = f.rid GROUP BY d.rid, d.doc_id"""


def url_filter() -> str:
    fits = sorted(URL_RULES, key=lambda r: -len(r.name))
    test = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '/{r.path}')"
    rule = " ".join(f"WHEN {test(r)} THEN '{r.name}'" for r in fits)
    verdict = " ".join(f"WHEN {test(r)} THEN '{r.verdict}'" for r in fits)

    def walk(name: str, seed: str, edges: str) -> str:
        """What arrives at each host over walks of every length, until next to nothing moves."""
        return f"""{name}w AS (SELECT host, CAST(count(*) FILTER (hit = '{seed}') AS DOUBLE) AS weight FROM p WHERE hit IS NOT NULL AND host != '' GROUP BY host),
{name}s AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) * {DAMPING} AS part FROM ({edges})),
{name}m(host, n, score) AS (SELECT host, 0, weight / (SELECT sum(weight) FROM {name}w) * {1 - DAMPING} FROM {name}w WHERE weight > 0 UNION ALL SELECT dst, n + 1, sum(score * part) FROM {name}m JOIN {name}s ON host = src WHERE score > 1e-200 GROUP BY dst, n),
{name}r AS (SELECT host, sum(score) AS score FROM {name}m GROUP BY host)"""

    lower = LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")
    return f"""WITH RECURSIVE u AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
p AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS hit FROM u),
e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT host AS src, {LOWER.format('raw')} AS dst FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s<>]+)', 1))) AS raw FROM p WHERE host != '')) WHERE src != dst GROUP BY ALL),
{walk('t', 'allow', 'SELECT src, dst, weight FROM e')}, {walk('b', 'block', 'SELECT dst AS src, src AS dst, weight FROM e')}
SELECT page_id, p.host, path, rule, coalesce(hit, CASE WHEN coalesce(y.score, 0) > {1 + CLOSE!r} * coalesce(x.score, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(x.score, 0), 9) AS trust, round(coalesce(y.score, 0), 9) AS distrust FROM p LEFT JOIN tr x ON p.host = x.host LEFT JOIN br y ON p.host = y.host"""


#: Smallest id that links (a, b: row numbers) reach, for rows v (rid, id).
REACH = """reach(a, b) AS (SELECT rid, rid FROM v UNION SELECT reach.a, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON reach.b = l.a),
least AS (SELECT reach.a AS rid, min(v.id) AS component_id FROM reach JOIN v ON reach.b = v.rid GROUP BY reach.a)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id AS id, regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS MATERIALIZED (SELECT rid, id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
x AS MATERIALIZED (SELECT rid, len(s) AS n, unnest(s) AS t FROM v),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM x a JOIN x b ON a.t = b.t AND a.rid < b.rid GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))), {REACH}
SELECT v.id AS doc_id, CAST(len(v.s) AS BIGINT) AS n_shingles, least.component_id FROM v JOIN least ON v.rid = least.rid"""

VECTORS = """WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id AS id, label, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.label = b.label AND a.rid < b.rid AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93),
""" + REACH + """, n AS (SELECT r, count(*) AS n FROM (SELECT a AS r FROM links UNION ALL SELECT b FROM links) GROUP BY r)
SELECT v.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, coalesce(v.id = component_id, false) AS kept FROM v JOIN least ON v.rid = least.rid LEFT JOIN n ON v.rid = n.r"""  # fmt: skip

_BENT = "SELECT vec_id + {0}, list_transform(embedding, lambda x, i: CAST(CAST(x AS DOUBLE) * (1 + ((i - 1) % 7 - 3) * {1}) AS FLOAT)), label FROM embeddings WHERE vec_id % 3 = 0"
COPIES = VECTORS.replace(" FROM embeddings)", f" FROM (SELECT vec_id, embedding, label FROM embeddings UNION ALL {_BENT.format(10_000_000, 0.0625)} UNION ALL {_BENT.format(20_000_000, 0.375)}))")

TOPK = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY asks ORDER BY score DESC, vec_id NULLS LAST) AS rank
FROM (SELECT a.rid AS asks, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid != b.rid)) WHERE rank <= 5"""

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '{END}{START}assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(i, r)),
f AS (SELECT *, '{START}' || replace({_ESCAPED.format('role')}, chr(10), '\\n') || chr(10) || {_ESCAPED.format('text')} || '{END}' || chr(10) AS piece FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, piece)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, piece) FILTER (role = '{TRAINED}'), '')) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""


LAYOUTS = f"""WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT conv_id, turn, 0 AS i, role, text FROM s WHERE conv_id % 4 != 3 UNION ALL SELECT conv_id, turn, 0, 'user', role FROM s WHERE conv_id % 4 = 3 UNION ALL SELECT conv_id, turn, 1, 'assistant', text FROM s WHERE conv_id % 4 = 3),
f AS (SELECT *, '{START}' || replace({_ESCAPED.format('role')}, chr(10), '\\n') || chr(10) || {_ESCAPED.format('text')} || '{END}' || chr(10) AS piece FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, i, role, piece)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, i, role, piece) FILTER (role = '{TRAINED}'), '')) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""


def repair() -> str:
    """Damage by a checksum worked out bit by bit, then edits row by row through the states of the grammar, with whole audits and texts."""
    said = "CASE WHEN {0}.t = '' THEN {1} ELSE {0}.t || chr(10) || {1} END"
    plus = lambda k, cost, letter, turn=None: f"{{'c': {k}.c + {cost}, 'a': {k}.a || '{letter}', 't': {said.format(k, turn) if turn else k + '.t'}}}"
    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"

    def put_in(inner: str, keep: str) -> str:
        """An empty turn put in, or none, from each state."""
        u, a = least("ku", *(plus(k, 3, "I", "'user:'") for k in ("k0", "ks", "ka"))), least("ka", plus("ku", 3, "I", "'assistant:'"))
        return f"SELECT {keep}k0, ks, {u} AS ku, {a} AS ka FROM ({inner})"

    row = "conv, i, state, role, text, initial, "
    before = put_in(put_in(put_in("SELECT r.conv, r.i, r.state, r.role, r.text, r.initial, k0, ks, ku, ka FROM dp JOIN r ON r.conv = dp.conv AND r.i = dp.i + 1", row), row), row)
    may = lambda k, initial, name: [f"CASE WHEN state != 'x' AND initial = '{initial}' THEN {plus(k, 'extra', 'K', kept)} END", *([f"CASE WHEN state != 'x' THEN {plus(k, '3 + extra', 'R', again.format(name))} END"] if name else [])]
    kept, again = "role || ':' || text", "'{}:' || text"
    gone = lambda k: plus(k, 4, "D")
    users = [x for k in ("k0", "ks", "ka") for x in may(k, "u", "user")]
    step = f"""SELECT conv, i, {gone('k0')} AS k0, {least(gone('ks'), *may('k0', 's', ''))} AS ks, {least(gone('ku'), *users)} AS ku, {least(gone('ka'), *may('ku', 'a', 'assistant'))} AS ka
FROM (SELECT *, CASE WHEN state = 't' THEN 3 ELSE 0 END AS extra FROM ({before}))"""
    after = put_in(put_in("SELECT conv, k0, ks, ku, ka FROM dp JOIN (SELECT conv AS c, max(i) AS n FROM r GROUP BY conv) ON conv = c AND i = n", "conv, "), "conv, ")
    never = "{'c': 1000000, 'a': '', 't': ''}"
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) x(i))),
o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS MATERIALIZED (SELECT conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda j: CAST(ascii(key[j]) AS BIGINT)), lambda c, b: xor(tab.t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS fault FROM o, tab),
d AS (SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM f, range(2) copies(n) WHERE fault != 0 AND (n = 0 OR fault = 3)),
n AS (SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, CAST(row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(length(role) || ':' || role || text)) AS BIGINT) AS i FROM d),
r AS MATERIALIZED (SELECT *, CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault, CASE WHEN fault IN ('b', 'd') THEN 'x' ELSE fault END AS state, lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM n),
dp AS (SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS k0, {never} AS ks, {never} AS ku, {never} AS ka FROM r UNION ALL {step}),
e AS (SELECT conv, {least('k0', 'ka')} AS k FROM ({after})),
c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(k.c, 0) AS BIGINT) AS cost, coalesce(k.a, '') AS audit, sha256(coalesce(k.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM o) LEFT JOIN c USING (conv) LEFT JOIN e USING (conv)"""


def clusters(k: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid in every round."""
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS c, q FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k}))"""
    near = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (SELECT rid, min(best).c AS c, min(best).d AS d FROM (SELECT rid, {{'d': CAST({near} AS BIGINT), 'c': c.c}} AS best FROM v, c{i} c) GROUP BY rid)"""
        if i < rounds:
            out += f""", m{i} AS (SELECT c, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY j) AS q FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.q) AS x, unnest(range(1, 65)) AS j FROM a{i} a JOIN v USING (rid)) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m{i}.q, c0.q) AS q FROM c{i} c0 LEFT JOIN m{i} ON c0.c = m{i}.c)"""
    return out + f""" SELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (rid) JOIN c{rounds} c ON a.c = c.c"""


ORACLES = {
    "op3_secret_scan": secret_scan(),
    "op4_url_filter": url_filter(),
    "op5_ngram_jaccard_join": JACCARD,
    "op6_embedding_near_dedup": VECTORS,
    "near_copies": COPIES,
    "op7_chat_format": CHAT,
    "chat_layouts": LAYOUTS,
    "op8_exact_topk": TOPK,
    "op12_turn_repair": repair(),
    "op13_centroid_clusters": clusters(),
}
