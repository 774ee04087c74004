"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat_template import CONTROL, ESCAPE
from .quality_rules import BIT, POLICIES, RULES, mask
from .secret_scan import BASE, EXTRA, MAX_OWNERS, MAX_REPOS, ORDER

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# 5 bits a letter, from the digest's hexadecimal digits
OP1 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda x: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', x) - 3, 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT)
    + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
    + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

# the exponent is bisected to the smallest that repeats no source more than 1.2 times
OP2 = f"""WITH RECURSIVE t AS (SELECT doc_id, source, CAST(greatest(len({WORDS}), 1) AS BIGINT) AS tokens, coalesce(CAST(doc_id AS STRING), '') || ':' || coalesce(length(text), 0) AS key FROM documents),
s AS (SELECT source, sum(tokens) AS tokens, sum(tokens) / (SELECT sum(tokens) FROM t) AS p, (SELECT sum(tokens) FROM t) AS total FROM t GROUP BY 1),
e AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
    SELECT k + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
        SELECT k, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(pow(p, (e.lo + e.hi) / 2) / p) / sum(pow(p, (e.lo + e.hi) / 2)) FROM s) <= 1.2 * (1 + 1e-12) AS ok FROM e WHERE k < 42) x),
a AS (SELECT CASE WHEN (SELECT max(1 / p) / count(*) FROM s) <= 1.2 * (1 + 1e-12) THEN 0 ELSE (SELECT hi FROM e WHERE k = 42) END AS a),
q AS (SELECT source, tokens, CAST(floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM s, a) * total + 1e-6) AS BIGINT) AS quota FROM s, a),
w AS (SELECT source, quota // tokens AS epochs, quota - (quota // tokens) * tokens AS part FROM q),
h AS (SELECT t.*, w.epochs, w.part, md5('1/' || epochs || '/' || key) AS hash FROM t JOIN w ON w.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, max(hash) AS cut FROM (SELECT source, hash, part, sum(tokens) OVER (PARTITION BY source ORDER BY hash) - tokens AS before FROM h) b WHERE before < part GROUP BY 1),
u AS (SELECT h.doc_id, h.source, h.tokens, h.key, unnest(range(0, CAST(h.epochs + CASE WHEN h.hash <= c.cut THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM h LEFT JOIN c ON c.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, source, tokens AS n_tokens, epoch, substr(md5('1/' || epoch || '/' || key), 1, 2) AS block, md5('1/' || epoch || '/' || key) AS place FROM u"""

_SPECIAL = "(" + "|".join("".join("\\" + c if not c.isalnum() and c not in "<>/" else c for c in x) for x in (ESCAPE, *CONTROL)) + ")"
_ESC = "regexp_replace({0}, '" + _SPECIAL + "', '\\\\\\1', 'g')"
OP4 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, CASE role WHEN 'user' THEN 15 + length({_ESC.format("text")}) WHEN 'assistant' THEN 5 + length({_ESC.format("text")})
    ELSE 17 + length({_ESC.format("role")}) + length({_ESC.format("text")}) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM l GROUP BY 1"""

_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))
_SOLE = " ".join(f"WHEN {bit} THEN '{rule}'" for rule, bit in BIT.items())
OP8 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT r, {WORDS} AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w) x),
o AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) x WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, i FROM o UNION ALL SELECT r, i + 1 FROM o UNION ALL SELECT r, i + 2 FROM o) x GROUP BY 1),
li AS (SELECT r, count(*) AS lines, count(DISTINCT line) AS kinds FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(li.lines - li.kinds, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(li.lines, 0) AS BIGINT) AS n_word_lines
    FROM d JOIN w ON w.r = d.r LEFT JOIN rep ON rep.r = d.r LEFT JOIN li ON li.r = d.r),
f AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask(POLICIES["base"])}) <> 0 AS base_failed, (fail_bits & {mask(tuple(BIT))}) = 0 AS kept, fail_bits,
    (fail_bits & {mask(POLICIES["v1"])}) = 0 AS kept_earlier, CASE fail_bits {_SOLE} END AS sole_rule, CASE WHEN fail_bits IN ({", ".join(map(str, BIT.values()))}) THEN count(*) OVER (PARTITION BY fail_bits) END AS n_sole FROM f"""

# all pairs that share a gram, on the driver's small tables
OP9 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, {WORDS} AS w FROM d),
g AS (SELECT DISTINCT r, g FROM (SELECT r, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0) x) y),
n AS (SELECT d.r, d.doc_id, count(g.g) AS n FROM d LEFT JOIN g ON g.r = d.r GROUP BY 1, 2),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON b.g = a.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach AS (SELECT r AS x, r AS y FROM n UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y)
SELECT n.doc_id, n.n AS n_shingles, min(m.doc_id) AS component_id FROM n JOIN reach ON reach.x = n.r JOIN n m ON m.r = reach.y GROUP BY n.r, n.doc_id, n.n"""


def _found(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, {k} AS kind, st AS start, st + length(m) AS stop, secret FROM (
        SELECT r, m[i] AS m, s[i] AS secret, CAST(coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st
        FROM (SELECT r, m, s, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {group}) AS s, string_split_regex(text, {p}) AS b FROM d WHERE regexp_matches(text, {p})) z) y) x
        WHERE length(secret) >= {least}"""


_NAMES = "[" + ", ".join(f"'{k}'" for k in ORDER) + "]"
_JOIN = f"string_agg({_NAMES}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
_N = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, (k, *_) in enumerate(BASE))
OP10 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found(i, *x) for i, x in enumerate((*BASE, *EXTRA)))}),
o AS (SELECT secret, count(DISTINCT coalesce('=' || owner, '')) > {MAX_OWNERS} OR count(DISTINCT coalesce('=' || owner, '') || chr(0) || coalesce('=' || repo, '')) > {MAX_REPOS} AS example FROM f JOIN d ON d.r = f.r GROUP BY 1),
j AS (SELECT f.*, o.example FROM f JOIN o ON o.secret = f.secret),
b AS (SELECT r, {_N}, {_JOIN} AS t FROM j WHERE kind < {len(BASE)} GROUP BY 1),
e AS (SELECT r, {_JOIN} AS t FROM j WHERE kind < {len(BASE)} OR NOT example GROUP BY 1),
n AS (SELECT r, count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example FROM j GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in BASE)}, sha256(coalesce(b.t, '')) AS base_sha256, coalesce(e.t, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN e ON e.r = d.r LEFT JOIN n ON n.r = d.r"""

ORACLES: dict[str, str] = {"op1_warc": OP1, "op2_source_mixing": OP2, "op4_chat_template": OP4, "op8_quality_rules": OP8, "op9_ngram_join": OP9, "op10_secret_scan": OP10}
