"""SQL twins of the operators' queries that SQL can express, for DuckDB over the same tables.

They are written from the definitions: plain windows of words, plain pairs, plain running sums.
"""

from __future__ import annotations

from corpuswatch.llm import chat_format as C
from corpuswatch.llm.queries import HOSTILE, MIX, URL_RULES

ORACLES: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LETTER_WORDS = r"regexp_extract_all(" + LOWER.format("coalesce({}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def windows(words: str, length: str) -> str:
    return f"list_transform(range(1, len({words}) - {length} + 2), lambda i: array_to_string({words}[i:i + {length} - 1], ' '))"


ORACLES["op2_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {BLANK_WORDS.format(LOWER.format("text"))} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE {windows("ws", "5")} END) AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * shared >= 80 * (total - shared)),
links AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT links.b, reach.other FROM reach JOIN links ON links.a = reach.doc_id)
SELECT s.doc_id, CAST(len(any_value(s.g)) AS BIGINT) AS n_shingles, min(reach.other) AS component_id
FROM s JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id
"""

ORACLES["op3_mixing"] = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(len({BLANK_WORDS.format("text")}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(source, '-'), coalesce(md5(text), '-'), '{MIX["seed"]}')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, {MIX["most"]} * sum(size)::BIGINT AS most,
    {list(MIX["weights"])}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(MIX["weights"])}] AS weight
  FROM d GROUP BY source),
ranked AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free, sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    row_number() OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS k
  FROM s),
stop AS (SELECT * FROM ranked WHERE most::DOUBLE * rest >= weight::DOUBLE * free ORDER BY k LIMIT 1),
t AS (
  SELECT r.source, r.source_size, CASE WHEN r.k < stop.k THEN r.most::DOUBLE ELSE r.weight::DOUBLE * stop.free::DOUBLE / stop.rest::DOUBLE END AS target FROM ranked r, stop),
q AS MATERIALIZED (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT doc_id, key, size, turn, (turn * source_size + done)::DOUBLE / target AS finish
  FROM (SELECT *, unnest(range(CAST(ceil(target / source_size) AS BIGINT))) AS turn FROM q WHERE size > 0 AND target > 0)),
lined AS (SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, turn ROWS UNBOUNDED PRECEDING) AS total FROM c),
n AS (SELECT doc_id, key, count(*) AS copies FROM lined WHERE total <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(copies, 0) * q.size AS BIGINT) AS taken, CAST(coalesce(copies, 0) AS BIGINT) AS copies
FROM q LEFT JOIN n USING (doc_id, key)
"""

_ESCAPED = "replace(replace(replace(replace({}, '\\', '\\\\'), '##', '\\#\\#'), '" + C.END + "', '<\\/turn>'), '" + C.PART + "', '<\\part>')"
ORACLES["op4_chat_format"] = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {text(HOSTILE)}), (-7, 1, 'assistant', {text(HOSTILE)})),
o AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND lag(turn) OVER w IS NOT NULL AS joined, row_number() OVER w AS k
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (
  SELECT *, length({_ESCAPED.format("text")}) + CASE WHEN joined THEN {len(C.PART)} ELSE {len(C.HEAD) + len(C.SEP) + len(C.END)} + length(replace({_ESCAPED.format("role")}, ': ', ':\\ ')) END AS chars
  FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

_FITS = "(host = {h} OR ends_with(host, {d})) AND starts_with(path, {p})"
_RULES = [(rule, verdict, _FITS.format(h=text(rule.partition("/")[0]), d=text("." + rule.partition("/")[0]), p=text("/" + rule.partition("/")[2]))) for rule, verdict in URL_RULES]
_RULES.sort(key=lambda r: -len(r[0]))
ORACLES["op5_url_rules"] = f"""
WITH u AS (
  SELECT page_id, coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits} THEN {text(rule)}" for rule, _, fits in _RULES)} END AS rule,
  CASE {" ".join(f"WHEN {fits} THEN {text(verdict)}" for _, verdict, fits in _RULES)} ELSE 'allow' END AS verdict
FROM u
"""

ORACLES["op7_substring_dedup"] = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {BLANK_WORDS.format("text")} AS ws FROM documents),
x AS (SELECT doc_id, unnest({windows("ws", "20")}) AS x, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20),
h AS MATERIALIZED (SELECT doc_id, p FROM x QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1),
c AS (SELECT DISTINCT doc_id, p + k AS p FROM h, range(20) AS g(k)),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM t ANTI JOIN c USING (doc_id, p) GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

ORACLES["op8_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {LETTER_WORDS.format("text")} AS ws FROM documents),
b AS (SELECT item_id, {LETTER_WORDS.format("text")} AS ws FROM benchmark),
g AS MATERIALIZED (SELECT DISTINCT item_id, n, unnest({windows("ws", "n")}) AS x FROM (SELECT *, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0)),
x AS (
  SELECT doc_id, n, unnest({windows("ws", "n")}) AS x, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n),
h AS MATERIALIZED (SELECT doc_id, item_id, p, n FROM x JOIN g USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM h, range(10) AS r(k) WHERE k < n GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def _crc_table() -> list[int]:
    """CRC-32 (reflected polynomial 0xEDB88320) of each byte value."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def crc32(column: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, byte by byte."""
    data = f"hex(encode({column}))"
    codes = f"list_transform(range(1, length({data}), 2), lambda i: CAST('0x' || substr({data}, i, 2) AS BIGINT))"
    step = f"xor({_crc_table()}[1 + xor(c & 255, b)], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}), 4294967295)"


#: Pairs by letters that are left out: two words differ by a replaced letter if leaving out one place makes them equal, by an
#: inserted one if leaving out a place of the longer makes it the shorter.
ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE r AS (
  SELECT concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':') AS doc, unnest(x) AS run
  FROM (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+') AS x FROM documents)),
h AS MATERIALIZED (SELECT run, {crc32("doc || run")} AS h FROM r WHERE length(run) >= 7),
v AS MATERIALIZED (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
e AS (SELECT DISTINCT d.word AS a, v.word AS b FROM d JOIN v ON v.word = d.less),
p AS MATERIALIZED (
  SELECT DISTINCT a.word AS a, b.word AS b FROM d a JOIN d b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
  UNION ALL SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
f AS MATERIALIZED (
  SELECT v.word, v.n, count(p.b) AS n_near, min({{'less': -o.n, 'form': o.word}}) FILTER (o.n >= 10 * v.n) AS best
  FROM v LEFT JOIN p ON p.a = v.word LEFT JOIN v o ON o.word = p.b GROUP BY v.word, v.n),
c AS (
  SELECT word, word AS here, 0 AS steps FROM f
  UNION ALL SELECT c.word, f.best.form, steps + 1 FROM c JOIN f ON f.word = c.here WHERE f.best IS NOT NULL),
s AS (SELECT word, max_by(here, steps) AS root FROM c GROUP BY word)
SELECT f.word, best.form AS form, root, n, n_near, -best.less AS form_n FROM f JOIN s USING (word)
"""


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _way(before: str, cost: str, audit: str, lines: str, only: str = "true") -> str:
    """One more edit after a way (cost, audit, lines); none if there was no way, or if ``only`` does not hold."""
    return f"CASE WHEN {only} AND {before} IS NOT NULL THEN {{'c': {before}.c + {cost}, 'a': {before}.a || '{audit}', 't': list_concat({before}.t, {lines})}} END"


#: Best ways with turns inserted before a row: z nothing yet, s system, u user (an assistant must follow), p pairs.
_INSERTED = {
    "u": _least("u", *[_way(w, "2", "I", "['user:']") for w in "zsp"], _way("u", "4", "II", "['assistant:', 'user:']")),
    "p": _least("p", _way("u", "2", "I", "['assistant:']"), *[_way(w, "4", "II", "['user:', 'assistant:']") for w in "zsp"]),
}
_STAYS, _COSTS, _LINE = "fault NOT IN ('blank', 'duplicate')", "CAST(fault = 'truncated' AS BIGINT)", "[role || ':' || text]"
_AFTER = {state: [_way(state, "3", "D", "CAST([] AS VARCHAR[])")] for state in "zsup"}
_AFTER["s"].append(_way("z", _COSTS, "K", _LINE, f"{_STAYS} AND initial = 's'"))
for _state, _before, _name in (("u", "zsp", "user"), ("p", "u", "assistant")):
    for _w in _before:
        _AFTER[_state].append(_way(_w, _COSTS, "K", _LINE, f"{_STAYS} AND initial = '{_name[0]}'"))
        _AFTER[_state].append(_way(_w, "2 + " + _COSTS, "R", f"['{_name}:' || text]", _STAYS))
_NO_WAY = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]))"
ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM k WHERE kind <> 0),
o AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
r AS MATERIALIZED (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM o),
m AS MATERIALIZED (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
    count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(illegal) AS illegal FROM r GROUP BY conv_id),
x AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS z, {_NO_WAY} AS s, {_NO_WAY} AS u, {_NO_WAY} AS p FROM m
  UNION ALL
  SELECT conv_id, i, {", ".join(_least(*_AFTER[state]) for state in "zsup")}
  FROM (
    SELECT z, s, {_INSERTED["u"]} AS u, {_INSERTED["p"]} AS p, r.conv_id, r.i, r.role, r.text, r.initial, r.fault
    FROM x JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i + 1)),
e AS (
  SELECT m.*, {_least("z", "p", _way("u", "2", "I", "['assistant:']"), _way("s", "4", "II", "['user:', 'assistant:']"))} AS w
  FROM x JOIN m ON m.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = m.n)
SELECT DISTINCT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
FROM conversations c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
