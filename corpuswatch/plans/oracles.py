"""SQL twins of the registered queries, for DuckDB over the same parquet tables.

They are written from the definitions of the operators, not from the Spark plans: sequential rules
(keep-first, anchored windows) are recursive queries that walk the rows in order.
"""

from __future__ import annotations

import hashlib

from corpuswatch import lexicons as L
from corpuswatch.functions.fingerprints import MERSENNE_31
from corpuswatch.operators import dedup as D
from corpuswatch.operators import verdicts as J
from corpuswatch.plans import fixtures as X
from corpuswatch.plans.queries import RENAMED

ORACLES: dict[str, str] = {}


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(text(i) for i in items) + "]"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def hits(lowered: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({lowered}, {text(t)})::INT" for t in terms) + ")"


# -- common tables ----------------------------------------------------------------------------------------

ART = """art AS (
  SELECT *, sha256(title || content) AS content_hash, crawled_at AS published_at FROM (
    SELECT doc_id, 'doc://' || doc_id AS url, split_part(text, chr(10), 1) AS title, text AS content, source,
      upper(lang) AS region, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS crawled_at FROM documents))"""


def category_hits(lexicon: dict[str, list[str]], chars: int | None, name: str = "cat_hits") -> str:
    body = "content" if chars is None else f"substr(content, 1, {chars})"
    rows = [(label, i, t) for i, (label, terms) in enumerate(lexicon.items()) for t in terms]
    return f"""{name} AS (
  SELECT doc_id, label, rank, least(count(*) / 3.0, 1.0) AS score
  FROM art JOIN ({values(rows)}) AS lex(label, rank, term) ON contains(lower(title || '. ' || {body}), term)
  GROUP BY doc_id, label, rank)"""


def sentiment(chars: int | None) -> str:
    body = "content" if chars is None else f"substr(content, 1, {chars})"
    low = f"lower(title || '. ' || {body})"
    return f"""mood AS (
  SELECT doc_id, CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
    CASE WHEN s > 0.1 THEN round(0.5 + s * 0.5, 4) WHEN s < -0.1 THEN round(0.5 - abs(s) * 0.5, 4) ELSE 0.5 END AS sentiment_score
  FROM (SELECT doc_id, (p - n)::DOUBLE / greatest(p + n, 1) AS s
        FROM (SELECT doc_id, {hits(low, X.POSITIVE)} AS p, {hits(low, X.NEGATIVE)} AS n FROM art)))"""


LAB = f"""{ART},
{category_hits(X.LEXICON, None)},
cats AS (
  SELECT doc_id, list(label ORDER BY score DESC, rank) AS categories, max(score) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) AS n FROM cat_hits) WHERE n <= 3 GROUP BY doc_id),
{sentiment(None)},
lab AS (
  SELECT art.*, coalesce(categories, ['general']) AS categories, coalesce(best, 0.5) AS best, sentiment_label, sentiment_score
  FROM art LEFT JOIN cats USING (doc_id) JOIN mood USING (doc_id))"""

TAG = f"""{LAB},
texts AS (SELECT doc_id, title || '. ' || content AS t FROM art),
raw_tags AS (
  SELECT doc_id, t, w AS name, label FROM (
    SELECT DISTINCT doc_id, t, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) AS w FROM texts)
  JOIN ({values(X.GAZETTEER)}) AS g(gname, label) ON lower(w) = gname
  UNION SELECT doc_id, t, unnest(regexp_extract_all(t, '\\d+(?:\\.\\d+)?\\s?%')), 'PERCENT' FROM texts
  UNION SELECT doc_id, t, unnest(regexp_extract_all(t, '[$€£]\\s?\\d[\\d,]*(?:\\.\\d+)?')), 'MONEY' FROM texts
  UNION SELECT doc_id, t, unnest(regexp_extract_all(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}')), 'DATE' FROM texts),
tags AS (
  SELECT doc_id, name, label,
    length(regexp_extract(t, '(?s)^(|.*?[^\\p{{L}}\\p{{N}}])' || regexp_escape(name) || '(?:[^\\p{{L}}\\p{{N}}]|$)', 1)) AS start
  FROM raw_tags),
typed AS (
  SELECT doc_id, type, name, min(start) AS start FROM tags JOIN ({values(list(L.ENTITY_TYPES.items()))}) AS ty(label, type) USING (label)
  WHERE length(trim(name)) >= 2 GROUP BY doc_id, type, name),
ent AS (SELECT *, min(start) OVER (PARTITION BY doc_id, type) AS type_at FROM typed),
ents AS (
  SELECT doc_id, list({{'name': name, 'type': type}} ORDER BY type_at, start) AS entities FROM ent GROUP BY doc_id),
tagged AS MATERIALIZED (SELECT lab.*, coalesce(entities, []) AS entities FROM lab LEFT JOIN ents USING (doc_id))"""

MENTIONS = """m AS (
  SELECT 'cat' AS kind, event_type AS name, ts FROM events UNION ALL SELECT 'ent', 'user:' || user_id, ts FROM events)"""

INC = """inc AS (
  SELECT event_id::VARCHAR AS article_hash, event_type || ' ' || event_id AS title, 'feed' || user_id % 7 AS source, ts AS published_at,
    event_type AS subcategory, upper(event_type[1]) || substr(event_type, 2) AS subcategory_label,
    0.5 + (event_id % 50) / 100.0 AS credibility_score, least((round(value * 100)::BIGINT + 1) // 2, 1000) / 1000.0::DOUBLE AS anomaly_score,
    CASE WHEN user_id % 5 <> 0 THEN 'R' || user_id % 5 END AS region, 'person:user' || user_id AS entity, props
  FROM events)"""

BAT = f"""{INC},
bat AS (
  SELECT *, count(*) OVER (PARTITION BY batch_id) < 50 AS pending FROM (
    SELECT *, (row_number() OVER (ORDER BY published_at, article_hash) - 1) // 200 AS batch_id FROM inc))"""


def mean(c: str) -> str:
    return f"round(sum({c}::DECIMAL(18,6))::DOUBLE / count({c}), 9)"


def rnd(x: str, n: int) -> str:
    """Half up on the decimal value; nine decimals first, so that binary noise does not decide."""
    return f"round(round({x}, 9)::DECIMAL(18,9), {n})::DOUBLE"


def anchors(hours: int) -> str:
    return f"""anchor(batch_id, a) AS (
  SELECT batch_id, min(published_at) FROM bat GROUP BY batch_id
  UNION ALL
  SELECT anchor.batch_id, (SELECT min(b.published_at) FROM bat b WHERE b.batch_id = anchor.batch_id AND b.published_at > a + INTERVAL {hours} HOURS)
  FROM anchor WHERE EXISTS (SELECT 1 FROM bat b WHERE b.batch_id = anchor.batch_id AND b.published_at > a + INTERVAL {hours} HOURS))"""


def cluster_tables(hours: int = 6) -> str:
    return f"""{BAT},
{anchors(hours)},
temporal AS (
  SELECT b.*, (SELECT max(a) FROM anchor WHERE anchor.batch_id = b.batch_id AND a <= b.published_at) AS a FROM bat b),
t_cl AS (
  SELECT batch_id, 'temporal' AS cluster_type, NULL::VARCHAR AS region, list(article_hash ORDER BY published_at, article_hash) AS events,
    list(DISTINCT region ORDER BY region) FILTER (region IS NOT NULL) AS regions, count(*) AS size,
    {mean('anomaly_score')} AS anomaly, {mean('credibility_score')} AS cred,
    {rnd(f"least({mean('anomaly_score')} * {mean('credibility_score')} * 1.5, 1.0)", 3)} AS confidence
  FROM temporal GROUP BY batch_id, a HAVING count(*) >= 3),
s_cl AS (
  SELECT batch_id, 'spatial' AS cluster_type, region, list(article_hash ORDER BY published_at, article_hash) AS events,
    NULL::VARCHAR[] AS regions, count(*) AS size, {mean('anomaly_score')} AS anomaly, {mean('credibility_score')} AS cred,
    {rnd(f"least({mean('anomaly_score')} * 1.2, 1.0)", 3)} AS confidence
  FROM bat WHERE region IS NOT NULL GROUP BY batch_id, region HAVING count(*) >= 3),
cl AS (
  SELECT *, sha256(cluster_type || '|' || array_to_string(events, '|')) AS cluster_id FROM (SELECT * FROM t_cl UNION ALL SELECT * FROM s_cl)),
pos AS (SELECT cluster_id, batch_id, unnest(events) AS article_hash, unnest(range(len(events))) AS pos FROM cl),
ce AS (SELECT pos.cluster_id, pos.pos, bat.* FROM pos JOIN bat USING (batch_id, article_hash))"""


# -- sources ----------------------------------------------------------------------------------------------

ORACLES["content_hash_reference"] = with_(ART) + "SELECT doc_id, sha256(title || substr(content, 1, 500)) AS content_hash FROM art"
ORACLES["content_hash"] = with_(ART) + "SELECT doc_id, content_hash FROM art"

ORACLES["ranked_id_list"] = """
WITH a AS (SELECT event_id AS id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS pos FROM events),
b AS (SELECT event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS pos FROM events)
SELECT id, 0 AS list, pos FROM a WHERE pos < 100
UNION ALL SELECT id, 1, pos FROM b WHERE pos < 50 AND id NOT IN (SELECT id FROM a WHERE pos < 100)"""

ORACLES["page_text_without_tags"] = r"""
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)"""


def element(tag: str, separator: str) -> str:
    inner = rf"regexp_extract(v, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1)"
    bare = rf"regexp_replace(regexp_replace({inner}, '\s*(?:<[^>]+>\s*)+', '{separator}', 'g'), '^\s+|\s+$', '', 'g')"
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', '{char}')"
    return bare


ORACLES["page_articles"] = rf"""
WITH vis AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g') AS v FROM pages),
parsed AS (SELECT page_id, {element('h1', '')} AS title, {element('article', ' ')} AS content, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS source FROM vis)
SELECT page_id, title, length(content) AS n_chars, md5(content) AS content_md5, source,
  sha256(title || content) AS content_hash, '2024-02-01 00:00:00' AS published_at
FROM parsed WHERE title <> '' AND length(content) >= 100"""


def links(where: str, cap: int | None = None) -> str:
    return rf"""
WITH h AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS hs FROM pages),
e AS (SELECT page_id, url, unnest(hs) AS h, unnest(range(len(hs))) AS p FROM h),
r AS (SELECT page_id, p, CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^https?://[^/?#]*') || h ELSE h END AS link,
        regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, h FROM e),
d AS (SELECT page_id, link, min(p) AS p FROM r WHERE regexp_extract(link, '^https?://([^/?#]*)', 1) = host {where} GROUP BY page_id, link),
n AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS pos FROM d)
SELECT page_id, pos, link FROM n {"" if cap is None else f"WHERE pos < {cap}"}"""


ORACLES["page_links"] = links("")
ORACLES["page_links_reference"] = links("", 30)
ORACLES["page_links_rendered"] = links("AND length(regexp_extract(h, '^[^?#]*')) > 12")

ORACLES["source_info"] = """
SELECT r_name AS source_region, s_suppkey % 3 + 1 AS source_priority, count(*) AS articles, sum(l_quantity)::BIGINT AS quantity
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""

# -- tables -----------------------------------------------------------------------------------------------

ORACLES["upserted_articles"] = with_(LAB) + f""",
base AS (SELECT * FROM lab WHERE doc_id IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY crawled_at, url) = 1),
fst AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY crawled_at, url) = 1),
lst AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY crawled_at DESC, url DESC) = 1)
SELECT content_hash, coalesce(base.url, fst.url) AS url, array_to_string(lst.categories, ',') AS categories, lst.sentiment_label,
  {stamp("lst.crawled_at + INTERVAL 1 DAY")} AS processed_at
FROM lst JOIN fst USING (content_hash) LEFT JOIN base USING (content_hash)"""

ORACLES["fact_rows"] = with_(TAG) + r"""
SELECT content_hash, url, md5(substr(title, 1, 500)) AS title_md5, region, array_to_string(categories, ',') AS categories, sentiment_label,
  sentiment_score, len(entities) AS entity_count, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS word_count,
  strftime(crawled_at, '%Y%m') AS month FROM tagged"""

ORACLES["upserted_vectors"] = """
SELECT vec_id AS id, CASE WHEN label = 1 THEN 2 ELSE 1 END AS updated_at,
  round(sign * embedding[1]::DOUBLE / norm, 4) AS first, round(sign * embedding[64]::DOUBLE / norm, 4) AS last
FROM (SELECT *, CASE WHEN label = 1 THEN -1 ELSE 1 END AS sign, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"""

# -- lists and filters ------------------------------------------------------------------------------------

LIST = f"""SELECT content_hash, url, source, {stamp('published_at')} AS published_at, array_to_string(categories, ',') AS categories,
  sentiment_label, sentiment_score, region"""
NEWEST = "ORDER BY published_at DESC NULLS FIRST, content_hash, url"

ORACLES["article_list"] = with_(LAB) + f"{LIST} FROM lab {NEWEST} LIMIT 50 OFFSET 10"
ORACLES["article_list_filtered"] = with_(LAB) + (
    f"{LIST} FROM lab WHERE list_contains(categories, 'alpha') AND sentiment_label = 'positive' AND region = 'EN' {NEWEST} LIMIT 200"
)
ORACLES["feed_filtered"] = with_(LAB) + f"{LIST} FROM (SELECT * FROM lab WHERE list_contains(categories, 'gamma') AND sentiment_label = 'negative' {NEWEST} LIMIT 200)"
ORACLES["feed_filtered_reference"] = with_(LAB) + (
    f"{LIST} FROM (SELECT * FROM lab {NEWEST} LIMIT 200) WHERE list_contains(categories, 'gamma') AND sentiment_label = 'negative'"
)
for name, source in (("unusual_event_feed", "inc"), ("unusual_event_feed_reference", "(SELECT * FROM inc ORDER BY published_at DESC, article_hash LIMIT 150)")):
    ORACLES[name] = with_(INC) + f"""
SELECT article_hash, subcategory, anomaly_score, {stamp('published_at')} AS published_at
FROM {source} WHERE subcategory = 'purchase' AND anomaly_score >= 0.3 ORDER BY published_at DESC, article_hash LIMIT 50"""
ORACLES["recent_events"] = """
SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOURS"""
ORACLES["score_bands"] = with_(INC) + """
SELECT article_hash,
  CASE WHEN credibility_score >= 0.65 THEN 'verified' WHEN credibility_score >= 0.4 THEN 'unverified' ELSE 'low credibility' END AS credibility_band,
  CASE WHEN anomaly_score >= 0.8 THEN 'critical' WHEN anomaly_score >= 0.65 THEN 'high' WHEN anomaly_score >= 0.5 THEN 'elevated' ELSE 'normal' END AS anomaly_level,
  CASE WHEN anomaly_score >= 0.75 THEN 'high' WHEN anomaly_score >= 0.55 THEN 'medium' ELSE 'low' END AS anomaly_bar,
  floor(anomaly_score * 100 + 0.5)::BIGINT AS anomaly_pct, floor(credibility_score::DOUBLE * 100 + 0.5)::BIGINT AS confidence_pct,
  CASE WHEN floor(credibility_score::DOUBLE * 100 + 0.5) >= 75 THEN 'high' WHEN floor(credibility_score::DOUBLE * 100 + 0.5) >= 55 THEN 'medium' ELSE 'low' END AS confidence_bar
FROM inc"""
ORACLES["age_labels"] = """
SELECT event_id, CASE WHEN us < 60000000 THEN us // 1000000 || 's ago' WHEN us < 3600000000 THEN us // 60000000 || 'm ago'
  WHEN us < 86400000000 THEN us // 3600000000 || 'h ago' ELSE us // 86400000000 || 'd ago' END AS age
FROM (SELECT event_id, epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) AS us FROM events)"""

# -- dedup ------------------------------------------------------------------------------------------------


def normalized(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def dedup_body(chars: int | None) -> str:
    return "title || ' ' || content" if chars is None else f"title || ' ' || substr(content, 1, {chars})"


def fingerprints(body: str, name: str = "fp") -> str:
    bits = ", ".join(
        f"(CASE WHEN 2 * sum((v >> {i}) & 1) > count(*) THEN {1 << i if i < 63 else -(1 << 63)} ELSE 0 END)::HUGEINT AS b{i}" for i in range(64)
    )
    total = " + ".join(f"b{i}" for i in range(64))
    return f"""{name}_w AS (
  SELECT doc_id, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS v FROM (SELECT doc_id, unnest(string_split({normalized(body)}, ' ')) AS w FROM art) WHERE w <> ''),
{name}_b AS (SELECT doc_id, {bits} FROM {name}_w GROUP BY doc_id),
{name} AS (SELECT art.doc_id, coalesce({total}, 0)::BIGINT AS simhash FROM art LEFT JOIN {name}_b USING (doc_id))"""


ORACLES["normalized_text"] = f"SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, {normalized('text')} AS t FROM documents)"

EXACT = "SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY crawled_at, url) = 1"
ORACLES["dedup_exact"] = with_(ART) + f"SELECT content_hash, url FROM ({EXACT})"

ORACLES["dedup_exact_with_memory"] = """
WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS k, ts, event_id FROM events),
kept(k, ts) AS (
  SELECT k, min(ts) FROM e GROUP BY k
  UNION ALL
  SELECT kept.k, min(e.ts) FROM kept JOIN e ON e.k = kept.k AND e.ts >= kept.ts + INTERVAL 6 HOURS GROUP BY kept.k, kept.ts)
SELECT k, min(event_id) AS event_id FROM kept JOIN e USING (k, ts) GROUP BY k, ts"""

ORACLES["unseen_articles"] = with_(ART) + """
SELECT doc_id, content_hash FROM art WHERE content_hash NOT IN (SELECT content_hash FROM art JOIN labels USING (doc_id))"""

ORACLES["simhash_fingerprints"] = with_(ART, fingerprints(dedup_body(None))) + "SELECT doc_id, simhash FROM fp"
ORACLES["simhash_fingerprints_reference"] = with_(ART, fingerprints(dedup_body(300))) + "SELECT doc_id, simhash FROM fp"
ORACLES["simhash_fingerprints_whole_text"] = with_(ART, fingerprints(dedup_body(None))) + "SELECT doc_id, simhash FROM fp"
ORACLES["fingerprint_distance"] = with_(ART, fingerprints(dedup_body(None)), fingerprints("content", "fq")) + """
SELECT doc_id, bit_count(xor(fp.simhash, fq.simhash))::BIGINT AS distance FROM fp JOIN fq USING (doc_id)"""
ORACLES["dedup_simhash_equal"] = with_(ART, fingerprints(dedup_body(None))) + """
SELECT url, simhash FROM art JOIN fp USING (doc_id) QUALIFY row_number() OVER (PARTITION BY simhash ORDER BY crawled_at, url) = 1"""


def keep_first(source: str, edges: str) -> str:
    """Walk the rows in order (``o``) and keep each one without a kept earlier neighbour.

    ``source`` has (doc_id, o); ``edges`` has (a, b) with a before b, both as doc_id. Only rows with an
    earlier neighbour take a step.
    """
    return f"""src AS ({source}), edg AS ({edges}),
step AS (
  SELECT row_number() OVER (ORDER BY o) AS i, doc_id, earlier
  FROM src JOIN (SELECT b AS doc_id, list(DISTINCT a) AS earlier FROM edg GROUP BY b) USING (doc_id)),
walk(i, dropped) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT step.i, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, doc_id) ELSE dropped END
  FROM walk JOIN step ON step.i = walk.i + 1),
gone AS (SELECT unnest(dropped) AS doc_id FROM walk WHERE i = (SELECT max(i) FROM walk)),
kept AS (SELECT doc_id FROM src WHERE doc_id NOT IN (SELECT doc_id FROM gone))"""


def simhash_layer(input_table: str) -> str:
    """Distance edges between all rows of a table with doc_id, url, crawled_at and simhash."""
    return keep_first(
        f"SELECT doc_id, row_number() OVER (ORDER BY crawled_at, url) AS o FROM {input_table}",
        f"""SELECT a.doc_id AS a, b.doc_id AS b FROM {input_table} a JOIN {input_table} b
          ON a.crawled_at < b.crawled_at AND bit_count(xor(a.simhash, b.simhash)) <= 5""",
    )


for name, chars in (("dedup_simhash", None), ("dedup_simhash_whole_text", None)):
    ORACLES[name] = (
        with_(ART, fingerprints(dedup_body(chars)), "inp AS (SELECT art.*, simhash FROM art JOIN fp USING (doc_id))", simhash_layer("inp"), recursive=True)
        + "SELECT url, simhash FROM inp JOIN kept USING (doc_id)"
    )

PERM = [
    (i, max((int(hashlib.md5(f"a{i}".encode()).hexdigest()[:8], 16) & MERSENNE_31) % MERSENNE_31, 1),
     (int(hashlib.md5(f"b{i}".encode()).hexdigest()[:8], 16) & MERSENNE_31) % MERSENNE_31)
    for i in range(D.NUM_PERM)
]


def signatures(body: str, source: str = "art") -> str:
    return f"""words AS (
  SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split({normalized(body)}, ' ')) AS w FROM {source}) WHERE w <> ''),
perm AS (SELECT * FROM ({values(PERM)}) AS p(i, a, b)),
sig AS (
  SELECT s.doc_id, i, coalesce(v, {MERSENNE_31}) AS v FROM (SELECT doc_id, i FROM {source}, perm) s LEFT JOIN (
    SELECT doc_id, i, min(((('0x' || substr(md5(w), 1, 8))::BIGINT & {MERSENNE_31}) * a + b) % {MERSENNE_31}) AS v FROM words, perm GROUP BY doc_id, i)
  USING (doc_id, i)),
bands AS (SELECT doc_id, i // {D.ROWS} AS band, string_agg(v::VARCHAR, ',' ORDER BY i) AS k FROM sig GROUP BY doc_id, i // {D.ROWS})"""


ORACLES["minhash_signatures"] = with_(ART, signatures(dedup_body(None))) + "SELECT doc_id, md5(string_agg(v::VARCHAR, ',' ORDER BY i)) AS signature_md5 FROM sig GROUP BY doc_id"
ORACLES["minhash_signatures_reference"] = ORACLES["minhash_signatures"].replace(dedup_body(None), dedup_body(500))
ORACLES["lsh_buckets"] = with_(ART, signatures(dedup_body(None))) + "SELECT band, min(doc_id) AS first_doc, count(*) AS n FROM bands GROUP BY band, k HAVING count(*) > 1"

SHARED = "SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.k = y.k"


def jaccard_edges(source: str) -> str:
    return f"""sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
cand AS ({SHARED} JOIN {source} p ON p.doc_id = x.doc_id JOIN {source} q ON q.doc_id = y.doc_id WHERE p.crawled_at < q.crawled_at),
common AS (SELECT c.a, c.b, count(*) AS n FROM cand c JOIN words x ON x.doc_id = c.a JOIN words y ON y.doc_id = c.b AND y.w = x.w GROUP BY c.a, c.b),
jac AS (
  SELECT cand.a, cand.b, CASE WHEN sa.n IS NULL AND sb.n IS NULL THEN 1.0
    ELSE coalesce(common.n, 0)::DOUBLE / (coalesce(sa.n, 0) + coalesce(sb.n, 0) - coalesce(common.n, 0)) END AS jaccard
  FROM cand LEFT JOIN common USING (a, b) LEFT JOIN sizes sa ON sa.doc_id = cand.a LEFT JOIN sizes sb ON sb.doc_id = cand.b)"""


ORACLES["lsh_verified"] = with_(ART, signatures(dedup_body(None)), jaccard_edges("art"), "lead AS (SELECT band, k, min(doc_id) AS a FROM bands GROUP BY band, k)",
    "lp AS (SELECT DISTINCT lead.a, doc_id AS b FROM bands JOIN lead USING (band, k) WHERE doc_id <> lead.a)") + """
SELECT a, b, round(jaccard, 6) AS jaccard FROM lp JOIN jac USING (a, b) WHERE jaccard >= 0.85"""


def minhash_layer(source: str, chars: int | None, verify: bool) -> list[str]:
    order = f"SELECT doc_id, row_number() OVER (ORDER BY crawled_at, url) AS o FROM {source}"
    parts = [signatures(dedup_body(chars), source)]
    if verify:
        return parts + [jaccard_edges(source), keep_first(order, "SELECT a, b FROM jac WHERE jaccard >= 0.85")]
    return parts + [keep_first(order, f"{SHARED} JOIN {source} p ON p.doc_id = x.doc_id JOIN {source} q ON q.doc_id = y.doc_id WHERE p.crawled_at < q.crawled_at")]


for name, chars, verify in (("dedup_minhash", None, True), ("dedup_minhash_whole_text", None, True), ("dedup_minhash_unverified", None, False)):
    ORACLES[name] = with_(ART, *minhash_layer("art", chars, verify), recursive=True) + "SELECT url FROM art JOIN kept USING (doc_id)"


def _renamed(cte: str, suffix: str) -> str:
    for t in ("src", "edg", "step", "walk", "gone", "kept"):
        for before in (f"{t} AS", f"{t}(i", f"FROM {t}", f"JOIN {t}"):
            cte = cte.replace(before, before.replace(t, t + suffix))
        cte = cte.replace(f" {t}.", f" {t}{suffix}.")
    return cte


def layers(reference: bool) -> str:
    ctes = [ART, fingerprints(dedup_body(300 if reference else None)), f"l1 AS (SELECT x.*, simhash FROM ({EXACT}) x JOIN fp USING (doc_id))"]
    if reference:
        ctes.append("l2 AS (SELECT * FROM l1 QUALIFY row_number() OVER (PARTITION BY simhash ORDER BY crawled_at, url) = 1)")
    else:
        ctes += [_renamed(simhash_layer("l1"), "_s"), "l2 AS (SELECT l1.* FROM l1 JOIN kept_s USING (doc_id))"]
    ctes += minhash_layer("l2", 500 if reference else None, not reference)
    return with_(*ctes, recursive=True) + """
SELECT url, CASE WHEN doc_id NOT IN (SELECT doc_id FROM l1) THEN 'exact' WHEN doc_id NOT IN (SELECT doc_id FROM l2) THEN 'simhash'
  WHEN doc_id NOT IN (SELECT doc_id FROM kept) THEN 'minhash' END AS dropped_by FROM art"""


ORACLES["dedup_layers"] = layers(False)
ORACLES["dedup_layers_reference"] = layers(True)

# -- enrichment -------------------------------------------------------------------------------------------

ORACLES["keyword_category_hits"] = with_(ART, category_hits(X.LEXICON, None)) + "SELECT doc_id, label AS category, round(score, 4) AS score FROM cat_hits"
ORACLES["keyword_category_hits_reference"] = ORACLES["keyword_category_hits"].replace(category_hits(X.LEXICON, None), category_hits(X.LEXICON, 512))
ORACLES["keyword_category_hits_default_whole_text"] = (
    with_(ART, category_hits(L.CATEGORY_KEYWORDS, None)) + "SELECT doc_id, label AS category, round(score, 4) AS score FROM cat_hits"
)
ORACLES["top_categories"] = with_(LAB) + "SELECT doc_id, array_to_string(categories, ',') AS categories, round(best, 4) AS best FROM lab"
CLASSES = """SELECT doc_id, sentiment_label AS label, sentiment_score AS score,
  CASE WHEN sentiment_label = 'positive' THEN sentiment_score ELSE 0.2 END AS positive,
  CASE WHEN sentiment_label = 'negative' THEN sentiment_score ELSE 0.2 END AS negative,
  CASE WHEN sentiment_label = 'neutral' THEN sentiment_score ELSE 0.6 END AS neutral FROM mood"""
ORACLES["keyword_sentiment"] = with_(ART, sentiment(None)) + CLASSES
ORACLES["keyword_sentiment_reference"] = with_(ART, sentiment(512)) + CLASSES
ORACLES["keyword_sentiment_whole_text"] = with_(ART, sentiment(None)) + CLASSES
ORACLES["tagged_entities"] = with_(TAG) + "SELECT doc_id, name, label, start FROM tags"
ORACLES["entities_from_tags"] = f"""
WITH t AS (
  SELECT l_orderkey AS k, l_linenumber AS pos, p_brand AS name,
    (['PERSON', 'ORG', 'GPE', 'CARDINAL', 'MONEY', 'PERCENT'])[p_size % 6 + 1] AS label FROM lineitem JOIN part ON l_partkey = p_partkey),
ty AS (SELECT k, type, name, min(pos) AS pos, arg_min(label, (pos, label)) AS label FROM t JOIN ({values(list(L.ENTITY_TYPES.items()))}) AS m(label, type) USING (label) GROUP BY k, type, name),
o AS (SELECT *, min(pos) OVER (PARTITION BY k, type) AS seen FROM ty)
SELECT k, string_agg(type || '/' || name || '/' || pos, ';' ORDER BY seen, pos, name, label) AS entities FROM o GROUP BY k"""
ORACLES["title_keywords"] = with_(ART) + rf"""
SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(title, '\s+'),
  lambda w: length(w) > 4 AND NOT list_contains({strings(L.TITLE_STOPWORDS)}, lower(w))), lambda w: lower(w))[1:5], ',') AS keywords FROM art"""
ORACLES["text_counts"] = with_(TAG) + r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS word_count, len(entities) AS entity_count FROM tagged"""


def reliability(c: str) -> str:
    low = f"lower({c})"
    bad = " OR ".join(f"contains({low}, {text(s)})" for s in L.DISTRUSTED_SOURCES)
    good = " OR ".join(f"contains({low}, {text(s)})" for s in L.TRUSTED_SOURCES)
    return f"CASE WHEN {bad} THEN 0.1 WHEN {good} THEN 0.9 ELSE 0.5 END::DOUBLE"


def credibility(c: str) -> str:
    return f"greatest(0.05, least(1.0, 0.5::DOUBLE + {hits(f'lower({c})', X.BOOSTS)} * 0.08 - {hits(f'lower({c})', X.PENALTIES)} * 0.1))"


ORACLES["source_reliability"] = with_(ART) + f"SELECT doc_id, {reliability('source')} AS by_source, {reliability('title')} AS by_title FROM art"
ORACLES["content_credibility"] = with_(ART) + f"SELECT doc_id, round({credibility('content')}, 4) AS credibility FROM art"
ORACLES["unusual_events"] = with_(
    ART,
    f"sig(name, label, base, need, term, i, j) AS ({values([(n, lab, b, need, t, i, j) for i, (n, lab, b, need, ts) in enumerate(X.EVENT_SIGNALS) for j, t in enumerate(ts)])})",
    """hit AS (
  SELECT doc_id, name, label, base, i, count(*) AS n, string_agg(term, ',' ORDER BY j) AS signals
  FROM art JOIN sig ON contains(lower(title || ' ' || content), term) GROUP BY doc_id, name, label, base, i, need HAVING count(*) >= need)""",
) + f"""
SELECT content_hash AS article_hash, url, name AS subcategory, label AS subcategory_label,
  round({reliability('source')} * 0.6 + {credibility("title || ' ' || content")} * 0.4, 3) AS credibility_score,
  round(least(base + least(n * 0.05, 0.3) + {reliability('source')} * 0.1, 1.0), 3)::DOUBLE AS anomaly_score, {reliability('source')} AS source_reliability, signals
FROM art JOIN hit USING (doc_id) WHERE {reliability('source')} >= 0.3
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1"""
ORACLES["parsed_timestamps"] = f"SELECT event_id, CASE WHEN event_type = 'purchase' THEN '2024-02-01 00:00:00' ELSE {stamp('ts')} END AS parsed FROM events"
ORACLES["model_json"] = "SELECT event_id, CASE WHEN event_type <> 'error' THEN (props->>'k')::BIGINT END AS k FROM events"
ORACLES["enriched_articles"] = with_(TAG) + r"""
SELECT url, array_to_string(categories, ',') AS categories, sentiment_label AS label,
  len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS word_count, len(entities) AS entity_count, 64 AS dim FROM tagged"""

# -- aggregates -------------------------------------------------------------------------------------------

NOW = "(SELECT max(crawled_at) FROM art)"
ORACLES["article_stats"] = with_(ART) + f"""
SELECT count(*) AS total, count(*) FILTER (crawled_at > {NOW} - INTERVAL 1 HOUR) AS last_hour,
  count(*) FILTER (crawled_at > {NOW} - INTERVAL 1 DAY) AS last_day, count(DISTINCT source) AS sources FROM art"""
ORACLES["sentiment_breakdown"] = with_(LAB) + f"""
SELECT sentiment_label AS label, count(*) AS count, {rnd(mean('sentiment_score'), 4)} AS avg_score FROM lab
WHERE crawled_at >= {NOW} - INTERVAL 6 HOURS GROUP BY sentiment_label"""
ORACLES["volume_per_minute"] = f"""
SELECT {stamp("date_trunc('minute', ts)")} AS minute, count(*) AS count FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTES GROUP BY 1"""
ORACLES["category_distribution"] = with_(LAB) + f"""
SELECT category, count(*) AS count FROM (SELECT unnest(categories) AS category FROM lab WHERE crawled_at >= {NOW} - INTERVAL 8760 HOURS)
GROUP BY category ORDER BY count DESC, category LIMIT 20"""
ORACLES["source_stats"] = with_(ART) + f"""
SELECT source, count(*) AS count, {stamp('max(crawled_at)')} AS last_seen FROM art WHERE crawled_at >= {NOW} - INTERVAL 6 HOURS
GROUP BY source ORDER BY count DESC, source LIMIT 50"""
ORACLES["sentiment_share"] = with_(LAB) + """
SELECT sentiment_label AS label, count(*) AS count, floor(count(*) * 100 / sum(count(*)) OVER () + 0.5)::BIGINT AS pct FROM lab GROUP BY sentiment_label"""
ORACLES["trending_topics"] = with_(LAB) + """
SELECT name, count(*) AS count FROM (SELECT DISTINCT content_hash, unnest(categories) AS name FROM lab) GROUP BY name ORDER BY count DESC, name LIMIT 10"""
ORACLES["source_rollup"] = with_(ART) + f"SELECT source, count(*) AS article_count, {stamp('max(crawled_at)')} AS last_seen FROM art GROUP BY source"


def cycles(seconds: int) -> str:
    return f"cyc AS (SELECT to_timestamp((epoch(ts)::BIGINT // {seconds}) * {seconds}) AT TIME ZONE 'UTC' AS cycle, count(*) AS crawled FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY 1)"


ORACLES["cycle_counts"] = with_(cycles(120)) + f"SELECT {stamp('cycle')} AS cycle, crawled, (sum(crawled) OVER (ORDER BY cycle))::BIGINT AS total_crawled FROM cyc"
ORACLES["rolling_cycle_mean"] = with_(cycles(3600)) + f"""
SELECT {stamp('cycle')} AS cycle, crawled, (sum(crawled) OVER w // count(*) OVER w)::BIGINT AS rolling_mean
FROM (SELECT * FROM cyc ORDER BY cycle DESC LIMIT 60) WINDOW w AS (ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
ORACLES["newest_events"] = with_(INC) + """
SELECT article_hash FROM inc WHERE published_at >= (SELECT max(published_at) FROM inc) - INTERVAL 7 DAYS ORDER BY published_at DESC, article_hash LIMIT 500"""
ORACLES["scoreboard"] = with_(INC) + """
SELECT article_hash, anomaly_score FROM (SELECT * FROM inc ORDER BY published_at DESC, article_hash LIMIT 200)
ORDER BY anomaly_score DESC, published_at DESC, article_hash LIMIT 20"""

# -- trends -----------------------------------------------------------------------------------------------

ORACLES["mentions"] = with_(TAG) + rf"""
SELECT kind, name, count(*) AS n, {stamp('max(crawled_at)')} AS last FROM (
  SELECT 'cat' AS kind, unnest(categories) AS name, crawled_at FROM tagged
  UNION ALL SELECT 'ent', e.type || ':' || substr(e.name, 1, 50), crawled_at FROM (SELECT unnest(entities) AS e, crawled_at FROM tagged) WHERE length(e.name) > 2
  UNION ALL SELECT 'kw', unnest(list_transform(list_filter(regexp_split_to_array(title, '\s+'),
    lambda w: length(w) > 4 AND NOT list_contains({strings(L.TITLE_STOPWORDS)}, lower(w))), lambda w: lower(w))[1:5]), crawled_at FROM tagged)
GROUP BY kind, name"""


def trend_sql(seconds: int = 1800, threshold: float = 2.5, source: str = "m") -> str:
    return f"""tr AS (
  SELECT 'trend:' || kind || ':' || name AS key, name, kind, c AS current_count, p AS prev_count, round(c::DOUBLE / greatest(p, 1), 3) AS velocity,
    c::DOUBLE / greatest(p, 1) >= {threshold} AS is_spike
  FROM (SELECT kind, name, count(*) FILTER (ts > now - INTERVAL {seconds} SECONDS) AS c, count(*) FILTER (ts <= now - INTERVAL {seconds} SECONDS) AS p
        FROM {source}, (SELECT max(ts) AS now FROM {source}) WHERE ts > now - INTERVAL {2 * seconds} SECONDS GROUP BY kind, name) WHERE c > 0)"""


ORACLES["trends"] = with_(MENTIONS, trend_sql()) + "SELECT * FROM tr"
ORACLES["trends_reference"] = with_(MENTIONS) + """
SELECT 'trend:' || kind || ':' || name AS key, name, kind, c AS current_count, p AS prev_count, round(c::DOUBLE / greatest(p, 1), 3) AS velocity,
  c::DOUBLE / greatest(p, 1) >= 2.5 AS is_spike
FROM (SELECT kind, name, count(DISTINCT s) FILTER (s BETWEEN now - 1800 AND now) AS c, count(DISTINCT s) FILTER (s BETWEEN now - 3600 AND now - 1800) AS p
      FROM (SELECT kind, name, epoch(date_trunc('second', ts))::BIGINT AS s FROM m), (SELECT epoch(date_trunc('second', max(ts)))::BIGINT AS now FROM m) GROUP BY kind, name)
WHERE c > 0"""
ORACLES["active_spikes"] = with_(MENTIONS, trend_sql()) + "SELECT kind, name, velocity FROM tr WHERE is_spike"
TOP = "SELECT kind, name, velocity FROM tr ORDER BY velocity DESC, kind, name LIMIT 20"
ORACLES["top_trends"] = with_(MENTIONS, trend_sql()) + TOP
ORACLES["trend_series"] = with_(MENTIONS) + f"""
, s AS (SELECT kind, name, epoch(date_trunc('second', ts))::BIGINT // 1800 AS slot, count(*) AS n FROM m GROUP BY ALL)
SELECT a.kind, a.name, {stamp("to_timestamp(a.slot * 1800) AT TIME ZONE 'UTC'")} AS slot, a.n AS current_count, coalesce(b.n, 0) AS prev_count,
  round(a.n::DOUBLE / greatest(coalesce(b.n, 0), 1), 3) AS velocity, a.n::DOUBLE / greatest(coalesce(b.n, 0), 1) >= 2.5 AS is_spike
FROM s a LEFT JOIN s b ON a.kind = b.kind AND a.name = b.name AND b.slot = a.slot - 1"""
ORACLES["frequency_signals"] = with_(INC) + """
, r AS (SELECT *, coalesce(region, 'global') AS reg, (SELECT max(published_at) FROM inc) AS now FROM inc),
c AS (SELECT subcategory, reg, now, count(*) FILTER (published_at > now - INTERVAL 24 HOURS) AS n, count(*) FILTER (published_at <= now - INTERVAL 24 HOURS) AS b,
        (list(article_hash ORDER BY published_at, article_hash) FILTER (published_at > now - INTERVAL 24 HOURS))[1:20] AS ev,
        epoch_us(max(published_at)) - epoch_us(min(published_at) FILTER (published_at > now - INTERVAL 24 HOURS)) AS span
      FROM r WHERE published_at > now - INTERVAL 168 HOURS GROUP BY subcategory, reg, now),
s AS (SELECT *, greatest(b / 7.0::DOUBLE, 0.5) AS per_day, n / greatest(b / 7.0::DOUBLE, 0.5) AS ratio FROM c),
f AS (SELECT *, least(least((ratio - 3) / 10, 0.5) + 0.3 + least(ln(n + 1) / 5, 0.3) + CASE WHEN reg <> 'global' THEN 0.1 ELSE 0 END, 1.0) AS conf FROM s WHERE n > 0 AND ratio >= 1)
SELECT subcategory || ':' || reg || ':' || epoch(date_trunc('second', now))::BIGINT AS signal_id, subcategory, nullif(reg, 'global') AS region, array_to_string(ev, ',') AS events,
  n AS event_count, round(per_day, 2) AS baseline_count, round(ratio, 3) AS frequency_ratio, round(span / 3.6e9, 4) AS temporal_span_hours, round(conf, 3) AS confidence
FROM f WHERE conf >= 0.45"""

# -- clusters ---------------------------------------------------------------------------------------------

ORACLES["event_batches"] = with_(BAT) + "SELECT article_hash, batch_id, pending FROM bat"
ORACLES["entity_clusters"] = with_(BAT) + f"""
, g AS (SELECT batch_id, entity, string_agg(article_hash, ',' ORDER BY published_at, article_hash) AS events, count(*) AS size,
          {mean('anomaly_score')} AS an, {mean('credibility_score')} AS cr FROM bat GROUP BY batch_id, entity HAVING count(*) >= 2)
SELECT batch_id, entity, events, size, {rnd('least(an * cr * 1.4, 1.0)', 3)} AS confidence, {rnd('an', 3)} AS avg_anomaly, {rnd('cr', 3)} AS avg_credibility
FROM g WHERE least(an * cr * 1.4, 1.0) >= 0.70"""
ORACLES["semantic_clusters"] = f"""
WITH v AS (SELECT *, label || '-' || vec_id AS h, 0.5 + (vec_id % 50) / 100.0::DOUBLE AS cr, (row_number() OVER (ORDER BY vec_id) - 1) // 200 AS batch_id FROM embeddings),
p AS (SELECT a.batch_id, a.h || ',' || b.h AS events, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim, (a.cr + b.cr) / 2 AS cr
      FROM v a JOIN v b ON a.batch_id = b.batch_id AND a.vec_id < b.vec_id)
SELECT batch_id, events, {rnd('sim', 4)} AS similarity, {rnd('least(sim * 0.9 * cr * 1.5, 1.0)', 3)} AS confidence, {rnd('cr', 3)} AS avg_credibility
FROM p WHERE sim >= 0.36 AND least(sim * 0.9 * cr * 1.5, 1.0) >= 0.05"""

CL = cluster_tables()
ORACLES["temporal_clusters"] = with_(CL, recursive=True) + f"""
SELECT cluster_id, batch_id, size, confidence, {rnd('anomaly', 3)} AS avg_anomaly, {rnd('cred', 3)} AS avg_credibility, array_to_string(regions, ',') AS regions,
  md5(array_to_string(events, ',')) AS events_md5 FROM cl WHERE cluster_type = 'temporal'"""
ORACLES["spatial_clusters"] = with_(CL, recursive=True) + f"""
SELECT cluster_id, batch_id, region, size, confidence, {rnd('anomaly', 3)} AS avg_anomaly FROM cl WHERE cluster_type = 'spatial'"""
ORACLES["cluster_union"] = with_(CL, recursive=True) + """
SELECT cluster_type, CASE cluster_type WHEN 'temporal' THEN 0 ELSE 1 END AS kind_rank, count(*) AS clusters, sum(size)::BIGINT AS events,
  round(sum(confidence::DECIMAL(18,6))::DOUBLE, 3) AS confidence FROM cl GROUP BY cluster_type"""
#: Batches that overlap, their clusters, and what is reachable through pairs that share half of the smaller one.
ORACLES["clusters_across_batches"] = with_(INC, recursive=True) + f"""
, n AS (SELECT *, (row_number() OVER (ORDER BY published_at, article_hash) - 1) // 100 AS newest FROM inc),
sb AS MATERIALIZED (SELECT * EXCLUDE (newest), newest - back AS batch_id FROM n, (VALUES (0), (1)) AS t(back) WHERE newest - back >= 0),
g AS (
  SELECT 'entity_match' AS cluster_type, batch_id, 'SAME_ENTITY' AS relationship, list(article_hash ORDER BY published_at, article_hash) AS events,
    least({mean('anomaly_score')} * {mean('credibility_score')} * 1.4, 1.0) AS c FROM sb GROUP BY batch_id, entity HAVING count(*) >= 2
  UNION ALL
  SELECT 'spatial', batch_id, NULL, list(article_hash ORDER BY published_at, article_hash), least({mean('anomaly_score')} * 1.2, 1.0)
  FROM sb WHERE region IS NOT NULL GROUP BY batch_id, region HAVING count(*) >= 3),
k AS MATERIALIZED (
  SELECT *, {rnd('c', 3)} AS confidence, sha256(cluster_type || '|' || array_to_string(events, '|')) AS cluster_id FROM g WHERE cluster_type = 'spatial' OR c >= 0.70),
m AS MATERIALIZED (SELECT DISTINCT cluster_id, unnest(events) AS e FROM k),
z AS (SELECT cluster_id, count(*) AS size FROM m GROUP BY cluster_id),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.cluster_id AS a, y.cluster_id AS b, count(*) AS common FROM m x JOIN m y ON x.e = y.e AND x.cluster_id <> y.cluster_id GROUP BY ALL)
  JOIN z za ON za.cluster_id = a JOIN z zb ON zb.cluster_id = b WHERE 2 * common >= least(za.size, zb.size)),
reach AS (SELECT cluster_id AS at_id, cluster_id FROM z UNION SELECT l.b, reach.cluster_id FROM reach JOIN l ON l.a = reach.at_id),
r AS (SELECT cluster_id, min(at_id) AS merged_id FROM reach GROUP BY cluster_id),
ev AS (SELECT merged_id, count(DISTINCT e) AS events FROM r JOIN m USING (cluster_id) GROUP BY merged_id)
SELECT merged_id, count(DISTINCT cluster_id) AS clusters, any_value(ev.events) AS events, array_to_string(list(DISTINCT cluster_type ORDER BY cluster_type), '+') AS cluster_types,
  CASE WHEN count(DISTINCT cluster_id) = 1 THEN min(relationship) WHEN bool_or(coalesce(relationship = 'SAME_ENTITY', false)) THEN 'SAME_ENTITY' ELSE 'SAME_PATTERN' END AS relationship,
  max(confidence) AS confidence, min(batch_id) AS first_batch, max(batch_id) AS last_batch
FROM r JOIN k USING (cluster_id) JOIN ev USING (merged_id) GROUP BY merged_id"""
ORACLES["cluster_event_rows"] = with_(CL, recursive=True) + "SELECT cluster_id, pos, article_hash, anomaly_score FROM ce"
ORACLES["shared_entities"] = with_(CL, recursive=True) + """
, n AS (SELECT cluster_id, entity, count(*) AS event_count, min(pos) AS seen FROM ce GROUP BY cluster_id, entity HAVING count(*) > 1),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seen, entity) AS rank FROM n)
SELECT cluster_id, rank, entity, event_count FROM k WHERE rank <= 10"""

STAT = f"""st AS (SELECT cluster_id, count(*) AS n, {mean('anomaly_score')} AS an, {mean('credibility_score')} AS cr, arg_min(subcategory, pos) AS sub,
  string_agg(substr(title, 1, 80), ',' ORDER BY pos) FILTER (pos < 5) AS titles, max(published_at) AS last FROM ce GROUP BY cluster_id)"""


def verdict_sql(reference: bool) -> str:
    strong = "WHEN confidence >= 0.85 AND an >= 0.75 AND n >= 6 THEN 'strong signal'"
    weak = "WHEN confidence >= 0.75 AND an >= 0.65 AND n >= 4 THEN 'weak signal'"
    order = f"{weak} {strong}" if reference else f"{strong} {weak}"
    return f"""{STAT},
vd AS (SELECT *, CASE WHEN cr < 0.35 THEN 'low' {order} ELSE 'none' END AS tier, printf('%.2f', {rnd('an', 2)}) AS a2, printf('%.2f', {rnd('cr', 2)}) AS c2 FROM cl JOIN st USING (cluster_id)),
ver AS (SELECT *, CASE WHEN tier IN ('weak signal', 'strong signal') THEN tier ELSE 'no strong connection' END AS verdict,
  CASE tier WHEN 'weak signal' THEN 'emerging_pattern' WHEN 'strong signal' THEN 'anomaly' ELSE 'coincidence' END AS classification FROM vd)"""


ORACLES["rule_verdicts"] = with_(CL, verdict_sql(False), recursive=True) + f"""
SELECT cluster_id AS event_cluster_id, 'Rule-based analysis of ' || n || ' events in subcategory ' || sub || '.' AS summary, titles AS connected_events,
  tier IN ('weak signal', 'strong signal') AS pattern_detected, confidence,
  CASE tier WHEN 'low' THEN {text(J.LOW_CREDIBILITY)}
    WHEN 'weak signal' THEN 'Multiple events (' || n || ') with elevated anomaly score (' || a2 || ') and acceptable credibility (' || c2 || '). Pattern threshold met but confirmation requires additional independent sources.'
    WHEN 'strong signal' THEN 'Strong cluster: ' || n || ' events, anomaly=' || a2 || ', credibility=' || c2 || '. Consistent signal across multiple sources.'
    ELSE {text(J.BELOW)} END AS reasoning,
  classification, verdict, 'Average source reliability: ' || c2 || '. ' || CASE WHEN cr < 0.5 THEN 'Low credibility — treat with skepticism.' ELSE 'Acceptable credibility.' END AS credibility_note
FROM ver"""
ORACLES["rule_verdicts_reference"] = with_(CL, verdict_sql(True), recursive=True) + "SELECT verdict, classification, count(*) AS n FROM ver GROUP BY ALL"
ORACLES["verdict_tiers"] = with_(CL, verdict_sql(False), recursive=True) + """
SELECT count(*) FILTER (verdict = 'strong signal') AS strong, count(*) FILTER (verdict = 'weak signal') AS weak,
  count(*) FILTER (verdict = 'no strong connection') AS none, count(*) FILTER (verdict <> 'no strong connection') AS with_connection FROM ver"""
ORACLES["recent_verdicts"] = with_(CL, verdict_sql(False), recursive=True) + f"""
SELECT cluster_id AS event_cluster_id, verdict, {stamp('last')} AS last_event_at FROM ver ORDER BY last DESC, cluster_id LIMIT 100"""
ORACLES["capped_confidence"] = with_(INC) + f"""
SELECT article_hash, round(CASE WHEN credibility_score - 0.4 < 0.35 AND anomaly_score > 0.4 THEN 0.4 ELSE anomaly_score END, 4) AS confidence,
  CASE WHEN credibility_score - 0.4 < 0.35 AND anomaly_score > 0.4 THEN {text(J.CAPPED)} END AS credibility_note FROM inc"""
ORACLES["default_verdicts"] = with_(BAT) + f"""
SELECT DISTINCT batch_id, 'no strong connection' AS verdict, 'coincidence' AS classification, 0.0 AS confidence, {text(J.NO_LINKS)} AS reasoning FROM bat"""
ORACLES["cluster_context"] = with_(CL, recursive=True) + rf"""
, b AS (SELECT cluster_id, string_agg('[' || (pos + 1) || '] Title: ' || title || chr(10) || '    Source: ' || source || ' (reliability: 0.5)' || chr(10) ||
    '    Credibility: ' || credibility_score::DOUBLE || ' | Anomaly: ' || anomaly_score || chr(10) || '    Subcategory: ' || subcategory_label || chr(10) ||
    '    Matched signals: ' || subcategory || chr(10) || '    Snippet: ' || substr(props, 1, 200) || chr(10), chr(10) ORDER BY pos) FILTER (pos < 10) AS block,
  count(*) AS n_events, {rnd(mean('anomaly_score'), 3)} AS avg_anomaly_score, {rnd(mean('credibility_score'), 3)} AS avg_credibility_score,
  coalesce(string_agg(DISTINCT region, ', ' ORDER BY region), 'unknown') AS regions_text, arg_min(subcategory_label, pos) AS subcategory,
  round((epoch(date_trunc('second', max(published_at))) - epoch(date_trunc('second', min(published_at)))) / 3600.0, 2)::DOUBLE AS hours FROM ce GROUP BY cluster_id),
n AS (SELECT cluster_id, entity, count(*) AS c, min(pos) AS seen FROM ce GROUP BY cluster_id, entity HAVING count(*) > 1),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seen, entity) AS rank FROM n),
e AS (SELECT cluster_id, string_agg('  - ' || entity || ' (appears in ' || c || ' events)', chr(10) ORDER BY rank) AS eb FROM k WHERE rank <= 10 GROUP BY cluster_id)
SELECT cluster_id, md5(block) AS events_md5, coalesce(eb, {text(J.NO_SHARED)}) AS entity_block, n_events, avg_anomaly_score, avg_credibility_score, regions_text, subcategory,
  'Cluster ID: ' || cluster_id || chr(10) || 'Cluster type: ' || cluster_type || chr(10) || 'Relationship: unknown' AS header, 'Events span: ' || hours || ' hours' AS temporal_block,
  'Relationship type detected: unknown (confidence: ' || confidence || ')' AS graph_block
FROM b JOIN cl USING (cluster_id) LEFT JOIN e USING (cluster_id)"""
ORACLES["cluster_graph_nodes"] = with_(CL, recursive=True) + "SELECT cluster_id, cluster_type, 'POSSIBLE_LINK' AS relationship_type, confidence FROM cl"
ORACLES["cluster_graph_events"] = with_(CL, recursive=True) + f"""
SELECT DISTINCT article_hash, title, 'event://' || article_hash AS url, subcategory, anomaly_score::DOUBLE AS anomaly_score, credibility_score::DOUBLE AS credibility_score, 0.5::DOUBLE AS source_reliability,
  {stamp('published_at')} AS published_at FROM ce"""
ORACLES["cluster_graph_membership"] = with_(CL, recursive=True) + """
SELECT article_hash AS src, cluster_id AS dst, 'BELONGS_TO_CLUSTER' AS type, confidence FROM pos JOIN cl USING (cluster_id)"""
ORACLES["cluster_graph_links"] = with_(CL, recursive=True) + """
SELECT a.article_hash AS src, b.article_hash AS dst, 'POSSIBLE_LINK' AS type, max(confidence) AS confidence
FROM pos a JOIN pos b ON a.cluster_id = b.cluster_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 JOIN cl ON cl.cluster_id = a.cluster_id GROUP BY 1, 2"""

# -- graph ------------------------------------------------------------------------------------------------

BASKET = """bk AS (SELECT l_orderkey AS article, l_partkey::VARCHAR AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR) AS p FROM lineitem),
pr AS (SELECT a.article, a.k AS src, b.k AS dst FROM bk a JOIN bk b ON a.article = b.article AND a.p < b.p),
co AS (SELECT src, dst, count(*) AS weight FROM pr GROUP BY src, dst)"""
ORACLES["entity_pairs_reference"] = with_(BASKET.replace("a.p < b.p)", "a.p < b.p WHERE b.p <= 5)")) + "SELECT article, src, dst FROM pr"
ORACLES["entity_pairs"] = with_(BASKET) + "SELECT article, src, dst FROM pr"
ORACLES["co_occurrence"] = with_(BASKET) + "SELECT src, dst, weight FROM co"
ORACLES["entity_connections"] = with_(BASKET) + """
, named AS (SELECT p_partkey::VARCHAR AS k FROM part WHERE p_brand = 'Brand#13')
SELECT p_brand AS name, p_type AS type, weight FROM (SELECT dst AS k, weight FROM co WHERE src IN (FROM named) UNION ALL SELECT src, weight FROM co WHERE dst IN (FROM named) AND src <> dst)
JOIN part ON p_partkey::VARCHAR = k ORDER BY weight DESC, p_brand, k LIMIT 20"""
ORACLES["category_pairs"] = with_(LAB) + """
, c AS (SELECT doc_id, unnest(categories) AS k, unnest(range(len(categories))) AS p FROM lab)
SELECT a.k AS src, b.k AS dst, count(*) AS weight FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.p < b.p GROUP BY 1, 2"""
GRAPH = f"""{TAG},
ekey AS (SELECT content_hash, url, crawled_at, sentiment_label, e.name AS name, e.type AS type, substr(lower(e.type || ':' || e.name), 1, 200) AS k, p
  FROM (SELECT *, unnest(entities) AS e, unnest(range(len(entities))) AS p FROM tagged)),
nod AS MATERIALIZED (
  SELECT content_hash AS id, 'Article' AS label, NULL AS mention_count, NULL AS article_count, NULL AS name, NULL AS type, arg_min(url, (crawled_at, url)) AS url, arg_min(sentiment_label, (crawled_at, url)) AS sentiment_label, max(crawled_at) AS last, min(crawled_at) AS published_at FROM tagged GROUP BY content_hash
  UNION ALL SELECT source, 'Source', NULL, count(*)::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL FROM tagged GROUP BY source
  UNION ALL SELECT c, 'Topic', count(*)::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest(categories) AS c FROM tagged) GROUP BY c
  UNION ALL SELECT k, 'Entity', count(*)::VARCHAR, NULL, arg_min(name, (crawled_at, url, p)), arg_min(type, (crawled_at, url, p)), NULL, NULL, NULL, NULL FROM ekey GROUP BY k),
edge AS MATERIALIZED (
  SELECT DISTINCT content_hash AS src, source AS dst, 'FROM_SOURCE' AS type, NULL AS sentiment FROM tagged
  UNION SELECT content_hash, unnest(categories), 'TAGGED_AS', NULL FROM tagged
  UNION SELECT content_hash, k, 'MENTIONS', sentiment_label FROM ekey)"""
ORACLES["graph_nodes"] = with_(GRAPH) + "SELECT id, label, mention_count, article_count, name, type, url, sentiment_label FROM nod"
ORACLES["graph_edges"] = with_(GRAPH) + "SELECT src, dst, type, sentiment FROM edge"
ORACLES["related_entities"] = with_(GRAPH) + """
, mr AS (SELECT content_hash, url, k, row_number() OVER (PARTITION BY content_hash, url ORDER BY p, k) AS n FROM ekey)
SELECT a.k AS src, b.k AS dst, count(*) AS weight FROM mr a JOIN mr b ON a.content_hash = b.content_hash AND a.url = b.url AND a.n < b.n GROUP BY 1, 2"""
LATEST = """lat AS MATERIALIZED (SELECT src, dst, edge.type FROM edge JOIN nod ON nod.label = 'Article' AND nod.id = src ORDER BY nod.published_at DESC, src, edge.type, dst LIMIT 100)"""
ORACLES["latest_subgraph_links"] = with_(GRAPH, LATEST) + "SELECT src, dst, type FROM lat"
ORACLES["latest_subgraph_nodes"] = with_(GRAPH, LATEST) + "SELECT id, label FROM nod WHERE id IN (SELECT src FROM lat UNION SELECT dst FROM lat)"
ORACLES["two_hop_neighbours"] = """
WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 7)
SELECT 'o' || l_orderkey AS id, 1 AS hops FROM o
UNION ALL SELECT DISTINCT 'p' || l_partkey, 2 FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM o) AND l_partkey <> 7"""
ORACLES["closed_links"] = with_(GRAPH) + "SELECT src, dst, type FROM edge WHERE type = 'TAGGED_AS'"
ORACLES["subgraph_by_label"] = with_(GRAPH) + "SELECT type, count(*) AS n FROM edge WHERE type = 'MENTIONS' GROUP BY type"

# -- vectors and insights ---------------------------------------------------------------------------------


def neighbours(k: int) -> str:
    return f"""nn AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b QUALIFY rank <= {k})"""


ORACLES["nearest_neighbours"] = with_(neighbours(10)) + "SELECT query_id, rank, id, round(score, 5) AS score FROM nn"
ORACLES["nearest_neighbours_by_label_cell"] = """
WITH mean AS (SELECT label, p, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY label, p),
center AS (SELECT label AS cell, list(m ORDER BY p) AS c FROM mean GROUP BY label),
near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(c, c) - 2 * list_dot_product(embedding::DOUBLE[], c), cell) AS place FROM embeddings, center),
hit AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM near q JOIN near v ON q.cell = v.cell AND q.place <= 2 AND v.place = 1 JOIN embeddings a ON a.vec_id = q.vec_id JOIN embeddings b ON b.vec_id = v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank, id, round(score, 5) AS score FROM hit QUALIFY rank <= 10"""
ORACLES["retrieval"] = with_(neighbours(5)) + """
SELECT query_id, string_agg('[' || rank || '] Title: ' || label || chr(10) || '    Categories: ' || label || chr(10) || '    Sentiment: neutral' || chr(10) || '    URL: vec://' || id, chr(10) || chr(10) ORDER BY rank) AS context,
  count(*) AS context_count, 'LLM unavailable. Found ' || count(*) || ' relevant articles: ' || string_agg(label::VARCHAR, ', ' ORDER BY rank) FILTER (rank <= 3) || '...' AS answer
FROM nn GROUP BY query_id"""

NAMED = f"""named AS (SELECT kind, coalesce(new, name) AS name, ts FROM m LEFT JOIN ({values(list(RENAMED.items()))}) AS r(old, new) ON old = name WHERE kind = 'cat')"""
SPIKES = "sp AS (SELECT *, row_number() OVER (ORDER BY velocity DESC, kind, name) AS place, printf('%.1f', round(velocity, 1)) AS v1 FROM (SELECT * FROM tr ORDER BY velocity DESC, kind, name LIMIT 20) WHERE is_spike)"
TITLES = values([("technology", "Technology"), ("finance", "Finance"), ("energy", "Energy"), ("war_conflict", "War Conflict"), ("crime_law", "Crime Law"), ("climate_environment", "Climate Environment")])
ORACLES["rule_insights"] = with_(MENTIONS, NAMED, trend_sql(14400, 0.5, "named"), SPIKES, f"tt AS (SELECT * FROM ({TITLES}) AS t(name, shown))") + f"""
SELECT 'market_opportunities' AS section, place, 'Surge in ' || shown || ' News Coverage' AS title, shown || ' sector showing ' || v1 || 'x velocity spike' AS description,
  CASE WHEN velocity > 3 THEN 'high' ELSE 'medium' END AS confidence, name AS category FROM sp JOIN tt USING (name) WHERE place <= 3 AND list_contains({strings(L.OPPORTUNITY_CATEGORIES)}, name)
UNION ALL SELECT 'emerging_risks', place, 'Elevated ' || shown || ' Activity', 'News volume ' || v1 || 'x above baseline', 'high', name
  FROM sp JOIN tt USING (name) WHERE place <= 3 AND list_contains({strings(L.RISK_CATEGORIES)}, name)
UNION ALL SELECT 'viral_topics', place, replace(name, ':', ' → '), 'Velocity: ' || v1 || 'x | Count: ' || current_count, 'high', kind FROM sp WHERE place <= 5"""
ORACLES["insight_context"] = with_(LAB, MENTIONS, NAMED, trend_sql(14400, 0.5, "named")) + f"""
SELECT (SELECT string_agg('- ' || name || ' (velocity: ' || printf('%.1f', round(velocity, 1)) || 'x, spike: ' || CASE WHEN is_spike THEN 'True' ELSE 'False' END || ')', chr(10) ORDER BY velocity DESC, kind, name)
    FROM (SELECT * FROM tr ORDER BY velocity DESC, kind, name LIMIT 10)) AS trend_block,
  (SELECT string_agg('- ' || label || ': ' || n || ' articles (' || printf('%.2f', round(a, 2)) || ' avg score)', chr(10) ORDER BY n DESC, label)
    FROM (SELECT sentiment_label AS label, count(*) AS n, {rnd(mean('sentiment_score'), 4)} AS a FROM lab WHERE crawled_at >= {NOW} - INTERVAL 24 HOURS GROUP BY 1)) AS sentiment_block,
  (SELECT string_agg('- ' || name || ' (user)', chr(10) ORDER BY n DESC, name) FROM (SELECT name, count(*) AS n FROM m WHERE kind = 'ent' GROUP BY name ORDER BY n DESC, name LIMIT 10)) AS entity_block,
  (SELECT string_agg('- ' || c || ': ' || n || ' articles', chr(10) ORDER BY n DESC, c) FROM (SELECT c, count(*) AS n FROM (SELECT unnest(categories) AS c FROM lab WHERE crawled_at >= {NOW} - INTERVAL 24 HOURS)
    GROUP BY c ORDER BY n DESC, c LIMIT 10)) AS category_block"""

# -- streams ----------------------------------------------------------------------------------------------

ORACLES["stream_volume"] = f"""
SELECT {stamp('minute')} AS minute, count(*) AS count FROM (SELECT date_trunc('minute', ts) AS minute FROM events)
WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY minute"""
ORACLES["stream_dedup_exact"] = with_(ART) + "SELECT DISTINCT content_hash FROM art"
ORACLES["stream_dedup_near"] = with_(
    ART, f"l1 AS ({EXACT})", *minhash_layer("l1", None, True), recursive=True
) + "SELECT url FROM l1 JOIN kept USING (doc_id)"
ORACLES["stream_dedup_layers"] = f"SELECT url FROM ({layers(False)}) WHERE dropped_by IS NULL"
KEPT_GRAPH = GRAPH.replace("FROM documents))", "FROM documents WHERE 'doc://' || doc_id IN (SELECT url FROM kept)))")
RELATED = """rel AS (
  SELECT a.k AS src, b.k AS dst, count(*) AS weight FROM mr a JOIN mr b ON a.content_hash = b.content_hash AND a.url = b.url AND a.n < b.n GROUP BY 1, 2)"""
ORACLES["stream_ingest"] = with_(f"kept AS MATERIALIZED ({ORACLES['stream_dedup_layers']})", KEPT_GRAPH) + rf"""
, mr AS (SELECT content_hash, url, k, row_number() OVER (PARTITION BY content_hash, url ORDER BY p, k) AS n FROM ekey), {RELATED}
SELECT 'lake' AS sink, url AS "key", left(content_hash, 16) AS "value" FROM tagged
UNION ALL SELECT 'articles', url, array_to_string(categories, ',') FROM tagged
UNION ALL SELECT 'facts', url, sentiment_label || '|' || len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) || '|' || len(entities) FROM tagged
UNION ALL SELECT 'nodes', label || '|' || id, coalesce(mention_count, article_count, '') FROM nod
UNION ALL SELECT 'edges', type || '|' || src || '|' || dst, coalesce(sentiment, '') FROM edge
UNION ALL SELECT 'edges', 'RELATES_TO|' || src || '|' || dst, weight::VARCHAR FROM rel
UNION ALL SELECT 'vectors', content_hash, sentiment_label FROM tagged
UNION ALL SELECT 'mentions', kind || '|' || name || '|' || {stamp('slot')}, count(*)::VARCHAR FROM (
  SELECT 'cat' AS kind, unnest(categories) AS name, time_bucket(INTERVAL 30 MINUTE, crawled_at) AS slot FROM tagged
  UNION ALL SELECT 'ent', e.type || ':' || substr(e.name, 1, 50), time_bucket(INTERVAL 30 MINUTE, crawled_at) FROM (SELECT unnest(entities) AS e, crawled_at FROM tagged) WHERE length(e.name) > 2)
GROUP BY kind, name, slot"""
ORACLES["stream_trends"] = ORACLES["trend_series"]
ORACLES["stream_top_trends"] = ORACLES["top_trends"]
ORACLES["stream_frequency"] = with_(INC) + f"""
, w AS (SELECT subcategory, coalesce(region, 'global') AS region, unnest(range(24)) AS k, date_trunc('hour', published_at) AS h FROM inc)
SELECT {stamp('h - to_hours(k)')} AS window_start, subcategory, region, count(*) AS event_count FROM w
WHERE h - to_hours(k) + INTERVAL 24 HOURS <= (SELECT max(published_at) FROM inc) - INTERVAL 24 HOURS GROUP BY ALL"""
ORACLES["stream_live_feed"] = with_(LAB) + f"SELECT content_hash, url, {stamp('published_at')} AS published_at FROM lab ORDER BY lab.published_at DESC, content_hash, url LIMIT 200"
ORACLES["stream_fan_out"] = with_(LAB) + r"""
SELECT url, content_hash, sentiment_label, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS word_count FROM lab"""


# -- payloads, topics, sinks ------------------------------------------------------------------------------

SHOWN = "url, title, md5(content) AS content_md5, source, author, published_at"
FIRST_LINE = "split_part(text, chr(10), 1)"
STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
ORACLES["story_items"] = f"""
SELECT {SHOWN} FROM (
  SELECT CASE WHEN doc_id % 3 > 0 THEN 'https://s/' || doc_id ELSE 'https://page/' || doc_id END AS url, {STRIPPED.format(FIRST_LINE)} AS title, substr(text, 1, 5000) AS content,
    'hackernews' AS source, lang AS author, {stamp("make_timestamp(doc_id * 60000000)")} AS published_at
  FROM documents WHERE doc_id % 5 <> 0) WHERE title <> ''"""
ORACLES["article_lists"] = f"""
SELECT {SHOWN} FROM (
  SELECT 'https://' || m || '/' || doc_id AS url, {STRIPPED.format(FIRST_LINE)} AS title,
    strftime(make_timestamp(doc_id * 3600000000), '%Y%m%dT%H%M%SZ') || ' ' || {STRIPPED.format(FIRST_LINE)} AS content, 'gdelt/' || source AS source,
    NULL AS author, {stamp("make_timestamp(doc_id * 3600000000)")} AS published_at
  FROM documents, (VALUES ('a'), ('b')) AS t(m) WHERE m = 'a' OR doc_id % 2 = 0) WHERE title <> ''"""
ORACLES["timeline_posts"] = f"""
SELECT {SHOWN} FROM (
  SELECT 'https://t/' || conv_id || '/' || turn || CASE WHEN role = 'user' THEN '/card' ELSE '' END AS url,
    CASE WHEN role = 'user' THEN 'Card' ELSE substr(t, 1, 120) END AS title, substr(t, 1, 5000) AS content, 'mastodon/host' AS source, role AS author,
    '2024-02-03 04:05:06' AS published_at
  FROM (SELECT *, {STRIPPED.format("text")} AS t FROM conversations) WHERE length(t) >= 40)"""
ORACLES["search_posts"] = f"""
SELECT {SHOWN} FROM (
  SELECT 'https://web/did:' || conv_id || '/post/' || turn AS url, substr(t, 1, 120) AS title, substr(t, 1, 5000) AS content, 'bluesky/q' AS source, role AS author,
    '2024-01-02 03:04:05' AS published_at
  FROM (SELECT *, {STRIPPED.format("text")} AS t FROM conversations) WHERE length(t) >= 30)"""
for name, whole in (("story_items", "text"), ("timeline_posts", "t"), ("search_posts", "t")):
    ORACLES[f"{name}_reference"] = ORACLES[name]
    ORACLES[name] = ORACLES[name].replace(f"substr({whole}, 1, 5000)", whole)
ORACLES["feed_articles"] = f"""
SELECT 'https://f/' || doc_id AS url, md5({STRIPPED.format(FIRST_LINE)}) AS title_md5, length({STRIPPED.format("translate(text, '<>', '  ')")}) AS n_chars, source, lang AS author,
  '2024-03-05 09:00:00' AS published_at
FROM documents WHERE {STRIPPED.format(FIRST_LINE)} <> ''"""
ORACLES["topic_round_trip"] = with_(ART) + """
SELECT url, content_hash, md5(content) AS content_md5, false AS quarantined FROM art WHERE content_hash[1] <> '0'
UNION ALL SELECT count(*)::VARCHAR, NULL, NULL, true FROM art WHERE content_hash[1] = '0'"""
ORACLES["lake_round_trip"] = with_(ART) + """
SELECT strftime(published_at, '%Y-%m-%d') AS dt, source AS source_key, count(*) AS n, min(substr(content_hash, 1, 16)) AS first_hash16 FROM art GROUP BY ALL"""
ORACLES["lake_article"] = with_(ART) + """
, f AS (SELECT * FROM art ORDER BY doc_id LIMIT 1)
SELECT art.url, art.content_hash, md5(art.content) AS content_md5 FROM art JOIN f ON art.content_hash = f.content_hash AND art.source = f.source AND art.published_at::DATE = f.published_at::DATE"""
_SHARE = "(length(title || '. ' || content) % 10)"
_MODEL_CATEGORIES = with_(ART) + f"""
SELECT doc_id, CASE WHEN {_SHARE} > 4 THEN 'long' ELSE 'short' END || CASE WHEN least({_SHARE}, 10 - {_SHARE}) > 3 THEN CASE WHEN {_SHARE} > 4 THEN ',short' ELSE ',long' END ELSE '' END AS categories
FROM art WHERE NOT contains(content, '|')"""
_MODEL_SENTIMENT = with_(ART) + f"""
SELECT doc_id, CASE WHEN {_SHARE} > 4 THEN 'positive' ELSE 'negative' END AS label, round(0.5 + {_SHARE} / 20.0::DOUBLE, 4) AS score FROM art WHERE NOT contains(content, '|')"""
_LOW = "lower(title || '. ' || content)"
_RULE_MOOD = sentiment(None).replace(hits(_LOW, X.POSITIVE), hits(_LOW, L.POSITIVE_WORDS)).replace(hits(_LOW, X.NEGATIVE), hits(_LOW, L.NEGATIVE_WORDS))
ORACLES["model_categories"] = with_(ART, category_hits(L.CATEGORY_KEYWORDS, None)) + f"""
, best AS (SELECT doc_id, string_agg(label, ',' ORDER BY score DESC, rank) AS categories
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) AS n FROM cat_hits) WHERE n <= 3 GROUP BY doc_id),
model AS ({_MODEL_CATEGORIES})
SELECT doc_id, CASE WHEN contains(content, '|') THEN coalesce(best.categories, {text(L.FALLBACK_CATEGORY[0])}) ELSE model.categories END AS categories
FROM art LEFT JOIN best USING (doc_id) LEFT JOIN model USING (doc_id)"""
ORACLES["model_sentiment"] = with_(ART, _RULE_MOOD) + f"""
, model AS ({_MODEL_SENTIMENT})
SELECT doc_id, CASE WHEN contains(content, '|') THEN sentiment_label ELSE model.label END AS label, CASE WHEN contains(content, '|') THEN sentiment_score ELSE model.score END AS score
FROM art JOIN mood USING (doc_id) LEFT JOIN model USING (doc_id)"""
ORACLES["trend_snapshots"] = with_(MENTIONS, trend_sql()) + """
SELECT kind, name, current_count, prev_count, is_spike, strftime((SELECT max(ts) FROM m), '%Y%m%d') AS day FROM tr"""
