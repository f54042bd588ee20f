"""Common parts of the DuckDB SQL of registered queries."""

from __future__ import annotations

from cairnbook.functions.text import AUTHORITY as _WEIGHTS
from cairnbook.functions.text import STOP_WORDS
from cairnbook.functions.urls import SECOND_LEVELS, TRACKING_PARAMETERS

_TIERS = ["PRIMARY SOURCE", "DIRECT PROJECT ARTIFACT", "COMMUNITY SOURCE", "AI-GENERATED", "UNKNOWN"]
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)

STOPS = _quoted(dict.fromkeys(STOP_WORDS))
AUTHORITY = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHTS.items())
TOKEN_ASSIGNMENT = r"""(?i)\b(?:token|secret|password|api_?key)\s*[=:]\s*["''][A-Za-z0-9_-]{16,}["'']"""
_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script\s*>', ' ', 'gis'), '<style[^>]*>.*?</style\s*>', ' ', 'gis'), '<!--.*?-->|<[^>]*>', ' ', 'gs')"
ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
DETAG = rf"trim(regexp_replace({ENTITIES.format(_STRIPPED)}, '\s+', ' ', 'g'))"

OBJ = f"""obj AS (
  SELECT doc_id, printf('KB-%08d', doc_id + 1) AS object_id, sha256(text) AS content_hash, n_chars AS bytes, source AS source_id, lang AS account_id, text AS body,
         '/store/' || source || '/' || lang || '/doc' || doc_id || '.txt' AS native_path,
         CASE doc_id % 5 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TIERS))} END AS authority
  FROM documents)"""
MSG = """msg AS (
  SELECT conv_id, turn, printf('KB-%08d', conv_id * 1000 + turn + 60000000) AS object_id, printf('KB-%08d', conv_id + 50000000) AS conversation_id FROM conversations)"""
EDGE = f"""{MSG}, edge AS (
  SELECT object_id AS source_object, conversation_id AS target_object, 'PART_OF' AS relationship_type FROM msg
  UNION ALL SELECT a.object_id, b.object_id, 'REPLIES_TO' FROM msg a JOIN msg b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"""


def toks(column: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


TOKENS = f"tok AS (SELECT doc_id, unnest({toks('text')}) AS t FROM documents)"


def url_rules(source: str) -> str:
    """CTEs that end in u: the columns of `source` (page_id, url, ...) with domain, scheme and normalized_url. Written
    from the rules with string functions: cut at '#', '?', '/', then at '@' and ':'."""
    names = lambda x: f"replace(url_decode(replace(split_part({x}, '=', 1), '+', '%20')), chr(0), '')"
    values = "url_decode(replace(substr(x, length(split_part(x, '=', 1)) + 2), '+', '%20'))"
    form = lambda x: f"replace(url_encode({x}), '%20', '+')"
    return rf"""u0 AS (
  SELECT *, CASE WHEN starts_with(trim(url), '//') THEN 'https:' || trim(url) WHEN regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN trim(url) ELSE 'http://' || trim(url) END AS full_url FROM {source}
), u1 AS (
  SELECT *, lower(split_part(full_url, ':', 1)) AS scheme0, substr(split_part(full_url, '#', 1), length(split_part(full_url, ':', 1)) + 2) AS rest,
         substr(full_url, length(split_part(full_url, '#', 1)) + 2) AS fragment FROM u0
), u2 AS (
  SELECT *, split_part(rest, '?', 1) AS place, substr(rest, length(split_part(rest, '?', 1)) + 2) AS query FROM u1
), u3 AS (
  SELECT *, CASE WHEN starts_with(place, '//') THEN split_part(substr(place, 3), '/', 1) ELSE '' END AS authority FROM u2
), u4 AS (
  SELECT *, CASE WHEN starts_with(place, '//') THEN substr(place, 3 + length(authority)) ELSE place END AS path, string_split(authority, '@')[-1] AS hostport FROM u3
), u5 AS (
  SELECT *, lower(split_part(hostport, ':', 1)) AS host, try_cast(nullif(split_part(hostport, ':', 2), '') AS INTEGER) AS port, rtrim(regexp_replace(path, '/(index|default)\.(html?|php|aspx?)$', '/', 'i'), '/') AS short,
         list_sort(list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: {{'k': {names('x')}, 'v': {values}}}), lambda x: lower(x.k) NOT IN ({_quoted(TRACKING_PARAMETERS)}))) AS kept FROM u4
), u6 AS (
  SELECT *, CASE WHEN host LIKE 'www.%.%' THEN substr(host, 5) ELSE host END AS site,
         host <> '' AND NOT contains(host, ' ') AND (contains(host, '.') OR host = 'localhost') AND NOT starts_with(host, '.') AND NOT ends_with(host, '.') AND NOT contains(host, '..') AS usable FROM u5
), u AS (
  SELECT * EXCLUDE (full_url, scheme0, rest, fragment, place, query, authority, path, hostport, host, port, short, kept, site, usable),
         CASE WHEN usable THEN site END AS domain, CASE WHEN usable THEN scheme0 END AS scheme,
         CASE WHEN usable THEN scheme0 || '://' || site || CASE WHEN port > 0 AND port <> CASE scheme0 WHEN 'http' THEN 80 WHEN 'https' THEN 443 WHEN 'ftp' THEN 21 ELSE 0 END THEN ':' || port ELSE '' END
         || CASE WHEN short = '' THEN '/' ELSE short END
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda x: {form('x.k')} || '=' || {form('x.v')}), '&') ELSE '' END
         || CASE WHEN starts_with(fragment, '!') THEN '#' || fragment ELSE '' END END AS normalized_url FROM u6)"""


URL = url_rules("pages")
REGISTRABLE = f"CASE WHEN len(string_split(domain, '.')) <= 2 THEN domain WHEN string_split(domain, '.')[-2] IN ({_quoted(SECOND_LEVELS)}) AND length(string_split(domain, '.')[-1]) = 2 THEN array_to_string(string_split(domain, '.')[-3:], '.') ELSE array_to_string(string_split(domain, '.')[-2:], '.') END"
VISIT = f"{URL}, visit AS (SELECT event_id, ts, event_type, normalized_url, domain FROM events JOIN u ON user_id = page_id WHERE normalized_url IS NOT NULL)"

_INDEX = f"""dt AS (SELECT doc_id, {toks('text')} AS ws FROM documents), {TOKENS},
q AS (SELECT DISTINCT item_id AS query_id, t AS term FROM (SELECT item_id, unnest({toks('text')}) AS t FROM benchmark) WHERE t NOT IN ({STOPS})),
l AS (SELECT doc_id, len(ws) AS len FROM dt), tot AS (SELECT count(*) AS n, avg(len) AS a FROM l)"""


def _bm25(terms: str, x: str) -> str:
    """CTEs that rank all documents for a table of (query_id, term); the ranking is r<x>."""
    return f"""p{x} AS (SELECT t AS term, doc_id, count(*) AS tf FROM tok WHERE t IN (SELECT term FROM {terms}) GROUP BY 1, 2),
f{x} AS (SELECT term, count(*) AS df FROM p{x} GROUP BY 1),
s{x} AS (SELECT query_id, p{x}.doc_id AS object_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score
  FROM {terms} z JOIN p{x} ON z.term = p{x}.term JOIN f{x} ON f{x}.term = p{x}.term JOIN l ON l.doc_id = p{x}.doc_id, tot GROUP BY 1, 2),
r{x} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS k FROM s{x})"""


def identifier(t: str) -> str:
    return f"(regexp_matches({t}, '^[0-9]+$') OR regexp_matches({t}, '^[0-9a-f]{{8,}}$') OR length({t}) > 20 OR (length({t}) >= 12 AND regexp_matches({t}, '[0-9]')) OR length(regexp_replace({t}, '[^0-9]', '', 'g')) > 0.3 * length({t}))"


BM25 = f"WITH {_INDEX}, {_bm25('q', '1')} SELECT query_id, object_id, score FROM r1 WHERE k <= 100"
_EXPANSION = f"""h AS (SELECT query_id, object_id AS doc_id FROM r1 WHERE k <= 8),
hw AS (SELECT DISTINCT query_id, doc_id, term FROM (SELECT h.query_id, h.doc_id, unnest({toks('substr(text, 1, 4000)')}) AS term FROM h JOIN documents USING (doc_id))),
hc AS (SELECT query_id, term, count(*) AS c FROM hw WHERE length(term) > 2 AND term NOT IN ({STOPS}) AND NOT {identifier('term')} GROUP BY 1, 2 HAVING count(*) >= 2),
hd AS (SELECT t AS term, count(DISTINCT doc_id) AS df FROM tok WHERE t IN (SELECT term FROM hc) GROUP BY 1),
hs AS (SELECT hc.query_id, hc.term, round(c * ln(n / df), 6) AS weight FROM hc JOIN hd ON hc.term = hd.term, tot WHERE df <= n * 0.25 AND NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = hc.query_id AND q.term = hc.term)),
more AS (SELECT query_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term DESC) AS k FROM hs) WHERE k <= 6)"""
EXPANSION_TERMS = f"WITH {_INDEX}, {_bm25('q', '1')}, {_EXPANSION} SELECT query_id, term, weight FROM more"
HYBRID = f"""WITH {OBJ}, {_INDEX}, {_bm25('q', '1')}, {_EXPANSION}, {_bm25('more', '2')},
n1 AS (SELECT query_id, object_id, score / max(score) OVER (PARTITION BY query_id) AS v FROM r1 WHERE k <= 100),
n2 AS (SELECT query_id, object_id, score / max(score) OVER (PARTITION BY query_id) AS v FROM r2 WHERE k <= 100),
e AS (SELECT DISTINCT query_id, o.source_id FROM q JOIN obj o ON q.term = o.source_id WHERE length(q.term) >= 4),
g0 AS (SELECT query_id, doc_id AS object_id, row_number() OVER (PARTITION BY query_id ORDER BY object_id) AS k FROM e JOIN obj USING (source_id)),
n3 AS (SELECT query_id, object_id, 1.0 AS v FROM g0 WHERE k <= 100),
m AS (SELECT query_id, object_id, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM (SELECT query_id, object_id, v AS a, 0.0 AS b, 0.0 AS c FROM n1 UNION ALL SELECT query_id, object_id, 0.0, v, 0.0 FROM n2 UNION ALL SELECT query_id, object_id, 0.0, 0.0, v FROM n3) GROUP BY 1, 2),
w AS (SELECT query_id, o.object_id, round(CAST(a AS DOUBLE), 4) AS c_lexical, round(0.35 * CAST(b AS DOUBLE), 4) AS c_expansion, round(0.5 * CAST(c AS DOUBLE), 4) AS c_graph,
  round(0.6 * CAST(CASE authority {AUTHORITY} ELSE 0.3 END AS DOUBLE), 4) AS c_authority, CAST(0.0 AS DOUBLE) AS c_recency FROM m JOIN obj o ON o.doc_id = m.object_id),
t AS (SELECT *, round(c_lexical + c_expansion + c_graph + c_authority + c_recency, 4) AS score FROM w)
SELECT query_id, object_id, c_lexical, c_expansion, c_graph, c_authority, c_recency, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM t) WHERE rank <= 20"""
CITE = f"""WITH {OBJ}, b AS (SELECT DISTINCT content_hash FROM obj WHERE doc_id % 19 <> 0),
c AS (SELECT doc_id, object_id, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND b.content_hash IS NOT NULL AS ok FROM obj LEFT JOIN b ON obj.content_hash = b.content_hash)
SELECT c.object_id, CASE WHEN c.ok THEN 'COMPLETE' WHEN p.ok THEN 'COMPLETE_VIA_PARENTS' ELSE 'INCOMPLETE' END AS status, CAST(CASE WHEN p.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS parents
FROM c LEFT JOIN c p ON p.doc_id = c.doc_id // 2 AND p.doc_id <> c.doc_id"""
ENTITIES_OF = f"""WITH e AS (SELECT printf('KB-%08d', p_partkey) AS object_id, p_name AS title FROM part),
w AS (SELECT DISTINCT object_id, title, t FROM (SELECT object_id, title, unnest({toks('title')}) AS t FROM e)),
q AS (SELECT DISTINCT query_id, t FROM (SELECT p_partkey AS query_id, unnest({toks('p_name')}) AS t FROM part WHERE p_partkey % 50 = 0) WHERE length(t) >= 4 AND t NOT IN ({STOPS})),
m AS (SELECT query_id, object_id, title, bool_or(lower(title) = q.t) AS exact FROM q JOIN w ON q.t = w.t GROUP BY 1, 2, 3)
SELECT query_id, object_id, title, exact FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, object_id) AS k FROM m) WHERE k <= 8"""

def mention_ctes(titles: str, objects: str) -> str:
    """CTEs that rank the texts of `objects` (object_id, body) for each title of a table; sc has the scores, per and tot
    the counts."""
    return f"""ph AS (SELECT title, array_to_string({toks('title')}, ' ') AS run, len({toks('title')}) AS k FROM {titles}),
dx AS (SELECT object_id, {toks('body')} AS ws FROM {objects}),
g AS (SELECT object_id, len(ws) AS size, array_to_string(ws[i:i + k - 1], ' ') AS run FROM dx, (SELECT DISTINCT k FROM ph), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
hit AS (SELECT title, object_id, size, count(*) AS tf FROM g JOIN ph USING (run) GROUP BY 1, 2, 3),
tot AS (SELECT count(*) AS total, avg(len(ws)) AS mean FROM dx),
per AS (SELECT title, count(*) AS n FROM hit GROUP BY 1),
sc AS (SELECT title, object_id, round(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score FROM hit JOIN per USING (title), tot WHERE n <= greatest(floor(total * 0.05), 1))"""


MENTIONS = f"""WITH {URL}, {OBJ},
ti AS (SELECT DISTINCT title FROM (SELECT unnest(string_split(domain, '.')) AS title FROM u WHERE domain IS NOT NULL UNION ALL SELECT {REGISTRABLE} FROM u WHERE domain IS NOT NULL) WHERE length(title) >= 4),
{mention_ctes('ti', 'obj')}
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY title ORDER BY score DESC, object_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 500
UNION ALL SELECT title, NULL, NULL, NULL FROM per, tot WHERE n > greatest(floor(total * 0.05), 1)"""

_W = f"round(0.6 * CAST(CASE authority {AUTHORITY} ELSE 0.3 END AS DOUBLE), 4) AS c_authority"
SIGNALS = f"""WITH {URL}, {OBJ}, {_INDEX}, {_bm25('q', '1')}, {_EXPANSION}, {_bm25('more', '2')},
n1 AS (SELECT query_id, object_id, score / max(score) OVER (PARTITION BY query_id) AS v FROM r1 WHERE k <= 100),
n2 AS (SELECT query_id, object_id, score / max(score) OVER (PARTITION BY query_id) AS v FROM r2 WHERE k <= 100),
e0 AS (SELECT DISTINCT string_split(domain, '.')[-3] AS label, page_id FROM u WHERE len(string_split(domain, '.')) >= 3),
e AS (SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY label) AS k FROM (SELECT DISTINCT query_id, label FROM q JOIN e0 ON term = label WHERE length(label) >= 4)) WHERE k <= 8),
g0 AS (SELECT query_id, page_id AS object_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, page_id) AS k FROM (SELECT query_id, page_id, count(*) AS s FROM e JOIN e0 USING (label) GROUP BY 1, 2)),
n3 AS (SELECT query_id, object_id, s / max(s) OVER (PARTITION BY query_id) AS v FROM g0 WHERE k <= 100),
m AS (SELECT query_id, object_id, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM (SELECT query_id, object_id, v AS a, 0.0 AS b, 0.0 AS c FROM n1 UNION ALL SELECT query_id, object_id, 0.0, v, 0.0 FROM n2 UNION ALL SELECT query_id, object_id, 0.0, 0.0, v FROM n3) GROUP BY 1, 2),
w AS (SELECT query_id, o.object_id, round(CAST(a AS DOUBLE), 4) AS c_lexical, round(0.35 * CAST(b AS DOUBLE), 4) AS c_expansion, round(0.5 * CAST(c AS DOUBLE), 4) AS c_graph, {_W},
  CASE doc_id % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.15 ELSE 0.0 END::DOUBLE AS c_recency FROM m JOIN obj o ON o.doc_id = m.object_id),
t AS (SELECT *, round(c_lexical + c_expansion + c_graph + c_authority + c_recency, 4) AS score FROM w)
SELECT query_id, object_id, c_lexical, c_expansion, c_graph, c_authority, c_recency, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM t) WHERE rank <= 20"""
EVIDENCE = f"""WITH {OBJ}, {_INDEX}, {_bm25('q', '1')},
b AS (SELECT DISTINCT content_hash FROM obj WHERE doc_id % 19 <> 0),
n1 AS (SELECT query_id, object_id AS doc_id, score / max(score) OVER (PARTITION BY query_id) AS v FROM r1 WHERE k <= 40),
w AS (SELECT query_id, o.object_id, o.doc_id, o.body, o.content_hash, round(CAST(v AS DOUBLE), 4) AS c_lexical, {_W} FROM n1 JOIN obj o USING (doc_id)),
t AS (SELECT *, round(c_lexical + c_authority, 4) AS score FROM w)
SELECT query_id, rank, object_id, score, substr(body, 1, 1200) AS excerpt, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND content_hash IN (SELECT content_hash FROM b) AS complete
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM t) WHERE rank <= 8"""
