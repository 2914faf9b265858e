"""DuckDB SQL over the driver's tables: adapters and passes from which the queries' SQL is put together."""

from __future__ import annotations

import re

from corpusgraph.config import DERIVED_KINDS, EVIDENCE_KINDS, STOP, SYMBOL_STOP
from corpusgraph.sources.tables import FILE_TEXTS


def names(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


DOCS = """docs AS (SELECT source || '_' || lpad(doc_id::VARCHAR, 7, '0') AS id, source AS chapter, 'doc ' || doc_id AS title,
  'https://' || lang || '.example/' || source || '/' || doc_id AS url, sha256(text) AS sha, text AS body FROM documents)"""

MANUALS = """manuals AS (SELECT 'part_' || lpad(k::VARCHAR, 7, '0') AS id, 'part' AS chapter, n AS title,
  'https://parts.example/' || lower(p_type) || '/' || (k // 60) || '/' || k AS url, sha256(body) AS sha, body FROM (
  SELECT p_partkey AS k, p_name AS n, p_type, concat('# ', p_name, chr(10), chr(10), '## ', p_type, ' range', chr(10), chr(10), '### size ', p_size, chr(10), chr(10),
    'Use `', p_name, '` with `', p_brand, ' kit ', p_partkey % 37, '` and `code ', p_partkey % 211, '`.', chr(10), chr(10),
    'Every ', p_name, ' of lot-', p_partkey % 53, ' is kept in bin-', p_partkey % 29, ' next to the shelf for size-', p_size, ' goods. ',
    'The ', p_type, ' range was checked by crew-', p_partkey % 17, ' before it left hall-', p_partkey % 13, ', and route-', p_partkey % 101, ' takes it to town-', p_partkey % 71, '. ',
    'Keep batch-', p_partkey % 97, ' dry, and never mix ', p_name, ' stock with other stock of the same hall.', chr(10), chr(10),
    'See [next](part_', lpad((p_partkey * 5 + 2)::VARCHAR, 7, '0'), '.html) and [kin](part/', lpad((p_partkey + 9)::VARCHAR, 7, '0'), '.md).', chr(10)) AS body FROM part))"""

VERSIONS = """versions AS (SELECT 'cust_' || o_custkey || '_v' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, o_custkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders)"""

_EXT = "['.py', '.ts', '.c', '.go', '.rs', '.java', '.rb', '.md']"
FILES = f"""files AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 40) || '/mod' || p_partkey || ({_EXT})[p_partkey % 8 + 1] AS relpath,
  (['python', 'typescript', 'c', 'go', 'rust', 'java', 'ruby', NULL])[p_partkey % 8 + 1] AS lang FROM part)"""

LINKS = """links AS (SELECT DISTINCT 'o' || lpad(l_orderkey::VARCHAR, 9, '0') AS s, 's' || lpad(l_suppkey::VARCHAR, 7, '0') AS t, CASE WHEN l_orderkey % 7 = 0 THEN 'imports' ELSE 'ref' END AS k FROM lineitem)"""
OFFERS = """offers AS (SELECT DISTINCT 'o' || lpad(l_orderkey::VARCHAR, 9, '0') AS s, 'x' || l_partkey || '_' || l_suppkey AS t, CASE WHEN l_orderkey % 7 = 0 THEN 'imports' ELSE 'ref' END AS k FROM lineitem)"""
LINK_NODES = """nodes AS (SELECT 'o' || lpad(o_orderkey::VARCHAR, 9, '0') AS id, o_orderpriority AS c, 'Order ' || o_orderkey AS t FROM orders
  UNION ALL SELECT 's' || lpad(s_suppkey::VARCHAR, 7, '0'), 'supplier', s_name FROM supplier)"""

EVENTS = """raw AS (SELECT event_id, event_type, 'u' || user_id AS u, 'i' || json_extract_string(props, '$.k') AS i FROM events),
log AS (SELECT event_id + 1 AS seq, 'node_added' AS t, CASE WHEN event_type = 'signup' THEN i ELSE u END AS id, 'seen ' || event_id AS title,
    CASE WHEN event_type = 'signup' THEN 'item' ELSE 'user' END AS c, NULL AS s, NULL AS d, NULL AS kind FROM raw WHERE event_type IN ('signup', 'error')
  UNION ALL SELECT event_id + 1, 'edge_added', NULL, NULL, NULL, u, i, CASE WHEN event_type <> 'view' THEN event_type ELSE 'ref' END FROM raw WHERE event_type NOT IN ('signup', 'error'))"""


def prose(body: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({body}, '```[\s\S]*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), 'https?://\S+', ' ', 'g')"


def tokens(text: str, chars: int) -> str:
    found = f"regexp_extract_all(lower(substring({text}, 1, {chars})), '[a-z0-9][a-z0-9._/-]{{1,40}}')"
    return f"list_filter({found}, lambda x: x NOT IN ({names(STOP)}) AND NOT regexp_matches(x, '^[0-9]+$'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def term_freq(src: str = "docs") -> str:
    return f"""tf AS (SELECT id, ord, term, count(*) AS tf FROM (SELECT id, chapter || '/' || id || '.md' AS ord, unnest({tokens(prose('body'), 2600)}) AS term FROM {src}) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM {src}),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


POSTINGS = """post AS (SELECT term, id, tf FROM tf JOIN df USING (term), n WHERE df / n::DOUBLE <= 0.35::DOUBLE QUALIFY row_number() OVER (PARTITION BY term ORDER BY tf DESC, ord) <= 40)"""


def profile(src: str) -> str:
    """prof: the signals of profiles; code headers by a pattern on the first 300 characters."""
    head = r"(?m)^path:\s*(\S*)\s*\nlanguage:\s*(\S*)\s*\nsymbols:\s*(.*?)\s*\n"
    heading = r"(?m)^(#{1,4})\s+(.+?)\s*#*\s*$"
    b = rf"regexp_replace(body, '```[\s\S]*?```', ' ', 'g')"
    return rf"""p0 AS (SELECT *, regexp_matches(substring(body, 1, 300), '{head}') AS is_code, regexp_extract(substring(body, 1, 300), '{head}', 1) AS path,
    regexp_extract(substring(body, 1, 300), '{head}', 3) AS syms, {prose('body')} AS prose FROM {src}),
p1 AS (SELECT *, length({strip('prose')}) AS prose_len,
    CASE WHEN is_code THEN list_filter(list_transform(string_split(syms, ','), lambda x: {strip('x')}), lambda x: x NOT IN ('', '(none detected)')) ELSE []::VARCHAR[] END AS symbols,
    list_filter(list_transform(regexp_extract_all({b}, '{heading}', 2), lambda x: {fold('x')}), lambda x: length(x) >= 3) AS headings0,
    list_filter(list_transform(regexp_extract_all({b}, '`([^`\n]{{2,60}})`', 1), lambda x: {fold('x')}), lambda x: length(x) BETWEEN 2 AND 60) AS spans,
    CASE WHEN is_code AND path <> '' THEN CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END
      WHEN url LIKE 'http%' OR url LIKE 'file://%' THEN regexp_replace(url, '/[^/]*$', '') END AS dir FROM p0),
hd AS (SELECT DISTINCT id, unnest(headings0) AS heading FROM p1),
tm AS (SELECT id, term, sum(w)::INT AS w FROM (
    SELECT id, unnest(spans) AS term, 3 AS w FROM p1 UNION ALL SELECT id, heading, 2 FROM hd
    UNION ALL SELECT * FROM (SELECT id, unnest(list_transform(symbols, lambda x: {fold('x')})) AS term, 2 AS w FROM p1) WHERE length(term) >= 2) GROUP BY ALL),
prof AS (SELECT p1.*, coalesce(nh, 0) AS n_headings, coalesce(nt, 0) AS n_terms, CASE WHEN dir IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY dir) - 1 END AS n_siblings
  FROM p1 LEFT JOIN (SELECT id, count(*) AS nh FROM hd GROUP BY id) USING (id) LEFT JOIN (SELECT id, count(*) AS nt FROM tm GROUP BY id) USING (id))"""


def nominated(scored: str, cap: int, kind: str) -> str:
    return f"""SELECT a AS s, b AS t, '{kind}' AS k FROM (SELECT * FROM (SELECT a, b, score FROM {scored} UNION ALL SELECT b, a, score FROM {scored})
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {cap}) WHERE a < b"""


SIGNATURES = rf"""sc AS (SELECT id, title, prose FROM prof WHERE prose_len >= 220),
sn AS (SELECT count(*) AS n FROM sc),
st AS (SELECT id, term, sum(tf) AS tf, max(b) AS b FROM (SELECT id, unnest({tokens('prose', 4000)}) AS term, 1 AS tf, 1 AS b FROM sc
  UNION ALL SELECT id, unnest({tokens('title', 1000000)}), 2, 0 FROM sc) GROUP BY ALL),
sd AS (SELECT term, count(*) AS df FROM st GROUP BY term),
sw AS (SELECT id, term, b, round(tf * ln(1 + n / (1 + df)::DOUBLE), 9) AS w FROM st JOIN sd USING (term), sn WHERE df >= 2 AND df <= greatest(3, floor(n * 0.35::DOUBLE))),
sg AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS norm FROM (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, term DESC) <= 15)),
sp AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY term ORDER BY w DESC, id) <= 64)"""
SIMILAR = SIGNATURES + """,
ss AS (SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w / (x.norm * y.norm)), 9) AS score, max(x.b * y.b) AS body FROM sp x JOIN sp y ON x.term = y.term AND x.id < y.id GROUP BY ALL),
sf AS (SELECT * FROM ss WHERE score >= 0.20::DOUBLE AND body = 1),
e_similar AS (""" + nominated("sf", 5, "similar_to") + ")"
SIBLINGS = "e_sibling AS (SELECT x.id AS s, y.id AS t, 'sibling_of' AS k FROM prof x JOIN prof y ON x.dir = y.dir AND x.id < y.id WHERE x.n_siblings BETWEEN 1 AND 12)"
DUPLICATES = "e_duplicate AS (SELECT id AS s, lead(id) OVER (PARTITION BY sha ORDER BY id) AS t, 'duplicate_of' AS k FROM {src} WHERE sha <> '' QUALIFY t IS NOT NULL)"
HEADINGS = """hc AS (SELECT id, heading FROM hd JOIN prof USING (id) WHERE n_headings >= 3),
hn AS (SELECT count(*) AS n FROM prof WHERE n_headings >= 3),
hf AS (SELECT heading FROM hc, hn GROUP BY heading, n HAVING count(*) >= 2 AND count(*) <= greatest(8, floor(n * 0.35::DOUBLE))),
hp AS (SELECT id, heading FROM hc JOIN hf USING (heading) QUALIFY row_number() OVER (PARTITION BY heading ORDER BY id) <= 64),
hm AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM hp x JOIN hp y ON x.heading = y.heading AND x.id < y.id GROUP BY ALL),
hs AS (SELECT a, b, round(hm.n / (p.n_headings + q.n_headings - (SELECT count(*) FROM hc u JOIN hc v ON u.heading = v.heading WHERE u.id = hm.a AND v.id = hm.b))::DOUBLE, 9) AS score
  FROM hm JOIN prof p ON p.id = a JOIN prof q ON q.id = b),
hk AS (SELECT * FROM hs WHERE score >= 0.35::DOUBLE),
e_heading AS (""" + nominated("hk", 5, "shares_heading") + ")"
TERMS = """tn AS (SELECT count(*) AS n FROM prof WHERE n_terms > 0),
td AS (SELECT term, count(*) AS df FROM tm GROUP BY term),
tw AS (SELECT id, term, round(ln(1 + n / (1 + df)::DOUBLE), 9) AS idf, w FROM tm JOIN td USING (term), tn WHERE df >= 2 AND df <= greatest(3, floor(n * 0.35::DOUBLE))),
ts AS (SELECT * FROM (SELECT *, round(w * idf, 9) AS weight FROM tw) QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 10),
tp AS (SELECT * FROM ts QUALIFY row_number() OVER (PARTITION BY term ORDER BY weight DESC, id) <= 40),
tq AS (SELECT x.id AS a, y.id AS b, count(*) AS n, round(sum(x.idf), 9) AS score FROM tp x JOIN tp y ON x.term = y.term AND x.id < y.id GROUP BY ALL),
tk AS (SELECT * FROM tq WHERE n >= 2 AND score >= 1),
e_term AS (""" + nominated("tk", 5, "shares_term") + ")"
OWNERS = f"""ow AS (SELECT symbol, min(id) AS owner FROM (SELECT id, unnest(symbols) AS symbol FROM prof WHERE is_code) WHERE length(symbol) >= 4 AND lower(symbol) NOT IN ({names(SYMBOL_STOP)}) GROUP BY symbol HAVING count(DISTINCT id) = 1)"""
SYMBOLS = OWNERS + """,
mu AS (SELECT id, title, symbols, unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS symbol FROM prof WHERE is_code),
mh AS (SELECT mu.id, symbol, owner, count(*) + CASE WHEN contains(lower(title), lower(symbol)) THEN 2 ELSE 0 END AS score FROM mu JOIN ow USING (symbol) WHERE owner <> mu.id AND NOT list_contains(symbols, symbol) GROUP BY mu.id, symbol, owner, title),
e_symbol AS (SELECT DISTINCT id AS s, owner AS t, 'mentions_symbol' AS k FROM (SELECT * FROM mh QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, symbol) <= 5))"""


def overlap(kind: str, member: str, shared: str, p: str, links: str = "links") -> str:
    """Coupling or co-citation; ``p`` is a prefix for the names of the parts."""
    return f"""{p}u AS (SELECT DISTINCT s, t FROM {links} WHERE k IN ('ref', 'imports') AND s <> t),
{p}h AS (SELECT s FROM {p}u GROUP BY s HAVING count(*) > 24),
{p}d AS (SELECT z, count(*) AS deg FROM (SELECT s AS z FROM {p}u UNION ALL SELECT t FROM {p}u) GROUP BY z),
{p}g AS (SELECT {member} AS id, {shared} AS z FROM {p}u WHERE {member} NOT IN (SELECT s FROM {p}h) QUALIFY row_number() OVER (PARTITION BY {shared} ORDER BY {member}) <= 40),
{p}m AS (SELECT x.id AS a, y.id AS b, round(sum(1.0::DOUBLE / greatest(2, deg)), 9) AS score FROM {p}g x JOIN {p}g y ON x.z = y.z AND x.id < y.id JOIN {p}d ON {p}d.z = x.z GROUP BY ALL),
{p}k AS (SELECT * FROM {p}m WHERE score >= 0.25::DOUBLE),
e_{kind} AS (""" + nominated(f"{p}k", 5, kind) + ")"


def pagerank(ids: str, edges: str, rounds: int = 20) -> str:
    parts = [f"pn AS (SELECT count(*) AS n FROM {ids})", f"po AS MATERIALIZED (SELECT s AS id, count(*) AS o FROM {edges} GROUP BY s)", f"pe AS MATERIALIZED (SELECT e.s, e.t, o FROM {edges} e JOIN po ON po.id = e.s)", f"r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM {ids}, pn)"]
    for i in range(rounds):
        parts.append(
            f"""l{i} AS (SELECT coalesce(sum(r), 0) AS l FROM r{i} WHERE id NOT IN (SELECT id FROM po)),
g{i} AS (SELECT pe.t AS id, sum(0.85::DOUBLE * r / o) AS g FROM pe JOIN r{i} ON r{i}.id = pe.s GROUP BY pe.t),
r{i + 1} AS MATERIALIZED (SELECT x.id, 0.15::DOUBLE / n + coalesce(g, 0) + 0.85::DOUBLE * l / n AS r FROM {ids} x LEFT JOIN g{i} USING (id), l{i}, pn)"""
        )
    return ",\n".join(parts)


def filled(template: str) -> str:
    """A template of ``sources.tables.FILE_TEXTS`` as SQL."""
    parts = [f"({x[1:-1]})" if x.startswith("{") else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in re.split(r"(\{[^}]*\})", template) if x]
    return "concat(" + ", ".join(parts) + ")"


_TEXT = "CASE k % 8 " + " ".join(f"WHEN {i} THEN {filled(t)}" for i, t in enumerate(FILE_TEXTS)) + " END"
_FILE_ID = "CASE WHEN lang IS NULL THEN 'pkg' || (k % 40) || '_mod' || k ELSE replace(relpath, '/', '_') END"
#: The graph's documents: manuals, and source and text files as a tree of files has them.
GRAPH_DOCS = f"""tfiles AS MATERIALIZED (SELECT k, lang, relpath, {_FILE_ID} AS id, {_TEXT} AS content FROM files),
gfiles AS MATERIALIZED (SELECT k, lang, relpath, id, CASE WHEN lang IS NULL THEN content ELSE concat('path: ', relpath, chr(10), 'language: ', lang, chr(10), 'symbols: ',
    CASE lang WHEN 'python' THEN 'make_part_' || k WHEN 'rust' THEN 'mod' || (k + 40) ELSE '(none detected)' END, chr(10), chr(10), content) END AS body, CASE WHEN lang IS NULL THEN 'Title ' || k ELSE relpath END AS title FROM tfiles
  UNION ALL SELECT k, 'readme', 'pkg' || k || '/README.md', 'pkg' || k || '_README', '# Package ' || k || chr(10), 'Package ' || k FROM files WHERE k < 40),
gdocs AS MATERIALIZED (SELECT id, chapter, title, url, sha, body FROM manuals
  UNION ALL SELECT id, split_part(id, '_', 1), title, 'file:///' || relpath, sha256(body), body FROM gfiles),
golist AS (SELECT k % 40 AS p, id FROM (SELECT k, relpath, id FROM tfiles UNION ALL SELECT k, relpath, id FROM gfiles WHERE lang = 'readme') QUALIFY row_number() OVER (PARTITION BY k % 40 ORDER BY relpath) <= 20),
evid AS (
    SELECT 'part_' || lpad(p_partkey::VARCHAR, 7, '0') AS s, 'part_' || lpad((p_partkey * 5 + 2)::VARCHAR, 7, '0') AS t, 'ref' AS k FROM part
    UNION SELECT 'part_' || lpad(p_partkey::VARCHAR, 7, '0'), 'part_' || lpad((p_partkey + 9)::VARCHAR, 7, '0'), 'ref' FROM part
    UNION SELECT a.id, b.id, 'imports' FROM tfiles a JOIN tfiles b ON b.k IN (a.k + 8, a.k + 40) AND a.lang = b.lang WHERE a.lang NOT IN ('go', 'java')
    UNION SELECT a.id, b.id, 'imports' FROM tfiles a JOIN tfiles b ON b.k = a.k + 8 WHERE a.lang = 'java'
    UNION SELECT a.id, b.id, 'imports' FROM tfiles a JOIN golist b ON b.p = (a.k + 8) % 40 WHERE a.lang = 'go'
    UNION SELECT a.id, b.id, 'ref' FROM tfiles a JOIN tfiles b ON b.k IN (a.k + 8, a.k + 40) WHERE a.lang IS NULL
    UNION SELECT 'pkg' || (k % 40) || '_README', id, 'contains' FROM (SELECT k, id FROM tfiles QUALIFY row_number() OVER (PARTITION BY k % 40 ORDER BY id) <= 200)),
links AS MATERIALIZED (SELECT s, t, arg_min(k, list_position([{names(EVIDENCE_KINDS)}], k)) AS k FROM evid WHERE s <> t AND t IN (SELECT id FROM gdocs) AND s IN (SELECT id FROM gdocs) GROUP BY s, t)"""


def graph_edges() -> str:
    """All parts up to ``ge``, the edges of the graph."""
    prio = ", ".join(f"'{k}'" for k in DERIVED_KINDS)
    vers = "e_version AS (SELECT NULL::VARCHAR AS s, NULL::VARCHAR AS t, 'supersedes' AS k WHERE false)"
    gates = """admitted AS (SELECT c.s, c.t, c.k FROM cand c JOIN prof p ON p.id = c.s JOIN prof q ON q.id = c.t WHERE CASE c.k
    WHEN 'mentions_symbol' THEN p.is_code OR q.is_code WHEN 'similar_to' THEN p.prose_len >= 220 OR q.prose_len >= 220
    WHEN 'sibling_of' THEN p.n_siblings BETWEEN 1 AND 12 OR q.n_siblings BETWEEN 1 AND 12 WHEN 'shares_heading' THEN p.n_headings >= 3 OR q.n_headings >= 3
    WHEN 'shares_term' THEN p.n_terms >= 2 OR q.n_terms >= 2 ELSE true END)"""
    cand = " UNION ".join(f"SELECT s, t, k FROM e_{x}" for x in ("duplicate", "coupled_with", "co_cited_with", "symbol", "similar", "sibling", "version", "heading", "term"))
    return ",\n".join(
        [
            MANUALS, FILES, GRAPH_DOCS, profile("gdocs"), DUPLICATES.format(src="gdocs"), overlap("coupled_with", "s", "t", "cw_"), overlap("co_cited_with", "t", "s", "cc_"), SYMBOLS, SIMILAR, SIBLINGS, vers, HEADINGS, TERMS,
            f"cand AS ({cand})", gates,
            "have AS (SELECT DISTINCT least(s, t) AS lo, greatest(s, t) AS hi FROM links)",
            f"derived AS (SELECT s, t, k FROM admitted WHERE (least(s, t), greatest(s, t)) NOT IN (SELECT (lo, hi) FROM have) QUALIFY row_number() OVER (PARTITION BY least(s, t), greatest(s, t) ORDER BY list_position([{prio}], k), s) = 1)",
            "ge AS (SELECT s, t, k FROM links UNION ALL SELECT s, t, k FROM derived)",
        ]
    )
