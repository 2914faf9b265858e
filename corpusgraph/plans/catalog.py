"""Registered queries over the driver's tables, whole, and the DuckDB SQL of each where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.config import DEFAULT
from corpusgraph.functions import ids
from corpusgraph.functions import text as T
from corpusgraph.operators import claims, events, graph, index, layout, links, relations, retrieval, view
from corpusgraph.operators.common import shared_folder, top
from corpusgraph.operators.profile import narrowed, profiles, selected, terms
from corpusgraph.plans import sql as S
from corpusgraph.plans.build import build_graph
from corpusgraph.sources import files as tree
from corpusgraph.sources import tables as src
from corpusgraph.sources import web
from corpusgraph.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# -- index and search ------------------------------------------------------------


@query(rf"""WITH {S.DOCS}, p AS (SELECT id, {S.prose('body')} AS prose FROM docs)
SELECT id, len(list_filter(string_split_regex(prose, '\s+'), lambda x: x <> ''))::INT AS words,
  length({S.strip('prose')})::INT AS prose_len, substring({S.strip(S.collapse('prose'))}, 1, 150) AS digest FROM p""")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.documents(spark, sf_dir).select("id", T.strip_prose(F.col("body")).alias("prose"))
    return p.select("id", T.word_count(F.col("prose")).alias("words"), F.length(T.strip(F.col("prose"))).alias("prose_len"), T.digest(F.col("prose"), 150).alias("digest"))


@query(f"WITH {S.DOCS}, {S.term_freq()} SELECT id, term, tf FROM tf")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_freq(src.documents(spark, sf_dir)).select("id", "term", "tf")


@query(f"WITH {S.DOCS}, {S.term_freq()} SELECT term, df, df / n::DOUBLE <= 0.35::DOUBLE AS kept FROM df, n")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.doc_freq(index.term_freq(src.documents(spark, sf_dir))).select("term", "df", "kept")


@query(f"WITH {S.DOCS}, {S.term_freq()}, {S.POSTINGS} SELECT term, id, tf FROM post")
def posting_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(index.term_freq(src.documents(spark, sf_dir))).select("term", "id", "tf")


SEARCH = "the tion of. ing tion house"


@query(rf"""WITH {S.DOCS}, {S.term_freq()}, {S.POSTINGS}, q AS (SELECT unnest(regexp_extract_all(lower('{SEARCH}'), '[a-z0-9][a-z0-9._/-]{{1,40}}')) AS term),
l AS (SELECT term, count(*) AS plen FROM post GROUP BY term),
z AS (SELECT id, round(sum(ln(1 + n / (1 + plen)::DOUBLE) * (1 + ln(tf))), 9) AS raw FROM q JOIN post USING (term) JOIN l USING (term), n GROUP BY id ORDER BY raw DESC, id LIMIT 10)
SELECT id, title, url, round(raw, 3) AS score FROM z JOIN docs USING (id)""")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.documents(spark, sf_dir)
    return index.search(docs, index.postings(index.term_freq(docs)), SEARCH)


# -- profiles and relations --------------------------------------------------------


@query(f"""WITH {S.MANUALS}, {S.profile('manuals')} SELECT id, prose_len::INT AS prose_len, is_code, dir, n_siblings::INT AS n_siblings, n_headings::INT AS n_headings, n_terms::INT AS n_terms,
  array_to_string(list_sort((SELECT list(heading) FROM hd WHERE hd.id = prof.id)), '|') AS headings FROM prof""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles(src.manuals(spark, sf_dir))
    return p.select("id", "prose_len", "is_code", "dir", "n_siblings", F.size("headings").alias("n_headings"), "n_terms", F.array_join(F.array_sort("headings"), "|").alias("headings"))


@query(f"""WITH {S.DOCS}, {S.profile('docs')} SELECT id, concat_ws(',', CASE WHEN is_code THEN 'mentions_symbol' END, CASE WHEN prose_len >= 220 THEN 'similar_to' END, CASE WHEN n_siblings BETWEEN 1 AND 12 THEN 'sibling_of' END,
  CASE WHEN n_headings >= 3 THEN 'shares_heading' END, CASE WHEN n_terms >= 2 THEN 'shares_term' END) AS dims FROM prof""")
def select_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(src.documents(spark, sf_dir)).select("id", F.array_join(selected(), ",").alias("dims"))


@query(f"WITH {S.DOCS}, {S.profile('docs')} SELECT id, dir, n_siblings::INT AS n_siblings FROM prof")
def cohort_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(src.documents(spark, sf_dir)).select("id", "dir", "n_siblings")


@query(f"WITH {S.MANUALS}, {S.profile('manuals')} SELECT id, term, w FROM tm")
def curated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(profiles(src.manuals(spark, sf_dir)))


@query(f"WITH {S.DOCS}, {S.DUPLICATES.format(src='docs')} SELECT * FROM e_duplicate")
def duplicate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.duplicate_of(src.documents(spark, sf_dir))


@query(f"WITH {S.DOCS}, {S.profile('docs')}, {S.SIBLINGS} SELECT * FROM e_sibling")
def sibling_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.sibling_of(profiles(src.documents(spark, sf_dir)))


@query(f"WITH {S.VERSIONS} SELECT a.id AS s, b.id AS t, 'supersedes' AS k FROM versions a JOIN versions b ON a.o_custkey = b.o_custkey AND a.v = b.v + 1 WHERE length('cust' || a.o_custkey) >= 4")
def supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.supersedes(profiles(src.versions(spark, sf_dir)))


@query(f"WITH {S.DOCS}, {S.profile('docs')}, {S.SIGNATURES} SELECT id, term, w, b AS in_body, round(norm, 6) AS norm FROM sg")
def signature_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.signatures(profiles(src.documents(spark, sf_dir))).select("id", "term", "w", "in_body", F.round("norm", 6).alias("norm"))


@query(f"WITH {S.DOCS}, {S.profile('docs')}, {S.SIMILAR} SELECT * FROM e_similar")
def similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.similar_to(profiles(src.documents(spark, sf_dir)))


@query(f"WITH {S.MANUALS}, {S.profile('manuals')}, {S.HEADINGS} SELECT * FROM e_heading")
def shares_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.shares_heading(profiles(src.manuals(spark, sf_dir)))


@query(f"WITH {S.MANUALS}, {S.profile('manuals')}, {S.TERMS} SELECT * FROM e_term")
def shares_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.shares_term(profiles(src.manuals(spark, sf_dir)))


def _graph_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manuals, and a tree of source and text files of eight kinds, with their evidence."""
    code = src.source_files(spark, sf_dir)
    manual = src.manuals(spark, sf_dir)
    docs = manual.unionByName(tree.tree_docs(code))
    refs = links.body_links(manual).select(F.col("src").alias("s"), F.col("dst").alias("t"), F.lit("ref").alias("k"))
    return docs, refs.union(tree.tree_edges(code))


_CODE = f"WITH {S.MANUALS}, {S.FILES}, {S.GRAPH_DOCS}, {S.profile('gdocs')}, {S.SYMBOLS}"


@query(f"{_CODE} SELECT symbol, owner FROM ow")
def unique_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.unique_owners(profiles(_graph_docs(spark, sf_dir)[0]))


@query(f"{_CODE} SELECT * FROM e_symbol")
def mentions_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.mentions_symbol(profiles(_graph_docs(spark, sf_dir)[0]))


@query(f"WITH {S.OFFERS}, {S.overlap('coupled_with', 's', 't', 'cw_', 'offers')} SELECT * FROM e_coupled_with")
def coupled_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that take the same offers, a part by a supplier."""
    return relations.coupled_with(src.offer_links(spark, sf_dir))


@query(f"WITH {S.LINKS}, {S.overlap('co_cited_with', 't', 's', 'cc_')} SELECT * FROM e_co_cited_with")
def co_cited_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.co_cited_with(src.order_links(spark, sf_dir))


EMBED = DEFAULT.but(embed_from=0.30)


@query(f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
p AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n + 1e-12::DOUBLE), 9) AS score FROM u a JOIN u b ON a.id < b.id), f AS (SELECT * FROM p WHERE score >= 0.30::DOUBLE)
{S.nominated('f', 5, 'semantic_similar')}""")
def semantic_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.semantic_similar(src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), EMBED)


@query(f"""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS id, 'day ' || strftime(o_orderdate, '%Y-%m-%d') AS entity0 FROM orders), x AS (SELECT DISTINCT id, {S.fold('entity0')} AS entity FROM e), n AS (SELECT count(DISTINCT id) AS n FROM x),
d AS (SELECT entity FROM x, n GROUP BY entity, n HAVING count(*) >= 2 AND count(*) <= greatest(2, floor(n * 0.3::DOUBLE))),
y AS (SELECT id, entity FROM x JOIN d USING (entity)), m AS (SELECT a.id AS a, b.id AS b, count(*) AS score FROM y a JOIN y b ON a.entity = b.entity AND a.id < b.id GROUP BY ALL HAVING count(*) >= 2)
{S.nominated('m', 5, 'shares_entity')}""")
def shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.concat(F.lit("Day "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("entity"))
    return relations.shares_entity(o)


# -- links and graph ------------------------------------------------------------------


@query(f"""WITH {S.MANUALS}, l AS (SELECT id AS src, unnest(regexp_extract_all(body, '\\[[^\\]]*\\]\\(([^)\\s#]+)', 1)) AS x FROM manuals)
SELECT DISTINCT src, regexp_replace(regexp_replace(replace(x, '/', '_'), '\\.html$', ''), '\\.md$', '') AS dst FROM l WHERE dst IN (SELECT id FROM manuals) AND dst <> src""")
def md_link_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.body_links(src.manuals(spark, sf_dir))


@query(f"WITH {S.LINKS}, {S.LINK_NODES} SELECT s AS src, t AS dst FROM links WHERE s IN (SELECT id FROM nodes) AND t IN (SELECT id FROM nodes) AND s <> t GROUP BY ALL")
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.resolve(src.order_links(spark, sf_dir).select(F.col("s").alias("src"), F.col("t").alias("dst")), src.order_nodes(spark, sf_dir))


@query(f"WITH {S.LINKS}, {S.LINK_NODES} SELECT id, count(s) AS g FROM nodes LEFT JOIN links ON links.t = id GROUP BY id")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(src.order_nodes(spark, sf_dir), src.order_links(spark, sf_dir))


@query(f"WITH {S.LINKS} SELECT k, count(*) AS n FROM links GROUP BY k")
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_type_counts(src.order_links(spark, sf_dir))


@query(f"WITH {S.LINKS} SELECT CASE WHEN count(*) > 0 THEN 'READY' ELSE 'NOT-READY' END AS verdict, count(*) || ' resolved links' AS note, count(*) AS edges FROM links")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.verdict(src.order_links(spark, sf_dir))


@query(f"WITH {S.LINKS} SELECT id, count(*) AS degree FROM (SELECT s AS id FROM links UNION ALL SELECT t FROM links) GROUP BY id ORDER BY degree DESC, id LIMIT 5")
def top_degree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_degree(src.order_links(spark, sf_dir))


@query(f"WITH {S.LINKS}, {S.LINK_NODES}, {S.pagerank('nodes', 'links')} SELECT id, round(r, 6) AS r FROM r20")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(src.order_nodes(spark, sf_dir), src.order_links(spark, sf_dir))


CENTRE = "o000000000"


@query(f"""WITH {S.LINKS}, b AS (SELECT s, t FROM links UNION SELECT t, s FROM links), h1 AS (SELECT DISTINCT t AS id FROM b WHERE s = '{CENTRE}'),
h2 AS (SELECT DISTINCT t AS id FROM b WHERE s IN (SELECT id FROM h1) AND t <> '{CENTRE}' AND t NOT IN (SELECT id FROM h1))
SELECT '{CENTRE}' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(src.order_links(spark, sf_dir), CENTRE, 2)


@query(f"WITH {S.LINKS}, b AS (SELECT s, t FROM links UNION SELECT t, s FROM links), h AS (SELECT '{CENTRE}' AS id UNION SELECT t FROM b WHERE s = '{CENTRE}') SELECT s, t, k FROM links WHERE s IN (SELECT id FROM h) AND t IN (SELECT id FROM h)")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.order_links(spark, sf_dir)
    return graph.induced(e, graph.neighbours(e, CENTRE, 1))


@query(f"""WITH RECURSIVE {S.LINKS}, b AS MATERIALIZED (SELECT s, t FROM links UNION SELECT t, s FROM links),
w AS (SELECT '{CENTRE}' AS id, 0 AS depth UNION SELECT b.t, w.depth + 1 FROM w JOIN b ON b.s = w.id WHERE w.depth < 3) SELECT id, min(depth)::INT AS depth FROM w GROUP BY id""")
def bfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.order_links(spark, sf_dir).select("s", "t")
    both = e.union(e.select("t", "s")).distinct()
    return graph.reach(both, spark.createDataFrame([(CENTRE,)], "id string"), 3)


def _built(spark: SparkSession, sf_dir: str):
    return build_graph(*_graph_docs(spark, sf_dir))


@query(f"WITH {S.graph_edges()} SELECT s, t, k FROM ge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).edges


@query(f"""WITH {S.graph_edges()}, {S.pagerank('gdocs', 'ge')}, gi AS (SELECT t AS id, count(*) AS g FROM ge GROUP BY t)
SELECT d.id AS i, chapter AS c, title AS t, url AS u, coalesce(g, 0)::INT AS g, round(r, 6) AS r, len(list_filter(string_split_regex({S.prose('body')}, '\\s+'), lambda x: x <> ''))::INT AS w FROM gdocs d LEFT JOIN gi USING (id) JOIN r20 ON r20.id = d.id""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).nodes


@query(f"WITH {S.graph_edges()} SELECT k, count(*) AS edges, (SELECT count(DISTINCT x) FROM (SELECT s AS x FROM derived d WHERE d.k = o.k UNION SELECT t FROM derived d WHERE d.k = o.k)) AS nodes FROM derived o GROUP BY k")
def dimension_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.dimension_report(_built(spark, sf_dir).derived)


@query(f"""WITH {S.graph_edges()} SELECT CASE WHEN count(*) FILTER (k IN ('ref', 'imports')) > 0 THEN 'READY' ELSE 'NOT-READY' END AS verdict, count(*) FILTER (k IN ('ref', 'imports')) || ' resolved links' AS note,
count(*) AS edges, (SELECT count(*) FROM gdocs) AS docs FROM ge""")
def site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).report.select("verdict", "note", "edges", "docs")


@query(f"""WITH {S.LINKS}, {S.LINK_NODES}, l AS MATERIALIZED (SELECT s, t, k FROM links), d AS MATERIALIZED (SELECT t AS id, count(*) AS g FROM l GROUP BY t),
n AS MATERIALIZED (SELECT id FROM nodes LEFT JOIN d USING (id) ORDER BY coalesce(g, 0) DESC, id LIMIT 500) SELECT s, t, k FROM l JOIN n a ON a.id = l.s JOIN n b ON b.id = l.t""")
def trim_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 500 most linked nodes; ranks are left out so that ids break ties."""
    e = src.order_links(spark, sf_dir)
    n = graph.in_degree(src.order_nodes(spark, sf_dir), e).withColumn("r", F.lit(0.0))
    return graph.induced(e, graph.trim(n, 500))


@query(f"WITH {S.LINKS}, {S.LINK_NODES} SELECT id, nodes.t AS t, c, count(s) AS g FROM nodes LEFT JOIN links ON links.t = id WHERE contains(lower(nodes.t), '00001') GROUP BY ALL ORDER BY g DESC, id LIMIT 8")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = src.order_nodes(spark, sf_dir)
    return graph.title_search(n.join(graph.in_degree(n, src.order_links(spark, sf_dir)), "id"), "00001")


@query(f"WITH {S.LINKS}, {S.LINK_NODES}, v AS (SELECT id FROM nodes WHERE c IN ('supplier', '1-URGENT')) SELECT s, t, k FROM links WHERE k <> 'imports' AND s IN (SELECT id FROM v) AND t IN (SELECT id FROM v)")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible(src.order_nodes(spark, sf_dir), src.order_links(spark, sf_dir), ["supplier", "1-URGENT"], hidden_kinds=("imports",))[1]


@query("SELECT label::VARCHAR AS c, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y, round(avg(embedding[3]::DOUBLE), 6) AS z, count(*) AS n FROM embeddings GROUP BY label")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "embeddings")
    return graph.centroids(e.select(F.col("label").cast("string").alias("c"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]))


@query("SELECT vec_id AS id, greatest(-32767, least(32767, round_even(embedding[1]::DOUBLE * 30000, 0)::INT))::INT AS qx, greatest(-32767, least(32767, round_even(embedding[2]::DOUBLE * 300000, 0)::INT))::INT AS qy FROM embeddings")
def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), T.quantise(F.col("embedding")[0].cast("double")).alias("qx"), T.quantise(F.col("embedding")[1].cast("double") * 10).alias("qy"))


@query(f"""WITH {S.LINKS}, {S.LINK_NODES}, p AS (SELECT 'CORPUS' AS name, count(*) AS count, -1 AS pos, least(10.0::DOUBLE, greatest(1.2::DOUBLE, count(*) / 2500.0::DOUBLE)) AS dur FROM nodes
UNION ALL SELECT k, count(*), list_position(['ref', 'imports'], k), least(14.0::DOUBLE, greatest(0.4::DOUBLE, count(*) / 1500.0::DOUBLE)) FROM links GROUP BY k)
SELECT name, count, round(coalesce(sum(dur) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS t0, round(dur, 4) AS dur FROM p""")
def build_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.build_phases(src.order_nodes(spark, sf_dir), src.order_links(spark, sf_dir))


@query(f"""WITH {S.LINKS}, {S.LINK_NODES}, p AS (SELECT k, count(*) AS m, list_position(['ref', 'imports'], k) AS pos, least(14.0::DOUBLE, greatest(0.4::DOUBLE, count(*) / 1500.0::DOUBLE)) AS dur FROM links GROUP BY k),
c AS (SELECT least(10.0::DOUBLE, greatest(1.2::DOUBLE, count(*) / 2500.0::DOUBLE)) AS dur FROM nodes), q AS (SELECT k, m, p.dur, c.dur + coalesce(sum(p.dur) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0 FROM p, c)
SELECT s, t, links.k AS k, round(t0 + row_number() OVER (PARTITION BY links.k ORDER BY s, t) / m::DOUBLE * dur, 4) AS birth FROM links JOIN q USING (k)""")
def edge_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.edge_births(src.order_nodes(spark, sf_dir), src.order_links(spark, sf_dir))


@query("""WITH n AS (SELECT c_custkey AS id, greatest(c_acctbal::DOUBLE, 0) AS r, coalesce(k, 0) AS kids, c_nationkey + coalesce(k, 0) AS degree, length(c_name) AS words FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey),
m AS (SELECT max(r) AS mr, max(kids) AS mk, max(degree) AS md, max(words) AS mw FROM n), f AS (SELECT *, least(30, greatest(3, round((1.2::DOUBLE + 14.2::DOUBLE * sqrt(r / mr) + 3.2::DOUBLE * sqrt(degree / md::DOUBLE)) / 0.62::DOUBLE)::INT))::INT AS floors FROM n, m)
SELECT id, floors, round(floors * 0.62::DOUBLE, 6) AS height, round(CASE WHEN kids > 0 THEN 0.06::DOUBLE + 0.20::DOUBLE * sqrt(kids / mk::DOUBLE) + 0.28::DOUBLE * sqrt(words / mw::DOUBLE) ELSE 0.02::DOUBLE + 0.12::DOUBLE * sqrt(words / mw::DOUBLE) END, 6) AS lit FROM f""")
def towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages: their balance is the rank, their orders are the links they send."""
    kids = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("kids"))
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("r"), "c_nationkey", F.length("c_name").alias("words"))
    n = c.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    return view.towers(n.withColumn("degree", F.col("c_nationkey") + F.col("kids")))


@query()
def settled_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations laid out, a site for each region: one group of rows for each site."""
    s, n = src.table(spark, sf_dir, "supplier"), src.table(spark, sf_dir, "nation")
    both = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # nation has 25 rows
    nodes = both.select(F.col("n_regionkey").cast("string").alias("site_id"), F.col("s_name").alias("i"), F.col("n_name").alias("c")).union(n.select(F.col("n_regionkey").cast("string"), "n_name", "n_name"))
    edges = both.select(F.col("n_regionkey").cast("string").alias("site_id"), F.col("s_name").alias("s"), F.col("n_name").alias("t"), F.lit("ref").alias("k"))
    return layout.settle(nodes, edges)


@query(f"""WITH {S.LINKS}, {S.LINK_NODES}, d AS MATERIALIZED (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM links UNION ALL SELECT t FROM links) GROUP BY id), m AS (SELECT count(*) AS m FROM links)
SELECT id, degree, round(degree + 400 * (degree / m::DOUBLE), 6) AS score FROM d, m ORDER BY score DESC, id LIMIT 40""")
def label_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 nodes that get a label; a node's share of all edges stands for its rank."""
    e = src.order_links(spark, sf_dir)
    n = graph.degree(e).crossJoin(F.broadcast(e.agg(F.count("*").alias("m")))).withColumn("r", F.col("degree") / F.col("m"))
    return graph.label_rank(n, 40).select("id", "degree", "score")


@query(f"""WITH {S.LINKS}, {S.LINK_NODES}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM nodes), p AS MATERIALIZED (SELECT id FROM o WHERE i % ceil(n / 5000.0::DOUBLE)::BIGINT = 0)
SELECT s, t, k FROM links JOIN p a ON a.id = s JOIN p b ON b.id = t ORDER BY s, t, k LIMIT 20000""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: edges among every k-th node."""
    return graph.stride_sample(src.order_nodes(spark, sf_dir), src.order_links(spark, sf_dir))[1]


@query(f"""WITH {S.LINKS}, {S.LINK_NODES}, v AS MATERIALIZED (SELECT * FROM links WHERE k <> 'imports'), h AS MATERIALIZED (SELECT '{CENTRE}' AS id UNION SELECT t FROM v WHERE s = '{CENTRE}' UNION SELECT s FROM v WHERE t = '{CENTRE}')
SELECT nodes.id, c, h.id IS NOT NULL AS near, CASE WHEN h.id IS NOT NULL THEN 1.2::DOUBLE ELSE 0.07::DOUBLE END AS dim FROM nodes LEFT JOIN h ON h.id = nodes.id""")
def in_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_focus(src.order_nodes(spark, sf_dir), src.order_links(spark, sf_dir), CENTRE, ("imports",))[0].select("id", "c", "near", "dim")


@query("""WITH l AS (SELECT DISTINCT CASE l_orderkey % 5 WHEN 0 THEN 'index' WHEN 1 THEN 'o' || l_orderkey || '_index' ELSE 'o' || l_orderkey END AS s, 's' || l_suppkey AS t, l_orderkey % 5 AS r FROM lineitem)
SELECT s, t, CASE r WHEN 0 THEN 'hub' WHEN 1 THEN 'contains' ELSE 'ref' END AS k FROM l""")
def hub_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose sources are the index, an index of a part, or a page."""
    k = F.col("l_orderkey")
    s = F.when(k % 5 == 0, "index").when(k % 5 == 1, F.concat(F.lit("o"), k, F.lit("_index"))).otherwise(F.concat(F.lit("o"), k))
    return graph.classify_hubs(src.table(spark, sf_dir, "lineitem").select(s.alias("s"), F.concat(F.lit("s"), "l_suppkey").alias("t")).distinct())


@query(f"""WITH {S.MANUALS}, {S.profile('manuals')}, d AS (SELECT id, list_filter(['sibling_of', 'similar_to', 'shares_heading', 'shares_term'], lambda x: CASE x WHEN 'similar_to' THEN prose_len >= 220 WHEN 'sibling_of' THEN n_siblings BETWEEN 1 AND 12 WHEN 'shares_heading' THEN n_headings >= 3 ELSE n_terms >= 2 END) AS dims FROM prof)
SELECT id, array_to_string(list_sort(CASE WHEN substr(id, 6)::BIGINT % 2 = 0 THEN list_filter(dims, lambda x: x IN ('similar_to', 'shares_entity')) ELSE dims END), ',') AS dims FROM d""")
def picked_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of the manuals; a router has picked two dimensions for every second one."""
    p = profiles(src.manuals(spark, sf_dir))
    picks = p.where(F.substring("id", 6, 20).cast("long") % 2 == 0).select("id", F.array(F.lit("similar_to"), F.lit("shares_entity")).alias("dims"))
    return narrowed(p.select("id", selected().alias("dims")), picks).select("id", F.array_join(F.array_sort("dims"), ",").alias("dims"))


# -- local trees -----------------------------------------------------------------------------

_STEP = "files b ON b.k IN (a.k + 8, a.k + 40) AND b.lang IS NOT DISTINCT FROM a.lang"


@query(f"""WITH {S.FILES} SELECT a.relpath AS rel, b.relpath AS hit FROM files a JOIN {_STEP} WHERE a.lang NOT IN ('go', 'java')
UNION ALL SELECT a.relpath, b.relpath FROM files a JOIN files b ON b.k = a.k + 8 WHERE a.lang = 'java'
UNION ALL SELECT a.relpath, b.relpath FROM files a JOIN (SELECT k % 40 AS p, relpath FROM (SELECT k, relpath FROM files UNION ALL SELECT k, 'pkg' || k || '/README.md' FROM files WHERE k < 40)
  QUALIFY row_number() OVER (PARTITION BY k % 40 ORDER BY relpath) <= 20) b ON b.p = (a.k + 8) % 40 WHERE a.lang = 'go' AND a.relpath <> b.relpath""")
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.imports(src.source_files(spark, sf_dir))


@query(f"""WITH {S.FILES} SELECT a.relpath AS rel, '../pkg' || ((a.k + 8) % 40) || '/mod' || (a.k + 8) || '.md' AS target, b.relpath AS hit, 'link' AS kind, CASE WHEN b.k IS NOT NULL THEN 1 END AS n FROM files a LEFT JOIN files b ON b.k = a.k + 8 WHERE a.lang IS NULL
UNION ALL SELECT relpath, 'nowhere.md', NULL, 'link', NULL FROM files WHERE lang IS NULL
UNION ALL SELECT a.relpath, 'Mod' || (a.k + 40), b.relpath, 'wiki', CASE WHEN b.k IS NOT NULL THEN 1 END FROM files a LEFT JOIN files b ON b.k = a.k + 40 WHERE a.lang IS NULL""")
def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.doc_links(src.source_files(spark, sf_dir))


@query(f"""WITH {S.FILES} SELECT CASE WHEN lang IS NULL THEN 'pkg' || (k % 40) || '_mod' || k ELSE replace(relpath, '/', '_') END AS id, 'pkg' || (k % 40) AS chapter, CASE WHEN lang IS NULL THEN 'Title ' || k ELSE relpath END AS title FROM files
UNION ALL SELECT 'pkg' || k || '_README', 'pkg' || k, 'Package ' || k FROM files WHERE k < 40""")
def doc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_docs(src.source_files(spark, sf_dir)).select("id", "chapter", "title")


@query(f"""WITH {S.FILES} SELECT 'pkg' || a.k || '_README' AS s, CASE WHEN b.lang IS NULL THEN 'pkg' || (b.k % 40) || '_mod' || b.k ELSE replace(b.relpath, '/', '_') END AS t, 'contains' AS k
FROM files a JOIN files b ON b.k % 40 = a.k WHERE a.k < 40 QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY t) <= 200""")
def hub_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tree.file_ids(src.source_files(spark, sf_dir)).select("id", links.parent(F.col("relpath")).alias("dir"), links.stem(F.col("relpath")).alias("stem"))
    return relations.directory_hubs(f)


@query("""WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'src/b.bin' WHEN 2 THEN 'node_modules/x.js' WHEN 3 THEN 'yarn.lock' WHEN 4 THEN 'docs/readme.md' WHEN 5 THEN 'Makefile' WHEN 6 THEN 'big.txt' WHEN 7 THEN '.notes' ELSE 'drivers/target/t.c' END AS r FROM part)
SELECT CASE k % 9 WHEN 1 THEN 'ext' WHEN 2 THEN 'pruned' WHEN 3 THEN 'noise_file' WHEN 6 THEN 'size' WHEN 7 THEN 'ext' WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'kept' ELSE 'binary' END WHEN 4 THEN CASE WHEN k % 5 = 0 THEN 'symlink' ELSE 'kept' END WHEN 8 THEN 'kept' ELSE 'kept' END AS skip, count(*) AS n FROM f GROUP BY ALL""")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = ["src/a.py", "src/b.bin", "node_modules/x.js", "yarn.lock", "docs/readme.md", "Makefile", "big.txt", ".notes", "drivers/target/t.c"]
    rows = src.table(spark, sf_dir, "part").select(
        F.element_at(F.array(*map(F.lit, names)), (k % 9 + 1).cast("int")).alias("relpath"), F.when(k % 9 == 6, 1_000_000).otherwise(100).alias("size"), ((k % 9 == 4) & (k % 5 == 0)).alias("is_symlink"),
        F.when((k % 9 == 0) & (k % 2 == 1), F.unhex(F.lit("610062"))).otherwise(F.unhex(F.lit("6162"))).alias("head"),
    )
    return tree.scan_stats(tree.scanned(rows, exempt=("drivers/target",)))


# -- web ------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>|<noscript[\s\S]*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t, html FROM pages)
SELECT page_id, length(t)::INT AS text_len, (length(t) < 150 AND len(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) = 0) AS shell FROM p""")
def js_shell_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.table(spark, sf_dir, "pages")
    return p.select("page_id", T.text_length(F.col("html")).alias("text_len"), T.is_js_shell(F.col("html"), T.hrefs(F.col("html"))).alias("shell"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '\s*#+$', '')) AS title,
trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS headings, '' AS description FROM pages""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return src.table(spark, sf_dir, "pages").select("page_id", T.page_title(h, F.col("url")).alias("title"), F.array_join(T.page_headings(h), "|").alias("headings"), T.page_description(h).alias("description"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(coalesce(html, ''), '<article>([\s\S]*)</article>', 1) AS h FROM pages),
c AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) AS t FROM a)
SELECT page_id, regexp_replace(t, '&amp;?', '&', 'g') AS text FROM c""")
def content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the element that holds a page's content."""
    p = src.table(spark, sf_dir, "pages")
    parts = web.page_parts(p.select(F.col("page_id").cast("string").alias("url"), "html"))
    return parts.select(F.col("url").cast("long").alias("page_id"), "text")


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'page ' || page_id WHEN 1 THEN 'og ' || page_id WHEN 2 THEN 'both ' || page_id ELSE '' END AS description FROM pages""")
def page_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are given descriptions in several forms, and none to every fourth."""
    k = F.col("page_id")
    meta = F.when(k % 4 == 0, F.concat(F.lit('<meta content="page  '), k, F.lit('" name="description">'))).when(k % 4 == 1, F.concat(F.lit("<META property='og:description' content='og "), k, F.lit("'/>"))).when(
        k % 4 == 2, F.concat(F.lit('<meta property="og:description" content="no"><meta name=description content="both '), k, F.lit('">'))).otherwise('<meta name="keywords" content="no">')
    h = F.replace("html", F.lit("<title>"), F.concat(meta, F.lit("<title>")))
    return src.table(spark, sf_dir, "pages").select("page_id", T.page_description(h).alias("description"))


@query("""WITH n AS (SELECT 'https://parts.example/p/' || (p_partkey % 20) || '/' || p_size AS url, p_partkey % 20 AS pos FROM part),
f AS (SELECT url, min(pos) AS pos FROM n GROUP BY url), e AS (SELECT pos, count(*) AS n FROM f GROUP BY pos), b AS (SELECT pos, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT url FROM f JOIN b USING (pos) WHERE before < 300""")
def sitemap_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap of 20 child sitemaps, read until 300 addresses are there."""
    k = F.col("p_partkey")
    locs = src.table(spark, sf_dir, "part").select((k % 20).alias("at"), F.concat(F.lit("<loc>https://parts.example/p/"), k % 20, F.lit("/"), "p_size", F.lit("</loc>")).alias("loc"))
    child = locs.groupBy("at").agg(F.array_join(F.sort_array(F.collect_set("loc")), "").alias("body")).select(F.concat(F.lit("https://parts.example/m"), "at", F.lit(".xml")).alias("url"), "body")
    root = spark.range(1).select(F.lit("https://parts.example/sitemap.xml").alias("url"), F.lit("".join(f"<loc>https://parts.example/m{i}.xml</loc>" for i in range(30))).alias("body"))
    return web.sitemap_inventory(root.unionByName(child), "https://parts.example/sitemap.xml", "https://parts.example/", enough=300)


@query(r"""WITH l AS (SELECT url AS src, regexp_extract(url, '^(\w+://[^/?#]*)', 1) || regexp_replace(unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)), '[?#].*$', '') AS dst FROM pages) SELECT DISTINCT src, dst FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(src.table(spark, sf_dir, "pages"))


@query(r"""WITH p AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^\w+://[^/?#]*', ''), '[?#].*$', ''), '^/+|/+$', '', 'g'), '\.html?$', '') AS p FROM pages)
SELECT url, CASE WHEN p = '' THEN 'index' ELSE replace(p, '/', '_') END AS id, split_part(replace(p, '/', '_'), '_', 1) AS chapter FROM p""")
def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.table(spark, sf_dir, "pages").select("url", ids.page_id(F.concat(F.regexp_extract("url", r"^(\w+://[^/?#]*)", 1), F.lit("/")), F.col("url")).alias("id"))
    return p.select("url", "id", ids.chapter(F.col("id")).alias("chapter"))


@query(r"""SELECT DISTINCT 'https://parts.example/docs/' || p_type || '/' || p_size AS url FROM part WHERE p_partkey % 3 <> 0""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    maps = src.table(spark, sf_dir, "part").select(
        F.concat(F.lit("https://parts.example/sitemap"), k, F.lit(".xml")).alias("url"),
        F.when(k % 3 == 0, F.concat(F.lit("<urlset><loc>https://other.example/"), k, F.lit("</loc><loc>https://parts.example/map"), k, F.lit(".xml</loc></urlset>"))).otherwise(F.concat(F.lit("<urlset><url><loc>https://parts.example/docs/"), "p_type", F.lit("/"), "p_size", F.lit("</loc></url></urlset>"))).alias("body"),
    )
    return web.sitemap_urls(maps, "https://parts.example/docs/")


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 1000 AS page FROM orders), x AS (SELECT k, CASE WHEN k % 10 = 0 THEN 'robots' WHEN k % 10 = 1 THEN 'status:404' WHEN k % 10 = 2 THEN 'not-html' ELSE 'ok' END AS r, page FROM f)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN r = 'ok' THEN CASE WHEN row_number() OVER (PARTITION BY page, r ORDER BY k) = 1 THEN 'page' ELSE 'redirect_merged' END ELSE r END AS outcome FROM x) GROUP BY outcome""")
def fetch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    log = src.table(spark, sf_dir, "orders").select(
        k.alias("ord"), F.concat(F.lit("https://x.example/a"), k).alias("url"), F.concat(F.lit("https://x.example/p"), k % 1000).alias("final_url"), F.when(k % 10 == 1, 404).otherwise(200).alias("status"),
        F.when(k % 10 == 2, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), F.when(k % 10 == 0, F.lit("robots")).alias("reason"),
    )
    return web.fetch_stats(web.settled(log))


@query("""WITH h AS (SELECT p_partkey AS k FROM part) SELECT 'https://x.example/d/' || k AS url,
CASE WHEN k % 11 > 5 THEN NULL ELSE 'https://x.example/d/' || (k - k % 11) END AS final_url, CASE WHEN k % 11 <= 5 THEN 200 END::INT AS status,
CASE WHEN k % 11 = 10 THEN 'offsite_redirect' WHEN k % 11 > 5 THEN 'too_many_hops' END AS reason FROM h""")
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of redirects from each key to the one before, down to a multiple of 11; the last of each chain leaves the site."""
    k = F.col("p_partkey")
    hops = src.table(spark, sf_dir, "part").select(
        F.concat(F.lit("https://x.example/d/"), k).alias("url"), F.when(k % 11 == 0, 200).otherwise(302).alias("status"),
        F.when(k % 11 == 10, "https://other.example/").when(k % 11 > 0, F.concat(F.lit("/d/"), k - 1)).alias("location"), F.lit(True).alias("allowed"),
    )
    return web.followed(hops, "https://x.example/")


# -- store ----------------------------------------------------------------------------------------------


@query(f"WITH {S.DOCS} SELECT id, (('0x' || substr(sha256(id), 1, 8))::BIGINT % 64)::INT AS bucket FROM docs")
def bucket_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.documents(spark, sf_dir).select("id", ids.bucket(F.col("id"), 64).alias("bucket"))


@query(r"SELECT DISTINCT regexp_extract(url, '^(\w+://[^/?#]*)', 1) || '/' AS url, substring(regexp_replace(regexp_replace(lower(regexp_extract(url, '^(\w+://[^/?#]*)', 1) || '/'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) || '-' || substr(sha256(regexp_extract(url, '^(\w+://[^/?#]*)', 1) || '/'), 1, 8) AS site_id FROM pages")
def site_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = src.table(spark, sf_dir, "pages").select(F.concat(F.regexp_extract("url", r"^(\w+://[^/?#]*)", 1), F.lit("/")).alias("url")).distinct()
    return u.select("url", ids.site_id(F.col("url")).alias("site_id"))


def stored(spark: SparkSession, sf_dir: str) -> tuple[Store, str]:
    """The manuals as a stored site, in a folder of its own for each folder of tables."""
    docs = src.manuals(spark, sf_dir)
    edges = links.body_links(docs).select(F.col("src").alias("s"), F.col("dst").alias("t"), F.lit("ref").alias("k"))
    nodes = docs.select(F.col("id").alias("i"), F.col("chapter").alias("c"), F.col("title").alias("t"), F.col("url").alias("u"), F.lit(0).alias("g"), F.lit(0.0).alias("r"), F.lit(0).alias("w"))
    store = Store(spark, f"{shared_folder(spark)}/sites-{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}")
    report = graph.verdict(edges).crossJoin(F.broadcast(docs.agg(F.count("*").alias("docs"))))  # one row each
    with store.lock("parts"):
        store.save("parts", "https://parts.example/", nodes, edges, index.postings(index.term_freq(docs)), docs, report)
    return store, "parts"


_PARTS = rf"""{S.MANUALS}, x AS (SELECT id AS s, unnest(regexp_extract_all(body, '\[[^\]]*\]\(([^)\s#]+)', 1)) AS x FROM manuals),
y AS (SELECT DISTINCT s, regexp_replace(regexp_replace(replace(x, '/', '_'), '\.html$', ''), '\.md$', '') AS t FROM x), links AS MATERIALIZED (SELECT s, t FROM y WHERE t IN (SELECT id FROM manuals) AND s <> t)"""


@query(f"WITH {S.MANUALS} SELECT 'parts' AS site_id, 'https://parts.example/' AS url, count(*) AS docs, CASE WHEN count(*) < 128 THEN 1 WHEN count(*) < 1024 THEN 16 WHEN count(*) < 32768 THEN 64 ELSE 256 END::INT AS doc_buckets FROM manuals")
def list_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)[0].list_sites().select("site_id", "url", "docs", "doc_buckets")


@query(f"WITH {S.MANUALS} SELECT id, chapter, title, url, sha, body FROM manuals WHERE id = 'part_0000007'")
def get_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, site = stored(spark, sf_dir)
    return store.get_page(site, "part_0000007")


@query(f"WITH {_PARTS} SELECT id, count(*) AS degree FROM (SELECT s AS id FROM links UNION ALL SELECT t FROM links) GROUP BY id ORDER BY degree DESC, id LIMIT 5")
def site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, site = stored(spark, sf_dir)
    return store.site_stats(site)[1]


@query(f"""WITH {S.MANUALS}, {S.term_freq('manuals')}, {S.POSTINGS}, q AS (SELECT unnest(['crew-3', 'bin-7', 'crew-3', 'nothing']) AS term),
l AS (SELECT term, count(*) AS plen FROM post GROUP BY term),
z AS (SELECT id, round(sum(ln(1 + n / (1 + plen)::DOUBLE) * (1 + ln(tf))), 9) AS raw FROM q JOIN post USING (term) JOIN l USING (term), n GROUP BY id ORDER BY raw DESC, id LIMIT 10)
SELECT id, title, url, round(raw, 3) AS score FROM z JOIN manuals USING (id)""")
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, site = stored(spark, sf_dir)
    return store.search(site, "crew-3 bin-7 crew-3 nothing")


# -- events -------------------------------------------------------------------------------------------------


@query(f"""WITH {S.EVENTS}, k AS (SELECT seq, CASE WHEN t = 'node_added' AND row_number() OVER (PARTITION BY t, id ORDER BY seq) > 1 AND id IS NOT NULL THEN 'node_updated' ELSE t END AS t, id, s, d, kind,
  row_number() OVER (PARTITION BY t, s, d, kind ORDER BY seq) AS e FROM log) SELECT seq, t, id, s, d FROM k WHERE t <> 'edge_added' OR e = 1""")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.deduplicated(src.build_events(spark, sf_dir)).select("seq", "t", "id", "s", "d")


@query(f"WITH {S.EVENTS}, n AS (SELECT * FROM log WHERE t = 'node_added') SELECT id, max_by(title, seq) AS t, max_by(c, seq) AS c FROM n GROUP BY id")
def live_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.live_nodes(events.deduplicated(src.build_events(spark, sf_dir))).select("id", "t", "c")


@query(f"WITH {S.EVENTS} SELECT DISTINCT s, d, kind FROM log WHERE t = 'edge_added'")
def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.live_edges(src.build_events(spark, sf_dir))


@query(f"WITH {S.EVENTS}, known AS (SELECT id FROM log WHERE id IS NOT NULL AND NOT (id LIKE 'i%' AND substr(id, 2)::BIGINT % 3 = 0)) SELECT d AS target, count(*) AS n FROM (SELECT DISTINCT s, d, kind FROM log WHERE t = 'edge_added') WHERE d NOT IN (SELECT id FROM known) GROUP BY d")
def pending_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which every third item is never announced."""
    silent = F.col("id").startswith("i") & (F.substring("id", 2, 20).cast("long") % 3 == 0)
    return events.pending(src.build_events(spark, sf_dir).where(F.col("id").isNull() | ~silent))


@query(f"WITH {S.EVENTS} SELECT seq, t FROM log WHERE seq > 900")
def resume_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.since(src.build_events(spark, sf_dir), 900).select("seq", "t")


@query(f"WITH {S.EVENTS} SELECT count(DISTINCT id) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT s, d, kind FROM log WHERE t = 'edge_added')) AS edges, max(seq) AS last_seq FROM log")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.counters(src.build_events(spark, sf_dir))


@query(f"WITH {S.EVENTS}, b AS (SELECT id, min(seq) AS born FROM log WHERE t = 'node_added' GROUP BY id) SELECT seq, s, d, kind, CASE WHEN born < seq THEN 0 ELSE 1 END AS late FROM log LEFT JOIN b ON b.id = d WHERE t = 'edge_added'")
def late_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.late_edges(src.build_events(spark, sf_dir))


_KEPT = f"""{S.EVENTS}, k AS (SELECT seq, CASE WHEN t = 'node_added' AND row_number() OVER (PARTITION BY t, id ORDER BY seq) > 1 THEN 'node_updated' ELSE t END AS t, row_number() OVER (PARTITION BY t, s, d, kind ORDER BY seq) AS e FROM log),
u AS (SELECT seq, t, row_number() OVER (ORDER BY seq) AS i FROM k WHERE t <> 'edge_added' OR e = 1)"""


@query(f"WITH {_KEPT}, b AS (SELECT (i - 1) // 64 AS batch, min(seq) AS seq, count(*) FILTER (t = 'node_added') AS n_node, count(*) FILTER (t = 'edge_added') AS n_edge FROM u GROUP BY ALL) SELECT batch, seq, (sum(n_node) OVER w - n_node)::BIGINT AS node_start, (sum(n_edge) OVER w - n_edge)::BIGINT AS edge_start, n_node, n_edge FROM b WINDOW w AS (ORDER BY batch)")
def timeline_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.timeline(src.build_events(spark, sf_dir))


@query(f"WITH {_KEPT} SELECT i AS seq, t FROM u")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.renumbered(events.deduplicated(src.build_events(spark, sf_dir))).select("seq", "t")


@query(f"WITH {S.LINKS}, {S.LINK_NODES}, u AS (SELECT 0 AS p, id AS a, '' AS b, 'node_added' AS t FROM nodes UNION ALL SELECT 1, s, t, 'edge_added' FROM links) SELECT row_number() OVER (ORDER BY p, a, b) AS seq, t, CASE WHEN p = 0 THEN a END AS id, CASE WHEN p = 1 THEN a END AS s, CASE WHEN p = 1 THEN b END AS d FROM u")
def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = src.order_nodes(spark, sf_dir).select(F.col("id").alias("i"), "t", F.lit("").alias("u"), "c")
    return events.replay(n, src.order_links(spark, sf_dir)).select("seq", "t", "id", "s", "d")


@query("""WITH e AS (SELECT event_id + 1 AS seq, user_id AS v FROM events), n AS (SELECT v, (row_number() OVER (ORDER BY seq) - 1) // 64 AS batch FROM e), b AS (SELECT batch, max(v) AS v FROM n GROUP BY batch)
SELECT batch, max(v) OVER (ORDER BY batch) AS shown FROM b""")
def running_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a display that never goes back shows of a counter; the users' numbers stand for it."""
    e = src.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("pages"))
    return events.running_maxima(e, "pages")


# -- retrieval ---------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)) + 1e-12::DOUBLE), 9) AS score FROM v, q ORDER BY score DESC, id LIMIT 8""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()["embedding"]
    return retrieval.nearest(e.select(F.col("vec_id").alias("id"), "embedding"), q)


@query("""WITH w AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS o FROM part QUALIFY o <= 8), v AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS o FROM part QUALIFY o <= 8),
g AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS o FROM part QUALIFY o <= 6), k AS (SELECT id, min(o) AS o FROM (SELECT id, o FROM w UNION ALL SELECT id, o + 1000 FROM v) GROUP BY id ORDER BY 2 LIMIT 12),
a AS (SELECT id, min(o) AS o FROM (SELECT id, o FROM k UNION ALL SELECT id, o + 1000000 FROM g) GROUP BY id) SELECT id, row_number() OVER (ORDER BY o)::INT AS ord FROM a""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size")

    def best(n: int, *order):
        from pyspark.sql.window import Window

        return p.orderBy(*order).limit(n).select("id", F.row_number().over(Window.orderBy(*order)).alias("ord"))

    return retrieval.candidate_union(best(8, F.desc("p_retailprice"), "id"), best(8, F.desc("p_size"), "id"), best(6, "id"))


@query(f"""WITH {S.DOCS}, b AS (SELECT id, unnest(range(greatest(1, ceil(length(body) / 600.0)::BIGINT))) AS pos, body FROM docs), s AS (SELECT id, pos, substring(body, pos::BIGINT * 600 + 1, 600) AS block FROM b),
z AS (SELECT id, pos, block, length(block) - length(replace(block, 'e', '')) AS score FROM s),
r AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(length(block)) OVER (PARTITION BY id ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z WINDOW w AS (PARTITION BY id ORDER BY score DESC, pos))
SELECT id, substring(string_agg(block, chr(10) || '…' || chr(10) ORDER BY pos), 1, 3600) AS excerpt FROM r WHERE rn <= 6 AND before < 1800 GROUP BY id""")
def best_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = retrieval.blocks(src.documents(spark, sf_dir))
    return retrieval.best_excerpt(b.withColumn("score", F.length("block") - F.length(F.replace("block", F.lit("e"), F.lit("")))))


# -- windows ------------------------------------------------------------------------------------------------------


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM o WHERE i IN (SELECT floor(j * n / 300.0::DOUBLE)::BIGINT FROM range(300) t(j), (SELECT count(*) AS n FROM orders))")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 300 rows at even places."""
    return index.even_sample(src.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 300)


@query("SELECT l_suppkey, l_orderkey FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) <= 40")
def group_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(src.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct(), ["l_suppkey"], [F.col("l_orderkey")], DEFAULT.group_max)


@query("SELECT date_trunc('minute', ts) - INTERVAL (minute(ts) % 5) MINUTE AS begin, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the batch twin of the event-time windows."""
    e = src.table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "event_type", "n")

