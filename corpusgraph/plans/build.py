"""From documents and evidence to the graph: relations, claims, index, rank and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.config import DEFAULT, Config, resolve_mode
from corpusgraph.functions import text as T
from corpusgraph.operators import claims, graph, index, relations
from corpusgraph.operators.common import cut, delete, union, written
from corpusgraph.operators.profile import narrowed, profiles, selected


@dataclass(frozen=True)
class Graph:
    """The tables of a built site; all are lazy but for the profiles and the evidence, which many passes use.

    The profiles are a table in the shared folder, of which each pass reads the columns it needs; ``release`` deletes it
    when the graph's tables are stored.
    """

    nodes: DataFrame
    edges: DataFrame
    derived: DataFrame
    postings: DataFrame
    report: DataFrame
    notes: tuple[str, ...]
    where: str = ""

    def release(self) -> None:
        if self.where:
            delete(self.nodes.sparkSession, self.where)


def derived_edges(profile: DataFrame, evidence: DataFrame, enabled: tuple[str, ...], cfg: Config = DEFAULT, heavy_ok: bool = True, entities: DataFrame | None = None, vectors: DataFrame | None = None, picks: DataFrame | None = None) -> DataFrame:
    """Admitted edges (s, t, k) of the enabled kinds.  ``picks`` (id, dims) may narrow a document's gate, never widen it."""
    passes = {
        "duplicate_of": lambda: relations.duplicate_of(profile),
        "coupled_with": lambda: relations.coupled_with(evidence, cfg),
        "co_cited_with": lambda: relations.co_cited_with(evidence, cfg),
        "mentions_symbol": lambda: relations.mentions_symbol(profile, cfg) if heavy_ok else None,
        "similar_to": lambda: relations.similar_to(profile, cfg) if heavy_ok else None,
        "sibling_of": lambda: relations.sibling_of(profile, cfg),
        "supersedes": lambda: relations.supersedes(profile),
        "shares_heading": lambda: relations.shares_heading(profile, cfg),
        "shares_term": lambda: relations.shares_term(profile, cfg),
        "shares_entity": lambda: relations.shares_entity(entities, cfg=cfg) if entities is not None else None,
        "semantic_similar": lambda: relations.semantic_similar(vectors, cfg) if vectors is not None else None,
    }
    found = [e for k in enabled if (e := passes[k]()) is not None]
    if not found:
        return evidence.limit(0).select("s", "t", "k")
    gates = profile.select("id", selected(enabled, heavy_ok, cfg).alias("dims"))
    if picks is not None:
        gates = narrowed(gates, picks)
    return claims.claims(union(found), evidence, gates)


def build_graph(docs: DataFrame, evidence: DataFrame, relations_mode: str | None = "auto", cfg: Config = DEFAULT, **models: DataFrame | None) -> Graph:
    """Build the graph of docs (id, chapter, title, url, sha, body) with evidence edges (s, t, k)."""
    enabled, notes = resolve_mode(relations_mode), []
    heavy_ok = True
    if cfg.heavy_docs is not None and docs.count() > cfg.heavy_docs:
        heavy_ok = False
        notes.append(f"mentions_symbol and similar_to skipped: over {cfg.heavy_docs} documents")
    notes += [f"{k} skipped: no {v}" for k, v in (("shares_entity", "entities"), ("semantic_similar", "vectors")) if k in enabled and models.get(v) is None]
    profile, where = written(profiles(docs, cfg))
    sure = cut(claims.evidence_first(evidence, docs))
    derived = cut(derived_edges(profile, sure, enabled, cfg, heavy_ok, **models))
    edges = sure.select("s", "t", "k").union(derived)
    rank, degree = graph.pagerank(profile, edges, cfg), graph.in_degree(profile, edges)
    words = profile.select("id", F.col("chapter").alias("c"), F.col("title").alias("t"), F.col("url").alias("u"), T.word_count(F.col("prose")).alias("w"))
    nodes = words.join(degree, "id").join(rank, "id").select(F.col("id").alias("i"), "c", "t", "u", F.col("g").cast("int").alias("g"), "r", "w")
    posting = index.postings(index.term_freq(docs, cfg), cfg)
    kinds = graph.edge_type_counts(edges).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("edge_types"))
    report = (
        graph.verdict(edges).crossJoin(F.broadcast(docs.agg(F.count("*").alias("docs")))).crossJoin(F.broadcast(kinds))
        .crossJoin(F.broadcast(posting.agg(F.count_distinct("term").alias("terms")))).withColumn("relation_mode", F.lit(relations_mode or "auto"))
    )
    return Graph(nodes, edges, derived, posting, report, tuple(notes), where)
