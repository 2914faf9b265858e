"""Profiles of documents and the gate of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.config import DEFAULT, KEYLESS_KINDS, Config
from corpusgraph.functions import text as T
from corpusgraph.operators.common import cut, small


def profiles(docs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per doc (id, chapter, title, url, sha, body) with the signals that relations are built from."""
    body, url, id_ = (F.coalesce(F.col(c), F.lit("")) for c in ("body", "url", "id"))
    p = docs.select(
        "id", "chapter", F.coalesce("title", F.lit("")).alias("title"), url.alias("url"), F.coalesce("sha", F.lit("")).alias("sha"), body.alias("body"),
        T.strip_prose(body).alias("prose"), T.is_code(body, cfg.symbol_chars).alias("is_code"), T.code_header(body, 2).alias("lang"),
        T.symbols(body, cfg.symbol_chars).alias("symbols"), T.headings(body).alias("headings"), T.curated_terms(body).alias("code_spans"),
        T.dir_key(body, url).alias("dir"), T.version(id_, url).alias("version"), T.base_key(id_, url).alias("base"),
    )
    # members of a folder are counted on its name alone; a folder of any size is one number, and no folder is no group
    mates = cut(docs.select(T.dir_key(body, url).alias("dir")).where("dir IS NOT NULL").groupBy("dir").agg((F.count("*") - 1).cast("int").alias("n_siblings")))
    n_terms = F.size(F.array_distinct(F.concat("code_spans", "headings", F.filter(F.transform("symbols", T.fold), lambda t: F.length(t) >= 2))))
    return p.withColumns({"prose_len": F.length(T.strip(F.col("prose"))), "digest": T.digest(F.col("prose"), 200), "n_terms": n_terms}).join(small(mates), "dir", "left").withColumn("n_siblings", F.coalesce("n_siblings", F.lit(0)))


def selected(enabled: tuple[str, ...] = KEYLESS_KINDS, heavy_ok: bool = True, cfg: Config = DEFAULT) -> Column:
    """Array of the dimensions that apply to a profile row."""
    gates = {
        "mentions_symbol": F.lit(heavy_ok) & F.col("is_code"),
        "similar_to": F.lit(heavy_ok) & (F.col("prose_len") >= cfg.min_prose),
        "sibling_of": F.col("n_siblings").between(cfg.sibling_min, cfg.sibling_max),
        "supersedes": F.col("version").isNotNull() & (F.length("base") >= 4),
        "shares_heading": F.size("headings") >= cfg.heading_min,
        "shares_term": F.col("n_terms") >= cfg.term_min,
        "shares_entity": F.col("prose_len") >= cfg.min_prose_entities,
        "semantic_similar": F.col("prose_len") >= cfg.min_prose,
    }
    return F.array_compact(F.array(*[F.when(g, F.lit(k)) for k, g in gates.items() if k in enabled])) if any(k in enabled for k in gates) else F.array().cast("array<string>")


def terms(profile: DataFrame) -> DataFrame:
    """(id, term, w): inline code spans 3 each, headings 2, symbols 2 each."""
    spans = profile.select("id", F.explode("code_spans").alias("term"), F.lit(3).alias("w"))
    heads = profile.select("id", F.explode("headings").alias("term"), F.lit(2).alias("w"))
    syms = profile.select("id", F.explode(F.transform("symbols", T.fold)).alias("term"), F.lit(2).alias("w")).where(F.length("term") >= 2)
    return spans.union(heads).union(syms).groupBy("id", "term").agg(F.sum("w").cast("int").alias("w"))


def narrowed(gates: DataFrame, picks: DataFrame) -> DataFrame:
    """``gates`` (id, dims) cut down to what picks (id, dims) name: a pick may narrow a document's gate, never widen it."""
    both = gates.join(picks.select("id", F.col("dims").alias("p")), "id", "left")
    return both.select("id", F.when(F.col("p").isNull(), F.col("dims")).otherwise(F.array_intersect("dims", "p")).alias("dims"))
