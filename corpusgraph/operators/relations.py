"""Derived relations: one function per kind, each returning edges (s, t, k)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.config import DEFAULT, STRUCTURAL_KINDS, SYMBOL_STOP, Config
from corpusgraph.functions import text as T
from corpusgraph.operators.common import cut, df_ceiling, following, idf, nominated, pairs, small, top, with_count
from corpusgraph.operators.index import numbered
from corpusgraph.operators.profile import terms


def duplicate_of(docs: DataFrame) -> DataFrame:
    """Chain of the sorted ids with one non-empty sha."""
    return following(docs.where("sha <> ''"), "sha", []).select(F.col("id").alias("s"), F.col("next").alias("t"), F.lit("duplicate_of").alias("k"))


def sibling_of(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All pairs of a directory with few enough members."""
    few = profile.where(F.col("dir").isNotNull() & F.col("n_siblings").between(cfg.sibling_min, cfg.sibling_max)).select("id", "dir")
    return pairs(few, "dir").select(F.col("a").alias("s"), F.col("b").alias("t"), F.lit("sibling_of").alias("k"))


def supersedes(profile: DataFrame) -> DataFrame:
    """Each version of a family over the one before it; equal versions in (chapter, id) order."""
    fam = profile.where(F.col("version").isNotNull() & (F.length("base") >= 4))
    order = [F.col("version"), F.col("chapter"), F.concat("id", F.lit(".md"))]
    return following(fam, "base", order).select(F.col("next").alias("s"), F.col("id").alias("t"), F.lit("supersedes").alias("k"))


def signatures(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(id, term, w, in_body, norm): the heaviest tf-idf terms of each document with enough prose; titles count twice.

    Ties go to the larger term.  df counts documents with the term in body or title.
    """
    cand = with_count(profile.where(F.col("prose_len") >= cfg.min_prose).select("id", "title", "prose"))
    body = cand.select("id", "n_all", F.explode(T.tokens(F.col("prose"), cfg.similar_chars)).alias("term"), F.lit(1).alias("tf"), F.lit(1).alias("b"))
    title = cand.select("id", "n_all", F.explode(T.tokens(F.col("title"), 1_000_000)).alias("term"), F.lit(2).alias("tf"), F.lit(0).alias("b"))
    tf = body.union(title).groupBy("id", "n_all", "term").agg(F.sum("tf").alias("tf"), F.max("b").alias("in_body"))
    df = tf.groupBy("term", "n_all").agg(F.count("*").alias("df"))
    df = df.where((F.col("df") >= cfg.df_min) & (F.col("df") <= df_ceiling(F.col("n_all"), 3, cfg.df_ratio)))
    w = tf.join(df.drop("n_all"), "term").select("id", "term", "in_body", F.round(F.col("tf") * idf(F.col("n_all"), F.col("df")), 9).alias("w"))
    sig = top(w, ["id"], [F.desc("w"), F.desc("term")], cfg.signature_terms)
    return sig.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))


def similar_to(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Cosine of signatures, with a term of the bodies in common."""
    post = top(signatures(profile, cfg), ["term"], [F.desc("w"), F.col("id")], cfg.similar_postings)
    met = pairs(post, "term", "w", "norm", "in_body").groupBy("a", "b").agg(
        F.round(F.sum(F.col("w_a") * F.col("w_b") / (F.col("norm_a") * F.col("norm_b"))), 9).alias("score"), F.max(F.col("in_body_a") * F.col("in_body_b")).alias("body")
    )
    return nominated(met.where((F.col("score") >= cfg.similar_from) & (F.col("body") == 1)), cfg.similar_cap, "similar_to")


def shares_heading(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Overlap of heading sets; headings of too many documents count in the union only."""
    cand = with_count(profile.where(F.size("headings") >= cfg.heading_min).select("id", "headings"))
    each = cand.select("id", "n_all", F.explode("headings").alias("heading"))
    df = each.groupBy("heading", "n_all").agg(F.count("*").alias("df"))
    df = df.where((F.col("df") >= 2) & (F.col("df") <= df_ceiling(F.col("n_all"), cfg.heading_df_floor, cfg.df_ratio))).select("heading")
    post = top(each.select("id", "heading").join(df, "heading"), ["heading"], [F.col("id")], cfg.heading_postings)
    met = pairs(post, "heading").groupBy("a", "b").agg(F.count("*").alias("n"))
    heads = cand.select("id", "headings")
    full = met.join(heads.select(F.col("id").alias("a"), F.col("headings").alias("ha")), "a").join(heads.select(F.col("id").alias("b"), F.col("headings").alias("hb")), "b")
    scored = full.select("a", "b", F.round(F.col("n") / F.size(F.array_union("ha", "hb")), 9).alias("score"))
    return nominated(scored.where(F.col("score") >= cfg.heading_overlap), cfg.heading_cap, "shares_heading")


def shares_term(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Curated terms in common, ranked by their summed idf."""
    cand = with_count(profile.where("n_terms > 0").select("id"))
    each = terms(profile).join(cand, "id")
    df = each.groupBy("term", "n_all").agg(F.count("*").alias("df"))
    df = df.where((F.col("df") >= cfg.df_min) & (F.col("df") <= df_ceiling(F.col("n_all"), 3, cfg.df_ratio)))
    w = each.join(df.drop("n_all"), "term").select("id", "term", F.round(idf(F.col("n_all"), F.col("df")), 9).alias("idf"), "w")
    w = w.withColumn("weight", F.round(F.col("w") * F.col("idf"), 9))
    sig = top(w, ["id"], [F.desc("weight"), F.col("term")], cfg.term_signature)
    post = top(sig, ["term"], [F.desc("weight"), F.col("id")], cfg.term_postings)
    met = pairs(post, "term", "idf").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.sum("idf_a"), 9).alias("score"))
    return nominated(met.where((F.col("n") >= cfg.term_min) & (F.col("score") >= cfg.term_weight)), cfg.term_cap, "shares_term")


def unique_owners(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(symbol, owner) of symbols that exactly one source file declares."""
    each = profile.where("is_code").select("id", F.explode("symbols").alias("symbol")).where((F.length("symbol") >= cfg.symbol_min_len) & ~F.lower("symbol").isin(*SYMBOL_STOP))
    return each.groupBy("symbol").agg(F.count_distinct("id").alias("n"), F.min("id").alias("owner")).where("n = 1").drop("n")


def mentions_symbol(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """From a source file to the only owner of an identifier in it; the best few symbols of a file."""
    code = profile.where("is_code")
    used = code.select("id", "title", "symbols", F.explode(F.regexp_extract_all("body", F.lit(T.IDENTIFIER), 0)).alias("symbol"))
    used = used.where(~F.array_contains("symbols", F.col("symbol"))).groupBy("id", "title", "symbol").agg(F.count("*").alias("n"))
    hit = used.join(unique_owners(code, cfg), "symbol").where("owner <> id")
    score = F.col("n") + F.when(F.contains(F.lower("title"), F.lower("symbol")), cfg.symbol_title_bonus).otherwise(0)
    best = top(hit.withColumn("score", score), ["id"], [F.desc("score"), F.col("symbol")], cfg.symbol_cap)
    return best.select(F.col("id").alias("s"), F.col("owner").alias("t"), F.lit("mentions_symbol").alias("k")).distinct()


def _overlap(links: DataFrame, member: str, shared: str, kind: str, cfg: Config) -> DataFrame:
    """Members with shared neighbours in links (s, t, k); a neighbour z weighs 1 / max(2, its links in and out).

    A page with more than ``hub_out_max`` links out is a table of contents and no member.  Of a neighbour's members the
    lowest ids count, so one hub's pairs are bounded.
    """
    use = links.where(F.col("k").isin(*STRUCTURAL_KINDS)).select("s", "t").where("s <> t").distinct()
    busy = use.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > cfg.hub_out_max).select("id")
    degree = use.select(F.explode(F.array("s", "t")).alias("z")).groupBy("z").agg(F.count("*").alias("deg"))
    each = use.select(F.col(member).alias("id"), F.col(shared).alias("z")).join(busy, "id", "left_anti")
    group = top(each, ["z"], [F.col("id")], cfg.group_max).join(degree, "z")
    met = pairs(group, "z", "deg").groupBy("a", "b").agg(F.round(F.sum(1 / F.greatest(F.lit(2), F.col("deg_a"))), 9).alias("score"))
    return nominated(met.where(F.col("score") >= cfg.couple_from), cfg.couple_cap, kind)


def coupled_with(links: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Bibliographic coupling: sources that cite the same targets."""
    return _overlap(links, "s", "t", "coupled_with", cfg)


def co_cited_with(links: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Co-citation: targets that the same sources cite."""
    return _overlap(links, "t", "s", "co_cited_with", cfg)


#: Entities of the lists in a block: two blocks are what a task holds.  Entities in common that are counted at once.
BLOCK_ENTITIES, COUNTED = 1 << 20, 1 << 21


def shares_entity(entities: DataFrame, pages: int | None = None, cfg: Config = DEFAULT, block: int = BLOCK_ENTITIES) -> DataFrame:
    """Entities (id, entity) in common, two at least; ``pages`` is the number of pages asked for entities.

    Documents of the same entities are one class, which knows its lowest ids; classes are numbered in the order of their
    lowest one.  They are dealt to blocks of about ``block`` entities, and each pair of blocks is one task, which counts
    what each two classes have in common and hands on the best few of a class in the other block.  Pairs of documents are
    never written: a document names the best few ids of its class's own and of the best classes.
    """
    cap = cfg.entity_cap
    each = entities.select("id", T.fold(F.col("entity")).alias("entity")).where("entity <> ''").distinct()
    n = F.lit(pages) if pages is not None else None
    each = each.crossJoin(F.broadcast(each.agg(F.count_distinct("id").alias("n_all")))) if n is None else each.withColumn("n_all", n)
    df = each.groupBy("entity", "n_all").agg(F.count("*").alias("df"))
    df = df.where((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("n_all") * F.lit(0.3)).cast("int")))).select("entity")
    df = cut(df.withColumn("e", F.monotonically_increasing_id()))
    lists = each.where("id IS NOT NULL").select("id", "entity").join(df, "entity").groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("es"))
    lists = cut(lists.where(F.size("es") >= 2))
    low = cut(numbered(lists.groupBy("es").agg(F.min("id").alias("id")), "id").select("es", F.col("__i").alias("c"), F.size("es").alias("size")))
    member = cut(lists.join(low, "es").select("id", "c", "size"))
    first = top(member, ["c"], [F.col("id")], cap + 1)  # one more than are named, as a document doesn't name itself

    best = cut(_best_classes(low, cap, block))
    score = best.select("c", F.col("other").alias("of"), "score").union(low.select("c", F.col("c").alias("of"), F.col("size").cast("long").alias("score")))
    named = top(score.join(first.select(F.col("c").alias("of"), F.col("id").alias("b")), "of"), ["c"], [F.desc("score"), F.col("b")], cap + 1)
    asked = named.groupBy("c").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), "b"))).alias("best"))
    out = member.join(asked, "c").select(F.col("id").alias("s"), F.explode(F.slice(F.filter("best", lambda x: x["b"] != F.col("id")), 1, cap)).alias("x"))
    return out.select("s", F.col("x.b").alias("t"), F.lit("shares_entity").alias("k")).where("s < t")


def _best_classes(low: DataFrame, cap: int, block: int) -> DataFrame:
    """(c, other, score): for each class (c, es) the ``cap`` + 1 others with most entities in common, two at least; ties by number."""
    blocks = max(1, -(-(low.agg(F.sum("size").alias("n")).first()["n"] or 0) // block))
    x = low.select("c", "es", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("own"))
    dealt = x.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("own", "to"), "j": F.greatest("own", "to")}).drop("to")
    keep = cap + 1

    def side(rows: pa.Table, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of a block's classes, and place of the class and entity of each entry."""
        mine = rows.filter(pc.equal(rows["own"], own)).combine_chunks()
        sizes = pc.list_value_length(mine["es"]).to_numpy()
        return mine["c"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(mine["es"]).to_numpy()

    def nearest(left: tuple, right: tuple) -> Iterator[np.ndarray]:
        (cl, at, entity), (cr, to, other) = left, right
        order = np.argsort(other, kind="stable")
        other, to = other[order], to[order]
        lo, hi = np.searchsorted(other, entity, "left"), np.searchsorted(other, entity, "right")
        ends = np.searchsorted(at, np.arange(len(cl) + 1))  # entries of each class
        work = np.concatenate([[0], np.cumsum(hi - lo)])[ends]
        a = 0
        while a < len(cl):
            b = max(a + 1, int(np.searchsorted(work, work[a] + COUNTED, "right")) - 1)
            part = slice(ends[a], ends[b])
            many = hi[part] - lo[part]
            total = int(many.sum())
            place = np.arange(total) + np.repeat(lo[part] - (np.cumsum(many) - many), many)
            key, n = np.unique(np.repeat(at[part], many) * len(cr) + to[place], return_counts=True)
            key, n = key[n >= 2], n[n >= 2]
            x, y = key // max(1, len(cr)), cr[key % max(1, len(cr))]
            x, y, n = (v[cl[x] != y] for v in (x, y, n))
            order = np.lexsort((y, -n, x))
            x, y, n = x[order], y[order], n[order]
            yes = np.arange(len(x)) - np.searchsorted(x, x) < keep
            yield np.stack([cl[x[yes]], y[yes], n[yes]])
            a = b

    def best(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        one, two = side(rows, i), side(rows, j)
        found = np.concatenate([np.zeros((3, 0), np.int64), *nearest(one, two), *(nearest(two, one) if i != j else ())], axis=1)
        return pa.table({"c": found[0], "other": found[1], "score": found[2]})

    met = dealt.groupBy("i", "j").applyInArrow(best, "c long, other long, score long")
    return top(met, ["c"], [F.desc("score"), F.col("other")], keep)


#: Vectors of a block: two blocks of so many rows and their products are all that a task holds.
BLOCK_VECTORS = 4096


def semantic_similar(vectors: DataFrame, cfg: Config = DEFAULT, block: int = BLOCK_VECTORS) -> DataFrame:
    """Cosine of embeddings (id, embedding), thresholded before the cap.

    Every pair is needed.  Vectors are dealt to blocks of about ``block`` rows, as many as their number asks for, and each
    pair of blocks is one product of matrices in one task.  A vector's best few of a block are all that the best few of
    all blocks can come from, so that a task hands on a bounded number of rows for each vector.  Vectors of different
    lengths, and those with nulls, meet nobody.
    """
    cap, least = cfg.embed_cap, cfg.embed_from
    id_type = vectors.schema["id"].dataType.simpleString()
    x = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding")).where(~F.exists("embedding", lambda v: v.isNull()))
    blocks = max(1, -(-x.count() // block))
    x = x.select("id", "embedding", F.size("embedding").alias("size"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    # block pair (i, j), i <= j, gets the rows of both
    dealt = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def best(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        own, ids = rows["own"].to_numpy(), rows["id"].to_pylist()
        m = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), rows["size"][0].as_py())
        norm = np.sqrt((m * m).sum(1))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        score = np.round((m[left] @ m[right].T) / (np.outer(norm[left], norm[right]) + 1e-12), 9)
        if i == j:
            np.fill_diagonal(score, -np.inf)
        out: set[tuple[int, int]] = set()
        for s, of, to in ((score, left, right), (score.T, right, left)):
            for a, line in zip(of.tolist(), s, strict=True):
                near = np.flatnonzero(line >= least)
                if len(near) > cap:  # all that are as good as the last one that counts: ids decide later
                    near = near[line[near] >= np.partition(line[near], -cap)[-cap]]
                out.update((min(a, b), max(a, b)) for b in to[near].tolist())
        pairs_ = sorted(out)
        at = {r: k for k, r in enumerate(left.tolist())}, {r: k for k, r in enumerate(right.tolist())}
        value = [float(score[at[0][a], at[1][b]] if a in at[0] and b in at[1] else score[at[0][b], at[1][a]]) for a, b in pairs_]
        kind = rows["id"].type
        return pa.table({"a": pa.array([ids[a] for a, _ in pairs_], kind), "b": pa.array([ids[b] for _, b in pairs_], kind), "score": pa.array(value, pa.float64())})

    met = dealt.groupBy("size", "i", "j").applyInArrow(best, f"a {id_type}, b {id_type}, score double")
    ordered = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct()
    return nominated(ordered, cap, "semantic_similar")


def directory_hubs(files: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``contains`` edges of README and index files (id, dir, stem) to their directory's other files, the lowest ids first."""
    hub = files.where(F.lower("stem").isin("readme", "index")).select(F.col("id").alias("s"), "dir")
    met = files.select(F.col("id").alias("t"), "dir").join(small(hub), "dir").where("s <> t")
    return top(met, ["s"], [F.col("t")], cfg.hub_members).select("s", "t", F.lit("contains").alias("k"))
