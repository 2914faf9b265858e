"""Graph operators over nodes (id, ...) and edges (s, t, k)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.config import DEFAULT, DERIVED_KINDS, STRUCTURAL_KINDS, Config
from corpusgraph.operators.common import cut, small


def in_degree(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, g): edges of any kind that arrive."""
    n = edges.groupBy(F.col("t").alias("id")).agg(F.count("*").alias("g"))
    return ids.select("id").join(n, "id", "left").select("id", F.coalesce("g", F.lit(0)).alias("g"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("s", "t")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_degree(edges: DataFrame, n: int = 5) -> DataFrame:
    return degree(edges).orderBy(F.desc("degree"), "id").limit(n)


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("k").agg(F.count("*").alias("n"))


def verdict(edges: DataFrame) -> DataFrame:
    """One row: READY if there is a resolved link or import, else NOT-READY, and why."""
    n = edges.agg(F.count_if(F.col("k").isin(*STRUCTURAL_KINDS)).alias("n"), F.count("*").alias("edges"))
    ready = F.col("n") > 0
    note = F.when(ready, F.concat(F.col("n").cast("string"), F.lit(" resolved links"))).otherwise("no resolved links: the graph can't be walked")
    return n.select(F.when(ready, "READY").otherwise("NOT-READY").alias("verdict"), note.alias("note"), "edges")


def pagerank(ids: DataFrame, edges: DataFrame, cfg: Config = DEFAULT, every: int = 5) -> DataFrame:
    """(id, r) after a fixed number of rounds; ranks of nodes without links out are spread over all.

    Nodes and links are dealt by id and source once and kept so; a round moves nothing but the shares that arrive, summed
    on the map side first.  A lost executor's part of what is kept is computed again, from a reliable checkpoint a few
    rounds back at most.  An edge whose target is unknown passes its share on to nobody; a repeated id is one node.
    """
    out = edges.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("out"))
    node = cut(ids.select("id").distinct().join(out, "id", "left")).repartition("id").persist()
    link = edges.select(F.col("s").alias("id"), "t").repartition("id").persist()
    n = node.count()
    d = cfg.damping
    rank = node.withColumn("r", F.lit(1.0 / max(n, 1)))
    kept: list[DataFrame] = []
    for i in range(cfg.iterations):
        loose = rank.where("out IS NULL").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("loose")).first()["loose"]
        share = rank.where("out IS NOT NULL").select("id", (F.col("r") * d / F.col("out")).alias("share"))
        got = link.join(share, "id").groupBy(F.col("t").alias("id")).agg(F.sum("share").alias("got"))
        rank = node.join(got, "id", "left").select("id", "out", (F.lit((1 - d) / max(n, 1) + loose * d / max(n, 1)) + F.coalesce("got", F.lit(0.0))).alias("r"))
        if (i + 1) % every == 0 or i + 1 == cfg.iterations:
            rank = cut(rank)
            for x in kept:
                x.unpersist()
            kept = []
        else:
            rank = rank.persist()
            kept.append(rank)
    node.unpersist()
    link.unpersist()
    return rank.select("id", F.round("r", 6).alias("r"))


def neighbours(edges: DataFrame, centre: str, depth: int = 1) -> DataFrame:
    """(id, hop) of what is within ``depth`` (at most 2) steps of ``centre``, in either direction.

    Only links of the nodes last found are looked at, in both directions; no table of all links turned round is made.
    """
    seen = edges.sparkSession.createDataFrame([(centre, 0)], "id string, hop int")
    front = seen
    for hop in range(1, min(depth, 2) + 1):
        near = small(front.select(F.col("id").alias("at")))
        out = edges.join(near, F.col("s") == F.col("at"), "left_semi").select(F.col("t").alias("id"))
        back = edges.join(near, F.col("t") == F.col("at"), "left_semi").select(F.col("s").alias("id"))
        front = cut(out.union(back).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    keep = small(ids.select("id").distinct())
    return edges.join(keep.withColumnRenamed("id", "s"), "s", "left_semi").join(keep.withColumnRenamed("id", "t"), "t", "left_semi").select("s", "t", "k")


def trim(nodes: DataFrame, n: int) -> DataFrame:
    """The best ``n`` nodes by in-degree, rank and id."""
    return nodes.orderBy(F.desc("g"), F.desc("r"), "id").limit(n)


def title_search(nodes: DataFrame, query: str, n: int = 8) -> DataFrame:
    """Nodes (id, t, g) whose title has the query in it, most linked first; a query of one letter finds nothing."""
    return nodes.where(F.contains(F.lower("t"), F.lit(query.lower())) & F.lit(len(query) >= 2)).orderBy(F.desc("g"), "id").limit(n)


# Weight of a rank beside a degree in the order of labels, and how many nodes and edges a sketch shows.
RANK_WEIGHT, SKETCH_NODES, SKETCH_EDGES = 400, 5000, 20_000


def label_rank(nodes: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` nodes (id, degree, r) that get a label first: by degree and weighted rank, ties by id."""
    score = F.col("degree") + F.col("r") * RANK_WEIGHT
    return nodes.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(budget)


def stride_sample(nodes: DataFrame, edges: DataFrame, most: int = SKETCH_NODES, most_edges: int = SKETCH_EDGES) -> tuple[DataFrame, DataFrame]:
    """Every k-th node in the order of ids, k the smallest step with at most ``most`` of them, and the edges among them,
    the first ``most_edges`` in the order of both ends: a sketch of a graph that is too large to show."""
    from corpusgraph.operators.index import numbered

    placed = numbered(nodes.select("id"), "id")
    shown = cut(placed.where(F.col("__i") % F.ceil(F.greatest(F.col("__n"), F.lit(1)) / most) == 0).select("id"))
    return shown, induced(edges, shown).orderBy("s", "t", "k").limit(most_edges)


# Weights of nodes and edges near the focus and away from it.
NODE_DIM, EDGE_DIM = (1.2, 0.07), (1.7, 0.035)


def in_focus(nodes: DataFrame, edges: DataFrame, centre: str, hidden_kinds: tuple[str, ...] = DERIVED_KINDS) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ...) with ``near``, whether they are the centre or next to it by an edge of a shown kind, and how far
    they are dimmed; edges with their dim.  Derived kinds are hidden unless told."""
    shown = edges.where(~F.col("k").isin(*hidden_kinds)) if hidden_kinds else edges
    near = cut(neighbours(shown, centre, 1).select("id", F.lit(True).alias("near")))
    marked = nodes.join(small(near), "id", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    dim = lambda weights, on: F.when(on, F.lit(weights[0])).otherwise(F.lit(weights[1])).alias("dim")
    at = (F.col("s") == centre) | (F.col("t") == centre)
    return marked.select("*", dim(NODE_DIM, F.col("near"))), shown.select("s", "t", "k", dim(EDGE_DIM, at))


def visible(nodes: DataFrame, edges: DataFrame, chapters: list[str] | None = None, query: str = "", hidden_kinds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, c, t) and edges that a view shows: chapter and title filters; an edge needs both ends and a shown kind."""
    keep = F.lit(True)
    if chapters is not None:
        keep = keep & F.col("c").isin(*chapters)
    if query:
        keep = keep & F.contains(F.lower("t"), F.lit(query.lower()))
    shown = nodes.where(keep)
    return shown, induced(edges.where(~F.col("k").isin(*hidden_kinds)) if hidden_kinds else edges, shown)


def centroids(layout: DataFrame) -> DataFrame:
    """Mean place of each chapter of (id, c, x, y, z)."""
    return layout.groupBy("c").agg(*[F.round(F.avg(a), 6).alias(a) for a in ("x", "y", "z")], F.count("*").alias("n"))


def reach(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of breadth-first search over links (s, t) from seeds (id), a frontier join a level."""
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        step = links.join(front.select(F.col("id").alias("s")), "s").select(F.col("t").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def classify_hubs(links: DataFrame) -> DataFrame:
    """Kind of a link by its source: ``index`` a hub, ``*_index`` contains, else ref."""
    k = F.when(F.col("s") == "index", "hub").when(F.col("s").endswith("_index"), "contains").otherwise("ref")
    return links.select("s", "t", k.alias("k"))
