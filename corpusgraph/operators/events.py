"""The build's event log: de-duplication, folding to the live state, and the timeline; batch twins of the streams.

Events are rows (seq long, t, id, title, url, c, s, d, kind, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.operators.index import numbered



def _kind():
    return F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("ref"))


def deduplicated(events: DataFrame) -> DataFrame:
    """The log as it is kept: a second node_added becomes node_updated, a second edge disappears.

    Sequence numbers are those of the source; ``renumbered`` closes the gaps that dropped edges leave.
    """
    first = F.row_number().over(Window.partitionBy("t", F.coalesce("id", F.lit("")), F.coalesce("s", F.lit("")), F.coalesce("d", F.lit("")), _kind()).orderBy("seq"))
    node_first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    nodes = events.where("t = 'node_added'").withColumn("t", F.when(node_first == 1, "node_added").otherwise("node_updated"))
    edges = events.where("t = 'edge_added'").withColumn("__n", first).where("__n = 1").drop("__n")
    return nodes.unionByName(edges).unionByName(events.where(~F.col("t").isin("node_added", "edge_added")))


def renumbered(events: DataFrame) -> DataFrame:
    """``seq`` from 1 without gaps, in order; numbered by ranges, so no task sorts the whole log."""
    return numbered(events, "seq").withColumn("seq", (F.col("__i") + 1).cast("long")).drop("__i", "__n")


def since(events: DataFrame, seq: int) -> DataFrame:
    """What a consumer that has seen ``seq`` still has to get."""
    return events.where(F.col("seq") > seq)


def live_nodes(log: DataFrame) -> DataFrame:
    """(id, t, c, u, g, r) of each node: node_added sets the row, node_updated changes the fields it carries."""
    rows = log.where(F.col("t").isin("node_added", "node_updated"))
    added = rows.where("t = 'node_added'").groupBy("id").agg(F.max("seq").alias("from_seq"))
    use = rows.join(added, "id", "left").where("from_seq IS NULL OR seq >= from_seq")
    last = lambda c, name: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(name)
    have = [(a, b) for a, b in (("title", "t"), ("c", "c"), ("url", "u"), ("g", "g"), ("r", "r")) if a in log.columns]
    return use.groupBy("id").agg(*[last(a, b) for a, b in have])


def live_edges(log: DataFrame) -> DataFrame:
    """(s, d, kind) of each edge once."""
    return log.where("t = 'edge_added'").select("s", "d", _kind().alias("kind")).distinct()


def pending(log: DataFrame) -> DataFrame:
    """(target, n): edges that point at a node that never came; their number is ``dangling``."""
    nodes = log.where(F.col("t").isin("node_added", "node_updated")).select(F.col("id").alias("d")).distinct()
    return live_edges(log).join(nodes, "d", "left_anti").groupBy(F.col("d").alias("target")).agg(F.count("*").alias("n"))


def counters(log: DataFrame) -> DataFrame:
    """One row: different nodes and edges, and the last sequence number."""
    return log.agg(
        F.count_distinct(F.when(F.col("t").isin("node_added", "node_updated"), F.col("id"))).alias("nodes"),
        F.count_distinct(F.when(F.col("t") == "edge_added", F.struct("s", "d", _kind()))).alias("edges"),
        F.max("seq").alias("last_seq"),
    )


def running_maxima(log: DataFrame, value: str, batch: int = 64) -> DataFrame:
    """(batch, shown) of a log with a counter ``value`` that may fall back: what a display that never goes back shows
    after each ``batch`` events.

    Maxima go up by blocks of batches, so no task sees the whole log.
    """
    each = numbered(log.select("seq", F.col(value).alias("v")), "seq").withColumn("batch", F.floor(F.col("__i") / batch)).groupBy("batch").agg(F.max("v").alias("v"))
    each = each.withColumn("block", F.floor(F.col("batch") / 1024))
    block = each.groupBy("block").agg(F.max("v").alias("v")).select("block", F.max("v").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = Window.partitionBy("block").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return each.join(F.broadcast(block), "block").select("batch", F.greatest(F.max("v").over(inside), "before").alias("shown"))


def late_edges(log: DataFrame) -> DataFrame:
    """Edges with ``late`` = 1 where the target was announced after the edge, or never."""
    born = log.where("t = 'node_added'").groupBy(F.col("id").alias("d")).agg(F.min("seq").alias("born"))
    return log.where("t = 'edge_added'").join(born, "d", "left").select("seq", "s", "d", _kind().alias("kind"), F.when(F.coalesce(F.col("born") < F.col("seq"), F.lit(False)), 0).otherwise(1).alias("late"))


def timeline(log: DataFrame, batch: int = 64) -> DataFrame:
    """(batch, seq, node_start, edge_start, n_node, n_edge) of the de-duplicated log's births, ``batch`` events each."""
    rows = numbered(deduplicated(log).where(F.col("t").isin("node_added", "node_updated", "edge_added")), "seq").withColumn("batch", F.floor(F.col("__i") / batch))
    each = rows.groupBy("batch").agg(F.min("seq").alias("seq"), F.count_if(F.col("t") == "node_added").alias("n_node"), F.count_if(F.col("t") == "edge_added").alias("n_edge"))
    # running sums over batches, by blocks of batches
    each = each.withColumn("block", F.floor(F.col("batch") / 1024))
    block = each.groupBy("block").agg(F.sum("n_node").alias("bn"), F.sum("n_edge").alias("be"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.select("block", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("be").over(before), F.lit(0)).alias("be"))
    inside = Window.partitionBy("block").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return each.join(F.broadcast(block), "block").select(
        "batch", "seq", (F.col("bn") + F.coalesce(F.sum("n_node").over(inside), F.lit(0))).alias("node_start"), (F.col("be") + F.coalesce(F.sum("n_edge").over(inside), F.lit(0))).alias("edge_start"), "n_node", "n_edge"
    )


def replay(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A stored graph as an event log: nodes in id order, then edges in (s, t) order, numbered from 1."""
    n = nodes.select(F.lit(0).alias("phase"), F.col("i").alias("a"), F.lit("").alias("b"), F.lit("node_added").alias("t"), F.col("i").alias("id"), F.col("t").alias("title"), F.col("u").alias("url"), "c", F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("kind"))
    e = edges.select(F.lit(1).alias("phase"), F.col("s").alias("a"), F.col("t").alias("b"), F.lit("edge_added").alias("t"), *[F.lit(None).cast("string").alias(x) for x in ("id", "title", "url", "c")], "s", F.col("t").alias("d"), F.col("k").alias("kind"))
    order = F.struct("phase", "a", "b").alias("__order")
    both = n.unionByName(e).withColumn("__order", order)
    return numbered(both, "__order").withColumn("seq", (F.col("__i") + 1).cast("long")).select("seq", "t", "id", "title", "url", "c", "s", "d", "kind")
