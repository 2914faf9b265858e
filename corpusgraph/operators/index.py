"""Inverted index and search."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.config import DEFAULT, Config
from corpusgraph.functions import text as T
from corpusgraph.operators.common import cut, top, with_count


def term_freq(docs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(id, doc_order, term, tf, n_all)."""
    cand = with_count(docs.select("id", F.concat_ws("/", "chapter", F.concat("id", F.lit(".md"))).alias("doc_order"), T.strip_prose(F.coalesce("body", F.lit(""))).alias("prose")))
    return cand.select("id", "doc_order", "n_all", F.explode(T.tokens(F.col("prose"), cfg.index_chars)).alias("term")).groupBy("id", "doc_order", "n_all", "term").agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(term, df, kept): kept if at most a share of all documents has the term."""
    # counted over the frequencies, so that they are needed and the tokens' exchange is the one that the postings use
    df = tf.groupBy("term", "n_all").agg(F.count_if(F.col("tf") > 0).alias("df"))
    return df.select("term", "df", "n_all", (F.col("df") / F.col("n_all") <= F.lit(cfg.df_ratio)).alias("kept"))


def postings(tf: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(term, id, tf, n_all): the documents with most occurrences, ties in document order."""
    kept = doc_freq(tf, cfg).where("kept").select("term")
    return top(tf.join(kept, "term"), ["term"], [F.desc("tf"), F.col("doc_order")], cfg.posting_cap).select("term", "id", "tf", "n_all")


def search(docs: DataFrame, posting: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, title, url, score) of the best documents; repeated query words count again; ties by id.

    The query's words go into the plan as a filter, which reaches the scan of stored postings, and the counting of terms
    where the postings are made on the way.
    """
    times = Counter(re.findall(T.TOKEN, query.lower()))
    hit = posting.where(F.col("term").isin(*times)) if times else posting.limit(0)
    again = F.lit(0)
    for term, n in times.items():
        again = F.when(F.col("term") == term, F.lit(n)).otherwise(again)
    each = hit.withColumn("plen", F.count("*").over(Window.partitionBy("term")))  # at most a posting list's length of rows each
    score = F.sum(again * F.log(1 + F.col("n_all") / (1 + F.col("plen"))) * (1 + F.log(F.col("tf"))))
    best = each.groupBy("id").agg(F.round(score, 9).alias("raw")).orderBy(F.desc("raw"), "id").limit(limit)
    return docs.select("id", "title", "url").join(F.broadcast(best), "id", "right").select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.round("raw", 3).alias("score"))


def even_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows at places floor(i * size / n) of the order, i < n; all rows if there are no more."""
    placed = numbered(df, order)
    # place i is floor(j * size / n) for the j that is the smallest with j * size / n >= i
    j = F.ceil(F.col("__i") * F.lit(n) / F.col("__n"))
    return placed.where((F.col("__n") <= n) | ((j < n) & (F.floor(j * F.col("__n") / F.lit(n)) == F.col("__i")))).drop("__i", "__n")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with its place __i in the order (from 0) and the number of rows __n.

    Rows are dealt by ranges of the order and that deal is written down, so that both uses see the same ranges; the
    number of rows in the ranges before is a table with one row for each range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id()))
    count = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    line = Window.orderBy("__p")
    before = count.select("__p", F.coalesce(F.sum("__c").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"), F.sum("__c").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__n"))
    place = F.col("__b") + F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return ranged.join(F.broadcast(before), "__p").withColumn("__i", place).drop("__p", "__b")
