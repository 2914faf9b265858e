"""Building blocks of the relation passes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Largest number of rows and of bytes that is broadcast, behind a count of them.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 * 1024 * 1024


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes (strings, and 16 for any other
    column), else as it is.  The count runs the plan, so it is cheap or cut before."""
    each = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, k in df.dtypes if k == "string"), F.lit(16 * len(df.columns)))
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(each.cast("long")).alias("b")).first()
    return F.broadcast(df) if got["n"] <= rows and (got["b"] or 0) <= size else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master gets a folder of our own where it is unset; a cluster would lose what is written there.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        where = sc._corpusgraph_shared = getattr(sc, "_corpusgraph_shared", None) or tempfile.mkdtemp(prefix="corpusgraph-checkpoint-")
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and where it is: for wide rows of which many passes read a few
    columns each.  ``delete`` it when nothing reads it any more."""
    where = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where), where


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusgraph_package", False):
        return
    root = Path(__file__).resolve().parents[2]
    fd, name = tempfile.mkstemp(prefix="corpusgraph-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((root / "corpusgraph").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    sc.addPyFile(name)
    sc._corpusgraph_package = True


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def with_count(df: DataFrame, name: str = "n_all") -> DataFrame:
    """``df`` with the number of its rows as a column, by a one-row join."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def df_ceiling(n: Column, floor: int, ratio: float) -> Column:
    return F.greatest(F.lit(floor), F.floor(n * F.lit(ratio)).cast("int"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + n / (1 + df))


def pairs(postings: DataFrame, key: str, *carry: str) -> DataFrame:
    """(a, b, key, carry_a, carry_b) of ids a < b that share a key.  Postings are truncated before, which bounds a key's pairs."""
    x = postings.select(F.col(key), F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    y = postings.select(F.col(key), F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return x.join(y, key).where("a < b")


def nominated(scored: DataFrame, cap: int, kind: str) -> DataFrame:
    """Edges (s, t, k) of scored pairs (a, b, score): every node names its best ``cap`` neighbours, ties by id; an edge is
    there if the *smaller* id names the larger one."""
    both = scored.select("a", "b", "score").union(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    return top(both, ["a"], [F.desc("score"), F.col("b")], cap).where("a < b").select(F.col("a").alias("s"), F.col("b").alias("t"), F.lit(kind).alias("k"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def following(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """(id, next) of rows and the row after each in its group, in the order of ``order`` and the id.

    All rows are numbered by ranges of (group, order), so that a group of any size is many tasks' work, and rows of
    neighbouring numbers are joined.  Rows of groups of one aren't numbered.
    """
    from corpusgraph.operators.index import numbered

    key = df.select("id", F.col(group).alias("g"), F.struct(F.col(group), *order, "id").alias("o"))
    several = key.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    line = numbered(key.join(several, "g", "left_semi"), "o").select("id", "g", "__i")
    after = line.select(F.col("id").alias("next"), "g", (F.col("__i") - 1).alias("__i"))
    return line.join(after, ["__i", "g"]).select("id", "next")
