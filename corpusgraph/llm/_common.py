"""What the operators of this package share: reading, shipping code, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of narrow rows that is ever broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 500_000
#: And their bytes at most.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Share of the driver's heap beyond which its garbage is collected between steps.
DRIVER_HEAP = 0.5
#: Bytes of one Arrow batch handed to a Python worker, so that very long texts don't pile up in one batch.
BATCH_BYTES = 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per context) and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_corpusgraph_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    fd, name = tempfile.mkstemp(prefix="corpusgraph-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((root / "corpusgraph").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    sc.addPyFile(name)
    sc._corpusgraph_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master gets a folder of our own where it is unset; a cluster would lose what is written there.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not where:
        found = sc._jsc.sc().getCheckpointDir()
        where = str(Path(found.get()).parent) if found.isDefined() else ""
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        where = sc._corpusgraph_shared = getattr(sc, "_corpusgraph_shared", None) or tempfile.mkdtemp(prefix="corpusgraph-checkpoint-")
    return where.rstrip("/")


def tidy(spark: SparkSession, share: float = DRIVER_HEAP) -> bool:
    """Collect the driver's garbage if its heap has grown beyond ``share`` of what it may have; says if it did.

    What tasks and plans leave behind is short-lived, but the heap grows to its limit for it and doesn't shrink by itself,
    and shuffle files and broadcasts that nothing refers to stay until the driver collects them.
    """
    jvm = spark._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    grown = runtime.totalMemory() > share * runtime.maxMemory()
    if grown:
        jvm.java.lang.System.gc()
    return grown


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, and keep the driver's heap from growing."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the checkpoints of frames made by ``cut`` that nothing will read again."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def delete_folder(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows and ``size`` bytes, else as it is.

    The bytes are those of strings, binaries and arrays, and 16 for every other column.
    """
    wide = [F.octet_length(F.col(c)) if k in ("string", "binary") else F.size(c) * 16 if k.startswith("array") else None for c, k in df.dtypes]
    each = sum((F.coalesce(x, F.lit(0)) for x in wide if x is not None), F.lit(16 * len(wide)))
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(each.cast("long")).alias("b")).first()
    return F.broadcast(df) if got["n"] <= rows and (got["b"] or 0) <= size else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores in front where ``df`` has such a column, for columns beside those of a caller."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
