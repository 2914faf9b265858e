"""The event log as a stream, with the results of the batch functions in ``operators.events``."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "seq long, t string, id string, title string, url string, c string, s string, d string, kind string"
_FIELDS = ("title", "c", "url")


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of line-delimited JSON files, file by file as they come; a limit of files bounds a batch."""
    r = spark.readStream.schema(EVENT)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(path)


def unique_edges(events: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """edge_added events, the first of each (s, d, kind).  Without a watermark the state is as large as the set of edges."""
    kind = F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("ref"))
    e = events.where("t = 'edge_added'").withColumn("kind", kind)
    return e.withWatermark(*watermark).dropDuplicatesWithinWatermark(["s", "d", "kind"]) if watermark else e.dropDuplicates(["s", "d", "kind"])


def node_log(events: DataFrame) -> DataFrame:
    """node events as the log keeps them, (seq, t, id, title, url, c): repeats of node_added become node_updated.

    State is one flag for each node.  Events of one node are put in order within a batch.
    """

    def label(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.exists
        rows = pd.concat(batches).sort_values("seq")
        t = []
        for kind in rows["t"]:
            t.append("node_updated" if kind == "node_added" and seen else kind)
            seen = seen or kind == "node_added"
        if seen and not state.exists:
            state.update((True,))
        yield rows.assign(t=t)

    cols = "seq long, t string, id string, title string, url string, c string"
    return events.where("t IN ('node_added', 'node_updated')").select("seq", "t", "id", "title", "url", "c").groupBy("id").applyInPandasWithState(label, cols, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def live_nodes(events: DataFrame) -> DataFrame:
    """(id, title, c, url, seq) of nodes as they stand after each batch, in update mode."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None, None, None, None]
        for r in pd.concat(batches).sort_values("seq").itertuples():
            if r.t == "node_added" and not state.exists and now[3] is None:
                now = [None, None, None, None]
            for i, f in enumerate(_FIELDS):
                v = getattr(r, f)
                if v is not None and v == v:
                    now[i] = v
            now[3] = int(r.seq)
        state.update(tuple(now))
        yield pd.DataFrame({"id": [key[0]], "title": [now[0]], "c": [now[1]], "url": [now[2]], "seq": [now[3]]})

    log = events.where("t IN ('node_added', 'node_updated')").select("seq", "t", "id", "title", "url", "c")
    return log.groupBy("id").applyInPandasWithState(fold, "id string, title string, c string, url string, seq long", "title string, c string, url string, seq long", "update", GroupStateTimeout.NoTimeout)


def counters(events: DataFrame) -> DataFrame:
    """Running number of events of each type and the last sequence number; monotone, in complete or update mode."""
    return events.groupBy("t").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def windows(events: DataFrame, ts: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: events in event-time windows with a watermark, (begin, event_type, n)."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, every), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("begin"), "event_type", "n")


def sink(df: DataFrame, path: str, checkpoint: str, seq: str | None = "seq"):
    """Write each batch, in sequence, to Parquet; started with availableNow, so that it ends when the input is used up."""

    def put(batch: DataFrame, epoch: int) -> None:
        out = batch.sortWithinPartitions(seq) if seq else batch
        out.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(events: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, most: int = 100, every: str = "300 milliseconds", once: bool = False):
    """Hand the events on in sequence, ``put(rows, n)`` with at most ``most`` of them each; a repeated sequence number is
    dropped, also one of an earlier batch.

    ``n`` counts on from the batch's number, so that a batch that is tried again hands on the same rows under the same
    numbers.  Numbers of the rows go by ranges, so that no task sorts a whole batch.
    """
    from corpusgraph.operators.index import numbered

    def hand_on(batch: DataFrame, epoch: int) -> None:
        rows = numbered(batch, "seq").withColumn("part", F.floor(F.col("__i") / most)).drop("__n")
        last = rows.agg(F.max("part").alias("p")).first()["p"]
        for p in range(0 if last is None else last + 1):
            put(rows.where(F.col("part") == p).orderBy("__i").drop("__i", "part"), (epoch << 32) + p)

    write = events.dropDuplicates(["seq"]).writeStream.foreachBatch(hand_on).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if once else write.trigger(processingTime=every)).start()


def layout_patches(events: DataFrame, folder: str, checkpoint: str, seed: int = 7, once: bool = False, every: str = "150 milliseconds"):
    """Places of nodes as they come: each batch's new nodes are put near what has a place already, and the places, (i, x,
    y, z), are written below ``folder``/places by batch.

    The log's edges are kept below ``folder``/edges, those of the batch count for its nodes.  A batch that is tried again
    writes the same folders again.
    """
    from corpusgraph.operators import layout

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        site = F.lit("").alias("site_id")
        kind = F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("ref"))
        batch.where("t = 'edge_added'").select("s", F.col("d").alias("t"), kind.alias("k")).write.mode("overwrite").parquet(f"{folder}/edges/epoch={epoch}")
        spark.createDataFrame([], "i string, x double, y double, z double").write.mode("overwrite").parquet(f"{folder}/places/epoch={epoch}")
        edges = spark.read.schema("s string, t string, k string, epoch long").parquet(f"{folder}/edges")
        known = spark.read.schema("i string, x double, y double, z double, epoch long").parquet(f"{folder}/places").where(F.col("epoch") < epoch)
        nodes = batch.where("t = 'node_added'").select(site, F.col("id").alias("i"))
        new = layout.placed(nodes, edges.select(site, "s", "t", "k"), known.select(site, "i", "x", "y", "z"), seed)
        new.select("i", "x", "y", "z").write.mode("append").parquet(f"{folder}/places/epoch={epoch}")

    write = events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if once else write.trigger(processingTime=every)).start()


class Run:
    """One run at a time: idle, running, complete or failed.

    ``start`` takes a function that starts a streaming query.  ``state`` looks at the query; a run without progress for
    ``quiet`` seconds, or longer than ``whole`` seconds, is stopped and has failed.
    """

    def __init__(self, quiet: float = 180, whole: float = 900) -> None:
        self.quiet, self.whole = quiet, whole
        self._query, self._error = None, ""
        self._began = self._moved = 0.0
        self._seen: object = None

    def start(self, begin: Callable[[], object]) -> None:
        if self.state() == "running":
            raise RuntimeError("a run is going on")
        self._error, self._seen = "", None
        self._began = self._moved = time.monotonic()
        self._query = begin()

    def state(self) -> str:
        q = self._query
        if q is None:
            return "idle"
        if self._error:
            return "failed"
        if not q.isActive:
            self._error = str(q.exception() or "")
            return "failed" if self._error else "complete"
        now, last = time.monotonic(), q.lastProgress
        mark = (last or {}).get("batchId"), (last or {}).get("numInputRows")
        if mark != self._seen:
            self._seen, self._moved = mark, now
        if now - self._moved > self.quiet or now - self._began > self.whole:
            q.stop()
            self._error = "no progress" if now - self._moved > self.quiet else "too long"
            return "failed"
        return "running"

    @property
    def error(self) -> str:
        return self._error
