"""The stored form of sites: versions of Parquet tables, and a commit file for each that is written last.

``data/<site>/<version>/<table>`` holds the tables of a version, the bodies in folders by bucket; ``commits/<site>/<version>.json``
says that it is whole, and what it is.  A reader takes the highest commit and reads all tables of that version, so that
it never sees a mix.  One version before the last stays for readers that began before.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import ids
from corpusgraph.operators import graph, index, retrieval

SCHEMAS = {
    "nodes": "i string, c string, t string, u string, g int, r double, w int",
    "edges": "s string, t string, k string",
    "postings": "term string, id string, tf long, n_all long",
    "docs": "id string, chapter string, title string, url string, sha string, body string, bucket int",
}
META = "site_id string, version int, url string, built_at string, doc_buckets int, verdict string, note string, docs long, edges long, terms long, edge_types map<string,long>, relation_mode string"
#: Seconds after which a lock that nobody has renewed may be taken over.
STALE = 120


@dataclass(frozen=True)
class Store:
    """A folder of sites in any file system that Spark reaches."""

    spark: SparkSession
    path: str

    # -- files -----------------------------------------------------------------

    def _fs(self, where: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _list(self, where: str) -> list[str]:
        fs, path = self._fs(where)
        return sorted(str(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, where: str) -> None:
        fs, path = self._fs(where)
        fs.delete(path, True)

    def _get(self, where: str) -> str | None:
        """A small file's text, or None; Spark's own readers leave out names that begin with a dot."""
        fs, path = self._fs(where)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, where: str, text: str, exclusive: bool = False) -> bool:
        """Write a small file whole: under another name first, then renamed.  ``exclusive`` fails where there is one."""
        fs, path = self._fs(where)
        if exclusive:
            try:
                out = fs.create(path, False)
            except Exception as e:  # noqa: BLE001  the JVM's exception says only in words that the file is there
                if "exist" in str(e).lower():
                    return False
                raise
        else:
            temp = self._fs(f"{where}.{uuid.uuid4().hex}.tmp")[1]
            out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if exclusive:
            return True
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(temp, path):
            raise OSError(f"{where} can't be written")
        return True

    # -- one writer for each site ----------------------------------------------

    @contextmanager
    def lock(self, site_id: str, wait: float = 30.0, stale: float = STALE) -> Iterator[None]:
        """Hold a site for writing: a file that only one can create.  One not renewed for ``stale`` seconds is taken over."""
        where, own = f"{self.path}/locks/{_name(site_id)}", f"{os.uname().nodename}-{os.getpid()}-{uuid.uuid4().hex}"
        until = time.monotonic() + wait
        while not self._put(where, own, exclusive=True):
            fs, path = self._fs(where)
            try:
                age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
            except Exception:  # noqa: BLE001  it has gone meanwhile
                continue
            if age > stale:
                fs.delete(path, False)
            elif time.monotonic() > until:
                raise TimeoutError(f"another writer holds {site_id}")
            else:
                time.sleep(0.1)
        try:
            yield
        finally:
            self._delete(where)

    def renew(self, site_id: str) -> None:
        """Tell others that the writer of a site is still at work."""
        fs, path = self._fs(f"{self.path}/locks/{_name(site_id)}")
        if fs.exists(path):
            fs.setTimes(path, int(time.time() * 1000), -1)

    # -- writing ---------------------------------------------------------------

    def save(self, site_id: str, url: str, nodes: DataFrame, edges: DataFrame, postings: DataFrame, docs: DataFrame, report: DataFrame) -> dict:
        """Replace a site by a new version; returns its meta.

        Nodes and edges are in order, bodies go to as many buckets as the site's size asks for.  Nothing of the version
        counts until its commit is there; what a failed save leaves behind is deleted by the next one.
        """
        site = _name(site_id)
        done = self._versions(site)
        version = (done[-1] if done else 0) + 1
        base = f"{self.path}/data/{site}/{version:08d}"
        self._delete(base)
        n = ids.bucket_count(docs.count())
        nodes.sort("i").write.parquet(f"{base}/nodes")
        self.renew(site_id)
        edges.sort("s", "t").write.parquet(f"{base}/edges")
        postings.write.parquet(f"{base}/postings")
        self.renew(site_id)
        docs.withColumn("bucket", ids.bucket(F.col("id"), n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/docs")
        told = report.first()
        meta = {k: v for k, v in told.asDict(recursive=True).items() if k in META} if told else {}
        meta |= {"site_id": site_id, "version": version, "url": url, "doc_buckets": n, "built_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        self._put(f"{self.path}/commits/{site}/{version:08d}.json", json.dumps(meta))
        for old in self._list(f"{self.path}/data/{site}"):
            if old.isdigit() and int(old) < version - 1:
                self._delete(f"{self.path}/commits/{site}/{old}.json")
                self._delete(f"{self.path}/data/{site}/{old}")
        return meta

    def reset(self, site_id: str) -> None:
        """Forget a site: its commits first, so that no reader finds it half gone."""
        self._delete(f"{self.path}/commits/{_name(site_id)}")
        self._delete(f"{self.path}/data/{_name(site_id)}")

    # -- reading ---------------------------------------------------------------

    def _versions(self, site: str) -> list[int]:
        return [int(f[:-5]) for f in self._list(f"{self.path}/commits/{site}") if f.endswith(".json") and f[:-5].isdigit()]

    def version(self, site_id: str) -> int:
        """The site's last whole version."""
        done = self._versions(_name(site_id))
        if not done:
            raise ValueError(f"no such site: {site_id}")
        return done[-1]

    def read(self, name: str, site_id: str, version: int | None = None) -> DataFrame:
        v = self.version(site_id) if version is None else version
        # the columns are said here, since a table may have no row and so no file
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/data/{_name(site_id)}/{v:08d}/{name}")

    def meta(self, site_id: str, version: int | None = None) -> DataFrame:
        v = self.version(site_id) if version is None else version
        return self.spark.read.schema(META).json(f"{self.path}/commits/{_name(site_id)}/{v:08d}.json")

    def list_sites(self) -> DataFrame:
        """Meta of the last version of each site."""
        last = [f"{self.path}/commits/{s}/{v[-1]:08d}.json" for s in self._list(f"{self.path}/commits") if (v := self._versions(s))]
        return (self.spark.read.schema(META).json(last) if last else self.spark.createDataFrame([], META)).orderBy("site_id")

    def get_page(self, site_id: str, page_id: str) -> DataFrame:
        """The document, from one bucket: buckets are folders, so one is read."""
        v = self.version(site_id)
        n = self.meta(site_id, v).first()["doc_buckets"]
        b = self.spark.range(1).select(ids.bucket(F.lit(page_id), n).alias("b")).first()["b"]
        return self.read("docs", site_id, v).where((F.col("bucket") == b) & (F.col("id") == page_id)).drop("bucket")

    def neighbours(self, site_id: str, page_id: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        """Nodes with their hop, and the edges among them."""
        v = self.version(site_id)
        nodes, edges = self.read("nodes", site_id, v), self.read("edges", site_id, v)
        if nodes.where(F.col("i") == page_id).isEmpty():
            raise ValueError(f"no such page: {page_id}")
        near = graph.neighbours(edges, page_id, depth)
        return nodes.join(graph.small(near.withColumnRenamed("id", "i")), "i"), graph.induced(edges, near)

    def site_stats(self, site_id: str) -> tuple[DataFrame, DataFrame]:
        """Meta and the five nodes with most edges."""
        v = self.version(site_id)
        return self.meta(site_id, v), graph.top_degree(self.read("edges", site_id, v))

    def search(self, site_id: str, query: str, limit: int = 10) -> DataFrame:
        v = self.version(site_id)
        nodes = self.read("nodes", site_id, v).select(F.col("i").alias("id"), F.col("t").alias("title"), F.col("u").alias("url"))
        return index.search(nodes, self.read("postings", site_id, v), query, limit)

    def graph_json(self, site_id: str) -> str:
        """The whole graph as one JSON object, for viewers that load it at once."""
        v = self.version(site_id)
        nodes = self.read("nodes", site_id, v).orderBy("i").toJSON().collect()
        edges = self.read("edges", site_id, v).orderBy("s", "t").toJSON().collect()
        return f'{{"nodes": [{", ".join(nodes)}], "edges": [{", ".join(edges)}]}}'

    def ask(self, site_id: str, question: str, models: retrieval.Models | None = None, top_k: int = 4) -> dict:
        """The pages that answer a question, and the answer if ``models`` can write one (see ``retrieval.ask``)."""
        v = self.version(site_id)
        nodes, posting, edges = (self.read(t, site_id, v) for t in ("nodes", "postings", "edges"))
        titles = nodes.select(F.col("i").alias("id"), F.col("t").alias("title"), F.col("u").alias("url"))
        docs = self.read("docs", site_id, v).select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("body", F.lit("")).alias("body"))
        return retrieval.ask(docs, lambda n: [r.id for r in index.search(titles, posting, question, n).collect()], edges, question, models, top_k)


def _name(site_id: str) -> str:
    if not site_id or not all(c.isalnum() or c in "._-" for c in site_id) or site_id.startswith("."):
        raise ValueError(f"not a site id: {site_id!r}")
    return site_id
