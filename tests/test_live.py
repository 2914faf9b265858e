"""Corpus files with links, runs and batches of the live stream, layouts that grow, addresses."""

from __future__ import annotations

import math
import time

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import hosts
from corpusgraph.operators import layout
from corpusgraph.sources import files as tree
from corpusgraph.streaming import live

DOC = "id string, chapter string, title string, url string, sha string, body string"


def test_corpus_with_links(spark, tmp_path):
    path = str(tmp_path / "corpus")
    docs = spark.createDataFrame([("a", "x", "A", "u", "s", "line\nline"), ("b", "_root", "B", "", "", "")], DOC)
    tree.write_corpus(docs, path, spark.createDataFrame([("a", "b"), ("a", "a2"), ("a", "b")], "s string, t string"))
    assert {tuple(r) for r in tree.read_written(spark, path).collect()} == {tuple(r) for r in docs.collect()}
    assert sorted(tuple(r) for r in tree.read_links(spark, path).collect()) == [("a", "a2"), ("a", "b")]
    with pytest.raises(Exception, match="broken"):
        tree.write_corpus(docs.withColumn("body", F.raise_error(F.lit("broken")).cast("string")), path)
    assert tree.read_written(spark, path).count() == 2  # what was whole before stays
    tree.write_corpus(docs.limit(1), path)
    assert tree.read_written(spark, path).count() == 1 and tree.read_links(spark, path).count() == 0


def test_batches_in_sequence(spark, tmp_path):
    src, got = tmp_path / "src", []
    events = [(s, "node_added", f"n{s}", None, None, None, None, None, None) for s in range(1, 251)]
    spark.createDataFrame(events[::-1] + events[:20], live.EVENT).repartition(3).write.json(str(src))
    put = lambda rows, n: got.append((n, [r.seq for r in rows.collect()]))
    q = live.batches(live.read_events(spark, str(src)), put, str(tmp_path / "ck"), most=100, once=True)
    q.awaitTermination()
    assert [len(s) for _, s in got] == [100, 100, 50] and [s for _, x in got for s in x] == list(range(1, 251)) and len({n for n, _ in got}) == 3
    spark.createDataFrame(events[:30], live.EVENT).write.mode("append").json(str(src))
    q = live.batches(live.read_events(spark, str(src)), put, str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    assert len(got) == 3  # seen before


def test_layout_patches(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    node = lambda s, i: (s, "node_added", i, None, None, "c", None, None, None)
    edge = lambda s, a, b: (s, "edge_added", None, None, None, None, a, b, None)
    for part in ([node(1, "a"), node(2, "b")], [node(3, "c"), edge(4, "a", "c")], [node(5, "a"), node(6, "d")]):
        spark.createDataFrame(part, live.EVENT).coalesce(1).write.mode("append").json(str(src))
        live.layout_patches(live.read_events(spark, str(src)), out, str(tmp_path / "ck"), once=True).awaitTermination()
    got = {r.i: (r.epoch, (r.x, r.y, r.z)) for r in spark.read.parquet(f"{out}/places").collect()}
    assert {i: e for i, (e, _) in got.items()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    assert got["b"][1] == pytest.approx(layout.stage(7, "b")) and 0 < math.dist(got["c"][1], got["a"][1]) <= layout.JITTER + 1e-9


class Query:
    def __init__(self, error=None):
        self.isActive, self.lastProgress, self._error = True, {"batchId": 0, "numInputRows": 1}, error

    def exception(self):
        return self._error

    def stop(self):
        self.isActive = False


def test_one_run_at_a_time():
    run, q = live.Run(quiet=0.1, whole=5), Query()
    assert run.state() == "idle"
    run.start(lambda: q)
    assert run.state() == "running"
    with pytest.raises(RuntimeError):
        run.start(Query)
    q.isActive = False
    assert run.state() == "complete"
    run.start(lambda: Query("lost"))
    run._query.isActive = False
    assert run.state() == "failed" and run.error == "lost"
    still = Query()
    run.start(lambda: still)
    run.state()
    time.sleep(0.15)
    assert run.state() == "failed" and run.error == "no progress" and not still.isActive
    run.whole = 0
    run.start(Query)
    assert run.state() == "failed" and run.error == "too long"


def test_layout_grows(spark):
    nodes = spark.createDataFrame([("s", f"n{k}", "c") for k in range(6)], "site_id string, i string, c string")
    edges = spark.createDataFrame([("s", "n0", "n4", "ref"), ("s", "n1", "n4", "contains"), ("s", "n5", "zz", "ref")], "site_id string, s string, t string, k string")
    known = spark.createDataFrame([("s", "n0", 0.4, 0.0, 0.0), ("s", "n1", -0.4, 0.0, 0.0)], "site_id string, i string, x double, y double, z double")
    got = {r.i: (r.x, r.y, r.z) for r in layout.placed(nodes, edges, known).collect()}
    assert set(got) == {"n2", "n3", "n4", "n5"} and got["n5"] == pytest.approx(layout.stage(7, "n5"))
    mean = (0.4 * 1.0 - 0.4 * 0.3) / 1.3
    assert 0 < math.dist(got["n4"], (mean, 0, 0)) <= layout.JITTER + 1e-9
    held = {r.i: (r.x, r.y, r.z) for r in layout.settle(nodes, edges, anchors=known).collect()}
    free = {r.i: (r.x, r.y, r.z) for r in layout.settle(nodes, edges).collect()}
    assert len(held) == 6 and math.dist(held["n0"], (0.4, 0, 0)) < math.dist(free["n0"], (0.4, 0, 0))


def test_shells(spark):
    nodes = spark.createDataFrame([(f"a{k:03d}", "big") for k in range(200)] + [(f"b{k}", "small") for k in range(20)], "i string, c string")
    edges = spark.createDataFrame([("a000", f"a{k:03d}", "ref") for k in range(1, 100)], "s string, t string, k string")
    got = {r.i: math.hypot(r.x, r.y, r.z) for r in layout.shells(nodes.repartition(4), edges).collect()}
    again = {r.i: math.hypot(r.x, r.y, r.z) for r in layout.shells(nodes, edges).collect()}
    assert got == again and len(got) == 220 and max(got.values()) <= layout.SHELL_RADIUS * 1.03 + 0.1
    assert max(v for i, v in got.items() if i[0] == "b") < min(v for i, v in got.items() if i[0] == "a" and i > "a100") and got["a000"] < 0.75 * got["a150"]


def test_addresses(spark):
    want = {
        "example.com": "https://example.com/", " docs.example.com/a?b#c ": "https://docs.example.com/a?b#c", "localhost:8080/x": "http://localhost:8080/x", "http://intranet": "http://intranet/",
        "https://me:pw@h.example/x": "https://h.example/x", "10.0.0.1": "https://10.0.0.1/", "intranet": None, "": None, "ftp://h.example": None, "two words.com": None, "http://": None, "http://[::1]:9/": "http://[::1]:9/",
    }
    df = spark.createDataFrame([(k,) for k in want], "raw string").withColumn("n", hosts.normalised(F.col("raw")))
    got = {r.raw: r.n for r in df.collect()}
    assert {k: v.url for k, v in got.items()} == want and all((v.url is None) == (v.error is not None) for v in got.values())
    assert spark.range(1).select(hosts.normalised(F.lit(None).cast("string")).alias("n")).first().n.error
    private = {
        "http://127.0.0.1/": True, "http://10.1.2.3": True, "http://172.16.0.1": True, "http://172.32.0.1": False, "http://192.168.1.1:80/x": True, "http://169.254.1.1": True, "http://8.8.8.8/": False, "http://224.0.0.1": True,
        "http://0.0.0.0": True, "http://[::1]/": True, "http://[fe80::1%25eth0]/": True, "http://[fd00::1]": True, "http://[2606:4700::1111]/": False, "http://[::ffff:10.0.0.1]/": True, "http://300.1.1.1": True,
        "http://x.internal/": True, "http://printer.local.": True, "http://localhost": True, "http://example.com": None, "http://": True,
    }
    df = spark.createDataFrame([(k,) for k in private], "u string").withColumn("p", hosts.private(F.col("u")))
    assert {r.u: r.p for r in df.collect()} == private
