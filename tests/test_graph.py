from __future__ import annotations

import base64
import gzip
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import ids
from corpusgraph.functions import text as T
from corpusgraph.operators import events, graph, index, layout, links, retrieval, view
from corpusgraph.sources import files as tree
from corpusgraph.sources import web
from corpusgraph.store import Store
from corpusgraph.streaming import live

DOC = "id string, chapter string, title string, url string, sha string, body string"


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_page_ids(spark):
    cases = [
        ("https://h/docs/", "https://h/docs/guide/a.html", "guide_a"), ("https://h/", "https://h/", "index"), ("https://h/", "https://h/a\\b", "a_5Cb"), ("https://h/", "https://h/a:b*c", "a_3Ab_2Ac"),
        ("https://h/", "https://h/..%2F..%2Fetc", "_252F-_252Fetc"), ("https://h/", "https://h/..", "index"), ("https://h/", "https://h/v1.2/guide/", "v1.2_guide"), ("https://h/", "https://h/~me/x.php", "_me_x"),
    ]
    got = frame(spark, "b string, u string, w string", *cases).select("w", ids.page_id(F.col("b"), F.col("u")).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_same_site_and_buckets(spark):
    r = frame(spark, "b string, u string", ("https://H/docs/x", "https://h/docs/y"), ("https://h/docs/x", "https://h/blog"), ("https://h/", "https://o/"))
    assert values(r, ids.same_site(F.col("b"), F.col("u"))) == [True, False, False]
    assert [ids.bucket_count(n) for n in (127, 128, 1023, 1024, 32767, 32768)] == [1, 16, 16, 64, 64, 256]


def test_pagerank_spreads_dangling_rank(spark):
    n, e = frame(spark, "id string", ("a",), ("b",), ("c",)), frame(spark, "s string, t string, k string", ("a", "b", "ref"), ("a", "c", "ref"), ("b", "c", "ref"))
    pr = dict.fromkeys("abc", 1 / 3)
    for _ in range(20):
        loose = 0.85 * pr["c"] / 3
        pr = {"a": 0.05 + loose, "b": 0.05 + loose + 0.85 * pr["a"] / 2, "c": 0.05 + loose + 0.85 * (pr["a"] / 2 + pr["b"])}
    got = {r.id: r.r for r in graph.pagerank(n, e).collect()}
    assert all(math.isclose(got[k], pr[k], abs_tol=1e-6) for k in pr) and math.isclose(sum(got.values()), 1, abs_tol=1e-5)
    assert graph.pagerank(n.limit(0), e).count() == 0
    assert {r.id: r.r for r in graph.pagerank(n.union(n), e, every=3).collect()} == got  # a repeated id is one node


def test_following_rows_of_large_groups(spark):
    from corpusgraph.operators import relations
    from corpusgraph.operators.common import following

    rows = [(f"d{i:05d}", "hot" if i % 3 else f"s{i}") for i in range(3000)] + [("x", ""), ("y", "")]
    got = {(r.s, r.t) for r in relations.duplicate_of(spark.createDataFrame(rows, "id string, sha string")).collect()}
    hot = [i for i, s in rows if s == "hot"]
    assert got == set(zip(hot, hot[1:], strict=False))
    again = following(spark.createDataFrame([("b", "g", 2), ("a", "g", 2), ("c", "g", 1), ("d", "h", 1), ("e", None, 1)], "id string, g string, v int"), "g", [F.col("v")])
    assert {(r.id, r.next) for r in again.collect()} == {("c", "a"), ("a", "b")}


def test_semantic_similar_by_blocks(spark):
    from corpusgraph.config import DEFAULT
    from corpusgraph.operators import relations

    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    vectors = [(f"v{i:03d}", [x + r.gauss(0, 0.4) for x in base[i % 5]]) for i in range(150)] + [("same1", [1.0] * 6), ("same2", [2.0] * 6), ("short", [1.0, 0.0]), ("zero", [0.0] * 6), (None, [1.0] * 6), ("none", None), ("hole", [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    known = [(i, v) for i, v in vectors if i and v and None not in v]
    score = {}
    for i, v in known:
        for j, w in known:
            if i < j and len(v) == len(w):
                n = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w)) + 1e-12
                score[i, j] = round(sum(x * y for x, y in zip(v, w, strict=True)) / n, 9)
    best = {}
    for (i, j), c in score.items():
        if c >= 0.7:
            for a, b in ((i, j), (j, i)):
                best.setdefault(a, []).append((-c, b))
    want = {(a, b) for a, line in best.items() for _, b in sorted(line)[:5] if a < b}
    for block in (4096, 40):
        got = relations.semantic_similar(spark.createDataFrame(vectors, "id string, embedding array<double>"), DEFAULT, block)
        assert {(x.s, x.t) for x in got.collect()} == want and len(want) > 100


def test_neighbours_and_induced(spark):
    e = frame(spark, "s string, t string, k string", ("a", "b", "ref"), ("c", "b", "ref"), ("c", "d", "ref"), ("d", "e", "ref"))
    assert {(r.id, r.hop) for r in graph.neighbours(e, "a", 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.id) for r in graph.neighbours(e, "a", 0).collect()} == {"a"}
    assert {(r.id, r.depth) for r in graph.reach(e.select("s", "t"), frame(spark, "id string", ("c",)), 9).collect()} == {("c", 0), ("b", 1), ("d", 1), ("e", 2)}


def test_search_ranks_the_right_page(spark):
    d = frame(spark, DOC, ("x", "_root", "kernel", "", "", "kernel driver kernel driver"), ("y", "_root", "cooking", "", "", "pasta and sauce"), ("z", "_root", "empty", "", "", None))
    post = index.postings(index.term_freq(d))
    assert values(index.search(d, post, "kernel driver"), "id") == ["x"]
    assert index.search(d, post, "").count() == index.search(d, post, "the").count() == 0


def test_posting_cap_and_ties(spark):
    d = frame(spark, DOC, *[(f"d{i:03}", "_root", "t", "", "", "common" if i < 50 else f"own{i}") for i in range(200)])
    assert sorted(values(index.postings(index.term_freq(d)).where("term = 'common'"), "id")) == [f"d{i:03}" for i in range(40)]


def test_links_of_bodies_resolve_or_vanish(spark):
    d = frame(spark, DOC, ("a", "_root", "", "", "", "[x](b.html) [y](dir/c.md#part) [z](gone) [self](a)"), ("b", "_root", "", "", "", ""), ("dir_c", "_root", "", "", "", ""))
    assert {(r.src, r.dst) for r in links.body_links(d).collect()} == {("a", "b"), ("a", "dir_c")}


def tree_files(spark):
    rows = [
        ("index.md", None, "# Home\n[g](docs/guide.md) [[design notes]] [gone](x.md) ![i](docs/guide.md) `[c](docs/guide.md)`"), ("docs/guide.md", None, "[home](../index) [abs](/index.md)"), ("docs/Design_Notes.md", None, "# Design"),
        ("pkg/__init__.py", "python", ""), ("pkg/a.py", "python", "from . import b, helper\nfrom pkg import helper as h\nimport os, pkg.b\n"), ("pkg/b.py", "python", "def go(): pass"), ("pkg/helper.py", "python", "class H: pass"),
        ("app.ts", "typescript", "import {u} from './src/util';\nimport r from 'react'"), ("src/util.ts", "typescript", "export const f = (x) => x"), ("src/lib.rs", "rust", "mod x;\nuse crate::x::y;"), ("src/x/mod.rs", "rust", "pub fn z() {}"),
        ("J/com/x/Foo.java", "java", "import com.x.Bar;"), ("J/com/x/Bar.java", "java", "public class Bar {}"), ("c/a.c", "c", '#include "a.h"\n#include "c/b.h"'), ("c/a.h", "c", ""), ("c/b.h", "c", ""), ("r/a.rb", "ruby", "require_relative 'b'"), ("r/b.rb", "ruby", ""),
    ]
    return frame(spark, "relpath string, lang string, content string", *rows)


def test_tree_links_and_imports(spark):
    f = tree_files(spark)
    got = {(r.rel, r.hit) for r in links.imports(f).collect()}
    assert got == {
        ("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/helper.py"), ("pkg/a.py", "pkg/__init__.py"), ("app.ts", "src/util.ts"), ("src/lib.rs", "src/x/mod.rs"), ("J/com/x/Foo.java", "J/com/x/Bar.java"),
        ("c/a.c", "c/a.h"), ("c/a.c", "c/b.h"), ("r/a.rb", "r/b.rb"),
    }
    found = links.doc_links(f)
    assert {(r.rel, r.hit) for r in found.where("hit IS NOT NULL").collect()} == {("index.md", "docs/guide.md"), ("index.md", "docs/Design_Notes.md"), ("docs/guide.md", "index.md")}
    assert values(found.where("hit IS NULL"), "target") == ["x.md"]
    d = {r.id: r for r in tree.tree_docs(f).collect()}
    assert d["index"].title == "Home" and d["docs_Design_Notes"].title == "Design" and "symbols: go" in d["pkg_b.py"].body and "symbols: f" in d["src_util.ts"].body
    assert ("index", "docs_guide", "ref") in {(r.s, r.t, r.k) for r in tree.tree_edges(f).collect()}


def test_go_packages(spark):
    f = frame(spark, "relpath string, lang string, content string", *[(f"pkg/f{i:02}.go", "go", "package p") for i in range(25)], ("main.go", "go", 'import (\n "example.com/m/pkg"\n)\nimport "fmt"'))
    assert sorted(r.hit for r in links.imports(f).collect()) == [f"pkg/f{i:02}.go" for i in range(20)]
    assert links.imports(f, "example.com/m").count() == 20


def test_file_ids_collide_late(spark):
    f = frame(spark, "relpath string, lang string, content string", ("a/b.md", None, ""), ("a_b.md", None, ""), ("a/b.py", "python", ""))
    got = {r.relpath: r.id for r in tree.file_ids(f).collect()}
    assert got["a_b.md"] == "a_b" and got["a/b.md"].startswith("a_b-") and got["a/b.py"] == "a_b.py"


def test_scan_reasons(spark):
    rows = [("a.py", 1, False, b"x"), ("drivers/target/x.c", 1, False, b"x"), ("target/y.c", 1, False, b"x"), ("z.bin", 1, False, b"x"), ("yarn.lock", 1, False, b"x"), ("big.md", 10**7, False, b"x"), ("bin.md", 1, False, b"a\0b"), ("l.md", 1, True, b"x"), (".license", 1, False, b"x"), ("LICENSE", 1, False, b"x")]
    f = frame(spark, "relpath string, size long, is_symlink boolean, head binary", *rows)
    got = {r.relpath: r.skip for r in tree.scanned(f, exempt=("drivers/target",)).collect()}
    assert got == {"a.py": None, "drivers/target/x.c": None, "target/y.c": "pruned", "z.bin": "ext", "yarn.lock": "noise_file", "big.md": "size", "bin.md": "binary", "l.md": "symlink", ".license": "ext", "LICENSE": None}
    assert {r.skip: r.n for r in tree.scan_stats(tree.scanned(f, 2)).collect()}["kept"] == 2


def test_read_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x y.md").write_text("hi")
    (tmp_path / "a.py").write_bytes(b"\0\1")
    got = {r.relpath: (r.size, r.is_symlink, bytes(r.content)) for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"d/x y.md": (2, False, b"hi"), "a.py": (2, False, b"\0\1")}


def test_corpus_files(spark, tmp_path):
    (tmp_path / "guide").mkdir()
    (tmp_path / "guide" / "guide_a.md").write_text('---\ntitle: "T x"\nsource_url: U\nsha256: H\n---\n\nbody: not meta\n')
    (tmp_path / "guide" / "plain.md").write_text("only text")
    got = {r.id: (r.chapter, r.title, r.url, r.sha, r.body) for r in tree.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"guide_a": ("guide", "T x", "U", "H", "\nbody: not meta\n"), "plain": ("guide", "plain", "", "", "only text")}
    d = tree.read_corpus(spark, str(tmp_path))
    tree.write_corpus(d, str(tmp_path / "out"))
    assert {tuple(r) for r in tree.read_written(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in d.collect()}


def test_html_rules(spark):
    p = frame(spark, "url string, html string", ("https://h/a/b.html", "<h1></h1><h1>A <b>b</b> #</h1><meta name='description' content=' x  y '><h2>S</h2><a href='../c'>c</a><a href='d.png'>d</a><a href='?q'>q</a><a href='https://o/x'>o</a><a href='#f'>f</a>"), ("https://h/s", '<title>T</title><div id="root"> </div>'))
    h, u = F.col("html"), F.col("url")
    assert values(p, T.page_title(h, u)) == ["A b", "T"] and values(p, T.page_description(h)) == ["x y", ""] and values(p, F.array_join(T.page_headings(h), "|")) == ["A b #|S", ""]
    assert {(r.src, r.dst) for r in links.page_links(p).collect()} == {("https://h/a/b.html", "https://h/c")}
    assert values(p, T.is_js_shell(h, T.hrefs(h))) == [False, True]


def test_inventories(spark):
    import zlib

    blob = b"# Sphinx inventory version 2\n# P\n# V\n# z\n" + zlib.compress(b"index std:doc -1 index.html T\nguide std:doc -1 $ T\nf py:function 1 f.html -\n")
    inv = web.inventory_urls(frame(spark, "content binary", (blob,), (b"junk",), (None,)), "https://h/docs/")
    assert sorted(values(inv, "url")) == ["https://h/docs/guide", "https://h/docs/index.html"]
    maps = frame(spark, "url string, body string", ("s", "<loc>https://h/m.xml</loc><loc>https://h/a</loc><loc>https://o/b</loc>"))
    assert values(web.sitemap_urls(maps, "https://h/"), "url") == ["https://h/a"] and values(web.child_sitemaps(maps), "url") == ["https://h/m.xml"]
    empty = maps.select("url").limit(0)
    assert {tuple(r) for r in web.page_inventory(a=empty, b=inv).collect()} == {("https://h/docs/guide", "b"), ("https://h/docs/index.html", "b")}
    assert values(web.navtree_urls(frame(spark, "body string", ('"a.html#x": "b.html"',)), "https://h/"), "url")


def test_redirects(spark):
    hops = frame(
        spark, "url string, status int, location string, allowed boolean", ("https://h/a", 302, "/b", True), ("https://h/b", 200, None, True), ("https://h/o", 301, "https://x/", True), ("https://h/r", 200, None, False), ("https://h/q", 302, "/r", True),
        ("https://h/l", 302, "/l", True), ("https://h/n", 302, None, True),
    )
    got = {r.url: (r.final_url, r.status, r.reason) for r in web.followed(hops, "https://h/").collect()}
    assert got == {
        "https://h/a": ("https://h/b", 200, None), "https://h/b": ("https://h/b", 200, None), "https://h/o": (None, None, "offsite_redirect"), "https://h/r": (None, None, "robots"), "https://h/q": (None, None, "robots_redirect"),
        "https://h/l": (None, None, "too_many_hops"), "https://h/n": ("https://h/n", 302, None),
    }


EVENTS = [
    (1, "node_added", "a", "A", None, "c1", None, None, None), (2, "node_added", "a", "A2", None, None, None, None, None), (3, "edge_added", None, None, None, None, "a", "b", None), (4, "edge_added", None, None, None, None, "a", "b", "ref"),
    (5, "edge_added", None, None, None, None, "a", "z", "imports"), (6, "node_added", "b", "B", None, "c2", None, None, None),
]


def test_events_fold(spark):
    log = events.deduplicated(frame(spark, live.EVENT, *EVENTS))
    assert sorted((r.seq, r.t) for r in log.collect()) == [(1, "node_added"), (2, "node_updated"), (3, "edge_added"), (5, "edge_added"), (6, "node_added")]
    assert [r.seq for r in events.renumbered(log).orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    assert {(r.id, r.t, r.c) for r in events.live_nodes(log).collect()} == {("a", "A2", "c1"), ("b", "B", "c2")}
    assert {tuple(r) for r in events.pending(log).collect()} == {("z", 1)}
    assert {(r.seq, r.late) for r in events.late_edges(log).collect()} == {(3, 1), (5, 1)}
    assert [r.seq for r in events.since(log, 4).orderBy("seq").collect()] == [5, 6]
    assert [tuple(r) for r in events.timeline(log, 2).orderBy("batch").collect()] == [(0, 1, 0, 0, 1, 0), (1, 3, 1, 0, 0, 2), (2, 6, 1, 2, 1, 0)]


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, e in enumerate(EVENTS):
        frame(spark, live.EVENT, e).coalesce(1).write.mode("append").json(str(src))
        _ = i
    stream = live.read_events(spark, str(src))
    for name, df, mode in (("edges", live.unique_edges(stream), "append"), ("log", live.node_log(stream), "append"), ("nodes", live.live_nodes(stream), "update"), ("count", live.counters(stream), "complete")):
        q = df.writeStream.format("memory").queryName(f"t_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    log = events.deduplicated(frame(spark, live.EVENT, *EVENTS))
    assert {(r.s, r.d, r.kind) for r in spark.table("t_edges").collect()} == {tuple(r) for r in events.live_edges(log).collect()}
    assert {(r.seq, r.t, r.id) for r in spark.table("t_log").collect()} == {(r.seq, r.t, r.id) for r in log.where("id IS NOT NULL").collect()}
    assert {(r.id, r.title, r.c) for r in spark.table("t_nodes").collect()} >= {tuple(r) for r in events.live_nodes(log).select("id", "t", "c").collect()}
    assert {r.t: r.n for r in spark.table("t_count").collect()} == {"node_added": 3, "edge_added": 3}
    q = live.sink(live.unique_edges(stream), str(tmp_path / "sink"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2


def test_phases(spark):
    n, e = frame(spark, "id string", ("a",), ("b",)), frame(spark, "s string, t string, k string", ("a", "b", "similar_to"), ("b", "a", "ref"))
    got = [tuple(r) for r in view.build_phases(n, e).orderBy("t0").collect()]
    assert got == [("CORPUS", 2, 0.0, 1.2), ("ref", 1, 1.2, 0.4), ("similar_to", 1, 1.6, 0.4)]


NODES = [{"i": "a", "t": "Ä", "u": "", "c": "x", "g": 1, "r": 0.5, "w": 7}, {"i": "b", "t": "", "u": "u", "c": "y", "g": 0, "r": 0.25, "w": 0}]
EDGES = [{"s": "a", "t": "b", "k": "ref"}]


def test_archive_round_trip():
    nodes, edges = pa.Table.from_pylist(NODES), pa.Table.from_pylist(EDGES)
    places = pa.table({"i": ["b", "a"], "x": pa.array([1, -5], pa.int16()), "y": pa.array([0, 32767], pa.int16()), "z": pa.array([0, 0], pa.int16())})
    text = view.pack(nodes=nodes, edges=edges, layout=places)
    back = view.unpack(text)
    assert {k: t.to_pylist() for k, t in back.items()} == {"nodes": NODES, "edges": EDGES, "layout": places.to_pylist()}
    assert text == view.pack(layout=places, edges=edges, nodes=nodes.select(["w", "i", "t", "u", "c", "g", "r"])) and view.unpack(view.pack(nodes=nodes.slice(0, 0), edges=edges.slice(0, 0)))["nodes"].num_rows == 0
    raw = gzip.decompress(base64.b64decode(text))
    again = lambda b: base64.b64encode(gzip.compress(b)).decode()
    for bad in (again(raw[:-1]), again(raw + b"x"), again(raw.replace(b"ref", b"fer")), again(b""), again(b"{}\n"), "no archive", text[:-8], ""):
        with pytest.raises(ValueError):
            view.unpack(bad)
    for bad in ({"edges": pa.Table.from_pylist([{"s": "a", "t": "z", "k": "ref"}])}, {"nodes": pa.Table.from_pylist([*NODES, NODES[0]])}, {"other": edges}, {"edges": edges.select(["s"])}):
        with pytest.raises(ValueError):
            view.pack(**{"nodes": nodes, "edges": edges, **bad})


def test_archives_of_sites(spark):
    nodes = spark.createDataFrame([(s, n["i"], n["t"], n["u"], n["c"], n["g"], n["r"], n["w"]) for s in ("one", "two") for n in NODES], "site_id string, i string, t string, u string, c string, g int, r double, w int")
    edges = spark.createDataFrame([("one", "a", "b", "ref")], "site_id string, s string, t string, k string")
    got = {x.site_id: view.unpack(x.archive) for x in view.archives(nodes.repartition(3), edges).collect()}
    assert {s: (t["nodes"].to_pylist(), t["edges"].num_rows) for s, t in got.items()} == {"one": (NODES, 1), "two": (NODES, 0)}
    assert view.fnv32(b"") == 0x811C9DC5 and view.fnv32(b"foobar") == 0xBF9CF968


def test_layout_ignores_derived_edges(spark):
    n = frame(spark, "site_id string, i string, c string", *[("s", f"n{i}", f"c{i % 2}") for i in range(12)])
    ref = [("s", f"n{i}", f"n{i + 1}", "ref") for i in range(8)]
    e = "site_id string, s string, t string, k string"
    one = {r.i: (r.x, r.y, r.z) for r in layout.settle(n, frame(spark, e, *ref)).collect()}
    two = {r.i: (r.x, r.y, r.z) for r in layout.settle(n.repartition(3), frame(spark, e, ("s", "n9", "n1", "similar_to"), *ref[::-1])).collect()}
    assert one == two and len(one) == 12 and max(abs(v) for p in one.values() for v in p) <= 0.999


def test_quantise_and_cosine(spark):
    v = frame(spark, "x double", (9.0,), (-9.0,), (0.5 / 30000,), (1.5 / 30000,))
    assert values(v, T.quantise(F.col("x"))) == [32767, -32767, 0, 2]
    c = frame(spark, "a array<double>, b array<double>", ([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0], [0.0]))
    assert [round(x, 9) for x in values(c, T.cosine(F.col("a"), F.col("b")))] == [0.0, 1.0, 0.0]


def test_retrieval(spark):
    of = lambda *x: frame(spark, "id string, ord int", *[(v, i + 1) for i, v in enumerate(x)])
    got = retrieval.candidate_union(of(*[f"k{i}" for i in range(8)]), of("k1", *[f"e{i}" for i in range(7)]), of("g0", "k0", "g1")).orderBy("ord")
    assert values(got, "id") == [*[f"k{i}" for i in range(8)], "e0", "e1", "e2", "e3", "g0", "g1"]
    d = frame(spark, "id string, body string", ("a", "x" * 1300), ("b", ""))
    b = retrieval.blocks(d)
    assert sorted((r.id, r.pos, len(r.block)) for r in b.collect()) == [("a", 0, 600), ("a", 1, 600), ("a", 2, 100), ("b", 0, 0)]
    e = {r.id: r.excerpt for r in retrieval.best_excerpt(b.withColumn("score", F.col("pos"))).collect()}
    assert len(e["a"]) == 1300 + 6 and e["b"] == ""


def test_store(spark, tmp_path):
    st = Store(spark, str(tmp_path))
    nodes = frame(spark, "i string, c string, t string, u string, g int, r double, w int", ("a", "_root", "A", "", 0, 0.5, 1), ("b", "_root", "B", "", 1, 0.5, 1))
    edges = frame(spark, "s string, t string, k string", ("a", "b", "ref"))
    d = frame(spark, DOC, ("a", "_root", "A", "", "", "kernel text"), ("b", "_root", "B", "", "", "other"), ("c", "_root", "C", "", "", ""))
    for site in ("one", "two", "one"):
        st.save(site, "https://h/", nodes, edges, index.postings(index.term_freq(d)), d, graph.verdict(edges))
    assert values(st.list_sites(), "site_id") == ["one", "two"]
    assert values(st.get_page("one", "a"), "body") == ["kernel text"]
    assert values(st.search("two", "kernel"), "id") == ["a"]
    near, between = st.neighbours("one", "a")
    assert near.count() == 2 and between.count() == 1
    with pytest.raises(ValueError):
        st.neighbours("one", "zzz")
    with pytest.raises(ValueError):
        st.get_page("none", "a")


def test_empty_tables(spark):
    d, e = frame(spark, DOC), frame(spark, "s string, t string, k string")
    from corpusgraph.plans.build import build_graph

    g = build_graph(d, e)
    assert g.nodes.count() == g.edges.count() == g.postings.count() == 0 and g.report.first().verdict == "NOT-READY"
