"""Whole sites: from a folder or pages to the store, the command line, questions, content of pages."""

from __future__ import annotations

import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusgraph import cli
from corpusgraph.functions import pages as P
from corpusgraph.operators import retrieval
from corpusgraph.plans import ingest
from corpusgraph.sources import files as tree
from corpusgraph.sources import web
from corpusgraph.store import Store


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "README.md": "# Start\n\nSee [guide](docs/guide.md) and [[setup]].\n", "docs/guide.md": "# Guide\n\nThe kernel loads `drivers/probe` first.\n" + "The kernel is loaded from disk. " * 12,
        "docs/setup.md": "# Setup\n\nBack to [start](../README.md).\n" + "The kernel is loaded from disk with care again. " * 12, "src/a.py": "import src.b\n\ndef probe_device():\n    return 1\n", "src/b.py": "class Loader:\n    pass\n",
        "build/out.md": "# noise\n", "notes.tmp.md": "# hidden\n", "logs/x.md": "# log\n", "logs/keep.md": "# kept?\n", "pic.png": "\0", ".gitignore": "*.tmp.md\nlogs/\n!logs/keep.md\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_folder_to_site(spark, folder, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "store"))
    got = ingest.ingest_local(store, folder)
    assert got["ok"] and got["verdict"] == "READY" and got["scan_stats"]["kept"] == 5 and got["scan_stats"]["ignored"] == 3 and got["version"] == 1
    site = got["site_id"]
    assert {r.site_id for r in store.list_sites().collect()} == {site}
    assert [r.id for r in store.search(site, "care kernel").collect()] == ["docs_setup"]  # kernel is in too many pages
    assert store.get_page(site, "README").first().body.startswith("# Start")
    near, edges = store.neighbours(site, "README")
    assert {r.i for r in near.collect()} >= {"README", "docs_guide", "docs_setup"} and edges.count() >= 3
    g = json.loads(store.graph_json(site))
    assert [n["i"] for n in g["nodes"]] == sorted(n["i"] for n in g["nodes"]) and [(e["s"], e["t"]) for e in g["edges"]] == sorted((e["s"], e["t"]) for e in g["edges"])
    again = ingest.ingest_local(store, folder, respect_gitignore=False, relations="off", max_files=3)
    assert again["version"] == 2 and again["scan_stats"]["kept"] == 3 and again["site_id"] == site
    assert not ingest.ingest_local(store, folder + "/README.md")["ok"] and not ingest.ingest_local(store, folder + "/none")["ok"]
    run = lambda *a: (cli.main(["--store", store.path, *a], spark), json.loads(capsys.readouterr().out))
    capsys.readouterr()
    assert run("sites")[1][0]["site_id"] == site and run("stats", site)[1]["top"] and run("search", site, "care")[0] == 0
    assert run("page", "none", "x") == (1, {"ok": False, "error": "no such site: none"})
    assert run("ingest-local", folder)[1]["version"] == 3 and run("ask", site, "care")[1]["citations"][0]["id"] == "docs_setup"
    store.reset(site)
    assert store.list_sites().count() == 0


def test_readers_never_see_half_a_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    nodes = spark.createDataFrame([("a", "_root", "A", "", 0, 0.5, 1)], "i string, c string, t string, u string, g int, r double, w int")
    edges = spark.createDataFrame([], "s string, t string, k string")
    posts = spark.createDataFrame([("x", "a", 1, 1)], "term string, id string, tf long, n_all long")
    docs = spark.createDataFrame([("a", "_root", "A", "", "", "x")], "id string, chapter string, title string, url string, sha string, body string")
    report = spark.createDataFrame([("READY",)], "verdict string")
    store.save("s", "u", nodes, edges, posts, docs, report)
    bad = docs.withColumn("body", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.save("s", "u", nodes.withColumn("t", F.lit("B")), edges, posts, bad, report)
    assert store.version("s") == 1 and store.read("nodes", "s").first().t == "A"
    old = store.read("nodes", "s")
    assert store.save("s", "u", nodes.withColumn("t", F.lit("C")), edges, posts, docs, report)["version"] == 2
    assert store.read("nodes", "s").first().t == "C" and old.first().t == "A"  # who began before still reads
    store.save("s", "u", nodes, edges, posts, docs, report)
    assert sorted(os.listdir(f"{tmp_path}/data/s")) == ["00000002", "00000003"]


def test_one_writer_at_a_time(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with store.lock("s"):
        with pytest.raises(TimeoutError), store.lock("s", wait=0.2):
            pass
        store.renew("s")
        with store.lock("other"):
            pass
    with store.lock("s"):
        time.sleep(1.1)
        with store.lock("s", stale=1):  # who has stopped renewing has lost it
            pass
    for bad in ("", "../x", ".hidden", "a/b"):
        with pytest.raises(ValueError):
            store.version(bad)


def test_ignore_rules(spark):
    rules = "# comment\n\n*.log\n!keep.log\n/top.md\nbuild/\ndocs/*.tmp\n**/cache/**\na/**/z.md\nfile[0-9].md\n\\!odd.md\ndir\n"
    want = {
        "x.log": 1, "d/x.log": 1, "keep.log": 0, "d/keep.log": 0, "top.md": 1, "d/top.md": 0, "build/a.md": 1, "d/build/a.md": 1, "build": 0, "docs/a.tmp": 1, "docs/d/a.tmp": 0, "x/cache/y/z.md": 1,
        "a/z.md": 1, "a/b/c/z.md": 1, "b/z.md": 0, "file1.md": 1, "filex.md": 0, "!odd.md": 1, "dir/deep/a.md": 1, "x/dir/a.md": 1, "directory/a.md": 0,
    }
    df = spark.createDataFrame([(p,) for p in want], "relpath string").withColumn("out", tree.ignored_by(rules))
    assert {r.relpath: int(r.out) for r in df.collect()} == want
    assert not spark.createDataFrame([("a",)], "relpath string").where(tree.ignored_by("\n# nothing\n")).count()


PAGE = """<html><head><title>Site</title></head><body><nav><a href="/menu">Menu</a></nav><main><h1>{t}<a class="headerlink" href="#x">#</a></h1>
<p>About <b>{t}</b>, see <a href="{to}">next</a>.</p><ul><li>one<li>two</ul><aside>not this</aside></main><footer>foot</footer></body></html>"""


def test_pages_to_site(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    names = ["index", "guide/a", "guide/b", "guide/c"]
    rows = [(f"https://h/docs/{n}.html", PAGE.format(t=n, to=f"/docs/{names[(k + 1) % 4]}.html")) for k, n in enumerate(names)] + [("https://other/x", "<p>no"), ("https://h/docs/index.html", "<p>again")]
    pages = spark.createDataFrame(rows[:5], "url string, html string")
    got = ingest.ingest_pages(store, pages, "https://h/docs/index.html")
    assert got["ok"] and got["fetched"] == 4 and got["verdict"] == "READY" and "seed_hint" not in got
    body = store.get_page(got["site_id"], "guide_a").first().body
    assert body == "# guide/a\n\nAbout **guide/a**, see [next](/docs/guide/b.html).\n\n* one\n* two\n"
    kinds = {(r.s, r.t): r.k for r in store.read("edges", got["site_id"]).collect()}
    assert kinds["index", "guide_a"] == "hub" and kinds["guide_a", "guide_b"] == "ref"
    links = spark.createDataFrame([(f"https://h/docs/{a}.html", f"https://h/docs/{b}.html") for a, b in zip(names, names[1:], strict=False)], "s string, t string")
    one = ingest.ingest_pages(store, pages, "https://h/docs/index.html", max_depth=1, links=links)
    assert one["fetched"] == 2 and "seed_hint" in one and one["version"] == 2
    assert not ingest.ingest_pages(store, pages, "https://none/")["ok"]
    assert {r.id for r in web.crawl(links, names[0], "https://h/", 9, max_pages=1).collect()} == {names[0]}


def test_answers(spark):
    docs = spark.createDataFrame([(f"p{i}", f"title {i}", f"u{i}", ("kernel " if i % 2 else "disk ") * 300 + f"page {i}") for i in range(20)], "id string, title string, url string, body string")
    edges = spark.createDataFrame([("p1", "p9", "ref"), ("p8", "p1", "ref"), ("p3", "p2", "ref")], "s string, t string, k string")
    find = lambda n: ["p1", "p3"][:n]
    plain = retrieval.ask(docs, find, edges, "kernel")
    assert plain["ok"] and [c["id"] for c in plain["citations"]] == ["p1", "p3", "p8", "p9"] and "answer" not in plain and plain["notes"]
    assert len(plain["citations"][0]["excerpt"]) == retrieval.EXCERPT

    def embed(texts):
        return [[t.count("kernel") + 0.1, t.count("disk") + 0.1, float(t.endswith("page 15"))] for t in texts]

    models = retrieval.Models(embed, lambda q, texts, n: sorted(range(len(texts)), key=lambda i: -texts[i].count("kernel"))[:n], lambda rules, asked: f"{asked.count('[')} pages")
    full = retrieval.ask(docs, find, edges, "kernel", models, top_k=3)
    assert full["answer"] == "3 pages" and len(full["citations"]) == 3 and not full["notes"]

    def broken(*_):
        raise RuntimeError("away")

    failing = retrieval.ask(docs, find, edges, "kernel", retrieval.Models(broken, broken, broken))
    assert [c["id"] for c in failing["citations"]] == ["p1", "p3", "p8", "p9"] and len(failing["notes"]) == 2
    assert not retrieval.ask(docs, lambda n: [], edges, "kernel")["ok"]


def test_page_content():
    doxygen = "<body><div class=headertitle><div class=title>Class Foo</div></div><h1>Project</h1><div id=doc-content><p>Real <div class=related>no</div></div></body>"
    root = P.parsed(doxygen)
    assert P.title(root, "") == "Class Foo" and P.content(root).text() == "Real"
    assert P.title(P.parsed("<h1> </h1><title> T </title>"), "") == "T" and P.title(P.parsed(None), "https://h/a/b") == "b"
    sphinx = "<div class=document><div class=body><h2>Sub#</h2><h2>Sub</h2><pre>a\n b</pre><blockquote><p>q</blockquote><table><tr><th>h|i<tr><td><code>1</code></table><img src=i alt=A><hr><ol><li>x<li>y</ol></div><div>side</div></div>"
    found = P.content(P.parsed(sphinx))
    assert P.headings(found) == ["Sub"]
    assert P.markdown(found) == "## Sub#\n\n## Sub\n\n```\na\n b\n```\n\n> q\n\n| h\\|i |\n| --- |\n| `1` |\n\n![A](i)\n\n* * *\n\n1. x\n2. y\n"
    for tag in ("<p>", "<div>", "<b>", "<ul><li>", "<blockquote>", "<table><tr><td>"):  # however deep
        assert re.search("x", P.markdown(P.content(P.parsed(tag * 2000 + "x"))) + "x")


def test_page_parts_rows(spark):
    df = spark.createDataFrame([("https://h/a", None), (None, "<p>x"), ("https://h/b", "<h1>B</h1>"), ("https://h/b", "<h1>B</h1>")], "url string, html string").withColumn("title", F.lit("clash"))
    got = sorted((r.url or "", r.title, r.text) for r in web.page_parts(df).collect())
    assert got == [("", "", "x"), ("https://h/a", "a", ""), ("https://h/b", "B", "B"), ("https://h/b", "B", "B")] and web.page_parts(df.limit(0)).count() == 0


def test_sitemap_limits(spark):
    root = "https://h/sitemap.xml"
    loc = lambda *u: "".join(f"<loc>{x}</loc>" for x in u)
    files = [(root, loc(*[f"https://h/m{i}.xml" for i in range(5)], "https://h/p"))] + [(f"https://h/m{i}.xml", loc(*[f"https://h/{i}/{k}" for k in range(10)], "https://x/no")) for i in range(5)]
    df = spark.createDataFrame(files, "url string, body string")
    assert web.sitemap_inventory(df, root, "https://h/").count() == 51
    assert web.sitemap_inventory(df, root, "https://h/", children=2).count() == 21
    assert web.sitemap_inventory(df, root, "https://h/", enough=12).count() == 21
