"""From a folder or a table of pages to a stored, searchable site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.config import DEFAULT, Config
from corpusgraph.functions import ids
from corpusgraph.operators.common import cut
from corpusgraph.plans.build import Graph, build_graph
from corpusgraph.sources import files as tree
from corpusgraph.sources import web
from corpusgraph.store import Store

# Bounds of what a caller may ask for.
MOST, FILES, PAGES, DEPTH, DEEPEST = 100_000, 2000, 200, 4, 32


def _clamped(n: int, most: int) -> int:
    return max(1, min(n, most))


def site_of(spark: SparkSession, url: str) -> str:
    return spark.range(1).select(ids.site_id(F.lit(url)).alias("s")).first()["s"]


def _kept(store: Store, site_id: str, url: str, docs: DataFrame, evidence: DataFrame, relations: str | None, cfg: Config, **models: DataFrame | None) -> tuple[Graph, dict]:
    with store.lock(site_id):
        g = build_graph(docs, evidence, relations, cfg, **models)
        meta = store.save(site_id, url, g.nodes, g.edges, g.postings, docs, g.report)
        g.release()
        return g, meta


def ingest_files(store: Store, files: DataFrame, root: str, max_files: int = FILES, ignore: str = "", relations: str | None = None, exempt: tuple[str, ...] = (), cfg: Config = DEFAULT) -> dict:
    """Store the site of a tree of files (relpath, size, is_symlink, head, content); ``ignore`` holds the lines of an ignore file.

    Returns ok, site_id, scan_stats (files by the reason why they are left out) and the site's meta, or ok False and why.
    """
    spark = store.spark
    ignored = tree.ignored_by(ignore) if ignore.strip() else None
    scan = cut(tree.scanned(files, _clamped(max_files, MOST), ignored, exempt).select("relpath", "lang", "skip", "content"))
    stats = {r["skip"]: r["n"] for r in tree.scan_stats(scan).collect()}  # a row for each reason
    source = f"file://{root.rstrip('/')}"
    if not stats.get("kept"):
        return {"ok": False, "error": "no document or source file found", "root": root, "scan_stats": stats}
    use = scan.where("skip IS NULL").select("relpath", "lang", F.decode("content", "UTF-8").alias("content"))
    site_id = site_of(spark, source)
    docs = cut(tree.tree_docs(use, root.rstrip("/")))
    g, meta = _kept(store, site_id, source, docs, tree.tree_edges(use), relations, cfg)
    return {"ok": True, "scan_stats": stats, "root": root, "notes": list(g.notes), **meta}


def ingest_local(store: Store, path: str, max_files: int = FILES, respect_gitignore: bool = True, relations: str | None = None, exempt: tuple[str, ...] = (), cfg: Config = DEFAULT) -> dict:
    """Store the site of a folder that Spark's readers reach.  The ignore file of its root counts, if there is one."""
    fs, where = store._fs(path)
    if not fs.exists(where):
        return {"ok": False, "error": f"no such folder: {path}"}
    if not fs.getFileStatus(where).isDirectory():
        return {"ok": False, "error": f"{path} is a file; name its folder"}
    root = str(fs.resolvePath(where).toUri().getPath())
    ignore = (store._get(f"{path.rstrip('/')}/.gitignore") or "") if respect_gitignore else ""
    return ingest_files(store, tree.read_tree(store.spark, path), root, max_files, ignore, relations, exempt, cfg)


def ingest_pages(store: Store, pages: DataFrame, url: str, max_pages: int = PAGES, max_depth: int = DEPTH, relations: str | None = None, links: DataFrame | None = None, cfg: Config = DEFAULT, **models: DataFrame | None) -> dict:
    """Store the site ``url`` from a table of fetched pages (url, html).

    With ``links`` (s, t), addresses, the pages within ``max_depth`` steps of ``url`` are taken, else all of the site; the
    first ``max_pages`` of them, by depth and address.  ``seed_hint`` says when hardly any page was found.
    """
    spark = store.spark
    on_site = pages.where(ids.same_site(F.lit(url), F.col("url"))).dropDuplicates(["url"])
    most = _clamped(max_pages, MOST)
    if links is not None:
        reached = web.crawl(links, url, url, _clamped(max_depth, DEEPEST), most).select(F.col("id").alias("url"))
        on_site = on_site.join(reached, "url", "left_semi")
    else:
        on_site = on_site.orderBy("url").limit(most)
    use = cut(on_site.select("url", "html"))
    n = use.count()
    hint = {"seed_hint": "hardly any page was found: the address may be that of a section; try the root of the documentation"} if n <= 2 else {}
    if not n:
        return {"ok": False, "error": "no page found", "url": url, **hint}
    base = F.lit(url)
    # of pages with one id the first address counts
    docs = cut(web.page_docs(use, base).withColumn("__first", F.min("url").over(_by("id"))).where("url = __first").drop("__first"))
    known = docs.select("id")
    found = web.content_links(use, base).join(known.withColumnRenamed("id", "t"), "t", "left_semi").join(known.withColumnRenamed("id", "s"), "s", "left_semi")
    evidence = found.select("s", "t", F.when(F.col("s") == "index", "hub").when(F.col("s").endswith("_index"), "contains").otherwise("ref").alias("k"))
    g, meta = _kept(store, site_of(spark, url), url, docs, evidence, relations, cfg, **models)
    return {"ok": True, "fetched": n, "notes": list(g.notes), **hint, **meta}


def _by(column: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(column)
