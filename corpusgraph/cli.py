"""Command line: ``python -m corpusgraph.cli <command> --store FOLDER ...``; every command prints one JSON value."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from corpusgraph.plans import ingest
from corpusgraph.store import Store


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _ingest(store: Store, a: argparse.Namespace) -> dict:
    pages = store.spark.read.parquet(a.pages)
    return ingest.ingest_pages(store, pages, a.url, a.max_pages, a.max_depth, a.relations)


def _stats(store: Store, a: argparse.Namespace) -> dict:
    meta, top = store.site_stats(a.site)
    return _rows(meta)[0] | {"top": _rows(top)}


def _neighbours(store: Store, a: argparse.Namespace) -> dict:
    nodes, edges = store.neighbours(a.site, a.page, a.depth)
    return {"nodes": _rows(nodes.orderBy("hop", "i")), "edges": _rows(edges.orderBy("s", "t"))}


COMMANDS: dict[str, tuple[str, Callable[[Store, argparse.Namespace], object], tuple[tuple[str, dict], ...]]] = {
    "ingest": ("store a site from a Parquet table of pages (url, html)", _ingest, (("url", {}), ("--pages", {"required": True}), ("--max-pages", {"type": int, "default": ingest.PAGES}), ("--max-depth", {"type": int, "default": ingest.DEPTH}), ("--relations", {}))),
    "ingest-local": (
        "store a site from a folder", lambda s, a: ingest.ingest_local(s, a.path, a.max_files, not a.no_gitignore, a.relations, tuple(a.exempt)),
        (("path", {}), ("--max-files", {"type": int, "default": ingest.FILES}), ("--no-gitignore", {"action": "store_true"}), ("--relations", {}), ("--exempt", {"action": "append", "default": []})),
    ),
    "sites": ("list the sites", lambda s, a: _rows(s.list_sites()), ()),
    "stats": ("a site and its nodes with most edges", _stats, (("site", {}),)),
    "search": ("the best pages for some words", lambda s, a: _rows(s.search(a.site, a.query, a.limit)), (("site", {}), ("query", {}), ("--limit", {"type": int, "default": 10}))),
    "page": ("a page", lambda s, a: _rows(s.get_page(a.site, a.page)), (("site", {}), ("page", {}))),
    "neighbours": ("pages around a page", _neighbours, (("site", {}), ("page", {}), ("--depth", {"type": int, "default": 1, "choices": (1, 2)}))),
    "ask": ("the pages that answer a question", lambda s, a: s.ask(a.site, a.question, top_k=a.top), (("site", {}), ("question", {}), ("--top", {"type": int, "default": 4}))),
    "graph": ("the whole graph of a site", lambda s, a: json.loads(s.graph_json(a.site)), (("site", {}),)),
    "reset": ("forget a site", lambda s, a: s.reset(a.site), (("site", {}),)),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusgraph")
    p.add_argument("--store", required=True, help="folder of the sites, in any file system that Spark reaches")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (about, _, arguments) in COMMANDS.items():
        c = sub.add_parser(name, help=about)
        for flag, options in arguments:
            c.add_argument(flag, **options)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    store = Store(spark or SparkSession.builder.appName("corpusgraph").getOrCreate(), a.store.rstrip("/"))
    try:
        out = COMMANDS[a.command][1](store, a)
    except (ValueError, TimeoutError) as e:
        out = {"ok": False, "error": str(e)}
    print(json.dumps(out, ensure_ascii=False, default=str))
    return int(isinstance(out, dict) and out.get("ok") is False)


if __name__ == "__main__":
    sys.exit(main())
