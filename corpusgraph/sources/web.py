"""Web inventories and fetch logs as tables.  Nothing here goes to the network: inputs are tables of what was fetched."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.functions import ids
from corpusgraph.functions import text as T
from corpusgraph.operators import graph
from corpusgraph.operators.common import ship

# The redirect codes, and limits of inventories.
REDIRECTS = (301, 302, 303, 307, 308)
CHILD_SITEMAPS, ENOUGH_URLS = 20, 2000
#: A line of a documentation inventory: name, domain:role, priority, address, shown name.  A domain has neither white
#: space nor a colon, so that a name that holds one isn't cut at it.
INVENTORY_LINE = r"(?m)^(.+?)\s+([^\s:]+):(\S+)\s+(-?\d+)\s+(\S+)\s+(.*)$"


def sitemap_urls(sitemaps: DataFrame, base: str) -> DataFrame:
    """(url) of page addresses on the site in sitemaps (url, body), each once."""
    locs = sitemaps.select(F.explode(F.regexp_extract_all("body", F.lit("<loc>([^<]+)</loc>"), 1)).alias("url"))
    return locs.where(~F.col("url").endswith(".xml") & ids.same_site(F.lit(base), F.col("url"))).distinct()


def sitemap_inventory(fetched: DataFrame, root: str, base: str, children: int = CHILD_SITEMAPS, enough: int = ENOUGH_URLS) -> DataFrame:
    """(url) of the page addresses that a site's sitemap ``root`` leads to, among fetched files (url, body).

    The first ``children`` child sitemaps in the order of the file are read, one after another until ``enough`` addresses
    are there: a child counts if those before it, with the root, have fewer.
    """
    top_ = fetched.where(F.col("url") == root).limit(1)
    line = top_.select(F.posexplode(F.array_distinct(F.regexp_extract_all("body", F.lit("<loc>([^<]+)</loc>"), 1))).alias("at", "url"))
    child = line.where(F.col("url").endswith(".xml")).orderBy("at").limit(children).withColumn("at", F.col("at") + 1)  # ``children`` rows at most
    files = top_.select(F.lit(0).alias("at"), "body").unionByName(fetched.join(F.broadcast(child), "url").select("at", "body").dropDuplicates(["at"]))
    found = files.select("at", F.explode(F.regexp_extract_all("body", F.lit("<loc>([^<]+)</loc>"), 1)).alias("url")).where(~F.col("url").endswith(".xml") & ids.same_site(F.lit(base), F.col("url")))
    first = found.groupBy("url").agg(F.min("at").alias("at"))
    each = first.groupBy("at").agg(F.count("*").alias("n"))  # a row for each of a few files
    line_ = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    read = each.withColumn("before", F.coalesce(F.sum("n").over(line_), F.lit(0))).where((F.col("at") == 0) | (F.col("before") < enough))
    return first.join(F.broadcast(read.select("at")), "at", "left_semi").select("url")


def child_sitemaps(sitemaps: DataFrame, most: int = CHILD_SITEMAPS) -> DataFrame:
    """Addresses of child sitemaps, the first ``most`` in order of their addresses."""
    locs = sitemaps.select(F.explode(F.regexp_extract_all("body", F.lit("<loc>([^<]+)</loc>"), 1)).alias("url"))
    return locs.where(F.col("url").endswith(".xml")).distinct().orderBy("url").limit(most)


def navtree_urls(scripts: DataFrame, base: str) -> DataFrame:
    """Page addresses in navigation index scripts (body)."""
    keys = scripts.select(F.explode(F.regexp_extract_all("body", F.lit('"([^"#]+\\.html)'), 1)).alias("k"))
    return keys.select(T.absolute_url(F.lit(base), F.col("k")).alias("url")).distinct()


def inventory_urls(blobs: DataFrame, base: str) -> DataFrame:
    """Page addresses in documentation inventories (content binary): four header lines, then a zlib stream of lines."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["content"]:
                try:
                    raw = bytes(raw)
                    if b"Sphinx inventory" not in raw[:200]:
                        continue
                    lines = zlib.decompress(raw.split(b"\n", 4)[4]).decode("utf-8", "replace")
                except (zlib.error, IndexError, TypeError):
                    continue
                for name, _, role, _, uri, _ in re.findall(INVENTORY_LINE, lines):
                    if role == "doc":
                        out.append(uri[:-1] + name if uri.endswith("$") else uri)
            yield pd.DataFrame({"uri": pd.Series(out, dtype=object)})

    uris = blobs.select("content").mapInPandas(read, "uri string")
    url = uris.select(T.absolute_url(F.lit(base), F.col("uri")).alias("url"))
    last = F.element_at(F.split(ids.path(F.col("url")), "/"), -1)
    return url.where(F.col("url").rlike(r"(?:\.html|/)$") | ~last.contains(".")).distinct()


def page_inventory(**sources: DataFrame) -> DataFrame:
    """(url, source) of the first of the named tables of addresses (url), in the order given, that has any row."""
    each = [s.select("url", F.lit(i).alias("prio"), F.lit(n).alias("source")) for i, (n, s) in enumerate(sources.items())]
    both = each[0]
    for e in each[1:]:
        both = both.union(e)
    return both.join(F.broadcast(both.agg(F.min("prio").alias("prio"))), "prio").select("url", "source").distinct()


def crawl(links: DataFrame, seed: str, base: str, depth: int, max_pages: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, depth) of a breadth-first crawl over links (s, t) between addresses on the site of ``base``.

    ``allowed`` (url) are the addresses that robots may read.  With ``max_pages`` the first pages in the order of the
    crawl stay: by depth, then by address.
    """
    on_site = links.where(ids.same_site(F.lit(base), F.col("t")))
    if allowed is not None:
        on_site = on_site.join(allowed.select(F.col("url").alias("t")).distinct(), "t", "left_semi").select("s", "t")
    found = graph.reach(on_site, links.sparkSession.createDataFrame([(seed,)], "id string"), depth)
    return found if max_pages is None else found.orderBy("depth", "id").limit(max_pages)


def followed(hops: DataFrame, base: str, most: int = 5) -> DataFrame:
    """(url, final_url, status, reason) of fetches (url, status, location, allowed), redirects followed by joins.

    Reasons: robots at the start, robots_redirect and offsite_redirect at a hop, too_many_hops; null if it ended.
    """
    hop = hops.select(F.col("url").alias("at"), "status", "location", "allowed").dropDuplicates(["at"])
    state = hops.select("url").distinct().select("url", F.col("url").alias("at"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("ended"), F.lit(None).cast("int").alias("code"))
    for i in range(most + 1):
        moves = F.col("status").isin(*REDIRECTS) & (F.coalesce("location", F.lit("")) != "")
        joined = state.join(hop, "at", "left")
        to = T.absolute_url(F.col("at"), F.col("location"))
        blocked = F.when(~F.coalesce("allowed", F.lit(True)), "robots" if i == 0 else "robots_redirect")
        if i:
            blocked = F.coalesce(blocked, F.when(~ids.same_site(F.lit(base), F.col("at")), F.lit("offsite_redirect")))
        open_ = ~F.col("ended") & F.col("reason").isNull()
        state = joined.select(
            "url",
            F.when(open_ & blocked.isNull() & moves, to).otherwise(F.col("at")).alias("at"),
            F.when(open_, blocked).otherwise(F.col("reason")).alias("reason"),
            (F.col("ended") | (open_ & blocked.isNull() & ~moves)).alias("ended"),
            F.when(open_ & blocked.isNull() & ~moves, F.col("status")).otherwise(F.col("code")).alias("code"),
        )
    last = F.when(~F.col("ended") & F.col("reason").isNull(), "too_many_hops").otherwise(F.col("reason"))
    return state.select("url", F.when(F.col("ended"), F.col("at")).alias("final_url"), F.col("code").alias("status"), last.alias("reason"))


def settled(fetches: DataFrame) -> DataFrame:
    """``fetches`` (ord, url, final_url, status, content_type, reason) with outcome: ``page``, or why there is none.

    Two addresses of one page give one page: the first in order, the other is redirect_merged.
    """
    ok = F.col("reason").isNull() & (F.col("status") == 200) & F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/html"))
    again = F.row_number().over(Window.partitionBy("final_url", ok).orderBy("ord")) > 1
    outcome = F.when(F.col("reason").isNotNull(), F.col("reason")).when(ok, F.when(again, F.lit("redirect_merged")).otherwise("page")).when(F.col("status") == 200, "not-html").otherwise(F.concat(F.lit("status:"), F.col("status").cast("string")))
    return fetches.withColumn("outcome", outcome)


def fetch_stats(done: DataFrame) -> DataFrame:
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


def root_of(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^(\w+://[^/?#]*)", 1), F.lit("/"))


def page_parts(pages: DataFrame) -> DataFrame:
    """(url, title, headings, text, markdown, hrefs) of pages (url, html), read from the element that holds the content.

    A null page is empty: its title is the last segment of the address.  Repeated rows give repeated rows.
    """
    ship(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusgraph.functions import pages as P

        for b in batches:
            rows = []
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root = P.parsed(html)
                name, found = P.title(root, url or ""), P.content(root)
                rows.append((url, name, P.headings(found), found.text(), P.markdown(found), P.links(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["url", "title", "headings", "text", "markdown", "hrefs"])

    kind = "url string, title string, headings array<string>, text string, markdown string, hrefs array<string>"
    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(read, kind)


def page_docs(pages: DataFrame, base: Column | None = None) -> DataFrame:
    """docs of pages (url, html): id and chapter from the address, the content as Markdown as the body."""
    parts = page_parts(pages)
    root = root_of(F.col("url")) if base is None else base
    d = parts.select(ids.page_id(root, F.col("url")).alias("id"), "title", "url", F.col("markdown").alias("body"))
    return d.select("id", ids.chapter(F.col("id")).alias("chapter"), "title", "url", F.sha2("body", 256).alias("sha"), "body")


def content_links(pages: DataFrame, base: Column | None = None) -> DataFrame:
    """(s, t) page ids of links in the content of pages (url, html) to other pages of the same site, each once."""
    each = page_parts(pages).select("url", F.explode("hrefs").alias("href")).where(T.allowed_href(F.col("href")))
    root = root_of(F.col("url")) if base is None else base
    full = F.regexp_replace(T.absolute_url(F.col("url"), F.regexp_replace("href", "#.*$", "")), r"[?#].*$", "")
    found = each.select(root.alias("root"), "url", full.alias("to")).where(ids.same_site(F.col("root"), F.col("to")))
    return found.select(ids.page_id(F.col("root"), F.col("url")).alias("s"), ids.page_id(F.col("root"), F.col("to")).alias("t")).where("s <> t").distinct()
