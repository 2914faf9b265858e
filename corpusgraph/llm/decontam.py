"""Benchmark decontamination by greedy string tiling.

Runs of ``seed`` words that a document shares with a benchmark item (Karp-Rabin hashes, found by binary search in the
items' hashes) join documents to items.  For each such pair the longest match of unmarked words is marked as a tile,
again and again, until no match of ``seed`` words is left; its words are compared, not just hashes.  Tiles needn't keep
their order, so passages that were reordered count as well.  A document is contaminated by an item if its tiles cover at
least ``coverage`` of the item's words.

Of equally long matches the first in the document is taken, then the first in the item.

The items are taken in blocks of a bounded number of words (a stated set of queries against all rows).  A block goes to
the executors as a broadcast of bounded size, and if there are several each has its own pass over the documents.
Documents stay where they are: no shuffle of texts.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm._common import cut, ship, small, unused
from corpusgraph.llm.shingles import Rolled, words_of

SEED, COVERAGE = 5, 0.5
#: Words of the items of one block; with their hashes about 100 bytes each on the driver and in every worker.
BLOCK_WORDS = 1_000_000


class ItemIndex:
    """Hashes of the items' runs of words: ``seed`` long, or as long as the item if it is shorter."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int) -> None:
        self.seed, self.ids, self.words, self.part = seed, [], [], {}
        rows: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item, text in items:
            r = Rolled(words_of(text))
            if r.words:
                n = min(seed, len(r.words))
                rows[n].append((r.runs(n), len(self.ids)))
                self.ids.append(item)
                self.words.append(r.words)
        for n, got in rows.items():
            h = np.concatenate([x for x, _ in got])
            which = np.concatenate([np.full(len(x), i) for x, i in got])
            at = np.concatenate([np.arange(len(x)) for x, _ in got])
            order = np.argsort(h, kind="stable")
            self.part[n] = (h[order], which[order], at[order])

    def coverage(self, text: str) -> dict[int | None, float]:
        """Share of each item's words that tiles of the text cover, for item ids with a shared seed: the best of an id."""
        out: dict[int | None, float] = {}
        for i, c in self.by_number(text).items():
            out[self.ids[i]] = max(c, out.get(self.ids[i], 0.0))
        return out

    def by_number(self, text: str) -> dict[int, float]:
        """The same for each item by its place in ``ids``, so that items without an id stay apart."""
        r, out = Rolled(words_of(text)), {}
        for n, (hashes, which, at) in self.part.items():
            own = r.runs(n)
            left = np.searchsorted(hashes, own, "left")
            hit = np.flatnonzero((left < len(hashes)) & (hashes[np.minimum(left, len(hashes) - 1)] == own))
            if not len(hit):
                continue
            right = np.searchsorted(hashes, own[hit], "right")
            seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for d, a, b in zip(hit.tolist(), left[hit].tolist(), right.tolist(), strict=True):
                for k in range(a, b):
                    seeds[which[k]].append((d, int(at[k])))
            for i, places in seeds.items():
                words = self.words[i]
                out[int(i)] = tiled(r.words, words, places, n) / len(words)
        return out


def tiled(text: list[str], item: list[str], places: list[tuple[int, int]], least: int) -> int:
    """Words of ``item`` under greedy tiles; places: (text, item) positions where runs of ``least`` words have one hash."""
    heap: list[tuple[int, int, int]] = []
    places = sorted(places, key=lambda p: (p[0] - p[1], p[0]))
    k = 0
    while k < len(places):
        d, i = places[k]
        k += 1
        last = d
        while k < len(places) and places[k][0] - places[k][1] == d - i and places[k][0] == last + 1:
            last += 1
            k += 1
        n = last - d + least
        if text[d : d + n] == item[i : i + n]:
            heap.append((-n, d, i))
    heapq.heapify(heap)
    in_text, in_item, covered = bytearray(len(text)), bytearray(len(item)), 0
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        begin = 0
        free = []
        for j in range(n + 1):
            if j == n or in_text[d + j] or in_item[i + j]:
                if j - begin >= least:
                    free.append((begin, j))
                begin = j + 1
        if free == [(0, n)]:
            in_text[d : d + n] = in_item[i : i + n] = b"\1" * n
            covered += n
        else:
            for a, b in free:
                heapq.heappush(heap, (a - b, d + a, i + a))
    return covered


def _blocks(items: DataFrame, id_col: str, text: str, words: int, unnamed: bool) -> tuple[int, Iterator[list[tuple[int | None, str]]]]:
    """How many blocks of at most about ``words`` words (at least one item) the items make, and the blocks.

    Items without a text are left out, and those without an id unless ``unnamed`` is set.
    """
    items = items.select(F.col(id_col).try_cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    items = items if unnamed else items.where("i IS NOT NULL")
    chars = items.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n = int(chars // (2 * words)) + 1  # a word has two characters at least, with what separates it
    return n, ([(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n))


def _by_block(docs: DataFrame, index) -> DataFrame:
    """(doc_id, h1, h2, n_words, matches) of rows (doc_id, h1, h2, text) for the items of a broadcast index."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found = [], []
            for t in b.column(3).to_pylist():
                got: dict[int, float] = {}
                unnamed: list[float] = []
                for k, c in index.value.by_number(t).items():
                    if (i := index.value.ids[k]) is None:
                        unnamed.append(c)
                    else:
                        got[i] = max(c, got.get(i, 0.0))
                n.append(len(words_of(t)))
                found.append([{"item_id": i, "coverage": c} for i, c in [*sorted(got.items()), *((None, c) for c in sorted(unnamed))]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(found, kind)], names=["doc_id", "h1", "h2", "n_words", "matches"])

    return docs.mapInArrow(run, "doc_id long, h1 long, h2 int, n_words long, matches array<struct<item_id:long,coverage:double>>")


def _passes(docs: DataFrame, blocks: Iterator, seed: int) -> Iterator[DataFrame]:
    """One pass over the documents for each block, cut before the block's index is dropped everywhere."""
    for block in blocks:
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, seed))
        yield cut(_by_block(docs, index))
        index.destroy()


def matches(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, block_words: int = BLOCK_WORDS, unnamed: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, and matches, an array of (item_id, coverage) with a shared seed.

    Null texts count as empty: no words, no matches.  Items without words match nothing.  An item id with several texts
    has the best coverage of them.  With ``unnamed``, items without an id count each by itself, with a null item_id, after
    the others.  A null id, or one that isn't a number, gives a null id.  Repeated rows give repeated rows.  Other columns
    aren't read.  Empty tables give no rows, or no matches.

    Items of more than ``block_words`` words are taken block by block, each in a pass of its own over the documents, so
    that the driver and every worker hold one block at a time.
    """
    ship(df.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).try_cast("long").alias("doc_id"), F.xxhash64(t).alias("h1"), F.hash(t).alias("h2"), t.alias("text"))
    n, blocks = _blocks(items, item_id, item_text, block_words, unnamed)
    if n == 1:
        return _by_block(docs, df.sparkSession.sparkContext.broadcast(ItemIndex(next(blocks), seed))).select("doc_id", "n_words", "matches")
    first, *others = _passes(docs, blocks, seed)
    # matches are a text's, so that rows of one text have the same ones
    each = [p.where(F.size("matches") > 0).select("h1", "h2", "matches").dropDuplicates(["h1", "h2"]).select("h1", "h2", F.lit(k).alias("k"), F.posexplode("matches").alias("at", "m")) for k, p in enumerate([first, *others])]
    found = each[0]
    for e in each[1:]:
        found = found.unionByName(e)
    alone = F.when(F.col("m.item_id").isNull(), F.struct("k", "at"))
    best = found.groupBy("h1", "h2", F.col("m.item_id").alias("item_id"), alone.alias("alone")).agg(F.max("m.coverage").alias("coverage"))
    line = F.sort_array(F.collect_list(F.struct(F.col("item_id").isNull().alias("last"), "item_id", "coverage")))
    all_ = best.groupBy("h1", "h2").agg(F.transform(line, lambda m: F.struct(m["item_id"].alias("item_id"), m["coverage"].alias("coverage"))).alias("all"))
    none = F.array().cast("array<struct<item_id:bigint,coverage:double>>")
    return first.join(all_, ["h1", "h2"], "left").select("doc_id", "n_words", F.coalesce("all", none).alias("matches"))


def report(df: DataFrame, items: DataFrame, coverage: float = COVERAGE, **options) -> DataFrame:
    """doc_id, n_words, n_items and item_ids that contaminate it, max_coverage (0 without a seed), contaminated.

    Nulls, repeated rows and empty tables are treated as in ``matches``.
    """
    hit = F.filter("matches", lambda m: m["coverage"] >= coverage)
    return matches(df, items, **options).select(
        "doc_id", "n_words",
        F.size(hit).cast("long").alias("n_items"),
        F.transform(hit, lambda m: m["item_id"]).alias("item_ids"),
        F.coalesce(F.round(F.array_max(F.transform("matches", lambda m: m["coverage"])), 6), F.lit(0.0)).alias("max_coverage"),
        (F.size(hit) > 0).alias("contaminated"),
    )


def clean(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, unnamed: bool = False) -> DataFrame:
    """The rows of ``df`` that no item contaminates, with all their columns; a row is judged by its text alone.

    ``unnamed`` takes the items without an id too.  A null or empty text stays; repeated rows stay or go together; without
    items all rows stay.  Items in several blocks make one pass each, as in ``matches``.
    """
    ship(df.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n, blocks = _blocks(items, item_id, item_text, block_words, unnamed)
    if n == 1:
        index = df.sparkSession.sparkContext.broadcast(ItemIndex(next(blocks), seed))

        @F.pandas_udf("boolean")
        def bad(texts):
            import pandas as pd

            return pd.Series([any(c >= coverage for c in index.value.coverage(t or "").values()) for t in texts], dtype=bool)

        return df.where(~bad(t))
    docs = df.select(F.lit(None).cast("long").alias("doc_id"), F.xxhash64(t).alias("h1"), F.hash(t).alias("h2"), t.alias("text"))
    gone = None
    for p in _passes(docs, blocks, seed):
        hit = p.where(F.exists("matches", lambda m: m["coverage"] >= coverage)).select("h1", "h2")
        gone = hit if gone is None else gone.union(hit)
    h1, h2 = unused(df, "bad_h1", "bad_h2")
    gone = cut(gone.distinct().toDF(h1, h2))
    return df.join(small(gone), (F.xxhash64(t) == F.col(h1)) & (F.hash(t) == F.col(h2)), "left_anti")
