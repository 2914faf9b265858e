"""MinHash near-dedup with DartMinHash signatures.

Weighted elements are the five-word shingles of a document, their weight is how often they occur.  Over every unit of
weight of every element a Poisson process of rate 1 runs in time; its events are the *darts*, drawn from hashes of
(element, unit, number), so that all documents see the same darts.  A dart hits a document if it lies below the
element's weight.  Each of the k coordinates of the signature keeps the earliest dart that hits it: two documents agree
in a coordinate with probability sum(min)/sum(max), their weighted Jaccard similarity.  Only darts up to a time horizon
are thrown (k (ln k + 3) are expected, and the horizon is doubled until each coordinate has one), so that a document
costs one hash for each shingle and a few for each dart, not k for each shingle.

1. one pass over the texts: (doc_id, digest of the words, weight, band hashes); nothing else of the text is kept;
2. documents with the same words are one class with one representative (an aggregation with map-side combine);
3. representatives meet in bands.  In every bucket they are paired with one centre only, the member that collides most
   often: a group of n copies gives about n pairs instead of n(n-1)/2;
4. pairs are verified exactly on the whole texts; connected components are formed of those with similarity >= 0.8;
5. members of a bucket that are still in different components are looked at again, by how they differ from the bucket's
   centre: two of them can only be similar if their differences share many units, which a prefix filter over the rare
   ones with the places of both sides in it finds (see ``_linkable``).  What it finds is verified exactly.  No link
   between documents that share a bucket is lost, and pairs inside a component, which can't change it, are never made.

A centre's text goes once to each group of GROUP of its pairs, which are dealt by (centre, group), so that the pairs of
a hot centre are many tasks' work and no row holds two texts.

30 bands of 5 coordinates: a pair of similarity 0.8 shares no bucket with probability 7e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgraph.llm._common import cut, release, ship, small
from corpusgraph.llm.components import components, joined
from corpusgraph.llm.shingles import Rolled, mix, words_of

WIDTH, BANDS, ROWS, THRESHOLD = 5, 30, 5, 0.8
#: Pairs of a centre that are compared in one task.
GROUP = 128
#: Names of columns that stand beside those of a caller's table.
ID, HASH, TIMES = "__neardup_id", "__neardup_hash", "__neardup_times"
_GAP, _NAME, _UNIT = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def units_of(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the element, level) of each unit of weight of distinct elements."""
    if counts.max(initial=1) == 1:
        return mix(elements), np.arange(len(elements)), np.zeros(len(elements), np.int64)
    at = np.repeat(np.arange(len(elements)), counts)
    level = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(elements[at] + level.astype(np.uint64) * _UNIT), at, level


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Names of the earliest darts, one for each of k coordinates; ``elements`` are distinct 64-bit hashes."""
    key, at, level = units_of(elements, np.ceil(weights).astype(np.int64))
    room = weights[at] - level
    whole = bool((room >= 1).all())
    horizon = k * (log(k) + 3) / float(weights.sum())
    first = _uniform(key + _GAP)
    while True:
        hit = np.flatnonzero(first <= 1 - exp(-horizon))  # most units of a long text have no dart before the horizon
        own, t = key[hit], -np.log1p(-first[hit])
        # times of the units' further darts, as many columns as hardly any unit needs
        columns = int(horizon + 5 * horizon**0.5 + 4)
        name, when = [own[:, None]], [t[:, None]]
        done = 1
        while len(own):
            number = np.arange(done + 1, done + columns + 1, dtype=np.uint64)
            times = t[:, None] - np.cumsum(np.log1p(-_uniform(own[:, None] + number * _GAP)), 1)
            name.append(own[:, None] + (number - np.uint64(1)) * _NAME)
            when.append(times)
            more = times[:, -1] <= horizon
            if not more.any():
                break
            own, t, done = own[more], times[more, -1], done + columns
        names, times = np.concatenate([x.ravel() for x in name]), np.concatenate([x.ravel() for x in when])
        near = times <= horizon
        names, times = mix(names[near]), times[near]
        if not whole:  # units that the weight fills in part only
            names, times = _partly(key, room, k, horizon)
        order = np.argsort(-times, kind="stable")
        names = names[order]
        out, got = np.zeros(k, np.uint64), np.zeros(k, bool)
        at = ((names >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        out[at], got[at] = names, True  # the last one, which is the earliest, stays
        if got.all():
            return out
        horizon *= 2


def _partly(key: np.ndarray, room: np.ndarray, k: int, horizon: float) -> tuple[np.ndarray, np.ndarray]:
    """Darts (names, times) of units of which only the lower part ``room`` counts."""
    names, times, t, n = [], [], np.zeros(len(key)), 0
    while len(key):
        number = np.full(1, n, np.uint64)
        t = t - np.log1p(-_uniform(key + (number + np.uint64(1)) * _GAP))
        near = t <= horizon
        key, room, t = key[near], room[near], t[near]
        name = mix(key + number * _NAME)
        low = _uniform(name + _UNIT) < room
        names.append(name[low])
        times.append(t[low])
        n += 1
    return np.concatenate(names), np.concatenate(times)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * _UNIT
    for r in signature.reshape(bands, rows).T:
        h = mix(h * _NAME + r)
    return h.view(np.int64)


def _digest(words: list[str], raw: bytes, text: str) -> bytes:
    """Of the words, or of the text if it has none: equal digests mean similarity 1 or equal texts."""
    return hashlib.blake2b(raw if words else b"\0" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, th, digest, weight, bands) of each row of (doc_id, th, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, weights, hashes = [], [], []
            for t in b.column(2):
                text = t.as_py() or ""
                r = Rolled(words_of(text))
                digests.append(_digest(r.words, r.raw, text))
                e, n = np.unique(r.shingles(width), return_counts=True)
                weights.append(int(n.sum()))
                hashes.append(band_hashes(dart_signature(e, n.astype(np.float64), bands * rows), bands, rows) if len(e) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(weights, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "th", "digest", "weight", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, th long, digest binary, weight long, bands array<long>")


def _against(pairs: DataFrame, texts: DataFrame, width: int, schema: str, of) -> DataFrame:
    """``of(a, b, units of a, units of b)``, a row of ``schema`` or None, for each of the pairs (a, b); texts: (node, text).

    The pairs of a centre a are cut into groups of about GROUP.  Each group gets the centre's text once, as its first
    row, and then one text for each pair, so that a task holds two texts at a time.
    """
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("a", F.ceil(F.col("n") / GROUP).alias("groups"))
    dealt = pairs.join(small(cut(hot)), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("groups")), F.lit(0)).alias("part"))
    sides = dealt.select(F.col("b").alias("node"), "a", "part", F.lit(1).alias("side")).union(dealt.select(F.col("a").alias("node"), "a", "part", F.lit(0).alias("side")).distinct())
    rows = sides.join(texts, "node").select("a", "part", "side", F.col("node").alias("b"), "text").repartition("a", "part").sortWithinPartitions("a", "part", "side")
    kinds = pa.schema(pa.field(f.name, {"bigint": pa.int64(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.list_(pa.int64()))) for f in StructType.fromDDL(schema))

    def bag(text: str) -> np.ndarray:
        return np.sort(units_of(*np.unique(Rolled(words_of(text)).shingles(width), return_counts=True))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, np.zeros(0, np.uint64)
        for x in batches:
            out = []
            for a, part, side, b, text in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if side == 0:
                    group, centre = (a, part), bag(text)
                elif group != (a, part):
                    raise RuntimeError("pairs without their centre")
                else:
                    row = of(a, b, centre, bag(text))
                    if row is not None:
                        out.append(row)
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose similarity on the whole texts is ``threshold`` or more."""

    def linked(a: int, b: int, x: np.ndarray, y: np.ndarray) -> tuple | None:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return (a, b) if both / (len(x) + len(y) - both) >= threshold else None

    return _against(pairs, texts, width, "a long, b long", linked)


def _differences(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, size, removed, added, units): the size of a, how many units b lacks and adds, and these units."""

    def difference(a: int, b: int, x: np.ndarray, y: np.ndarray) -> tuple:
        less, more = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
        return a, b, len(x), len(less), len(more), np.concatenate([less, more]).view(np.int64)

    return _against(pairs, texts, width, "a long, b long, size long, removed long, added long, units array<long>", difference)


def _linkable(diff: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that may be similar, of documents with known differences from one centre and in different components.

    diff: (a, b, component, size, removed, added, units).  With R the units of the centre C that a document lacks, A those
    that it adds, and o the units that two differences have in common,
    sim(x, y) = (|C| - |Rx| - |Ry| + o) / (|C| + |Ax| + |Ay| - o).  Let g = t |A| + |R| for threshold t: sim(x, y) >= t
    asks for o >= (gx + gy - (1 - t) |C|) / (1 + t), and a document is linked to the centre iff g <= (1 - t) |C|.  Documents
    linked to it are in its component, so of a pair to be found the one with the larger g is *far*: not linked to it.

    A unit can only be common to a pair if a far document has it, another one too, and not all in one component.  Such
    units are put in one order for the centre, rarest first.  If a pair's first common unit is at place i of the c units
    of x and at place j of the d units of y, then o <= min(c - i, d - j).  So each side has a largest g that the other one
    may have at that place, and both must allow it.
    """
    d = diff.withColumn("far", F.col("added") * threshold + F.col("removed") > (1 - threshold) * F.col("size") + 1e-9)
    d = d.withColumn("g", threshold * F.col("added") + F.col("removed"))
    # centres without a far document have no pair to look for
    bounds = cut(d.groupBy("a").agg(F.min("g").alias("g_low"), F.max(F.when(F.col("far"), F.col("g"))).alias("g_high")).where("g_high IS NOT NULL"))
    d = d.join(small(bounds), "a")
    d = d.withColumn("room", (1 - threshold) * F.col("size") - F.col("g") + 1e-6)
    unit = d.select("a", F.col("b").alias("x"), "component", "far", "g", "g_low", "g_high", "room", F.explode("units").alias("u"))
    often = unit.groupBy("a", "u").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n > 1 AND n_far > 0 AND lo <> hi").select("a", "u", "n")
    listed = unit.join(often, ["a", "u"]).groupBy("a", "x", "component", "far", "g", "g_low", "g_high", "room").agg(F.sort_array(F.collect_list(F.struct("n", "u"))).alias("us"))
    placed = listed.select("a", "x", "component", "far", "g", "g_low", "g_high", "room", F.size("us").alias("c"), F.posexplode("us").alias("i", "s"))
    placed = placed.select("a", "x", "component", "far", "g", "g_low", "g_high", F.col("s.u").alias("u"), ((1 + threshold) * (F.col("c") - F.col("i")) + F.col("room")).alias("most"))
    placed = cut(placed.where("most >= g_low"))
    # the one with the smaller g looks up far ones with a g between its own and the most that its place allows
    look = placed.where("most >= g AND g <= g_high").select("a", "u", "x", F.col("component").alias("cx"), F.col("g").alias("gx"), F.col("most").alias("most_x"))
    held = placed.where("far").select("a", "u", F.col("x").alias("y"), F.col("component").alias("cy"), F.col("g").alias("gy"), F.col("most").alias("most_y"))
    met = look.join(held, ["a", "u"]).where("cx <> cy AND gy >= gx AND gy <= most_x AND gx <= most_y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _classes(df: DataFrame, id_col: str, text: str, width: int, bands: int, rows: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, class_id) of ``df`` with an id, th a hash of the text, and the (doc_id, th) that stands for each class."""
    docs = df.select(F.col(id_col).try_cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    sig = cut(signatures(docs, width, bands, rows))
    # texts of the same words are one node; it is represented by its smallest (id, hash), as one id may have several texts
    reps = sig.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    sig = sig.select("doc_id", "th", "digest")

    member = reps.select("node", "weight", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(member.join(shared, "bucket"))
    busy = met.groupBy("node").agg(F.sum(F.col("n") - 1).alias("busy"))
    centre = met.join(busy, "node").groupBy("bucket").agg(F.max(F.struct("busy", "node", "weight")).alias("c"))
    star = cut(met.join(centre, "bucket").select("bucket", "node", F.col("c.node").alias("a"), (F.least("weight", "c.weight") / F.greatest("weight", "c.weight")).alias("bound")))
    pairs = star.where((F.col("node") != F.col("a")) & (F.col("bound") >= threshold)).select("a", F.col("node").alias("b")).distinct()
    wanted = reps.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"))
    texts = cut(docs.join(small(wanted), ["doc_id", "th"]).groupBy("node").agg(F.first("text").alias("text")))
    release(met)
    links = cut(_verified(cut(pairs), texts, width, threshold))
    label = components(links)

    # what is left: members of one bucket, other than its centre, in different components
    part = F.coalesce("component", "node").alias("component")
    near = star.select("bucket", "a", "node").join(label, "node", "left").select("bucket", "a", "node", part)
    split = near.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n > 2 AND lo <> hi").select("bucket")
    open_ = cut(near.join(split, "bucket", "left_semi").where("a <> node").select("a", F.col("node").alias("b"), "component").distinct())
    release(star)
    diff = cut(_differences(open_.select("a", "b"), texts, width).join(open_, ["a", "b"]))
    more = cut(_verified(cut(_linkable(diff, threshold)), texts, width, threshold))
    release(texts, diff, open_)
    if not more.isEmpty():
        label = joined(label, more)

    own = reps.select("node", "digest", "rep").join(label, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    first = own.groupBy("component").agg(F.min("rep").alias("first"))
    of = own.join(small(cut(first)), "component").select("digest", F.col("first.doc_id").alias("class_id"))
    return sig.join(of, "digest").select("doc_id", "th", "class_id"), first.select("first.doc_id", "first.th")


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): one row per row of ``df``; class_id is the smallest id of the near-duplicate class.

    Null texts count as empty.  Texts without words are alike only if they are equal.  A text of fewer than ``width``
    words has one shingle of all its words.  Different texts of one id are compared each by itself and may get different
    classes.  A row without an id, or with one that isn't a number, gets the id and the class null and is compared with
    nothing.  Repeated rows get equal rows.  Other columns are not read.  An empty table gives an empty table.
    """
    known, _ = _classes(df, id_col, text, width, bands, rows, threshold)
    none = F.lit(None).cast("long")
    id_ = F.col(id_col).try_cast("long")
    return known.select("doc_id", "class_id").unionByName(df.where(id_.isNull()).select(none.alias("doc_id"), none.alias("class_id")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``df`` for each class, that of the smallest id; rows without an id stay.

    Of repeated rows (same id and text) one stays, and of the texts of one id those that stand for a class.  The columns
    are those of ``df``.
    """
    known, first = _classes(df, id_col, text, width, bands, rows, threshold)
    often = known.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    one = first.join(often, ["doc_id", "th"]).select(F.col("doc_id").alias(ID), F.col("th").alias(HASH), F.col("n").alias(TIMES))
    id_, th = F.col(id_col).try_cast("long"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    kept = cut(one)
    rows_ = df.where(id_.isNotNull()).join(small(kept), (id_ == F.col(ID)) & (th == F.col(HASH)))
    out = rows_.where(F.col(TIMES) == 1)
    if not kept.where(F.col(TIMES) > 1).isEmpty():  # only repeated rows are shuffled to be made one
        out = out.unionByName(rows_.where(F.col(TIMES) > 1).dropDuplicates([ID, HASH]))
    return out.select(*df.columns).unionByName(df.where(id_.isNull()))
