"""View data: build phases, and archives of sites.

An archive is what a viewer loads whole: one string for a site, the Base64 of a gzip stream that holds named Arrow tables
(nodes, edges, and optionally layout and timeline).  Sites are archived side by side, one group of rows each.
"""

from __future__ import annotations

import base64
import gzip
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.config import DERIVED_KINDS, EVIDENCE_KINDS
from corpusgraph.operators.index import numbered

ORDER = (*EVIDENCE_KINDS, *DERIVED_KINDS)


def _phases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, count, t0, dur), not rounded.  The table of kinds is closed, so the running sum is over a few rows."""
    corpus = nodes.agg(F.count("*").alias("count")).select(F.lit("CORPUS").alias("name"), "count", F.lit(-1).alias("pos"), F.least(F.lit(10.0), F.greatest(F.lit(1.2), F.col("count") / 2500)).alias("dur"))
    pos = F.array_position(F.array(*map(F.lit, ORDER)), F.col("k")).cast("int")
    kinds = edges.groupBy("k").agg(F.count("*").alias("count")).select(F.col("k").alias("name"), "count", F.when(pos == 0, 99).otherwise(pos).alias("pos"), F.least(F.lit(14.0), F.greatest(F.lit(0.4), F.col("count") / 1500)).alias("dur"))
    t0 = F.coalesce(F.sum("dur").over(Window.orderBy("pos", "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return corpus.union(kinds).select("name", "count", t0.alias("t0"), "dur")


def build_phases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, count, t0, dur): the corpus phase and one phase for each kind of edge, one after another."""
    return _phases(nodes, edges).select("name", "count", F.round("t0", 4).alias("t0"), F.round("dur", 4).alias("dur"))


def edge_births(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, t, k, birth): when each edge appears, the edges of a kind evenly through its phase in the order of their ends.

    Edges are numbered by ranges of (kind, ends), so a kind of any size is many tasks' work.
    """
    line = numbered(edges.select("s", "t", "k").withColumn("o", F.struct("k", "s", "t")), "o")
    first = line.groupBy("k").agg(F.min("__i").alias("first"))  # a row for each kind, as the phases have
    phase = _phases(nodes, edges).select(F.col("name").alias("k"), "count", "t0", "dur")
    at = F.col("t0") + (F.col("__i") - F.col("first") + 1) / F.col("count") * F.col("dur")
    return line.join(F.broadcast(first), "k").join(F.broadcast(phase), "k").select("s", "t", "k", F.round(at, 4).alias("birth"))


# Fixed values of a town: a floor's height, least and most floors, what rank and degree add, and how much is lit.
FLOOR, FLOORS, BASE, BY_RANK, BY_DEGREE = 0.62, (3, 30), 1.2, 14.2, 3.2
LIT, LIT_FAN, LIT_WORDS, LIT_ALONE, LIT_ALONE_WORDS = 0.06, 0.20, 0.28, 0.02, 0.12


def towers(nodes: DataFrame) -> DataFrame:
    """(id, floors, height, lit) of nodes (id, r, degree, kids, words): a page as a tower, as high as its rank and degree
    against the largest ones, lit by its words and the links it sends."""
    most = nodes.agg(*[F.greatest(F.max(c), F.lit(least)).alias(f"max_{c}") for c, least in (("r", 1e-9), ("degree", 1), ("kids", 1), ("words", 1))])  # one row
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col(f"max_{c}")))
    high = F.round((BASE + BY_RANK * F.sqrt(part("r")) + BY_DEGREE * F.sqrt(part("degree"))) / FLOOR).cast("int")
    floors = F.greatest(F.lit(FLOORS[0]), F.least(F.lit(FLOORS[1]), high))
    volume = F.sqrt(part("words"))
    lit = F.when(F.col("kids") > 0, LIT + LIT_FAN * F.sqrt(part("kids")) + LIT_WORDS * volume).otherwise(LIT_ALONE + LIT_ALONE_WORDS * volume)
    return nodes.crossJoin(F.broadcast(most)).select("id", floors.alias("floors"), F.round(floors * FLOOR, 6).alias("height"), F.round(lit, 6).alias("lit"))


#: Version of the container, and the tables that an archive may have with the columns that each must have.
VERSION = 1
PARTS = {
    "nodes": {"i": pa.string(), "t": pa.string(), "u": pa.string(), "c": pa.string(), "g": pa.int64(), "r": pa.float64(), "w": pa.int64()},
    "edges": {"s": pa.string(), "t": pa.string(), "k": pa.string()},
    "layout": {"i": pa.string(), "x": pa.int16(), "y": pa.int16(), "z": pa.int16()},
    "timeline": {"batch": pa.int64(), "seq": pa.int64(), "node_start": pa.int64(), "edge_start": pa.int64(), "n_node": pa.int64(), "n_edge": pa.int64()},
}


def fnv32(data: bytes) -> int:
    """FNV-1a, 32 bits."""
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % (1 << 32)
    return h


def _checked(parts: dict[str, pa.Table]) -> dict[str, pa.Table]:
    """The tables with their fixed columns in their order; a ValueError for what no archive may hold."""
    out = {}
    for name, columns in PARTS.items():
        if name in parts:
            if missing := [c for c in columns if c not in parts[name].column_names]:
                raise ValueError(f"{name} without {', '.join(missing)}")
            out[name] = parts[name].select(list(columns)).cast(pa.schema(list(columns.items()))).combine_chunks()
    if unknown := set(parts) - set(PARTS):
        raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
    if not {"nodes", "edges"} <= set(out):
        raise ValueError("an archive has nodes and edges")
    ids = out["nodes"]["i"]
    if ids.null_count or pc.count_distinct(ids).as_py() < len(ids):
        raise ValueError("a node id is missing or there twice")
    ends = [out["edges"][c] for c in ("s", "t")] + ([out["layout"]["i"]] if "layout" in out else [])
    if not all(pc.all(pc.is_in(e, value_set=ids.combine_chunks())).as_py() is not False for e in ends):
        raise ValueError("an edge or a place of an unknown node")
    return out


def pack(**parts: pa.Table) -> str:
    """The tables of one site as a string; equal tables give equal strings."""
    sink = pa.BufferOutputStream()
    for name, table in _checked(parts).items():
        meta = {b"part": name.encode(), b"version": str(VERSION).encode()}
        # ends of edges, chapters and kinds repeat, so they are kept as numbers into a list of their values
        coded = pa.table({c: pc.dictionary_encode(table[c]) if pa.types.is_string(table[c].type) else table[c] for c in table.column_names})
        with pa.ipc.new_stream(sink, coded.schema.with_metadata(meta)) as writer:
            writer.write_table(coded)
    body = sink.getvalue().to_pybytes()
    head = json.dumps({"bytes": len(body), "mark": fnv32(body)}).encode() + b"\n"
    return base64.b64encode(gzip.compress(head + body, 9, mtime=0)).decode()


def unpack(text: str) -> dict[str, pa.Table]:
    """The tables of an archive; a ValueError for anything that ``pack`` didn't write whole."""
    try:
        head, _, body = gzip.decompress(base64.b64decode(text, validate=True)).partition(b"\n")
        stated = json.loads(head)
        if stated["bytes"] != len(body) or stated["mark"] != fnv32(body):
            raise ValueError("the archive is damaged")
        source, parts = pa.BufferReader(body), {}
        while source.tell() < len(body):
            table = pa.ipc.open_stream(source).read_all()
            meta = table.schema.metadata or {}
            if meta.get(b"version") != str(VERSION).encode():
                raise ValueError("an archive of another version")
            plain = {c: table[c].cast(pa.string()) if pa.types.is_dictionary(table[c].type) else table[c] for c in table.column_names}
            parts[meta[b"part"].decode()] = pa.table(plain)
    except (EOFError, KeyError, OSError, TypeError, UnicodeDecodeError, pa.ArrowInvalid) as e:
        raise ValueError("not an archive") from e
    return _checked(parts)


def archives(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, archive) of nodes (site_id, i, t, u, c, g, r, w) and edges (site_id, s, t, k), one string for each site.

    A site is one group of rows, as a viewer loads it whole.  Rows are put in order, so that a site's string doesn't
    depend on how its rows were dealt.
    """

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        text = pack(nodes=left.drop_columns("site_id").sort_by("i"), edges=right.drop_columns("site_id").sort_by([(c, "ascending") for c in ("s", "t", "k")]))
        return pa.table({"site_id": pa.array([key[0].as_py()], pa.string()), "archive": pa.array([text])})

    n = nodes.select(F.col("site_id").cast("string").alias("site_id"), *[F.col(c).cast({pa.int64(): "long", pa.float64(): "double"}.get(t, "string")).alias(c) for c, t in PARTS["nodes"].items()])
    e = edges.select(F.col("site_id").cast("string").alias("site_id"), *[F.col(c).cast("string").alias(c) for c in PARTS["edges"]])
    return n.groupBy("site_id").cogroup(e.groupBy("site_id")).applyInArrow(one, "site_id string, archive string")
