"""Token counts with offset-mapped attribution to the sections or fields of a document.

A whole document is encoded once by a byte-level BPE, whose tokens' bytes, joined, are the text: the running sum of the
tokens' lengths gives each token its span.  Sections are spans of code points; a binary search of the section starts in
the token spans is the interval join.  A token inside a section belongs to it; a token that crosses a boundary is
allocated by an explicit rule: ``start`` (section of its first byte, the default), ``end`` (of its last byte) or
``most`` (of most of its bytes, the earlier on a tie).  So the counts of a document's sections add up to its tokens, if
its sections cover it.  Rows are independent: no shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm._common import ship

RULES = ("start", "end", "most")
SECTIONS = "array<struct<name:string,start:int,end:int>>"


def field_sections(*columns: str, separator: str = "\n") -> tuple[Column, Column]:
    """(text, sections) of the named columns joined by ``separator``, which belongs to the field before it; nulls are empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    gap = len(separator)
    sections, begin = [], F.lit(0)
    for i, (c, p) in enumerate(zip(columns, parts, strict=True)):
        end = begin + F.char_length(p) + (gap if i < len(columns) - 1 else 0)
        sections.append(F.struct(F.lit(c).alias("name"), begin.cast("int").alias("start"), end.cast("int").alias("end")))
        begin = end
    return F.concat_ws(separator, *parts), F.array(*sections)


def _byte_places(raw: bytes, places: np.ndarray) -> np.ndarray:
    """Byte offsets of code point offsets."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) == 0 or b.max() < 128:
        return np.minimum(places, len(b))
    first = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
    return first[np.minimum(places, len(first) - 1)]


def attribute(lengths: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens allocated, tokens crossing a bound) of sections [start, end) in bytes; sorted, not overlapping."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    head = np.searchsorted(start, begins, "right") - 1  # section of the first byte
    tail = np.searchsorted(start, ends - 1, "right") - 1
    inside = lambda k, at: (k >= 0) & (at < end[np.maximum(k, 0)])
    if len(start) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    crosses = (head != tail) | (inside(head, begins) != inside(tail, ends - 1))
    at, ok = head, inside(head, begins)
    if rule == "end":
        at, ok = tail, inside(tail, ends - 1)
    elif rule == "most" and crosses.any():
        at, ok = at.copy(), ok.copy()
        for t in np.flatnonzero(crosses):
            k = np.arange(max(head[t], 0), tail[t] + 1)
            share = np.minimum(end[k], ends[t]) - np.maximum(start[k], begins[t]) if len(k) else np.zeros(0)
            ok[t] = len(k) > 0 and share.max() > 0
            if ok[t]:
                at[t] = k[share.argmax()]
    n = len(start)
    touched = np.bincount(head[crosses & inside(head, begins)], minlength=n)[:n]
    return np.bincount(at[ok], minlength=n)[:n], touched


def pieces(start: list[int | None], end: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, section) of disjoint pieces in order, from sections that may be in any order and overlap.

    What several sections cover belongs to the one that begins last, of those the later given.  A section without a bound,
    or that ends before it begins, has no piece.
    """
    known = sorted((max(a, 0), k, max(b, 0)) for k, (a, b) in enumerate(zip(start, end, strict=True)) if a is not None and b is not None and b > max(a, 0))
    bounds = sorted({x for a, _, b in known for x in (a, b)})
    out: list[list[int]] = []
    open_: list[tuple[int, int, int]] = []  # (-start, -number, end): the one that begins last is first
    at = 0
    for low, high in zip(bounds, bounds[1:], strict=False):
        while at < len(known) and known[at][0] <= low:
            a, k, b = known[at]
            heapq.heappush(open_, (-a, -k, b))
            at += 1
        while open_ and open_[0][2] <= low:
            heapq.heappop(open_)
        if open_:
            k = -open_[0][1]
            if out and out[-1][2] == k and out[-1][1] == low:
                out[-1][1] = high
            else:
                out.append([low, high, k])
    a, b, k = np.array(out, np.int64).reshape(-1, 3).T
    return a, b, k


@lru_cache(maxsize=2)
def _encoding(name: str, pattern: str):
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        lengths[i] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def section_counts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str | Column = "text", sections: Column | None = None, rule: str = "start") -> DataFrame:
    """doc_id, n_tokens and sections: array of (name, start, end, n_tokens, n_crossing), in order.

    n_crossing counts tokens that begin in the section and end beyond it.  Null texts count as empty, with one empty
    section and no tokens.  Sections are lines unless given; tokens outside of all given sections count in n_tokens only.
    Given sections may be in any order, reach beyond the text and overlap (see ``pieces``); one with a null bound, or null
    itself, holds nothing.  A null id, or one that isn't a number, gives a null id; repeated rows give repeated rows,
    other columns aren't read, an empty table gives an empty one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = df.sparkSession
    ship(spark)
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]
    column = F.col(text) if isinstance(text, str) else text
    by_line = sections is None
    rows = df.select(F.col(id_col).try_cast("long").alias("doc_id"), F.coalesce(column.cast("string"), F.lit("")).alias("text"), *([] if by_line else [sections.cast(SECTIONS).alias("sections")]))
    part = pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length_of = _encoding(name, pattern)
        for b in batches:
            n, offsets, names, starts, ends, counts, crossing = [], [0], [], [], [], [], []
            given = [None] * b.num_rows if by_line else b.column(2).to_pylist()
            for t, s in zip(b.column(1).to_pylist(), given, strict=True):
                raw = t.encode("utf-8")
                if by_line:
                    lines = t.split("\n")
                    size = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
                    end = np.cumsum(size)
                    start, end = end - size, np.append(end[:-1], len(t))
                    own = list(map(str, range(len(lines))))
                else:
                    start, end = ([(x or {}).get(k) for x in s or []] for k in ("start", "end"))
                    own = [(x or {}).get("name") for x in s or []]
                lengths = length_of[encoding.encode_ordinary(t)]
                if by_line:
                    got, over = attribute(lengths, _byte_places(raw, start), _byte_places(raw, end), rule)
                else:
                    a, z, k = pieces(start, end)
                    each = attribute(lengths, _byte_places(raw, a), _byte_places(raw, z), rule)
                    got, over = (np.bincount(k, v, minlength=len(own)).astype(np.int64) for v in each)
                n.append(len(lengths))
                offsets.append(offsets[-1] + len(own))
                names += own
                for to, v in zip((starts, ends, counts, crossing), (start, end, got, over), strict=True):
                    to.append(v)
            flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind) if by_line or kind == pa.int64() else pa.array([v for y in x for v in y], kind)
            inner = pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), flat(starts, pa.int32()), flat(ends, pa.int32()), flat(counts, pa.int64()), flat(crossing, pa.int64())], fields=list(part)
            )
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], names=["doc_id", "n_tokens", "sections"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, sections array<struct<name:string,start:int,end:int,n_tokens:long,n_crossing:long>>")
