"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of the last ``window`` lines ends a chunk where it is divisible by ``divisor``; a line of
``long_words`` words or ``LONG_CHARS`` characters or more is a chunk by itself.  Boundaries depend on the lines around them only, so that lines put in
or taken out elsewhere don't shift them.  A chunk counts if it has several lines and something besides white space, or is
such a long line.  Of equal chunks anywhere in the corpus the one of the smallest (id, position) stays.

A chunk may straddle the edge of what is repeated, so chunks alone leave most short-lined passages in.  With ``run_words``
every run of lines of more words, or of ``RUN_CHARS`` characters or more, that occurs at a smaller place too goes as a whole, wherever chunks end: the units are
then also the shortest such runs from each line on and up to each line.  Any longer run is the
union of such runs inside it (each of its lines ends one, or lies in the one that begins the run), so that equal units
are all that has to be found.  Blank lines begin and end no run.

Words are parted by Unicode white space; characters are code points, counted without white space at a line's ends.  They
stand for words in scripts that are written without spaces.

1. one pass emits (id, position, 64-bit hash) of each unit; hashes met more than once are found by an aggregation with
   map-side combine;
2. a second pass emits the SHA-256 of units (over those of their lines, so that no line is read once for each unit) with
   such a hash only; they are grouped by hash *and* digest: a collision of hashes removes nothing;
3. the line ranges to remove, a short list for each document, go back to the texts: broadcast if their number is
   small, else with one shuffle of the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm._common import BROADCAST_ROWS, cut, ship, small, unused

WINDOW, DIVISOR, LONG_WORDS = 2, 2, 25
#: A line with as many characters is long, however few words it has.
LONG_CHARS = 120
#: Repeated runs of lines with more words than that, or with as many characters, are removed whole.
RUN_WORDS, RUN_CHARS = 50, 240
#: Bytes of digests of repeated units, each once, that are broadcast at most.
BROADCAST_BYTES = 32 * 1024 * 1024


def chunks_of(text: str, window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> list[tuple[int, int, bytes, bool]]:
    """(first line, lines, bytes, counts) of the chunks of a text; joined by line feeds they are the text."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    sizes = [_size(line) for line in text.split("\n")]
    out: list[tuple[int, int, bytes, bool]] = []
    begin, hashes = 0, [0] * window
    for i, line in enumerate(lines):
        long = sizes[i][0] >= long_words or sizes[i][1] >= LONG_CHARS
        if long and begin < i:
            out.append(_chunk(lines, begin, i, False))
            begin = i
        hashes.append(zlib.crc32(line))
        rolled = 0
        for h in hashes[-window:]:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h + 1) & 0xFFFFFFFFFFFFFFFF
        rolled ^= rolled >> 29
        if long or rolled * 0xBF58476D1CE4E5B9 % (1 << 64) // (1 << 32) % divisor == 0:
            out.append(_chunk(lines, begin, i + 1, long))
            begin = i + 1
    if begin < len(lines):
        out.append(_chunk(lines, begin, len(lines), False))
    return out


def _size(line: str) -> tuple[int, int]:
    """Words and characters of a line."""
    return len(line.split()), len(line.strip())


def _chunk(lines: list[bytes], begin: int, end: int, long: bool) -> tuple[int, int, bytes, bool]:
    whole = b"\n".join(lines[begin:end])
    return begin, end - begin, whole, long or (end - begin > 1 and not whole.isspace() and bool(whole))


def runs_of(text: str, run_words: int = RUN_WORDS) -> set[tuple[int, int]]:
    """(first line, lines) of the shortest runs that are large enough, from each line on and up to each line.

    A run is large enough with more than ``run_words`` words or with ``RUN_CHARS`` characters.
    """
    size = [(i, *_size(line)) for i, line in enumerate(text.split("\n"))]
    size = [x for x in size if x[1]]
    out: set[tuple[int, int]] = set()
    end = words = chars = 0
    for i, w, c in size:
        while end < len(size) and words <= run_words and chars < RUN_CHARS:
            words += size[end][1]
            chars += size[end][2]
            end += 1
        if words <= run_words and chars < RUN_CHARS:
            break
        out.add((i, size[end - 1][0] + 1 - i))
        words -= w
        chars -= c
    begin = words = chars = 0
    for i, w, c in size:
        words += w
        chars += c
        while words - size[begin][1] > run_words or chars - size[begin][2] >= RUN_CHARS:
            words -= size[begin][1]
            chars -= size[begin][2]
            begin += 1
        if words > run_words or chars >= RUN_CHARS:
            out.add((size[begin][0], i + 1 - size[begin][0]))
    return out


def _units(text: str, chunks: bool, run_words: int, options: tuple[int, int, int]) -> list[tuple[int, int]]:
    found = runs_of(text, run_words) if run_words else set()
    if chunks:
        found |= {(pos, n) for pos, n, _, counts in chunks_of(text, *options) if counts}
    return sorted(found)


def _emit(docs: DataFrame, with_digest: bool, chunks: bool, run_words: int, options: tuple[int, int, int]) -> DataFrame:
    """(doc_id, th, pos, lines, h[, digest]) of the units; docs: (doc_id, th, text)."""
    ship(docs.sparkSession)
    schema = "doc_id long, th long, pos int, lines int, h long" + ", digest binary" * with_digest
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()][: 5 + with_digest]
    names = ["doc_id", "th", "pos", "lines", "h", "digest"][: 5 + with_digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in types]
            for doc, th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                units = _units(text, chunks, run_words, options)
                if not units:
                    continue
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                short = [xxhash.xxh64_digest(x) for x in lines]
                whole = [hashlib.sha256(x).digest() for x in lines] if with_digest else []
                for pos, n in units:
                    h = xxhash.xxh64_intdigest(b"".join(short[pos : pos + n]))
                    row = (doc, th, pos, n, h - (h >> 63 << 64), hashlib.sha256(b"".join(whole[pos : pos + n])).digest() if with_digest else b"")
                    for to, v in zip(cols, row, strict=False):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.mapInArrow(run, schema)


def _joined(cuts: list[dict[str, int]]) -> list[dict[str, int]]:
    """Sorted ranges, those that overlap as one."""
    out: list[dict[str, int]] = []
    for c in cuts:
        if out and c["pos"] < out[-1]["pos"] + out[-1]["lines"]:
            out[-1]["lines"] = max(out[-1]["lines"], c["pos"] + c["lines"] - out[-1]["pos"])
        else:
            out.append(dict(c))
    return out


def _join_ranges(gone: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("lines", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = pa.array([_joined(c) for c in b.column(2).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cuts], names=["doc_id", "th", "cuts"])

    return gone.mapInArrow(run, "doc_id long, th long, cuts array<struct<pos:int,lines:int>>")


def removals(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS, run_words: int = 0, chunks: bool = True) -> DataFrame:
    """(doc_id, th, cuts): sorted line ranges (pos, lines) to remove from the text with hash ``th`` of a document.

    Without ``run_words`` only chunks are compared, without ``chunks`` only runs (see ``runs_of``).
    """
    how = (chunks, run_words, (window, divisor, long_words))
    docs = df.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    again = cut(_emit(docs, False, *how).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    found = cut(_emit(docs, True, *how).join(small(again), "h", "left_semi"))
    at = F.struct("doc_id", "th", "pos")
    first = cut(found.groupBy("h", "digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # the places of one unit may be a third of all: they stay where they are if the units are few, else Spark splits them
    size = first.agg(F.count("*").alias("n"), F.sum(F.length("digest")).alias("bytes")).first()
    few = size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    gone = found.join(F.broadcast(first) if few else first, ["h", "digest"]).where(at != F.col("first"))
    return _join_ranges(gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "lines"))).alias("cuts")))


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", cuts: str | None = None, **options) -> DataFrame:
    """``df`` with the repeated chunks removed from ``text``; ``cuts`` names a column for the removed line ranges.

    ``run_words=RUN_WORDS`` removes repeated runs of lines as a whole besides (see ``removals``).

    Rows with a null id, one that isn't a number, or a null text stay as they are and take no part.  A text of which nothing is left becomes
    empty.  Repeated rows (same id and text) count as one place and get the same result.  All columns stay.
    """
    own, th, list_ = unused(df, "cut_id", "cut_th", "cut_list")
    gone = cut(removals(df, id_col, text, **options)).toDF(own, th, list_)
    joined = df.join(small(gone), (F.col(id_col).try_cast("long") == F.col(own)) & (F.xxhash64(F.col(text).cast("string")) == F.col(th)), "left")

    def kept(lines: Column) -> Column:
        """The lines between the ranges: each is copied once, however many ranges there are."""
        begin = F.concat(F.array(F.lit(0)), F.transform(list_, lambda c: c["pos"] + c["lines"]))
        end = F.concat(F.transform(list_, lambda c: c["pos"]), F.array(F.size(lines)))
        return F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(lines, a + 1, b - a)))

    body = F.get(F.transform(F.array(F.split(F.col(text), "\n", -1)), kept), F.lit(0))
    out = joined.withColumn(text, F.when(F.col(list_).isNull(), F.col(text)).otherwise(F.array_join(body, "\n")))
    return out.select(*df.columns, *([F.col(list_).alias(cuts)] if cuts else []))
