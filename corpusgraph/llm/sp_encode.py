"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

The encoder never replays the merges of a whole word.  It takes the longest vocabulary match at a position (an
Aho-Corasick automaton over the pieces), accepts it if it is *compatible* with the token before it - re-merging the
two texts alone gives the same two tokens back - and otherwise tries the next shorter piece.  Where no piece is left,
the position is marked as failed in a bitfield and the token before it is taken back.  A sequence whose neighbours are
all compatible is the sequence the merges would have made.  The compatibility of a pair is computed once per worker.

Words are independent of each other when no piece holds a letter followed by the word mark; this is checked when the
model is loaded, and otherwise the text is one word, which is merged directly (with a heap).  Runs of the word mark have
pieces of one and the same score, where the leftmost pair goes first; the pair test replays that order, and the tests
hold such runs of every length against the library.  Characters outside the vocabulary become byte tokens.

Rows are independent: no shuffle, and memory is bounded by one Arrow batch and a cache of two generations.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm._common import ship

MARK = "▁"
#: Words of each of the two generations of a worker's cache.
CACHE_WORDS = 150_000


class BacktrackingEncoder:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != spec.BPE or not spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisation is supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        kinds = type(proto.pieces.add())
        del proto.pieces[-1]
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.surface: list[str | None] = []
        self.byte_id = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.rank[p.piece], self.id[p.piece] = -p.score, i
                self.surface.append(p.piece.replace(MARK, " "))
            elif p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)], self.byte_of[i] = i, int(p.piece[3:5], 16)
                self.surface.append(None)
            elif p.type in (kinds.CONTROL, kinds.UNKNOWN):
                self.surface.append("" if p.type == kinds.CONTROL else spec.unk_surface)
            else:
                raise ValueError(f"pieces of type {p.type} are not supported")
        self.after: dict[str, dict[str, bool]] = {}
        # a piece that its own merges don't make is never a token
        real = [p for p in self.rank if len(p) == 1 or self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in real:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        known = set(real)
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None) for p in real}
        self.chars = {p for p in self.rank if len(p) == 1}
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank)
        self.letter = next(i for p, i in self.id.items() if MARK not in p)
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.other: set[str] = set()  # words that don't decode to themselves

    def merge(self, text: str) -> list[str]:
        """Replay the merges: best score first, leftmost on ties."""
        n = len(text)
        part: list[str | None] = list(text)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(rank[text[i : i + 2]], i, text[i : i + 2]) for i in range(n - 1) if text[i : i + 2] in rank]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = right[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != whole:
                continue
            part[i], part[j] = whole, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (s := whole + part[k]) in rank:
                    heapq.heappush(heap, (rank[s], i, s))
            if (h := left[i]) >= 0 and (s := part[h] + whole) in rank:
                heapq.heappush(heap, (rank[s], h, s))
        return [p for p in part if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether re-merging the two texts alone gives the two tokens back; kept by first token."""
        after = self.after.get(a)
        if after is None:
            after = self.after[a] = {}
        ok = after[b] = self.merge(a + b) == [a, b]
        return ok

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text of known characters without a run of marks."""
        n, long, shorter, after = len(text), self.automaton.iter_long, self.shorter, self.after
        longest = long(text)  # goes on behind each match by itself
        piece = next(longest)[1]
        if len(piece) == n:
            return [piece]
        failed, tokens, pos, last = 0, [], 0, None
        while True:
            end = pos + len(piece)
            if not failed >> end & 1:
                if last is None:
                    ok = True
                else:
                    ok = after[last].get(piece) if last in after else None
                    if ok is None:
                        ok = self.compatible(last, piece)
                if ok:
                    tokens.append(piece)
                    if end == n:
                        return tokens
                    if longest is None:
                        longest = long(text, end)
                    pos, last = end, piece
                    piece = next(longest)[1]
                    continue
            longest = None
            if (less := shorter[piece]) is not None:
                piece = less
            else:
                failed |= 1 << pos
                piece = tokens.pop()
                pos -= len(piece)
                last = tokens[-1] if tokens else None

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word: a run of marks and what follows up to the next mark."""
        ids: list[int] = []
        at = 0
        for m in self._unknown(word):
            if m > at:
                self._known(word[at:m], ids)
            ids += [self.byte_id[b] for b in word[m].encode()]
            at = m + 1
        if at < len(word):
            self._known(word[at:], ids)
        return ids

    def _unknown(self, word: str) -> list[int]:
        chars = self.chars
        return [] if chars.issuperset(word) else [i for i, c in enumerate(word) if c not in chars]

    def _known(self, text: str, ids: list[int]) -> None:
        pieces = self.backtrack(text) if self.by_word else self.merge(text)
        ids += map(self.id.__getitem__, pieces)

    def decode(self, ids: list[int]) -> str:
        """As decode(ids) of the library: the mark that the encoder put before the text goes, bytes are joined."""
        out: list[str] = []
        run = bytearray()
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
            return text[1:] if self.prefix and text[:1] == " " else text
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
            else:
                if run:
                    out.append(_utf8(run))
                    run.clear()
                out.append(self.surface[i])
        if run:
            out.append(_utf8(run))
        text = "".join(out)
        return text[1:] if self.prefix and ids and ids[0] not in self.byte_of and text[:1] == " " else text

    def words(self, text: str) -> list[str]:
        s = self.prefix + text.replace(" ", MARK)
        return _WORDS.findall(s) if self.by_word else [s]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for w in self.words(text) for i in self.word_ids(w)]

    def encode_digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        if not text:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        if not self.by_word or not self.prefix or MARK in text or "  " in text or text[0] == " ":
            ids = self.encode(text)
            decoded, joined = self.decode(ids), ",".join(map(str, ids))
        else:
            words = text.split(" ")
            got = list(map(self.young.get, words))
            if None in got:
                for i, g in enumerate(got):
                    if g is None:
                        got[i] = self._word(words[i])
            joined = ",".join(got)
            # each word's ids were decoded when the word was first met; where one differs, the whole text is decoded
            decoded = text if self.other.isdisjoint(words) else self.decode(self.encode(text))
        return joined.count(",") + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def _word(self, word: str) -> str:
        """The ids, joined by commas, of a word with a mark before it, kept in the younger generation."""
        got = self.young.get(word) or self.old.get(word)
        if got is None:
            ids = self.word_ids(MARK + word)
            got = ",".join(map(str, ids))
            # the mark put before the text isn't decoded at its begin: with a letter before it, every mark is shown
            if self.decode([self.letter, *ids]) != self.surface[self.letter] + " " + word:
                self.other.add(word)
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = got
        return got


_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _utf8(run: bytearray) -> str:
    return run.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def _encoder(name: str) -> BacktrackingEncoder:
    with open(SparkFiles.get(name), "rb") as f:
        return BacktrackingEncoder(f.read())


def _ship_model(df: DataFrame, path: str) -> str:
    """Send the model file to the executors; returns the name under which they find it."""
    ship(df.sparkSession)
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of ``text`` (array<int>) and the text decoded from them; both names must be free.

    A null text counts as empty: no ids, empty decoded text.  Repeated rows and any other columns stay as they are.
    """
    if {ids, decoded} & set(df.columns):
        raise ValueError(f"{ids} or {decoded} is a column already")
    name = _ship_model(df, model_path)

    @F.pandas_udf("struct<ids:array<int>,decoded:string>")
    def run(texts):
        import pandas as pd

        e = _encoder(name)
        got = [e.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": got, "decoded": [e.decode(x) for x in got]})

    both = df.withColumn("__sp", run(F.coalesce(F.col(text), F.lit(""))))
    return both.withColumns({ids: F.col("__sp.ids"), decoded: F.col("__sp.decoded")}).drop("__sp")


def encode_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (0 tokens, the hash of nothing); a null id, or one that isn't a number, gives a null id; repeated rows
    give repeated rows; an empty table gives an empty table; other columns are not read.
    """
    name = _ship_model(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(name)
        for b in batches:
            got = [e.encode_digest(t.as_py() or "") for t in b.column(1)]
            n, a, d = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
