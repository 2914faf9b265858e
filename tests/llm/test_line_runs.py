"""Repeated runs of lines against a brute force that knows neither chunks nor units."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from test_operators import frame

import corpus_pipeline
from corpusgraph.llm import line_chunks
from corpusgraph.llm.queries import QUERIES


def runs_gone(docs, words=line_chunks.RUN_WORDS):
    """Numbers of the lines of any run of more than ``words`` words or 240 characters that also stands at a smaller (id, line)."""
    lines = [(d, t.split("\n")) for d, t in sorted(docs)]
    places = defaultdict(list)
    for k, (_, own) in enumerate(lines):
        for i, x in enumerate(own):
            places[x].append((k, i))
    out = {}
    for k, (d, own) in enumerate(lines):
        gone = set()
        for i, x in enumerate(own):
            for e, j in places[x] if x.strip() else ():
                if (e, j) < (k, i):
                    other, n = lines[e][1], 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    while not own[i + n - 1].strip():  # blank lines begin and end no run
                        n -= 1
                    if len(" ".join(own[i : i + n]).split()) > words or sum(len(x.strip()) for x in own[i : i + n]) >= line_chunks.RUN_CHARS:
                        gone |= set(range(i, i + n))
        out[d] = gone
    return out


def brute_runs(docs):
    """Texts without those lines."""
    gone = runs_gone(docs)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def short_lined(seed, n=24):
    r = random.Random(seed)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 24)))
    passages = [[line() for _ in range(r.randrange(3, 12))] for _ in range(5)] + [["x y", " ".join(f"l{i}" for i in range(60)), "z"]]
    docs = []
    for i in range(n):
        parts = [[line() for _ in range(r.randrange(0, 4))], r.choice(passages), [line() for _ in range(r.randrange(0, 4))], r.choice(passages)[r.randrange(0, 3) :], [line()]]
        docs.append((i, "\n".join(x for p in parts for x in p)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force(spark, seed):
    docs = short_lined(seed)
    got = {x.doc_id: x.text for x in line_chunks.remove_repeated(frame(spark, docs), run_words=line_chunks.RUN_WORDS, chunks=False).collect()}
    assert got == brute_runs(docs) and any(got[d] != t for d, t in docs)


def passages(spark, where):
    """Each passage between other lines, in two documents."""
    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shapes = [[line(20) for _ in range(3)] for _ in range(20)] + [[line(6) for _ in range(9)] for _ in range(20)]
    docs = [(2 * k + second, "\n".join([line(9), *p, line(9)])) for k, p in enumerate(shapes) for second in (0, 1)]
    rows = [(d, t, "en", "web", len(t)) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return docs


def test_passages_of_short_lines_go_whole(spark, tmp_path):
    docs = passages(spark, tmp_path)
    got = {x.doc_id: x.n_lines_removed for x in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {d: (t.count("\n") - 1 if d % 2 else 0) for d, t in docs}


def test_pipeline_leaves_no_repeated_passage(spark, tmp_path):
    docs = passages(spark, tmp_path)
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:2]):
        stage(spark, out, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
    got = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    assert got == {d: (x, len(x)) for d, t in docs for x in ["\n".join(t.split("\n")[:: t.count("\n")]) if d % 2 else t]}


WORDS = [f"w{i}" for i in range(30)]
HAN = "".join(chr(0x4E00 + 7 * i) for i in range(130))


@pytest.mark.parametrize("line", ["\t".join(WORDS), "\u00a0".join(WORDS), "\u3000".join(WORDS), HAN], ids=["tabs", "no-break", "ideographic", "han"])
def test_long_lines_without_spaces(spark, line):
    docs = [(i, f"before {i}\n{line}\nafter {i}") for i in range(6)]
    got = {x.doc_id: x.text for x in line_chunks.remove_repeated(frame(spark, docs)).collect()}
    assert got == {i: t if i == 0 else f"before {i}\nafter {i}" for i, t in docs}


def test_short_lines_without_spaces(spark):
    lines = [HAN[k : k + 30] for k in range(0, 100, 10)]
    docs = [(i, "\n".join([f"before {i}", *lines, f"after {i}"])) for i in range(3)]
    got = {x.doc_id: x.text for x in line_chunks.remove_repeated(frame(spark, docs), run_words=line_chunks.RUN_WORDS).collect()}
    assert got == {i: t if i == 0 else f"before {i}\nafter {i}" for i, t in docs}


def test_blank_lines_are_never_long():
    assert [c[3] for c in line_chunks.chunks_of(" " * 500)] == [False] and line_chunks.runs_of("\n".join([" " * 500] * 9)) == set()
