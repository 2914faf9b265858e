"""Operators of the training-data pipeline against brute-force versions, exact round trips and defined edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgraph.llm import decontam, fingerprints, html_text, license_scan, line_chunks, neardup, quality, sp_encode, token_spans, warc
from corpusgraph.llm.queries import piece_model
from corpusgraph.llm.shingles import Rolled, words_of

#: Columns with names that the operators use inside.
CLASH = ("th", "h", "w", "seen", "rep", "digest", "bucket", "next", "range", "part", "chunk", "cuts", "x", "host", "path", "keep", "sections", "matches", "n", "a", "b", "cut_id", "cut_th", "cut_list", "bad_id", "bad_host", "bad_path", "bad_th", "label_id", "y")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in CLASH})


EDGES = [(1, None), (2, ""), (3, "same text here"), (3, "same text here"), (None, "no id"), (4, "same text here"), (5, "x" * 60_000), (6, "é 😀 \n\n ﬁ")]


# -- sentencepiece ------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    with open(piece_model(), "rb") as f:
        return sp_encode.BacktrackingEncoder(f.read())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_runs_of_marks_equal_the_library(coder, library):
    r = random.Random(6)
    assert coder.by_word
    pieces = [p.strip("▁") for p in coder.id if p.strip("▁") and "▁" not in p.strip("▁")]
    for n in (*range(1, 80), 127, 128, 129, 1000, 1001, 20_011):
        for _ in range(12):
            text = " " * n + "".join(r.choice(pieces) for _ in range(r.randrange(4)))
            ids = library.encode(text)
            assert coder.encode(text) == ids and [coder.id[p] for p in coder.backtrack("▁" + text.replace(" ", "▁"))] == ids


@given(st.lists(st.sampled_from(["a", "b", "th", "ing", " ", "  ", "▁", "é", "\n", "😀", "日", "<0x0A>", "<s>", "e", "er", "\x00", "ion", "s"]), max_size=24).map("".join))
@settings(max_examples=400, deadline=None)
def test_pieces_equal_the_library(coder, library, text):
    ids = library.encode(text)
    assert coder.encode(text) == ids and coder.decode(ids) == library.decode(ids)
    n, shown, back = coder.encode_digest(text)
    assert (n, shown) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert back == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_backtracking_equals_merging(coder):
    r = random.Random(2)
    for _ in range(2000):
        w = "▁" + "".join(r.choice("abcdeilnorstuth") for _ in range(r.randrange(1, 15)))
        assert coder.backtrack(w) == coder.merge(w)


def test_encode_edges(spark, library):
    df = frame(spark, EDGES)
    got = Counter((r.doc_id, r.n_tokens) for r in sp_encode.encode_digests(df, piece_model()).collect())
    assert got == Counter((d, len(library.encode(t or ""))) for d, t in EDGES)
    full = sp_encode.encode(df, piece_model())
    assert {r.doc_id: r.decoded for r in full.where("doc_id IN (1, 6)").collect()} == {1: "", 6: library.decode(library.encode(EDGES[-1][1]))}
    assert sp_encode.encode_digests(df.limit(0), piece_model()).count() == 0
    with pytest.raises(ValueError):
        sp_encode.encode(df.withColumn("ids", F.lit(1)), piece_model())


# -- near-dedup ---------------------------------------------------------------------


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(texts, threshold=0.8):
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j]:
                like = sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values()) >= threshold
            else:
                like = not bags[i] and not bags[j] and (texts[i] or "") == (texts[j] or "")
            if like:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]

    def edit(t, k):
        t = list(t)
        for _ in range(k):
            t[r.randrange(len(t))] = r.choice(words)
        return t

    base, out = [r.choice(words) for _ in range(200)], []
    for _ in range(100):  # one large group, many of it just under the threshold
        out.append(" ".join(edit(base, r.randrange(0, 9))))
    other = edit(base, 9)
    for _ in range(30):
        out.append(" ".join(edit(other, r.randrange(0, 5))))
    for _ in range(8):
        b = [r.choice(words) for _ in range(r.randrange(5, 60))]
        out += [" ".join(edit(b, r.randrange(0, 4))) for _ in range(5)]
    out += [" ".join(base[:60] + edit(base[60:], 140)) for _ in range(10)]  # a passage in common
    return [*out, "", "", "a b", "a b", " ", "A  b", None, out[3], "one two one two one two one two", "one two one two one two one two"]


def test_classes_equal_brute_force(spark):
    texts = near_texts(5)
    df = frame(spark, list(enumerate(texts))).repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == dict(enumerate(brute_classes(texts)))


def test_texts_of_one_id_are_compared_each_by_itself(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(7, one), (7, two), (7, two), (8, one + " z"), (9, two + " z"), (3, three), (None, one)]
    df = frame(spark, rows)
    got = Counter((r.doc_id, r.class_id) for r in neardup.classes(df).collect())
    assert got == Counter([(7, 7), (7, 7), (7, 7), (8, 7), (9, 7), (3, 3), (None, None)])
    known, first = neardup._classes(df, "doc_id", "text", 5, 30, 5, 0.8)
    assert known.count() == 6 and first.count() == 3
    kept = Counter((r.doc_id, r.text) for r in neardup.keep_one(df).collect())
    assert kept == Counter([(7, one), (7, two), (3, three), (None, one)])
    words = spark.createDataFrame([("x", "a b c"), ("5", "d e f")], "doc_id string, text string")
    assert sorted(map(str, neardup.classes(words).collect())) == sorted(["Row(doc_id=5, class_id=5)", "Row(doc_id=None, class_id=None)"])
    assert neardup.keep_one(words).count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_linkable_misses_no_similar_pair(spark, seed):
    """Every pair of different components that is similar is found, and none inside a component is made."""
    r, t = random.Random(seed), 0.8
    words = list(range(60 if seed % 2 else 4000))
    centre = set(range(r.choice([12, 60])))
    sets = []
    for _ in range(60):
        x = set(r.choice(sets)) if sets and r.random() < 0.5 else set(centre)
        for u in r.sample(sorted(x), r.randrange(0, max(1, len(x) // 4))):
            x.discard(u)
            if r.random() < 0.8:
                x.add(1000 + r.choice(words))
        sets.append(x)
    like = lambda x, y: len(x & y) / len(x | y)
    part = [-1 if like(x, centre) >= t else r.choice([i, -2]) for i, x in enumerate(sets)]
    rows = [(0, i + 1, part[i], len(centre), len(centre - x), len(x - centre), sorted(x ^ centre)) for i, x in enumerate(sets)]
    diff = spark.createDataFrame(rows, "a long, b long, component long, size long, removed long, added long, units array<long>")
    got = {(p.a - 1, p.b - 1) for p in neardup._linkable(diff, t).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if part[i] != part[j] and like(sets[i], sets[j]) >= t}
    assert want <= got and all(part[i] != part[j] for i, j in got)


def test_dart_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**63, 800).astype(np.uint64)
    wa, wb = np.zeros(800), np.zeros(800)
    wa[:600], wb[200:] = 1.0, 1.0
    wa[100:150], wb[300:340], wa[400:420] = 2.5, 3.0, 0.5
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    agree = [(neardup.dart_signature(e[wa > 0] ^ np.uint64(s << 40), wa[wa > 0], 150) == neardup.dart_signature(e[wb > 0] ^ np.uint64(s << 40), wb[wb > 0], 150)).mean() for s in range(20)]
    assert abs(np.mean(agree) - want) < 0.03


def test_near_edges(spark):
    df = frame(spark, EDGES)
    got = Counter((r.doc_id, r.class_id) for r in neardup.classes(df).collect())
    assert got == Counter([(1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (None, None), (5, 5), (6, 6)])
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5, 6]
    assert neardup.classes(df.limit(0)).count() == neardup.keep_one(df.limit(0)).count() == 0


def test_rolled_hashes_are_of_the_words():
    r = Rolled(words_of("Ein Wort, zwei wort zwei WORT zwei!"))
    assert r.words == ["ein", "wort", "zwei", "wort", "zwei", "wort", "zwei"]
    h = r.runs(2)
    assert h[1] == h[3] == h[5] and h[2] == h[4] and len(set(h.tolist())) == 3 and len(r.runs(8)) == 0


# -- lines ---------------------------------------------------------------------------


def brute_gone(docs):
    """Lines to remove from each text, by comparing every chunk with all before it."""
    first, out = {}, {}
    chunks = [(d, pos, n, whole) for d, t in docs if d is not None and t is not None for pos, n, whole, counts in line_chunks.chunks_of(t) if counts]
    for d, pos, _, whole in chunks:
        first[whole] = min(first.get(whole, (d, pos)), (d, pos))
    for d, t in docs:
        out[d] = {i for e, pos, n, whole in chunks if e == d and first[whole] != (d, pos) for i in range(pos, pos + n)}
    return out


def brute_lines(docs):
    """Texts after removal."""
    gone = brute_gone(docs)
    return {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_lines_equal_brute_force(spark):
    r = random.Random(4)
    pool = [" ".join(r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(r.randrange(1, 40))) for _ in range(40)]
    passage = [" ".join(f"p{i}" for i in range(60)), "short line one", "short line two", "short line three", "short line four"]
    docs = []
    for i in range(60):
        lines = [r.choice(pool) + (f" {i}" if r.random() < 0.6 else "") for _ in range(r.randrange(1, 12))]
        at = r.randrange(len(lines) + 1)
        docs.append((i, "\n".join(lines[:at] + passage + lines[at:])))
    got = {x.doc_id: x.text for x in line_chunks.remove_repeated(frame(spark, docs)).collect()}
    assert got == brute_lines(docs)
    assert sum(passage[0] in t for t in got.values()) == 1  # the long passage is left once


def test_chunks_cover_the_text_and_resist_shifts():
    lines = [f"line number {i * i % 97}" for i in range(200)]
    one, two = (line_chunks.chunks_of("\n".join(x)) for x in (lines, ["new first line", *lines]))
    assert b"\n".join(c[2] for c in one).decode() == "\n".join(lines)
    assert len({c[2] for c in one} & {c[2] for c in two}) >= len({c[2] for c in one}) - 2
    assert line_chunks.chunks_of("") == [(0, 1, b"", False)]


def test_long_text_with_many_repeats(spark):
    """A text of 60,000 lines with a repeated pair of lines after every fourth one."""
    pair = ["the same line here", "and the same line there"]
    long = [x for i in range(20_000) for x in (f"own line {i}", *(pair if i % 2 else [f"other {i}", f"third {i}"]))]
    docs = [(1, "\n".join(pair * 3)), (2, "\n".join(long))]
    got = {r.doc_id: r.text for r in line_chunks.remove_repeated(frame(spark, docs)).collect()}
    assert got == brute_lines(docs)


def test_line_edges(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "own\n" + long), (5, "\n\n\n")]
    out = line_chunks.remove_repeated(frame(spark, rows), cuts="gone")
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "own"), (5, "\n\n\n")])
    assert line_chunks.remove_repeated(frame(spark, rows).limit(0)).count() == 0


# -- decontamination -------------------------------------------------------------------


def brute_cover(text, item, least):
    """Greedy string tiling by trying every pair of places again and again."""
    a, b = words_of(text), words_of(item)
    least = min(least, len(b))
    ua, ub, covered = [False] * len(a), [False] * len(b), 0
    while b:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        ua[i : i + n] = ub[j : j + n] = [True] * n
        covered += n
    return covered / len(b) if b else 0.0


def test_tiles_equal_brute_force():
    r = random.Random(7)
    for k in range(150):
        words = [f"v{i}" for i in range((2, 3, 5, 25)[k % 4])]
        item = [r.choice(words) for _ in range(r.randrange(1, 30))]
        parts = [item[:10], item[10:20], item[20:], [r.choice(words) for _ in range(12)]]
        r.shuffle(parts)
        text = " ".join(w for p in parts for w in p)
        got = decontam.ItemIndex([(1, " ".join(item))], 4).coverage(text).get(1, 0.0)
        assert got == brute_cover(text, " ".join(item), 4)


def test_reordered_passages_are_caught(spark):
    item = [f"t{i}" for i in range(40)]
    docs = [(1, "x y z " + " ".join(item[20:] + ["gap"] + item[:20])), (2, "clean words only in this text"), (3, " ".join(item[:15])), (4, "tiny"), (5, None), (None, " ".join(item)), (6, "")]
    items = spark.createDataFrame([(7, " ".join(item)), (8, "tiny"), (9, None), (None, "clean words only in this text"), (10, "")], "item_id long, text string")
    for block in (1_000_000, 3):
        got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontam.report(frame(spark, docs), items, block_words=block).collect()}
        assert got == {1: (True, [7]), 2: (False, []), 3: (False, []), 4: (True, [8]), 5: (False, []), None: (True, [7]), 6: (False, [])}
        kept = decontam.clean(frame(spark, docs), items, block_words=block)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6] and kept.columns == frame(spark, docs).columns
    assert decontam.report(frame(spark, docs).limit(0), items).count() == 0
    assert decontam.clean(frame(spark, docs), items.limit(0)).count() == 7


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_report_equals_brute_force(spark, block):
    """Every document against every item, items without an id and several texts of one id among them."""
    r = random.Random(17)
    words = [f"v{i}" for i in range(40)]
    texts = [[r.choice(words) for _ in range(r.randrange(1, 25))] for _ in range(14)]
    items = [(None if k % 5 == 0 else k // 2, " ".join(t)) for k, t in enumerate(texts)] + [(90, None), (91, ""), (3, " ".join(texts[7]))]
    docs = []
    for i in range(30):
        parts = [x for t in r.sample(texts, r.randrange(0, 3)) for x in (t[len(t) // 2 :], t[: len(t) // 2])] + [[r.choice(words) for _ in range(r.randrange(9))]]
        r.shuffle(parts)
        docs.append((i // 2 if i % 7 else None, " ".join(w for p in parts for w in p)))
    docs += [docs[4], docs[4], (None, None)]
    got = decontam.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=block, unnamed=True).collect()
    want = []
    for d, t in docs:
        named, alone = {}, []
        for i, x in set(items):
            if x and words_of(x) and (c := brute_cover(t, x, 5)):
                if i is None:
                    alone.append((None, c))
                else:
                    named[i] = max(c, named.get(i, 0.0))
        want.append((d, len(words_of(t)), (*sorted(named.items()), *sorted(alone, key=lambda a: a[1]))))
    assert Counter((x.doc_id, x.n_words, tuple(map(tuple, x.matches))) for x in got) == Counter(want)


# -- licences ------------------------------------------------------------------------------


def test_license_places(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0 and the MIT license; mit LICENSE."), (2, None), (3, "apache licenses are apache-license"), (4, "GNU General Public License" + " word" * 10_000 + " cc BY"),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (6, "apache licénse Kelvin apache"), (None, "cc by"), (7, "cc\nby cc by"), (7, "cc\nby cc by"),
    ]
    got = {(r.doc_id): (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1] == (14, 3, 3, 12, "apache,mit", "apache,apache-2.0,mit")
    assert got[2] == (0, 0, None, None, "", "")
    assert got[3] == (5, 1, 3, 3, "apache", "apache")
    assert got[4] == (10_006, 2, 0, 10_004, "cc-by,gpl", "cc-by,gpl")
    assert got[5][1:] == (0, None, None, "", "mit-grant")
    assert got[6][1] == 0 and got[None][1] == 1 and got[7] == (4, 2, 0, 2, "cc-by", "cc-by")
    scan = license_scan.scan(frame(spark, rows))
    assert scan.count() == 9 and license_scan.scan(frame(spark, rows).limit(0)).count() == 0
    assert all(0 <= r.score <= 1 for r in scan.collect())


MIT = """MIT License

Copyright (c) 2020 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions:"""


def test_license_texts(spark):
    index = license_scan._index(license_scan._idf())
    assert all(sum(w in index for w in set(t.split())) >= 2 and f" {k} " in f" {t} " for _, t, k in license_scan.TEMPLATES)
    rows = [
        (1, MIT), (2, "/* " + MIT.upper().replace("\n", "\n * ") + " */ code"), (3, MIT.replace("free of charge", "at a charge").replace("without restriction", "with care")),
        (4, ZLIB), (5, MIT + " other words " + ZLIB), (6, "software " * 300 + "persons merge noninfringement boost"), (7, "words before " * 50 + ZLIB.replace("liable", "reliable")),
    ]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert [got[i].labels for i in range(1, 8)] == ["mit,mit-grant", "mit,mit-grant", "mit", "zlib", "mit,mit-grant,zlib", "", ""]
    assert got[1].score == 1.0 and got[4].score == 1.0 and got[6].score == 0.0


# -- fingerprints ----------------------------------------------------------------------------


def test_fingerprints_equal_brute_force(spark):
    r = random.Random(9)
    pool = [f"paragraph {i}" for i in range(400)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.choice([0, 1, 3, 12, 150]))) for _ in range(25)] + ["same", "same", "😀é" * 7, ""]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    out = {x.doc_id: x for x in fingerprints.compare_with_next(frame(spark, rows).repartition(3)).collect()}

    def keys(t):
        seen, k = Counter(), set()
        for p in t.split("\n"):
            if p:
                k.add((p, seen[p]))
                seen[p] += 1
        return k

    def like(a, b):
        a, b = keys(a), keys(b)
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    order = sorted(rows, reverse=True)
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        x = out[d]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(x.near_edited, like(t, edited), abs_tol=1e-6) and math.isclose(x.near_next, like(t, n), abs_tol=1e-6)
    same = [x.fingerprint for d, x in out.items() if dict(rows)[d] == "same"]
    assert same[0] == same[1]


def test_fingerprint_edges(spark):
    got = fingerprints.compare_with_next(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and sum(r.doc_id == 3 for r in got) == 2 and all(0 <= r.near_next <= 1 for r in got)
    one = fingerprints.compare_with_next(frame(spark, [(1, "a\nb")])).collect()
    assert one[0].near_next == 1.0
    assert fingerprints.compare_with_next(frame(spark, EDGES).limit(0)).count() == 0


def paragraph_keys(text):
    """Keys of a text's paragraphs by the definition: 60 bits of the MD5, moved on for each repeat."""
    seen, out = Counter(), []
    for p in text.split("\n"):
        if p:
            x = int(hashlib.md5(p.encode()).hexdigest()[:15], 16)
            out.append((x + seen[x] * fingerprints.REPEAT) % (1 << fingerprints.KEY_BITS))
            seen[x] += 1
    return out


def test_differing_digests_are_recovered(spark):
    r = random.Random(10)
    line = lambda: r.choice(["again", "and again", *(f"line {i}" for i in range(300))])
    versions = []
    for n in (0, 1, 5, 40, 700, 5000):
        old = [line() for _ in range(n)]
        new = [line() if r.random() < r.choice([0, 0.01, 1]) else x for x in old] + [line() for _ in range(r.randrange(4))]
        versions.append(("\n".join(old), "\n".join(new)))
    long = [f"p{i}" for i in range(100_000)]
    versions += [("\n".join(long), "\n".join(["new", *long[:40_000], *long[40_007:]])), ("x\n" * 30_000, "x\n" * 29_000), (None, "a"), (None, None)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(versions)], "i int, old string, new string").withColumns({c: F.lit("clash") for c in CLASH})
    out = fingerprints.compare(df)
    assert out.columns == [*df.columns, "removed", "added", "likeness"] and out.limit(0).count() == 0
    for x in out.collect():
        a, b = (set(paragraph_keys(v or "")) for v in versions[x.i])
        assert set(x.removed) == a - b and set(x.added) == b - a and len(x.removed) == len(a - b) and len(x.added) == len(b - a)
        assert math.isclose(x.likeness, len(a & b) / len(a | b) if a | b else 1.0)


def test_equal_keys_end(spark):
    rows = spark.createDataFrame([(1, [5, 5, 9], [7]), (2, [5, 5, 5], [5]), (3, [1], [2])], "i int, a array<long>, b array<long>")
    got = {x.i: (x.removed, x.added) for x in fingerprints.differences(rows, {"d": ("a", "b")}, {"i": "i", "removed": "d.removed", "added": "d.added"}).collect()}
    assert got[1] == ([5, 9], [7]) and got[3] == ([1], [2]) and len(got) == 3


def test_next_text_of_rows_without_id(spark):
    n = 2500
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = {x.text: x.next for x in fingerprints.with_next(docs).collect()}
    order = [x.text for x in docs.orderBy(F.xxhash64("text").desc()).collect()]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_next_text_across_many_parts(spark):
    n = 3000
    docs = spark.range(n).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = {r.doc_id // 7: r.next for r in fingerprints.with_next(docs).collect()}
    assert got == {i: f"t{(i - 1) % n}" for i in range(n)}


# -- quality ----------------------------------------------------------------------------------


def test_quality_held_out(spark):
    r = random.Random(11)
    good = lambda: " ".join(r.choice(["river", "stone", "green", "walks", "under", "light", "many", "house"]) + str(r.randrange(30)) for _ in range(r.randrange(20, 200)))
    bad = lambda: r.choice([lambda: good().upper().replace(" ", "!! "), lambda: good().replace(" ", " | "), lambda: "spam word " * 60])()
    rows = [(i, bad() if i % 5 == 0 else good(), f"s{i % 3 if i % 2 else 0}", "en") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit("clash") for c in CLASH})
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    s = {x.doc_id: x.keep for x in quality.scores(df, labels).collect()}
    assert sum(s[i] == (i % 5 != 0) for i in range(300, 600)) >= 297
    kept = quality.kept(df, labels)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, k in s.items() if k}
    assert quality.scores(df, labels.limit(0)).where("keep").count() == 600
    assert quality.scores(df.limit(0), labels).count() == quality.kept(df.limit(0), labels).count() == 0


def brute_quality(rows, labels, weights, bias):
    """(id, evidence, host rate, path rate, quality) of rows (id, text, source, lang), each site's counts summed without the row itself."""
    import regex

    def evidence(text):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
        n = max(1, len(text))
        x = [len(regex.findall(r"\p{Lu}", text)) / n, len(regex.findall(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:'()-]", text)) / n, math.log1p(len(words)) - math.log1p(len(set(words))), math.log1p(len(words))]
        return sum(a * b for a, b in zip(x, weights, strict=True)) + bias

    sig = lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))
    logit = lambda p: math.log(max(min(p, 1 - 1e-6), 1e-6) / (1 - max(min(p, 1 - 1e-6), 1e-6)))
    ev = [evidence(t or "") for _, t, _, _ in rows]
    y = [labels.get(i, sig(e)) for (i, _, _, _), e in zip(rows, ev, strict=True)]
    site = [(s or "", g or "") for _, _, s, g in rows]
    rate = sum(y) / len(y)

    def strength(groups):  # (n, s, prior)
        spread = sum(n * (s / n - p) ** 2 for n, s, p in groups)
        share = (spread - sum(p * (1 - p) for _, _, p in groups)) / sum(n * p * (1 - p) for n, _, p in groups)
        return min(max(1 / share - 1 if share > 0 else 1e6, 2.0), 1e6)

    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, p), v in zip(site, y, strict=True):
        hosts[h].append(v)
        paths[h, p].append(v)
    m = strength([(len(v), sum(v), rate) for v in hosts.values()])
    prior = {h: (sum(v) + m * rate) / (len(v) + m) for h, v in hosts.items()}
    k = strength([(len(v), sum(v), prior[h]) for (h, _), v in paths.items()])
    out = []
    for (i, _, _, _), (h, p), e, v in zip(rows, site, ev, y, strict=True):
        host = (sum(hosts[h]) - v + m * rate) / (len(hosts[h]) - 1 + m)
        path = (sum(paths[h, p]) - v + k * host) / (len(paths[h, p]) - 1 + k)
        out.append((i, e, host, path, sig(e + logit(path) - logit(rate))))
    return out


def test_quality_equals_brute_force(spark):
    where = "/root/testdata/sf0.001"
    if not os.path.isdir(where):
        pytest.skip("no test data here")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    more = spark.createDataFrame([(None, None, None, None, None), (3, "", "en", "alone", 0), (5, "Two texts!", "de", None, 10)], docs.schema)
    df = docs.unionByName(more)
    rows = [(x.doc_id, x.text, x.source, x.lang) for x in df.collect()]
    model = quality.fit(df, labels)
    known = {x.doc_id: float(x.quality) for x in labels.collect()}
    assert model.fitted
    show = lambda out: sorted(((-1 if x[0] is None else x[0]), *(round(v, 6) for v in x[1:])) for x in out)
    got, want = show((x.doc_id, x.evidence, x.host_rate, x.path_rate, x.quality) for x in quality.scores(df, labels).collect()), show(brute_quality(rows, known, model.weights, model.bias))
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6)
    assert Counter(x.doc_id for x in quality.kept(df, labels).collect()) == Counter(x[0] for x in brute_quality(rows, known, model.weights, model.bias) if x[4] >= quality.KEEP_FROM)


def test_a_document_does_not_judge_itself(spark):
    """The label and the text of a document alone on its site change none of what its site says of it."""
    r = random.Random(12)
    rows = [(i, " ".join(r.choice(["stone", "GREEN !!", "walks"]) for _ in range(30)), f"s{i}", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert len({x.path_rate for x in quality.scores(df, labels).collect()}) == 1


def test_sparse_sites_shrink_to_their_priors(spark):
    rows = [("big", "a", 1.0)] * 90 + [("big", "a", 0.0)] * 10 + [("bad", "b", 0.0)] * 100 + [("tiny", "c", 0.0)]
    post, rate = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, y double"))
    p = {r.host: r.path_rate for r in post.collect()}
    assert p["bad"] < 0.1 < rate < p["big"] and p["bad"] < p["tiny"] < rate
    edge = spark.createDataFrame([(1, None, None, None), (2, "", "s", None), (None, "ok text", "s", "en")], "doc_id long, text string, source string, lang string")
    assert quality.scores(edge, spark.createDataFrame([], "doc_id long, quality int")).count() == 3


# -- pages --------------------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<main><article><header><h1>Head &amp; tail</h1></header><p>First <b>bold</b>
 line.<br>Next&nbsp;line <!-- not this --> end.<p>Short.</p><form><label>Mail</label><input value=x><button>Go</button></form>
<div class="share"><a href=x>Share</a></div><blockquote>Quoted &lt;tag&gt;</blockquote></article>
<section id="comments"><article><p>A reader says something rather long about the article and its many merits.</p></article></section></main>
<aside><p>Related stories that are long enough to look like text, with many words in them.</p></aside><div class="ad">Buy now</div><footer>&copy; 2024</footer></body></html>"""


def test_article_without_the_rest():
    assert html_text.main_text(PAGE) == "Head & tail\n\nFirst bold line. Next line end.\n\nShort.\n\nQuoted <tag>"


def test_pages_without_marks():
    text = " ".join(["word"] * 40)
    page = f"<div><a href=1>a</a> <a href=2>b</a></div><div><p>{text}</p><p>{text}</p></div><div><a href=3>more</a> <a href=4>links</a></div>"
    assert html_text.main_text(page) == f"{text}\n\n{text}"


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<article><p>cut &am", "cut &am"), ("<article><p>a<p>b</article", "a\n\nb"), ("<article>x<!-- open", "x"), ("<script>x", ""), ("<article><p>a > b < c</p></article>", "a > b < c")])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_tree_fits_its_table():
    rows = html_text.labelled_table()
    tree = html_text.train_tree(rows)
    assert sum(html_text.keeps(tree, x) == bool(y) for x, y in rows) == len(rows)
    assert {html_text.FEATURES[k] for k in splits(tree)} >= {"words", "density", "words_before", "words_after"}


def splits(tree):
    return [] if isinstance(tree, int) else [tree[0], *splits(tree[2]), *splits(tree[3])]


LONG = "A paragraph of the story goes on for quite a while, as paragraphs of stories do, and it says a thing or two about the matter at hand before it ends. "
#: Pages of common layouts with what a reader takes for their text; none of them is in the labelled table.
READ = {
    "compound name in an article": ("<article><h1>Head</h1><div class='note-header'>Real sub-heading</div><p>" + LONG + "</article>", ["Head", "Real sub-heading", LONG]),
    "section named after a topic": ("<article><p>" + LONG + "<section class='related-work'><h2>Related work</h2><p>" + LONG + "</section></article>", [LONG, "Related work", LONG]),
    "article with a name like an advert": ("<nav><a href=x>Home</a></nav><article class='promo-story'><h1>T</h1><p>" + LONG + "<p>Yes.</article>", ["T", LONG, "Yes."]),
    "unnamed remarks after the article": ("<article><p>" + LONG * 2 + "</article><div class='reader'><p>" + LONG + "<p>I agree.</div>", [LONG * 2]),
    "quote left open": ('<article><p>' + LONG + '<p>Hello <a href="x>link</a> world</article><p class="y">rest', [LONG, "Hello rest"]),
    "quote left open at the end": ("<article><p>" + LONG + "<p>Hello <a title='x>link</a></article>", [LONG, "Hello"]),
    "quotes in a name": ('<article><p "odd">' + LONG + "<p it's>Fine.</article>", [LONG, "Fine."]),
    "greater-than in a value": ('<article><p title="a > b">' + LONG + "<img alt='x>y'>End.</article>", [LONG + "End."]),
    "comments in the article": ("<article><p>" + LONG + "<p>End.<div id='comments'><p>" + LONG + "<p>Me too.</div></article>", [LONG, "End."]),
    "comments as articles": ("<main><article><p>" + LONG + "</article><div class='comment-list'><article class='comment'><p>" + LONG + "</article></div></main>", [LONG]),
    "longer comments than text": ("<article><h1>T</h1><p>" + LONG * 2 + "</article><section class=comments><p>" + "<p>".join([LONG * 2] * 4) + "</section>", ["T", LONG * 2]),
    "form around the page": ("<form id=aspnet><div class=nav><a href=a>One</a> <a href=b>Two</a></div><article><h1>T</h1><p>" + LONG + "<p>Short.</article></form>", ["T", LONG, "Short."]),
    "form in the article": ("<article><p>" + LONG + "<form action=x><label>Your mail</label><p>We send you a letter every week.<button>Go</button></form><p>End.</article>", [LONG, "End."]),
    "layout class around all": ("<div class='layout-sidebar-right'><div class='post-content'><h1>T</h1><p>" + LONG + "<p>" + LONG + "</div><div class='sidebar'><p>About the author, who writes.</div></div>", ["T", LONG, LONG]),
    "body class": ("<body class='has-sidebar ad'><article><p>" + LONG + "</article>", [LONG]),
    "notices and adverts": ("<div class='cookie-banner'><p>" + LONG + "</div><div id=ad>Buy now, while it is cheap</div><article><h1>T</h1><p>" + LONG + "<div class=advert>Cheap things</div><p>Ok.</article>", ["T", LONG, "Ok."]),
    "header and footer in the article": ("<article><header><h1>T</h1></header><p>" + LONG + "<p>" + LONG + "<footer>Posted in things</footer></article><footer>Imprint</footer>", ["T", LONG, LONG]),
    "aside in the article": ("<article><p>" + LONG + "<aside><p>" + LONG[:60] + "</aside><p>Last.</article>", [LONG, "Last."]),
    "main without an article": ("<header><a href=/>Site</a></header><main><h1>T</h1><p>" + LONG + "<p>One.<p>" + LONG + "</main><aside><p>" + LONG + "</aside><footer>Imprint and more</footer>", ["T", LONG, "One.", LONG]),
    "roles": ("<div role=navigation><a href=a>A</a></div><div role=main><p>" + LONG + "<p>So.<p>" + LONG + "</div><div role=contentinfo>Imprint and more</div>", [LONG, "So.", LONG]),
    "old tables": ("<table><tr><td><a href=a>Start</a><br><a href=b>Next</a></td><td><p>" + LONG * 2 + "<p>" + LONG * 2 + "</td></tr></table>", [LONG * 2, LONG * 2]),
    "no marks": ("<div><a href=1>a</a> <a href=2>b</a></div><p>" + LONG * 2 + "<p>" + LONG * 2 + "<p>" + LONG + "<div><a href=3>more</a> <a href=4>links</a></div>", [LONG * 2, LONG * 2, LONG]),
    "links in the text": ("<article><p>" + LONG + "<ul><li><a href=a>First source</a></li><li>Second source</li></ul><p><a href=b>Further on</a><p>End.</article>", [LONG, "First source", "Second source", "Further on", "End."]),
    "menu only": ("<ul><li><a href=a>One</a></li><li><a href=b>Two or three</a></li><li><a href=c>Four</a></li></ul>", []),
    "hidden parts": ("<article><p>" + LONG + "<div hidden>Not seen</div><div aria-hidden=true>Nor this</div><template><p>x</template><p>Seen.</article>", [LONG, "Seen."]),
    "preformatted and quotes": ("<article><pre>a  b\n c</pre><blockquote>Said.</blockquote><dl><dt>Word</dt><dd>Sense</dd></dl><figure><figcaption>What it shows</figcaption></figure></article>", ["a b c", "Said.", "Word", "Sense", "What it shows"]),
}


@pytest.mark.parametrize("name", list(READ))
def test_layouts(name):
    page, want = READ[name]
    assert html_text.main_text(page) == "\n\n".join(x.strip() for x in want)


def test_page_rows(spark):
    df = frame(spark, [(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, *[len(html_text.main_text(PAGE))] * 2] and html_text.extract(df.limit(0)).count() == 0


# -- archives --------------------------------------------------------------------------------------


def pages(spark, n=700):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h/"), "id").alias("url"), F.concat(F.lit("<p>é"), "id", F.lit("</p>")).alias("html"))


def test_audit_finds_damage(spark):
    p = pages(spark)
    got = warc.audited_pages(p, p.withColumn("html", F.when(F.col("page_id").isin(5, 699), "<p>bad</p>").otherwise(F.col("html"))))
    wrong = {r.key.split()[0] for r in got.where("status <> 'intact'").collect() if r.status == "differs" and r.key.startswith(("5 ", "699 "))}
    assert got.count() == 700 and wrong == {"5", "699"}
    same_length = p.withColumn("html", F.when(F.col("page_id") == 300, F.regexp_replace("html", "<p>", "<q>")).otherwise(F.col("html")))
    assert [r.key for r in warc.audited_pages(p, same_length).where("status <> 'intact'").collect()] == ["300 https://h/300"]
    assert warc.audited_pages(p, p).where("status <> 'intact'").count() == 0
    short = warc.audited_pages(p, p.where("page_id < 690"))
    assert {r.status for r in short.where("status <> 'intact'").collect()} == {"missing"} and short.where("status = 'missing'").count() == 10


def test_only_bad_branches_are_descended(spark):
    p = pages(spark)
    one, two = (warc.leaves(warc.page_records(x, warc.record(), 100)) for x in (p, p.withColumn("html", F.when(F.col("page_id") == 42, F.regexp_replace("html", "p", "q")).otherwise(F.col("html")))))
    damage, counts = warc.audit(one, two)
    assert [r.leaf for r in damage.collect()] == [42] and {r.level: r.compared for r in counts.collect()} == {2: 7, 1: 7, 0: 16}


def test_offsets_are_prefix_sums(spark):
    p = pages(spark)
    got = warc.leaves(warc.page_records(p, warc.record())).orderBy("leaf").collect()
    raw = p.select("page_id", warc.record().alias("r")).orderBy("page_id").collect()
    at = 0
    for g, r in zip(got, raw, strict=True):
        assert (g.offset, g.length) == (at, len(r.r))
        at += g.length


def test_record_round_trip(spark):
    p = pages(spark, 5).withColumn("r", warc.record())
    back = p.select("url", "html", warc.parse_record("r").alias("x")).collect()
    assert all(b.x.url == b.url and b.x.payload == b.html and b.x.intact for b in back)
    cut = p.select(warc.parse_record("c").alias("x")) if "c" in p.columns else p.withColumn("c", F.concat(F.expr("substring(r, 1, octet_length(r) - 8)"), F.lit(b"xxxxxxxx"))).select(warc.parse_record("c").alias("x"))
    assert not any(r.x.intact for r in cut.collect())
    assert p.withColumn("c", F.lit(b"junk")).select(warc.parse_record("c").alias("x")).first().x is None


def brute_archives(rows, most=2048):
    """Records of each archive in order, as (key, bytes), by the definition; rows: (page_id, url, html)."""
    out = defaultdict(list)
    for i, u, h in rows:
        body, name = (h or "").encode(), "\n".join(["" if i is None else str(i), u or ""])
        x = hashlib.sha256(name.encode()).hexdigest()
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {u or ''}\r\nWARC-Record-ID: <urn:uuid:{x[:8]}-{x[8:12]}-5{x[13:16]}-8{x[17:20]}-{x[20:32]}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
        key = u or "" if i is None else f"{i} {u or ''}"
        out["pages-none" if i is None else f"pages-{i // most:06d}"].append((-1 if i is None else i, key, head.encode() + body + b"\r\n\r\n"))
    return out


def brute_root(records):
    """Root of the Merkle tree over (offset, length, SHA-256) of the records, built in Python."""
    at, level = 0, []
    for raw in records:
        level.append((hashlib.sha256(f"{at}:{len(raw)}:{hashlib.sha256(raw).hexdigest()}".encode()).hexdigest(), at, at + len(raw)))
        at += len(raw)
    while len(level) > 1:
        groups = [level[i : i + warc.FANOUT] for i in range(0, len(level), warc.FANOUT)]
        level = [(hashlib.sha256(":".join([str(g[0][1]), str(g[-1][2]), ",".join(x[0] for x in g)]).encode()).hexdigest(), g[0][1], g[-1][2]) for g in groups]
    return level[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"https://h/{i}", "<p>" + "é" * r.randrange(40) + str(i)) for i in range(500)]
    other = []
    for i, u, h in rows:
        x = r.random()
        other += [] if x < 0.01 else [(i, u, h + "!" * r.randrange(2))] if x < 0.02 else [(i, u, "?" + h[1:])] if x < 0.03 else [(i, u, h)]
    other += [(700 + k, "new", "page") for k in range(3)]
    schema = "page_id long, url string, html string"
    leaf = [warc.leaves(warc.page_records(spark.createDataFrame(x, schema).repartition(4), warc.record(), 100)) for x in (rows, other)]
    for x, mine in zip((rows, other), leaf, strict=True):
        top = {n.archive: (n.hash, n.begin, n.end) for n in warc.tree(mine)[-1].collect()}
        want = {a: brute_root([raw for _, _, raw in sorted(v)]) for a, v in brute_archives(x, 100).items()}
        # archives are as deep as the largest one: a root of a smaller one is hashed as an only child
        assert set(top) == set(want) and all(top[a][1:] == want[a][1:] for a in top)
        assert sum(top[a] == want[a] for a in top) >= 5
    damage, _ = warc.audit(*leaf)
    got = Counter((d.archive, d.key, d.status) for d in damage.collect())
    want = Counter()
    one, two = brute_archives(rows, 100), brute_archives(other, 100)
    for a in set(one) | set(two):
        place = []
        for side in (one, two):
            at, seen = 0, {}
            for _, key, raw in sorted(side.get(a, [])):
                seen[key] = (raw, at)
                at += len(raw)
            place.append(seen)
        for key in set(place[0]) | set(place[1]):
            x, y = place[0].get(key), place[1].get(key)
            if x != y:
                want[a, key, "missing" if y is None else "extra" if x is None else "moved" if x[0] == y[0] else "differs"] += 1
    assert got == want and {"missing", "moved", "differs", "extra"} <= {s for _, _, s in got}


def test_a_shift_is_one_finding(spark):
    p = pages(spark, 300)
    got = warc.audit(*(warc.leaves(warc.page_records(x, warc.record())) for x in (p, p.where("page_id <> 40"))))[0]
    assert sorted((f.status, f.first_leaf, f.last_leaf, f.n) for f in warc.findings(got).collect()) == [("missing", 40, 40, 1), ("moved", 41, 299, 259)]


def test_hot_and_missing_ids_are_laid_out_whole(spark):
    n = 3 * warc.HOT
    p = spark.range(n).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 3 == 0, F.col("id") % 250).alias("page_id"), F.concat(F.lit("u"), F.col("id") % 5000).alias("url"), F.lit("x").alias("html"))
    for x in warc.leaves(warc.page_records(p, warc.record())).groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("leaf", "offset", "length", "key"))).alias("r")).collect():
        assert [y.leaf for y in x.r] == list(range(len(x.r)))
        assert all(a.offset + a.length == b.offset for a, b in zip(x.r, x.r[1:], strict=False)) and x.r[0].offset == 0
        ids = [int(y.key.split()[0]) for y in x.r if " " in y.key]
        assert ids == sorted(ids)


def test_archive_edges(spark):
    df = frame(spark, [(None, None, None), (1, "u", None), (1, "u", None), (2, "v", "")], "page_id long, url string, html string")
    got = warc.audited_pages(df, df)
    assert got.count() == 4 and got.where("status <> 'intact'").count() == 0
    assert warc.audited_pages(df.limit(0), df.limit(0)).count() == 0


# -- tokens --------------------------------------------------------------------------------------------


def tokens():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def brute_sections(text, sections, rule):
    import base64

    import tiktoken

    path, pattern = tokens()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    at, out = 0, Counter()
    starts = [len(text[:a].encode()) for a, _ in sections]
    ends = [len(text[:b].encode()) for _, b in sections]
    for t in e.encode_ordinary(text):
        n = len(e.decode_single_token_bytes(t))
        share = [len(range(max(a, at), min(b, at + n))) for a, b in zip(starts, ends, strict=True)]
        where = {"start": [a <= at < b for a, b in zip(starts, ends, strict=True)], "end": [a <= at + n - 1 < b for a, b in zip(starts, ends, strict=True)], "most": [s > 0 and s == max(share) for s in share]}[rule]
        if any(where):
            out[where.index(True)] += 1
        at += n
    return [out[i] for i in range(len(sections))]


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_sections_equal_brute_force(spark, rule):
    text = "Überschrift\nsome running text with unfamiliarities 😀 and numbers 12345\n\nlast"
    cuts = [(0, 5), (5, 17), (20, 40), (40, 41), (50, len(text))]
    sections = F.array(*[F.struct(F.lit(str(i)).alias("name"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, (a, b) in enumerate(cuts)])
    got = token_spans.section_counts(frame(spark, [(1, text)]), *tokens(), sections=sections, rule=rule).first()
    assert [s.n_tokens for s in got.sections] == brute_sections(text, cuts, rule)


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_odd_sections_equal_brute_force(spark, rule):
    """Unsorted, overlapping, empty and unbounded sections: each byte is of the section that begins last."""
    r = random.Random(len(rule))
    text = "Überschrift und some running text with unfamiliarities 😀 and numbers 12345 at the end"
    given = [[(None, 5), (3, None), None, (9, 2), (4, 4)]] + [[(r.randrange(-3, 90), r.randrange(0, 99)) for _ in range(r.randrange(9))] for _ in range(20)]
    rows = [(i, text, [None if x is None else (str(k), *x) for k, x in enumerate(g)]) for i, g in enumerate(given)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<name:string,start:int,end:int>>")
    got = {x.doc_id: [(s.start, s.end, s.n_tokens) for s in x.sections] for x in token_spans.section_counts(df, *tokens(), sections=F.col("spans"), rule=rule).collect()}
    for i, g in enumerate(given):
        owner = [-1] * len(text)
        for k, x in sorted(enumerate(g), key=lambda p: (-99 if p[1] is None or p[1][0] is None else max(p[1][0], 0), p[0])):
            if x and None not in x:
                for at in range(max(x[0], 0), min(max(x[1], 0), len(text))):
                    owner[at] = k
        cuts, whose = [], []
        for at, k in enumerate(owner):
            if k >= 0 and whose and whose[-1] == k and cuts[-1][1] == at:
                cuts[-1] = (cuts[-1][0], at + 1)
            elif k >= 0:
                cuts.append((at, at + 1))
                whose.append(k)
        want = [0] * len(g)
        for k, n in zip(whose, brute_sections(text, cuts, rule), strict=True):
            want[k] += n
        assert got[i] == [((None, None) if x is None else x) + (n,) for x, n in zip(g, want, strict=True)]


def test_lines_and_fields_add_up(spark):
    df = frame(spark, EDGES)
    for r in token_spans.section_counts(df, *tokens()).collect():
        assert sum(s.n_tokens for s in r.sections) == r.n_tokens
    text, sections = token_spans.field_sections("doc_id", "text", "h")
    got = token_spans.section_counts(df, *tokens(), text=text, sections=sections).collect()
    assert len(got) == len(EDGES) and all(sum(s.n_tokens for s in r.sections) == r.n_tokens and [s.name for s in r.sections] == ["doc_id", "text", "h"] for r in got)
    assert token_spans.section_counts(df.limit(0), *tokens()).count() == 0
    with pytest.raises(ValueError):
        token_spans.section_counts(df, *tokens(), rule="other")


def test_ids_that_are_no_numbers(spark):
    """They are null ids, and no row is lost."""
    df = frame(spark, [("x", "one\ntwo lines"), ("7", "other words")], "doc_id string, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en"), "quality": F.lit(1)})
    items = spark.createDataFrame([("y", "other words"), ("3", "two lines")], "item_id string, text string")
    outs = [
        sp_encode.encode_digests(df, piece_model()), token_spans.section_counts(df, *tokens()), license_scan.scan(df), fingerprints.compare_with_next(df), decontam.matches(df, items),
        neardup.classes(df), quality.scores(df, df.select("doc_id", "quality")), html_text.extract(df.withColumnRenamed("doc_id", "page_id").withColumns({"url": F.lit(""), "html": F.col("text")})).withColumnRenamed("page_id", "doc_id"),
    ]
    for out in outs:
        assert sorted(r.doc_id or 0 for r in out.select("doc_id").collect()) == [0, 7]
    assert line_chunks.remove_repeated(df).count() == neardup.keep_one(df).count() == quality.kept(df, df.select("doc_id", "quality")).count() == decontam.clean(df, items.limit(0)).count() == 2
    pages_ = df.withColumnRenamed("doc_id", "page_id").withColumns({"url": F.lit("u"), "html": F.col("text")})
    assert warc.audited_pages(pages_, pages_).count() == 2
