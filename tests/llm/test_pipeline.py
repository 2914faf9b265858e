"""The queries with SQL against DuckDB, and each pipeline stage against a brute-force version of it on its own input."""

from __future__ import annotations

import os

import duckdb
import pytest
from test_line_runs import runs_gone
from test_operators import brute_classes, brute_gone

import corpus_pipeline
from corpusgraph.llm import decontam, quality
from corpusgraph.llm.queries import ORACLES, QUERIES, piece_model

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@needs_data
@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*cols).collect()
    show = lambda rows: sorted(tuple("-" if v is None else str(v) for v in r) for r in rows)
    assert show(got) == show(want.fetchall())


def brute_line_stage(docs):
    """Texts without the lines that brute force removes as a repeated chunk or as part of a repeated run."""
    chunks, runs, out = brute_gone(docs), runs_gone(docs), {}
    for d, t in docs:
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in chunks[d] | runs[d])
    return out


@needs_data
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        seen.append((name, before, after))
        docs = out
    _, before, after = seen[0]
    full, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert set(after) == {r.doc_id for r in quality.scores(full, labels).where("keep").collect()} and len(after) > 0.7 * len(before)
    _, before, after = seen[1]
    assert {d: r.text for d, r in after.items()} == brute_line_stage(sorted(before.items())) and all(r.n_chars == len(r.text) for r in after.values())
    _, before, after = seen[2]
    ids = sorted(before)
    assert set(after) == {ids[c] for c in brute_classes([before[i] for i in ids])}
    _, before, after = seen[3]
    index = decontam.ItemIndex([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], decontam.SEED)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {d for d, t in before.items() if max(index.coverage(t).values(), default=0) < decontam.COVERAGE}
    assert not any(i in r.text for r in after.values() for i in items)
    _, before, after = seen[4]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert {d: r.n_tokens for d, r in after.items()} == {d: len(sp.encode(t)) for d, t in before.items()}


@needs_data
def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and "ids_sha256" in got.columns
