"""Benchmark items without an id."""

from __future__ import annotations

import corpus_pipeline
from corpusgraph.llm import decontam
from corpusgraph.llm.queries import QUERIES


def test_items_without_id_contaminate(spark, tmp_path):
    one, two, three = (" ".join(f"{w}{i}" for i in range(12)) for w in "abc")
    items = spark.createDataFrame([(None, one), (None, two), (7, three), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"{three} {two} {one}"), (3, "nothing of them"), (4, three)], "doc_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_items, r.item_ids, r.max_coverage, r.contaminated) for r in QUERIES["op8_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, [None], 1.0, True), 2: (3, [7, None, None], 1.0, True), 3: (0, [], 0.0, False), 4: (1, [7], 1.0, True)}
    assert [r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()] == [3]
    assert decontam.report(docs, items, block_words=10, unnamed=True).where("contaminated").count() == 3
