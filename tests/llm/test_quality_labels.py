"""Labels of one class only."""

from __future__ import annotations

import pytest

from corpusgraph.llm import quality


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_class_keep_every_document(spark, label):
    rows = [(i, f"Some plain text number {i}.", "ab"[i % 2], "en" if i % 3 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = [(i, label) for i in range(60) if i % 2 and i % 5]  # sites differ in their share of labelled rows
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == 60 and all(r.keep and r.quality == 0.5 for r in got)
    assert sorted(r.doc_id for r in quality.kept(docs, labels).collect()) == list(range(60))
    assert quality.kept(docs, labels, keep_from=0.7).count() == 60 and all(r.keep for r in quality.scores(docs, labels, keep_from=0.7).collect())
