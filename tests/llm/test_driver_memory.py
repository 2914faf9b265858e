from __future__ import annotations

import gc

from corpusgraph.llm._common import tidy
from corpusgraph.llm.components import components, joined


def test_garbage_is_collected_when_the_heap_has_grown(spark):
    assert tidy(spark, 0.0) and not tidy(spark, 1.1)
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    kept = [spark._jvm.java.util.ArrayList(1_000_000) for _ in range(60)]  # 240 MB at least
    grown = heap.totalMemory() - heap.freeMemory()
    del kept
    gc.collect()
    assert tidy(spark, 0.0) and heap.totalMemory() - heap.freeMemory() < grown


def test_further_links_join_components(spark):
    links = [(1, 2), (2, 3), (5, 6), (8, 9), (20, 21)]
    for more in ([(3, 6)], [(9, 30), (30, 6)], [(40, 41), (1, 3)], [(9, 5), (6, 2), (50, 20), (50, 51)]):
        frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
        got = joined(components(frame(links)), frame(more))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, components(frame(links + more)).collect()))
