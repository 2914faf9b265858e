from __future__ import annotations

import random
from itertools import combinations

import pytest

from corpusgraph.operators import relations


def brute(rows: list[tuple[str, str]], cap: int = 5) -> set[tuple[str, str]]:
    of: dict[str, set[str]] = {}
    for d, e in rows:
        of.setdefault(d, set()).add(e)
    df = {e: sum(e in s for s in of.values()) for s in of.values() for e in s}
    use = {d: {e for e in s if 2 <= df[e] <= max(2, int(len(of) * 0.3))} for d, s in of.items()}
    met: dict[str, list] = {d: [] for d in of}
    for a, b in combinations(of, 2):
        if (n := len(use[a] & use[b])) >= 2:
            met[a].append((-n, b))
            met[b].append((-n, a))
    return {(a, b) for a, near in met.items() for _, b in sorted(near)[:cap] if a < b}


@pytest.mark.parametrize("block, counted", [(1 << 20, 1 << 21), (40, 30)])
def test_entities_with_copies_and_ties_in_blocks(spark, monkeypatch, block, counted):
    monkeypatch.setattr(relations, "COUNTED", counted, raising=False)
    rng = random.Random(5)
    sets = [rng.sample(range(25), rng.randint(1, 6)) for _ in range(60)]
    rows = [(f"d{k}", f"e{e}") for k in range(160) for e in sets[k if k < 50 else rng.randrange(60)]]
    got = [tuple(r) for r in relations.shares_entity(spark.createDataFrame(rows, "id string, entity string"), block=block).select("s", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and got
