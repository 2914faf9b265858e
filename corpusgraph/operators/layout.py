"""A settled three-dimensional layout of each site's graph: numpy inside one group of rows for each site.

Deterministic: start places are hashes of (seed, node).  Springs of structural links, repulsion within and between grid
cells, a pull to the chapter's centre and, for unlinked nodes, to an outer shell; every round reads the places of the
round before.  Derived edges never pull.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.config import DERIVED_KINDS
from corpusgraph.operators.common import cut, small, top
from corpusgraph.operators.index import numbered

# The layout's constants.
R_MAX, SPRING, REST, REP_CUT, CELL_CUT, MAX_STEP = 0.999, 0.35, 0.10, 0.12, 0.35, 0.06
STAGE_NEAR, STAGE_FAR = 0.55, 0.92
WEIGHT, OTHER_WEIGHT = {"ref": 1.0, "imports": 1.0, "contains": 0.30, "hub": 0.30}, 0.10
SCALE, LIMIT = 30000, 32767
LOOSE_REST, PUSH, CELL_PUSH, CHAPTER_PULL, SHELL_PULL, SHELL, ANCHOR_PULL = 1.6, 0.022, 0.010, 0.012, 0.008, 0.9, 0.12
ALL_PAIRS, CROWDED, NEXT = 5000, 48, 3  # nodes up to which all of a cell meet; members from which only the next few do
JITTER, LOCATED = 0.05, 8
# Fixed values of the shells: outer radius, inner share, pull of hubs, tilt, and how far a node is off its lattice point.
SHELL_RADIUS, SHELL_INNER, HUB_PULL, TILT, OFF_ANGLE, OFF_RADIUS = 100.0, 0.30, 0.30, 0.55, 0.30, 0.03
GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))


def _random(seed: int, *parts: object) -> float:
    raw = "|".join(map(str, (seed, *parts))).encode()
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") / 2**64


def stage(seed: int, node: str) -> tuple[float, float, float]:
    """Start place of a node: a direction and a radius between two shells."""
    u, phi = _random(seed, "stage", node), 2 * math.pi * _random(seed, "phi", "stage", node)
    z = 2 * u - 1
    r = STAGE_NEAR + (STAGE_FAR - STAGE_NEAR) * _random(seed, "radius", node)
    flat = math.sqrt(max(0.0, 1 - z * z))
    return flat * math.cos(phi) * r, z * r, flat * math.sin(phi) * r


def rounds_for(n: int) -> int:
    return 40 if n <= 2000 else 24 if n <= 20000 else 14


def _cell_pairs(cell: np.ndarray, all_pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs inside each cell: all, or of a crowded cell each member with the few after it."""
    order = np.argsort(cell, kind="stable")
    _, begin, size = np.unique(cell[order], return_index=True, return_counts=True)
    a, b = [], []
    for s, m in zip(begin, size, strict=True):
        mine = order[s : s + m]
        if all_pairs or m <= CROWDED:
            i, j = np.triu_indices(m, 1)
        else:
            steps = range(1, NEXT + 1)
            i, j = np.concatenate([np.arange(m - d) for d in steps]), np.concatenate([np.arange(d, m) for d in steps])
        a.append(mine[i])
        b.append(mine[j])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def relax(start: np.ndarray, cluster: np.ndarray, springs: np.ndarray, weight: np.ndarray, anchors: np.ndarray | None = None) -> np.ndarray:
    """Settled places of nodes: start (n, 3), cluster numbers (n,), springs (m, 2), weight (m,), and places (n, 3) that
    nodes are drawn back to, nan for none."""
    x, n = start.astype(float).copy(), len(start)
    if n == 0:
        return x
    members = np.bincount(cluster).astype(float)
    centre = np.stack([np.bincount(cluster, x[:, k]) / members for k in range(3)], 1)[cluster]
    loose = np.bincount(springs.ravel(), minlength=n) == 0 if len(springs) else np.ones(n, bool)
    rest = np.where(weight >= 1, REST, REST * LOOSE_REST)
    side = max(REP_CUT, (4.19 / n) ** (1 / 3) * 1.5)
    forward = [(dx, dy, dz) for dx in (0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) > (0, 0, 0)]
    for _ in range(rounds_for(n)):
        f = np.zeros_like(x)
        if len(springs):
            d = x[springs[:, 1]] - x[springs[:, 0]]
            r = np.linalg.norm(d, axis=1) + 1e-9
            pull = d / r[:, None] * (SPRING * weight * (r - rest))[:, None]
            np.add.at(f, springs[:, 0], pull)
            np.add.at(f, springs[:, 1], -pull)
        grid = np.floor(x / side).astype(int)
        keys, cell = np.unique(grid, axis=0, return_inverse=True)
        cell = cell.ravel()
        a, b = _cell_pairs(cell, n <= ALL_PAIRS)
        d = x[b] - x[a]
        r = np.linalg.norm(d, axis=1)
        near = (r < REP_CUT) & (r * r >= 1e-12)
        push = d[near] * (PUSH * (REP_CUT - r[near]) / r[near])[:, None]
        np.add.at(f, a[near], -push)
        np.add.at(f, b[near], push)
        mean = np.stack([np.bincount(cell, x[:, k]) for k in range(3)], 1) / np.bincount(cell)[:, None]
        field = np.zeros_like(mean)
        where = {tuple(k): i for i, k in enumerate(keys)}
        for i, k in enumerate(keys):
            for step in forward:
                j = where.get(tuple(k + step))
                if j is not None:
                    gap = mean[j] - mean[i]
                    r1 = float(np.linalg.norm(gap)) + 1e-9
                    if r1 < CELL_CUT:
                        field[i] -= gap * (CELL_PUSH * (CELL_CUT - r1) / r1)
                        field[j] += gap * (CELL_PUSH * (CELL_CUT - r1) / r1)
        f += field[cell] + CHAPTER_PULL * (centre - x)
        r = np.linalg.norm(x, axis=1) + 1e-9
        f += np.where(loose, SHELL_PULL * (SHELL - r) / r, 0)[:, None] * x
        if anchors is not None:
            f += np.nan_to_num(ANCHOR_PULL * (anchors - x))
        step = np.linalg.norm(f, axis=1)
        x += f * np.where(step > MAX_STEP, MAX_STEP / np.maximum(step, 1e-12), 1)[:, None]
    top = np.abs(x).max()
    return x * (R_MAX / top if top > R_MAX else 1.0)


def settle(nodes: DataFrame, edges: DataFrame, seed: int = 7, anchors: DataFrame | None = None) -> DataFrame:
    """(site_id, i, x, y, z) of nodes (site_id, i, c) and edges (site_id, s, t, k); a site is laid out in one task.

    Nodes with a place in ``anchors`` (site_id, i, x, y, z) begin there and are drawn back to it.
    """
    none = [F.lit(None).cast("double").alias(v) for v in "xyz"]
    a = nodes.select("site_id", F.lit(0).alias("edge"), "i", F.col("c").alias("x1"), F.lit(None).cast("string").alias("x2"), *none)
    b = edges.where(~F.col("k").isin(*DERIVED_KINDS)).select("site_id", F.lit(1).alias("edge"), F.col("s").alias("i"), F.col("t").alias("x1"), F.col("k").alias("x2"), *none)
    both = a.union(b)
    if anchors is not None:
        both = both.union(anchors.select("site_id", F.lit(2).alias("edge"), "i", F.lit(None).cast("string"), F.lit(None).cast("string"), "x", "y", "z"))

    def lay(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows[rows["edge"] == 0].drop_duplicates("i").sort_values("i").reset_index(drop=True)
        place = {i: k for k, i in enumerate(n["i"])}
        e = rows[(rows["edge"] == 1) & rows["i"].isin(place) & rows["x1"].isin(place) & (rows["i"] != rows["x1"])].sort_values(["i", "x1", "x2"])
        springs = np.array([[place[s], place[t]] for s, t in zip(e["i"], e["x1"], strict=True)], int).reshape(-1, 2)
        weight = np.array([WEIGHT.get(k, OTHER_WEIGHT) for k in e["x2"]])
        cluster = np.unique(n["x1"].fillna("").to_numpy(str), return_inverse=True)[1]
        start = np.array([stage(seed, i) for i in n["i"]]).reshape(-1, 3)
        held = rows[(rows["edge"] == 2) & rows["i"].isin(place)].drop_duplicates("i")
        at = np.full_like(start, np.nan)
        at[[place[i] for i in held["i"]]] = held[["x", "y", "z"]].to_numpy(float)
        xyz = relax(np.where(np.isnan(at), start, at), cluster, springs, weight, at if len(held) else None)
        return pd.DataFrame({"site_id": rows["site_id"].iloc[0], "i": n["i"], "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return both.groupBy("site_id").applyInPandas(lay, "site_id string, i string, x double, y double, z double")


def placed(nodes: DataFrame, edges: DataFrame, known: DataFrame, seed: int = 7) -> DataFrame:
    """(site_id, i, x, y, z) of nodes (site_id, i) that aren't among the ``known`` places yet.

    A node comes near the weighted mean of its first LOCATED neighbours that have a place, by their ids, a little off by a
    hash of its own id; without one it comes to its start place.  Places of one batch don't see each other.
    """
    new = nodes.select("site_id", "i").distinct().join(known.select("site_id", "i"), ["site_id", "i"], "left_anti")
    weight = F.lit(OTHER_WEIGHT)
    for kind, w in WEIGHT.items():
        weight = F.when(F.col("k") == kind, F.lit(w)).otherwise(weight)
    both = edges.select("site_id", F.col("s").alias("i"), F.col("t").alias("o"), weight.alias("w")).union(edges.select("site_id", F.col("t").alias("i"), F.col("s").alias("o"), weight.alias("w")))
    near = both.where("i <> o").groupBy("site_id", "i", "o").agg(F.max("w").alias("w")).join(known.select("site_id", F.col("i").alias("o"), "x", "y", "z"), ["site_id", "o"])
    near = top(near.join(new, ["site_id", "i"], "left_semi"), ["site_id", "i"], [F.col("o")], LOCATED)
    mean = near.groupBy("site_id", "i").agg(*[(F.sum(F.col(v) * F.col("w")) / F.sum("w")).alias(v) for v in "xyz"])

    def put(frames):
        for f in frames:
            out = []
            for i, x, y, z in zip(f["i"], f["x"], f["y"], f["z"], strict=True):
                p = np.array(stage(seed, i))
                if x == x:
                    u, phi = 2 * _random(seed, "jitter", i) - 1, 2 * math.pi * _random(seed, "phi", "jitter", i)
                    flat, r = math.sqrt(max(0.0, 1 - u * u)), JITTER * (0.35 + 0.65 * _random(seed, "jitter-r", i))
                    p = np.array([x + flat * math.cos(phi) * r, y + u * r, z + flat * math.sin(phi) * r])
                n = float(np.linalg.norm(p))
                out.append(p * (R_MAX / n) if n > R_MAX else p)
            xyz = np.array(out).reshape(-1, 3)
            yield pd.DataFrame({"site_id": f["site_id"], "i": f["i"], "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return new.join(mean, ["site_id", "i"], "left").mapInPandas(put, "site_id string, i string, x double, y double, z double")


def shells(nodes: DataFrame, edges: DataFrame, seed: int = 7) -> DataFrame:
    """(i, x, y, z) of nodes (i, c) of one graph: a shell for each chapter, the largest outermost, its nodes on a spiral
    of equal steps in id order, and hubs drawn inwards.

    Nodes are numbered by ranges of (chapter, id), so a chapter of any size is many tasks' work.
    """
    draw = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) / float(1 << 52)
    degree = edges.select(F.explode(F.array("s", "t")).alias("i")).groupBy("i").agg(F.count("*").alias("d"))
    line = numbered(nodes.select("i", F.coalesce("c", F.lit("")).alias("c")).distinct().withColumn("o", F.struct("c", "i")), "o")
    chapter = cut(line.groupBy("c").agg(F.count("*").alias("m"), F.min("__i").alias("first")))
    most = chapter.agg(F.max("m").alias("biggest"))
    p = line.join(small(chapter), "c").join(degree, "i", "left").crossJoin(F.broadcast(most)).crossJoin(F.broadcast(degree.agg(F.max("d").alias("dmax"))))  # one row each
    j = F.col("__i") - F.col("first")
    y = 1 - 2 * (j + 0.5) / F.col("m")
    flat, phi = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y)), j * GOLDEN_ANGLE + (2 * draw(F.lit("angle"), F.col("i")) - 1) * OFF_ANGLE
    yaw, tilt = 2 * math.pi * draw(F.lit("yaw"), F.col("c")), (2 * draw(F.lit("tilt"), F.col("c")) - 1) * TILT
    radius = SHELL_RADIUS * (SHELL_INNER + (1 - SHELL_INNER) * F.sqrt(F.col("m") / F.col("biggest")))
    pull = 1 - HUB_PULL * F.sqrt(F.coalesce("d", F.lit(0)) / F.greatest(F.coalesce("dmax", F.lit(1)), F.lit(1)))
    r = radius * pull * (1 + (2 * draw(F.lit("radius"), F.col("i")) - 1) * OFF_RADIUS)
    p = p.select("i", (flat * F.cos(phi)).alias("a"), y.alias("b"), (flat * F.sin(phi)).alias("e"), yaw.alias("yaw"), tilt.alias("tilt"), r.alias("r"))
    p = p.select("i", "b", "r", "tilt", (F.col("a") * F.cos("yaw") + F.col("e") * F.sin("yaw")).alias("a"), (F.col("e") * F.cos("yaw") - F.col("a") * F.sin("yaw")).alias("e"))
    return p.select("i", F.round(F.col("a") * F.col("r"), 2).alias("x"), F.round((F.col("b") * F.cos("tilt") - F.col("e") * F.sin("tilt")) * F.col("r"), 2).alias("y"), F.round((F.col("b") * F.sin("tilt") + F.col("e") * F.cos("tilt")) * F.col("r"), 2).alias("z"))
