"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log-odds of a logistic regression on a few shares of its text (JVM-side expressions),
fitted on a bounded sample of labelled rows.  Sites add to it: every document counts in its host and in its path below
the host, with its label if it has one and else with its probability.  The rate of a host is shrunk toward the global
rate and the rate of a path toward its host's, with strengths estimated by moments over all hosts and all paths, so that
sparse sites stay near their priors.  The decision adds the log-odds by which the path's posterior differs from the
global rate.  A document is left out of its own site's counts, so that neither its label nor its own evidence comes back
to it through its site; one that is alone on its site gets the global rate.  Counts are grouped aggregations with
map-side combine, so that a host with a third of all rows is as cheap as any; nothing of a host is gathered but its
counts.

Any two levels of columns can be host and path.  The documents table has no addresses: its ``source`` is the host, and
the ``lang`` of a document, under which sites commonly keep their translations, stands for the first step of the path.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm._common import cut, release, small, unused

#: Labelled rows that the classifier is fitted on at most: those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
#: Probability of good quality from which a document is kept.
KEEP_FROM = 0.5
#: Bounds of the strength of a prior, in documents.
STRENGTH = (2.0, 1e6)


def features(text: str = "text") -> list[Column]:
    """Shares of capitals, of signs, of table bars and of different words, and the logarithm of the number of words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, "\\s+"), lambda w: w != "")
    n_words = F.size(words)
    return [
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / n,
        F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,;:'()-]+", "")) / n,
        F.log1p(n_words.cast("double")) - F.log1p(F.size(F.array_distinct(words)).cast("double")),
        F.log1p(n_words.cast("double")),
    ]


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float
    #: Whether rows of both classes were there; if not, every document is kept.
    fitted: bool = True

    def logit(self, x: Column) -> Column:
        """``x``: an array column of the features, so that they are computed once for a row."""
        return reduce(lambda a, b: a + b, [x[i] * F.lit(float(w)) for i, w in enumerate(self.weights)], F.lit(float(self.bias)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Newton's method on standardised columns with their squares left out; weights are given for raw columns.

    Without rows of both classes the evidence is 0 for every document.
    """
    if len(y) == 0 or y.min() == y.max():
        return Model((0.0,) * x.shape[1], 0.0, fitted=False)
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[-1, -1] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / scale
    return Model(tuple(float(v) for v in raw), float(w[-1] - (raw * mean).sum()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit the classifier on at most ``rows`` labelled documents; null ids and null labels are left out.

    An id counts once: of different texts under one id the one with the smallest features.
    """
    sample = _labels(labels, id_col, label).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    x = F.array(*[f.cast("double") for f in features(text)])
    found = docs.select(F.col(id_col).try_cast("long").alias("label_id"), F.col(text).alias(text)).join(F.broadcast(sample), "label_id")
    got = found.select("label_id", "y", x.alias("x")).groupBy("label_id", "y").agg(F.min("x").alias("x")).orderBy("label_id").toPandas()
    if got.empty:
        return Model((0.0,) * len(features(text)), 0.0, fitted=False)
    return fit_logistic(np.stack(got["x"].map(np.asarray)), (got["y"] >= 0.5).to_numpy().astype(float))


def _labels(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(label_id, y): one label for each id, the mean of its rows."""
    return labels.select(F.col(id_col).try_cast("long").alias("label_id"), F.col(label).cast("double").alias("y")).where("label_id IS NOT NULL AND y IS NOT NULL").groupBy("label_id").agg(F.avg("y").alias("y"))


def _strength(rates: DataFrame, prior: Column) -> float:
    """Strength of a beta prior by moments: what groups' rates vary beyond the sampling of their n documents."""
    r = rates.select("n", (F.col("s") / F.col("n")).alias("rate"), prior.alias("prior")).agg(
        F.sum(F.col("n") * F.pow(F.col("rate") - F.col("prior"), 2)).alias("spread"),
        F.sum(F.col("prior") * (1 - F.col("prior"))).alias("sampling"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("scale"),
    ).first()
    if not r["scale"]:
        return STRENGTH[1]
    share = (r["spread"] - r["sampling"]) / r["scale"]  # intra-group correlation, at most 1
    return float(np.clip(1 / share - 1 if share > 0 else STRENGTH[1], *STRENGTH))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


@dataclass(frozen=True)
class Sites:
    """Counts of sites and what all of them say: (host, path, n, s, host_n, host_s), the global rate, two strengths."""

    counts: DataFrame
    rate: float
    host_strength: float
    path_strength: float

    def rates(self, y: Column | float, weight: float = 1.0) -> tuple[Column, Column]:
        """Posterior rates of host and path of a row joined with ``counts``, without ``weight`` documents of label ``y``."""
        host = (F.col("host_s") - y + self.host_strength * self.rate) / (F.col("host_n") - weight + self.host_strength)
        return host, (F.col("s") - y + self.path_strength * host) / (F.col("n") - weight + self.path_strength)


def site_counts(evidence: DataFrame) -> Sites:
    """Counts and priors from rows (host, path, y), y in 0..1."""
    path = cut(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s")))
    host = path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = path.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = total["s"] / total["n"] if total["n"] else 0.5
    m = _strength(host, F.lit(rate))
    above = cut(host.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")))
    both = cut(path.join(small(above), "host"))
    release(path, above)
    k = _strength(both, (F.col("host_s") + m * rate) / (F.col("host_n") + m))
    return Sites(both, rate, m, k)


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, n, host_rate, path_rate), global rate) of rows (host, path, y), y in 0..1, with all rows in."""
    sites = site_counts(evidence)
    host, path = sites.rates(0.0, 0.0)
    return sites.counts.select("host", "path", "n", host.alias("host_rate"), path.alias("path_rate")), sites.rate


def _site(host: str, path: list[str]) -> list[Column]:
    return [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in path]).alias("path")]


def _judged(rows: DataFrame, model: Model, labels: DataFrame, id_col: str, label: str, keep_from: float) -> DataFrame:
    """``rows`` (doc_id, host, path, x, ...) with evidence, host_rate, path_rate, quality and keep."""
    own = cut(rows.withColumn("evidence", model.logit(F.col("x"))).drop("x"))
    known = _labels(labels, id_col, label)
    # both sides are narrow; an id that is no number, or none, has no label
    own = cut(own.join(known, F.col("doc_id") == F.col("label_id"), "left").drop("label_id").withColumn("y", F.coalesce("y", _probability(F.col("evidence")))))
    sites = site_counts(own.select("host", "path", "y"))
    host, path = sites.rates(F.col("y"))
    out = own.join(small(sites.counts), ["host", "path"]).withColumns({"host_rate": host, "path_rate": path})
    # labels of one class tell sites apart by how many of their rows are labelled, not by their quality
    z = F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.lit(sites.rate)) if model.fitted else F.col("evidence")
    return out.withColumn("quality", _probability(z)).withColumn("keep", F.col("quality") >= keep_from if model.fitted else F.lit(True))


def scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: tuple[str, ...] = ("lang",), label: str = "quality", rows: int = SAMPLE_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, quality (probability), keep: one row per row of ``df``.

    The rates are those of the document's site without the document itself.  Null texts count as empty; a null host or
    path is a site of its own; a null id, or one that isn't a number, has no label.  Labels of one id are averaged.
    Without labelled rows of both classes the evidence is 0, sites add nothing and every document is kept.  Repeated rows
    give repeated rows and count as often in their site.  Other columns aren't read; an empty table gives an empty table.
    """
    model = fit(df, labels, id_col, text, label, rows)
    x = F.array(*[f.cast("double") for f in features(text)])
    own = df.select(F.col(id_col).try_cast("long").alias("doc_id"), *_site(host, list(path)), x.alias("x"))
    out = _judged(own, model, labels, id_col, label, keep_from)
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "path_rate", "quality")), "keep")


def kept(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: tuple[str, ...] = ("lang",), label: str = "quality", rows: int = SAMPLE_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``df`` that ``scores`` keeps, with the columns of ``df``.

    Nulls, repeated rows and empty tables are treated as in ``scores``; repeated rows are kept or dropped together.
    Texts aren't shuffled while the rejected rows' keys (id, site, hash of the text) are few enough to broadcast.
    """
    model = fit(df, labels, id_col, text, label, rows)
    if not model.fitted:
        return df.select(*df.columns)
    th = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    x = F.array(*[f.cast("double") for f in features(text)])
    own = df.select(F.col(id_col).try_cast("long").alias("doc_id"), *_site(host, list(path)), th.alias("th"), x.alias("x"))
    bad = _judged(own, model, labels, id_col, label, keep_from).where("NOT keep").select("doc_id", "host", "path", "th").distinct()
    keys = [F.col(id_col).try_cast("long"), *_site(host, list(path)), th]
    names = unused(df, "bad_id", "bad_host", "bad_path", "bad_th")
    gone = cut(bad.toDF(*names))
    same = [k.eqNullSafe(F.col(n)) if n == names[0] else k == F.col(n) for k, n in zip(keys, names, strict=True)]
    return df.join(small(gone), same, "left_anti").select(*df.columns)
