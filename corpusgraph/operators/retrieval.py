"""Retrieval for answers: candidates from words, vectors and the graph, ranked, with excerpts.  Models are pluggable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.functions import text as T


def nearest(vectors: DataFrame, query: list[float], n: int = 8) -> DataFrame:
    """(id, score) of the vectors (id, embedding) closest to the query; ties by id."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select("id", F.round(T.cosine(F.col("embedding"), q), 9).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def candidate_union(by_words: DataFrame, by_vectors: DataFrame, by_graph: DataFrame, cap: int = 12) -> DataFrame:
    """(id, ord): words first, then vectors, at most ``cap`` of them, then the graph's, each id once.

    Inputs: (id, ord) with ord from 1, a few rows each.
    """
    each = by_words.select("id", F.col("ord").alias("o")).union(by_vectors.select("id", F.col("ord") + 1000))
    first = each.groupBy("id").agg(F.min("o").alias("o"))
    kept = first.orderBy("o").limit(cap)
    whole = kept.union(by_graph.select("id", F.col("ord") + 1_000_000)).groupBy("id").agg(F.min("o").alias("o"))
    return whole.select("id", F.row_number().over(Window.orderBy("o")).alias("ord"))


def blocks(docs: DataFrame, size: int = 600) -> DataFrame:
    """(id, pos, block) of the bodies' blocks; an empty body has one empty block."""
    n = F.greatest(F.ceil(F.length("body") / size).cast("int"), F.lit(1))
    return docs.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("body", i * size + 1, F.lit(size)))).alias("pos", "block"))


def best_excerpt(scored: DataFrame, budget: int = 1800, most: int = 6) -> DataFrame:
    """(id, excerpt) of scored blocks (id, pos, block, score): the best of them, at most ``most`` and until ``budget``
    characters are reached, joined in page order, at most twice the budget long."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    ranked = scored.withColumns({"rn": F.row_number().over(w), "before": F.coalesce(F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    kept = ranked.where((F.col("rn") <= most) & (F.col("before") < budget))
    return kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("b")).select("id", F.substring(F.array_join("b.block", "\n…\n"), 1, 2 * budget).alias("excerpt"))


@dataclass(frozen=True)
class Models:
    """What a caller can plug in; each may be left out.

    ``embed`` gives a vector for each text, ``rerank`` the places of the best texts for a question, ``chat`` the answer to
    (instructions, question with context).
    """

    embed: Callable[[list[str]], list[list[float]]] | None = None
    rerank: Callable[[str, list[str], int], list[int]] | None = None
    chat: Callable[[str, str], str] | None = None


# How many pages each way of finding nominates, and how much of a page is looked at.
BY_WORDS, BY_VECTORS, BY_GRAPH, AROUND, UNION, HEAD, RANKED_HEAD, EXCERPT = 8, 8, 6, 3, 12, 600, 3000, 1800
RERANK_CHARS = 1200
INSTRUCTIONS = "Answer from the numbered pages below and from nothing else; put the number of the page, as [n], behind each claim. Say so if they don't suffice. Answer in the language of the question."


def _unit(v: list[float]) -> float:
    return sum(x * x for x in v) ** 0.5


def _closest(query: list[float], vectors: list[list[float]]) -> list[int]:
    """Places of a few vectors by falling cosine; ties in order."""
    q = _unit(query)
    score = [sum(a * b for a, b in zip(query, v, strict=True)) / (q * _unit(v) + 1e-12) for v in vectors]
    return sorted(range(len(vectors)), key=lambda i: -score[i])


def embedded(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(id, embedding) of docs (id, title, body): title and the body's head, embedded by the workers batch by batch."""
    import pandas as pd

    def run(frames):
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": embed(part["t"].tolist())})

    text = F.concat("title", F.lit("\n"), F.substring("body", 1, HEAD))
    return docs.select("id", text.alias("t")).mapInPandas(run, "id string, embedding array<double>")


def around(edges: DataFrame, centres: list[str], n: int) -> list[str]:
    """The first ``n`` pages next to the centres, one centre after another, each centre's in id order, the centre first."""
    if not centres:
        return []
    at = edges.sparkSession.createDataFrame(list(enumerate(centres)), "at int, c string")
    both = edges.join(F.broadcast(at), F.col("s") == F.col("c")).select("at", F.col("t").alias("id"), F.lit(1).alias("far"))
    both = both.union(edges.join(F.broadcast(at), F.col("t") == F.col("c")).select("at", F.col("s").alias("id"), F.lit(1).alias("far"))).union(at.select("at", "c", F.lit(0)))
    first = both.groupBy("id").agg(F.min(F.struct("at", "far")).alias("o")).orderBy("o", "id").limit(n)
    return [r.id for r in first.collect()]


def ask(docs: DataFrame, find: Callable[[int], list[str]], edges: DataFrame, question: str, models: Models | None = None, top_k: int = 4) -> dict:
    """The pages that answer a question, with excerpts, and the answer if there is a model to write it.

    docs: (id, title, url, body); ``find(n)`` gives the ids of the best n pages by words.  Candidates are the best by words
    and, with an embedding model, by vectors, at most UNION of them, and the pages around the best few by words.  With
    both an embedding and a reranking model they are ranked by them, else the candidates' order stays.  An excerpt is the
    head of a page, or with an embedding model its blocks closest to the question.  Without a chat model, or when a model
    fails, ``notes`` says so and the pages are given all the same.
    """
    models, notes = models or Models(), []
    words = find(BY_WORDS)
    near = around(edges, words[:AROUND], BY_GRAPH)
    query: list[float] | None = None
    by_vector: list[str] = []
    if models.embed:
        try:
            query = models.embed([question])[0]
            by_vector = [r.id for r in nearest(embedded(docs, models.embed), query, BY_VECTORS).collect()]
        except Exception as e:  # noqa: BLE001  whatever a caller's model raises: words and links are left
            notes.append(f"no vectors: {type(e).__name__}: {e}")
            query = None
    found = list(dict.fromkeys([*list(dict.fromkeys([*words, *by_vector]))[:UNION], *near]))
    if not found:
        return {"ok": False, "error": "no page found", "notes": notes}
    page = {r.id: r for r in docs.where(F.col("id").isin(found)).collect()}
    found = [i for i in found if i in page]
    chosen = found[:top_k]
    if query is not None and models.rerank:
        try:
            ranked = [found[i] for i in _closest(query, models.embed([page[i].body[:RANKED_HEAD] for i in found]))]
            chosen = [ranked[i] for i in models.rerank(question, [page[i].body[:RERANK_CHARS] for i in ranked], min(top_k, len(ranked)))]
        except Exception as e:  # noqa: BLE001
            notes.append(f"not reranked: {type(e).__name__}: {e}")
    excerpt = {i: page[i].body[:EXCERPT] for i in chosen}
    if query is not None:
        for i in chosen:
            parts = [page[i].body[k : k + HEAD] for k in range(0, len(page[i].body), HEAD)] or [""]
            try:
                picked, size = [], 0
                for k in _closest(query, models.embed(parts))[:6]:
                    if size >= EXCERPT:
                        break
                    picked.append(k)
                    size += len(parts[k])
                excerpt[i] = "\n…\n".join(parts[k] for k in sorted(picked))[: 2 * EXCERPT]
            except Exception as e:  # noqa: BLE001
                notes.append(f"head of {i}: {type(e).__name__}: {e}")
    cited = [{"n": k, "id": i, "title": page[i].title, "url": page[i].url, "excerpt": excerpt[i]} for k, i in enumerate(chosen, 1)]
    out = {"ok": True, "citations": cited, "notes": notes}
    if models.chat:
        context = "\n\n".join(f"[{c['n']}] {c['title']} ({c['url']})\n{c['excerpt']}" for c in cited)
        try:
            out["answer"] = models.chat(INSTRUCTIONS, f"Question: {question}\n\n{context}")
        except Exception as e:  # noqa: BLE001
            notes.append(f"no answer: {type(e).__name__}: {e}")
    else:
        notes.append("no answer: no model to write it")
    return out
