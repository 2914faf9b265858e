from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.config import DEFAULT, DERIVED_KINDS, KEYLESS_KINDS, resolve_mode
from corpusgraph.operators import claims, relations
from corpusgraph.operators.profile import profiles, selected
from corpusgraph.plans.build import build_graph

PROSE = "The scheduler keeps a queue of kernel tasks and a driver assigns every task to a worker. " * 4
HEADS = "# Installation\n\n## Configuration\n\n## Troubleshooting\n"
SCHEMA = "id string, chapter string, title string, url string, sha string, body string"


def docs(spark, *rows):
    out = []
    for r in rows:
        id_, body = r[0], r[1]
        extra = r[2] if len(r) > 2 else {}
        out.append((id_, "_root", extra.get("title", id_.replace("_", " ")), extra.get("url", ""), extra.get("sha", ""), body))
    return spark.createDataFrame(out, SCHEMA)


def links(spark, *pairs, k="ref"):
    return spark.createDataFrame([(s, t, k) for s, t in pairs], "s string, t string, k string")


def edges(df, kind=None):
    return {(r.s, r.t) for r in df.collect() if kind is None or r.k == kind}


def code(path, symbols, text):
    return f"path: {path}\nlanguage: python\nsymbols: {symbols}\n\n{text}"


def none(spark):
    return spark.createDataFrame([], "s string, t string, k string")


def test_modes():
    assert resolve_mode("off") == resolve_mode("0") == ()
    assert resolve_mode(None) == KEYLESS_KINDS
    assert resolve_mode("all") == DERIVED_KINDS
    assert resolve_mode("similar_to, nonsense") == ("similar_to",)
    with pytest.raises(ValueError):
        DEFAULT.but(nonsense=1)


def test_mixed_documents_select_different_dimensions(spark):
    d = docs(
        spark, ("prose_a", PROSE), ("prose_b", PROSE + " again"), ("stub", "todo"), ("release_v2", "notes"), ("release_v1", "notes"),
        ("auth.py", code("src/auth.py", "login_user", "def login_user(): pass")), ("user.py", code("src/user.py", "show_page", "login_user()")),
    )
    dims = {r.id: set(r.dims) for r in profiles(d).select("id", selected().alias("dims")).collect()}
    assert "similar_to" not in dims["stub"] and "similar_to" in dims["prose_a"]
    assert {"mentions_symbol", "sibling_of"} <= dims["user.py"]
    assert "supersedes" in dims["release_v2"]
    assert len({frozenset(v) for v in dims.values()}) >= 4
    assert edges(relations.mentions_symbol(profiles(d))) == {("user.py", "auth.py")}


def test_prose_length_bounds(spark):
    d = docs(spark, ("a", "x" * 219), ("b", "x" * 220), ("c", ""), ("d", None))
    got = {r.id: (r.prose_len, r.dims) for r in profiles(d).select("id", "prose_len", selected().alias("dims")).collect()}
    assert got["a"] == (219, []) and got["b"] == (220, ["similar_to"]) and got["c"] == got["d"] == (0, [])


def test_versions_chain_numerically(spark):
    names = ["guide_v2", "guide_v10", "guide_v1", "shot_v2.png", "conv1", "plain"]
    got = {r.id: r.version for r in profiles(docs(spark, *[(n, "x") for n in names])).collect()}
    assert got["guide_v10"] == [10] and got["shot_v2.png"] is None and got["conv1"] is None
    assert edges(relations.supersedes(profiles(docs(spark, *[(n, "x") for n in names])))) == {("guide_v10", "guide_v2"), ("guide_v2", "guide_v1")}


def test_versions_with_dots(spark):
    d = docs(spark, ("page_v1.0", "x"), ("page_v2.0", "x"), ("page_v3.1", "x"))
    p = profiles(d)
    assert {tuple(r.version) for r in p.collect()} == {(1, 0), (2, 0), (3, 1)}
    assert p.select("base").distinct().count() == 1


def test_duplicates_chain_sorted_ids(spark):
    d = docs(spark, ("p3", "t", {"sha": "h"}), ("p1", "t", {"sha": "h"}), ("p2", "t", {"sha": "h"}), ("q", "t"))
    assert edges(relations.duplicate_of(d)) == {("p1", "p2"), ("p2", "p3")}


def test_sibling_cohort_bounds(spark):
    for n, want in ((1, 0), (2, 1), (13, 78), (14, 0)):
        d = docs(spark, *[(f"d{i:02}", "x", {"url": f"https://h.example/dir/{i}"}) for i in range(n)])
        assert relations.sibling_of(profiles(d)).count() == want


def test_headings_need_overlap(spark):
    d = docs(spark, ("a", HEADS), ("b", HEADS + "## More\n"), ("c", "# One\n\n## Two\n\n## Three\n"), ("d", "```\n" + HEADS + "```\n"))
    assert edges(relations.shares_heading(profiles(d))) == {("a", "b")}


def test_terms_need_two_in_common(spark):
    d = docs(spark, ("a", "`alpha one` `beta two`"), ("b", "`alpha one` `beta two` `x y`"), ("c", "`alpha one` `gamma`"), ("d", "`delta` `eps`"))
    assert edges(relations.shares_term(profiles(d))) == {("a", "b")}


def test_coupling_and_hubs(spark):
    assert edges(relations.coupled_with(links(spark, ("p1", "t1"), ("p2", "t1"), ("p1", "t2"), ("p2", "t2")))) == {("p1", "p2")}
    assert edges(relations.co_cited_with(links(spark, ("s1", "x"), ("s1", "y"), ("s2", "x"), ("s2", "y")))) == {("x", "y")}
    hub = links(spark, *[(f"p{i:02}", "hub") for i in range(40)])
    assert edges(relations.coupled_with(hub)) == edges(relations.co_cited_with(hub)) == set()
    toc = links(spark, *[(s, f"t{i:02}") for s in ("toc1", "toc2") for i in range(30)])
    assert edges(relations.coupled_with(toc)) == set()


def test_symbols_rank_by_mentions_and_title(spark):
    body = "lib_alpha lib_alpha lib_beta lib_gamma lib_gamma lib_gamma same_name"
    d = docs(
        spark, ("lib_a", code("l/a.py", "lib_alpha, same_name", "x")), ("lib_b", code("l/b.py", "lib_beta, same_name", "x")), ("lib_c", code("l/c.py", "lib_gamma", "x")),
        ("user", code("l/u.py", "own", body), {"title": "about LIB_BETA"}),
    )
    assert edges(relations.mentions_symbol(profiles(d), DEFAULT.but(symbol_cap=2))) == {("user", "lib_b"), ("user", "lib_c")}


def test_nomination_is_by_the_smaller_id(spark):
    vectors = spark.createDataFrame([("e0", [1.0, 0.0]), ("e1", [1.0, 0.05]), ("e2", [1.0, 0.1]), ("e3", [1.0, 0.15]), ("e4", [1.0, 0.2]), ("e5", [1.0, 0.25]), ("e6", [1.0, 0.30]), ("e7", [0.0, 1.0])], "id string, embedding array<double>")
    got = edges(relations.semantic_similar(vectors))
    assert {t for s, t in got if s == "e0"} == {"e1", "e2", "e3", "e4", "e5"}
    assert not any("e7" in p for p in got)


def test_titles_alone_make_no_similarity(spark):
    words = [f"w{i}" for i in range(400)]
    d = docs(spark, *[(f"d{i}", " ".join(words[i * 60 : i * 60 + 60]) * 2, {"title": "reference manual"}) for i in range(5)])
    assert edges(relations.similar_to(profiles(d))) == set()


def test_evidence_is_never_replaced(spark):
    d = docs(spark, ("a", PROSE, {"sha": "h"}), ("b", PROSE, {"sha": "h"}), ("c", PROSE))
    g = build_graph(d, links(spark, ("b", "a")))
    assert not {frozenset(e) for e in edges(g.derived)} & {frozenset("ab")}
    assert g.report.first().verdict == "READY"
    linkless = build_graph(d, none(spark))
    assert ("a", "b") in edges(linkless.derived, "duplicate_of") and not edges(linkless.derived, "similar_to") & {("a", "b")}
    assert linkless.report.first().verdict == "NOT-READY"


def test_claim_order_and_gates(spark):
    cand = spark.createDataFrame([("a", "b", "similar_to"), ("b", "a", "mentions_symbol"), ("a", "c", "similar_to"), ("a", "c", "shares_term"), ("c", "d", "duplicate_of")], "s string, t string, k string")
    gates = spark.createDataFrame([("a", ["similar_to"]), ("b", ["mentions_symbol"]), ("c", ["shares_term"]), ("d", [])], "id string, dims array<string>")
    got = {(r.s, r.t, r.k) for r in claims.claims(cand, none(spark), gates).collect()}
    assert got == {("b", "a", "mentions_symbol"), ("a", "c", "similar_to"), ("c", "d", "duplicate_of")}
    closed = gates.withColumn("dims", F.filter("dims", lambda x: x != "similar_to"))
    got = {(r.s, r.t, r.k) for r in claims.claims(cand, none(spark), closed).collect()}
    assert ("a", "c", "shares_term") in got


def test_stubs_have_no_edges(spark):
    g = build_graph(docs(spark, ("x1", "todo", {"sha": "1"}), ("x2", "tba", {"sha": "2"})), none(spark))
    assert g.edges.count() == 0 and g.report.first().verdict == "NOT-READY"


def test_model_kinds_are_skipped_with_a_note(spark):
    g = build_graph(docs(spark, ("x1", "todo"), ("x2", "tba")), none(spark), "all")
    assert g.notes == ("shares_entity skipped: no entities", "semantic_similar skipped: no vectors")


def test_order_of_rows_does_not_matter(spark):
    rows = [(f"d{i:02}", PROSE + f" `term {i % 3}` `kind {i % 2}` topic{i % 4} word{i % 5}\n\n" + HEADS, {"url": f"https://h.example/{i % 3}/x"}) for i in range(20)]
    one = edges(build_graph(docs(spark, *rows), none(spark)).edges)
    random.Random(3).shuffle(rows)
    assert one == edges(build_graph(docs(spark, *rows).repartition(7), none(spark)).edges) and one


def test_shared_entities(spark):
    e = spark.createDataFrame([(d, x) for d, x in (("a", "Foo-Bar"), ("a", "Baz"), ("b", "foo bar"), ("b", "BAZ"), ("c", "Baz"), ("d", ""), *[(f"z{i}", f"q{i}") for i in range(20)])], "id string, entity string")
    assert edges(relations.shares_entity(e)) == {("a", "b")}
