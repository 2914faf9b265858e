"""Document fingerprints: invertible Bloom lookup sketches, in SQL functions only.

A text's paragraphs (its non-empty lines) become 60-bit keys: the head of the MD5 of the paragraph, moved on by a fixed
step for each repeat of it, so that the keys of a text are a set.  Each key goes into one cell of each of three
subtables, chosen by 20 bits of the key; a cell holds the number of its keys, their XOR and the XOR of their checks (a
remainder, which XOR doesn't preserve).  The sketches of two versions are subtracted cell by cell, and *peeling*
takes out cells of a single key until all are empty: what came out are the differing paragraphs, and

    likeness = shared / (all) = Jaccard similarity of the two sets of keys, 1 for two empty sets.

Where peeling gets stuck, only those rows go on to tables four times as large, until none is left.  Everything is local
to a row; the step between documents (a document's edited text takes from the next document) needs one shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm._common import cut, small

#: Cells of each of the three subtables of a fingerprint.
CELLS = 8
#: Fixed values of keys, repeats and checks.
KEY_BITS, REPEAT, CHECK = 60, 982451653, 2147483647
#: Rounds of peeling in one attempt at most; a round without a lone key ends it.
ROUNDS = 40
#: Cells of a subtable at most, as a key has 20 bits for each, and tries with twice the cells before keys are compared.
MOST, TRIES = 1 << 20, 5
#: Paragraphs of a text, and so repeats of one, at most: a text has fewer than 2**31 characters.
_LONGEST = 1 << 30
#: Ranges of ids at most, and documents wanted in each part of a range, when documents are put in order.
RANGES, PART_ROWS = 256, 1000


def keys_sql(text: str) -> str:
    """Sorted paragraph keys, made a set: a key's r-th repeat is moved on by r steps.

    The number of equal ones before a place of the sorted array is found by halving steps, not by a search for each key.
    """
    digests = f"array_sort(transform(filter(split({text}, '\\n', -1), p -> p != ''), p -> CAST(conv(substring(md5(p), 1, 15), 16, 10) AS BIGINT)))"
    further = f"r + shiftright({_LONGEST}, CAST(b AS INT))"
    before = f"aggregate(sequence(0, {_LONGEST.bit_length() - 1}), 0, (r, b) -> if(i >= {further} AND get(s, i - ({further})) = x, {further}, r))"
    return f"element_at(transform(array({digests}), s -> transform(s, (x, i) -> if(i > 0 AND get(s, i - 1) = x, pmod(x + CAST({before} AS BIGINT) * {REPEAT}, {1 << KEY_BITS}), x))), 1)"


def sketch_sql(keys: str, cells: str | int, parts: str | int = 1) -> str:
    """Array of 3 * cells structs (n, k, h); ``cells`` and ``parts`` are powers of 2.

    The keys of a subtable are dealt to ``parts`` parts first, so that a cell looks through those of its part only: with
    about sqrt(cells) parts a sketch of m cells costs m + 2 n sqrt(m) steps for n keys.
    """
    filled = f"named_struct('n', CAST(size(f) AS BIGINT), 'k', aggregate(f, 0L, (acc, x) -> acc ^ x), 'h', aggregate(f, 0L, (acc, x) -> acc ^ (x % {CHECK}L)))"
    cell = f"element_at(transform(array(found), f -> if(size(f) = 0, named_struct('n', 0L, 'k', 0L, 'h', 0L), {filled})), 1)"
    tables = []
    for j in range(3):
        place = f"shiftright(x, {20 * j})" if j else "x"
        own = f"{place} & {{0}} = i"
        if parts == 1:
            found = f"filter({keys}, x -> {own.format(f'({cells} - 1)')})"
            tables.append(f"transform(sequence(0, {cells} - 1), i -> {cell.replace('found', found)})")
        else:
            dealt = f"transform(sequence(0, {parts} - 1), i -> filter({keys}, x -> {own.format(f'({parts} - 1)')}))"
            found = f"filter(get(dealt, i & ({parts} - 1)), x -> {own.format(f'({cells} - 1)')})"
            tables.append(f"flatten(transform(array({dealt}), dealt -> transform(sequence(0, {cells} - 1), i -> {cell.replace('found', found)})))")
    return f"concat({', '.join(tables)})"


def show_sql(sketch: str) -> str:
    """Cells as hexadecimal n.k.h, an empty cell as nothing, joined by commas."""
    return f"array_join(transform({sketch}, c -> if(c.n = 0, '', concat(lower(hex(c.n)), '.', lower(hex(c.k)), '.', lower(hex(c.h))))), ',')"


def peel_sql(a: str, b: str, cells: str | int, parts: str | int = 1, rounds: int = ROUNDS) -> str:
    """Struct (removed, added) of the keys that only sketch ``a`` or only ``b`` holds; null if peeling gets stuck.

    A round takes the keys of all cells with a single key out of the sketch at once, by subtracting their own sketch.
    """
    less = "(x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h)"
    # a lone key must pass its check and belong to the cell it was found in
    mine = f"shiftright(c.k, CAST(20 * (i div {cells}) AS INT)) & ({cells} - 1) = i % {cells}"
    alone = f"filter(st.cells, (c, i) -> (c.n = 1 OR c.n = -1) AND c.h = c.k % {CHECK}L AND {mine})"
    minus = f"zip_with(zip_with(st.cells, {sketch_sql('gone', cells, parts)}, {less}), {sketch_sql('come', cells, parts)}, (x, y) -> named_struct('n', x.n + y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    next_ = f"named_struct('cells', {minus}, 'removed', concat(st.removed, gone), 'added', concat(st.added, come), 'live', true)"
    split = "element_at(transform(array(array_distinct(transform(filter(pure, c -> c.n = {0}), c -> c.k))), {1} -> {2}), 1)"
    step = f"if(st.live, element_at(transform(array({alone}), pure -> if(size(pure) = 0, named_struct('cells', st.cells, 'removed', st.removed, 'added', st.added, 'live', false), {split.format(1, 'gone', split.format(-1, 'come', next_))})), 1), st)"
    none = "CAST(array() AS ARRAY<BIGINT>)"
    peeled = f"aggregate(sequence(1, {rounds}), named_struct('cells', zip_with({a}, {b}, {less}), 'removed', {none}, 'added', {none}, 'live', true), (st, r) -> {step})"
    left = "exists(z.cells, c -> c.n != 0 OR c.k != 0 OR c.h != 0)"
    return f"element_at(transform(array({peeled}), z -> if({left}, CAST(NULL AS STRUCT<removed: ARRAY<BIGINT>, added: ARRAY<BIGINT>>), named_struct('removed', array_sort(z.removed), 'added', array_sort(z.added)))), 1)"


def likeness_sql(d: str, a: str, b: str) -> str:
    """Jaccard similarity of two key sets of sizes ``a`` and ``b`` from their differences ``d``; null without them."""
    shared = f"(({a} + {b} - size({d}.removed) - size({d}.added)) / 2)"
    return f"if({d} IS NULL, CAST(NULL AS DOUBLE), if({a} + {b} = 0, 1D, {shared} / ({a} + {b} - {shared})))"


def differences(rows: DataFrame, pairs: dict[str, tuple[str, str]], result: dict[str, str], cells: int = CELLS) -> DataFrame:
    """``result``, name: SQL over ``rows`` and a column (removed, added) for each of ``pairs``, name: (old, new) key arrays.

    The first sketches have ``cells`` cells in a subtable, those of rows that got stuck enough for all keys of both sides,
    twice as many at each further try.  What is stuck after TRIES of them (two keys of one text that are equal in 60 bits
    cancel for ever; a key has bits for MOST cells only) is compared key by key.  Each try reads what got stuck only, and
    writes nothing but the result of the others.
    """
    kind = "struct<removed: array<bigint>, added: array<bigint>>"
    done = " AND ".join(f"{n} IS NOT NULL" for n in pairs)
    carried = [c for c in rows.columns if c not in pairs]

    def told(tried: DataFrame) -> DataFrame:
        return cut(
            tried.select(
                F.expr(done).alias("__done"), *[F.expr(f"CASE WHEN {done} THEN {e} END").alias(f"__r_{n}") for n, e in result.items()],
                *[F.expr(f"CASE WHEN NOT ({done}) THEN `{c}` END").alias(c) for c in (*carried, *pairs)],
            )
        )

    a_few = {n: f"if(abs(size({a}) - size({b})) > {3 * cells}, CAST(NULL AS {kind}), {peel_sql(sketch_sql(a, cells), sketch_sql(b, cells), cells)})" for n, (a, b) in pairs.items()}
    tried = told(rows.withColumns({n: F.expr(e) for n, e in a_few.items()}))
    out, k = [], 0
    while True:
        out.append(tried.where("__done"))
        rows = tried.where("NOT __done").select(*carried, *pairs)
        if rows.isEmpty():
            break
        for n, (a, b) in pairs.items():
            # at least 1.5 cells for each key, all subtables together, more than before, and about as many parts as the root
            bits = f"CAST(least({MOST.bit_length() - 1}, greatest({cells.bit_length()}, ceil(log2((size({a}) + size({b})) / 2D))) + {k}) AS INT)"
            rows = rows.withColumns({f"__m_{n}": F.expr(f"shiftleft(1, {bits})"), f"__p_{n}": F.expr(f"shiftleft(1, CAST(({bits}) div 2 AS INT))")})
        exact = {n: f"named_struct('removed', array_sort(array_except({a}, {b})), 'added', array_sort(array_except({b}, {a})))" for n, (a, b) in pairs.items()}
        sized = {n: peel_sql(sketch_sql(a, f"__m_{n}", f"__p_{n}"), sketch_sql(b, f"__m_{n}", f"__p_{n}"), f"__m_{n}", f"__p_{n}") for n, (a, b) in pairs.items()}
        tried = told(rows.withColumns({n: F.coalesce(n, F.expr(exact[n] if k == TRIES else sized[n])) for n in pairs}))
        k += 1
    all_ = out[0]
    for d in out[1:]:
        all_ = all_.unionByName(d)
    return all_.select(*[F.col(f"__r_{n}").alias(n) for n in result])


def compare(df: DataFrame, old: str = "old", new: str = "new", cells: int = CELLS) -> DataFrame:
    """``df`` with what two versions of a text have not in common: ``removed`` and ``added``, arrays of paragraph keys.

    ``likeness`` is the Jaccard similarity of both key sets.  Null texts count as empty, two empty texts have likeness 1;
    repeated rows get equal rows; a table without rows gives none.  Other columns stay.
    """
    texts = {"__old": old, "__new": new}
    rows = df.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in texts.items()})
    rows = rows.withColumns({k: F.expr(keys_sql(k)) for k in texts})
    own = {c: f"`{c}`" for c in df.columns}
    found = {"removed": "__d.removed", "added": "__d.added", "likeness": likeness_sql("__d", "size(__old)", "size(__new)")}
    return differences(rows, {"__d": ("__old", "__new")}, own | found, cells)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): rows of (doc_id, text) with the text of the next document, in descending order of ids.

    After the last comes the first.  Null ids are last; ties are ordered by a hash of the text.  Ids are cut into ranges
    at quantiles and ranges into parts of about PART_ROWS rows.  A part is sorted in one task; the first row of a part
    is copied to the part before it, so that one shuffle of the texts is enough.
    """
    n = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    ranges = int(min(RANGES, max(1, (n["n"] or 0) // PART_ROWS)))
    cuts: list[int] = []
    if ranges > 1 and n["lo"] is not None:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("c")).first()["c"]))
    low = [n["lo"] or 0, *cuts]
    high = [*cuts, (n["hi"] or 0) + 1]
    parts = max(1, (n["n"] or 0) // max(1, len(low)) // PART_ROWS)
    width = [max(1, -(-(b - a) // parts)) for a, b in zip(low, high, strict=True)]

    def literal(values: list[int]):
        return F.array(*[F.lit(int(v)).cast("long") for v in values])

    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(literal(low), lambda c: c <= F.col("doc_id"))))
    # rows without an id are ordered by the hash of their text, so ranges of it are their parts
    part = F.when(F.col("doc_id").isNull(), F.floor(F.col("th") / F.lit(2**63 // max(1, (n["n"] or 0) // (2 * PART_ROWS)) - 1)).cast("long")).otherwise(
        F.floor((F.col("doc_id") - F.element_at(literal(low), F.greatest("range", F.lit(1)))) / F.element_at(literal(width), F.greatest("range", F.lit(1))))
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").withColumn("range", place).withColumn("part", part)

    first = cut(rows.groupBy("range", "part").agg(F.max(F.struct("doc_id", "th")).alias("head")))
    top = {r["range"]: r["head"] for r in first.groupBy("range").agg(F.max_by("head", "part").alias("head")).collect()}  # RANGES + 1 rows at most
    order = sorted(top, reverse=True)
    after = {r: top[order[(i + 1) % len(order)]] for i, r in enumerate(order)}
    spark = docs.sparkSession
    behind = spark.createDataFrame([(r, (h["doc_id"], h["th"])) for r, h in after.items()], "range int, other struct<doc_id:long,th:long>")
    w = Window.partitionBy("range").orderBy(F.col("part").desc())
    feed = (
        first.withColumn("own", F.lead("head").over(w)).join(F.broadcast(behind), "range")
        .select("range", "part", F.coalesce("own", "other").alias("h"))
        .select("range", "part", F.col("h.doc_id").alias("f_id"), F.col("h.th").alias("f_th"))
    )
    feed = cut(feed)
    guests = rows.drop("range", "part").join(small(feed), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")))
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests.select("doc_id", "th", "text", "range", "part").withColumn("guest", F.lit(1)))
    line = Window.partitionBy("range", "part").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    return both.withColumn("next", F.lead("text").over(line)).where("guest = 0").select("doc_id", "text", "next")


def edited_sql(text: str, other: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of the other text."""
    half = f"(char_length({text}) div 2)"
    return f"concat(substring({text}, 1, CAST(char_length({text}) - {half} AS INT)), substring({other}, 1, CAST({half} AS INT)))"


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row, and how many
    paragraphs the edited text has lost and gained (n_removed, n_added).

    Null texts count as empty, and an empty text has the fingerprint of no keys; the likeness of two empty ones is 1.
    Null ids, and ids that aren't numbers, come last in the order and are null; repeated rows are documents of their own.  Other columns aren't read; an empty
    table gives an empty table; a single document is its own next.
    """
    docs = df.select(F.col(id_col).try_cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    told = with_next(docs).withColumn("edited", F.expr(edited_sql("text", "next")))
    rows = told.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(keys_sql("text")).alias("ka"), F.expr(keys_sql("edited")).alias("ke"), F.expr(keys_sql("next")).alias("kn"),
    )
    rows = rows.withColumns({"fingerprint": F.expr(show_sql(sketch_sql("ka", cells))), "edited_fingerprint": F.expr(show_sql(sketch_sql("ke", cells)))})
    near = {n: f"round({likeness_sql(d, 'size(ka)', f'size({k})')}, 6)" for n, d, k in (("near_edited", "e", "ke"), ("near_next", "x", "kn"))}
    size = {n: f"CAST(size(e.{k}) AS BIGINT)" for n, k in (("n_removed", "removed"), ("n_added", "added"))}
    own = {c: c for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")}
    return differences(rows, {"e": ("ka", "ke"), "x": ("ka", "kn")}, own | near | size, cells)


#: DuckDB SQL for the rows of ``compare_with_next``; the likeness is computed from the key sets themselves.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
e AS (SELECT doc_id, text, nxt, substring(text, 1, length(text) - length(text) // 2) || substring(nxt, 1, length(text) // 2) AS edited FROM n),
p AS (
  SELECT doc_id, 'a' AS v, unnest(string_split(text, chr(10))) AS p FROM e
  UNION ALL SELECT doc_id, 'e', unnest(string_split(edited, chr(10))) FROM e
  UNION ALL SELECT doc_id, 'n', unnest(string_split(nxt, chr(10))) FROM e),
g AS (SELECT doc_id, v, ('0x' || substr(md5(p), 1, 15))::BIGINT AS g FROM p WHERE p <> ''),
k AS (SELECT doc_id, v, ((g::HUGEINT + (row_number() OVER (PARTITION BY doc_id, v, g) - 1)::HUGEINT * {REPEAT}) % {1 << KEY_BITS})::BIGINT AS k FROM g),
c AS (
  SELECT doc_id, v, j * {CELLS} + (k >> (20 * j)) % {CELLS} AS i, count(*) AS n, bit_xor(k) AS x, bit_xor(k % {CHECK}) AS h
  FROM k, (SELECT unnest([0, 1, 2]) AS j) GROUP BY ALL),
f AS (
  SELECT doc_id, v, string_agg(CASE WHEN n IS NULL THEN '' ELSE lower(to_hex(n)) || '.' || lower(to_hex(x)) || '.' || lower(to_hex(h)) END, ',' ORDER BY i) AS f
  FROM (SELECT * FROM (SELECT doc_id FROM d), (SELECT unnest(['a', 'e']) AS v), (SELECT unnest(range({3 * CELLS})) AS i)) LEFT JOIN c USING (doc_id, v, i) GROUP BY ALL),
s AS (SELECT doc_id, count(*) FILTER (v = 'a') AS na, count(*) FILTER (v = 'e') AS ne, count(*) FILTER (v = 'n') AS nn FROM k GROUP BY doc_id),
b AS (SELECT a.doc_id, count(*) FILTER (o.v = 'e') AS be, count(*) FILTER (o.v = 'n') AS bn FROM k a JOIN k o ON a.doc_id = o.doc_id AND a.k = o.k AND a.v = 'a' AND o.v <> 'a' GROUP BY a.doc_id),
z AS (SELECT e.doc_id, coalesce(na, 0) AS na, coalesce(ne, 0) AS ne, coalesce(nn, 0) AS nn, coalesce(be, 0) AS be, coalesce(bn, 0) AS bn FROM e LEFT JOIN s USING (doc_id) LEFT JOIN b USING (doc_id))
SELECT e.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fa.f AS fingerprint, fe.f AS edited_fingerprint,
  round(CASE WHEN na + ne = 0 THEN 1.0::DOUBLE ELSE be::DOUBLE / (na + ne - be) END, 6) AS near_edited,
  round(CASE WHEN na + nn = 0 THEN 1.0::DOUBLE ELSE bn::DOUBLE / (na + nn - bn) END, 6) AS near_next, na - be AS n_removed, ne - be AS n_added
FROM e JOIN z USING (doc_id) JOIN f fa ON fa.doc_id = e.doc_id AND fa.v = 'a' JOIN f fe ON fe.doc_id = e.doc_id AND fe.v = 'e'
"""
