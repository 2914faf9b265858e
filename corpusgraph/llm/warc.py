"""WARC records and a Merkle fixity audit of archive replicas.

A page becomes a WARC/1.0 resource record (bytes).  Records of an archive are laid out in order, which gives each its
byte range [offset, offset + length).  Leaves of an archive's tree are the SHA-256 of (offset, length, record); an inner
node is the SHA-256 of its children's hashes and the range they span.  Two replicas are compared from the roots
down: only children of nodes that differ are joined on the next level, so that an intact archive costs one comparison
and a damaged record one path.  What differs on the lowest level is reported with its range in both replicas.

Offsets are prefix sums in two levels (blocks of records, then blocks of an archive), so that no task ever holds a whole
archive; trees are built by grouped aggregations of at most FANOUT children.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm._common import cut, small

#: Children of a node, consecutive sequence numbers of a block of records, and records of one number that stay together.
FANOUT, BLOCK, HOT = 16, 256, 4096


def record(url: str = "url", payload: str = "html", record_id: str = "page_id") -> Column:
    """Bytes of a resource record; nulls are empty."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    name = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (record_id, url)])
    h = F.sha2(name, 256)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\r\n]", ""),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def parse_record(data: str) -> Column:
    """Struct (url, digest, length, payload, intact) of a record's bytes; null where it isn't a record.

    ``intact`` compares the payload with the digest and the length that the record itself states.
    """
    raw = F.col(data)
    text = F.decode(raw, "ISO-8859-1")  # one character for each byte, so that positions agree
    end = F.instr(text, "\r\n\r\n")
    head = F.decode(F.substring(raw, 1, end - 1), "UTF-8")
    get = lambda name: F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    n = get("Content-Length").try_cast("int")
    body = F.substring(raw, end + 4, n)
    digest = F.regexp_replace(get("WARC-Block-Digest"), "^sha256:", "")
    return F.when(
        text.startswith("WARC/") & (end > 0) & n.isNotNull(),
        F.struct(get("WARC-Target-URI").alias("url"), digest.alias("digest"), n.alias("length"), F.decode(body, "UTF-8").alias("payload"), ((F.octet_length(body) == n) & (F.sha2(body, 256) == digest)).alias("intact")),
    )


def leaves(records: DataFrame) -> DataFrame:
    """(archive, leaf, key, offset, length, digest, hash) of records (archive string, seq long, key string, length long, digest string).

    Order: seq, then a hash of key and digest, then key and digest.  ``leaf`` numbers the records of an archive from 0.
    Records of one seq beyond HOT are cut into ranges of that hash, each a part of its own, and the block around them
    into its seqs, so that no task gets all records of a seq.
    """
    rows = records.withColumn("seq", F.coalesce("seq", F.lit(-1))).withColumns({"block": F.floor(F.col("seq") / BLOCK), "h": F.xxhash64("key", "digest")})
    often = rows.groupBy("archive", "block", "seq").agg(F.count("*").alias("times")).where(F.col("times") > HOT)
    hot = cut(often.select("archive", "block", "seq", F.ceil(F.col("times") * 2 / HOT).alias("ranges")))
    cracked = hot.select("archive", "block").distinct().withColumn("cracked", F.lit(True))
    rows = rows.join(small(hot.drop("block")), ["archive", "seq"], "left").join(small(cracked), ["archive", "block"], "left")
    rows = rows.withColumns({"of": F.when(F.col("cracked"), F.col("seq")).otherwise(F.lit(-1)), "part": F.coalesce(F.floor((F.col("h") / 2.0**64 + 0.5) * F.col("ranges")), F.lit(0))}).drop("cracked", "ranges")
    place = ["block", "of", "part"]
    block = rows.groupBy("archive", *place).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    # blocks of blocks, so that the running sums of a huge archive aren't one task's either
    block = block.withColumn("group", F.floor(F.col("block") / BLOCK))
    group = block.groupBy("archive", "group").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("archive").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    group = group.select("archive", "group", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"g_{c}") for c in ("n", "bytes")])
    inside = Window.partitionBy("archive", "group").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    block = block.select("archive", "group", *place, *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"b_{c}") for c in ("n", "bytes")])
    base = block.join(group, ["archive", "group"]).select("archive", *place, (F.col("b_n") + F.col("g_n")).alias("n0"), (F.col("b_bytes") + F.col("g_bytes")).alias("bytes0"))
    line = Window.partitionBy("archive", *place).orderBy("seq", "h", "key", "digest")
    placed = rows.withColumns({"i": F.row_number().over(line) - 1, "done": F.coalesce(F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    placed = placed.join(base, ["archive", *place]).select("archive", (F.col("n0") + F.col("i")).alias("leaf"), "key", (F.col("bytes0") + F.col("done")).alias("offset"), "length", "digest")
    return placed.withColumn("hash", F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels (archive, node, hash, begin, end), leaves first, up to one node for each archive."""
    level = cut(leaf.select("archive", F.col("leaf").alias("node"), "hash", F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end")))
    levels = [level]
    most = level.agg(F.max("node").alias("m")).first()["m"]
    while most is not None and most > 0:
        up = level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "hash", "begin", "end"))).alias("c"))
        span = F.concat_ws(":", F.array_min("c.begin"), F.array_max("c.end"), F.array_join("c.hash", ","))
        level = cut(up.select("archive", "node", F.sha2(span, 256).alias("hash"), F.array_min("c.begin").alias("begin"), F.array_max("c.end").alias("end")))
        levels.append(level)
        most //= FANOUT
    return levels


def audit(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare two replicas, given by their ``leaves``.

    Returns the damage, (archive, leaf, key, status, offset, length, other_offset, other_length), and (level, compared),
    how many nodes were compared.  Status: ``differs`` (other bytes under the same key), ``missing`` (not in the second),
    ``extra`` (only there) or ``moved`` (the same bytes in another place, as after a record that was put in, left out or
    grew).  ``findings`` makes one row of all records that one shift has moved.  Equal replicas have no damage.
    """
    first, second = tree(one), tree(two)
    depth = max(len(first), len(second))
    for t in (first, second):  # a lone node stands for itself on higher levels
        while len(t) < depth:
            t.append(t[-1])
    wrong, counts = None, []
    for k in range(depth - 1, -1, -1):
        a, b = first[k].alias("a"), second[k].alias("b")
        if wrong is not None:
            bad = wrong.select(F.col("archive").alias("w"), F.col("node").alias("p"))
            pick = lambda t, n: t.join(bad, (F.col(f"{n}.archive") == F.col("w")) & (F.floor(F.col(f"{n}.node") / FANOUT) == F.col("p")), "left_semi")
            a, b = pick(a, "a").alias("a"), pick(b, "b").alias("b")
        both = a.join(b, (F.col("a.archive") == F.col("b.archive")) & (F.col("a.node") == F.col("b.node")), "full_outer").select(
            F.coalesce("a.archive", "b.archive").alias("archive"), F.coalesce("a.node", "b.node").alias("node"), F.col("a.hash").alias("ha"), F.col("b.hash").alias("hb")
        )
        both = cut(both)
        counts.append(both.agg(F.lit(k).alias("level"), F.count("*").alias("compared")))
        wrong = both.where(~F.col("ha").eqNullSafe(F.col("hb")))
    bad = wrong.select("archive", F.col("node").alias("leaf"))
    total = counts[0]
    for c in counts[1:]:
        total = total.union(c)
    return _explained(*(x.join(bad, ["archive", "leaf"], "left_semi") for x in (one, two))), total


def _explained(one: DataFrame, two: DataFrame) -> DataFrame:
    """Damage from the leaves that differ on both sides: equal records are moved, then those of equal keys differ."""

    def numbered(x: DataFrame, *by: str) -> DataFrame:
        return x.withColumn("nth", F.row_number().over(Window.partitionBy("archive", *by).orderBy("leaf")))

    same = ["archive", "key", "length", "digest"]
    a, b = (cut(numbered(x.select(*same, "leaf", "offset"), *same[1:])) for x in (one, two))
    other = [F.col("leaf").alias("other_leaf"), F.col("offset").alias("other_offset")]
    moved = a.join(b.select(*same, "nth", *other), [*same, "nth"]).select("archive", "leaf", "key", F.lit("moved").alias("status"), "offset", "length", "other_offset", F.col("length").alias("other_length"))
    a, b = (numbered(x.join(y, [*same, "nth"], "left_anti"), "key") for x, y in ((a, b), (b, a)))
    right = b.select("archive", "key", "nth", F.col("length").alias("other_length"), *other)
    pairs = a.select("archive", "key", "nth", "leaf", "offset", "length").join(right, ["archive", "key", "nth"], "full_outer")
    status = F.when(F.col("other_leaf").isNull(), "missing").when(F.col("leaf").isNull(), "extra").otherwise("differs")
    rest = pairs.select("archive", F.coalesce("leaf", "other_leaf").alias("leaf"), "key", status.alias("status"), "offset", "length", "other_offset", "other_length")
    return moved.unionByName(rest)


def findings(damage: DataFrame) -> DataFrame:
    """(archive, status, shift, first_leaf, last_leaf, n): one row per damaged record, and one for all that a shift of so
    many bytes has moved in an archive."""
    shift = F.col("other_offset") - F.col("offset")
    alone = F.when(F.col("status") != "moved", F.col("leaf"))
    return damage.withColumns({"shift": F.when(F.col("status") == "moved", shift), "alone": alone}).groupBy("archive", "status", "shift", "alone").agg(
        F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf"), F.count("*").alias("n")).drop("alone")


def page_records(pages: DataFrame, data: Column, archive_pages: int = 2048) -> DataFrame:
    """Record rows (archive, seq, key, length, digest) of a pages table with record bytes ``data``.

    Archives hold ``archive_pages`` consecutive page ids.  Pages without id, or with one that isn't a number, go to an
    archive of their own, in the order of a hash; nulls in other columns are empty.  Repeated rows are records each.
    """
    seq = F.col("page_id").try_cast("long")
    return pages.select(
        F.coalesce(F.format_string("pages-%06d", F.floor(seq / archive_pages)), F.lit("pages-none")).alias("archive"), F.coalesce(seq, F.lit(-1)).alias("seq"),
        F.concat_ws(" ", seq.cast("string"), F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("key"), data.alias("__data"),
    ).select("archive", "seq", "key", F.octet_length("__data").cast("long").alias("length"), F.sha2("__data", 256).alias("digest"))


def audited_pages(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page archives of two replicas, compared: one row per record of the first replica and per extra one.

    archive, leaf, key, offset, length, status: ``intact`` or as ``audit`` says.  An empty replica makes all missing.
    """
    one, two = (cut(leaves(page_records(p, record()))) for p in (pages, replica))
    damage, _ = audit(one, two)
    damage = cut(damage)
    bad = damage.where("status <> 'extra'").select("archive", "leaf", "status")
    known = one.join(bad, ["archive", "leaf"], "left").select("archive", "leaf", "key", "offset", "length", F.coalesce("status", F.lit("intact")).alias("status"))
    extra = damage.where("status = 'extra'").select("archive", "leaf", "key", F.col("other_offset").alias("offset"), F.col("other_length").alias("length"), "status")
    return known.unionByName(extra)
