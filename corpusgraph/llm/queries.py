"""The queries opN_<name> of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from corpusgraph.llm import decontam, fingerprints, html_text, license_scan, line_chunks, neardup, quality, sp_encode, token_spans, warc
from corpusgraph.llm._common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_encode.encode_digests(table(spark, sf_dir, "documents"), piece_model())


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


ORACLES["op4_license_scan"] = license_scan.ORACLE


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


ORACLES["op6_fingerprints"] = fingerprints.ORACLE


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of the texts after removal: nothing but the ranges and hashes is written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_chunks.remove_repeated(docs, cuts="cuts", run_words=line_chunks.RUN_WORDS)
    cuts = F.coalesce("cuts", F.array().cast("array<struct<pos:int,lines:int>>"))
    return out.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"),
        F.size(cuts).cast("long").alias("n_chunks_removed"), F.aggregate(cuts, F.lit(0), lambda a, c: a + c["lines"]).cast("long").alias("n_lines_removed"), cuts.alias("removed"),
    )


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)


@query
def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archives against a replica in which one letter of every 97th page was turned over."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    return warc.audited_pages(pages, pages.withColumn("html", damaged))


@query
def op10_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_spans.section_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Cuts the article out of the pages that the tables hold, whose layout is one and the same.
ORACLES["op1_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>([\s\S]*)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, unnest(string_split_regex(h, '</?(?:h1|p)>')) AS t, generate_subscripts(string_split_regex(h, '</?(?:h1|p)>'), 1) AS i FROM a),
c AS (SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '<[^>]+>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) AS t FROM b),
d AS (SELECT page_id, url, string_agg(regexp_replace(t, '&amp;?', '&', 'g'), chr(10) || chr(10) ORDER BY i) AS text FROM c WHERE t <> '' GROUP BY ALL)
SELECT page_id, a.url, coalesce(text, '') AS text, coalesce(length(text), 0)::BIGINT AS n_chars FROM a LEFT JOIN d USING (page_id)
"""

#: Bytes of a record that don't depend on its page: the fixed parts of the head, the id and the digest in it, the line ends.
_FIXED = sum(
    map(len, ("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: ", "\r\nWARC-Record-ID: <urn:uuid:", ">\r\nWARC-Block-Digest: sha256:", "\r\nContent-Type: text/html\r\nContent-Length: ", "\r\n\r\n", "\r\n\r\n"))
) + 36 + 64
#: The ranges of records follow from their lengths; which ones were changed is known from how the replica was made.
ORACLES["op9_warc_fixity"] = f"""
WITH p AS (SELECT page_id, 'pages-' || lpad((page_id // 2048)::VARCHAR, 6, '0') AS archive, page_id || ' ' || coalesce(url, '') AS key, coalesce(html, '') AS h, coalesce(url, '') AS u FROM pages),
r AS (SELECT *, ({_FIXED} + strlen(u) + strlen(h) + length(strlen(h)::VARCHAR))::BIGINT AS n FROM p)
SELECT archive, row_number() OVER w - 1 AS leaf, key, (sum(n) OVER w - n)::BIGINT AS "offset", n AS length, CASE WHEN page_id % 97 = 13 AND h <> '' THEN 'differs' ELSE 'intact' END AS status
FROM r WINDOW w AS (PARTITION BY archive ORDER BY page_id)
"""
