"""Adapters that give the driver's tables the shapes of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs of the documents table."""
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("id"), F.col("source").alias("chapter"), F.concat(F.lit("doc "), "doc_id").alias("title"),
        F.concat(F.lit("https://"), "lang", F.lit(".example/"), "source", F.lit("/"), "doc_id").alias("url"), F.sha2("text", 256).alias("sha"), F.col("text").alias("body"),
    )


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs with headings, inline code, prose and links, written from the part table."""
    body = F.expr("""concat('# ', p_name, '\n\n## ', p_type, ' range\n\n### size ', p_size, '\n\nUse `', p_name, '` with `', p_brand, ' kit ', p_partkey % 37, '` and `code ', p_partkey % 211, '`.\n\n',
        'Every ', p_name, ' of lot-', p_partkey % 53, ' is kept in bin-', p_partkey % 29, ' next to the shelf for size-', p_size, ' goods. ',
        'The ', p_type, ' range was checked by crew-', p_partkey % 17, ' before it left hall-', p_partkey % 13, ', and route-', p_partkey % 101, ' takes it to town-', p_partkey % 71, '. ',
        'Keep batch-', p_partkey % 97, ' dry, and never mix ', p_name, ' stock with other stock of the same hall.\n\n',
        'See [next](part_', lpad(p_partkey * 5 + 2, 7, '0'), '.html) and [kin](part/', lpad(p_partkey + 9, 7, '0'), '.md).\n')""")
    return table(spark, sf_dir, "part").withColumn("body", body).select(
        F.concat(F.lit("part_"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("id"), F.lit("part").alias("chapter"), F.col("p_name").alias("title"),
        F.expr("concat('https://parts.example/', lower(p_type), '/', p_partkey div 60, '/', p_partkey)").alias("url"), F.sha2("body", 256).alias("sha"), "body",
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs of a family for each customer, a version for each order."""
    n = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    return table(spark, sf_dir, "orders").withColumn("v", n).select(
        F.concat(F.lit("cust_"), "o_custkey", F.lit("_v"), "v").alias("id"), F.lit("cust").alias("chapter"), F.concat(F.lit("order "), "o_orderkey").alias("title"), F.lit("").alias("url"), F.lit("").alias("sha"), F.lit("").alias("body")
    )


#: Suffix and language of a part's source file by the remainder of its key.
LANGUAGES = [(".py", "python"), (".ts", "typescript"), (".c", "c"), (".go", "go"), (".rs", "rust"), (".java", "java"), (".rb", "ruby"), (".md", None)]


_PKG, _MOD = "pkg{(k + 8) % 40}", "mod{k + 8}"
#: Contents by the remainder of the key; what is in braces is computed from the key k, in Spark and in the queries' SQL alike.
FILE_TEXTS = (
    f"import {_PKG}.{_MOD}\nfrom . import mod{{k + 40}}\n\ndef make_part_{{k}}():\n    return make_part_{{k + 8}}() + make_part_{{k + 16}}() + make_part_{{k + 8}}()\n",
    f"import x from '../{_PKG}/{_MOD}';\nimport y from './mod{{k + 40}}';\nimport z from 'react';\n",
    f'#include "mod{{k + 40}}.c"\n#include "{_PKG}/{_MOD}.c"\n#include <stdio.h>\n',
    f'package x\nimport (\n  "fmt"\n  "example.com/x/{_PKG}"\n)\n',
    f"mod mod{{k + 40}};\nuse crate::{_PKG}::{_MOD};\n",
    f"import {_PKG}.{_MOD};\nimport java.util.List;\n",
    f"require_relative '../{_PKG}/{_MOD}'\nrequire_relative 'mod{{k + 40}}'\n",
    f"# Title {{k}}\n\nSee [a](../{_PKG}/{_MOD}.md) and [[Mod{{k + 40}}]], not ![pic](mod{{k}}.png), [gone](nowhere.md) or [web](https://x.example/).\n\n```\n[fenced](mod{{k}}.md)\n```\n",
)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files (relpath, lang, content) written from the part table: each imports the files 8 and 40 keys on."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    def filled(template: str):
        parts = []
        for i, piece in enumerate(template.replace("{", "\0{").replace("}", "}\0").split("\0")):
            parts.append(F.expr(piece[1:-1]).cast("string") if piece.startswith("{") and i else F.lit(piece))
        return F.concat(*parts)

    kind = F.col("k") % 8
    pick = lambda values: F.element_at(F.array(*values), (kind + 1).cast("int"))
    files = part.select(
        F.concat(F.lit("pkg"), F.col("k") % 40, F.lit("/mod"), "k", pick([F.lit(s) for s, _ in LANGUAGES])).alias("relpath"),
        pick([F.lit(x) for _, x in LANGUAGES]).alias("lang"), pick([filled(t) for t in FILE_TEXTS]).alias("content"),
    )
    readme = part.where("k < 40").select(F.concat(F.lit("pkg"), "k", F.lit("/README.md")).alias("relpath"), F.lit(None).cast("string").alias("lang"), F.concat(F.lit("# Package "), "k", F.lit("\n")).alias("content"))
    return files.unionByName(readme)


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence (s, t, k) from orders to the suppliers of their lines; every seventh order imports."""
    k = F.when(F.col("l_orderkey") % 7 == 0, "imports").otherwise("ref")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("s"), F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 7, "0")).alias("t"), k.alias("k")).distinct()


def offer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence (s, t, k) from orders to the offers they take, a part by a supplier: few orders share one."""
    k = F.when(F.col("l_orderkey") % 7 == 0, "imports").otherwise("ref")
    offer = F.concat(F.lit("x"), "l_partkey", F.lit("_"), "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("s"), offer.alias("t"), k.alias("k")).distinct()


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("id"), F.col("o_orderpriority").alias("c"), F.concat(F.lit("Order "), "o_orderkey").alias("t"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("id"), F.lit("supplier").alias("c"), F.col("s_name").alias("t"))
    return o.union(s)


def build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log of the events table: a user is a node, what a user does to an item an edge; items are never announced but by signup."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    user, item = F.concat(F.lit("u"), "user_id"), F.concat(F.lit("i"), "k")
    node = e.where("event_type IN ('signup', 'error')").select(
        (F.col("event_id") + 1).alias("seq"), F.lit("node_added").alias("t"), F.when(F.col("event_type") == "signup", item).otherwise(user).alias("id"), F.concat(F.lit("seen "), "event_id").alias("title"),
        F.lit(None).cast("string").alias("url"), F.when(F.col("event_type") == "signup", "item").otherwise("user").alias("c"), *[F.lit(None).cast("string").alias(x) for x in ("s", "d", "kind")],
    )
    edge = e.where("event_type NOT IN ('signup', 'error')").select(
        (F.col("event_id") + 1).alias("seq"), F.lit("edge_added").alias("t"), *[F.lit(None).cast("string").alias(x) for x in ("id", "title", "url", "c")], user.alias("s"), item.alias("d"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
    )
    return node.unionByName(edge)
