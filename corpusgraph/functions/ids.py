"""Identity rules: page ids, chapters, sites and buckets, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\w+://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """Path of an address, without parameters of its last segment."""
    p = F.regexp_extract(url, r"^(?:\w+://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(p, ";[^/]*$", "")


def folder(url: Column) -> Column:
    """The path up to its last slash."""
    p = path(url)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "/")).otherwise(F.lit("/"))


def same_site(base: Column, url: Column) -> Column:
    prefix = folder(base)
    return (netloc(base) == netloc(url)) & ((prefix == "/") | path(url).startswith(prefix))


def page_id(base: Column, url: Column) -> Column:
    """The page's path below the folder of ``base`` as a name that is safe in file systems; ``index`` if nothing is left."""
    p, prefix = path(url), folder(base)
    rel = F.when((prefix != "/") & p.startswith(prefix), F.substr(p, F.length(prefix) + 1)).otherwise(p)
    rel = F.regexp_replace(F.regexp_replace(rel, "^/+|/+$", ""), r"(?i)\.(?:html?|php|aspx?)$", "")
    rel = F.replace(rel, F.lit("/"), F.lit("_"))
    # percent-encoding: url_encode writes forms, which differ in three characters
    enc = F.replace(F.replace(F.replace(F.url_encode(rel), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    safe = F.regexp_replace(F.regexp_replace(enc, "[^A-Za-z0-9._-]+", "_"), r"\.\.+", "-")
    safe = F.regexp_replace(safe, r"^[._-]+|[._-]+$", "_")
    return F.when(safe.rlike("[A-Za-z0-9]"), safe).otherwise(F.lit("index"))


def chapter(id_: Column) -> Column:
    return F.when(F.instr(id_, "_") > 0, F.substring_index(id_, "_", 1)).otherwise(F.lit("_root"))


def bucket_count(docs: int) -> int:
    """Buckets of a site's bodies by its number of documents."""
    return 1 if docs < 128 else 16 if docs < 1024 else 64 if docs < 32768 else 256


def bucket(id_: Column, n: int | Column) -> Column:
    return (F.conv(F.substring(F.sha2(id_, 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def site_id(url: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(url), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(url, 256), 1, 8))
