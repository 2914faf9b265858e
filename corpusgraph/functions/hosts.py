"""Addresses that a caller names: made whole, and kept away from private networks.  Column expressions; no name is looked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that always mean this machine, and endings that are never public.
LOOPBACK = ("localhost", "127.0.0.1", "[::1]")
INTERNAL = (".local", ".internal")
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def host(url: Column) -> Column:
    """The host of an address in lower case, without credentials, port and a dot at the end."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")


def normalised(raw: Column) -> Column:
    """Struct (url, error): a web address as it is meant, or why it is none.

    Without a scheme it is https, or http for this machine, and the host must look like one: this machine, four numbers,
    or a name with a dot.  Credentials are dropped.
    """
    value = F.trim(F.coalesce(raw, F.lit("")))
    explicit = value.rlike(r"(?i)^[a-z][a-z0-9+.-]*://")
    bare = F.lower(F.regexp_extract(value, r"^(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    whole = F.when(explicit, value).otherwise(F.concat(F.when(bare.isin(*LOOPBACK), F.lit("http://")).otherwise(F.lit("https://")), value))
    scheme, at = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), host(whole)
    rest = F.regexp_replace(whole, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)", "")
    port = F.regexp_extract(rest, r"^(:\d+)", 1)
    path = F.regexp_replace(rest, r"^:\d*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    likely = at.isin(*LOOPBACK) | at.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | at.rlike(r"^[^.].*\..*[a-z0-9]")
    error = (
        F.when(value == "", "no address").when(~explicit & value.rlike(r"\s"), "not a web address").when(~scheme.isin("http", "https"), "neither http nor https")
        .when((at == "") | at.rlike(r"\s"), "not a web address").when(~explicit & ~likely, "not a web address")
    )
    return F.struct(F.when(error.isNull(), F.concat(scheme, F.lit("://"), at, port, path)).alias("url"), error.alias("error"))


def private(url: Column) -> Column:
    """Whether an address is of this machine, a private network or no public one; null for a name, which only a look-up
    could tell, and true without a host."""
    at = host(url)
    octet = [F.regexp_extract(at, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i + 1).try_cast("int") for i in range(4)]
    a, b, c, _ = octet
    v4 = F.coalesce(
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & ((b == 168) | ((b == 0) & c.isin(0, 2)))) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113)),
        F.lit(True),
    ) | F.exists(F.array(*octet), lambda o: F.coalesce(o > 255, F.lit(True)))
    six = F.regexp_replace(F.regexp_replace(at, r"^\[|\]$", ""), "%.*$", "")
    v6 = six.rlike(r"^(?:0*:)*:?0*[01]?$") | six.rlike(r"^f[cdef]") | six.rlike(r"^(?:0*:)*:?ffff:") | six.rlike(r"^2001:0*db8:") | ~six.rlike(r"^[0-9a-f:.]+$")
    name = F.when((at == "localhost") | at.rlike("|".join(e.replace(".", r"\.") + "$" for e in INTERNAL)), True)
    return F.when(at == "", True).when(at.startswith("["), v6).when(at.rlike(r"^[\d.]+$"), v4).otherwise(name)
