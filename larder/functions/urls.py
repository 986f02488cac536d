"""URLs as keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"(?i)^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Parameters that tell where a reader came from (fixed values).
TRACKING = r"(?i)^(utm_|fbclid|gclid|mc_|adt_ei$|ref$|source$)"


def _host(authority: Column, scheme: Column) -> Column:
    """Lower-case host without www. and without the scheme's usual port; user names stay."""
    bare = F.regexp_replace(F.lower(authority), r"^((?:[^@]*@)?)www\.", "$1")
    return F.when(F.lower(scheme) == "http", F.regexp_replace(bare, ":80$", "")).otherwise(F.regexp_replace(bare, ":443$", ""))


def canonical_url(url: Column) -> Column:
    """https, lower-case host without www., no final slash but the root's, fragment or tracking parameter, parameters by name; what is no URL stays."""
    trimmed = F.trim(url)
    part = lambda i: F.regexp_extract(trimmed, URL, i)
    # a port is dropped as the usual one of the old scheme, and then of https
    host = F.regexp_replace(_host(part(2), part(1)), ":443$", "")
    named = F.transform(F.split(part(4), "&"), lambda x, i: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("name"), i.alias("i"), x.alias("x")))
    kept = F.array_sort(F.filter(named, lambda p: (p["x"] != "") & ~p["name"].rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: p["x"]), "&")
    path = F.regexp_replace(part(3), "/+$", "")
    made = F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(trimmed.rlike(URL), made).otherwise(url)


def origin(url: Column) -> Column:
    """Scheme, host without www. and port if it isn't the usual one; what is no URL: lower case without final slashes."""
    made = F.lower(F.regexp_replace(F.trim(url), r"(?is)^(https?)://([^/?#]+).*$", "$1://$2"))
    made = F.regexp_replace(made, r"(?s)^(https?://)(?:[^@]*@)?(?:www\.)?", "$1")
    made = F.regexp_replace(made, r"(?s)^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.when(F.trim(url).rlike(URL), made).otherwise(F.regexp_replace(F.lower(url), "/+$", ""))
