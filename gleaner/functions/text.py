"""Phrases, urls and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def phrases(prompt: Column) -> Column:
    """Parts between commas, stripped and in lower case; empty parts go, null gives none."""
    parts = F.transform(F.split(F.coalesce(prompt, F.lit("")), ","), lambda p: F.lower(strip(p)))
    return F.filter(parts, lambda p: p != "")


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty if the last segment has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def first_segment(path: Column, root: str) -> Column:
    """The folder right below ``root`` that holds the path; null for files in the root itself."""
    inner = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path)))
    return F.when(F.contains(inner, F.lit("/")), F.substring_index(inner, "/", 1))


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(ext))


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def _pairs(url: Column) -> Column:
    """Key and value of each query parameter that has a value."""
    parts = F.filter(F.split(url_query(url), "&"), lambda p: F.regexp_extract(p, "=(.+)$", 1) != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, "=(.*)$", 1).alias("value")))


def with_parameter(url: Column, key: str, value: str) -> Column:
    """``url`` with the query parameter set: in its place if it was there, else at the end. Blank parameters go; of those
    with the same key, values stay in order at the place of the first; a fragment stays."""
    def rebuild(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        keys = F.when(F.array_contains(keys, key), keys).otherwise(F.concat(keys, F.array(F.lit(key))))
        own = lambda k: F.when(k == key, F.array(F.concat(k, F.lit("=" + value)))).otherwise(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: F.concat(p["key"], F.lit("="), p["value"])))
        return F.array_join(F.flatten(F.transform(keys, own)), "&")

    query = F.element_at(F.transform(F.array(_pairs(url)), rebuild), 1)
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), query, F.regexp_extract(url, "(#.*)$", 1))


def parameter(url: Column, key: str, default: str) -> Column:
    """The first value of a query parameter that has one."""
    found = F.filter(_pairs(url), lambda p: p["key"] == key)
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(default))


def safe_name(name: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` only; ``unknown`` if nothing is left."""
    kept = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_-]", "")
    return F.when(kept == "", F.lit("unknown")).otherwise(kept)


def media_name(url: Column, user: Column) -> Column:
    """``@user_<md5 of the url>.<format>``."""
    return F.concat(F.lit("@"), safe_name(user), F.lit("_"), F.md5(url.cast("binary")), F.lit("."), parameter(url, "format", "jpg"))


def percent_encoded(c: Column) -> Column:
    """All but letters, digits and ``_.-~`` as percent signs and hex, by bytes of UTF-8."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def folded(c: Column) -> Column:
    """For comparison without case: as lower case does, and letters that only differ in it otherwise (such as a sharp s) alike."""
    return F.lower(F.upper(c))


def handle(text: Column) -> Column:
    """A user's handle: trimmed, without leading ``@``; null if nothing of more than one character was there."""
    t = strip(text)
    return F.when((F.length(t) > 1) & F.startswith(t, F.lit("@")), F.regexp_replace(t, "^@+", ""))


def flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("TRUE")).otherwise(F.lit("FALSE"))


def local_path(path: str) -> str:
    """A path that Python can open; the folder has to be on a disk that driver and tasks share."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is not on a local or mounted folder")
    return path
