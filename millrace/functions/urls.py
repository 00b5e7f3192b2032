"""Addresses, routes and methods as Column expressions.

Paths are cut by regular expressions, as ``parse_url`` rejects placeholders
like ``{id}`` and blanks, which documented routes hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.fields import safe_value
from millrace.functions.text import text

_ABSOLUTE = r"(?i)^https?://"


def method(c: Column) -> Column:
    x = F.upper(text(c))
    return F.when(x == "", "GET").otherwise(x)


def url_path(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_query(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\?([^#]*)", 1)


def without_query(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[?#].*$", "")


def route(c: Column) -> Column:
    """Path with a leading slash and without query; an address gives its path or ``/``, nothing stays nothing."""
    x = text(c)
    own = F.regexp_replace(x, r"\?.*$", "")
    own = F.when(own.startswith("/"), own).otherwise(F.concat(F.lit("/"), own))
    path = url_path(x)
    return F.when(x == "", "").when(x.rlike(_ABSOLUTE), F.when(path == "", "/").otherwise(path)).otherwise(own)


def flat_route(c: Column) -> Column:
    """Route for look-ups: white space runs as one blank, nothing as ``/``."""
    x = F.substring_index(F.regexp_replace(text(c), r"(?U)\s+", " "), "?", 1)
    return F.when(x == "", "/").when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))


def route_variants(c: Column) -> Column:
    """A route with and without its last slash; none of ``/`` or nothing."""
    bare = F.regexp_replace(c, r"/+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).when(c.endswith("/"), F.array(c, bare)).otherwise(F.array(c, F.concat(c, F.lit("/"))))


def meaningful_route(c: Column) -> Column:
    return F.coalesce((F.length(c) >= 4) & ~c.isin("", "/"), F.lit(False))


def query_map(c: Column) -> Column:
    """Query of an address as a map; of a repeated name the last value stands."""
    pairs = F.filter(F.split(url_query(c), "&"), lambda x: x != "")
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.lit(0), F.size(entries) - i - 1)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def fill_placeholders(c: Column, values: Column) -> Column:
    """Route whose ``{x}``, ``<x>`` and ``:x`` are replaced by the map's values, ``test`` where it lacks the name."""
    marks = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\{[^}/]+\}|<[^>/]+>|:[A-Za-z_]\w*)"), F.lit(1)))
    name = lambda m: F.regexp_replace(m, r"[{}<>:]", "")
    return F.aggregate(marks, c, lambda acc, m: F.replace(acc, m, F.coalesce(F.element_at(values, name(m)), F.lit("test"))))


def fill_safe(c: Column) -> Column:
    """Route whose placeholders are replaced by a value that suits their names."""
    marks = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\{[^}/]+\}|<[^>/]+>|:[A-Za-z_]\w*)"), F.lit(1)))
    return F.aggregate(marks, c, lambda acc, m: F.replace(acc, m, safe_value(F.regexp_replace(m, r"[{}<>:]", ""))))


def page_slug(c: Column) -> Column:
    """Last part of an address's path."""
    return F.element_at(F.filter(F.split(F.concat(F.lit("/"), url_path(c)), "/"), lambda x: x != ""), -1)


def file_safe(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def join_url(base: Column, path: Column) -> Column:
    """Base without last slashes, then the path with one first slash."""
    return F.concat(F.regexp_replace(F.coalesce(base, F.lit("")), r"/+$", ""), route(path))
