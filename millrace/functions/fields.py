"""Fields of records, endpoints and answers: defaults, normal forms and ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import text

# Values to try a parameter with, by what its lower-cased name holds, first match first.
SAFE_VALUES = [("limit", "1"), ("count", "1"), ("page", "1"), ("offset", "1"), ("date", "2024-01-01"), ("country", "US"), ("lat", "40.7128"), ("lon", "-74.0060"), ("lng", "-74.0060"), ("city", "New York"), ("language", "en"), ("id", "1")]
SAFE_NAMES = {"lang": "en"}  # fixed values: whole names
# Layers of a search, those that name an endpoint and those that are broad.
ENDPOINT_LAYERS = ("endpoint_url_match", "endpoint_route_host_match")
BROAD_LAYERS = ("keyword_match", "keyword_requests_match")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def safe_value(name: Column) -> Column:
    x, out = F.lower(F.coalesce(name, F.lit(""))), F.when(F.lit(False), "")
    for name, value in SAFE_NAMES.items():
        out = out.when(x == name, value)
    for part, value in SAFE_VALUES:
        out = out.when(F.contains(x, F.lit(part)), value)
    return out.otherwise("test")


def layer_limit(layer: Column, *, endpoint: int = 15, broad: int = 15, other: int = 50) -> Column:
    return F.when(layer.isin(*ENDPOINT_LAYERS), endpoint).when(layer.isin(*BROAD_LAYERS), broad).otherwise(other)


def param_list(c: Column) -> Column:
    """Names of a text like ``a, b;c``."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def literal_block(code: Column, name: str) -> Column:
    """The first ``name = {...}`` without inner braces, or nothing."""
    return F.regexp_extract(F.coalesce(code, F.lit("")), rf"(?s)\b{name}\s*=\s*\{{([^{{}}]*)\}}", 1)


def json_kind(c: Column) -> Column:
    """object, list, text, number, null or none, by the JSON text's first character; no JSON counts as bare."""
    x = text(c)
    return (
        F.when(x == "", "none").when(x == "null", "null").when(x.startswith("{"), "object").when(x.startswith("["), "list").when(x.startswith('"'), "text")
        .when(x.rlike(r"^-?[0-9.]+$"), "number").otherwise("bare")
    )


def content_type(payload: Column, given: Column) -> Column:
    """The given type, else JSON for an object or list, form for other payloads, nothing without payload."""
    kind = json_kind(payload)
    return F.when(F.coalesce(text(given), F.lit("")) != "", text(given)).when(kind.isin("object", "list"), "application/json").when(kind.isin("none", "null"), "").otherwise("application/x-www-form-urlencoded")


def first_filled(*cols: Column) -> Column:
    """The first text that is not blank, else the empty text."""
    return F.coalesce(*[F.when(text(c) != "", text(c)) for c in cols], F.lit(""))
