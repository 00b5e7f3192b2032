"""Model answers: the endpoint that an answer names, and tests of the code it holds."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.jsonvals import names_in

# What names an endpoint, a method and a route in an answer that is no JSON.
ENDPOINT_ID = r"apiendpoint_[A-Za-z0-9_\-]+"
METHOD_WORD = r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\b"
ROUTE_WORD = r"/[A-Za-z0-9_./{}:\-]+"
QUOTED_NAME = r"[\"']([A-Za-z_][A-Za-z0-9_.\-]*)[\"']"
FENCED_JSON = r"(?is)```(?:json)?\s*(.*?)```"
TOP3_KEYS = ("top3_endpoint_ids", "top3", "top_3")

ANSWER = "endpoint_id string, method string, route string, parameters array<string>, top3 array<string>, listed boolean"


def _said(v) -> str:
    return "" if v is None else str(v).strip()


def parse_answer(raw: str | None) -> tuple:
    """(endpoint id, method, route, parameter names, endpoint ids in order, whether those are a list) of an answer.

    The first fenced block stands for the answer.  A JSON object tells its
    fields; of any other text the first id, method and route count, and every
    quoted name is a parameter.
    """
    text = _said(raw)
    block = re.search(FENCED_JSON, text)
    if block:
        text = block[1].strip()
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        found = None
    if not isinstance(found, dict):
        first = lambda p: next((m[0] for m in re.finditer(p, text)), "")
        return first(ENDPOINT_ID), first(METHOD_WORD).upper(), first(ROUTE_WORD), names_in(re.findall(QUOTED_NAME, text)), [], False
    ranked = next((found[k] for k in TOP3_KEYS if found.get(k)), None)
    listed = isinstance(ranked, list)
    ranked = re.findall(ENDPOINT_ID, ranked) if isinstance(ranked, str) else [_said(x) for x in ranked] if isinstance(ranked, list) else []
    return _said(found.get("endpoint_id")), _said(found.get("method")), _said(found.get("route")), names_in(found.get("parameters")), ranked, listed


def answer(raw: Column) -> Column:
    return F.udf(parse_answer, ANSWER, useArrow=True)(raw)


def _holds(code: Column, part: Column) -> Column:
    return (part != "") & F.contains(F.lower(code), F.lower(part))


def names_host(code: Column, host: Column) -> Column:
    return _holds(code, host)


def names_endpoint(code: Column, url: Column, route: Column) -> Column:
    return _holds(code, url) | _holds(code, route)


def uses_method(code: Column, method: Column) -> Column:
    """A client's call of that name, ``method=`` with the name, or the quoted name before a comma, in any case."""
    name = F.concat(F.lit(r"\Q"), method, F.lit(r"\E"))
    pattern = F.concat(
        F.lit(r"(?i)\brequests\."), name, F.lit(r"\s*\(|\bhttpx\."), name, F.lit(r"\s*\(|method\s*=\s*[\"']"), name, F.lit(r"[\"']|[\"']"), name, F.lit(r"[\"']\s*,")
    )
    return F.regexp_like(code, pattern)


def sends_header(code: Column, host: Column) -> Column:
    return F.contains(F.lower(code), F.lit("x-rapidapi-host")) & ((host == "") | F.contains(F.lower(code), F.lower(host)))


def handles_response(code: Column) -> Column:
    return code.rlike(r"\.json\(\)|\.text|\.content|status_code|raise_for_status\(\)")


def handles_errors(code: Column) -> Column:
    return code.rlike(r"\btry\s*:|\bexcept\b|raise_for_status\(\)|status_code")
