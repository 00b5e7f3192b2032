"""Values of JSON text whose shape differs from row to row."""

from __future__ import annotations

import json
import re
from typing import Any
from urllib.parse import parse_qsl

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers that are no parameters, and keys that hold a parameter's name or its description.
HEADERS = {"x-rapidapi-host", "x-rapidapi-key", "x-rapidapi-proxy-secret", "content-type", "accept", "authorization", "user-agent"}
NAME_KEYS = ("name", "key", "param", "parameter", "field")
BARE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
# Keys that tell of a parameter without being one.
COVERAGE_GENERIC = {
    "name", "key", "type", "description", "required", "optional", "default", "example", "value", "values", "schema", "items", "properties", "format", "in", "param", "parameter", "parameters",
    "payload", "body", "headers",
}
# Parts of the name of a code fragment that holds parameters.
FRAGMENTS = ("query", "params", "payload", "data", "json", "body")
KEY_IN_TEXT = re.compile(r"[\"']([A-Za-z_][A-Za-z0-9_.\-]*)[\"']\s*:")


def load(v: str | None) -> Any:
    """The value of JSON text; other text stays as it is."""
    if v is None:
        return None
    try:
        return json.loads(v)
    except (ValueError, RecursionError):
        return v


def _flat(v: Any, out: list[str]) -> None:
    """Keys of objects at any depth; of a list the objects' names and schemas and the plain names; a text that is a name."""
    if isinstance(v, dict):
        out.extend(map(str, v))
        for x in v.values():
            if isinstance(x, (dict, list)):
                _flat(x, out)
    elif isinstance(v, list):
        for x in v:
            if isinstance(x, dict):
                out.extend(str(x[k]) for k in NAME_KEYS if x.get(k) is not None)
                _flat(x.get("schema"), out)
            elif isinstance(x, str):
                _flat(x, out)
    elif isinstance(v, str) and BARE_NAME.fullmatch(v.strip()):
        out.append(v)


def _parameters(found: list[str]) -> list[str]:
    return sorted({x.strip() for x in found if x.strip() and x.strip().lower() not in HEADERS})


def names_in(v: Any) -> list[str]:
    """Sorted parameter names in a value, without headers."""
    out: list[str] = []
    _flat(v, out)
    return _parameters(out)


def names(*values: str | None) -> list[str]:
    """Sorted parameter names in JSON texts, without headers."""
    out: list[str] = []
    for v in values:
        _flat(load(v), out)
    return _parameters(out)


def observed(code_params: str | None) -> list[str]:
    """Sorted names that stand as keys in the fragments of code which hold parameters."""
    v = load(code_params)
    if not isinstance(v, dict):
        return []
    texts = [str(x) for k, x in v.items() if x is not None and any(f in str(k).lower() for f in FRAGMENTS)]
    return _parameters([k for t in texts for k in KEY_IN_TEXT.findall(t)])


def observed_names(c: Column) -> Column:
    return F.udf(observed, "array<string>", useArrow=True)(c)


def top_names(*values: str | None) -> list[str]:
    """Sorted names at the top of JSON texts alone: keys of an object, names or texts of a list."""
    out: set[str] = set()
    for v in map(load, values):
        if isinstance(v, dict):
            out.update(map(str, v))
        elif isinstance(v, list):
            out.update(str(x["name"]) for x in v if isinstance(x, dict) and x.get("name"))
            out.update(x for x in v if isinstance(x, str))
    return sorted(x for x in out if x)


def dense_names(*cols: Column) -> Column:
    return F.udf(top_names, "array<string>", useArrow=True)(*cols)


def param_names(*cols: Column) -> Column:
    return F.udf(names, "array<string>", useArrow=True)(*cols)


# Keys of a parameter that hold its name, place or value, first match first, and lists of parameters by place.
PARAM_NAMES = ("name", "key", "id", "param", "title")
PARAM_PLACES = ("in", "paramType", "parameterType", "location", "type")
PARAM_VALUES = ("value", "example", "examples", "default", "defaultValue", "testValue", "sample")
PARAM_LISTS = ("query", "queries", "queryParams", "path", "pathParams", "headers")


def _listed(v: Any) -> list:
    """The parameters of a documented value: a list, lists by place, or an object of objects."""
    if isinstance(v, dict) and "parameters" in v:
        v = load(v["parameters"]) if isinstance(v["parameters"], str) else v["parameters"]
    if isinstance(v, list):
        return v
    if not isinstance(v, dict):
        return []
    by_place = [x | {"in": x.get("in") or k} for k in PARAM_LISTS if isinstance(v.get(k), list) for x in v[k] if isinstance(x, dict)]
    return by_place or (list(v.values()) if all(isinstance(x, (dict, list)) and x for x in v.values()) else [])


def _example(p: dict) -> Any:
    v = next((p[k] for k in PARAM_VALUES if p.get(k) not in (None, "")), "")
    v = load(v) if isinstance(v, str) else v
    return v.get("value", v.get("example", v)) if isinstance(v, dict) else v


def bucketed(route: str | None, params: str | None) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Query, path and header parameters with an example value each, of a route's query and of documented parameters; those of the body are none."""
    said = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    query = dict(parse_qsl((route or "").partition("?")[2], keep_blank_values=True))
    path: dict[str, str] = {}
    header: dict[str, str] = {}
    for p in _listed(load(params)):
        name = next((str(p[k]) for k in PARAM_NAMES if p.get(k)), "") if isinstance(p, dict) else ""
        place = next((str(p[k]).lower() for k in PARAM_PLACES if p.get(k)), "query") if name else "body"
        into = header if "header" in place else path if "path" in place else None if "body" in place else query
        if into is not None:
            into[name] = said(_example(p))
    return query, path, header


def param_buckets(route: Column, params: Column) -> Column:
    return F.udf(bucketed, "query map<string,string>, path map<string,string>, header map<string,string>", useArrow=True)(route, params)


def _collect(v: Any, out: set[str]) -> None:
    if isinstance(v, dict):
        told = [v[k] for k in NAME_KEYS if isinstance(v.get(k), str)]
        out.update(x.strip() for x in (*told, *v) if 0 < len(x.strip()) <= 80 and x.strip().lower() not in COVERAGE_GENERIC)
        v = list(v.values())
    for x in v if isinstance(v, list) else ():
        _collect(x, out)


def collected(*values: str | None) -> list[str]:
    """Sorted names of documented parameters at any depth; keys that only describe are left out, and names above 80 characters."""
    out: set[str] = set()
    for v in values:
        _collect(load(v), out)
    return sorted(out)


def collected_names(*cols: Column) -> Column:
    return F.udf(collected, "array<string>", useArrow=True)(*cols)


def filled(v: Any) -> bool:
    """Whether a value says something; 0 and false do."""
    return v is not None and (bool(v.strip()) if isinstance(v, str) else bool(v) if isinstance(v, (list, dict)) else True)


def used(code: str | None, *values: str | None) -> bool | None:
    """Whether a text holds a documented parameter's name; null where no value documents any."""
    found: set[str] = set()
    told = [v for v in map(load, values) if filled(v)]
    if not told:
        return None
    for v in told:
        _collect(v, found)
    return any(n in (code or "") for n in found)


def param_used(code: Column, *cols: Column) -> Column:
    return F.udf(used, "boolean", useArrow=True)(code, *cols)


def walk(v: str | None, compat: bool = False, name: str = "") -> list[tuple[str, str, str]]:
    """(location, key, text) of every string in a JSON text, in the field ``name``; ``compat`` leaves out strings that lie directly in lists."""
    out: list[tuple[str, str, str]] = []

    def go(x: Any, where: str, key: str, listed: bool) -> None:
        if isinstance(x, dict):
            for k, y in x.items():
                go(y, f"{where}.{k}" if where else str(k), str(k), False)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                go(y, f"{where}[{i}]", key, True)
        elif isinstance(x, str) and not (compat and listed):
            out.append((where, key, x))

    go(load(v), name, name, False)
    return out


def json_strings(c: Column, *, compat: bool = False) -> Column:
    return F.udf(lambda v: walk(v, compat), "array<struct<location: string, key: string, text: string>>", useArrow=True)(c)


def side_strings(fields: dict[str, Column], *, compat: bool = False) -> Column:
    """Strings of several JSON texts, each location with its field's name at the head."""
    own = list(fields)
    run = lambda *values: [x for n, v in zip(own, values) for x in walk(v, compat, n)]
    return F.udf(run, "array<struct<location: string, key: string, text: string>>", useArrow=True)(*fields.values())


def balanced(text: str | None, marker: str = "") -> list[str]:
    """JSON objects and lists that stand balanced in a text after each marker, outermost first, strings skipped."""
    out, s = [], text or ""
    at = s.find(marker) if marker else 0
    while 0 <= at < len(s):
        start = min((p for p in (s.find("{", at), s.find("[", at)) if p >= 0), default=-1)
        if start < 0:
            break
        depth, i, quoted = 0, start, False
        while i < len(s):
            ch = s[i]
            if quoted:
                i += ch == "\\"
                quoted = ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                depth += 1
            elif ch in "}]":
                depth -= 1
                if not depth:
                    break
            i += 1
        if depth:
            break
        out.append(s[start : i + 1])
        at = s.find(marker, i + 1) if marker else i + 1
    return out


def balanced_json(c: Column, marker: str = "") -> Column:
    return F.udf(lambda t: balanced(t, marker), "array<string>", useArrow=True)(c)


def comments_text(c: Column) -> Column:
    """Comments as one text: of a JSON list the items' text, an empty line between; other JSON strings and bare text as they are."""
    objects = F.transform(F.from_json(c, "array<struct<text: string>>"), lambda x: x["text"])
    strings = F.from_json(c, "array<string>")
    one = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    joined = lambda a: F.array_join(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), "\n\n")
    listed = F.trim(c).startswith("[")
    return F.when(c.isNull(), "").when(listed & F.trim(c).rlike(r"^\[\s*\{"), joined(objects)).when(listed, joined(strings)).when(F.trim(c).startswith('"'), F.coalesce(F.trim(one), F.lit(""))).otherwise(F.trim(c))
