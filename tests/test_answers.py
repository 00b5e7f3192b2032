"""Answers, their parameters and prompts against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers, jsonvals
from millrace.functions.code import replay_values
from millrace.operators import prompts
from millrace.operators.quality import match_type

ID = "apiendpoint_doc_0000000001"


@pytest.mark.parametrize(
    "raw,want",
    [
        (f'{{"endpoint_id": "{ID}", "method": "post", "route": "a/b", "parameters": ["city", "two words", {{"name": "unit"}}], "top3_endpoint_ids": ["x", " {ID} "]}}', (ID, "post", "a/b", ["city", "unit"], ["x", ID], True)),
        (f'Here:\n```json\n{{"endpoint_id": "{ID}", "top3": "{ID}, apiendpoint_b"}}\n```\nor {{}}', (ID, "", "", [], [ID, "apiendpoint_b"], False)),
        (f'I take {ID} with get on /v1/{{id}}/now and "city", \'accept\'', (ID, "GET", "/v1/{id}/now", ["city"], [], False)),
        ("[1, 2]", ("", "", "", [], [], False)), ("", ("", "", "", [], [], False)), (None, ("", "", "", [], [], False)), ('{"endpoint_id": null, "top_3": 5}', ("", "", "", [], [], False)),
    ],
)
def test_parsed_answers(raw, want):
    assert answers.parse_answer(raw) == want


def test_code_checks(spark):
    rows = [
        ("requests.post (u)", "GET", False), ("x(method='POST')", "POST", True), ('"PUT", u', "PUT", True), ("requests.get (u)", "GET", True), ("httpx.Get(u)", "GET", True), ("requests.post(u)", "GET", False), ("a.b", "a+", False),
    ]
    df = spark.createDataFrame(rows, "code string, method string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", answers.uses_method(F.col("code"), F.col("method"))).collect())
    code = F.lit("h = {'X-RapidAPI-Host': 'W.example'}\nr.raise_for_status()\nget('https://w.example/v1/now')")
    r = spark.range(1).select(
        answers.names_host(code, F.lit("w.EXAMPLE")).alias("a"), answers.names_endpoint(code, F.lit(""), F.lit("/V1/now")).alias("b"), answers.sends_header(code, F.lit("")).alias("c"),
        answers.handles_response(code).alias("d"), answers.handles_errors(code).alias("e"), answers.names_host(code, F.lit("")).alias("f"), answers.sends_header(code, F.lit("other")).alias("g"),
    ).first()
    assert tuple(r) == (True, True, True, True, True, False, False)


def test_parameters():
    assert jsonvals.observed('{"params": "{\'city\': c, \\"unit\\": 1}", "headers_code": "{\'x\': 1}", "json_body": {"deep": 2}}') == ["city", "deep", "unit"]
    assert jsonvals.observed("bare") == [] and jsonvals.observed(None) == []
    assert jsonvals.names('[{"name": "a", "key": "b", "schema": {"c": {"d": 1}}, "other": {"e": 1}}, "f", "no name"]', '"g.h"', '{"Accept": 1}') == ["a", "b", "c", "d", "f", "g.h"]
    assert jsonvals.top_names('{"a": {"b": 1}}', '[{"name": "c"}, "d", {"x": 1}]', "text", None) == ["a", "c", "d"]


def test_replayed_values():
    code = 'q: dict = {"city": "Rome", "limit": n, "api_token": "x", "note": "' + "a" * 40 + '", "lang": f(), "days": 3, 5: 1}\nz = {"other": 1}\n'
    assert replay_values(code) == {"city": "Rome", "limit": "1", "note": "test", "lang": "en", "days": "3"}
    assert replay_values("def broken(") == {} and replay_values(None) == {} and replay_values("x = 1") == {}


def test_prompts_by_level(spark):
    row = (1, "h.example", "https://h.example/a", "GET", "/a", "", "weather", "", "", ["city", "unit"], "documentation")
    df = spark.createDataFrame([row], "ord int, host string, url string, method string, route string, endpoint_name string, api_name string, function_name string, hint string, gold array<string>, source string")
    got = {r.context: r.prompt.split("\n") for r in prompts.codegen_prompts(df).collect()}
    assert [len(got[c]) for c in prompts.LEVELS] == [5, 6, 10, 12, 13]
    assert "Parameters (documentation): city, unit" in got["C3"] and not any(x.startswith("Parameters") for x in got["C2"]) and "Name: unknown" in got["C2"] and "Function: call_service" in got["C0"]


def test_match_types(spark):
    rows = [("u = 'https://h.example/v1/now?x=1'", "https://h.example/v1/now", None, None, "url"), ("get('/v1/now')", "https://h.example/v1/now", "", None, "route"), ("'h.example'", None, "/", {"X-RapidAPI-Host": "h.example"}, "host_only"), ("x", "", "", None, "none")]
    df = spark.createDataFrame(rows, "code string, url string, route string, headers map<string,string>, want string")
    got = df.withColumn("got", match_type(F.lit(None).cast("string"), F.col("code"), F.col("url"), F.col("route"), F.lit(""), F.col("headers"))).collect()
    assert all(r.got == r.want for r in got)


def test_documented_endpoints(spark, monkeypatch):
    from millrace.plans import apis

    ends = [("w", 0, "first", "/a/b/", "h0.example", "https://h0.example/a/b/"), ("w", 1, "second", "/c", "H1.example", " https://h1.example/c "), ("v", 0, "only", None, None, None)]
    e = spark.createDataFrame(ends, "api_name string, pos int, endpoint_id string, route string, host string, url string")
    docs = spark.createDataFrame([("w", "known.example"), ("v", None)], "api_name string, rapidapi_host string")
    rows = [
        (1, "w", "get('https://h1.example/c')", "url", "second"), (2, "w", "get('https://h0.example/a/b')", "url", "first"), (3, "w", "get(base + '/a/b')", "route", "first"), (4, "w", "h = 'H1.example'", "host_only", "second"),
        (5, "w", "h = 'h1.example'", "none", "first"), (6, "w", "known.example", "host_only", "first"), (7, "v", "x", "none", "only"), (8, "undocumented", "x", "none", None), (9, "w", None, "none", "first"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "ord bigint, api_name string, code string")
    monkeypatch.setattr(apis, "endpoints", lambda s, d: e)
    monkeypatch.setattr(apis, "heavy", lambda s, d, *c: df)
    monkeypatch.setattr(apis, "table", lambda s, d, n: docs)
    got = {r.ord: (r.how, r.endpoint_id) for r in apis.documented_endpoint(spark, "").collect()}
    assert got == {r[0]: r[3:] for r in rows}


def test_collected_parameters():
    listed = '[{"name": "city", "in": "query", "example": "{\\"value\\": \\"Rome\\"}"}, {"key": "id", "location": "PATH", "default": 7}, {"id": "X-Key", "paramType": "header"}, {"name": "b", "in": "body"}, {"in": "query"}, "text"]'
    assert jsonvals.bucketed("/a?page=2&page=3&q=a%20b", listed) == ({"page": "3", "q": "a b", "city": "Rome"}, {"id": "7"}, {"X-Key": ""})
    assert jsonvals.bucketed("/a", '{"query": [{"name": "u"}], "headers": [{"name": "h", "in": ""}]}') == ({"u": ""}, {}, {"h": ""})
    assert jsonvals.bucketed(None, '{"parameters": [{"name": "z", "value": [1, 2]}]}') == ({"z": "[1, 2]"}, {}, {})
    assert jsonvals.bucketed("/a", "bare") == ({}, {}, {}) == jsonvals.bucketed(None, '{"a": 1}') and jsonvals.bucketed("", '{"a": {"name": "n"}}') == ({"n": ""}, {}, {})


def test_suspicious_literals():
    from millrace.operators.audit import suspicious

    key = "a1B2c3D4e5F6g7H8i9J0k1L2m3"
    code = f'h = {{"X-RapidAPI-Key": "{key}", "x-rapidapi-key": "your_{key}", "other": "{key}z"}}\nk = "0123456789mshabcdefgh12"\n'
    assert suspicious(code) == ["0123456789mshabcdefgh12", key] and suspicious(code + "(") == ["0123456789mshabcdefgh12"] and suspicious(None) == []


def test_endpoint_prompts(spark):
    kind = "api_name string, endpoint_id string, endpoint_name string, method string, route string, params string, path_params string, header_params string, payload string"
    none = (None, None, None, None)
    ends = [("w", f"e{i}", f"n{i}", "get", f"/r{i}", '{"city": 1}', None, None, None) for i in range(15)] + [("one", "only", "n", "GET", "/x", *none)]
    rows = [
        (1, "url", "w", "e3", "n3", "GET", "/other", *none), (2, "url", "w", "", "n", "GET", "r5", *none), (3, "url", "w", "new", "mine", "POST", "/z", *none), (4, "host_only", "w", "e1", "", "GET", "/r1", *none),
        (5, "url", "one", "only", "", "GET", "/x", *none), (6, "url", "free", "a", "", "GET", "/a", *none), (7, "url", "free", "b", "", "GET", "/b", '["p"]', None, None, None), (8, "url", None, "b", "", "GET", "/b", *none),
    ]
    df = spark.createDataFrame(rows, "ord bigint, match string, " + kind)
    got = {}
    for r in prompts.endpoint_prompts(df, spark.createDataFrame(ends, kind)).collect():
        got.setdefault(r.ord, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 10, 2: 10, 3: 10, 6: 2, 7: 2}
    target = {k: [r.endpoint_id for r in v if r.is_target] for k, v in got.items()}
    assert target == {1: ["e3"], 2: ["e5"], 3: ["new"], 6: ["a"], 7: ["b"]}
    assert all(sorted(r.label for r in v) == sorted(f"E{i + 1}" for i in range(len(v))) for v in got.values())
    assert next(r.line for r in got[1] if r.is_target).endswith(". endpoint_id=e3 | method=GET | route=/r3 | name=n3 | params=city")
