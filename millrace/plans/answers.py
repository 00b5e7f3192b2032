"""Queries over model answers: what they name and how that scores, and the prompts and parameters they are scored against."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import answers as an
from millrace.functions import text as tx
from millrace.functions import urls
from millrace.functions.code import code_facts, replay
from millrace.functions.fields import content_type, first_filled
from millrace.functions.jsonvals import dense_names, observed_names, param_buckets, param_names
from millrace.operators import prompts as pr
from millrace.operators.audit import suspicious_literals
from millrace.operators.dedupe import first_wins, last_wins
from millrace.operators.metrics import set_prf
from millrace.plans.apis import END, _METHOD, _TRIM, _route_sql, endpoints
from millrace.plans.records import FLAT, SIDES, flat
from millrace.plans.registry import query
from millrace.runtime import spread, table

_DOCUMENTED = ("params", "path_params", "header_params", "payload")


def _gold(spark, d):
    """What the last record of each id says of its endpoint."""
    return last_wins(pr.ground_truth(flat(spark, d)), ["sample_id"], "ord")


def _gold_params(df):
    """Documented and observed parameter names, and which of them count."""
    documented, seen = param_names(*[F.col(c) for c in _DOCUMENTED]), observed_names(F.col("code_params"))
    df = df.withColumn("documented", documented).withColumn("observed", seen)
    source = F.when(F.size("documented") > 0, "documentation").when(F.size("observed") > 0, "code_params").otherwise("none")
    return df.withColumn("source", source).withColumn("gold", F.when(F.size("documented") > 0, F.col("documented")).otherwise(F.col("observed")))


_GOLD = f", g AS (SELECT sample_id, arg_max({_TRIM.format('endpoint_id')}, ord) AS gid, arg_max({_route_sql('route')}, ord) AS groute, arg_max({_METHOD}, ord) AS gmethod, arg_max({_TRIM.format('api_host')}, ord) AS ghost, arg_max({_TRIM.format('url')}, ord) AS gurl FROM flat GROUP BY 1)"
_TOP3 = " ".join(
    f"WHEN json_type(j, '$.{k}') = 'ARRAY' AND json_array_length(j, '$.{k}') > 0 THEN list_transform(from_json(json_extract(j, '$.{k}'), '[\"VARCHAR\"]'), lambda y: trim(y)) WHEN json_type(j, '$.{k}') = 'VARCHAR' AND json_extract_string(j, '$.{k}') <> '' THEN regexp_extract_all(json_extract_string(j, '$.{k}'), '{an.ENDPOINT_ID}')"
    for k in an.TOP3_KEYS
)
_PARSED = rf""", raw AS (SELECT sample_id, model, called_at, {_TRIM.format('raw_output')} AS raw FROM model_output), f AS (SELECT *, regexp_extract_all(raw, '(?is)```(?:json)?\s*(.*?)```', 1) AS blocks FROM raw),
 x AS (SELECT sample_id, model, called_at, CASE WHEN len(blocks) > 0 THEN regexp_replace(blocks[1], '^\s+|\s+$', '', 'g') ELSE raw END AS x FROM f),
 o AS (SELECT *, CASE WHEN json_valid(x) THEN CASE WHEN json_type(x) = 'OBJECT' THEN x END END AS j FROM x),
 a AS (SELECT sample_id, model, called_at, CASE WHEN j IS NULL THEN regexp_extract(x, '{an.ENDPOINT_ID}') ELSE {_TRIM.format("json_extract_string(j, '$.endpoint_id')")} END AS eid,
 CASE WHEN j IS NULL THEN upper(regexp_extract(x, '(?i)\b(GET|POST|PUT|DELETE|PATCH)\b', 1)) ELSE {_TRIM.format("json_extract_string(j, '$.method')")} END AS method,
 CASE WHEN j IS NULL THEN regexp_extract(x, '{an.ROUTE_WORD}') ELSE {_TRIM.format("json_extract_string(j, '$.route')")} END AS route, CASE WHEN j IS NULL THEN []::VARCHAR[] {_TOP3} ELSE []::VARCHAR[] END AS top3, j FROM o)"""
_SCORED = f""", n AS (SELECT a.sample_id, a.model, a.called_at, a.eid, a.top3, CASE WHEN a.method = '' THEN 'GET' ELSE upper(a.method) END AS m, {_route_sql('a.route')} AS r, g.* EXCLUDE (sample_id) FROM a JOIN g USING (sample_id)),
 s AS (SELECT *, (eid <> '' AND eid = gid) OR (r <> '' AND r = groute AND m = gmethod) AS top1 FROM n)"""


def _endpoint_scores(spark, d):
    a = spread(table(spark, d, "model_output").select("sample_id", "model", "called_at", "raw_output"), "called_at").withColumn("a", an.answer(F.col("raw_output")))
    a = a.select("sample_id", "model", "called_at", F.col("a.endpoint_id").alias("eid"), urls.method(F.col("a.method")).alias("m"), urls.route(F.col("a.route")).alias("r"), F.col("a.parameters").alias("pred"), F.col("a.top3").alias("ranked"))
    g = _gold(spark, d).select("sample_id", F.col("endpoint_id").alias("gid"), F.col("route").alias("groute"), F.col("method").alias("gmethod"))
    j = a.join(g, "sample_id")
    top1 = ((F.col("eid") != "") & (F.col("eid") == tx.text(F.col("gid")))) | ((F.col("r") != "") & (F.col("r") == F.col("groute")) & (F.col("m") == F.col("gmethod")))
    top3 = top1 | ((F.col("gid") != "") & F.array_contains(F.slice("ranked", 1, 3), tx.text(F.col("gid"))))
    return j.select(
        "sample_id", "model", "called_at", "eid", "pred", top1.alias("top1"), top3.alias("top3"), ((F.col("r") != "") & (F.col("r") == F.col("groute"))).alias("route_ok"), (F.col("m") == F.col("gmethod")).alias("method_ok")
    )


@query(FLAT + _GOLD + _PARSED + _SCORED + " SELECT sample_id, model, called_at, eid, top1, top1 OR (gid <> '' AND list_contains(top3[1:3], gid)) AS top3, r <> '' AND r = groute AS route_ok, m = gmethod AS method_ok FROM s")
def endpoint_scores(spark, d):
    """Each answer's endpoint against its record's: by id, or by route and method; among the first three; route; method."""
    return _endpoint_scores(spark, d).drop("pred")


@query(FLAT + _GOLD + _PARSED + _SCORED + " SELECT model, count(*) AS n, count(*) FILTER (eid <> '') AS named, count(*) FILTER (top1) AS top1, count(*) FILTER (top1 OR (gid <> '' AND list_contains(top3[1:3], gid))) AS top3, count(*) FILTER (r <> '' AND r = groute) AS routes, count(*) FILTER (m = gmethod) AS methods FROM s GROUP BY 1")
def endpoint_rank(spark, d):
    """The scores counted by model."""
    s = _endpoint_scores(spark, d)
    n = {"named": F.col("eid") != "", "top1": F.col("top1"), "top3": F.col("top3"), "routes": F.col("route_ok"), "methods": F.col("method_ok")}
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in n.items()])


_LISTED = " ".join(f"WHEN json_type(j, '$.{k}') = 'ARRAY' AND json_array_length(j, '$.{k}') > 0 THEN true WHEN json_type(j, '$.{k}') = 'VARCHAR' AND json_extract_string(j, '$.{k}') <> '' THEN false" for k in an.TOP3_KEYS)


@query("WITH " + _PARSED.lstrip(", ") + f" SELECT sample_id, model, called_at, eid <> '' AND method <> '' AND route <> '' AS format_ok, coalesce(CASE WHEN j IS NULL THEN false {_LISTED} ELSE false END AND len(top3) BETWEEN 1 AND 3 AND len(list_filter(top3, lambda y: coalesce(y, '') = '')) = 0, false) AS top3_ok FROM a")
def answer_format(spark, d):
    """Whether an answer names endpoint, method and route, and lists one to three endpoints."""
    a = spread(table(spark, d, "model_output").select("sample_id", "model", "called_at", "raw_output"), "called_at").withColumn("a", an.answer(F.col("raw_output")))
    named = (F.col("a.endpoint_id") != "") & (F.col("a.method") != "") & (F.col("a.route") != "")
    return a.select("sample_id", "model", "called_at", named.alias("format_ok"), (F.col("a.listed") & F.size("a.top3").between(1, 3) & F.forall("a.top3", lambda x: x != "")).alias("top3_ok"))


@query()
def answer_params(spark, d):
    """Precision, recall and F1 of the parameters that an answer names against its record's, documented ones before observed ones."""
    gold = _gold_params(last_wins(flat(spark, d).select("sample_id", "ord", *SIDES), ["sample_id"], "ord")).select("sample_id", "gold", "source")
    return _endpoint_scores(spark, d).join(gold, "sample_id").select("sample_id", "model", "called_at", "source", set_prf(F.col("pred"), F.col("gold")).alias("m")).select("sample_id", "model", "called_at", "source", "m.*")


@query()
def param_truth(spark, d):
    """Documented and observed parameter names of each record, which of them count, and how the observed ones score against the documented."""
    g = _gold_params(flat(spark, d).select("ord", *SIDES))
    return g.select("ord", "documented", "observed", "source", set_prf(F.col("observed"), F.col("documented")).alias("m")).select("ord", "documented", "observed", "source", "m.*")


_CODE = rf""", fe AS (SELECT sample_id, model, called_at, raw_output, list_transform(regexp_extract_all(coalesce(raw_output,''), '(?is)```(?:[a-z0-9_+-]*)[ \t]*\r?\n(.*?)```', 1), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')) AS f FROM model_output),
 c AS (SELECT sample_id, model, called_at, CASE WHEN len(f) > 0 THEN list_sort(list_transform(f, lambda y: {{'n': -length(y), 'y': y}}))[1].y ELSE {_TRIM.format('raw_output')} END AS code FROM fe), k AS (SELECT c.*, lower(code) AS low, g.* EXCLUDE (sample_id) FROM c JOIN g USING (sample_id))"""


@query(
    FLAT + _GOLD + _CODE + r""" SELECT sample_id, model, called_at, ghost <> '' AND contains(low, lower(ghost)) AS host_ok, (gurl <> '' AND contains(low, lower(gurl))) OR (groute <> '' AND contains(low, lower(groute))) AS endpoint_ok,
 regexp_matches(code, '(?i)\brequests\.' || gmethod || '\s*\(|\bhttpx\.' || gmethod || '\s*\(|method\s*=\s*["'']' || gmethod || '["'']|["'']' || gmethod || '["'']\s*,') AS method_ok, contains(low, 'x-rapidapi-host') AND (ghost = '' OR contains(low, lower(ghost))) AS header_ok,
 contains(code, '.json()') OR contains(code, '.text') OR contains(code, '.content') OR contains(code, 'status_code') OR contains(code, 'raise_for_status()') AS response_ok,
 regexp_matches(code, '\btry\s*:') OR regexp_matches(code, '\bexcept\b') OR contains(code, 'raise_for_status()') OR contains(code, 'status_code') AS error_ok FROM k"""
)
def answer_checks(spark, d):
    """Host, endpoint, method, header, response and error handling in the code of each answer."""
    g = _gold(spark, d).select("sample_id", F.col("host").alias("ghost"), F.col("url").alias("gurl"), F.col("route").alias("groute"), F.col("method").alias("gmethod"))
    j = table(spark, d, "model_output").select("sample_id", "model", "called_at", tx.fence(F.col("raw_output")).alias("code")).join(g, "sample_id")
    code, host, url, route, method = (F.col(c) for c in ("code", "ghost", "gurl", "groute", "gmethod"))
    return j.select(
        "sample_id", "model", "called_at", an.names_host(code, host).alias("host_ok"), an.names_endpoint(code, url, route).alias("endpoint_ok"), an.uses_method(code, method).alias("method_ok"),
        an.sends_header(code, host).alias("header_ok"), an.handles_response(code).alias("response_ok"), an.handles_errors(code).alias("error_ok"),
    )


@query()
def answer_code(spark, d):
    """The code of each answer against its record: syntax, name, clients, return, keys, parameters, and whether the request is built right and the whole is robust.

    The request that would be sent is read from the syntax tree; nothing is run.
    Without known parameters a request needs none; else their F1 is 0.5 at least.
    """
    g = _gold(spark, d).select("sample_id", F.col("host").alias("ghost"), F.col("url").alias("gurl"), F.col("route").alias("groute"), F.col("method").alias("gmethod"))
    last = last_wins(flat(spark, d).select("sample_id", "ord", "function_name", *SIDES), ["sample_id"], "ord")
    gold = _gold_params(last).select("sample_id", tx.text(F.col("function_name")).alias("gname"), "gold", "source")
    a = spread(table(spark, d, "model_output").select("sample_id", "model", "called_at", "raw_output"), "called_at")
    a = a.select("sample_id", "model", "called_at", tx.fence(F.col("raw_output")).alias("code")).withColumn("f", code_facts(F.col("code"))).withColumn("keys", F.size(suspicious_literals(F.col("code"))))
    j = a.join(g, "sample_id").join(gold, "sample_id").withColumn("m", set_prf(F.col("f.params"), F.col("gold")))
    code, host, url, route, method = (F.col(c) for c in ("code", "ghost", "gurl", "groute", "gmethod"))
    named = an.names_host(code, host) & an.names_endpoint(code, url, route) & an.uses_method(code, method) & an.sends_header(code, host)
    request = named & ((F.col("m.gold_count") == 0) | (F.col("m.f1") >= 0.5))
    sent = F.col("f.url").isNotNull() & an.names_host(F.col("f.url"), host) & an.names_endpoint(F.col("f.url"), url, route) & (F.col("f.method") == method)
    returned = F.col("f.has_return") & code.rlike(r"\.json\(\)|\.text|\.content|return response")
    robust = F.col("f.valid") & (F.size("f.clients") > 0) & (F.col("keys") == 0) & returned & an.handles_errors(code) & F.coalesce(sent, F.lit(False))
    return j.select(
        "sample_id", "model", "called_at", F.col("f.valid").alias("syntax_ok"), ((F.col("gname") != "") & F.array_contains("f.functions", F.col("gname"))).alias("name_ok"), F.col("f.clients").alias("clients"),
        returned.alias("return_ok"), (F.col("keys") == 0).alias("secret_safe"), "source", F.col("m.f1").alias("param_f1"), request.alias("request_ok"), F.coalesce(sent, F.lit(False)).alias("sent_ok"), robust.alias("robust_ok"),
    )


@query()
def codegen_contexts(spark, d):
    """The whole prompt of each record at each context level."""
    f = flat(spark, d)
    g = pr.ground_truth(f).join(_gold_params(f.select("ord", *SIDES)).select("ord", "gold", "source"), "ord")
    named = f.select("ord", tx.text(F.col("api_name")).alias("api_name"), tx.text(F.col("function_name")).alias("function_name"), pr.task_hint(F.col("function_name"), F.col("endpoint_name"), F.lit(None).cast("string")).alias("hint"))
    return pr.codegen_prompts(g.join(named, "ord"))


@query()
def replay_params(spark, d):
    """Name and value to try each parameter of a record's code with, read from the first dict that it is given; nothing is run and no long text is replayed."""
    return spread(flat(spark, d).select("ord", "code"), "ord").select("ord", F.inline(F.map_entries(replay(F.col("code"))))).select("ord", F.col("key").alias("name"), "value")


@query()
def dense_corpus(spark, d):
    """One text to search for each host, method and route, of the first record that has them."""
    f = flat(spark, d)
    host, method, route = tx.text(F.col("api_host")), urls.method(F.col("method")), urls.flat_route(F.col("route"))
    own = f.select("ord", tx.text(F.col("api_name")).alias("api"), host.alias("host"), method.alias("verb"), route.alias("path"), tx.text(F.col("endpoint_name")).alias("ename"), *SIDES)
    first = first_wins(own.where("api <> '' and host <> ''"), [F.col("host"), F.col("verb"), F.col("path")], F.col("ord"))
    names = F.array_join(dense_names(*[F.col(c) for c in ("params", "path_params", "payload", "code_params")]), " ")
    return first.select("ord", "host", "verb", "path", F.concat_ws(" ", "api", "host", "ename", "path", tx.path_tokens(F.col("path")), "verb", names).alias("search_text"))


@query()
def endpoint_parameters(spark, d):
    """Query, path and header parameters of each documented endpoint with an example value."""
    e = endpoints(spark, d)
    return e.select("api_name", "pos", "endpoint_id", param_buckets(F.col("route"), F.col("params")).alias("p")).select("api_name", "pos", "endpoint_id", *[F.map_entries(f"p.{k}").alias(k) for k in ("query", "path", "header")])


@query(FLAT + f"SELECT ord, {_TRIM.format('src')} <> '' AS has_code, {_TRIM.format('params')} <> '' AS has_params, coalesce(cardinality(headers), 0) > 0 AS has_headers, score IS NOT NULL AS has_score FROM flat")
def filled_fields(spark, d):
    """Fields of a record that say something; zero does."""
    return flat(spark, d).select(
        "ord", tx.has_content(F.col("code"), "string").alias("has_code"), tx.has_content(F.col("params"), "string").alias("has_params"), tx.has_content(F.col("headers"), "map").alias("has_headers"),
        tx.has_content(F.col("score"), "double").alias("has_score"),
    )


@query(END + f"SELECT api_name, pos::INT AS pos, coalesce(nullif({_TRIM.format('endpoint_id')}, ''), nullif({_TRIM.format('url')}, ''), nullif({_TRIM.format('route')}, ''), '') AS name FROM ends")
def endpoint_keys(spark, d):
    """What an endpoint goes by: its id, else its address, else its route."""
    return endpoints(spark, d).select("api_name", "pos", first_filled(F.col("endpoint_id"), F.col("url"), F.col("route")).alias("name"))


@query("SELECT api_name, pos::INT AS pos, CASE WHEN g <> '' THEN g WHEN p = '' OR p = 'null' THEN '' WHEN starts_with(p, '{') OR starts_with(p, '[') THEN 'application/json' ELSE 'application/x-www-form-urlencoded' END AS content_type FROM (SELECT api_name, generate_subscripts(endpoints_metadata, 1) - 1 AS pos, unnest(list_transform(endpoints_metadata, lambda e: " + _TRIM.format("e.payload") + ")) AS p, unnest(list_transform(endpoints_metadata, lambda e: " + _TRIM.format("e.content_type") + ")) AS g FROM api_document)")
def content_types(spark, d):
    """The kind of body of each endpoint: the one given, else by its payload."""
    e = table(spark, d, "api_document").select("api_name", F.posexplode("endpoints_metadata").alias("pos", "e"))
    return e.select("api_name", "pos", content_type(F.col("e.payload"), F.col("e.content_type")).alias("content_type"))
