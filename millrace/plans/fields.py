"""Queries over single fields: filters, defaults, ordered rules and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import fields as fl
from millrace.functions import urls
from millrace.operators import prompts as pr
from millrace.operators.select import top_per_group
from millrace.plans.apis import _METHOD, _TRIM, END, _route_sql, endpoints
from millrace.plans.records import FLAT, flat, heavy
from millrace.plans.registry import query
from millrace.runtime import table

_KIND = "CASE WHEN x = '' THEN 'none' WHEN x = 'null' THEN 'null' WHEN starts_with(x, '{') THEN 'object' WHEN starts_with(x, '[') THEN 'list' WHEN starts_with(x, chr(34)) THEN 'text' WHEN regexp_matches(x, '^-?[0-9.]+$') THEN 'number' ELSE 'bare' END"


@query(FLAT + f", k AS (SELECT {_TRIM.format('params')} AS x FROM flat) SELECT {_KIND} AS kind, count(*) AS n FROM k GROUP BY 1")
def param_kinds(spark, d):
    """Shapes of the documented parameters."""
    return flat(spark, d).groupBy(fl.json_kind(F.col("params")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(FLAT + r"SELECT ord FROM flat WHERE regexp_matches(lower(trim(coalesce(path,''))), '[.]py$') AND NOT regexp_matches(lower(coalesce(repo,'')), '(toolbench|toolllm|awesome)') AND coalesce(api_host,'') <> '' AND contains(src, api_host)")
def crawl_filters(spark, d):
    """Python files outside listed repositories whose code names the host; cheap tests stand before the search in the text."""
    f = flat(spark, d).where(F.lower(F.trim(F.coalesce("path", F.lit("")))).endswith(".py") & ~F.lower(F.coalesce("repo", F.lit(""))).rlike("(toolbench|toolllm|awesome)"))
    return f.where((F.coalesce("api_host", F.lit("")) != "") & F.contains("code", F.col("api_host"))).select("ord")


@query(FLAT + "SELECT coalesce(layer,'none') AS layer, CASE WHEN layer IN ('endpoint_url_match','endpoint_route_host_match') THEN 15 WHEN layer IN ('keyword_match','keyword_requests_match') THEN 15 ELSE 50 END AS most, count(*) AS n FROM flat GROUP BY 1, 2")
def layer_limits(spark, d):
    return flat(spark, d).groupBy(F.coalesce("layer", F.lit("none")).alias("layer"), fl.layer_limit(F.col("layer")).alias("most")).agg(F.count(F.lit(1)).alias("n"))


@query(FLAT + f"SELECT ord, CASE WHEN {_TRIM.format('route')} <> '' THEN {_TRIM.format('route')} ELSE regexp_extract(coalesce(url,''), '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS full_route, {_METHOD} AS full_method, coalesce(match, 'none') AS full_match FROM flat")
def enrich_metadata(spark, d):
    """Defaults where a record's documentation fields are missing."""
    return flat(spark, d).select("ord", fl.first_filled(F.col("route"), urls.url_path(F.col("url"))).alias("full_route"), urls.method(F.col("method")).alias("full_method"), F.coalesce("match", F.lit("none")).alias("full_match"))


@query(FLAT + f", g AS (SELECT ord, {_TRIM.format('api_host')} AS host, {_METHOD} AS method, {_route_sql('route')} AS route FROM flat) SELECT ord, 'Write a Python function that calls the API.' || chr(10) || 'Host: ' || host || chr(10) || 'Endpoint: ' || method || ' ' || route AS prompt FROM g")
def codegen_prompts(spark, d):
    g = pr.ground_truth(flat(spark, d))
    return g.select("ord", F.concat(F.lit("Write a Python function that calls the API.\nHost: "), "host", F.lit("\nEndpoint: "), "method", F.lit(" "), "route").alias("prompt"))


@query(FLAT + f"SELECT ord, {_TRIM.format('api_host')} AS host, {_TRIM.format('url')} AS url, {_METHOD} AS method, {_route_sql('route')} AS route, coalesce(endpoint_id,'') AS endpoint_id, coalesce(match,'none') AS match FROM flat")
def ground_truth(spark, d):
    return pr.ground_truth(flat(spark, d)).select("ord", "host", "url", "method", "route", "endpoint_id", "match")


@query("WITH k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(coalesce(code.complete_function,''), '(?m)^\\s*[\"'']([a-z][a-z0-9_]*)[\"'']\\s*:', 1))) AS name FROM function_record) SELECT name, CASE " + " ".join(f"WHEN name = '{a}' THEN '{b}'" for a, b in fl.SAFE_NAMES.items()) + " " + " ".join(f"WHEN contains(name, '{a}') THEN '{b}'" for a, b in fl.SAFE_VALUES) + " ELSE 'test' END AS value FROM k")
def safe_values(spark, d):
    """A value to try each parameter of the code with."""
    k = heavy(spark, d, "code").select(F.explode(F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(r"(?m)^\s*[\"']([a-z][a-z0-9_]*)[\"']\s*:"), F.lit(1))).alias("name")).distinct()
    return k.select("name", fl.safe_value(F.col("name")).alias("value"))


@query(FLAT + r"SELECT ord, regexp_extract(src, '(?s)\bheaders\s*=\s*\{([^{}]*)\}', 1) AS headers_text, length(regexp_extract(src, '(?s)\bparams\s*=\s*\{([^{}]*)\}', 1))::INT AS params_chars FROM flat")
def code_literals(spark, d):
    f = heavy(spark, d, "code")
    return f.select("ord", fl.literal_block(F.col("code"), "headers").alias("headers_text"), F.length(fl.literal_block(F.col("code"), "params")).alias("params_chars"))


@query(END + "SELECT api_name, count(*) AS endpoints, count(*) FILTER (upper(method) IN ('GET','POST','PUT','PATCH','DELETE','HEAD','OPTIONS')) AS known, count(*) FILTER (length(coalesce(route,'')) >= 4) AS routed FROM ends GROUP BY 1")
def method_whitelist(spark, d):
    e = endpoints(spark, d)
    return e.groupBy("api_name").agg(F.count(F.lit(1)).alias("endpoints"), F.count_if(F.upper("method").isin(*fl.METHODS)).alias("known"), F.count_if(F.length(F.coalesce("route", F.lit(""))) >= 4).alias("routed"))


@query(FLAT + ", r AS (SELECT coalesce(language,'') AS lang, ord, stars, row_number() OVER (PARTITION BY coalesce(language,'') ORDER BY coalesce(stars,0) DESC, ord) AS place FROM flat) SELECT lang, ord, place::INT AS place FROM r WHERE place <= 50")
def popular_order(spark, d):
    """Search results by fame, earlier ones first among equals."""
    f = flat(spark, d).select(F.coalesce("language", F.lit("")).alias("lang"), "ord", "stars")
    return top_per_group(f, ["lang"], [F.coalesce("stars", F.lit(0)).desc(), F.col("ord").asc()], 50, "place").select("lang", "ord", "place")


@query(r"WITH j AS (SELECT sample_id, model, called_at, regexp_replace(coalesce(raw_output,''), '^\s+|\s+$', '', 'g') AS x FROM model_output) SELECT sample_id, model, called_at, CASE WHEN starts_with(x, '{') AND json_valid(x) THEN 'json' WHEN contains(x, '```') THEN 'fenced' WHEN x = '' THEN 'empty' ELSE 'text' END AS shape, coalesce(CASE WHEN starts_with(x, '{') AND json_valid(x) THEN json_extract_string(x, '$.endpoint_id') END, '') AS named FROM j")
def answer_shapes(spark, d):
    """What kind of text an answer is, and the endpoint that a JSON answer names."""
    x = F.regexp_replace(F.coalesce("raw_output", F.lit("")), r"(?U)^\s+|\s+$", "")
    v = F.try_parse_json(F.when(x.startswith("{"), x))
    shape = F.when(v.isNotNull(), "json").when(F.contains(x, F.lit("```")), "fenced").when(x == "", "empty").otherwise("text")
    return table(spark, d, "model_output").select("sample_id", "model", "called_at", shape.alias("shape"), F.coalesce(F.try_variant_get(v, "$.endpoint_id", "string"), F.lit("")).alias("named"))


@query(FLAT + r"SELECT comments_source, count(*) AS n, count(*) FILTER (regexp_matches(coalesce(comments,''), '^\s*\[')) AS listed, max(length(comments)) AS longest FROM flat GROUP BY 1")
def comment_sources(spark, d):
    c = F.coalesce("comments", F.lit(""))
    return flat(spark, d).groupBy("comments_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(c.rlike(r"^\s*\[")).alias("listed"), F.max(F.char_length("comments")).cast("bigint").alias("longest"))
