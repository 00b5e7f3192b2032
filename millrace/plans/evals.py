"""Queries over model answers, their scores and probes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators.dedupe import last_wins
from millrace.operators.metrics import bool_mean, pass_at_k as _pass_at_k, set_prf as _set_prf, wilson
from millrace.operators.select import top_per_group
from millrace.plans.records import FLAT, flat
from millrace.plans.registry import query
from millrace.runtime import table
from millrace.streaming.incremental import open_rows


@query("WITH p AS (SELECT sample_id, max(ord) AS ord FROM function_record GROUP BY 1) SELECT m.sample_id, m.model, count(*) AS n, count(*) FILTER (p.ord IS NULL) AS unmatched, max(p.ord) AS last_ord FROM model_output m LEFT JOIN p USING (sample_id) GROUP BY 1, 2")
def eval_left_join(spark, d):
    """Answers with the last record of their id; answers without one stay."""
    p = last_wins(flat(spark, d).select("sample_id", "ord"), ["sample_id"], "ord")
    j = table(spark, d, "model_output").select("sample_id", "model").join(p, "sample_id", "left")
    return j.groupBy("sample_id", "model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ord").isNull()).alias("unmatched"), F.max("ord").alias("last_ord"))


@query("SELECT CASE WHEN grouping(doc_match_type) = 1 THEN 'overall' ELSE coalesce(doc_match_type, 'unknown') END AS grp, count(*) AS n, round(avg(syntax_pass::INT), 6) AS syntax, round(avg(host_acc::INT), 6) AS host, round(avg(endpoint_acc::INT), 6) AS endpoint, round(avg(mock_pass::INT), 6) AS mock, round(avg(param_doc.f1), 6) AS doc_f1, round(avg(param_obs.f1), 6) AS obs_f1 FROM eval_row GROUP BY GROUPING SETS ((), (doc_match_type))")
def eval_rollup(spark, d):
    """Means over all rows and by kind of match, in one pass."""
    e = table(spark, d, "eval_row")
    g = e.groupingSets([[], ["doc_match_type"]], "doc_match_type").agg(
        F.grouping("doc_match_type").alias("g"), F.count(F.lit(1)).alias("n"), *[F.round(bool_mean(F.col(c)), 6).alias(a) for c, a in (("syntax_pass", "syntax"), ("host_acc", "host"), ("endpoint_acc", "endpoint"), ("mock_pass", "mock"))],
        F.round(F.avg("param_doc.f1"), 6).alias("doc_f1"), F.round(F.avg("param_obs.f1"), 6).alias("obs_f1"),
    )
    return g.select(F.when(F.col("g") == 1, "overall").otherwise(F.coalesce("doc_match_type", F.lit("unknown"))).alias("grp"), "n", "syntax", "host", "endpoint", "mock", "doc_f1", "obs_f1")


@query("WITH s AS (SELECT sample_id, count(*) AS n, count(*) FILTER (coalesce(mock_pass,false)) AS c FROM eval_row GROUP BY 1), k AS (SELECT unnest([1, 2, 3]) AS k), e AS (SELECT k, CASE WHEN n >= k THEN 1 - (greatest(0, n - c)::DOUBLE / n) * CASE WHEN k >= 2 THEN greatest(0, n - c - 1)::DOUBLE / (n - 1) ELSE 1 END * CASE WHEN k >= 3 THEN greatest(0, n - c - 2)::DOUBLE / (n - 2) ELSE 1 END END AS p FROM s, k WHERE n >= k) SELECT k::INT AS k, count(p) AS samples, round(avg(p) * 100, 2) AS pass_at_k FROM e GROUP BY k")
def pass_at_k(spark, d):
    return _pass_at_k(table(spark, d, "eval_row"), "sample_id", "mock_pass", [1, 2, 3]).where("samples > 0")


@query("SELECT sample_id, model, CASE WHEN coalesce(param_doc.gold_count, 0) > 0 THEN round(param_doc.f1, 6) WHEN coalesce(param_obs.gold_count, 0) > 0 THEN round(param_obs.f1, 6) END AS active_f1, coalesce(host_acc, false) AND coalesce(endpoint_acc, false) AND coalesce(method_acc, false) AS request_ok, coalesce(error_handling, false) AND coalesce(response_handling, false) AS robust FROM eval_row")
def composite_scores(spark, d):
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    f1 = F.when(F.coalesce("param_doc.gold_count", F.lit(0)) > 0, F.col("param_doc.f1")).when(F.coalesce("param_obs.gold_count", F.lit(0)) > 0, F.col("param_obs.f1"))
    return table(spark, d, "eval_row").select("sample_id", "model", F.round(f1, 6).alias("active_f1"), (yes("host_acc") & yes("endpoint_acc") & yes("method_acc")).alias("request_ok"), (yes("error_handling") & yes("response_handling")).alias("robust"))


@query("SELECT context, model, count(*) AS n, count(DISTINCT sample_id) AS samples, round(avg(param_doc.precision), 6) AS p, round(avg(param_doc.recall), 6) AS r FROM eval_row GROUP BY 1, 2")
def context_table(spark, d):
    return table(spark, d, "eval_row").groupBy("context", "model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("samples"), F.round(F.avg("param_doc.precision"), 6).alias("p"), F.round(F.avg("param_doc.recall"), 6).alias("r"))


_CLASS = "CASE WHEN error_type IS NOT NULL OR status_code IS NULL THEN 'network_failure' WHEN status_code = 429 THEN 'rate_limit' WHEN status_code IN (401, 403) THEN 'authentication' WHEN status_code >= 500 THEN 'service_unavailable' WHEN status_code BETWEEN 200 AND 299 THEN 'success_2xx' WHEN status_code = 402 THEN 'quota_or_payment' ELSE 'reachable_non_2xx' END"


def outcome(status, error):
    s = status
    return (
        F.when(error.isNotNull() | s.isNull(), "network_failure").when(s == 429, "rate_limit").when(s.isin(401, 403), "authentication").when(s >= 500, "service_unavailable")
        .when(s.between(200, 299), "success_2xx").when(s == 402, "quota_or_payment").otherwise("reachable_non_2xx")
    )


@query(f"SELECT {_CLASS} AS kind, count(*) AS n FROM probe GROUP BY 1")
def status_outcome(spark, d):
    return table(spark, d, "probe").groupBy(outcome(F.col("status_code"), F.col("error_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT method, count(*) AS n, count(*) FILTER (k = 'success_2xx') AS good, count(*) FILTER (received_http_response) AS answered, round(count(*) FILTER (k = 'success_2xx')::DOUBLE / nullif(count(*) FILTER (received_http_response), 0), 6) AS rate, count(*) FILTER (k IN ('network_failure','rate_limit','quota_or_payment','authentication','service_unavailable')) AS outside FROM (SELECT *, {_CLASS} AS k FROM probe) GROUP BY 1")
def probe_summary(spark, d):
    p = table(spark, d, "probe").withColumn("k", outcome(F.col("status_code"), F.col("error_type")))
    good, answered = F.count_if(F.col("k") == "success_2xx"), F.count_if("received_http_response")
    return p.groupBy("method").agg(F.count(F.lit(1)).alias("n"), good.alias("good"), answered.alias("answered"), F.round(F.try_divide(good, answered), 6).alias("rate"),
                                   F.count_if(F.col("k").isin("network_failure", "rate_limit", "quota_or_payment", "authentication", "service_unavailable")).alias("outside"))


_Z = 1.959963984540054


@query(f"WITH s AS (SELECT api_name, count(*)::DOUBLE AS n, count(*) FILTER ({_CLASS} = 'success_2xx')::DOUBLE AS c FROM probe GROUP BY 1) SELECT api_name, round((c/n + {_Z}*{_Z}/(2*n) - {_Z}*sqrt(c/n*(1-c/n)/n + {_Z}*{_Z}/(4*n*n)))/(1+{_Z}*{_Z}/n), 6) AS low, round((c/n + {_Z}*{_Z}/(2*n) + {_Z}*sqrt(c/n*(1-c/n)/n + {_Z}*{_Z}/(4*n*n)))/(1+{_Z}*{_Z}/n), 6) AS high FROM s")
def wilson_ci(spark, d):
    p = table(spark, d, "probe").withColumn("good", outcome(F.col("status_code"), F.col("error_type")) == "success_2xx")
    g = p.groupBy("api_name").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("good").cast("double").alias("c"))
    low, high = wilson(F.col("c"), F.col("n"))
    return g.select("api_name", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"WITH s AS (SELECT api_name, avg(({_CLASS} = 'success_2xx')::INT) AS r FROM probe GROUP BY 1) SELECT count(*) AS apis, round(avg(r), 6) AS macro FROM s")
def macro_rate(spark, d):
    p = table(spark, d, "probe").withColumn("good", outcome(F.col("status_code"), F.col("error_type")) == "success_2xx")
    return p.groupBy("api_name").agg(bool_mean(F.col("good")).alias("r")).agg(F.count(F.lit(1)).alias("apis"), F.round(F.avg("r"), 6).alias("macro"))


@query()
def cluster_bootstrap(spark, d):
    """Interval of the macro rate: APIs drawn anew by Poisson weights that a hash of draw and name gives, in one aggregate."""
    draws = 500
    p = table(spark, d, "probe").withColumn("good", outcome(F.col("status_code"), F.col("error_type")) == "success_2xx")
    r = p.groupBy("api_name").agg(bool_mean(F.col("good")).alias("r"))
    each = r.select("r", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b"), "api_name")
    u = F.pmod(F.xxhash64("b", "api_name"), F.lit(1_000_003)) / 1_000_003.0
    weight = F.lit(0)
    total, term = 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        term /= k + 1
        weight = weight + (u >= total).cast("int")
    m = each.groupBy("b").agg((F.sum(weight * F.col("r")) / F.sum(weight)).alias("m"))
    return m.agg(F.round(F.percentile("m", 0.025), 4).alias("low"), F.round(F.percentile("m", 0.975), 4).alias("high"), F.count("m").alias("draws"))


@query(r"SELECT sample_id, model, called_at, CASE WHEN raw_output IS NULL THEN '' WHEN len(f) > 0 THEN list_sort(list_transform(f, lambda y: {'n': -length(y), 'y': y}))[1].y ELSE regexp_replace(raw_output, '^\s+|\s+$', '', 'g') END AS fenced FROM (SELECT *, list_transform(regexp_extract_all(raw_output, '(?is)```(?:[a-z0-9_+-]*)[ \t]*\r?\n(.*?)```', 1), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')) AS f FROM model_output)")
def code_fence(spark, d):
    """Longest fenced block of each answer."""
    return table(spark, d, "model_output").select("sample_id", "model", "called_at", tx.fence(F.col("raw_output")).alias("fenced"))


@query(r"SELECT sample_id, model, called_at, regexp_extract(coalesce(raw_output,''), '(apiendpoint_[A-Za-z0-9_\-]+)', 1) AS endpoint_id, len(regexp_extract_all(coalesce(raw_output,''), '(?i)\b(GET|POST|PUT|DELETE|PATCH)\b', 1))::INT AS methods FROM model_output")
def endpoint_answer(spark, d):
    """Endpoint ids and methods that an answer names, when it is no JSON."""
    r = F.coalesce("raw_output", F.lit(""))
    return table(spark, d, "model_output").select("sample_id", "model", "called_at", F.regexp_extract(r, r"(apiendpoint_[A-Za-z0-9_\-]+)", 1).alias("endpoint_id"), F.size(F.regexp_extract_all(r, F.lit(r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\b"), F.lit(1))).alias("methods"))


@query("SELECT DISTINCT sample_id FROM function_record f WHERE NOT EXISTS (SELECT 1 FROM model_output m WHERE m.sample_id = f.sample_id AND m.ok)")
def resume_anti_join(spark, d):
    """Prompts still to be answered."""
    return open_rows(flat(spark, d).select("sample_id").distinct(), table(spark, d, "model_output").where("ok"), ["sample_id"])


@query(FLAT + "SELECT ord FROM flat WHERE sample_id IN (SELECT sample_id FROM eval_row) AND api_host IN (SELECT host FROM probe)")
def semi_join_selected(spark, d):
    f = flat(spark, d).select("ord", "sample_id", "api_host")
    return f.join(table(spark, d, "eval_row").select("sample_id"), "sample_id", "left_semi").join(table(spark, d, "probe").select(F.col("host").alias("api_host")), "api_host", "left_semi").select("ord")


@query(FLAT + ", t AS (SELECT ord, list_distinct(regexp_extract_all(lower(coalesce(function_name,'')), '[a-z0-9]+')) AS p, list_distinct(regexp_extract_all(lower(coalesce(endpoint_name,'')), '[a-z0-9]+')) AS g FROM flat) SELECT ord, len(list_intersect(p, g))::INT AS tp, CASE WHEN len(g) > 0 THEN CASE WHEN len(p) = 0 THEN 0.0 ELSE round(len(list_intersect(p, g))::DOUBLE / len(p), 6) END END AS precision, CASE WHEN len(g) > 0 THEN round(len(list_intersect(p, g))::DOUBLE / len(g), 6) END AS recall FROM t")
def set_prf(spark, d):
    """Words of function names against words of the endpoint's name."""
    w = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))
    m = _set_prf(w(F.col("function_name")), w(F.col("endpoint_name")))
    return flat(spark, d).select("ord", m.alias("m")).select("ord", F.col("m.true_positive").alias("tp"), F.round("m.precision", 6).alias("precision"), F.round("m.recall", 6).alias("recall"))


@query("SELECT host, min_by(sample_id, k) AS sample_id, count(*) AS n FROM (SELECT *, coalesce(sample_id,'') || coalesce(url,'') AS k FROM probe) GROUP BY host")
def host_distinct(spark, d):
    p = table(spark, d, "probe").withColumn("k", F.concat(F.coalesce("sample_id", F.lit("")), F.coalesce("url", F.lit(""))))
    return p.groupBy("host").agg(F.min_by("sample_id", "k").alias("sample_id"), F.count(F.lit(1)).alias("n"))


@query(FLAT + ", p AS (SELECT lower(host) AS h, max(status_code) AS worst, count(*) AS probes FROM probe GROUP BY 1) SELECT f.ord, p.worst, p.probes FROM flat f JOIN p ON lower(f.api_host) = p.h")
def host_join(spark, d):
    p = table(spark, d, "probe").groupBy(F.lower("host").alias("h")).agg(F.max("status_code").alias("worst"), F.count(F.lit(1)).alias("probes"))
    return flat(spark, d).select("ord", F.lower("api_host").alias("h")).join(p, "h").select("ord", "worst", "probes")


@query("SELECT model, sample_id, called_at, elapsed_sec, row_number() OVER (PARTITION BY model ORDER BY elapsed_sec DESC NULLS LAST, sample_id, called_at)::INT AS place, round(elapsed_sec - lag(elapsed_sec) OVER (PARTITION BY model ORDER BY elapsed_sec DESC NULLS LAST, sample_id, called_at), 6) AS step FROM model_output QUALIFY row_number() OVER (PARTITION BY model ORDER BY elapsed_sec DESC NULLS LAST, sample_id, called_at) <= 10")
def slowest_answers(spark, d):
    """Ten slowest answers of each model and their distance."""
    order = [F.col("elapsed_sec").desc_nulls_last(), F.col("sample_id").asc(), F.col("called_at").asc()]
    m = table(spark, d, "model_output").select("model", "sample_id", "called_at", "elapsed_sec")
    top = top_per_group(m, ["model"], order, 10, "place")  # few rows a model before the second window
    return top.withColumn("step", F.round(F.col("elapsed_sec") - F.lag("elapsed_sec").over(Window.partitionBy("model").orderBy("place")), 6))
