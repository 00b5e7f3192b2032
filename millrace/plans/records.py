"""Queries over code records: duplicates, gates, scores, selection and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.code import LINE_RULES, NO_COMMENT, annotated, code_facts, extract_functions, line_comment
from millrace.functions.jsonvals import param_used
from millrace.functions.urls import url_path
from millrace.operators import quality as ql
from millrace.operators.dedupe import duplicate_count, first_wins, greedy_near, numbered
from millrace.operators.select import early_stop, hash_split, select_balanced, top_per_group, two_level_top
from millrace.plans.registry import query
from millrace.runtime import spread, table


# The record's fields that hold JSON text, of its API metadata.
SIDES = ("params", "path_params", "header_params", "payload", "code_params")


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "function_record")


def flat(spark: SparkSession, d: str) -> DataFrame:
    """The record's fields under one name each; the scan reads only those a query uses."""
    q = "quality_metrics.completeness_checks."
    return records(spark, d).select(
        "ord", "sample_id", "api_name", "api_host", "function_name", "language", "source_machine", "comments_source", "comments",
        F.col("github_info.repo").alias("repo"), F.col("github_info.file_path").alias("path"), F.col("github_info.stars").alias("stars"),
        F.col("github_info.query_layer").alias("layer"), F.col("code.complete_function").alias("code"), F.col("code.has_comments").alias("has_comments"),
        F.col("code.has_docstring").alias("has_docstring"), F.col("code.comment_lines").alias("n_comments"), F.col("api_metadata.url").alias("url"),
        F.col("api_metadata.route").alias("route"), F.col("api_metadata.method").alias("method"), F.col("api_metadata.endpoint_id").alias("endpoint_id"),
        F.col("api_metadata.endpoint_name").alias("endpoint_name"), F.col("api_metadata.doc_match_type").alias("match"), F.col("api_metadata.headers").alias("headers"),
        F.col("api_metadata.params").alias("params"), F.col("api_metadata.payload").alias("payload"), F.col("api_metadata.path_params").alias("path_params"), F.col("api_metadata.header_params").alias("header_params"), F.col("api_metadata.params_source").alias("params_source"), F.col("api_metadata.code_params").alias("code_params"),
        F.col("quality_metrics.code_quality_score").alias("score"), F.col(q + "is_syntactically_valid").alias("valid"), F.col(q + "has_api_call").alias("has_call"),
        F.col(q + "has_response_handling").alias("has_response"), F.col(q + "has_error_handling").alias("has_error"), F.col(q + "has_imports").alias("has_imports"),
        F.col(q + "has_database_call").alias("has_db"), F.col(q + "has_indentation_issue").alias("bad_indent"),
    )


def heavy(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Some of the fields, over all cores, for work that costs more than moving them."""
    return spread(flat(spark, d).select("ord", *cols), "ord")


# The flat view in SQL.
FLAT = """WITH flat AS (SELECT ord, sample_id, api_name, api_host, function_name, language, source_machine, comments_source, comments, github_info.repo AS repo,
 github_info.file_path AS path, github_info.stars AS stars, github_info.query_layer AS layer, code.complete_function AS src, code.has_comments AS has_comments,
 code.has_docstring AS has_docstring, code.comment_lines AS n_comments, api_metadata.url AS url, api_metadata.route AS route, api_metadata.method AS method,
 api_metadata.endpoint_id AS endpoint_id, api_metadata.endpoint_name AS endpoint_name, api_metadata.doc_match_type AS match, api_metadata.headers AS headers, api_metadata.params AS params, api_metadata.code_params AS code_params,
 quality_metrics.code_quality_score AS score, quality_metrics.completeness_checks.is_syntactically_valid AS valid, quality_metrics.completeness_checks.has_api_call AS has_call,
 quality_metrics.completeness_checks.has_response_handling AS has_response, quality_metrics.completeness_checks.has_error_handling AS has_error,
 quality_metrics.completeness_checks.has_imports AS has_imports, quality_metrics.completeness_checks.has_database_call AS has_db,
 quality_metrics.completeness_checks.has_indentation_issue AS bad_indent FROM function_record)
"""
_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(src, '^\s+|\s+$', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t\f\v]+\n', chr(10), 'g')"""
_KEY = f"coalesce(api_host,''), coalesce(repo,''), coalesce(path,''), coalesce(function_name,''), sha1({_NORMAL})"


def _key():
    return [F.coalesce(F.col(c), F.lit("")) for c in ("api_host", "repo", "path", "function_name")] + [tx.code_hash(F.col("code"))]


@query(FLAT + f"SELECT min(ord) AS ord, count(*) AS copies FROM flat GROUP BY {_KEY}")
def dedupe_first_wins(spark, d):
    """First record of each host, repository, path, function and normalised code."""
    df = heavy(spark, d, "api_host", "repo", "path", "function_name", "code")
    return df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(_key())]).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("copies")).select("ord", "copies")


@query(FLAT + "SELECT min(ord) AS ord FROM flat GROUP BY api_name, repo, path, function_name, src")
def dedupe_exact_code(spark, d):
    df = flat(spark, d).select("ord", "api_name", "repo", "path", "function_name", "code")
    return first_wins(df, [F.col(c) for c in ("api_name", "repo", "path", "function_name", "code")], F.col("ord")).select("ord")


@query(FLAT + f"SELECT count(*) AS total, count(DISTINCT k) AS kept, count(*) - count(DISTINCT k) AS duplicates FROM (SELECT concat_ws('|', {_KEY}) AS k FROM flat)")
def dedupe_dup_count(spark, d):
    df = heavy(spark, d, "api_host", "repo", "path", "function_name", "code").select(F.concat_ws("|", *_key()).alias("k"))
    return duplicate_count(df, [F.col("k")])


_REASON = """CASE WHEN coalesce(score, 0) < {least} THEN 'score_below_threshold' WHEN NOT coalesce(valid, false) THEN 'invalid_syntax' WHEN NOT coalesce(has_call, false) THEN 'no_api_call'
 WHEN coalesce(has_db, false) THEN 'database_call' WHEN coalesce(bad_indent, false) THEN 'indentation_issue'
 WHEN trim(coalesce(api_host,'')) <> '' AND NOT contains(src, trim(api_host)) THEN 'host_not_in_code' ELSE 'ok' END"""


def _gated(spark, d, least):
    df = flat(spark, d)
    reason = ql.gate_reason(least, score=F.col("score"), valid=F.col("valid"), call=F.col("has_call"), database=F.col("has_db"), indentation=F.col("bad_indent"), code=F.col("code"), host=F.col("api_host"))
    return df.withColumn("reason", reason)


@query(FLAT + f"SELECT {_REASON.format(least=70)} AS reason, count(*) AS n FROM flat GROUP BY 1")
def quality_reasons(spark, d):
    """Records by the first test they fail."""
    return _gated(spark, d, F.lit(70)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(FLAT + f"SELECT ord FROM flat WHERE {_REASON.format(least=70)} = 'ok'")
def quality_kept(spark, d):
    return _gated(spark, d, F.lit(70)).where("reason = 'ok'").select("ord")


@query(
    FLAT + f", g AS (SELECT ord, score, {_REASON.format(least=0)} AS reason FROM flat), n AS (SELECT count(*) AS n FROM g WHERE reason = 'ok' AND score >= 85) "
    "SELECT ord FROM g, n WHERE reason = 'ok' AND score >= CASE WHEN n < 100000 THEN 60 ELSE 85 END"
)
def adaptive_threshold(spark, d):
    """The stricter threshold where enough records pass it, else the milder one."""
    df = _gated(spark, d, F.lit(0)).withColumn("passes", F.col("reason") == "ok").select("ord", "score", "passes")
    return ql.adaptive_threshold(df, "passes", "score", 100_000, 85.0, 60.0).select("ord")


_AUTO = " OR ".join(f"contains(lower(x), '{t.lower()}')" for t in ql.AUTO_TOKENS)


@query(FLAT + f"SELECT ord FROM (SELECT ord, src AS x FROM flat UNION ALL SELECT ord, repo AS x FROM flat) WHERE {_AUTO} GROUP BY ord")
def auto_generated(spark, d):
    df = heavy(spark, d, "code", "repo")
    return df.where(ql.auto_generated(F.col("code"), F.col("repo"))).select("ord")


@query(FLAT + r"SELECT ord FROM flat WHERE regexp_matches(src, '\b(var|temp|result|param)\d{2,}\b')")
def auto_generated_names(spark, d):
    """Numbered variable names, the evident intent behind the literal patterns."""
    return flat(spark, d).where(F.col("code").rlike(rf"\b(?:{'|'.join(ql.AUTO_NAMES)})\d{{2,}}\b")).select("ord")


@query(
    FLAT + r"""SELECT ord, regexp_matches(src, '(?m)^\s*import\s+|^\s*from\s+') AS has_imports,
 contains(src,'requests.') OR contains(src,'urllib.') OR contains(src,'httpx.') OR contains(src,'http.client') AS has_api_call,
 contains(src,'.json()') OR contains(src,'.text') OR contains(src,'.content') OR contains(src,'response.status_code') OR contains(src,'response[') AS has_response_handling,
 contains(src,'try:') AND contains(src,'except') AS has_error_handling,
 contains(src,'mysql') OR contains(src,'sqlite') OR contains(src,'cursor.') OR contains(src,'.execute(') OR contains(src,'psycopg2') OR contains(src,'pymongo') AS has_database_call,
 regexp_matches(src, '(?m)^[ \t]+def ') AS has_indentation_issue,
 len(list_filter(string_split(src, chr(10)), lambda x: starts_with(trim(x), '#') AND NOT starts_with(trim(x), '#!')))::INT AS comment_lines FROM flat"""
)
def code_checks(spark, d):
    df = heavy(spark, d, "code")
    return df.select("ord", *[v.alias(k) for k, v in ql.checks(F.col("code")).items()])


@query(
    FLAT + """SELECT ord, round(greatest(0, least(100, CASE WHEN coalesce(valid,false) THEN 30 ELSE 0 END + CASE WHEN coalesce(has_call,false) THEN 25 ELSE 0 END
 + CASE WHEN coalesce(has_response,false) THEN 20 ELSE 0 END + CASE WHEN coalesce(has_error,false) THEN 10 ELSE 0 END
 + CASE WHEN loc < 10 THEN 0 WHEN loc <= 30 THEN 5 WHEN loc <= 50 THEN 10 ELSE 8 END
 + CASE WHEN coalesce(stars,0) >= 100 THEN 5 WHEN coalesce(stars,0) >= 10 THEN 3 WHEN coalesce(stars,0) >= 1 THEN 1.5 ELSE 0 END
 + least(15, least(15, 2 * coalesce(n_comments,0)) + CASE WHEN coalesce(has_docstring,false) THEN 10 ELSE 0 END)
 - CASE WHEN coalesce(has_db,false) THEN 30 ELSE 0 END - CASE WHEN coalesce(bad_indent,false) THEN 20 ELSE 0 END - CASE WHEN coalesce(has_imports,false) THEN 0 ELSE 10 END)), 2)::DOUBLE AS computed
 FROM (SELECT *, len(string_split(src, chr(10))) AS loc FROM flat)"""
)
def quality_score(spark, d):
    df = flat(spark, d)
    s = ql.quality_score(
        valid=F.col("valid"), call=F.col("has_call"), response=F.col("has_response"), error=F.col("has_error"), loc=ql.line_count(F.col("code")), stars=F.col("stars"),
        n_comments=F.col("n_comments"), docstring=F.col("has_docstring"), imports=F.col("has_imports"), database=F.col("has_db"), indentation=F.col("bad_indent"),
    )
    return df.select("ord", F.round(s, 2).alias("computed"))


_OWN_ROUTE = "coalesce(nullif(route,''), regexp_extract(coalesce(url,''), '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
_OWN_HOST = "coalesce(nullif(api_host,''), nullif(headers['x-rapidapi-host'],''), headers['X-RapidAPI-Host'], '')"
_MATCH = f"""CASE WHEN match IN ('url','route','host_only','none') THEN match WHEN coalesce(url,'') <> '' AND contains(src, url) THEN 'url'
 WHEN {_OWN_ROUTE} NOT IN ('', '/') AND contains(src, {_OWN_ROUTE}) THEN 'route' WHEN {_OWN_HOST} <> '' AND contains(src, {_OWN_HOST}) THEN 'host_only' ELSE 'none' END"""


def _matched(spark, d):
    df = flat(spark, d)
    return df.withColumn("kind", ql.match_type(F.col("match"), F.col("code"), F.col("url"), F.col("route"), F.col("api_host"), F.col("headers")))


@query(FLAT + f"SELECT ord, {_MATCH} AS kind FROM flat")
def match_type_case(spark, d):
    return _matched(spark, d).select("ord", "kind")


_RANK = "CASE kind WHEN 'url' THEN 3 WHEN 'route' THEN 2 WHEN 'host_only' THEN 1 ELSE 0 END DESC, coalesce(score,0) DESC, coalesce(has_comments,false)::INT DESC, coalesce(has_docstring,false)::INT DESC, coalesce(n_comments,0) DESC, coalesce(stars,0) DESC, ord"


def _ranked(spark, d):
    p = F.when(F.col("kind") == "url", 3).when(F.col("kind") == "route", 2).when(F.col("kind") == "host_only", 1).otherwise(0)
    zero, no = (lambda c: F.coalesce(F.col(c), F.lit(0))), (lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int"))
    order = [p.desc(), zero("score").desc(), no("has_comments").desc(), no("has_docstring").desc(), zero("n_comments").desc(), zero("stars").desc(), F.col("ord").asc()]
    return _matched(spark, d), order


@query(FLAT + f", m AS (SELECT *, {_MATCH} AS kind FROM flat), r AS (SELECT ord, repo, row_number() OVER (PARTITION BY repo ORDER BY {_RANK}) AS rank FROM m) SELECT ord, repo, rank::INT AS rank FROM r WHERE rank <= 5")
def rank_top_per_group(spark, d):
    """Five best records of each repository."""
    df, order = _ranked(spark, d)
    return top_per_group(df, ["repo"], order, 5).select("ord", "repo", "rank")


@query(
    FLAT + """, s AS (SELECT api_host, repo, min(ord) AS seen FROM flat GROUP BY 1, 2), t AS (SELECT f.ord, f.api_host, f.repo, row_number() OVER (PARTITION BY f.api_host, f.repo ORDER BY coalesce(f.score,0) DESC, f.ord) AS rn FROM flat f
 WHERE f.api_host IS NOT NULL AND f.repo IS NOT NULL), u AS (SELECT t.ord, t.api_host, row_number() OVER (PARTITION BY t.api_host ORDER BY s.seen, t.repo, t.rn) AS place FROM t JOIN s ON t.api_host = s.api_host AND t.repo = s.repo WHERE t.rn <= 5)
 SELECT ord, api_host, place::INT AS place FROM u WHERE place <= 20"""
)
def two_level_topk(spark, d):
    df = flat(spark, d).where("api_host is not null and repo is not null").select("ord", "api_host", "repo", "score")
    return two_level_top(df, "api_host", "repo", [F.coalesce("score", F.lit(0.0)).desc(), F.col("ord").asc()], "ord", 5, 20).select("ord", "api_host", "place")


@query()
def select_balanced_caps(spark, d):
    """Greedy selection, best first, under a cap per API and one per repository, with back-fill by new keys; compared with a sequential walk in the tests."""
    df, _ = _ranked(spark, d)
    zero, no = (lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")), (lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double"))
    place = F.when(F.col("kind") == "url", 3.0).when(F.col("kind") == "route", 2.0).when(F.col("kind") == "host_only", 1.0).otherwise(0.0)
    order = [place, zero("score"), no("has_comments"), no("has_docstring"), zero("n_comments"), zero("stars")]
    key = F.concat_ws("\x01", *[F.coalesce(c, F.lit("")) for c in ("api_host", "repo", "path", "function_name")], tx.code_hash(F.col("code")))
    df = df.select(
        "ord", F.coalesce("api_name", F.lit("")).alias("api_name"), F.coalesce("repo", F.lit("")).alias("repo"), key.alias("key"),
        F.struct(*[(-c).alias(f"s{i}") for i, c in enumerate(order)], F.col("ord").alias("o")).alias("rk"),
    )
    return select_balanced(df, "ord", "rk", [("api_name", 30), ("repo", 120)], 12_000, key="key")


@query(FLAT + ", n AS (SELECT layer, api_name, count(*) AS gain FROM flat WHERE layer IS NOT NULL AND api_name IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(gain) OVER (PARTITION BY api_name ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM n) SELECT api_name, layer, gain, before FROM b WHERE before < 5")
def early_stop_layers(spark, d):
    """Query layers that are still asked once the earlier ones found enough."""
    df = flat(spark, d).where("layer is not null and api_name is not null").groupBy("layer", "api_name").agg(F.count(F.lit(1)).alias("gain"))
    return early_stop(df, "api_name", "layer", "gain", 5).select("api_name", "layer", "gain", "before")


@query(FLAT + ", g AS (SELECT DISTINCT api_name AS g FROM flat WHERE coalesce(api_name,'') <> ''), p AS (SELECT g, row_number() OVER (ORDER BY sha1('20260607:' || g), g) AS i, count(*) OVER () AS t FROM g) SELECT g AS api_name, CASE WHEN i <= floor(t * 0.7) THEN 'train' WHEN i <= floor(t * 0.7) + floor(t * 0.1) THEN 'dev' ELSE 'test' END AS split FROM p")
def group_split(spark, d):
    """Every API in one split, in an order that a seed and the name determine."""
    return hash_split(flat(spark, d), "api_name", {"train": 0.7, "dev": 0.1, "test": 0.2}, "20260607")


def _split_rows(spark, d):
    return flat(spark, d).join(group_split(spark, d), "api_name")


_SPLIT = ", g AS (SELECT DISTINCT api_name AS g FROM flat WHERE coalesce(api_name,'') <> ''), p AS (SELECT g, row_number() OVER (ORDER BY sha1('20260607:' || g), g) AS i, count(*) OVER () AS t FROM g), s AS (SELECT g AS api_name, CASE WHEN i <= floor(t * 0.7) THEN 'train' WHEN i <= floor(t * 0.7) + floor(t * 0.1) THEN 'dev' ELSE 'test' END AS split FROM p), j AS (SELECT flat.*, s.split FROM flat JOIN s USING (api_name))"


@query(FLAT + _SPLIT + " SELECT split, coalesce(match, 'unknown') AS kind, count(*) AS n FROM j GROUP BY 1, 2")
def split_stats(spark, d):
    return _split_rows(spark, d).groupBy("split", F.coalesce("match", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(FLAT + _SPLIT + " SELECT a.split AS a, b.split AS b, count(DISTINCT a.api_name) AS shared FROM j a JOIN j b ON a.api_name = b.api_name AND a.split < b.split GROUP BY 1, 2")
def split_overlap(spark, d):
    """Groups in more than one split: none."""
    j = _split_rows(spark, d).select("api_name", "split").distinct()
    return j.alias("x").join(j.alias("y"), "api_name").where("x.split < y.split").groupBy(F.col("x.split").alias("a"), F.col("y.split").alias("b")).agg(F.count_distinct("api_name").alias("shared"))


@query(FLAT + _SPLIT + " SELECT (SELECT count(*) FROM (SELECT ord FROM flat WHERE coalesce(api_name,'') <> '' EXCEPT ALL SELECT ord FROM j)) AS lost, (SELECT count(*) FROM (SELECT ord FROM j EXCEPT ALL SELECT ord FROM flat)) AS strange")
def split_integrity(spark, d):
    """Rows that the splits lost or made up."""
    whole, j = flat(spark, d).where("coalesce(api_name, '') <> ''").select("ord"), _split_rows(spark, d).select("ord")
    both = whole.exceptAll(j).select(F.lit("lost").alias("k")).unionByName(j.exceptAll(whole).select(F.lit("strange").alias("k")))
    return both.agg(F.count_if(F.col("k") == "lost").alias("lost"), F.count_if(F.col("k") == "strange").alias("strange"))


@query(FLAT + "SELECT 'SCG-' || lpad((row_number() OVER (ORDER BY ord))::VARCHAR, 6, '0') AS seq_id, ord FROM flat")
def sequence_ids(spark, d):
    return numbered(flat(spark, d).select("ord"), [F.col("ord").asc()]).select("seq_id", "ord")


@query(
    FLAT + """SELECT coalesce(source_machine, 'unknown') AS machine, count(*) AS n, round(avg(score), 2) AS avg_score, min(score) AS min_score, max(score) AS max_score,
 count(*) FILTER (score >= 90) AS ge90, count(*) FILTER (score >= 80) AS ge80, count(*) FILTER (score >= 70) AS ge70, count(*) FILTER (score >= 60) AS ge60,
 count(DISTINCT api_name) AS apis, count(DISTINCT repo) AS repos, count(*) FILTER (has_comments) AS with_comments, count(*) FILTER (has_docstring) AS with_docstring FROM flat GROUP BY 1"""
)
def source_report(spark, d):
    """Scores, distinct names and conditional counts by source."""
    s = F.col("score")
    return flat(spark, d).groupBy(F.coalesce("source_machine", F.lit("unknown")).alias("machine")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 2).alias("avg_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
        *[F.count_if(s >= k).alias(f"ge{k}") for k in (90, 80, 70, 60)], F.count_distinct("api_name").alias("apis"), F.count_distinct("repo").alias("repos"),
        F.count_if("has_comments").alias("with_comments"), F.count_if("has_docstring").alias("with_docstring"),
    )


@query(FLAT + "SELECT 'match' AS field, coalesce(match,'unknown') AS value, count(*) AS n FROM flat GROUP BY 2 UNION ALL SELECT 'layer', coalesce(layer,'unknown'), count(*) FROM flat GROUP BY 2 UNION ALL SELECT 'method', upper(coalesce(method,'GET')), count(*) FROM flat GROUP BY 2 UNION ALL SELECT 'comments', coalesce(comments_source,'unknown'), count(*) FROM flat GROUP BY 2")
def counter_report(spark, d):
    """Counts of several fields in one scan: a row becomes one pair per field before the aggregate."""
    e = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("match", "layer", "method", "comments"))), F.array(*[F.coalesce(F.col(c), F.lit("unknown")) for c in ("match", "layer")], F.upper(F.coalesce("method", F.lit("GET"))), F.coalesce("comments_source", F.lit("unknown")))))
    return flat(spark, d).select(e.alias("field", "value")).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    FLAT + """SELECT format('{}/{} ({:.1f}%)', count(*) FILTER (has_comments), count(*), 100.0 * count(*) FILTER (has_comments) / count(*)) AS commented,
 format('{}/{} ({:.1f}%)', count(*) FILTER (valid), count(*), 100.0 * count(*) FILTER (valid) / count(*)) AS valid, round(count(*) / count(DISTINCT api_name), 2) AS per_api, round(count(*) / count(DISTINCT repo), 2) AS per_repo FROM flat"""
)
def crawl_statistics(spark, d):
    n = F.count(F.lit(1))
    ratio = lambda c: F.format_string("%d/%d (%.1f%%)", F.count_if(c), n, F.count_if(c) * 100.0 / n)
    return flat(spark, d).agg(ratio("has_comments").alias("commented"), ratio("valid").alias("valid"), F.round(n / F.count_distinct("api_name"), 2).alias("per_api"), F.round(n / F.count_distinct("repo"), 2).alias("per_repo"))


@query(
    FLAT + """SELECT coalesce(api_name,'') AS api, count(*) AS functions, count(DISTINCT repo) AS repos, count(DISTINCT endpoint_id) FILTER (match IN ('url','route')) AS matched,
 count(*) FILTER (match = 'url') AS by_url, count(*) FILTER (match = 'route') AS by_route, count(*) FILTER (match = 'host_only') AS by_host FROM flat GROUP BY 1"""
)
def api_summary(spark, d):
    hit = F.col("match").isin("url", "route")
    return flat(spark, d).groupBy(F.coalesce("api_name", F.lit("")).alias("api")).agg(
        F.count(F.lit(1)).alias("functions"), F.count_distinct("repo").alias("repos"), F.count_distinct(F.when(hit, F.col("endpoint_id"))).alias("matched"),
        *[F.count_if(F.col("match") == k).alias(a) for k, a in (("url", "by_url"), ("route", "by_route"), ("host_only", "by_host"))],
    )


@query(
    FLAT + """SELECT count(*) AS n, count(*) FILTER (match IN ('url','route')) AS documented, count(DISTINCT coalesce(api_name,'') || '|' || coalesce(endpoint_id,'')) FILTER (match IN ('url','route')) AS endpoints,
 count(*) FILTER (coalesce(params,'') NOT IN ('', '[]', '{}', 'null')) AS with_params, round(100.0 * count(*) FILTER (match IN ('url','route')) / count(*), 2) AS share FROM flat"""
)
def coverage_report(spark, d):
    """Coverage as the SQL fixes it: recorded matches, endpoint ids and the params text alone; ``documentation_coverage`` is the whole report."""
    hit = F.col("match").isin("url", "route")
    pair = F.concat(F.coalesce("api_name", F.lit("")), F.lit("|"), F.coalesce("endpoint_id", F.lit("")))
    return flat(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("documented"), F.count_distinct(F.when(hit, pair)).alias("endpoints"),
        F.count_if(~F.coalesce("params", F.lit("")).isin("", "[]", "{}", "null")).alias("with_params"), tx.percent(F.count_if(hit), F.count(F.lit(1))).alias("share"),
    )


@query()
def documentation_coverage(spark, d):
    """What the documentation covers: complete metadata, matched endpoints, documented parameters and whether the code names one.

    ``with_params`` counts any of the four fields with content; ``param_documented``
    takes params only where their source is the documentation, as does ``param_used``.
    """
    df = heavy(spark, d, "api_name", "api_host", "code", "url", "route", "method", "endpoint_id", "match", "headers", "params", "params_source", "path_params", "header_params", "payload")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    head = lambda k: F.try_element_at("headers", F.lit(k))
    host = F.coalesce(some("api_host"), head("x-rapidapi-host"), head("X-RapidAPI-Host"), F.lit(""))
    kind = ql.match_type(F.col("match"), F.col("code"), F.col("url"), F.coalesce(some("route"), url_path(F.col("url"))), host)
    own = F.when(F.col("params_source").isin("documentation", "documented"), F.col("params"))
    rest = [F.col(c) for c in ("path_params", "header_params", "payload")]
    df = df.select(
        kind.alias("kind"), F.struct(F.coalesce("api_name", F.lit("")), F.coalesce(some("endpoint_id"), some("url"), some("route"), F.lit(""))).alias("endpoint"),
        (some("url").isNotNull() & some("method").isNotNull() & F.coalesce(F.size("headers") > 0, F.lit(False))).alias("complete"),
        param_used(F.col("code"), F.col("params"), *rest).isNotNull().alias("with_params"), param_used(F.col("code"), own, *rest).alias("used"),
    )
    hit, n, documented = F.col("kind").isin("url", "route"), F.count(F.lit(1)), F.count("used")
    return df.agg(
        n.alias("n"), F.count_if("complete").alias("metadata_complete"), F.count_if(hit).alias("endpoint_matched"), F.count_if(F.col("kind") == "host_only").alias("host_only"),
        F.count_if(F.col("kind") == "none").alias("no_match"), F.count_distinct(F.when(hit, F.col("endpoint"))).alias("endpoints"), F.count_if("with_params").alias("with_params"),
        documented.alias("param_documented"), F.count_if("used").alias("param_used"), tx.percent(F.count_if("complete"), n).alias("complete_share"), tx.percent(F.count_if(hit), n).alias("matched_share"),
        tx.percent(documented, n).alias("documented_share"), tx.percent(F.count_if("used"), documented).alias("used_share"),
    )


@query(FLAT + "SELECT sum(least(n, 5))::BIGINT AS budget FROM (SELECT repo, count(*) AS n FROM flat GROUP BY repo)")
def candidate_budget(spark, d):
    return flat(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.least("n", F.lit(5))).alias("budget"))


@query(
    FLAT + f""", k AS (SELECT concat_ws('|', {_KEY}) AS k FROM flat) SELECT 'records' AS test, (count(*) BETWEEN 1 AND 12500000)::BOOLEAN AS ok FROM flat UNION ALL SELECT 'score_range', count(*) FILTER (score < 0 OR score > 100) = 0 FROM flat
 UNION ALL SELECT 'average', coalesce(avg(score) >= 80, false) FROM flat UNION ALL SELECT 'comments', count(*) FILTER (has_comments) >= 0.6 * count(*) FROM flat UNION ALL SELECT 'duplicates', count(*) = count(DISTINCT k) FROM k"""
)
def validation(spark, d):
    """Tests of a release, one row each."""
    n = F.count(F.lit(1))
    one = flat(spark, d).agg(
        n.between(1, 12_500_000).alias("records"), (F.count_if((F.col("score") < 0) | (F.col("score") > 100)) == 0).alias("score_range"), F.coalesce(F.avg("score") >= 80, F.lit(False)).alias("average"),
        (F.count_if("has_comments") >= n * 0.6).alias("comments"), (n == F.count_distinct(F.concat_ws("|", *_key()))).alias("duplicates"),
    )
    return one.unpivot([], ["records", "score_range", "average", "comments", "duplicates"], "test", "ok")


_LINE_KIND = " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{c}'" for c, p in [("", NO_COMMENT), *LINE_RULES])


@query(FLAT + f"SELECT x AS line_kind, count(*) AS n FROM (SELECT CASE {_LINE_KIND} ELSE '' END AS x FROM (SELECT trim(replace(replace(unnest(string_split(src, chr(10))), chr(9), ' '), chr(13), ' ')) AS l FROM flat)) GROUP BY 1")
def line_classify(spark, d):
    return heavy(spark, d, "code").select(F.explode(F.split("code", "\n")).alias("l")).groupBy(line_comment(F.col("l")).alias("line_kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    FLAT + """, l AS (SELECT ord, generate_subscripts(string_split(src, chr(10)), 1) AS i, trim(replace(unnest(string_split(src, chr(10))), chr(13), '')) AS l FROM flat),
 p AS (SELECT ord, i, l, last_value(CASE WHEN l <> '' THEN l END IGNORE NULLS) OVER (PARTITION BY ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l)
 SELECT ord, count(*) FILTER (starts_with(l, 'def ') AND starts_with(prev, '#')) AS commented_defs FROM p GROUP BY ord"""
)
def line_before(spark, d):
    """Definitions whose last line before them that is not blank is a comment."""
    # The line before is the one before among those that are not blank; it is found within the row.
    lines = F.filter(F.transform(F.split("code", "\n"), lambda x: F.trim(F.translate(x, "\r", ""))), lambda x: x != "")
    rows = flat(spark, d).where("code is not null").select("ord", lines.alias("x"))
    found = F.filter("x", lambda x, i: x.startswith("def ") & F.coalesce(F.get("x", i - 1).startswith("#"), F.lit(False)))
    return rows.select("ord", F.size(found).cast("bigint").alias("commented_defs"))


@query()
def code_facts_all(spark, d):
    """Facts from the syntax tree, each text parsed once."""
    df = heavy(spark, d, "code").select("ord", code_facts(F.col("code")).alias("f"))
    return df.select("ord", "f.*")


@query()
def function_extract(spark, d):
    df = heavy(spark, d, "code", "api_host").select("ord", "code", F.array(F.coalesce("api_host", F.lit(""))).alias("hosts"))
    return df.select("ord", F.inline(extract_functions(F.col("code"), F.col("hosts"))))


@query()
def annotate_code(spark, d):
    df = heavy(spark, d, "code").select("ord", annotated(F.col("code")).alias("a"))
    return df.select("ord", F.col("a.code").alias("annotated"), F.size("a.inserted").alias("inserted"))


@query()
def near_dup_greedy(spark, d):
    """Order-dependent near-duplicates within an API, in any repository; records without an API's name are compared with each other."""
    return greedy_near(flat(spark, d), "api_name", "ord", "code", threshold=0.85)


@query()
def annotation_report(spark, d):
    """Records by kind of match and number of comments put in."""
    df = heavy(spark, d, "code", "match").select("match", F.size(annotated(F.col("code"))["inserted"]).alias("inserted"))
    return df.groupBy(F.coalesce("match", F.lit("unknown")).alias("match"), "inserted").agg(F.count(F.lit(1)).alias("n")).orderBy("match", "inserted")


@query()
def uncommented(spark, d):
    """Whether a record's code has neither comments nor a docstring, whatever its flags say."""
    df = heavy(spark, d, "code").select("ord", code_facts(F.col("code")).alias("f"))
    return df.select("ord", ((F.col("f.n_comments") == 0) & ~F.col("f.has_docstring")).alias("uncommented"))
