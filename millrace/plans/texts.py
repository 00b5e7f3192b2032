"""Queries over documents, prompts and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import urls
from millrace.operators import prompts as pr
from millrace.functions.fields import SAFE_NAMES, SAFE_VALUES
from millrace.functions.jsonvals import balanced_json
from millrace.operators.audit import STRONG, findings_of, record_findings, release_audit, suspicious_literals
from millrace.operators.dedupe import first_wins
from millrace.plans.apis import END, _METHOD, _TRIM, _route_sql, endpoints
from millrace.plans.records import FLAT, SIDES, flat, heavy, records
from millrace.plans.registry import query
from millrace.runtime import spread, table


def documents(spark, d):
    return table(spark, d, "documents")


@query("SELECT lower(coalesce(lang,'und')) AS lang, count(*) AS n, count(DISTINCT source) AS sources, sum(length(coalesce(text,'')))::BIGINT AS chars, count(*) FILTER (n_chars IS NOT NULL AND n_chars <> length(text)) AS stale FROM documents GROUP BY 1")
def language_report(spark, d):
    return documents(spark, d).groupBy(F.lower(F.coalesce("lang", F.lit("und"))).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"),
        F.count_if(F.col("n_chars").isNotNull() & (F.col("n_chars") != F.char_length("text"))).alias("stale"),
    )


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def document_copies(spark, d):
    return documents(spark, d).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text,''), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents")
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), n AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2), t AS (SELECT doc_id, sum(n) AS t FROM n GROUP BY 1) SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM n JOIN t USING (doc_id) GROUP BY doc_id")
def char_entropy(spark, d):
    """Bits a character of every text that is not empty."""
    return documents(spark, d).where("text <> ''").select("doc_id", F.round(tx.entropy(F.col("text")), 6).alias("entropy"))


@query(r"SELECT doc_id, len(regexp_extract_all(t, '[^\r\n]+'))::INT AS filled, len(regexp_extract_all(t, '(?m)^[ \t]*[*-] '))::INT AS bullets, len(regexp_extract_all(t, '```'))::INT AS fences, len(list_distinct(regexp_extract_all(lower(t), '[a-z]+')))::INT AS distinct_words FROM (SELECT doc_id, coalesce(text,'') AS t FROM documents)")
def document_shape(spark, d):
    t = F.coalesce("text", F.lit(""))
    n = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    return documents(spark, d).select("doc_id", n(r"[^\r\n]+").alias("filled"), n(r"(?m)^[ \t]*[*-] ").alias("bullets"), n("```").alias("fences"), F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)))).alias("distinct_words"))


@query("SELECT source, doc_id, length(coalesce(text,'')) AS n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(coalesce(text,'')) DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def longest_per_source(spark, d):
    df = documents(spark, d).select("source", "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "doc_id"))).where("rank <= 5")


_STRONG = f"unnest([{', '.join(f"'{k}'" for k in STRONG)}]) AS kind, unnest([{', '.join(f"'{p}'" for p in STRONG.values())}]) AS p"


@query(f"SELECT kind, count(*) AS n FROM (SELECT {_STRONG}, code.complete_function AS t FROM function_record) WHERE regexp_matches(t, p) GROUP BY kind")
def secret_findings(spark, d):
    """Records by the shapes of tokens that SQL can search, in the code alone; ``release_findings`` is the whole audit."""
    return findings_of(heavy(spark, d, "code"), "ord", "code").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def release_findings(spark, d):
    """Records by the kind of what a release must not hold, in every string of a record."""
    df = records(spark, d).select(
        "ord", "sample_id", "api_name", "api_host", "function_name", "language", "source_machine", "github_info", "code", "api_metadata", "comments", "comments_source",
    )
    sides = ["comments", *(f"api_metadata.{c}" for c in SIDES)]
    return record_findings(spread(df, "ord"), "ord", sides).groupBy("kind").agg(F.count_distinct("ord").alias("n"))


@query("SELECT CASE WHEN regexp_matches(p, '(^|/)([.]env|id_rsa|credentials|secrets?)([.][a-z]+)?$') THEN 'forbidden_name' WHEN regexp_matches(p, '(^|/)(node_modules|venv|[.]git|__pycache__)/') THEN 'forbidden_folder' WHEN regexp_matches(p, '[.](pem|key|p12|pyc|log|sqlite|db)$') THEN 'forbidden_suffix' ELSE 'ok' END AS kind, count(*) AS n FROM (SELECT lower(replace(trim(coalesce(github_info.file_path,'')), chr(92), '/')) AS p FROM function_record) GROUP BY 1")
def release_files(spark, d):
    return flat(spark, d).groupBy(release_audit(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.split, c.c AS context, count(*) AS n, sum(length(e.text || ' [' || c.c || ']'))::BIGINT AS chars FROM eval_item e CROSS JOIN (SELECT unnest(['C0','C1','C2','C3','C4']) AS c) c GROUP BY 1, 2")
def context_cross(spark, d):
    """Every task in five contexts."""
    e = pr.contexts(table(spark, d, "eval_item"))
    return e.groupBy("split", "context").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(F.concat("text", F.lit(" ["), "context", F.lit("]")))).alias("chars"))


@query(
    FLAT + f""", g AS (SELECT ord, {_TRIM.format('api_host')} AS host, {_TRIM.format('url')} AS url, {_METHOD} AS method, {_route_sql('route')} AS route, {_TRIM.format('endpoint_name')} AS ename FROM flat), c AS (SELECT g.*, x.i AS i FROM g, (SELECT unnest([0,1,2,3,4]) AS i) x)
 SELECT ord, 'C' || i AS context, CASE WHEN i = 0 THEN '' ELSE 'Host: ' || host END || CASE WHEN i >= 2 THEN chr(10) || 'Endpoint: ' || method || ' ' || route || chr(10) || 'URL: ' || url || chr(10) || 'Name: ' || ename ELSE '' END || CASE WHEN i >= 3 THEN chr(10) || 'Headers: x-rapidapi-host is ' || host || ', x-rapidapi-key is given by the caller' ELSE '' END || CASE WHEN i >= 4 THEN chr(10) || 'Dependency: requests' ELSE '' END AS docs FROM c"""
)
def context_docs(spark, d):
    """What each context level tells of the documented endpoint."""
    return pr.context_docs(flat(spark, d))


@query()
def endpoint_prompts(spark, d):
    """Prompts with the target among up to nine other endpoints, in an order that a hash of record and endpoint gives."""
    return pr.endpoint_prompts(flat(spark, d), endpoints(spark, d))


@query(END + f", n AS (SELECT api_name, count(*) AS c FROM (SELECT DISTINCT api_name, endpoint_id FROM ends) GROUP BY 1) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(r.api_metadata.doc_match_type,'') = 'host_only' THEN 'host_only' WHEN coalesce(n.c, 0) < 2 THEN 'few_candidates' ELSE 'ok' END AS reason FROM function_record r LEFT JOIN n ON r.api_name = n.api_name) GROUP BY 1")
def prompt_skips(spark, d):
    n = endpoints(spark, d).select("api_name", "endpoint_id").distinct().groupBy("api_name").agg(F.count(F.lit(1)).alias("c"))
    j = flat(spark, d).select("ord", "api_name", "match").join(n, "api_name", "left")
    reason = F.when(F.coalesce("match", F.lit("")) == "host_only", "host_only").when(F.coalesce("c", F.lit(0)) < 2, "few_candidates").otherwise("ok")
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    FLAT + r""", w AS (SELECT ord, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(function_name,''), '[_\-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g')) AS a, regexp_replace(coalesce(endpoint_name,''), '^\s+|\s+$', '', 'g') AS b FROM flat)
 SELECT ord, CASE WHEN a = '' THEN b WHEN b = '' OR lower(a) = lower(b) THEN a ELSE a || ' | ' || b END AS hint FROM w"""
)
def task_hint(spark, d):
    """What a function is for, in words of its names."""
    return flat(spark, d).select("ord", pr.task_hint(F.col("function_name"), F.col("endpoint_name"), F.lit(None).cast("string")).alias("hint"))


_SAFE = "CASE " + " ".join(f"WHEN n = '{a}' THEN '{b}'" for a, b in SAFE_NAMES.items()) + " " + " ".join(f"WHEN contains(n, '{a}') THEN '{b}'" for a, b in SAFE_VALUES) + " ELSE 'test' END"


@query(
    END + rf""", r AS (SELECT api_name, pos, {_route_sql('route')} AS r FROM ends), m AS (SELECT *, list_distinct(regexp_extract_all(r, '(\{{[^}}/]+\}}|<[^>/]+>|:[A-Za-z_]\w*)', 1)) AS marks FROM r)
 SELECT api_name, pos::INT AS pos, CASE WHEN len(marks) = 0 THEN r ELSE list_reduce(list_prepend(r, marks), lambda acc, k: replace(acc, k, {_SAFE.replace('n =', "lower(regexp_replace(k, '[{}<>:]', '', 'g')) =").replace('contains(n', "contains(lower(regexp_replace(k, '[{}<>:]', '', 'g'))")})) END AS filled FROM m"""
)
def filled_routes(spark, d):
    """Routes with their placeholders filled by a safe value of their name."""
    return endpoints(spark, d).select("api_name", "pos", urls.fill_safe(urls.route(F.col("route"))).alias("filled"))


_UNSAFE = "delete|remove|create|update|upload|send|pay|purchase|order|book|post|write|message|sms|email"  # fixed values


@query(
    FLAT + rf""", c AS (SELECT ord, lower({_TRIM.format('api_host')}) AS host, coalesce(route, '') AS r, coalesce(route, '') || ' ' || coalesce(endpoint_name, '') AS said FROM flat WHERE upper({_METHOD}) = 'GET'),
 k AS (SELECT * FROM c WHERE host <> '' AND r <> '' AND NOT regexp_matches(said, '(?i){_UNSAFE}') AND NOT (contains(r, '{{') AND NOT contains(r, '}}')) QUALIFY row_number() OVER (PARTITION BY host ORDER BY ord) = 1)
 SELECT ord, host FROM k ORDER BY host LIMIT 120"""
)
def probe_candidates(spark, d):
    """The first record of each host whose documented call only reads, the first 120 hosts: what may be tried without harm."""
    f = flat(spark, d).select("ord", F.lower(tx.text(F.col("api_host"))).alias("host"), urls.method(F.col("method")).alias("m"), F.coalesce("route", F.lit("")).alias("r"), F.coalesce("endpoint_name", F.lit("")).alias("name"))
    harmless = ~F.concat_ws(" ", "r", "name").rlike(f"(?i){_UNSAFE}") & ~(F.col("r").contains("{") & ~F.col("r").contains("}"))
    kept = f.where((F.col("m") == "GET") & (F.col("host") != "") & (F.col("r") != "") & harmless).select("ord", "host")
    return first_wins(kept, [F.col("host")], F.col("ord")).orderBy("host").limit(120)


@query()
def suspicious_keys(spark, d):
    """How many texts of each record's code look like keys."""
    return heavy(spark, d, "code").select("ord", F.size(suspicious_literals(F.col("code"))).alias("n"))


@query()
def json_fragments(spark, d):
    """Balanced JSON objects and lists inside the documents' texts."""
    return spread(documents(spark, d).select("doc_id", "text"), "doc_id").select("doc_id", F.size(balanced_json(F.col("text"))).alias("fragments"))


@query(END + r"SELECT api_name, pos::INT AS pos, regexp_replace(regexp_replace(" + _TRIM.format("api_name") + r", '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS file, list_filter(string_split('/' || regexp_extract(coalesce(url, ''), '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda y: y <> '')[-1] AS slug FROM ends")
def page_names(spark, d):
    """A file name for each API and the last part of its endpoints' addresses."""
    return endpoints(spark, d).select("api_name", "pos", urls.file_safe(F.col("api_name")).alias("file"), urls.page_slug(F.col("url")).alias("slug"))
