"""Queries over API documents and their endpoints, and joins of records with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import urls
from millrace.functions.jsonvals import collected_names, comments_text, param_names, side_strings
from millrace.operators.dedupe import first_wins
from millrace.operators.select import top_per_group
from millrace.plans.records import FLAT, SIDES, flat, heavy
from millrace.plans.registry import query
from millrace.runtime import table


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    """One row per documented endpoint; documents without a list have none."""
    doc = table(spark, d, "api_document")
    return doc.select("api_name", "category", F.col("subscriptions_count").alias("subs"), F.posexplode("endpoints_metadata").alias("pos", "e")).select(
        "api_name", "category", "subs", "pos", F.col("e.endpoint_id").alias("endpoint_id"), F.col("e.endpoint_name").alias("endpoint_name"), F.col("e.route").alias("route"),
        F.col("e.method").alias("method"), F.col("e.rapidapi_host").alias("host"), F.col("e.base_url").alias("base_url"), F.col("e.url").alias("url"), F.col("e.params").alias("params"),
        F.col("e.path_params").alias("path_params"), F.col("e.payload").alias("payload"), F.coalesce(F.col("e.description"), F.col("e.endpoint_description")).alias("description"), F.col("e.index").alias("idx"),
    )


END = """WITH x AS (SELECT api_name, category, subscriptions_count AS subs, unnest(endpoints_metadata) AS e, generate_subscripts(endpoints_metadata, 1) - 1 AS pos FROM api_document),
 ends AS (SELECT api_name, category, subs, pos, e.endpoint_id AS endpoint_id, e.endpoint_name AS endpoint_name, e.route AS route, e.method AS method, e.rapidapi_host AS host, e.base_url AS base_url,
 e.url AS url, e.params AS params, coalesce(e.description, e.endpoint_description) AS description, e."index" AS idx FROM x)
"""
_TRIM = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
_METHOD = f"CASE WHEN {_TRIM.format('method')} = '' THEN 'GET' ELSE upper({_TRIM.format('method')}) END"
_PATH = r"regexp_extract(coalesce({0}, ''), '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _route_sql(c: str) -> str:
    t = _TRIM.format(c)
    own = f"regexp_replace({t}, '\\?.*$', '')"
    return f"CASE WHEN {t} = '' THEN '' WHEN regexp_matches({t}, '(?i)^https?://') THEN CASE WHEN {_PATH.format(t)} = '' THEN '/' ELSE {_PATH.format(t)} END WHEN starts_with({own}, '/') THEN {own} ELSE '/' || {own} END"


_FLAT_ROUTE = r"string_split(regexp_replace(regexp_replace(coalesce(route,''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '?')[1]"


@query(END + f"SELECT endpoint_id, api_name, pos::INT AS pos, {_route_sql('route')} AS norm_route, {_METHOD} AS norm_method FROM ends")
def route_normalise(spark, d):
    return endpoints(spark, d).select("endpoint_id", "api_name", "pos", urls.route(F.col("route")).alias("norm_route"), urls.method(F.col("method")).alias("norm_method"))


@query(END + f"SELECT api_name, pos::INT AS pos, CASE WHEN r = '' THEN '/' WHEN starts_with(r, '/') THEN r ELSE '/' || r END AS flat_route FROM (SELECT api_name, pos, {_FLAT_ROUTE} AS r FROM ends)")
def route_flat(spark, d):
    return endpoints(spark, d).select("api_name", "pos", urls.flat_route(F.col("route")).alias("flat_route"))


@query(END + f"SELECT api_name, pos::INT AS pos, CASE WHEN rtrim(r, '/') = '' THEN '' WHEN ends_with(r, '/') THEN r || ' ' || rtrim(r, '/') ELSE r || ' ' || r || '/' END AS variants FROM (SELECT api_name, pos, {_route_sql('route')} AS r FROM ends)")
def route_variants(spark, d):
    return endpoints(spark, d).select("api_name", "pos", F.array_join(urls.route_variants(urls.route(F.col("route"))), " ").alias("variants"))


@query(FLAT + f"SELECT ord, {_PATH.format('url')} AS path, lower(regexp_extract(coalesce(url,''), '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(coalesce(url,''), '\\?([^#]*)', 1) AS args, regexp_replace(coalesce(url,''), '[?#].*$', '') AS bare FROM flat")
def url_parts(spark, d):
    u = F.col("url")
    return flat(spark, d).select("ord", urls.url_path(u).alias("path"), urls.url_host(u).alias("host"), urls.url_query(u).alias("args"), urls.without_query(u).alias("bare"))


@query(END + f"SELECT api_name, pos::INT AS pos, regexp_replace(coalesce(base_url,''), '/+$', '') || {_route_sql('route')} AS address FROM ends")
def endpoint_address(spark, d):
    return endpoints(spark, d).select("api_name", "pos", urls.join_url(F.col("base_url"), F.col("route")).alias("address"))


@query(END + f"SELECT min(pos)::INT AS pos, api_name, endpoint_id FROM ends GROUP BY api_name, endpoint_id, {_METHOD}, {_route_sql('route')}")
def endpoint_distinct(spark, d):
    """First endpoint of each API, id, method and route."""
    e = endpoints(spark, d)
    keys = [F.col("api_name"), F.col("endpoint_id"), urls.method(F.col("method")), urls.route(F.col("route"))]
    return first_wins(e.select("api_name", "endpoint_id", "method", "route", "pos"), keys, F.col("pos")).select("pos", "api_name", "endpoint_id")


@query(END + f"SELECT lower(host) AS host, {_METHOD} AS method, CASE WHEN r = '' THEN '/' WHEN starts_with(r, '/') THEN r ELSE '/' || r END AS route, count(*) AS n, min(api_name) AS api FROM (SELECT *, {_FLAT_ROUTE} AS r FROM ends) GROUP BY 1, 2, 3")
def corpus_distinct(spark, d):
    return endpoints(spark, d).groupBy(F.lower("host").alias("host"), urls.method(F.col("method")).alias("method"), urls.flat_route(F.col("route")).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.min("api_name").alias("api"))


@query(END + f"SELECT api_name, pos::INT AS pos, regexp_replace(regexp_replace(lower(coalesce(endpoint_name,'')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake_name, array_to_string(list_filter(regexp_split_to_array(coalesce(route,''), '[/_\\-.]'), lambda y: y <> ''), ' ') AS route_tokens, left(sha1(coalesce(api_name,'') || '::' || {_METHOD} || '::' || {_route_sql('route')}), 16) AS stable FROM ends")
def endpoint_names(spark, d):
    e = endpoints(spark, d)
    return e.select("api_name", "pos", F.lower(tx.snake(F.lower("endpoint_name"))).alias("snake_name"), tx.path_tokens(F.col("route")).alias("route_tokens"),
                    tx.stable_id(F.col("api_name"), urls.method(F.col("method")), urls.route(F.col("route"))).alias("stable"))


@query("SELECT api_name, count(*) AS documents, sum(coalesce(len(endpoints_metadata), 0))::BIGINT AS endpoints, count(*) FILTER (error IS NOT NULL) AS failed FROM api_document GROUP BY 1")
def doc_stats(spark, d):
    return table(spark, d, "api_document").groupBy("api_name").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(F.size("endpoints_metadata"), F.lit(0))).alias("endpoints"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@query("SELECT coalesce(category,'unknown') AS category, count(*) AS documents, count(*) FILTER (error IS NULL) AS good, sum(coalesce(len(list_filter(endpoints_metadata, lambda y: upper(y.method) = 'POST')), 0))::BIGINT AS posts FROM api_document GROUP BY 1")
def category_summary(spark, d):
    posts = F.coalesce(F.size(F.filter("endpoints_metadata", lambda e: F.upper(e["method"]) == "POST")), F.lit(0))
    return table(spark, d, "api_document").groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("error").isNull()).alias("good"), F.sum(posts).alias("posts"))


@query("SELECT round(quantile_cont(subscriptions_count, 0.5), 4) AS median, round(avg(subscriptions_count), 4) AS mean, round(quantile_cont(subscriptions_count, 0.9), 4) AS p90, max(subscriptions_count) AS most, count(subscriptions_count) AS n FROM api_document")
def subscription_stats(spark, d):
    s = "subscriptions_count"
    return table(spark, d, "api_document").agg(F.round(F.percentile(s, 0.5), 4).alias("median"), F.round(F.avg(s), 4).alias("mean"), F.round(F.percentile(s, 0.9), 4).alias("p90"), F.max(s).alias("most"), F.count(s).alias("n"))


@query("WITH b AS (SELECT CASE WHEN subscriptions_count IS NULL THEN 'unknown' WHEN subscriptions_count < 100 THEN 'low' WHEN subscriptions_count < 1000 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n FROM api_document GROUP BY 1) SELECT bucket, n, round(100.0 * n / sum(n) OVER (), 4) AS share FROM b")
def subscription_buckets(spark, d):
    s = F.col("subscriptions_count")
    b = F.when(s.isNull(), "unknown").when(s < 100, "low").when(s < 1000, "middle").otherwise("high")
    g = table(spark, d, "api_document").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))  # four rows


@query(FLAT + ", c AS (SELECT api_name, count(*) AS n FROM flat WHERE api_name IS NOT NULL GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, api_name) AS i, count(*) OVER () AS t, sum(n) OVER () AS s FROM c) SELECT count(*) FILTER (n = 1) AS singles, round(100.0 * sum(n) FILTER (i <= ceil(t * 0.2)) / max(s), 4) AS top_share FROM r")
def lorenz_share(spark, d):
    """APIs seen once, and the share of records that the upper fifth of APIs has."""
    c = flat(spark, d).where("api_name is not null").groupBy("api_name").agg(F.count(F.lit(1)).alias("n"))
    # Ranks by count: groups of APIs of equal count, few whatever the input, carry the sums.
    g = c.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy(F.col("n").desc())
    g = g.withColumn("before", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("t", F.sum("m").over(Window.partitionBy()))
    upper = F.greatest(F.lit(0), F.least(F.col("m"), F.ceil(F.col("t") * 0.2) - F.col("before")))
    return g.agg(F.sum(F.when(F.col("n") == 1, F.col("m")).otherwise(0)).alias("singles"), F.round(F.sum(upper * F.col("n")) * 100.0 / F.sum(F.col("n") * F.col("m")), 4).alias("top_share"))


@query(END + ", s AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY (coalesce(description,'') = '')::INT, (coalesce(params,'') IN ('', '[]', '{}', 'null'))::INT, idx, pos, endpoint_id) AS rank FROM ends) SELECT api_name, endpoint_id, rank::INT AS rank FROM s WHERE rank <= 2")
def endpoint_query_candidates(spark, d):
    """Two endpoints of each API to search for: described ones first, then those with parameters."""
    e = endpoints(spark, d)
    order = [(F.coalesce("description", F.lit("")) == "").cast("int").asc(), F.coalesce("params", F.lit("")).isin("", "[]", "{}", "null").cast("int").asc(), F.col("idx").asc(), F.col("pos").asc(), F.col("endpoint_id").asc()]
    return top_per_group(e, ["api_name"], order, 2).select("api_name", "endpoint_id", "rank")


_NO_VALUE = "coalesce({0}, '') IN ('', 'null', '{{}}', '[]')"
_LAYERS = f"""WITH x AS (SELECT api_name, unnest(endpoints_metadata) AS e, generate_subscripts(endpoints_metadata, 1) - 1 AS pos FROM api_document),
 v AS (SELECT api_name, pos, {_TRIM.format('e.url')} AS u, CASE WHEN {_route_sql('e.route')} <> '' THEN {_route_sql('e.route')} ELSE {_PATH.format('e.url')} END AS r, coalesce(nullif(e.endpoint_description,''), nullif(e.description,'')) IS NULL AS undescribed,
 {' AND '.join(_NO_VALUE.format('e.' + c) for c in ('params', 'path_params', 'header_params', 'payload'))} AS bare, coalesce(e."index", 999999) AS idx, coalesce(nullif(e.endpoint_id,''), nullif(e.url,''), nullif(e.route,'')) AS k,
 regexp_extract(coalesce(e.url,''), '(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS host FROM x), h AS (SELECT api_name, min(host) AS host FROM v WHERE host <> '' GROUP BY 1),
 f AS (SELECT * FROM v WHERE length(r) >= 4 AND k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY api_name, k ORDER BY undescribed, bare, idx, pos, u, r) = 1),
 c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY api_name ORDER BY undescribed, bare, idx, pos, k) <= 2), w AS (SELECT *, string_split(string_split(host, '.')[1], '-')[1] AS word FROM h),
 q AS (SELECT api_name, 'endpoint_url_match' AS layer, '"' || u || '" language:python' AS q FROM c JOIN h USING (api_name) WHERE u <> '' UNION SELECT api_name, 'endpoint_route_host_match', '"' || r || '" "' || h.host || '" language:python' FROM c JOIN h USING (api_name)
 UNION SELECT api_name, 'host_match', '"' || host || '" language:python' FROM w UNION SELECT api_name, 'header_match', '"x-rapidapi-host" "' || host || '" language:python' FROM w UNION SELECT api_name, 'keyword_match', '"' || word || '" "rapidapi" language:python' FROM w WHERE length(word) > 3
 UNION SELECT api_name, 'library_match', '"' || host || '" "requests" language:python' FROM w UNION SELECT api_name, 'function_match', '"' || host || '" "def " language:python' FROM w
 UNION SELECT api_name, 'keyword_requests_match', '"' || word || '" "requests.post" OR "requests.get" language:python' FROM w WHERE length(word) > 3 UNION SELECT api_name, 'error_handling_match', '"' || host || '" language:python "try"' FROM w) SELECT api_name, layer, q FROM q"""


@query(_LAYERS)
def search_queries(spark, d):
    """Search expressions of every layer, once each: two endpoints of each API, described ones with parameters first, then its least host and that host's first word."""
    e = table(spark, d, "api_document").select("api_name", F.posexplode("endpoints_metadata").alias("pos", "e")).select("api_name", "pos", "e.*")
    route = urls.route(F.col("route"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    none = lambda c: F.coalesce(c, F.lit("")).isin("", "null", "{}", "[]")
    bare = none(F.col("params")) & none(F.col("path_params")) & none(F.col("header_params")) & none(F.col("payload"))
    v = e.select(
        "api_name", "pos", tx.text(F.col("url")).alias("u"), F.when(route != "", route).otherwise(urls.url_path(F.col("url"))).alias("r"), F.coalesce(filled("endpoint_description"), filled("description")).isNull().alias("undescribed"),
        bare.alias("bare"), F.coalesce("index", F.lit(999999)).alias("idx"), F.coalesce(filled("endpoint_id"), filled("url"), filled("route")).alias("k"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1).alias("host"),
    )
    hosts = v.where("host <> ''").groupBy("api_name").agg(F.min("host").alias("host"))
    order = [F.col(c) for c in ("undescribed", "bare", "idx", "pos")]
    c = top_per_group(v.where((F.length("r") >= 4) & F.col("k").isNotNull()), ["api_name", "k"], [*order, F.col("u"), F.col("r")], 1, "n").drop("n", "host")
    c = top_per_group(c, ["api_name"], [*order, F.col("k")], 2, "n").groupBy("api_name").agg(F.collect_list(F.struct("u", "r")).alias("ends"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    in_python = F.lit(" language:python")
    one = lambda k, *q: F.struct(F.lit(k).alias("layer"), F.concat(*q).alias("q"))
    host, word = quoted(F.col("host")), F.substring_index(F.substring_index("host", ".", 1), "-", 1)
    keyword = F.when(F.length(word) > 3, quoted(word))
    ends = F.coalesce("ends", F.array().cast("array<struct<u: string, r: string>>"))
    layers = F.concat(
        F.transform(F.filter(ends, lambda x: x["u"] != ""), lambda x: one("endpoint_url_match", quoted(x["u"]), in_python)), F.transform(ends, lambda x: one("endpoint_route_host_match", quoted(x["r"]), F.lit(" "), host, in_python)),
        F.array(
            one("host_match", host, in_python), one("header_match", F.lit('"x-rapidapi-host" '), host, in_python), one("keyword_match", keyword, F.lit(' "rapidapi"'), in_python), one("library_match", host, F.lit(' "requests"'), in_python),
            one("function_match", host, F.lit(' "def "'), in_python), one("keyword_requests_match", keyword, F.lit(' "requests.post" OR "requests.get"'), in_python), one("error_handling_match", host, in_python, F.lit(' "try"')),
        ),
    )
    return hosts.join(c, "api_name", "left").select("api_name", F.inline(layers)).where("q is not null").distinct()


@query(FLAT + END.replace("WITH x", ", x", 1) + f", a AS (SELECT DISTINCT api_name FROM flat WHERE api_name IS NOT NULL), n AS (SELECT api_name, count(*) AS n FROM ends GROUP BY 1) SELECT count(*) AS apis, sum(n.n)::BIGINT AS endpoints FROM a JOIN n USING (api_name)")
def documented_apis(spark, d):
    """APIs of the records that are documented, and their endpoints."""
    n = endpoints(spark, d).groupBy("api_name").agg(F.count(F.lit(1)).alias("n"))
    return n.join(flat(spark, d).select("api_name").where("api_name is not null"), "api_name", "left_semi").agg(F.count(F.lit(1)).alias("apis"), F.sum("n").alias("endpoints"))


_END_ROUTE = f"CASE WHEN {_route_sql('e.route')} <> '' THEN {_route_sql('e.route')} ELSE {_PATH.format('e.url')} END"
_DOCUMENTED = f""", known AS (SELECT api_name, list(DISTINCT host) FILTER (coalesce(host,'') <> '') AS hosts FROM (SELECT api_name, host FROM ends UNION SELECT api_name, rapidapi_host FROM api_document) GROUP BY 1),
 v AS (SELECT e.api_name, e.pos, e.endpoint_id, coalesce(e.host,'') AS host, {_TRIM.format('e.url')} AS u, {_END_ROUTE} AS r FROM ends e),
 m AS (SELECT f.ord, v.pos, v.endpoint_id AS eid, CASE WHEN v.api_name IS NULL THEN 5 WHEN v.u <> '' AND (contains(f.src, v.u) OR (ends_with(v.u, '/') AND rtrim(v.u, '/') <> '' AND contains(f.src, rtrim(v.u, '/')))) THEN 1
 WHEN rtrim(v.r, '/') <> '' AND (contains(f.src, v.r) OR (ends_with(v.r, '/') AND contains(f.src, rtrim(v.r, '/')))) THEN 2 WHEN v.host <> '' AND contains(f.src, v.host) THEN 3
 WHEN len(list_filter(known.hosts, lambda h: contains(f.src, h))) > 0 THEN 4 ELSE 5 END AS pass FROM flat f LEFT JOIN v ON f.api_name = v.api_name LEFT JOIN known ON f.api_name = known.api_name)"""


def _chosen(code, ends, hosts):
    """(how, endpoint) of the endpoint that a text names best, from the endpoints of its API in order; decided within the row."""
    has = lambda x: (x != "") & F.coalesce(F.contains(code, x), F.lit(False))
    bare = lambda x: F.regexp_replace(x, "/+$", "")
    steps = [
        ("url", lambda e: has(e["u"]) | (e["u"].endswith("/") & has(bare(e["u"])))), ("route", lambda e: (bare(e["r"]) != "") & (has(e["r"]) | (e["r"].endswith("/") & has(bare(e["r"]))))),
        ("host_only", lambda e: has(e["host"])),
    ]
    one = lambda how, e: F.struct(F.lit(how).alias("how"), e["eid"].alias("eid"))
    options = [F.when(F.exists(ends, test), one(how, F.get(F.filter(ends, test), F.lit(0)))) for how, test in steps]
    first = F.get(ends, F.lit(0))
    return F.coalesce(*options, F.when(F.exists(hosts, has), one("host_only", first)), F.struct(F.lit("none").alias("how"), first["eid"].alias("eid")))


@query(FLAT + END.replace("WITH x", ", x", 1) + _DOCUMENTED + " SELECT ord, CASE min(pass) WHEN 1 THEN 'url' WHEN 2 THEN 'route' WHEN 3 THEN 'host_only' WHEN 4 THEN 'host_only' ELSE 'none' END AS how, arg_min(eid, (pass, pos, eid)) AS endpoint_id FROM m GROUP BY ord")
def documented_endpoint(spark, d):
    """The endpoint that each record's code names best: by address, by route, by host, else the first; records of undocumented APIs have none.

    An API's endpoints are one array, joined once, so a text moves once at most.
    """
    e = endpoints(spark, d)
    route = urls.route(F.col("route"))
    own = F.struct("pos", F.col("endpoint_id").alias("eid"), tx.text(F.col("url")).alias("u"), F.when(route != "", route).otherwise(urls.url_path(F.col("url"))).alias("r"), F.coalesce("host", F.lit("")).alias("host"))
    named = table(spark, d, "api_document").select("api_name", F.col("rapidapi_host").alias("host")).unionByName(e.select("api_name", "host"))
    hosts = named.where("host <> ''").groupBy("api_name").agg(F.collect_set("host").alias("hosts"))
    doc = e.groupBy("api_name").agg(F.array_sort(F.collect_list(own)).alias("ends")).join(hosts, "api_name", "left")
    c = _chosen(F.col("code"), F.col("ends"), F.coalesce("hosts", F.array().cast("array<string>")))
    j = heavy(spark, d, "api_name", "code").join(doc, "api_name", "left").withColumn("c", F.when(F.col("ends").isNotNull(), c))
    return j.select("ord", F.coalesce("c.how", F.lit("none")).alias("how"), F.col("c.eid").alias("endpoint_id"))


@query(FLAT + END.replace("WITH x", ", x", 1) + ", doc AS (SELECT api_name, count(*) AS n FROM ends GROUP BY 1), own AS (SELECT api_name, count(DISTINCT coalesce(endpoint_id,'')) AS n FROM flat GROUP BY 1) SELECT f.ord, coalesce(doc.n, own.n) AS candidates, doc.n IS NOT NULL AS documented FROM flat f LEFT JOIN doc ON f.api_name = doc.api_name LEFT JOIN own ON f.api_name = own.api_name")
def candidate_index(spark, d):
    """Candidates of each record: the documented ones, else those that records of the API name."""
    f = flat(spark, d)
    doc = endpoints(spark, d).groupBy("api_name").agg(F.count(F.lit(1)).alias("dn"))
    own = f.groupBy("api_name").agg(F.count_distinct(F.coalesce("endpoint_id", F.lit(""))).alias("on"))
    return f.select("ord", "api_name").join(doc, "api_name", "left").join(own, "api_name", "left").select("ord", F.coalesce("dn", "on").alias("candidates"), F.col("dn").isNotNull().alias("documented"))


@query(FLAT + "SELECT ord, coalesce(nullif(api_host,''), github.h1, github.h2, '') AS host FROM (SELECT f.*, {'h1': r.api_metadata.headers['x-rapidapi-host'], 'h2': r.api_metadata.headers['X-RapidAPI-Host']} AS github FROM flat f JOIN function_record r USING (ord))")
def host_fallback(spark, d):
    f = flat(spark, d)
    head = lambda k: F.try_element_at("headers", F.lit(k))
    return f.select("ord", F.coalesce(F.when(F.col("api_host") != "", F.col("api_host")), head("x-rapidapi-host"), head("X-RapidAPI-Host"), F.lit("")).alias("host"))


@query(FLAT + """SELECT ord, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(code_params,''), '["'']([A-Za-z_][A-Za-z0-9_.\\-]*)["'']\\s*:', 1))), ',') AS names FROM flat""")
def json_key_names(spark, d):
    return flat(spark, d).select("ord", F.array_join(F.array_sort(tx.json_keys_in_text(F.col("code_params"))), ",").alias("names"))


@query()
def documented_params(spark, d):
    """Names of documented parameters at any depth, of every record."""
    f = flat(spark, d)
    fields = [F.col(c) for c in ("params", "path_params", "header_params", "payload")]
    told = [F.when(F.col("params_source") == "documentation", F.col("params")), *fields[1:]]
    return f.select("ord", param_names(*fields).alias("flat_names"), collected_names(*told).alias("all_names"))


@query()
def json_walk(spark, d):
    """Every string in the JSON side fields with its place, headed by the field's name."""
    return flat(spark, d).select("ord", F.inline(side_strings({c: F.col(c) for c in SIDES})))


@query()
def comment_texts(spark, d):
    return flat(spark, d).select("ord", comments_text(F.col("comments")).alias("text"))


@query(FLAT + r"SELECT ord, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(function_name,''), '[_\-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g')) AS words, regexp_replace(regexp_replace(regexp_replace(coalesce(function_name,''), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake FROM flat")
def name_words(spark, d):
    f = flat(spark, d)
    # The SQL side keeps the case, as its lower() would come last anyway.
    x = F.regexp_replace(F.coalesce("function_name", F.lit("")), r"([a-z0-9])([A-Z])", "$1_$2")
    x = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return f.select("ord", tx.words(F.col("function_name")).alias("words"), x.alias("snake"))
