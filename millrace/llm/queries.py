"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.identity import host_name, repo_name, strip
from millrace.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, d: str, *more: str) -> DataFrame:
    df = table(spark, d, "function_record").select("ord", *[F.col(c).alias(c.rpartition(".")[2]) for c in more])
    return spread(df, "ord") if "code.complete_function" in more else df


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _splits(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.splits import group_splits

    df = _records(spark, d, "api_host", "github_info.repo", "language")
    return group_splits(df, "ord", host_name(F.col("api_host")), repo_name(F.col("repo")), F.lower(strip(F.col("language"))))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).where("group_host is not null").select("ord", "group_host")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).select("ord", "split")


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and groups that each split got."""
    return _splits(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("group").alias("n_groups"))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.documented_functions import documented

    return documented(_records(spark, d, "code.complete_function"), "ord", "complete_function")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _functions(spark, d).select("ord", "func_name").distinct()


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of code and description themselves."""
    return _functions(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.near_duplicates import similar_pairs

    df = _records(spark, d, "code.complete_function")
    return similar_pairs(df, "ord", "complete_function", words=3, similarity="0.7").select(F.col("id_a").alias("ord_a"), F.col("id_b").alias("ord_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of links of each record, five words and 0.8."""
    from millrace.llm.near_duplicates import class_links

    df = _records(spark, d, "code.complete_function")
    return class_links(df, "ord", "complete_function")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group of each record: linked by pairs of p3_found, directly or through others."""
    from millrace.llm.near_duplicates import similar_groups

    return similar_groups(_records(spark, d, "code.complete_function"), "ord", "complete_function", words=3, similarity="0.7")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_kinds(spark, d).select("ord")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """With the evidence that told each record apart."""
    from millrace.llm.not_handwritten import file_kinds

    df = _records(spark, d, "code.complete_function", "github_info.file_path", "github_info.repo")
    return file_kinds(df, "ord", F.col("complete_function"), F.col("file_path"), F.col("repo"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.credentials import credentials

    return credentials(_records(spark, d, "code.complete_function"), "ord", "complete_function").select("ord", "secret").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every record's code with its credentials masked."""
    from millrace.llm.credentials import redacted

    return redacted(_records(spark, d, "code.complete_function"), "ord", "complete_function")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.capping import over_cap

    df = _records(spark, d, "api_host", "github_info.repo", "quality_metrics.code_quality_score")
    caps = [(host_name(F.col("api_host")), 20), (repo_name(F.col("repo")), 5)]
    return over_cap(df, "ord", F.col("code_quality_score"), caps)


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """The records that stay, with their host and repository."""
    kept = _records(spark, d, "api_host", "github_info.repo").join(p6_found(spark, d), "ord", "left_anti")
    return kept.select("ord", host_name(F.col("api_host")).alias("host"), repo_name(F.col("repo")).alias("repo"))


def _copies(spark: SparkSession, d: str):
    from millrace.llm.format_duplicates import copies

    df = _records(spark, d, "function_name", "github_info.file_path", "code.complete_function")
    return copies(df, "ord", "function_name", "file_path", "complete_function")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[1].select(F.col("first_id").alias("first_ord"), F.col("id").alias("ord"))


def p7_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The record kept of each group and its number of copies."""
    return _copies(spark, d)[0].select(F.col("first_id").alias("ord"), "copies")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.packing import pack

    return pack(_documents(spark, d), "doc_id", "text", capacity=2048)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.leakage import leaked_items

    return leaked_items(_documents(spark, d), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "text", window=13)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("verbatim > 0").select("doc_id", "item_id")


def p9_templates(spark: SparkSession, d: str) -> DataFrame:
    """Items met with other numbers, names or units."""
    return _leaks(spark, d)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.shared_spans import shared_chars

    return shared_chars(_documents(spark, d), "doc_id", "text", length=200)


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """The shared stretches themselves."""
    from millrace.llm.shared_spans import shared_spans

    return shared_spans(_documents(spark, d), "doc_id", "text", length=200)


_TRIM = r"regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g')".replace("\\\\", "\\")
_HOST = f"nullif(regexp_replace(regexp_replace(regexp_replace({_TRIM.format('api_host')}, '^([a-z][a-z0-9+.-]*:)?//', ''), '[/?#].*$', ''), '(:[0-9]*)?[.]*(:[0-9]*)?$', ''), '')"
_REPO = f"nullif(regexp_replace(regexp_replace(regexp_replace({_TRIM.format('github_info.repo')}, '^[a-z][a-z0-9+.-]*://[^/]*/+', ''), '^/+|/+$', '', 'g'), '([.]git)+$', ''), '')"
_NAMED = f"WITH RECURSIVE r AS (SELECT ord, {_HOST} AS h, {_REPO} AS p, quality_metrics.code_quality_score AS s FROM function_record)"
_PAIRS = """w AS (SELECT ord, regexp_extract_all(lower(code.complete_function), '[a-z0-9_]+') AS w FROM function_record),
 s AS (SELECT DISTINCT ord, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS t FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)), n AS (SELECT ord, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.ord AS x, b.ord AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.ord < b.ord GROUP BY 1, 2),
 pairs AS (SELECT c.x AS ord_a, c.y AS ord_b FROM c JOIN n p ON p.ord = c.x JOIN n q ON q.ord = c.y WHERE 10 * c.k >= 7 * (p.n + q.n - c.k))"""
_SHARED = """WITH w AS (SELECT doc_id, k, md5(substr(text, k, 200)) AS g FROM documents, LATERAL (SELECT unnest(range(1, length(text) - 198)) AS k) WHERE length(text) >= 200),
 s AS (SELECT g FROM w GROUP BY g HAVING min(doc_id) <> max(doc_id)), c AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM w WHERE g IN (SELECT g FROM s))"""
SQL = {
    "p1_found": _NAMED + """, e AS (SELECT DISTINCT 'h ' || h AS a, 'r ' || p AS b FROM r WHERE h IS NOT NULL AND p IS NOT NULL), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach(node, root) AS (SELECT DISTINCT 'h ' || h, 'h ' || h FROM r WHERE h IS NOT NULL UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.node),
 g AS (SELECT node, min(root) AS root FROM reach GROUP BY 1) SELECT r.ord, substr(g.root, 3) AS group_host FROM r JOIN g ON g.node = coalesce('h ' || r.h, 'r ' || r.p)""",
    "p3_found": "WITH " + _PAIRS + " SELECT ord_a, ord_b FROM pairs",
    "p3_groups": "WITH RECURSIVE " + _PAIRS + """, sym AS (SELECT ord_a AS a, ord_b AS b FROM pairs UNION ALL SELECT ord_b, ord_a FROM pairs), reach(node, root) AS (SELECT ord, ord FROM function_record UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.node AND sym.b > reach.root),
 g AS (SELECT node AS ord, min(root) AS group_id FROM reach GROUP BY 1) SELECT ord, group_id, count(*) OVER (PARTITION BY group_id) AS members FROM g""",
    "p3_classes": """WITH w AS (SELECT ord, coalesce(regexp_extract_all(lower(code.complete_function), '[a-z0-9_]+'), []) AS w FROM function_record),
 t AS (SELECT ord, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS s FROM w),
 c AS (SELECT s, min(ord) AS class_id, count(*) AS copies FROM t WHERE s IS NOT NULL GROUP BY s), x AS (SELECT class_id, len(s) AS n, unnest(s) AS g FROM c),
 k AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2), l AS (SELECT a, count(*) AS links FROM k WHERE 10 * k >= 8 * (na + nb - k) GROUP BY 1)
 SELECT t.ord, c.class_id, coalesce(c.copies, 1) AS copies, coalesce(l.links, 0) AS links FROM t LEFT JOIN c ON t.s = c.s LEFT JOIN l ON l.a = c.class_id""",
    "p6_kept": _NAMED + """, k AS (SELECT ord, h, p, row_number() OVER (PARTITION BY h ORDER BY s DESC NULLS LAST, ord) AS i, row_number() OVER (PARTITION BY p ORDER BY s DESC NULLS LAST, ord) AS j FROM r)
 SELECT ord, h AS host, p AS repo FROM k WHERE NOT ((h IS NOT NULL AND i > 20) OR (p IS NOT NULL AND j > 5))""",
    "p6_found": _NAMED + """, k AS (SELECT ord, h, p, row_number() OVER (PARTITION BY h ORDER BY s DESC NULLS LAST, ord) AS i, row_number() OVER (PARTITION BY p ORDER BY s DESC NULLS LAST, ord) AS j FROM r)
 SELECT ord FROM k WHERE (h IS NOT NULL AND i > 20) OR (p IS NOT NULL AND j > 5)""",
    "p9_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_item),
 dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+12], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS k)), iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+12], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS k))
 SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""".replace("\\\\", "\\"),
    "p10_found": _SHARED + " SELECT doc_id, sum(CASE WHEN prev IS NULL OR k - prev >= 200 THEN 200 ELSE k - prev END)::BIGINT AS shared_chars FROM c GROUP BY 1",
    "p10_spans": _SHARED + ", r AS (SELECT doc_id, k, sum(CASE WHEN prev IS NULL OR k - prev > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c) SELECT doc_id AS doc, min(k) - 1 AS start, max(k) + 199 AS stop FROM r GROUP BY doc_id, run",
}


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
