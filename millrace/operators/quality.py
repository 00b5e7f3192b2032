"""Gates, checks and scores of code records."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import text
from millrace.functions.urls import url_path

# Tokens that the checks look for.
CALL_TOKENS = ("requests.", "urllib.", "httpx.", "http.client")
RESPONSE_TOKENS = (".json()", ".text", ".content", "response.status_code", "response[")
DATABASE_TOKENS = ("mysql", "sqlite", "cursor.", ".execute(", "psycopg2", "pymongo")
ANSWER_TOKENS = (".json()", ".text", ".content", "status_code", "raise_for_status()")
AUTO_TOKENS = ("toolbench_rapidapi_key", "ToolBench", "ToolDial", "ToolEyes", "auto-generated", "automatically generated", "generated by", "code generator", "This code was generated", "Auto-generated code")
AUTO_NAMES = ("var", "temp", "result", "param")
# Weights of the score.
WEIGHTS = {"syntax": 30, "call": 25, "response": 20, "error": 10, "comments": 15, "docstring": 10, "database": -30, "indent": -20, "no_import": -10}


def any_token(c: Column, tokens: tuple[str, ...], *, fold: bool = False) -> Column:
    x = F.lower(c) if fold else c
    return F.coalesce(reduce(or_, [F.contains(x, F.lit(t.lower() if fold else t)) for t in tokens]), F.lit(False))


def comment_lines(code: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(code, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.size(F.filter(trimmed, lambda x: x.startswith("#") & ~x.startswith("#!")))


def line_count(code: Column) -> Column:
    return F.size(F.split(F.coalesce(code, F.lit("")), "\n"))


def checks(code: Column) -> dict[str, Column]:
    """The checks that regular expressions decide; validity and docstrings need a parser."""
    c = F.coalesce(code, F.lit(""))
    return {
        "has_imports": c.rlike(r"(?m)^\s*import\s+|^\s*from\s+"),
        "has_api_call": any_token(c, CALL_TOKENS),
        "has_response_handling": any_token(c, RESPONSE_TOKENS),
        "has_error_handling": F.contains(c, F.lit("try:")) & F.contains(c, F.lit("except")),
        "has_database_call": any_token(c, DATABASE_TOKENS),
        "has_indentation_issue": c.rlike(r"(?m)^[ \t]+def "),
        "comment_lines": comment_lines(c),
    }


def auto_generated(code: Column, repo: Column, *, strict_names: bool = False) -> Column:
    """Whether code or repository hold a generator's phrase; numbered variable names count on request."""
    said = any_token(code, AUTO_TOKENS, fold=True) | any_token(repo, AUTO_TOKENS, fold=True)
    return said | code.rlike(rf"\b(?:{'|'.join(AUTO_NAMES)})\d{{2,}}\b") if strict_names else said


def comment_score(n_comments: Column, docstring: Column) -> Column:
    return F.least(n_comments * 2, F.lit(WEIGHTS["comments"])) + F.when(F.coalesce(docstring, F.lit(False)), WEIGHTS["docstring"]).otherwise(0)


def quality_score(*, valid: Column, call: Column, response: Column, error: Column, loc: Column, stars: Column, n_comments: Column, docstring: Column, imports: Column, database: Column, indentation: Column) -> Column:
    """0 to 100; a missing check counts as failed, missing stars as none."""
    on = lambda c, w: F.when(F.coalesce(c, F.lit(False)), float(w)).otherwise(0.0)
    s = F.coalesce(stars, F.lit(0))
    length = F.when(loc < 10, 0.0).when(loc <= 30, 5.0).when(loc <= 50, 10.0).otherwise(8.0)
    fame = F.when(s >= 100, 5.0).when(s >= 10, 3.0).when(s >= 1, 1.5).otherwise(0.0)
    total = (
        on(valid, WEIGHTS["syntax"]) + on(call, WEIGHTS["call"]) + on(response, WEIGHTS["response"]) + on(error, WEIGHTS["error"]) + length + fame
        + F.least(comment_score(F.coalesce(n_comments, F.lit(0)), docstring), F.lit(WEIGHTS["comments"]))
        + on(database, WEIGHTS["database"]) + on(indentation, WEIGHTS["indent"]) + F.when(F.coalesce(imports, F.lit(False)), 0.0).otherwise(float(WEIGHTS["no_import"]))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def gate_reason(least: Column, *, score: Column, valid: Column, call: Column, database: Column, indentation: Column, code: Column, host: Column) -> Column:
    """First test that a record fails, in fixed order, or ``ok``; an empty host skips the last test."""
    no, yes = (lambda c: ~F.coalesce(c, F.lit(False))), (lambda c: F.coalesce(c, F.lit(False)))
    h = text(host)
    return (
        F.when(F.coalesce(score, F.lit(0.0)) < least, "score_below_threshold").when(no(valid), "invalid_syntax").when(no(call), "no_api_call")
        .when(yes(database), "database_call").when(yes(indentation), "indentation_issue")
        .when((h != "") & ~F.coalesce(F.contains(code, h), F.lit(False)), "host_not_in_code").otherwise("ok")
    )


def adaptive_threshold(df: DataFrame, passes: str, score: str, target: int, high: float, low: float) -> DataFrame:
    """Rows that pass with ``high``, or with ``low`` where those are fewer than ``target``; the count is a scalar subquery in one plan."""
    count = df.agg(F.count_if(F.col(passes) & (F.col(score) >= high)).alias("__n")).scalar()
    return df.where(F.col(passes) & (F.col(score) >= F.when(count < target, low).otherwise(high)))


def match_type(existing: Column, code: Column, url: Column, route: Column, host: Column, headers: Column | None = None) -> Column:
    """How code names a documented endpoint; a known existing value stays.

    A missing route is the address's path, a missing host the one in the headers.
    """
    has = lambda x: (F.coalesce(x, F.lit("")) != "") & F.coalesce(F.contains(code, x), F.lit(False))
    filled = lambda x: F.when(x != "", x)
    route = F.coalesce(filled(route), url_path(url))
    if headers is not None:
        host = F.coalesce(filled(host), filled(F.try_element_at(headers, F.lit("x-rapidapi-host"))), F.try_element_at(headers, F.lit("X-RapidAPI-Host")))
    return (
        F.when(existing.isin("url", "route", "host_only", "none"), existing).when(has(url), "url")
        .when(has(route) & (route != "/"), "route").when(has(host), "host_only").otherwise("none")
    )
