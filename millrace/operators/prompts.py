"""Ground truth, context levels and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import urls
from millrace.functions.jsonvals import param_names

LEVELS = ("C0", "C1", "C2", "C3", "C4")


def contexts(df: DataFrame) -> DataFrame:
    """Each row once for each context level."""
    return df.withColumn("context", F.explode(F.array(*map(F.lit, LEVELS))))


def task_hint(function_name: Column, endpoint_name: Column, doc_line: Column) -> Column:
    """Words of the function's name, the endpoint's name and the documentation's first line, once each whatever their case."""
    parts = F.filter(F.array(tx.words(function_name), tx.text(endpoint_name), tx.text(doc_line)), lambda x: x != "")
    first = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return F.array_join(first, " | ")


def ground_truth(df: DataFrame) -> DataFrame:
    """What an answer is compared with, from the flat record."""
    return df.select(
        "ord", "sample_id", tx.text(F.col("api_host")).alias("host"), tx.text(F.col("url")).alias("url"), urls.method(F.col("method")).alias("method"), urls.route(F.col("route")).alias("route"),
        tx.text(F.col("endpoint_name")).alias("endpoint_name"), F.coalesce("endpoint_id", F.lit("")).alias("endpoint_id"), F.coalesce("match", F.lit("none")).alias("match"),
    )


def _headers(host: Column) -> Column:
    return F.concat(F.lit("\nHeaders: x-rapidapi-host is "), host, F.lit(", x-rapidapi-key is given by the caller"))


def context_docs(df: DataFrame) -> DataFrame:
    """What each level tells but for the parameters, which ``codegen_prompts`` has."""
    g = contexts(ground_truth(df))
    i = F.substr("context", F.lit(2)).cast("int")
    from2 = F.concat(F.lit("\nEndpoint: "), "method", F.lit(" "), "route", F.lit("\nURL: "), "url", F.lit("\nName: "), "endpoint_name")
    docs = F.concat(F.when(i >= 1, F.concat(F.lit("Host: "), "host")).otherwise(""), F.when(i >= 2, from2).otherwise(""), F.when(i >= 3, _headers(F.col("host"))).otherwise(""), F.when(i >= 4, "\nDependency: requests").otherwise(""))
    return g.select("ord", "context", docs.alias("docs"))


def codegen_prompts(df: DataFrame) -> DataFrame:
    """``(ord, context, prompt)``: the task, what the level tells of host, endpoint, headers, parameters and dependency, and the rules of an answer.

    ``df`` has the ground truth, ``api_name``, ``function_name``, ``hint``,
    ``gold`` (parameter names) and ``source`` (where they come from).
    """
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    name = F.when(F.col("function_name") != "", F.col("function_name")).otherwise("call_service")
    listed = F.when(F.size("gold") > 0, F.array_join("gold", ", ")).otherwise("none known")
    level = F.substr("context", F.lit(2)).cast("int")
    told = [
        (0, F.lit("Write one Python function that calls the API. Answer with code alone, without fences or explanation.")), (0, line("Function", name)), (0, line("API", F.col("api_name"))),
        (0, line("Task", F.when(F.col("hint") != "", F.col("hint")).otherwise(tx.words(name)))), (1, line("Host", F.col("host"))), (2, line("URL", F.col("url"))), (2, line("Route", F.col("route"))),
        (2, line("Method", F.col("method"))), (2, line("Name", F.when(F.col("endpoint_name") != "", F.col("endpoint_name")).otherwise("unknown"))), (3, F.substr(_headers(F.col("host")), F.lit(2))),
        (3, F.concat(F.lit("Parameters ("), "source", F.lit("): "), listed)), (4, F.lit("Dependency: requests or another direct HTTP client")),
        (0, F.lit("Do not call the API now. Build the request and return the parsed or raw response. Take the key from an argument or the environment. Send the host as a header where it is known.")),
    ]
    return contexts(df).select("ord", "context", F.concat_ws("\n", *[F.when(level >= least, text) for least, text in told]).alias("prompt"))


def candidates(df: DataFrame, ends: DataFrame) -> DataFrame:
    """``(api_name, ends)``: the endpoints of each API, the documented ones, else those that records of the API name; one each of id, method and route.

    An endpoint without an id goes by one that its API, method and route determine.
    """

    def shaped(x: DataFrame, *fields: str) -> DataFrame:
        m, r, api = urls.method(F.col("method")), urls.route(F.col("route")), tx.text(F.col("api_name"))
        own = F.coalesce(F.when(tx.text(F.col("endpoint_id")) != "", tx.text(F.col("endpoint_id"))), tx.stable_id(api, m, r))
        return x.select(api.alias("api_name"), own.alias("cid"), m.alias("m"), r.alias("r"), tx.text(F.col("endpoint_name")).alias("name"), param_names(*[F.col(c) for c in fields]).alias("params"))

    doc = shaped(ends.dropDuplicates(["api_name", "endpoint_id", "method", "route"]), "params", "path_params", "payload")
    rest = df.join(doc.select("api_name").distinct(), "api_name", "left_anti")
    named = shaped(rest.dropDuplicates(["api_name", "endpoint_id", "method", "route"]), "params", "path_params", "header_params", "payload")
    one = doc.unionByName(named).where("api_name <> ''").groupBy("api_name", "cid", "m", "r").agg(F.min(F.struct("name", "params")).alias("x"))
    return one.groupBy("api_name").agg(F.array_sort(F.collect_list(F.struct("cid", "m", "r", F.col("x.name").alias("name"), F.col("x.params").alias("params")))).alias("ends"))


def endpoint_prompts(df: DataFrame, ends: DataFrame, *, most: int = 10) -> DataFrame:
    """``(ord, label, endpoint_id, is_target, line)``: each record's endpoint among up to ``most - 1`` others of its API, in an order that record and endpoint determine.

    Records matched by host alone have none, as have those with fewer than two
    candidates.  An endpoint that is not among its API's is added.  Everything
    is chosen within the row from one array of the API's endpoints.
    """
    g = df.where(F.coalesce("match", F.lit("")) != "host_only").select(
        "ord", tx.text(F.col("api_name")).alias("api_name"), tx.text(F.col("endpoint_id")).alias("gid"), urls.method(F.col("method")).alias("gm"), urls.route(F.col("route")).alias("gr"), tx.text(F.col("endpoint_name")).alias("gname")
    )
    j = g.join(candidates(df, ends), "api_name")
    is_target = lambda e: (e["cid"] == F.col("gid")) | ((e["m"] == F.col("gm")) & (e["r"] == F.col("gr")))
    missing = F.struct(
        F.coalesce(F.when(F.col("gid") != "", F.col("gid")), tx.stable_id(F.col("api_name"), F.col("gm"), F.col("gr"))).alias("cid"), F.col("gm").alias("m"), F.col("gr").alias("r"), F.col("gname").alias("name"),
        F.array().cast("array<string>").alias("params"),
    )
    j = j.withColumn("target", F.coalesce(F.get(F.filter("ends", is_target), F.lit(0)), missing))
    mixed = lambda e, hit: F.struct(F.xxhash64(F.col("ord"), e["cid"], e["m"], e["r"]).alias("h"), F.lit(hit).alias("hit"), e.alias("e"))
    others = F.slice(F.array_sort(F.transform(F.filter("ends", lambda e: ~is_target(e)), lambda e: mixed(e, False))), 1, most - 1)
    j = j.withColumn("shown", F.array_sort(F.concat(F.array(mixed(F.col("target"), True)), others))).where(F.size("shown") > 1)
    listed = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise("none known")

    def shown(x: Column, i: Column) -> Column:
        e, label = x["e"], F.concat(F.lit("E"), (i + 1).cast("string"))
        line = F.concat(label, F.lit(". endpoint_id="), e["cid"], F.lit(" | method="), e["m"], F.lit(" | route="), e["r"], F.lit(" | name="), e["name"], F.lit(" | params="), listed(e["params"]))
        return F.struct(label.alias("label"), e["cid"].alias("endpoint_id"), x["hit"].alias("is_target"), line.alias("line"))

    return j.select("ord", F.inline(F.transform("shown", shown)))
