"""Queries that write to the shared folder by one of the sinks and read back by one of the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.dedupe import first_wins
from millrace.plans.records import FLAT, flat
from millrace.plans.registry import query
from millrace.runtime import scratch, table
from millrace.sources import files
from millrace.streaming.incremental import open_rows

_KIND = "ord bigint, sample_id string, api_name string, code string, score double"
_ROWS = "SELECT ord, sample_id, api_name, src AS code, score FROM flat"


def _rows(spark, d):
    return flat(spark, d).select("ord", "sample_id", "api_name", "code", "score")


@query(FLAT + _ROWS)
def jsonl_round_trip(spark, d):
    """Records written one object a line and read again."""
    path = scratch(spark, "io-jsonl")
    files.write_jsonl(_rows(spark, d), path)
    return files.jsonl(spark, path, _KIND).select("ord", "sample_id", "api_name", "code", "score")


@query("SELECT split, count(*) AS n, sum(length(text))::BIGINT AS chars FROM eval_item GROUP BY 1")
def split_round_trip(spark, d):
    """A table partitioned by split, of which each split is read alone."""
    path = scratch(spark, "io-splits")
    files.write_partitioned(table(spark, d, "eval_item"), path, "split")
    parts = [files.split_rows(spark, path, s).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")) for s in ("test", "validation")]
    return parts[0].unionByName(parts[1])


@query(FLAT + "SELECT 'first' AS source_machine, count(*) AS n, count(DISTINCT ord) AS ords FROM flat UNION ALL SELECT 'second', count(*), count(DISTINCT ord) FROM flat WHERE score >= 90")
def first_source(spark, d):
    """Of two sources the first path that exists and has rows: one lacks its first path, one has an empty file there."""
    a, b, empty = (scratch(spark, "io-source") + ".jsonl" for _ in range(3))
    files.write_jsonl(_rows(spark, d), a)
    files.write_jsonl(_rows(spark, d).where("score >= 90"), b)
    files.write_jsonl(_rows(spark, d).limit(0), empty)
    rows, _ = files.first_available(spark, {"first": [a + ".none", a], "second": [empty, b]}, _KIND)
    return rows.groupBy("source_machine").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("ords"))


@query("SELECT count(*) AS n, count(DISTINCT sample_id) AS ids FROM (SELECT DISTINCT sample_id FROM function_record WHERE sample_id IS NOT NULL)")
def append_round_trip(spark, d):
    """Ids appended in two runs, the second with what the first had, too; none stands twice."""
    path = scratch(spark, "io-append")
    ids = first_wins(flat(spark, d).where("sample_id is not null").select("sample_id", "ord"), [F.col("sample_id")], F.col("ord"))
    files.write_jsonl(ids.where("ord % 3 = 0"), path)
    done = files.jsonl(spark, path, "sample_id string, ord bigint")
    files.write_jsonl(open_rows(ids, done, ["sample_id"]), path, append=True)
    return files.jsonl(spark, path, "sample_id string, ord bigint").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("ids"))


@query("SELECT ord AS doc_id, sample_id FROM function_record WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ord) = 1")
def restored_union(spark, d):
    """Rows of a JSON-lines backup and of a table restored as one, the first of each id."""
    path = scratch(spark, "io-backup")
    own = flat(spark, d).where("sample_id is not null").select("ord", "sample_id")
    files.write_jsonl(own.where("ord % 2 = 0"), path)
    both = files.jsonl(spark, path, "ord bigint, sample_id string").unionByName(own.where("ord % 2 = 1")).unionByName(own.where("ord % 5 = 0"))
    return first_wins(both, [F.col("sample_id")], F.col("ord")).select(F.col("ord").alias("doc_id"), "sample_id")


@query("SELECT source AS name, count(*) AS n, NULL::VARCHAR AS unit FROM documents WHERE source IS NOT NULL GROUP BY 1 UNION ALL SELECT event_type, NULL, 'event' FROM events GROUP BY 1")
def summary_csv(spark, d):
    """Summaries of different columns in one CSV file, read again."""
    path = scratch(spark, "io-csv")
    a = table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct().withColumn("unit", F.lit("event"))
    files.write_summary_csv([a, b], path)
    return spark.read.option("header", True).schema("n bigint, name string, unit string").csv(path)
