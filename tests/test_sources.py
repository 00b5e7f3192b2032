"""Files in and out, and incremental runs."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.streaming import incremental, windows


def test_json_and_jsonl(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1, "v": "x"}, {"k": 2}]))
    assert files.json_array(spark, str(tmp_path / "a.json"), "k bigint, v string").count() == 2
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert files.jsonl(spark, str(tmp_path / "b.jsonl"), "k bigint").count() == 2
    (tmp_path / "c.jsonl").write_text('{"k": 1}\nbroken\n')
    with pytest.raises(Exception):
        files.jsonl(spark, str(tmp_path / "c.jsonl"), "k bigint").collect()
    assert files.jsonl(spark, str(tmp_path / "c.jsonl"), "k bigint", tolerant=True).select("k").collect()[0].k == 1


def test_first_available(spark, tmp_path):
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "good.json").write_text('[{"k": 7}]')
    rows, status = files.first_available(spark, {"m1": [str(tmp_path / x) for x in ("none.json", "empty.json", "good.json", "later.json")]}, "k bigint")
    assert [(r.k, r.source_machine) for r in rows.collect()] == [(7, "m1")]
    assert [r.status for r in status.collect()] == ["missing", "empty", "ok", "skipped"]


def test_folder_and_partitions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text(json.dumps({"category": "c", "apis": [{"n": "a"}, {"n": "b"}]}))
    (tmp_path / "in/bad.json").write_text("{")
    df = files.folder(spark, str(tmp_path / "in"), "category string, apis array<struct<n: string>>", inner="apis")
    assert {r.n for r in df.where("n is not null").collect()} == {"a", "b"}
    out = str(tmp_path / "out")
    files.write_partitioned(spark.createDataFrame([("a/b", 1), ("c", 2)], "split string, v int"), out, "split")
    assert [r.v for r in files.split_rows(spark, out, "a_b").collect()] == [1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a bigint, b string")
    assert files.write_jsonl(df, str(tmp_path / "j")) == 2
    assert files.write_jsonl(df, str(tmp_path / "j"), append=True) == 2
    assert files.jsonl(spark, str(tmp_path / "j"), "a bigint, b string").count() == 4
    files.write_summary_csv([df, df.select("a", F.lit(1).alias("c"))], str(tmp_path / "csv"))
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "csv")).columns) == ["a", "b", "c"]
    files.write_json_document(df, str(tmp_path / "d/x.json"))
    assert json.loads((tmp_path / "d/x.json").read_text())[0] == {"a": 1, "b": "x"}


def test_incremental(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    schema = spark.createDataFrame([], "id string, v bigint").schema
    (src / "1.json").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 2}\n{"id": "a", "v": 1}\n')
    incremental.append_new(spark, str(src), schema, out, cp, ["id"])
    assert spark.read.parquet(out).count() == 2
    (src / "2.json").write_text('{"id": "b", "v": 9}\n{"id": "c", "v": 3}\n')
    incremental.append_new(spark, str(src), schema, out, cp, ["id"])
    incremental.append_new(spark, str(src), schema, out, cp, ["id"])
    assert {(r.id, r.v) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:59:00", "x"), ("2024-01-01 01:10:00", "y")], "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k")
    rows.write.parquet(str(tmp_path / "ev"))
    want = {(r.window_start, r.k, r.n) for r in windows.tumbling(rows, "ts", "1 hour", ["k"], [F.count(F.lit(1)).alias("n")]).collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    q = windows.tumbling(stream, "ts", "1 hour", ["k"], [F.count(F.lit(1)).alias("n")]).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.window_start, r.k, r.n) for r in spark.table("win").collect()} == want


def test_odd_sources(spark, tmp_path):
    (tmp_path / "list.json").write_text(' [{"k": 1}, {"k": 2}]')
    (tmp_path / "object.json").write_text('{"k": 1}')
    read = lambda name: [r.k for r in files.json_array(spark, str(tmp_path / name), "k bigint", lists_only=True).collect()]
    assert read("list.json") == [1, 2] and read("object.json") == []
    assert files.jsonl(spark, str(tmp_path / "none.jsonl"), "k bigint", missing_ok=True).count() == 0
    files.write_partitioned(spark.createDataFrame([(1, "a")], "v int, split string"), str(tmp_path / "parts"), "split")
    with pytest.raises(FileNotFoundError):
        files.split_rows(spark, str(tmp_path / "parts"), "b")


def test_distinct_stream(spark, tmp_path):
    from millrace.streaming.incremental import distinct_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": "a", "t": "2024-01-01T00:00:00", "v": 1}\n{"k": "b", "t": "2024-01-01T00:00:01", "v": 2}\n{"k": "a", "t": "2024-01-01T00:00:02", "v": 3}\n')
    stream = spark.readStream.schema("k string, t timestamp, v int").json(str(tmp_path / "in"))
    for part in ("", '{"k": "b", "t": "2024-01-01T00:00:03", "v": 4}\n{"k": "c", "t": "2024-01-01T00:00:04", "v": 5}\n'):
        if part:
            (tmp_path / "in" / "b.json").write_text(part)
        q = distinct_stream(stream, ["k"], "t", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
