"""JSON, JSONL, CSV and Parquet in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _read(spark: SparkSession, schema: StructType | str | None):
    r = spark.read
    return r.schema(schema) if schema is not None else r


def json_array(spark: SparkSession, path: str, schema: StructType | str | None = None, *, lists_only: bool = False) -> DataFrame:
    """A file that holds one JSON list of objects; a broken file ends the read.  With ``lists_only`` (and a schema) a file that holds no list has no rows."""
    if lists_only:
        whole = spark.read.option("wholetext", True).text(path).where(F.ltrim("value").startswith("["))
        kind = schema.simpleString() if isinstance(schema, StructType) else f"struct<{schema}>"
        return whole.select(F.inline(F.from_json("value", f"array<{kind}>", {"mode": "FAILFAST"})))
    return _read(spark, schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None, *, tolerant: bool = False, missing_ok: bool = False) -> DataFrame:
    """One object a line, blank lines skipped; a broken row ends the read, or is left out when ``tolerant``.  A missing file has no rows with ``missing_ok`` (and a schema)."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return _read(spark, schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def folder(spark: SparkSession, path: str, schema: StructType | str, *, inner: str | None = None) -> DataFrame:
    """All JSON files of a folder with their names, unreadable ones skipped; ``inner`` unfolds a list in each."""
    df = spark.read.schema(schema).option("multiLine", True).option("ignoreCorruptFiles", True).option("mode", "DROPMALFORMED").json(f"{path}/*.json").withColumn("file", F.col("_metadata.file_name"))
    return df.select("file", F.inline(inner)) if inner else df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_available(spark: SparkSession, candidates: dict[str, list[str]], schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Of each source the first path that exists, reads and has rows; the union with ``source_machine``, and a status per path.

    Only the handful of paths is walked on the driver.
    """
    parts, status = None, []
    for name, paths in candidates.items():
        found = False
        for path in paths:
            if found:
                status.append((name, path, "skipped"))
                continue
            if not _exists(spark, path):
                status.append((name, path, "missing"))
                continue
            try:
                df = jsonl(spark, path, schema) if path.endswith(".jsonl") else json_array(spark, path, schema)
                some = bool(df.limit(1).count())
            except Exception:
                status.append((name, path, "error"))
                continue
            status.append((name, path, "ok" if some else "empty"))
            if some:
                found = True
                df = df.withColumn("source_machine", F.lit(name))
                parts = df if parts is None else parts.unionByName(df, allowMissingColumns=True)
    if parts is None:
        parts = spark.createDataFrame([], schema).withColumn("source_machine", F.lit(None).cast("string"))
    return parts, spark.createDataFrame(status, "source string, path string, status string")


def split_rows(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table partitioned by ``split``; the others are not read, and a split that is missing is an error."""
    if not _exists(spark, f"{path}/split={split}"):
        raise FileNotFoundError(f"no split {split} in {path}")
    return spark.read.parquet(path).where(F.col("split") == split)


def write_jsonl(df: DataFrame, path: str, *, append: bool = False) -> int:
    """Write one object a line and return the number of rows, counted as they pass."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append" if append else "overwrite").json(path)
    return seen.get["rows"]


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder per value; slashes in values become underscores."""
    df.withColumn(by, F.translate(by, "/", "_")).write.mode("overwrite").partitionBy(by).parquet(path)


def write_summary_csv(parts: list[DataFrame], path: str) -> None:
    """Rows of different columns as one CSV file under the sorted union of the headers."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.select(*sorted(out.columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_document(df: DataFrame, path: str, *, most: int = 100_000) -> None:
    """A small result as one indented JSON list; more than ``most`` rows are an error, as they belong in a table."""
    import json
    from pathlib import Path

    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2), encoding="utf-8")
