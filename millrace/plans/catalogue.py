"""The registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import answers, apis, evals, fields, records, relational, tables, texts  # noqa: F401  (they register their queries)
from millrace.plans.registry import QUERIES, SQL, Query


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Kept records, five best per repository, reported by match and source."""
    kept = records.quality_kept(spark, d)
    best = records.rank_top_per_group(spark, d).join(kept, "ord", "left_semi")
    return (
        records.flat(spark, d).join(best.select("ord"), "ord", "left_semi").groupBy(F.coalesce("match", F.lit("unknown")).alias("match"), F.coalesce("source_machine", F.lit("unknown")).alias("machine"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 2).alias("avg_score"), F.count_distinct("api_name").alias("apis"))
    )


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
