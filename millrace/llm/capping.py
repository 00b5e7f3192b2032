"""Limits on how many records each contributor keeps, best quality first.

Keys are sorted by range over the cluster, by contributor, descending score
and id, so that a contributor with a third of all rows lies in as many
partitions as its size needs.  The rows before a partition and the place
where the contributor that runs on from the partition before began are known
from one summary row per partition; they give each row's exact rank without
any group meeting in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import stage


def _positions(carried: list[str]):
    """(part, pos, who, local, ...): place in the sorted partition, and rank since the contributor began in it."""
    schema = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("who", pa.string()), ("local", pa.int64()), *((c, pa.int64()) for c in carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pos, last, since = 0, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            who = batch.column(0)
            change = np.ones(n, bool)
            change[1:] = np.asarray(pc.not_equal(who.slice(1), who.slice(0, n - 1)))
            change[0] = last is None or who[0].as_py() != last
            at = np.arange(pos, pos + n)
            start = np.maximum.accumulate(np.where(change, at, -1))
            start = np.where(start < 0, since, start)
            yield pa.record_batch([pa.array(np.full(n, part, np.int32)), pa.array(at), who, pa.array(at - start), *batch.columns[1:]], schema=schema)
            pos, last, since = pos + n, who[n - 1].as_py(), int(start[-1])

    return run, ", ".join(["part int, pos bigint, who string, local bigint", *(f"{c} bigint" for c in carried)])


def exact_ranks(df: DataFrame, ids: list[str], who: Column, score: Column, *, keep: list[str] | None = None) -> DataFrame:
    """``(ids..., keep..., rank)``, rank from 1, of the rows whose contributor is not null.

    Ids and kept columns are bigints.  Absent and NaN scores come last, then ids ascend.
    """
    s = F.when(F.isnan(score), F.lit(None)).otherwise(score.cast("double"))
    named = [*ids, *(keep or [])]
    keys = df.select(*[F.col(c).cast("bigint").alias(f"c{i}") for i, c in enumerate(named)], who.alias("who"), s.alias("score")).where("who is not null")
    cols = [f"c{i}" for i in range(len(named))]
    order = [F.col("who").asc(), F.col("score").desc_nulls_last(), *(F.col(c).asc() for c in cols[: len(ids)])]
    run, kind = _positions(cols)
    placed = stage(keys.repartitionByRange(*order).sortWithinPartitions(*order).select("who", *cols).mapInArrow(run, kind), "cap-placed")
    # One row per partition: its rows, and the contributor that ends it with the place where that one began in it.
    ends = placed.groupBy("part").agg(F.max(F.struct("pos", "who", "local")).alias("end"), F.min_by("who", "pos").alias("first")).orderBy("part").toArrow().to_pylist()
    carried, running, before = [], None, 0
    for e in ends:
        end = e["end"]
        carried.append((e["part"], e["first"], before if running is None or running[0] != e["first"] else running[1]))
        began = before + end["pos"] - end["local"]
        if running is None or running[0] != end["who"] or end["who"] != e["first"]:
            running = (end["who"], began)
        before += end["pos"] + 1
        carried[-1] += (before - end["pos"] - 1,)
    spark = df.sparkSession
    known = spark.createDataFrame(carried, "part int, first string, start bigint, offset bigint")
    # Global position less the contributor's start; only the partition's first contributor can have begun earlier.
    rank = F.when(F.col("who") == F.col("first"), F.col("offset") + F.col("pos") - F.col("start")).otherwise(F.col("local")) + 1
    return placed.join(F.broadcast(known), "part").select(*[F.col(c).alias(n) for c, n in zip(cols, named)], rank.alias("rank"))


def over_cap(df: DataFrame, id_col: str, score: Column, caps: list[tuple[Column, int]]) -> DataFrame:
    """``(id)`` of the rows beyond a cap of at least one contributor column; a null contributor has no cap.

    Ids must be unique.  All rankings run over all rows.  Equal scores are
    kept by ascending id.  An empty table gives an empty result.
    """
    dropped = None
    for who, cap in caps:
        d = exact_ranks(df, [id_col], who, score).where(F.col("rank") > cap).select(id_col)
        dropped = d if dropped is None else dropped.unionByName(d)
    return dropped.distinct()


def kept_within_share(df: DataFrame, id_col: str, score: Column, who: Column, share: float) -> DataFrame:
    """``(id)`` kept when a contributor may have at most ``share`` of the rows that have a contributor, at least one each."""
    ranks = exact_ranks(df, [id_col], who, score)
    total = df.where(who.isNotNull()).count()
    return ranks.where(F.col("rank") <= max(1, int(total * share))).select(id_col)
