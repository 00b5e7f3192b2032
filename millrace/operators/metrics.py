"""Set measures, pass@k, hit@k and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_prf(pred: Column, gold: Column) -> Column:
    """Precision, recall and F1 of two sets of names.

    Names match without regard to case, counts are of the raw distinct names;
    without gold the measures are null.
    """
    p, g = (F.array_distinct(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda y: y.isNotNull())) for x in (pred, gold))
    low = lambda x: F.array_distinct(F.transform(x, lambda y: F.lower(y)))
    tp, np_, ng = F.size(F.array_intersect(low(p), low(g))), F.size(p), F.size(g)
    precision = F.when(ng == 0, F.lit(None)).when(np_ == 0, 0.0).otherwise(tp / np_)
    recall = F.when(ng > 0, tp / ng)
    f1 = F.when(ng > 0, F.when((np_ == 0) | (tp == 0), 0.0).otherwise(2 * (tp / np_) * (tp / ng) / ((tp / np_) + (tp / ng))))
    return F.struct(precision.cast("double").alias("precision"), recall.cast("double").alias("recall"), f1.cast("double").alias("f1"),
                    ng.alias("gold_count"), np_.alias("pred_count"), tp.alias("true_positive"))


def pass_at_k(df: DataFrame, id_col: str, passed: str, ks: list[int]) -> DataFrame:
    """``(k, samples, pass_at_k)`` in per cent: mean over samples with n >= k of 1 - C(n-c,k)/C(n,k)."""
    per = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(passed), F.lit(False))).alias("c"))
    each = per.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    missed = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0.0), (F.col("n") - F.col("c") - i).cast("double")) / (F.col("n") - i))
    est = F.when(F.col("n") >= F.col("k"), 1 - missed)
    return each.groupBy("k").agg(F.count(est).alias("samples"), F.round(F.coalesce(F.avg(est), F.lit(0.0)) * 100, 2).alias("pass_at_k"))


def bool_mean(c: Column) -> Column:
    return F.avg(c.cast("int"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the score interval; null without trials."""
    p = hits / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, *, block: int = 4096) -> DataFrame:
    """``(query_id, corpus_id, score, rank)``: the k rows of the corpus with the largest dot product, ties by id.

    A stated query set against the whole corpus: the queries, in blocks of a
    checked size, go to the tasks that scan the corpus, each of which keeps its
    best k; the rest merges them.  Vectors are ``(id, embedding)``.
    """
    import numpy as np
    import pyarrow as pa

    spark = corpus.sparkSession
    schema = pa.schema([("query_id", pa.int64()), ("corpus_id", pa.int64()), ("score", pa.float64())])
    kind = "query_id bigint, corpus_id bigint, score double"

    def scan(shared):
        def run(batches):
            ids, q = shared.value
            best: tuple | None = None
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                cid = np.asarray(batch.column(0), np.int64)
                flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
                s = q @ flat.T
                c = np.broadcast_to(cid, s.shape)
                if best is not None:
                    s, c = np.concatenate([best[0], s], axis=1), np.concatenate([best[1], c], axis=1)
                o = np.lexsort((c, -np.round(s, 9)), axis=1)[:, :k]
                best = np.take_along_axis(s, o, 1), np.take_along_axis(c, o, 1)
            if best is not None:
                n = best[0].shape[1]
                yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(best[1].ravel()), pa.array(best[0].ravel())], schema=schema)

        return run

    out = None
    total = queries.count()
    blocks = max(1, -(-total // block))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks))
    for b in range(blocks):
        t = queries.where(part == b).select("id", "embedding").toArrow() if blocks > 1 else queries.select("id", "embedding").toArrow()
        ids = np.asarray(t["id"], np.int64)
        vec = np.asarray(t["embedding"].combine_chunks().flatten(), np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        got = corpus.select("id", "embedding").mapInArrow(scan(spark.sparkContext.broadcast((ids, vec))), kind)
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("corpus_id").asc())
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
