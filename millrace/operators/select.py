"""Ranked and capped selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import join_hot
from millrace.runtime import discard, stage


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group; the window limits groups on the map side before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def two_level_top(df: DataFrame, outer: str, inner: str, order: list[Column], first: str, k_inner: int, k_outer: int) -> DataFrame:
    """Best ``k_inner`` rows of each inner group, then ``k_outer`` of each outer one, inner groups in order of first sight."""
    seen = df.groupBy(outer, inner).agg(F.min(first).alias("__seen"))
    top = top_per_group(df, [outer, inner], order, k_inner, "__rn").join(seen, [outer, inner])
    return top_per_group(top, [outer], [F.col("__seen").asc(), F.col(inner).asc(), F.col("__rn").asc()], k_outer, "place").drop("__rn", "__seen")


def select_balanced(df: DataFrame, id_col: str, rank: str, caps: list[tuple[str, int]], target: int, *, key: str | None = None) -> DataFrame:
    """``(id, pass)`` of a greedy selection in rank order under several caps, then of its back-fill.

    A row is taken when fewer than cap taken rows precede it in each of its
    groups; a row that one cap turns away takes no room in another.  Rows whose
    fate the rows before settle are decided all at once, round by round.  A row
    is taken when it is among the first cap rows, open and taken ones together,
    of each group: the windows keep no more than that of a group before they
    shuffle.  It is turned away when it comes after a group's last possible
    taken row.  Only open rows go into the next round, and each round settles
    the first open row at least, so rounds end.  Pass 2 adds turned-away rows
    in rank order until the target, with ``key`` only the first of each key
    that no taken row has.  Ranks must be unique; null groups are one group.
    """
    groups = [f"g{i}" for i in range(len(caps))]
    extra = F.col(key) if key else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(rank).alias("rk"), *[F.col(c).alias(g) for g, (c, _) in zip(groups, caps)], extra.alias("key"))
    open_ = stage(rows, "balance-open")
    taken = stage(rows.limit(0), "balance-taken")
    away = None
    while open_.limit(1).count():
        both = open_.withColumn("new", F.lit(True)).unionByName(taken.withColumn("new", F.lit(False)))
        free = None
        for g, (_, cap) in zip(groups, caps):
            first = top_per_group(both, [g], [F.col("rk").asc()], cap, "__n").where("new").select("id")
            free = first if free is None else free.join(first, "id")
        fresh = stage(open_.join(free, "id", "left_semi"), "balance-fresh")
        now = stage(taken.unionByName(fresh), "balance-taken")
        rest = open_.join(fresh.select("id"), "id", "left_anti")
        full = F.lit(False)
        for i, (g, (_, cap)) in enumerate(zip(groups, caps)):
            last = top_per_group(now, [g], [F.col("rk").asc()], cap, "__n").where(F.col("__n") == cap).select(F.col(g).alias(f"f{i}"), F.col("rk").alias(f"last{i}"))
            rest = join_hot(rest.withColumn(f"f{i}", F.coalesce(F.col(g).cast("string"), F.lit("\x00"))), last.withColumn(f"f{i}", F.coalesce(F.col(f"f{i}").cast("string"), F.lit("\x00"))), [f"f{i}"], "left", bound=None)
            full = full | F.coalesce(F.col("rk") > F.col(f"last{i}"), F.lit(False))
        decided = stage(rest.withColumn("full", full).select(*open_.columns, "full"), "balance-decided")
        for old in (open_, taken, fresh):
            discard(old)
        gone = decided.where("full").drop("full")
        away = gone if away is None else away.unionByName(gone)
        open_, taken = stage(decided.where("not full").drop("full"), "balance-open"), now
    out = taken.orderBy("rk").limit(target).select("id", F.lit(1).alias("pass"))
    n = min(target, taken.count())
    if away is not None and n < target:
        if key:
            away = away.join(taken.select("key").distinct(), away["key"].eqNullSafe(taken["key"]), "left_anti")
            away = away.groupBy("key").agg(F.min(F.struct("rk", "id")).alias("b")).select("b.rk", "b.id")
        out = out.unionByName(away.orderBy("rk").limit(target - n).select("id", F.lit(2).alias("pass")))
    return out.withColumnRenamed("id", id_col)


def early_stop(df: DataFrame, group: str, layer: str, gain: str, enough: int) -> DataFrame:
    """Layers of each group that start before the gains of the earlier ones reach ``enough``."""
    before = F.sum(gain).over(Window.partitionBy(group).orderBy(layer).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < enough)


def hash_split(df: DataFrame, group: str, shares: dict[str, float], seed: str) -> DataFrame:
    """``(group, split)`` of the distinct groups: sizes by share, last split the rest, order by a seeded SHA-1."""
    from millrace.operators.dedupe import numbered

    groups = df.select(group).distinct().where(F.col(group).isNotNull() & (F.col(group) != ""))
    key = F.sha1(F.concat(F.lit(seed), F.lit(":"), F.col(group)))
    placed = numbered(groups.withColumn("__h", key), [F.col("__h").asc(), F.col(group).asc()], prefix="", width=1).withColumn("__i", F.col("seq_id").cast("bigint"))
    total = groups.agg(F.count(F.lit(1)).alias("__t")).scalar()
    names = list(shares)
    split, edge = F.when(F.lit(False), ""), F.lit(0)
    for k in names[:-1]:
        edge = edge + F.floor(F.col("__t") * F.lit(shares[k]))
        split = split.when(F.col("__i") <= edge, k)
    return placed.withColumn("__t", total).select(group, split.otherwise(names[-1]).alias("split"))
