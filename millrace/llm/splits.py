"""Splits that keep related records together.

Records that name the same host or repository, directly or through others,
form one component.  Components come from the graph of hosts and repositories
by alternating stars (large star, small star), a few shuffles of the distinct
edges.  Components of equal size and label profile (the share of each label in
quarters) form a bundle.  The bundles are the nodes of a min-cost flow to the
splits that pays for what exceeds a split's quota or its quota of a label.  The
flow is rounded to whole components, largest first, each bundle making up for
what the ones before it left over; members of a bundle are told apart by hash.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from millrace.operators.joins import join_hot
from millrace.runtime import discard, stage

HUB = 1_000_000  # neighbours of a node that one task still takes
BUCKETS = 16384  # hash ranges in which the members of a bundle are counted


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour and number of neighbours of each ``u``; combines before it shuffles."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _stars(edges: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """One large-star and one small-star step over edges (u, v), u > v; edges of nodes with more than ``hub`` neighbours are not shuffled by them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    own = least.select("u", F.least("u", "m").alias("m"))
    big = join_hot(both.where("v > u"), own, ["u"], bound=None, hot=hub, counted=least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    big = stage(big.distinct(), "graph-large")
    least = _least(big)
    to = join_hot(big, least.select("u", "m"), ["u"], bound=None, hot=hub, counted=least)
    small = to.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return small.distinct(), big


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as written, and their number and hash sum, taken as they were written."""
    seen = Observation()
    h = F.xxhash64("u", "v")
    out = stage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("h")), "graph-edges")
    got = seen.get
    return out, (got["n"], got["h"])


def components(edges: DataFrame, *, rounds: int = 60, hub: int = HUB) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(u, v)``; the root is the least node of its component.

    Rounds grow with the logarithm of the longest path, so ``rounds`` is far
    beyond any graph's need; a graph that needs more raises an error.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    nodes = stage(both.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "graph-nodes")
    now, seen = _settled(both.where("u <> v").distinct())
    for _ in range(rounds):
        before = now
        after, big = _stars(before, hub)
        now, digest = _settled(after)
        discard(before)
        discard(big)
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


class _Flow:
    """Min-cost flow with whole costs: shortest distances, then all flow along arcs that lie on shortest ways, until none is left."""

    def __init__(self):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.at: list[list[int]] = []
        self.name: dict = {}

    def node(self, x) -> int:
        if x not in self.name:
            self.name[x] = len(self.at)
            self.at.append([])
        return self.name[x]

    def arc(self, a, b, cap: int, cost: int) -> int:
        e = len(self.to)
        i, j = self.node(a), self.node(b)
        self.to += [j, i]
        self.room += [cap, 0]
        self.cost += [cost, -cost]
        self.at[i].append(e)
        self.at[j].append(e + 1)
        return e

    def sent(self, e: int) -> int:
        return self.room[e ^ 1]

    def _distances(self, s: int) -> list[float]:
        dist = [float("inf")] * len(self.at)
        dist[s] = 0
        queue, queued = deque([s]), {s}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in self.at[a]:
                b = self.to[e]
                if self.room[e] and dist[a] + self.cost[e] < dist[b]:
                    dist[b] = dist[a] + self.cost[e]
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        return dist

    def run(self, source, sink) -> None:
        s, t = self.node(source), self.node(sink)
        while True:
            dist = self._distances(s)
            if dist[t] == float("inf"):
                return
            while self._blocking(s, t, dist):
                pass

    def _blocking(self, s: int, t: int, dist: list[float]) -> bool:
        level = {s: 0}
        queue = deque([s])
        on = lambda a, e: self.room[e] and dist[self.to[e]] == dist[a] + self.cost[e]
        while queue:
            a = queue.popleft()
            for e in self.at[a]:
                if self.to[e] not in level and on(a, e):
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        if t not in level:
            return False
        turn = dict.fromkeys(level, 0)
        way: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(self.room[e] for e in way)
                for e in way:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                cut = next(i for i, e in enumerate(way) if not self.room[e])
                a = self.to[way[cut] ^ 1]
                del way[cut:]
                continue
            while turn[a] < len(self.at[a]):
                e = self.at[a][turn[a]]
                if level.get(self.to[e], -1) == level[a] + 1 and on(a, e):
                    break
                turn[a] += 1
            else:
                if a == s:
                    return True
                back = way.pop()
                a = self.to[back ^ 1]
                turn[a] += 1
                continue
            way.append(e)
            a = self.to[e]


OVER_SPLIT, OVER_LABEL = 4000, 1000  # costs of a row beyond a split's quota and beyond its quota of a label


def allocate(bundles: list[tuple[int, object, int, dict[str, int]]], shares: dict[str, float]) -> dict[tuple[int, object], dict[str, int]]:
    """How many components of each bundle (size, profile, components, rows by label) go to each split.

    The flow is in rows: source, bundle and label, label and split, split, sink.
    """
    names = list(shares)
    total = sum(s * n for s, _, n, _ in bundles)
    of_label: dict = defaultdict(int)
    for _, _, _, rows in bundles:
        for x, r in rows.items():
            of_label[x] += r
    quota = _whole(total, shares)
    flow = _Flow()
    arcs: dict = {}
    for s, p, n, rows in bundles:
        for x, r in rows.items():
            flow.arc("source", (s, p, x), r, 0)
            for k in names:
                # A component larger than the quota deviates by what exceeds it, wherever it goes.
                arcs[s, p, x, k] = flow.arc((s, p, x), (x, k), r, int(OVER_SPLIT * max(0, s - quota[k]) / s))
    for x, r in of_label.items():
        own = _whole(r, shares)
        for k in names:
            flow.arc((x, k), k, own[k], 0)
            flow.arc((x, k), k, r, OVER_LABEL)
    for k in names:
        flow.arc(k, "sink", quota[k], 0)
        flow.arc(k, "sink", total, OVER_SPLIT)
    flow.run("source", "sink")
    room = dict(quota)
    label_room = {x: _whole(r, shares) for x, r in of_label.items()}
    owed = dict.fromkeys(names, 0)  # rows that the flow gave a split and rounding has not yet
    out: dict = {}
    for s, p, n, rows in sorted(bundles, key=lambda b: (-b[0], str(b[1]))):
        want = {k: owed[k] + sum(flow.sent(arcs[s, p, x, k]) for x in rows) for k in names}
        take = {k: min(n, max(0, want[k]) // s) for k in names}
        while sum(take.values()) > n:
            take[max((k for k in names if take[k]), key=lambda k: take[k] * s - want[k])] -= 1
        each = {x: r / n for x, r in rows.items()}
        left = n - sum(take.values())
        while left:
            k = min(names, key=lambda k: (
                OVER_SPLIT * max(0, s - max(0, room[k] - take[k] * s)) + OVER_LABEL * sum(max(0, y - max(0, label_room[x][k] - take[k] * y)) for x, y in each.items()), take[k] * s - want[k],
            ))
            # As many at once as the split has room for.
            more = max(1, min(left, (room[k] - take[k] * s) // s))
            take[k] += more
            left -= more
        for k in names:
            owed[k] = want[k] - take[k] * s
            room[k] -= take[k] * s
            for x, y in each.items():
                label_room[x][k] -= take[k] * y
        out[s, p] = take
    return out


def _whole(rows: int, shares: dict[str, float]) -> dict[str, int]:
    """The rows dealt out by the shares in whole numbers, what is left over to the largest remainders."""
    out = {k: int(rows * v) for k, v in shares.items()}
    rest = sorted(shares, key=lambda k: -(rows * shares[k] - out[k]))
    for k in rest[: rows - sum(out.values())]:
        out[k] += 1
    return out


def group_splits(df: DataFrame, id_col: str, host: Column, repo: Column, label: Column, shares: dict[str, float] | None = None) -> DataFrame:
    """``(id, group, group_host, split)`` of every row; rows with neither host nor repository are groups of their own.

    ``host`` and ``repo`` are canonical names, null where absent.  The group is
    its least node, hosts before repositories, so ``group_host`` is the least
    host or null.  A null label counts as the empty string.  ``shares`` sum to 1.
    """
    shares = shares or {"train": 0.7, "validation": 0.1, "test": 0.2}
    spark = df.sparkSession
    h, r = F.concat(F.lit("h "), host), F.concat(F.lit("r "), repo)
    rows = df.select(F.col(id_col).alias("id"), h.alias("h"), r.alias("r"), F.coalesce(label, F.lit("")).alias("label"))
    edges = rows.where("h is not null or r is not null").select(F.coalesce("h", "r").alias("u"), F.coalesce("r", "h").alias("v")).distinct()
    roots = stage(components(edges), "split-roots")
    named = join_hot(rows.select("id", "label", F.coalesce("h", "r").alias("node")), roots, ["node"], "left")
    alone = F.concat(F.lit("~ "), F.col("id").cast("string"))
    named = stage(named.select("id", "label", F.coalesce("root", alone).alias("root")), "split-rows")
    discard(roots)
    # A component's label profile: the labels with an eighth of its rows or more, in quarters; at most eight.
    sizes = named.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.sum("n").over(Window.partitionBy("root")))
    quarters = F.round(F.col("n") * 4 / F.col("size")).cast("int")
    told = F.when(quarters >= 1, F.struct("label", quarters.alias("quarters"), "n"))
    profile = sizes.groupBy("root", "size").agg(F.array_sort(F.collect_list(told)).alias("told"), F.sum(F.when(quarters < 1, F.col("n")).otherwise(0)).alias("rest"))
    name = F.to_json(F.transform("told", lambda x: F.struct(x["label"].alias("l"), x["quarters"].alias("q"))))
    rest = F.struct(F.lit("other labels").alias("label"), F.col("rest").alias("n"))
    by_label = F.concat(F.transform("told", lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n"))), F.array(rest))
    bucket = F.pmod(F.xxhash64("root"), F.lit(BUCKETS))
    profile = stage(profile.select("root", "size", name.alias("profile"), by_label.alias("labels"), bucket.alias("bucket")), "split-groups")
    # Distinct sizes are at most the square root of twice the rows, profiles a fixed number for the labels there are.
    told = profile.select("size", "profile", F.inline("labels")).groupBy("size", "profile", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    bundles: dict = {}
    for x in told.toArrow().to_pylist():
        bundle = bundles.setdefault((x["size"], x["profile"]), [0, {}])
        bundle[0] = max(bundle[0], x["c"])
        if x["n"]:
            bundle[1][x["label"]] = bundle[1].get(x["label"], 0) + x["n"]
    dealt = allocate([(s, p, n, by) for (s, p), (n, by) in sorted(bundles.items())], shares)
    plan = []
    for (s, p), take in dealt.items():
        start = 0
        for k in shares:
            if take[k]:
                plan.append((s, p, k, start, start + take[k]))
                start += take[k]
    plan_df = spark.createDataFrame(plan, "size bigint, profile string, split string, first bigint, last bigint")
    # A component's place among its bundle's by hash: the components in lower hash ranges, and its rank in its own.
    keys = ["size", "profile"]
    per = profile.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("c"))
    below = F.sum("c").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(*keys, "bucket", F.coalesce(below, F.lit(0)).alias("below"))
    rank = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(F.xxhash64("root"), "root")) - 1
    placed = profile.select("root", *keys, "bucket").withColumn("rank", rank).join(per, [*keys, "bucket"]).withColumn("place", F.col("rank") + F.col("below"))
    placed = stage(placed.join(plan_df, keys).where("place >= first and place < last").select("root", "split"), "split-dealt")
    out = join_hot(named, placed, ["root"])
    host_of = F.when(F.col("root").startswith("h "), F.substr("root", F.lit(3)))
    return out.select(F.col("id").alias(id_col), F.col("root").alias("group"), host_of.alias("group_host"), "split")
