"""Long stretches of text that occur verbatim in more than one document.

Every run of ``length`` characters counts as a paragraph, wherever it begins.
Its MinHash signature has one band of one row, the least hash of its k-grams:
equal paragraphs have equal signatures, so for the relation asked for, equality
of whole runs, this tuning has a recall of 1.  Neighbouring paragraphs mostly
share their least k-gram, so a document has few distinct ones, called anchors.
Paragraphs cut at blank lines and banded for similarity, the method as it is
named, miss stretches that begin and end inside a paragraph; the README has
what ``tests/llm/measure_paragraphs.py`` measures of it.

Colliding anchors are joined, texts of equal context are settled by hash as one
class, and only one text of each class is compared character by character with
the other classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import vec
from millrace.operators.joins import join_hot
from millrace.runtime import discard, stage

BROADCAST_ANCHORS = 300_000  # anchors that may go to the workers (some 45 MB); more are joined by shuffle, hot ones apart
GROUP_BOUND = 64  # classes of an anchor that are compared pair by pair; larger groups go by window hashes
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHAR = vec.mix(np.arange(1 << 16, dtype=_U), 23) | _U(1)


def _power(base: np.uint64, n: int, memo: dict) -> np.ndarray:
    have = memo.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, _U)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        memo[base] = have = p
    return have[:n]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts one after another, and each text's offset."""
    off = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


class _Rolling:
    """Hashes of any span of a run of code points."""

    def __init__(self, points: np.ndarray, memo: dict):
        n = len(points)
        low = points < 1 << 16
        v = _CHAR[np.where(low, points, 0)]
        if not low.all():
            v = np.where(low, v, vec.mix(points.astype(_U), 23) | _U(1))
        self.sum = np.zeros(n + 1, _U)
        np.cumsum(v * _power(_ODD, n, memo), out=self.sum[1:])
        self.inv = _power(_INV, n + 1, memo)

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return vec.mix((self.sum[stop] - self.sum[start]) * self.inv[start], 29)

    def every(self, k: int) -> np.ndarray:
        n = len(self.sum) - k
        return vec.mix((self.sum[k:] - self.sum[:n]) * self.inv[:n], 29) if n > 0 else np.zeros(0, _U)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(np.uint64).max, _U)
    b = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _anchors(k: int, length: int):
    w = length - k + 1
    left = w - 1
    schema = pa.schema([(c, pa.int64()) for c in ("h", "ctx", "doc", "at")])
    bits, low = _U(~((1 << 21) - 1) & (2**64 - 1)), _U((1 << 21) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for i, j in vec.chunks(column, vec.CHUNK_BYTES // 2):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                ok = [x for x in range(j - i) if len(texts[x]) >= length]
                # A single text may exceed what the packed position holds; pieces overlap by a window's length then.
                points, off = _points([texts[x] for x in ok])
                if not len(points):
                    continue
                doc = np.asarray(ids.slice(i, j - i), np.int64)[ok]
                roll = _Rolling(points, memo)
                g = roll.every(k)
                found = []
                step = 1 << 20
                for a in range(0, len(g) - w + 1, step):
                    part = g[a : min(len(g), a + step + w - 1)]
                    least = _sliding_min((part & bits) | np.arange(len(part), dtype=_U), w)
                    j0 = np.arange(a, a + len(least))
                    t = np.searchsorted(off, j0, side="right") - 1
                    inside = j0 + length <= off[t + 1]
                    found.append(np.unique((least[inside] & low).astype(np.int64) + a))
                p = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                t = np.searchsorted(off, p, side="right") - 1
                lo, hi = np.maximum(p - left, off[t]), np.minimum(p + length, off[t + 1])
                ctx = vec.mix(roll.span(lo, hi) + (p - lo).astype(_U) * _U(1000003) + (hi - p).astype(_U))
                at = ((p - off[t]) << 20) | ((p - lo) << 10) | (hi - p)
                yield pa.record_batch([pa.array(g[p].view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc[t]), pa.array(at)], schema=schema)

    return run, "h bigint, ctx bigint, doc bigint, at bigint"


def _contexts():
    schema = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("before", pa.string()), ("behind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for doc, text, marks in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in range(3))):
                    for m in marks:
                        p, lo, hi = m["at"] >> 20, (m["at"] >> 10) & 1023, m["at"] & 1023
                        rows.append((m["h"], m["ctx"], doc, text[p - lo : p], text[p : p + hi]))
                yield pa.record_batch([pa.array(x) for x in zip(*rows)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run, "h bigint, ctx bigint, doc bigint, before string, behind string"


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _extents(length: int):
    """How far the stretches around the anchor reach that one other document shares, for each class of an anchor."""
    schema = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("before", pa.int32()), ("behind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for h, group in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in range(2))):
                    own = [(g["ctx"], g["doc"], g["many"], g["before"][::-1], g["behind"]) for g in group]
                    far = {}
                    for x in range(len(own)):
                        for y in range(x):
                            a, b = own[x], own[y]
                            # A class of one document needs another document; a class of several has its partner already.
                            if a[1] == b[1] and not (a[2] or b[2]):
                                continue
                            lo, hi = _common(a[3], b[3]), _common(a[4], b[4])
                            if lo + hi >= length:
                                for c in (a, b):
                                    p = far.get(c[0], (0, 0))
                                    far[c[0]] = (max(p[0], lo), max(p[1], hi))
                    rows += [(h, c, *e) for c, e in far.items()]
                yield pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run, "h bigint, ctx bigint, before int, behind int"


def _windows(length: int):
    """(h, ctx, doc, o, hash) of every window of the length that holds the anchor, o characters of it before the anchor."""
    schema = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("o", pa.int32()), ("w", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for h, ctx, doc, before, behind in zip(*(batch.column(c).to_pylist() for c in range(5))):
                points, _ = _points([before + behind])
                g = _Rolling(points, memo).every(length)
                o = len(before) - np.arange(len(g))
                keep = o >= 0
                n = int(keep.sum())
                yield pa.record_batch(
                    [pa.array(np.full(n, h)), pa.array(np.full(n, ctx)), pa.array(np.full(n, doc)), pa.array(o[keep].astype(np.int32)), pa.array(g[keep].view(np.int64))], schema=schema
                )

    return run, "h bigint, ctx bigint, doc bigint, o int, w bigint"


def shared_spans(df: DataFrame, id_col: str, text_col: str, *, length: int = 200, k: int | None = None, group_bound: int = GROUP_BOUND) -> DataFrame:
    """Merged stretches ``(doc, start, stop)`` in characters that lie in stretches of ``length`` or more shared with another document.

    Null texts and texts shorter than ``length`` share nothing.  ``id_col``
    must be unique.  ``length`` is at most 900 and at least 20.
    """
    if not 20 <= length <= 900:
        raise ValueError("length must lie in 20..900")
    k = k or max(8, length * 12 // 25)
    source = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    run, kind = _anchors(k, length)
    anchors = stage(source.where(F.char_length("text") >= length).mapInArrow(run, kind), "span-anchors")
    # Aggregates combine before they shuffle, so an anchor in a third of all documents is a row per task, never one task's group.
    common = stage(anchors.groupBy("h").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2")).where("d1 <> d2").select("h"), "span-common")
    cells = stage(join_hot(anchors, common, ["h"], bound=BROADCAST_ANCHORS), "span-cells")
    discard(anchors)
    discard(common)
    classes = cells.groupBy("h", "ctx").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2"), F.min(F.struct("doc", "at")).alias("one"))
    classes = stage(classes.select("h", "ctx", (F.col("d1") != F.col("d2")).alias("many"), F.col("one.doc").alias("doc"), F.col("one.at").alias("at")), "span-contexts-of-anchors")
    per_anchor = stage(classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.bool_or(~F.col("many")).alias("open")), "span-anchor-sizes")
    pos, before, behind = F.shiftright("at", 20), F.shiftright("at", 10).bitwiseAND(1023), F.col("at").bitwiseAND(1023)
    own = join_hot(cells, classes.select("h", "ctx", "many"), ["h", "ctx"], bound=None)
    settled = own.where("many").where(before + behind >= length).select("doc", (pos - before).alias("start"), (pos + behind).alias("stop"))
    classes = stage(join_hot(classes, per_anchor, ["h"], bound=BROADCAST_ANCHORS), "span-classes")

    reps = classes.where("classes > 1 and open")
    asked = reps.groupBy("doc").agg(F.collect_list(F.struct("h", "ctx", "at")).alias("marks"))
    run, kind = _contexts()
    contexts = source.join(asked, "doc").select("doc", "text", "marks").mapInArrow(run, kind)
    contexts = stage(contexts.join(reps.select("h", "ctx", "many", "classes"), ["h", "ctx"]), "span-contexts")

    run, kind = _extents(length)
    few = (
        contexts.where(F.col("classes") <= group_bound).groupBy("h").agg(F.collect_list(F.struct("ctx", "doc", "many", "before", "behind")).alias("group"))
        .mapInArrow(run, kind)
    )
    run, kind = _windows(length)
    rows = contexts.where(F.col("classes") > group_bound)
    windows = rows.select("h", "ctx", "doc", "before", "behind").mapInArrow(run, kind)
    shared = windows.join(rows.select("h", "ctx", "many"), ["h", "ctx"]).groupBy("w").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2"), F.max("many").alias("m")).where("d1 <> d2 or m")
    lots = windows.join(shared.select("w"), "w", "left_semi").groupBy("h", "ctx").agg(F.max("o").cast("int").alias("before"), (length - F.min("o")).cast("int").alias("behind"))
    reach = few.unionByName(lots)
    unsettled = (
        own.where("not many").select("h", "ctx", "doc", "at").join(reach, ["h", "ctx"])
        .select("doc", (pos - F.col("before")).alias("start"), (pos + F.col("behind")).alias("stop"))
    )
    spans = settled.unionByName(unsettled)
    order = Window.partitionBy("doc").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    spans = spans.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def shared_chars(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """``(id, shared_chars)`` of each document with at least one shared stretch."""
    return shared_spans(df, id_col, text_col, **kw).groupBy("doc").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars")).withColumnRenamed("doc", id_col)
