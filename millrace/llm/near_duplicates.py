"""Near-duplicate records with small edits: an exact similarity join by a token-group matrix.

The token set of a text is the set of its sequences of ``words`` consecutive
words ``[a-z0-9_]+`` of the lower-cased text.  Two texts are similar when the
sets' intersection is at least ``similarity`` of their union.

1. Records of equal token sets form one class.
2. The tokens of a class are put in a global order, rarest first.  Classes go
   into groups by the least scrambled token of the first ones (similar sets
   mostly agree in it) and a band of set sizes.
3. The token-group matrix is kept sparse: of each class only a prefix of the
   order goes into its group's token union, as long as a partner above the
   threshold can make necessary, so no link is lost.  With so short a prefix
   the tokens behind it are one fewer than the overlap needed, so one token met
   in the union is what lets a group qualify; adding up more of them would
   refuse nothing.
4. What does refuse groups is the place of the first token met: the overlap is
   at most that token and what lies behind it in either.  Only groups whose
   bound reaches the overlap needed are opened.
5. Members of opened groups are met in blocks of bounded size, and a pair comes
   out only if bitmaps of both sets allow the similarity; then the whole token
   sets are compared.

The order comes from counts over all texts; which tokens it calls frequent
changes the work, never the result.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import vec
from millrace.operators.joins import join_hot
from millrace.llm.splits import components
from millrace.runtime import discard, stage

FREQUENT_SHARE = 0.00005  # a token in more texts than this is ordered by its count; bounds the order's table
BROADCAST_IDS = 1_000_000  # ids up to which the texts to compare are picked by broadcast (8 MB); more are joined by shuffle
COUNT_ROWS = 16384  # texts over which a task counts before it reports the tokens seen often
HOT_TEXTS = 2_000_000  # a token in more texts than this is dealt to several parts
WORDS = 8  # 64-bit words of a set's bitmap
BLOCK = 4096  # askers and members of a group that meet in one block; larger groups are dealt to several
TOKENS_PER_TASK = 1 << 18  # rows of the matrix that a task takes
_U = np.uint64
_BITS = ", ".join(f"b{i} bigint" for i in range(WORDS))


def _needed(similarity: Fraction, n: np.ndarray) -> np.ndarray:
    """Least overlap with any set of similarity or more, for sets of n."""
    return -((-n * similarity.numerator) // similarity.denominator)


def _fingerprints(row: np.ndarray, h: np.ndarray, rows: int):
    """Per row: two sums of scrambled tokens and the number of tokens."""
    n = np.bincount(row, minlength=rows).astype(np.int64)
    a, b = np.zeros(rows, _U), np.zeros(rows, _U)
    has = np.nonzero(n)[0]
    if len(has):
        first = np.concatenate([[0], np.cumsum(n[has])[:-1]])
        a[has] = np.add.reduceat(vec.mix(h, 11), first)
        b[has] = np.add.reduceat(vec.mix(h, 13), first)
    return vec.mix(a + n.astype(_U)), b, n


def _bitmaps(row: np.ndarray, h: np.ndarray, rows: int) -> list[np.ndarray]:
    """Each row's tokens as marks in a bitmap, in columns of 64 bits."""
    marks = np.zeros((rows, WORDS * 64), dtype=bool)
    marks[row, (vec.mix(h, 31) % _U(WORDS * 64)).astype(np.int64)] = True
    return list(np.packbits(marks, axis=1).view(np.int64).reshape(rows, WORDS).T)


def _describe(words: int):
    """kind 0: (id, fp, fp2, n, bitmap) of a text; kind 1: a token and in how many texts of some thousands it was."""
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("id", "fp", "fp2", "n", *(f"b{i}" for i in range(WORDS))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        texts = 0

        def report():
            t, c = np.unique(np.concatenate(seen), return_counts=True)
            often = c >= 2
            t, c = t[often].view(np.int64), c[often].astype(np.int64)
            z = np.zeros(len(t), np.int64)
            return pa.record_batch([pa.array(x) for x in (z.astype(np.int32) + 1, z, t, z, c, *[z] * WORDS)], schema=schema)

        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for i, j in vec.chunks(text):
                row, h = vec.code_shingles(text.slice(i, j - i), words)
                a, b, n = _fingerprints(row, h, j - i)
                cols = [pa.array(np.ascontiguousarray(x)) for x in (a.view(np.int64), b.view(np.int64), n, *_bitmaps(row, h, j - i))]
                yield pa.record_batch([pa.array(np.zeros(j - i, np.int32)), ids.slice(i, j - i), *cols], schema=schema)
                seen.append(h)
                texts += j - i
                if texts >= COUNT_ROWS:
                    yield report()
                    seen, texts = [], 0
        if seen:
            yield report()

    return run, f"kind int, id bigint, fp bigint, fp2 bigint, n bigint, {_BITS}"


def _matrix(words: int, similarity: Fraction, order, hot: int, only_hot: bool):
    """(token, fp, grp, at) of each text's prefix; a task reports equal sets once as far as it remembers them.

    Tokens in more than ``hot`` texts are left out, or alone come out, with the
    number of parts that their texts are dealt to and the text's part.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("token", "fp", "grp", "at", *(("parts", "part") if only_hot else ()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = order.value
        frequent = frequent.view(_U)
        known: set[int] = set()
        for batch in batches:
            text = batch.column(1)
            for i, j in vec.chunks(text):
                row, h = vec.code_shingles(text.slice(i, j - i), words)
                if not len(h):
                    continue
                a, _, n = _fingerprints(row, h, j - i)
                fresh = np.zeros(j - i, dtype=bool)
                for k, x in enumerate(a.tolist()):
                    if n[k] and x not in known:
                        known.add(x)
                        fresh[k] = True
                if len(known) > 1_000_000:
                    known.clear()
                keep = fresh[row]
                row, h = row[keep], h[keep]
                rank = np.zeros(len(h), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    rank = np.where(frequent[at] == h, count[at], 0)
                o = np.lexsort((h, rank, row))
                row, h = row[o], h[o]
                first = np.searchsorted(row, np.arange(j - i))
                pos = np.arange(len(row)) - first[row]
                prefix = pos < (n - _needed(similarity, n) + 1)[row]
                row, h, pos, rank = row[prefix], h[prefix], pos[prefix], rank[o][prefix]
                least = np.zeros(j - i, _U)
                if len(row):
                    own, begin = np.unique(row, return_index=True)
                    least[own] = np.minimum.reduceat(vec.mix(h, 17), begin)
                band = np.floor(np.log(np.maximum(n, 1)) / math.log(1.15)).astype(_U)
                grp = vec.mix(least + band * _U(0x9E3779B97F4A7C15), 19)
                keep = rank > hot if only_hot else rank <= hot
                row, h, pos, rank = row[keep], h[keep], pos[keep], rank[keep]
                own = a[row]
                cols = [h.view(np.int64), own.view(np.int64), grp[row].view(np.int64), (pos << 32) | n[row]]
                if only_hot:
                    parts = 1 + rank // hot
                    cols += [parts, (vec.mix(own, 37) % parts.astype(_U)).astype(np.int64)]
                yield pa.record_batch([pa.array(c) for c in cols], schema=schema)

    return run, "token bigint, fp bigint, grp bigint, at bigint" + ", parts bigint, part bigint" * only_hot


def _compare(words: int, similarity: Fraction):
    """(fp_a, fp_b, shared, total) of the pairs of texts whose whole sets are similar."""
    schema = pa.schema([("fp_a", pa.int64()), ("fp_b", pa.int64()), ("shared", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            for i in range(0, batch.num_rows, 512):
                k = min(512, batch.num_rows - i)
                width = 8
                out = []
                for p, q in zip(a.slice(i, k), b.slice(i, k)):
                    x, y = np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U)
                    out.append(len(np.intersect1d(x, y, assume_unique=True)))
                na = np.asarray([len(p.as_buffer()) // width for p in a.slice(i, k)], np.int64)
                nb = np.asarray([len(p.as_buffer()) // width for p in b.slice(i, k)], np.int64)
                shared = np.asarray(out, np.int64)
                total = na + nb - shared
                ok = shared * similarity.denominator >= total * similarity.numerator
                yield pa.record_batch(
                    [batch.column(0).slice(i, k).filter(pa.array(ok)), batch.column(1).slice(i, k).filter(pa.array(ok)), pa.array(shared[ok]), pa.array(total[ok])], schema=schema
                )

    return run, "fp_a bigint, fp_b bigint, shared bigint, total bigint"


def _sets(words: int):
    """(fp, tokens) of each text: the sorted tokens as bytes."""
    schema = pa.schema([("fp", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for i, j in vec.chunks(text):
                rows = j - i
                row, h = vec.code_shingles(text.slice(i, rows), words)
                a, _, _ = _fingerprints(row, h, rows)
                off = (np.searchsorted(row, np.arange(rows + 1)) * 8).astype(np.int32)
                tokens = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(off), pa.py_buffer(h.tobytes())])
                yield pa.record_batch([pa.array(a.view(np.int64)), tokens], schema=schema)

    return run, "fp bigint, tokens binary"


def _blocks(opened: DataFrame, members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their place among the blocks of a group: each asker with all parts of the members, each member with all parts of the askers."""
    parts = lambda df, name: F.broadcast(  # noqa: E731  (at most rows / block groups have more than a block)
        df.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block).select("grp", F.ceil(F.col("c") / block).alias(name))
    )
    ask, hold = parts(opened, "asks"), parts(members, "holds")

    def dealt(df: DataFrame, own: str, other: str, key: str, mine: str, theirs: str) -> DataFrame:
        df = df.join(ask, "grp", "left").join(hold, "grp", "left")
        place = F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1)))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1)) - 1))
        return df.withColumn(mine, place).withColumn(theirs, every).drop("asks", "holds")

    return dealt(opened, "asks", "holds", "fp_a", "ask", "hold"), dealt(members, "holds", "asks", "fp_b", "hold", "ask")


def similar_classes(df: DataFrame, id_col: str, text_col: str, *, words: int = 5, similarity: str = "0.8", hot: int = HOT_TEXTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Membership ``(id, class_id, copies)`` and links ``(class_a, class_b, similarity)`` between classes.

    A class is a set of records of one token set, named by its least id.
    Null and wordless texts belong to no class.  Ids must be unique bigints.
    Links have class_a < class_b, once each.
    """
    spark = df.sparkSession
    share = Fraction(similarity)
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    run, kind = _describe(words)
    seen = stage(source.mapInArrow(run, kind), "near-texts")
    texts = seen.where("kind = 0 and n > 0")
    total = texts.count()
    # Sum of the counts that tasks reported; at most avg tokens / FREQUENT_SHARE tokens can pass, whatever the input's size.
    often = (
        seen.where("kind = 1").groupBy(F.col("fp").alias("token")).agg(F.sum("n").alias("c"))
        .where(F.col("c") >= max(4, math.ceil(FREQUENT_SHARE * total))).toArrow()
    )
    token, count = np.asarray(often["token"], np.int64), np.asarray(often["c"], np.int64)
    o = np.argsort(token.view(_U))
    order = spark.sparkContext.broadcast((token[o], count[o]))

    classes = stage(
        texts.groupBy("fp", "fp2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first(F.struct(*(f"b{i}" for i in range(WORDS)))).alias("bits")),
        "near-classes",
    )
    members = texts.join(classes.select("fp", "fp2", "class_id", "copies"), ["fp", "fp2"]).select("id", "class_id", "copies")

    t = float(share)
    u, eps = t / (1 + t), 1e-9
    size = [F.shiftright("at", 32).cast("int").alias("pos"), F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("n")]
    # A row of the matrix: a token, a group holding it, the sizes of the members and the most that one has from the token on.
    row = [F.max("n").alias("most"), F.min("n").alias("least"), F.max(F.col("n") - F.col("pos")).alias("behind"), F.count(F.lit(1)).alias("held"), F.min("fp").alias("one")]

    def met(asking: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
        # A similar member of size s shares t/(1+t)(n+s) tokens at least, all of them from the first shared one on.
        need = u * (F.col("q.n") + F.greatest(F.col("least"), F.ceil(F.col("q.n") * t - eps))) - eps
        return (
            asking.alias("q").join(matrix.alias("g"), keys)
            .where((F.col("q.grp") <= F.col("g.grp")) & ((F.col("held") > 1) | (F.col("one") != F.col("q.fp"))))
            .where((F.col("most") >= F.col("q.n") * t - eps) & (F.col("least") * t <= F.col("q.n") + eps))
            .where((F.col("q.n") - F.col("pos") >= need) & (F.col("behind") >= need))
            .select(F.col("q.fp").alias("fp_a"), F.col("g.grp").alias("grp"), (F.col("q.grp") == F.col("g.grp")).alias("own"))
        )

    run, kind = _matrix(words, share, order, hot, False)
    # One exchange by token serves the counts, the matrix and the queries.
    # The filter is what the joins below would otherwise put under the exchange, each its own, so that it could not be shared.
    whole = F.lit(True)
    for c in ("token", "fp", "grp", "at"):
        whole = whole & F.col(c).isNotNull()
    written = source.where(F.col("text").isNotNull())
    # As many tasks as the prefixes' tokens ask for, whatever the session's default.
    prefix = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * t) + 1)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(prefix / TOKENS_PER_TASK))
    cells = written.mapInArrow(run, kind).where(whole).repartition(tasks, "token")
    per_token = Window.partitionBy("token")
    cells = (
        cells.withColumn("some", F.min("fp").over(per_token) != F.max("fp").over(per_token)).where("some")
        .groupBy("token", "fp").agg(F.first("grp").alias("grp"), F.min("at").alias("at")).select("token", "fp", "grp", *size)
    )
    opened = met(cells, cells.groupBy("token", "grp").agg(*row), ["token"])
    grouped = cells.select("fp", "grp", "n")
    if len(count) and int(count.max()) > hot:
        # Texts of a hot token are dealt to parts; each part has its own rows of the matrix, and a query asks all of them.
        run, kind = _matrix(words, share, order, hot, True)
        cells = written.mapInArrow(run, kind).groupBy("token", "part", "fp").agg(F.first("grp").alias("grp"), F.min("at").alias("at"), F.first("parts").alias("parts"))
        cells = stage(cells.select("token", "part", "fp", "grp", "parts", *size), "near-hot")
        asking = cells.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        opened = opened.unionByName(met(asking, cells.groupBy("token", "part", "grp").agg(*row), ["token", "part"]))
        grouped = grouped.unionByName(cells.select("fp", "grp", "n"))
    told = classes.select("fp", "n", "bits")
    # Both in one table, as they come from the same exchange; a class's own group has no ``own``.
    # It reads ``n``, too, as its exchange would else be another one with fewer columns.
    group_of = grouped.groupBy("fp").agg(F.first("grp").alias("grp"), F.max("n").alias("n")).where("n > 0").select(F.col("fp").alias("fp_a"), "grp", F.lit(None).cast("boolean").alias("own"))
    both = stage(opened.distinct().unionByName(group_of), "near-opened")
    opened = both.where("own is not null")
    members_of = both.where("own is null").select(F.col("fp_a").alias("fp_b"), "grp")
    askers, held = _blocks(opened, members_of, block)
    askers = askers.join(told.select(F.col("fp").alias("fp_a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "fp_a")
    held = held.join(told.select(F.col("fp").alias("fp_b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "fp_b")
    # Tokens in one set only are at least the bits that differ: shared <= (size - apart) / 2, shared / (size - shared) >= similarity.
    apart = functools.reduce(operator.add, (F.bit_count(F.col(f"ba.b{i}").bitwiseXOR(F.col(f"bb.b{i}"))) for i in range(WORDS)))
    size, up, down = F.col("na") + F.col("nb"), F.lit(share.numerator), F.lit(share.numerator + share.denominator)
    pairs = (
        askers.join(held, ["grp", "ask", "hold"])
        .where((F.col("fp_a") != F.col("fp_b")) & (~F.col("own") | (F.col("fp_a") < F.col("fp_b"))) & (F.least("na", "nb") >= F.greatest("na", "nb") * t - eps))
        .where((size - apart) * down >= 2 * up * size)
        .select(F.least("fp_a", "fp_b").alias("fp_a"), F.greatest("fp_a", "fp_b").alias("fp_b")).distinct()
    )
    pairs = stage(pairs, "near-pairs")
    discard(both)
    asked = pairs.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).distinct()
    ids = stage(classes.join(asked, "fp").select(F.col("class_id").alias("id")), "near-asked")
    few = ids.count() <= BROADCAST_IDS
    run, kind = _sets(words)
    sets = stage(source.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text").mapInArrow(run, kind), "near-sets")
    run, kind = _compare(words, share)
    alike = (
        pairs.join(sets.select(F.col("fp").alias("fp_a"), F.col("tokens").alias("ta")), "fp_a")
        .join(sets.select(F.col("fp").alias("fp_b"), F.col("tokens").alias("tb")), "fp_b")
        .select("fp_a", "fp_b", "ta", "tb").mapInArrow(run, kind)
    )
    name = classes.select("fp", "class_id")
    links = (
        alike.join(name.select(F.col("fp").alias("fp_a"), F.col("class_id").alias("a")), "fp_a")
        .join(name.select(F.col("fp").alias("fp_b"), F.col("class_id").alias("b")), "fp_b")
        .select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), (F.col("shared") / F.col("total")).alias("similarity"))
    )
    return members, links


def similar_pairs(df: DataFrame, id_col: str, text_col: str, *, words: int = 5, similarity: str = "0.8", **kw) -> DataFrame:
    """All pairs ``(id_a, id_b)``, id_a < id_b, of similar records, copies expanded.

    The result grows with the square of the copies of one text; where that is
    not wanted, ``class_links`` and ``similar_groups`` say the same in a row
    per record.
    """
    members, links = similar_classes(df, id_col, text_col, words=words, similarity=similarity, **kw)
    members = stage(members, "near-members")
    links = stage(links, "near-links")
    several = members.where("copies > 1")
    same = several.alias("a").join(several.alias("b"), "class_id").where("a.id < b.id").select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    other = (
        links.join(members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x")), "class_a")
        .join(members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y")), "class_b").select("x", "y")
    )
    both = same.unionByName(other)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def class_links(df: DataFrame, id_col: str, text_col: str, *, words: int = 5, similarity: str = "0.8") -> DataFrame:
    """One row per record: its class (null without words), the copies of that class, and the links its class has to others."""
    members, links = similar_classes(df, id_col, text_col, words=words, similarity=similarity)
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(degree, "class_id", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    all_ids = df.select(F.col(id_col).cast("bigint").alias("id"))
    return all_ids.join(out, "id", "left").select(F.col("id").alias(id_col), "class_id", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def similar_groups(df: DataFrame, id_col: str, text_col: str, *, words: int = 5, similarity: str = "0.8", **kw) -> DataFrame:
    """``(id, group_id, members)`` of every record: records linked directly or through others, named by the least id; records without words are alone."""
    members, links = similar_classes(df, id_col, text_col, words=words, similarity=similarity, **kw)
    members = stage(members, "near-members")
    root = stage(components(links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v"))).select(F.col("node").alias("class_id"), "root"), "near-roots")
    grouped = stage(join_hot(members.select("id", "class_id"), root, ["class_id"], "left").select("id", F.coalesce("root", "class_id").alias("group_id")), "near-groups")
    several = stage(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "near-sizes")
    out = join_hot(grouped, several, ["group_id"], "left")
    alone = df.select(F.col(id_col).cast("bigint").alias("id")).join(grouped.select("id"), "id", "left_anti").select("id", F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("members"))
    return out.select("id", "group_id", F.coalesce("members", F.lit(1)).alias("members")).unionByName(alone).withColumnRenamed("id", id_col)
