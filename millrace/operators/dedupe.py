"""Duplicate removal that keeps a known row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """The first row of each key by ``order``; null keys are equal to each other.

    ``min_by`` over a struct combines on the map side, so a key with a third of
    all rows shuffles one row per task, where a window would sort it in one.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    best = df.select(*named, row.alias("__row"), order.alias("__o")).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by("__row", "__o").alias("__row"))
    return best.select("__row.*")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("__row")).select("__row.*")


def duplicate_count(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``(total, kept, duplicates)`` of a table."""
    per = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


_GRAM_BITS, _GRAM = 18, 6
_ROWS = 1024  # texts from which on a group's grams are laid out by gram rather than by text


def _rare(codes, owner, size):
    """Which characters of the texts ``SequenceMatcher`` starts blocks at: those not popular, that is in more than one in a hundred of 200 or more."""
    import numpy as np

    key = owner * (int(codes.max(initial=0)) + 1) + codes
    return (np.bincount(key)[key] <= (size // 100 + 1)[owner]) | (size < 200)[owner]


def _batches(codes: list, chosen, size: int = 64):
    """``(places, characters, their owners, sizes, starts, slots)`` of the chosen texts, some at a time; ``slots[k - 1]`` has one for each k-gram."""
    import numpy as np

    for at in range(0, len(chosen), size):
        part = chosen[at : at + size]
        flat, n = np.concatenate([codes[x] for x in part]), np.array([len(codes[x]) for x in part])
        slots, h, c = np.zeros((_GRAM, len(flat)), np.int32), np.zeros(len(flat), np.uint32), flat.astype(np.uint32)
        for k in range(1, min(_GRAM, len(flat)) + 1):
            h = h[: len(flat) - k + 1] * np.uint32(0x9E3779B1) + c[k - 1 :] + np.uint32(k)
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            slots[k - 1, : len(x)] = x >> np.uint32(32 - _GRAM_BITS)
        yield part, flat, np.repeat(np.arange(len(part)), n), n, np.cumsum(n) - n, slots


def _held(codes: list, chosen, by_gram: bool):
    """A bit for each slot and text that is set if a chosen text has the gram, 64 texts to a word; and each slot's share of the chosen texts."""
    import numpy as np

    slots, words = 1 << _GRAM_BITS, (len(codes) + 63) // 64
    out = np.zeros((slots, words) if by_gram else (words, slots), np.uint64)
    share, some, at = np.zeros(slots, np.int32), np.zeros((min(8, words), slots), np.uint64), 0  # some words, so that what is written lies together

    def put():
        for col in some:
            np.add(share, np.bitwise_count(col), out=share)
        if by_gram:
            out[:, at : at + len(some)] = some[: words - at].T
        else:
            out[at : at + len(some)] = some[: words - at]
        some[:] = 0

    for part, _, _, size, starts, slot in _batches(codes, chosen):
        for x, n, start in zip(part, size.tolist(), starts.tolist()):
            if x >> 6 >= at + len(some):
                put()
                at = (x >> 6) // len(some) * len(some)
            g = np.concatenate([slot[k, start : start + max(n - k, 0)] for k in range(_GRAM)])
            some[(x >> 6) - at][g] |= np.uint64(1 << (x & 63))
    put()
    return out, share / max(len(chosen), 1)


def _needed(codes: list, chosen):
    """``(place, left, right, weight)`` of the chosen texts: so many characters of it, the earlier one, are matched only if the later one holds the left or the right gram.

    ``SequenceMatcher`` starts a block at a character that is not popular, or
    where both texts begin, and extends it over equal neighbours.  A matched
    character is therefore joined to the next rare one on its left (or the
    text's start) or on its right, and all between stands in the other text, too.
    """
    import numpy as np

    mask = (1 << _GRAM_BITS) - 1
    for part, flat, owner, size, starts, slots in _batches(codes, chosen):
        x, rare = np.arange(len(flat)), _rare(flat, owner, size)
        before = np.where(rare, x, 0)
        before[starts] = starts
        before = np.maximum.accumulate(before)
        after = np.minimum.accumulate(np.where(rare, x, len(flat))[::-1])[::-1]
        to_left, to_right = np.minimum(x - before + 1, _GRAM), np.minimum(after - x + 1, _GRAM)
        left = slots[to_left - 1, x - to_left + 1].astype(np.int64)
        right = np.where(after < (starts + size)[owner], slots[to_right - 1, x], left)
        key = np.sort((owner << 2 * _GRAM_BITS) + (left << _GRAM_BITS) + right)
        at = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
        weight, key = np.diff(at, append=len(key)), key[at]
        ends = np.searchsorted(key >> 2 * _GRAM_BITS, np.arange(len(part)), "right").tolist()
        left, right = key >> _GRAM_BITS & mask, key & mask
        for place, lo, hi in zip(part, [0, *ends], ends):
            yield place, left[lo:hi], right[lo:hi], weight[lo:hi]


def _planes(levels: list) -> list:
    """The sums of bits as binary digits: of rows of words, those of ``levels[i]`` count 2 ** i; three rows become a sum and a carry."""
    import numpy as np

    out, at = [], 0
    while at < len(levels):
        rows, carry = levels[at], []
        while len(rows) > 1:
            m = len(rows) // 3
            if not m:
                carry.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
                break
            a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            d = a ^ b
            carry.append((a & b) | (c & d))
            rows = np.concatenate([d ^ c, rows[3 * m :]])
        out.append(rows[0] if len(rows) else None)
        if carry:
            more = np.concatenate(carry)
            levels[at + 1 :] = [np.concatenate([levels[at + 1], more]), *levels[at + 2 :]] if at + 1 < len(levels) else [more]
        at += 1
    return out


def _weights(held, by_gram: bool, left, right, weight, places):
    """The weight of the keys that each text at ``places`` holds."""
    import numpy as np

    word, bit = places >> 6, (places & 63).astype(np.uint64)
    lo, hi = int(word[0]), int(word[-1]) + 1
    if len(places) <= 16:
        if by_gram:
            rows = (held[left, word[:, None]] | held[right, word[:, None]])
        else:
            rows = np.stack([held[w][left] | held[w][right] for w in range(lo, hi)])[word - lo] if hi - lo <= len(places) else np.stack([held[w][left] | held[w][right] for w in word.tolist()])
        return ((rows >> bit[:, None]) & np.uint64(1)).astype(np.float64) @ weight.astype(np.float64)
    rows = held[left, lo:hi] | held[right, lo:hi] if by_gram else np.stack([held[w][left] | held[w][right] for w in range(lo, hi)], 1)
    sums = np.zeros((hi - lo) * 64, np.int64)
    for at, p in enumerate(_planes([rows[weight >> b & 1 == 1] for b in range(int(weight.max()).bit_length())])):
        if p is not None:
            sums += np.unpackbits(p.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << at
    return sums[places - lo * 64]


def _close(held, by_gram: bool, share, left, right, weight, places, size, n: int, threshold: float):
    """Those of the later texts at ``places`` whose grams allow a ratio above the threshold with an earlier one of ``n`` characters.

    Heavy and rare keys alone, as many as refuse a text that has no more of
    them than is usual, go first; those they leave are told by all.
    """
    import numpy as np

    total = size + n
    missing = weight * (1 - np.minimum(share[left] + share[right], 1))
    down = np.sort(missing)[::-1]
    most = n - threshold / 2 * (int(size.min()) + n)
    m = int(np.searchsorted(np.cumsum(down), 1.25 * most)) + 16
    some = [np.nonzero(missing >= down[m])[0]] if m < 0.7 * len(down) else []
    for part in (*some, slice(None)):
        w = weight[part]
        stay = np.nonzero(2.0 * (n - int(w.sum()) + _weights(held, by_gram, left[part], right[part], w, places)) / total > threshold)[0]
        places, total = places[stay], total[stay]
        if not len(places):
            break
    return places


class _Matcher:
    """Whether ``SequenceMatcher(None, later, earlier).ratio()`` exceeds a threshold, for one earlier text.

    The blocks are those of ``SequenceMatcher``: in a window, the longest run
    of equal characters that are rare in the earlier text, the first in the
    later and then in the earlier text, extended over equal neighbours.  All
    windows beside the blocks of a round are searched at once in the next one,
    by the equal characters along diagonals, and the search ends once the
    blocks found suffice or what is open cannot.
    """

    POINTS = 4_000_000  # equal characters up to which a pair's are held in memory

    def __init__(self, text: str, codes):
        import numpy as np

        self.text = text
        at = np.nonzero(_rare(codes, np.zeros(len(codes), np.int64), np.array([len(codes)])))[0]
        self.at = at[np.argsort(codes[at], kind="stable")]
        self.count = np.append(np.bincount(codes[at]), 0)
        self.first = np.cumsum(self.count) - self.count

    def exceeds(self, later: str, codes, threshold: float) -> bool:
        import difflib

        import numpy as np

        a, b, la, lb = later, self.text, len(later), len(self.text)
        total, none = la + lb, np.iinfo(np.int64).max
        c = np.minimum(codes, len(self.count) - 1)
        count = self.count[c]
        m = int(count.sum())
        if m > self.POINTS or not total or (la + 1) ** 2 * (lb + 1) * min(la + 1, lb + 1) >= none:
            return difflib.SequenceMatcher(None, a, b).ratio() > threshold
        i = np.repeat(np.arange(la), count)
        j = self.at[np.arange(m) + np.repeat(self.first[c] - np.cumsum(count) + count, count)]
        diag, i = np.divmod(np.sort((i - j + lb) * la + i), max(la, 1))
        j = i - diag + lb
        found, windows = 0, [(0, la, 0, lb)]
        of_a, of_b = np.zeros(la, np.int64), np.zeros(lb, np.int64)
        while windows:
            w = of_a[i]
            keep = np.nonzero((w == of_b[j]) & (w >= 0))[0]
            i, j, w = i[keep], j[keep], w[keep]
            start = np.nonzero(np.append(True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1) | (w[1:] != w[:-1])))[0][: len(i)]
            size, own = np.diff(start, append=len(i)), w[start]
            best = np.full(len(windows), none)
            np.minimum.at(best, own, ((la - size) * (la + 1) + i[start]) * (lb + 1) + j[start])
            of_a, of_b, more, left = np.full(la, -1), np.full(lb, -1), [], 0
            for (alo, ahi, blo, bhi), x in zip(windows, best.tolist()):
                x, q = divmod(x, lb + 1) if x != none else (None, blo)
                n, p = divmod(x, la + 1) if x is not None else (la, alo)
                n = la - n
                while p - 32 >= alo and q - 32 >= blo and a[p - 32 : p] == b[q - 32 : q]:
                    p, q, n = p - 32, q - 32, n + 32
                while p > alo and q > blo and a[p - 1] == b[q - 1]:
                    p, q, n = p - 1, q - 1, n + 1
                while p + n + 32 <= ahi and q + n + 32 <= bhi and a[p + n : p + n + 32] == b[q + n : q + n + 32]:
                    n += 32
                while p + n < ahi and q + n < bhi and a[p + n] == b[q + n]:
                    n += 1
                if n:
                    found += n
                    for v in ((alo, p, blo, q), (p + n, ahi, q + n, bhi)):
                        if v[0] < v[1] and v[2] < v[3]:
                            of_a[v[0] : v[1]] = of_b[v[2] : v[3]] = len(more)
                            more.append(v)
                            left += min(v[1] - v[0], v[3] - v[2])
            windows = more
            if 2.0 * found / total > threshold:
                return True
            if 2.0 * (found + left) / total <= threshold:
                return False
        return 2.0 * found / total > threshold


def _candidates(rows: list, codes: list, earlier, later, threshold: float):
    """``(earlier, later)`` places of pairs that the bounds allow; ``rows`` are ``(grp, id, text)`` in order, and later ones are of the same group."""
    import numpy as np

    group = np.unique([rows[x][0] for x in [*earlier, *later]], return_inverse=True)[1]
    own, g = group[: len(earlier)].tolist(), group[len(earlier) :]
    i, n = np.array([rows[x][1] for x in later], np.int64), np.array([len(codes[x]) for x in later], np.int64)
    los, his = np.searchsorted(g, own, "left").tolist(), np.searchsorted(g, own, "right").tolist()
    may_of, asked = {}, np.zeros(len(later), bool)
    for x, lo, hi in zip(earlier, los, his):
        lo += int(np.searchsorted(i[lo:hi], rows[x][1], "right"))
        size = len(codes[x])
        if lo < hi and size:
            may = np.nonzero(2.0 * np.minimum(n[lo:hi], size) / (n[lo:hi] + size) > threshold)[0] + lo
            if len(may):
                may_of[x] = may
                asked[may] = True
    if not may_of:
        return
    by_gram = len(later) > _ROWS and g[0] == g[-1]
    held, share = _held([codes[x] for x in later], np.nonzero(asked)[0].tolist(), by_gram)
    for x, *keys in _needed(codes, list(may_of)):
        may = may_of[x]
        for y in _close(held, by_gram, share, *keys, may, n[may], len(codes[x]), threshold).tolist():
            yield x, later[y]


def _similar(threshold: float):
    from itertools import groupby

    import numpy as np
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        order = sorted(zip(t["grp"].to_pylist(), t["id"].to_pylist(), t["text"].to_pylist(), t["block"].to_pylist()))
        rows = [r[:3] for r in order]
        # Characters by their place in the alphabet of these texts.
        flat = [np.frombuffer(r[2].encode("utf-32-le", "surrogatepass"), np.uint32) for r in rows]
        used = np.zeros(1 + max((int(c.max()) for c in flat if len(c)), default=0), bool)
        for c in flat:
            used[c] = True
        place = np.cumsum(used) - 1
        codes = [place[c] for c in flat]
        p, q = (t[c][0].as_py() for c in ("p", "q"))
        if p >= 0:
            one, other = ([x for x, r in enumerate(order) if r[3] == k] for k in (p, q))
            parts = [(one, one)] if p == q else [(one, other), (other, one)]
        else:
            groups = [[x for x, _ in g] for _, g in groupby(enumerate(rows), lambda r: r[1][0])]
            parts = [(g, g) for g in groups if len(g) > _ROWS] + [(s, s) for s in [[x for g in groups if 1 < len(g) <= _ROWS for x in g]]]
        near: dict[int, list[int]] = {}
        for part in parts:
            for x, y in _candidates(rows, codes, *part, threshold):
                near.setdefault(y, []).append(x)
        # Bundled groups are whole: a row is compared with those kept until one is near.  Of a larger group all near pairs are needed.
        out, gone, matchers, group = [], set(), {}, None
        for y in sorted(near):
            if rows[y][0] != group:
                matchers, group = {}, rows[y][0]
            for x in sorted(near[y]):
                if x in gone:
                    continue
                if x not in matchers:
                    matchers[x] = _Matcher(rows[x][2], codes[x])
                if matchers[x].exceeds(rows[y][2], codes[y], threshold):
                    out.append((rows[y][0], rows[y][1], rows[x][1] if p >= 0 else None))
                    if p < 0:
                        gone.add(y)
                        break
        return pa.table({"grp": pa.array([r[0] for r in out], pa.string()), "later": pa.array([r[1] for r in out], pa.int64()), "earlier": pa.array([r[2] for r in out], pa.int64())})

    return run


def _dropped(t):
    """Later rows with an earlier one that stays, decided in order."""
    import pyarrow as pa

    near: dict[int, list[int]] = {}
    for x, y in zip(t["later"].to_pylist(), t["earlier"].to_pylist()):
        near.setdefault(x, []).append(y)
    gone: set[int] = set()
    for x in sorted(near):
        if any(y not in gone for y in near[x]):
            gone.add(x)
    return pa.table({"grp": pa.array([t["grp"][0].as_py()] * len(gone), pa.string()), "first": pa.array(sorted(gone), pa.int64())})


def greedy_near(df: DataFrame, group: str, id_col: str, text_col: str, *, threshold: float = 0.85, block: int = 4096, chars: int = 1 << 24) -> DataFrame:
    """``(grp, id, kept)``: a row stays unless its sequence ratio with an earlier kept row of its group exceeds the threshold.

    A null group counts as the empty one, a null text as empty.  Equal texts
    are one class, as a text's ratio with itself is 1.  Groups of up to
    ``block`` texts and ``chars`` characters are bundled and walked whole.  In
    a larger one blocks of the texts by length are compared with each other
    wherever lengths allow, so it is work for many tasks, and only its similar
    pairs are walked in order, as the ratio does not depend on what stays.
    Bounds on the matched characters spare nearly all pairs the ratio, never
    one above the threshold.
    """
    from millrace.runtime import stage

    src = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    same = src.groupBy("grp", "text").agg(F.min("id").alias("first"), F.collect_list("id").alias("ids")).withColumn("n", F.char_length("text"))
    same = stage(same, "near-texts")
    groups = same.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("c"))
    groups = stage(groups.withColumn("large", (F.col("m") > block) | (F.col("c") > chars)), "near-groups")
    rest = groups.where("not large").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
    bundles = 1 + max(2 * rest.m // block, 2 * rest.c // chars)
    large = F.broadcast(groups.where("large").select("grp"))  # at most rows / block or characters / chars
    bundle = (-1 - F.pmod(F.hash("grp"), F.lit(bundles))).cast("int")
    whole = same.join(large, "grp", "left_anti").select(F.lit("").alias("unit"), bundle.alias("p"), bundle.alias("q"), bundle.alias("block"), "grp", F.col("first").alias("id"), "text")
    by_length = Window.partitionBy("grp").orderBy("n", "first")
    number = F.floor((F.row_number().over(by_length) - 1) / block) + F.floor(F.sum("n").over(by_length.rowsBetween(Window.unboundedPreceding, 0)) / chars)
    placed = stage(same.join(large, "grp", "left_semi").select("grp", "first", "n").withColumn("block", number.cast("int")), "near-blocks")
    sizes = placed.groupBy("grp", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("m"))
    x = sizes.select("grp", F.col("block").alias("p"), F.col("hi"), F.col("m"))
    y = sizes.select("grp", F.col("block").alias("q"), F.col("lo"))
    reach = (F.col("p") == F.col("q")) & (F.col("m") > 1) | (F.col("p") < F.col("q")) & ((F.col("lo") <= F.col("hi")) | (F.col("hi") * 2.0 > (F.col("hi") + F.col("lo")) * (threshold - 1e-9)))
    pairs = x.join(y, "grp").where(reach).select("grp", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    # Blocks first meet their pairs without the texts, which move once a pair.
    todo = placed.join(pairs, ["grp", "block"]).select("grp", "first", "block", "p", "q")
    todo = todo.join(same.select("grp", "first", "text"), ["grp", "first"]).select(F.col("grp").alias("unit"), "p", "q", "block", "grp", F.col("first").alias("id"), "text")
    near = stage(whole.unionByName(todo).groupBy("unit", "p", "q").applyInArrow(_similar(threshold), "grp string, later bigint, earlier bigint"), "near-pairs")
    walked = near.where("earlier is not null").groupBy("grp").applyInArrow(_dropped, "grp string, first bigint")
    gone = near.where("earlier is null").select("grp", F.col("later").alias("first")).unionByName(walked).withColumn("gone", F.lit(True))
    out = same.select("grp", "first", "ids").join(gone, ["grp", "first"], "left").select("grp", "first", "gone", F.explode("ids").alias("id"))
    return out.select("grp", "id", ((F.col("id") == F.col("first")) & F.col("gone").isNull()).alias("kept"))


def numbered(df: DataFrame, order: list[Column], prefix: str = "SCG-", width: int = 6) -> DataFrame:
    """With ``seq_id`` from each row's place in the order, from 1.

    Places come from the rows in the partitions before, not from one window over all rows.
    """
    from millrace.runtime import stage

    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__b"))  # one row per partition
    out = placed.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return out.withColumn("seq_id", F.format_string(f"{prefix}%0{width}d", at + F.col("__b") + 1)).drop("__m", "__p", "__b")
