"""Evaluation texts inside corpus documents, verbatim or with other numbers, names and units.

A word is a run of letters and digits, lower-cased.  Templates put a typed
placeholder where a word is a number (it begins with a digit), a unit (a fixed
list) or a name.  Each text is read in two canonical forms:

* words as they stand, numbers and units as placeholders.  It depends on each
  word alone, so windows that agree word by word agree in it whatever is
  around them and whatever their case;
* names, too.  A name is told by its form before lower-casing, in item and
  document alike: camel case, a capital inside a sentence (then wherever the
  same text writes that word with a capital), a word in quotation marks or an
  identifier with underscores.  Neighbouring words of one type are one
  placeholder, so ``New York`` can stand for ``Berlin``.

Windows of ``window`` places are joined by the template's hash, windows with
fewer than ``least_literals`` literal words by the hash of the words
themselves, so templates of placeholders alone join nothing.  The words in the
placeholders' places decide what was met: equal ones make a verbatim window;
other ones a re-parameterised window, if along the whole passage (windows at
one distance between document and item) each item value stands for one
document value and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import vec
from millrace.runtime import stage

BROADCAST_WINDOWS = 2_000_000  # item windows up to which their hashes go to the workers (16 MB); more are joined by shuffle
BROADCAST_ROWS = 200_000  # item windows up to which their slots go to the workers; more are joined by shuffle
SALTS = 16  # parts of the documents' windows of a key where items are joined by shuffle
# Words that count as units.
UNITS = ("ms", "s", "sec", "secs", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
         "year", "years", "kb", "mb", "gb", "tb", "byte", "bytes", "km", "m", "cm", "mm", "kg", "g", "mg", "percent", "usd", "eur", "gbp",
         "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "gram", "grams", "kilogram", "kilograms",
         "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees")
_U = np.uint64
_NUMBER, _UNIT, _NAME = 1, 2, 3
_KIND = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], _U)
_OPEN = np.ones(256, dtype=bool)
_OPEN[[1, 2, 3, 32]] = False


def _hash_words(texts: list[str]) -> np.ndarray:
    return np.unique(vec.prose_words(pa.array(texts, pa.string()))[1])


def _member(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(h), bool)
    return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h


def _names(column: pa.Array, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each word whether the text writes it as a name."""
    x = pc.fill_null(column, "")
    # What stands between two words becomes one mark: a sentence's end, a quotation mark, underscores alone, or anything else.
    for pattern, mark in (
        (r"[^\p{L}\p{N}]*(?:[.!?:;][\s\"'`)\]]|[\n\r])[^\p{L}\p{N}]*", "\x01"),
        (r"[^\p{L}\p{N}\x01]*[\"`][^\p{L}\p{N}\x01]*", "\x03"),
        (r"[^\p{L}\p{N}\x01-\x03]*[^\p{L}\p{N}\x01-\x03_][^\p{L}\p{N}\x01-\x03]*", " "),
        (r"_+", "\x02"),
    ):
        x = pc.replace_substring_regex(x, pattern=pattern, replacement=mark)
    data, off = vec.as_bytes(x)
    r, start, stop = vec.words(data, off, _OPEN)
    if len(r) != len(row):  # a letter whose lower case is no letter: no names are told apart then
        return np.zeros(len(row), bool)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    low_data, low_off = vec.as_bytes(pc.utf8_lower(x))
    _, low_start, _ = vec.words(low_data, low_off, _OPEN)
    if len(low_start) != len(row):
        return np.zeros(len(row), bool)
    second = np.minimum(start + 1, len(data) - 1)
    low_second = np.minimum(low_start + 1, len(low_data) - 1)
    capital = (data[start] != low_data[low_start]) | ((data[start] >= 0xC0) & (data[second] != low_data[low_second]))
    ups, lows = upper[stop] - upper[start], lower[stop] - lower[start]
    capital &= (stop - start > 1) & ((ups == 0) | (lows > 0) | (data[start] >= 0xC0))  # words in capitals alone are no names
    camel = (lows > 0) & (ups - ((data[start] >= 65) & (data[start] <= 90)) > 0)
    before = np.where(start > off[r], data[np.maximum(start - 1, 0)], 1)
    behind = np.where(stop < off[r + 1], data[np.minimum(stop, len(data) - 1)], 1)
    identifier = (before == 2) | (behind == 2) | ((before == 3) & (behind == 3))
    inside = capital & (before != 1)
    own = vec.mix(h + r.astype(_U) * _U(0x9E3779B97F4A7C15), 41)
    return camel | identifier | (capital & _member(own, np.unique(own[inside])))


def _windows(window: int, least_literals: int, wanted):
    """(id, pos, form, key, exact, slots) of each window, of those whose key is wanted where a set is given."""
    schema = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("form", pa.int32()), ("key", pa.int64()), ("exact", pa.int64()), ("slots", pa.list_(pa.int64()))])
    units = _hash_words(list(UNITS))

    def cut(ids, row, h, kind, form, want, differs=None):
        """Windows over places with their values ``h`` and types, those that ``differs`` marks a place of where it is given."""
        r, first, key = vec.ngrams(row, np.where(kind > 0, _KIND[kind], h), window)
        if not len(r):
            return
        _, _, exact = vec.ngrams(row, h, window)
        slot = kind > 0
        ahead = np.concatenate([[0], np.cumsum(slot)])
        n = ahead[first + window] - ahead[first]
        few = window - n < least_literals
        if form:
            marks = np.concatenate([[0], np.cumsum(differs)])
            keep = ~few & (marks[first + window] > marks[first])
        else:
            key = np.where(few, vec.mix(exact, 43), key)
            keep = np.ones(len(r), bool)
        if want is not None:
            keep &= _member(key, want)
        r, first, key, exact, n = r[keep], first[keep], key[keep], exact[keep], n[keep]
        if not len(r):
            return
        where = np.nonzero(slot)[0]
        off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        pick = np.repeat(ahead[first] - off[:-1], n) + np.arange(off[-1])
        pos = (first - np.searchsorted(row, r)).astype(np.int32)
        yield pa.record_batch(
            [ids.take(pa.array(r)), pa.array(pos), pa.array(np.full(len(r), form, np.int32)), pa.array(key.view(np.int64)), pa.array(exact.view(np.int64)),
             pa.ListArray.from_arrays(pa.array(off), pa.array(h[where[pick]].view(np.int64)))],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = None if wanted is None else wanted.value
        for batch in batches:
            for i, j in vec.chunks(batch.column(1)):
                ids, column = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                row, h, plain = vec.prose_words(column)
                if len(h) < window:
                    continue
                data, off = vec.as_bytes(plain)
                _, start, _ = vec.words(data, off, vec._TEXT_WORD)
                digit = (data[start] >= 48) & (data[start] <= 57)
                kind = np.where(digit, _NUMBER, np.where(_member(h, units), _UNIT, 0))
                yield from cut(ids, row, h, kind, 0, want)
                name = _names(column, row, h) & (kind == 0)
                kind = np.where(name, _NAME, kind)
                follows = np.zeros(len(h), bool)
                follows[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & (row[1:] == row[:-1])
                begin = np.nonzero(~follows)[0]
                place = np.arange(len(h)) - begin[np.cumsum(~follows) - 1]
                value = np.add.reduceat(np.where(place > 0, vec.mix(h + place.astype(_U), 47), h), begin)
                several = np.diff(np.append(begin, len(h))) > 1
                yield from cut(ids, row[begin], value, kind[begin], 1, want, name[begin] | several)

    return run, "id bigint, pos int, form int, key bigint, exact bigint, slots array<bigint>"


def leaked_items(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, *, window: int = 13, least_literals: int = 8, bound: int = BROADCAST_WINDOWS
) -> DataFrame:
    """One row ``(doc_id, item_id, verbatim, reworded)`` per document and item with a window in common.

    ``verbatim`` counts the document's windows that occur word by word in the
    item; ``reworded`` those that occur with other slot values only, for which
    at least ``least_literals`` of the places must be literal and the passage's
    values consistent.  Null texts and texts of fewer than ``window`` words
    have no windows.  Repeated windows of a document count once per place.
    ``bound`` chooses between broadcast and shuffle and never changes the rows.
    """
    spark = docs.sparkSession
    item = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text"))
    doc = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(doc_text).alias("text"))
    run, kind = _windows(window, least_literals, None)
    asked = stage(item.mapInArrow(run, kind), "leak-items")
    number = asked.count()
    wanted = None
    if number <= bound:
        hashes = asked.select("key").distinct().toArrow()["key"].to_numpy().view(_U)
        wanted = spark.sparkContext.broadcast(np.sort(hashes))
    run, kind = _windows(window, least_literals, wanted)
    met = doc.mapInArrow(run, kind)
    q = asked.select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "form", "key", F.col("exact").alias("item_exact"), F.col("slots").alias("item_slots"))
    if number <= min(bound, BROADCAST_ROWS):
        both = met.join(F.broadcast(q), ["form", "key"])
    else:
        # The windows of a key that many documents hold are dealt to parts; the items' windows go to each.
        met = met.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)))
        both = met.join(q.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["form", "key", "salt"])
    same = F.col("exact") == F.col("item_exact")
    literal = (F.col("form") == 0) & same
    # A passage: windows at one distance.  Its values must map one to one.
    passage = both.groupBy("id", "item", "form", (F.col("pos") - F.col("item_pos")).alias("distance")).agg(
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("slots", "item_slots")))).alias("values"),
        F.collect_set(F.when(literal, F.col("pos"))).alias("equal"), F.collect_set(F.when(~same, F.col("pos"))).alias("other"),
    )
    n = F.size("values")
    one_to_one = (F.size(F.array_distinct("values.slots")) == n) & (F.size(F.array_distinct("values.item_slots")) == n)
    passage = passage.select("id", "item", "equal", F.transform(F.when(one_to_one, F.col("other")).otherwise(F.array().cast("array<int>")), lambda p: F.struct(F.col("form").alias("form"), p.alias("at"))).alias("other"))
    out = passage.groupBy("id", "item").agg(F.array_distinct(F.flatten(F.collect_list("equal"))).alias("equal"), F.array_distinct(F.flatten(F.collect_list("other"))).alias("other"))
    # A place met word by word anywhere in the item is not counted as reworded.
    reworded = F.filter(F.col("other"), lambda x: ~((x["form"] == 0) & F.array_contains("equal", x["at"])))
    out = out.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), F.size("equal").cast("bigint").alias("verbatim"), F.size(reworded).cast("bigint").alias("reworded"))
    return out.where((F.col("verbatim") > 0) | (F.col("reworded") > 0))
