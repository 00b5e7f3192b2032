"""Texts put into containers of fixed capacity by minimum bin slack.

Only the histogram of lengths, at most as many entries as the capacity,
reaches the driver.  There a container is filled with the longest length left
and the multiset of lengths that comes closest to the room that remains, found
by subset sums over a bitset and tracked back with counts; the pattern is
repeated as often as the counts allow, so the work does not grow with the
number of texts.  Texts then take the places of their length in order of a
global sort by length and id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.capping import exact_ranks
from millrace.runtime import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are split before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def _encoding(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def _lengths(path: str):
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], schema=schema)

    return run, "id bigint, tokens bigint"


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, tokens)``; null and empty texts have none."""
    run, kind = _lengths(tokenizer)
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col)).mapInArrow(run, kind)


def _fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths whose sum is the largest not above ``room``."""
    mask = (1 << (room + 1)) - 1
    sets: list[tuple[int, int]] = []  # length, sums reachable before it
    have = 1
    for n in sorted((x for x in counts if x <= room), reverse=True):
        sets.append((n, have))
        left, step = min(counts[n], room // n), 1
        while left and not have >> room & 1:
            k = min(step, left)
            have |= have << (n * k) & mask
            left -= k
            step *= 2
        if have >> room & 1:
            break
    at, out = have.bit_length() - 1, {}
    for n, before in reversed(sets):
        k = 0
        while not before >> at & 1:
            at -= n
            k += 1
        if k:
            out[n] = k
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(containers, lengths with their number in each) until nothing is left."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        use = _fill(capacity - longest, rest)
        use[longest] = use.get(longest, 0) + 1
        times = min(left[n] // k for n, k in use.items())
        out.append((times, use))
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _places(capacity: int, table):
    """Container and place of (id, piece, tokens, rank)."""
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int64()), ("tokens", pa.int64()), ("container", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = table.value
        for batch in batches:
            tokens, rank = np.asarray(batch.column(2)), np.asarray(batch.column(3)) - 1
            box, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(tokens):
                if not n:
                    continue  # an empty text takes no room: the first container's start
                at = np.nonzero(tokens == n)[0]
                start, first, each, base = of[int(n)]
                i = np.searchsorted(start, rank[at], side="right") - 1
                box[at] = first[i] + (rank[at] - start[i]) // each[i]
                place[at] = base[i] + (rank[at] - start[i]) % each[i] * n
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(box), pa.array(place)], schema=schema)

    return run, "id bigint, piece bigint, tokens bigint, container bigint, place bigint"


def pack(df: DataFrame, id_col: str, text_col: str, *, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, piece, tokens, container, place)``, a row per text, or per piece of a text longer than a container.

    Pieces but the last fill a container.  Null and empty texts have no tokens
    and lie at the start of container 0.  Ids must be unique.
    """
    lengths = stage(token_counts(df, id_col, text_col, tokenizer), "pack-lengths")
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1)
    pieces = lengths.select("id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("id", F.col("piece").cast("bigint").alias("piece"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("bigint").alias("tokens"))
    counts = {r["tokens"]: r["count"] for r in pieces.groupBy("tokens").count().where("tokens > 0").toArrow().to_pylist()}
    table: dict = {n: ([], [], [], []) for n in counts}
    used = dict.fromkeys(counts, 0)
    box = 0
    for times, use in patterns(counts, capacity):
        base = 0
        for n, k in sorted(use.items(), reverse=True):
            start, first, each, at = table[n]
            start.append(used[n])
            first.append(box)
            each.append(k)
            at.append(base)
            used[n] += k * times
            base += k * n
        box += times
    table = {n: tuple(np.asarray(x, np.int64) for x in t) for n, t in table.items()}
    shared = df.sparkSession.sparkContext.broadcast(table)  # at most capacity lengths in each of the patterns
    ranked = exact_ranks(pieces, ["id", "piece"], F.lpad(F.col("tokens").cast("string"), 12, "0"), F.lit(0.0), keep=["tokens"])
    run, kind = _places(capacity, shared)
    return ranked.select("id", "piece", "tokens", "rank").mapInArrow(run, kind).withColumnRenamed("id", id_col)
