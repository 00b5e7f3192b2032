"""Vectorised text primitives on Arrow columns: word spans, word hashes, word n-gram hashes.

All hashes are 64-bit and depend on the text alone, so that every task and
every session computes the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts are handled in groups of about this size, which bounds a worker's memory

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U), 7) | _U(1)
_CODE_WORD = np.zeros(256, dtype=bool)
_CODE_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_"]] = True
_TEXT_WORD = np.ones(256, dtype=bool)
_TEXT_WORD[32] = False


def _powers(n: int) -> np.ndarray:
    p = np.empty(n + 1, dtype=_U)
    p[0] = 1
    if n:
        p[1:] = _ODD
        np.multiply.accumulate(p, out=p)
    return p


_POW = _powers(1 << 16)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(start, stop) of consecutive rows whose texts have about ``limit`` bytes together."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    at, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(size):
        yield at, len(size)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and the offset of each row (one more than rows); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column])
    n = len(column)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def _word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each byte span, whatever lies around it."""
    if not len(start):
        return np.zeros(0, _U)
    length = stop - start
    out = np.zeros(len(start), _U)
    short = length <= 64
    # Horner steps over the words still having bytes; words of ordinary length need few.
    order = np.nonzero(short)[0]
    at, left, h = start[order], length[order].copy(), np.zeros(len(order), _U)
    live = np.arange(len(order))
    step = 0
    while len(live):
        h[live] = h[live] * _ODD + _BYTE[data[at[live] + step]]
        step += 1
        live = live[left[live] > step]
    out[order] = h
    for i in np.nonzero(~short)[0]:
        b = _BYTE[data[start[i] : stop[i]]]
        p = _POW if len(b) < len(_POW) else _powers(len(b))
        out[i] = (b * p[: len(b)][::-1]).sum(dtype=_U)
    return mix(out + length.astype(_U) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of each run of word bytes within a row."""
    n = len(data)
    w = np.zeros(n + 2, dtype=bool)
    w[1:-1] = is_word[data]
    edge = w[1:] != w[:-1]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True  # a row's border ends a run
    inside = w[1:-1]
    begin = np.zeros(n + 1, dtype=bool)
    begin[:n] = inside & (edge[:-1] | cut[:n])
    end = np.zeros(n + 1, dtype=bool)
    end[1:] = inside & (edge[1:] | cut[1:])
    start, stop = np.nonzero(begin)[0], np.nonzero(end)[0]
    row = np.searchsorted(off, start, side="right") - 1
    return row, start, stop


def ngrams(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index of the first word, hash) of each sequence of n consecutive words within a row."""
    m = len(h) - n + 1
    if m <= 0:
        return row[:0], np.zeros(0, np.int64), np.zeros(0, _U)
    g = np.zeros(m, _U)
    for i in range(n):
        g = g * _ODD + h[i : i + m]
    same = row[:m] == row[n - 1 :]
    first = np.nonzero(same)[0]
    return row[first], first, mix(g[first], 3)


def code_shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct sequences of n words [a-z0-9_] of each lower-cased text, sorted by row and hash.

    A text of fewer words than n, but at least one, has its whole word sequence as its one member.
    """
    data, off = as_bytes(pc.utf8_lower(column))
    row, start, stop = words(data, off, _CODE_WORD)
    h = _word_hashes(data, start, stop)
    count = np.bincount(row, minlength=len(column))
    r, _, g = ngrams(row, h, n)
    few = np.nonzero((count > 0) & (count < n))[0]
    if len(few):
        first = np.searchsorted(row, few)
        own = np.zeros(len(few), _U)
        for k in range(n - 1):
            has = count[few] > k
            own[has] = own[has] * _ODD + h[first[has] + k]
        r, g = np.concatenate([r, few]), np.concatenate([g, mix(own, 5)])
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    keep = np.ones(len(r), dtype=bool)
    keep[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return r[keep], g[keep]


def prose_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, hash) of each run of letters and digits of the lower-cased texts, and the texts with single blanks between words."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), pattern=r"[^\p{L}\p{N}]+", replacement=" ")
    data, off = as_bytes(plain)
    row, start, stop = words(data, off, _TEXT_WORD)
    return row, _word_hashes(data, start, stop), plain
