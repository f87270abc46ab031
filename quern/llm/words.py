"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; since those are ASCII,
bytes and characters agree on where words end. Nothing here makes a Python
object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another and padded with zeros, and the offset of each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(PAD, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    out = np.zeros(len(raw) + PAD, np.uint8)
    out[: len(raw)] = raw
    return out, at - at[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and how many words each text has."""
    n = int(offsets[-1])
    body = data[:n]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~((body == 32) | ((body >= 9) & (body <= 13)))
    starts = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] = inside[1:-1][cuts]
    stops[cuts - 1] = inside[1:-1][cuts - 1]
    first = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(first, offsets))
    return first, np.flatnonzero(stops) + 1, counts


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    lanes = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,))
    lengths = (ends - starts).astype(np.int64)
    h = (lengths.astype(np.uint64) + np.uint64(1)) * _M2
    live, at, left = np.arange(len(starts)), starts.copy(), lengths
    while len(live):
        word = lanes[at]
        short = left < 8
        if short.any():
            word = np.where(short, word & ((np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), word)
        x = (h[live] ^ word) * _M1
        h[live] = (x ^ (x >> np.uint64(32))) * _M2
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    h ^= h >> np.uint64(29)
    return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of one sequence followed by another, from the hashes of both."""
    x = (a * _M1) ^ (a >> np.uint64(31))
    x = (x + b) * _M2
    return x ^ (x >> np.uint64(30))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out = power
            else:
                m = min(len(out), len(power) - have)
                out = pair(out[:m], power[have : have + m])
            have += size
        if have == k:
            return out[:n]
        power = pair(power[: len(power) - size], power[size:])
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every ``w`` consecutive values."""
    if len(x) < w:
        return x[:0]
    power, size = x, 1
    while size * 2 <= w:
        power = np.minimum(power[: len(power) - size], power[size:])
        size *= 2
    n = len(x) - w + 1
    return np.minimum(power[:n], power[w - size :][:n])


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: bytes and offsets.

    The byte before a word that is not its text's first is white space; it
    becomes the joining space.
    """
    n = int(offsets[-1])
    out = data[:n].copy()
    text = np.repeat(np.arange(len(counts)), counts)[keep]
    s, e = starts[keep], ends[keep]
    change = np.zeros(n + 1, np.int8)
    change[s] += 1
    ends_of = np.zeros(n + 1, np.int8)
    ends_of[e] += 1
    mask = np.cumsum(change[:n] - ends_of[:n], dtype=np.int8).astype(bool)
    later = s[1:][text[1:] == text[:-1]] if len(s) else s
    out[later - 1] = 32
    mask[later - 1] = True
    sizes = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets]
    return out[mask], sizes
