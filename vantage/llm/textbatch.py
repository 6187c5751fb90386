"""Vectorised word and shingle hashing over Arrow text columns.

Everything works on the UTF-8 bytes of a block of documents at a time, so memory is bounded by the
block (or by one document where that is longer) and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20
#: Odd multipliers of the rolling hashes; any odd 64-bit values do.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_MUL = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _fold_table(separator) -> np.ndarray:
    """byte -> folded byte + 1, or 0 for separators (255 never occurs in UTF-8)."""
    lut = np.zeros(256, np.uint8)
    for b in range(255):
        if not separator(b):
            lut[b] = (b + 32 if 65 <= b <= 90 else b) + 1
    return lut


#: Words are runs of anything but space, tab, LF, VT, FF and CR; A-Z are folded.
SPACE_WORDS = _fold_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and non-ASCII bytes; A-Z are folded.
ALNUM_WORDS = _fold_table(lambda b: b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive row ranges; null texts are empty."""
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if not n:
        return
    _, off_buf, data_buf = arr.buffers()
    off = np.frombuffer(off_buf, np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block_bytes, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, row) of every word of a block, in text order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    folded = lut[data]
    inside = folded != 0
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edge = offsets[1:-1]
    before[edge[edge < len(data)]] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    p, p_inv = _power_tables(len(data))
    total = np.cumsum(folded.astype(np.uint64) * p, dtype=np.uint64)
    upto = total[ends - 1]
    upto -= np.where(starts > 0, total[np.maximum(starts, 1) - 1], np.uint64(0))
    row = np.searchsorted(offsets, starts, "right") - 1
    return mix(upto * p_inv[starts]), starts, ends, row


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of ``h`` (k <= 6)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[:len(h) - k + 1] * _MUL[0]
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _MUL[j] + h[j:len(h) - k + 1 + j]
    return mix(out)


def shingle_sets(column: pa.Array, k: int = 5, lut: np.ndarray = SPACE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column.

    Texts of fewer than ``k`` words give one hash of their whole sequence; texts without words none.
    """
    for lo, hi, data, off in text_blocks(column):
        h, _, _, row = words(data, off, lut)
        all_grams = grams(h, k)
        at = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                g = np.sort(all_grams[a:b - k + 1])
                yield lo + i, g[np.concatenate(([True], g[1:] != g[:-1]))]
            elif b > a:
                yield lo + i, np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), int(b - a))], np.uint64)
            else:
                yield lo + i, np.zeros(0, np.uint64)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits of an array as two signed longs."""
    d = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), "<i8")
    return int(d[0]), int(d[1])
