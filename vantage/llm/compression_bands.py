"""Quality rules over compression (operator 12).

Text that a compressor shrinks too well repeats itself, text that it can't shrink is noise (keys, encoded
blobs, random strings).  What is too well or too little depends on the length, for a frame has fixed
costs and a longer text has more to refer back to, so both limits come from a table of length bands.
They apply to the whole document and to each fixed chunk of its UTF-8 bytes; the chunks find a blob or a
repeated stretch that the rest of a document hides.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .registry import query
from .store import table

LEVEL = 3
CHUNK_BYTES = 4096
#: A document fails when chunks outside their band hold more than this share of its bytes.
MAX_BAD_SHARE = 0.25
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_SYMBOLS = b"#*$%&|<>"


class Band(NamedTuple):
    """Ratios (bytes / compressed bytes) that texts of at least ``from_bytes`` bytes may have."""

    from_bytes: int
    low: float
    high: float


#: Random base64 text tends to 8/6 = 1.33, less in short frames; prose of alphabets and of CJK scripts
#: lies between 1.4 (some hundred bytes) and 3, lists, tables and templates reach 4 to 6.
BANDS = (Band(0, 0.0, 3.0), Band(256, 1.2, 3.0), Band(512, 1.3, 3.5), Band(1024, 1.4, 4.0), Band(4096, 1.45, 5.0),
         Band(16384, 1.5, 6.0), Band(65536, 1.5, 8.0), Band(1 << 20, 1.5, 10.0))

_COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "kept boolean, n_bytes long, ratio double, bad_chunk_bytes long, reason string")


def n_repeat_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included; exact, no hashing.

    Words become numbers; numbers of pairs, then of pairs of pairs, ... number the windows.
    """
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    width, names = 1, len(number)
    if names == n:
        return 0
    while width < window:
        step = min(width, window - width)
        pairs = ids[:n - width - step + 1] * names + ids[step:n - width + 1]
        distinct, ids = np.unique(pairs, return_inverse=True)
        width, names = width + step, len(distinct)
    again = np.flatnonzero(np.bincount(ids, minlength=names)[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[again] += 1
    edges[again + window] -= 1
    return int(np.count_nonzero(np.cumsum(edges)))


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, lines equal to an earlier one, words in repeated windows).

    Words are runs of bytes other than space, tab, LF, VT, FF and CR, as ``bytes.split`` cuts them.
    """
    words = data.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    chars = int(np.count_nonzero((joined & 0xC0) != 0x80))
    symbols = sum(data.count(bytes((c,))) for c in _SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), n_repeat_words(words)


def in_band(n_bytes: int, ratio: float, bands: Iterable[Band] = BANDS) -> str:
    """'' where the ratio is allowed for a text of this length, else 'repetitive' or 'incompressible'."""
    band = max((b for b in bands if b.from_bytes <= n_bytes), key=lambda b: b.from_bytes, default=None)
    if band is None:
        return ""
    return "repetitive" if ratio > band.high else "incompressible" if ratio < band.low else ""


def judge(data: bytes, compress, bands: Iterable[Band] = BANDS, chunk_bytes: int = CHUNK_BYTES,
          max_bad_share: float = MAX_BAD_SHARE) -> tuple[float | None, int, str]:
    """(ratio, bytes in failing chunks, reason or '') of one text; empty texts have no ratio and no reason.

    A last chunk shorter than the others is judged by the band of its own length.
    """
    if not data:
        return None, 0, ""
    ratio = len(data) / len(compress(data))
    reason = in_band(len(data), ratio, bands)
    bad = 0
    if len(data) > chunk_bytes:
        for at in range(0, len(data), chunk_bytes):
            piece = data[at:at + chunk_bytes]
            if in_band(len(piece), len(piece) / len(compress(piece)), bands):
                bad += len(piece)
    if not reason and bad > max_bad_share * len(data):
        reason = "chunks"
    return ratio, bad, reason


def _texts(column: pa.Array) -> Iterable[bytes]:
    for value in column.cast(pa.large_string()).cast(pa.large_binary()):
        yield value.as_py() or b""


def assess(docs: DataFrame, bands: Sequence[Band] = BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad_share: float = MAX_BAD_SHARE) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id and text): counts, ratio, verdict and its reason.

    Null and empty texts have no words, hence fail the base rules; ratio is null there.  Null and repeated
    doc_ids are kept as they are, other columns are not read.  ``reason`` names the first rule that fails:
    words, repeats, repetitive, incompressible or chunks.
    """
    bands = tuple(bands)

    def run(batches):
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            rows = []
            for data in _texts(batch.column(1)):
                counts = base_counts(data)
                few, repeats = counts[0] < MIN_WORDS, 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                ratio, bad, reason = judge(data, compress, bands, chunk_bytes, max_bad_share)
                reason = "words" if few else "repeats" if repeats else reason
                rows.append((*counts, few or repeats, not reason, len(data), ratio, bad, reason or None))
            columns = list(zip(*rows, strict=True)) or [()] * 11
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.int64(), pa.string()]
            names = [c.split()[0] for c in _COLUMNS.split(", ")]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, _COLUMNS)


def keep_good(docs: DataFrame, bands: Sequence[Band] = BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad_share: float = MAX_BAD_SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes the base rules and its compression bands."""
    bands, at = tuple(bands), docs.columns.index("text")

    def good(data: bytes, compress) -> bool:
        counts = base_counts(data)
        return (counts[0] >= MIN_WORDS and 100 * counts[4] <= MAX_REPEAT_PERCENT * counts[0]
                and not judge(data, compress, bands, chunk_bytes, max_bad_share)[2])

    def run(batches):
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            yield batch.filter(pa.array([good(x, compress) for x in _texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@query("op12_compression_bands")
def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents", "doc_id", "text"))
