"""Text rules that several operators share.

White space is the six ASCII code points ``\\x20 \\x09-\\x0D`` and case folding
touches A-Z only, so results do not depend on a locale or a Unicode version.
"""

from __future__ import annotations

import ctypes
import string
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z.  All-ASCII strings take the JVM's fast path."""
    slow = F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(slow)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- numpy side

_RNG = np.random.default_rng(0x7D3)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    if len(_POW.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up = np.full(size, _R, np.uint64)
        down = np.full(size, _R_INV, np.uint64)
        up[0] = down[0] = 1
        _POW["up"], _POW["down"] = np.cumprod(up), np.cumprod(down)
    return _POW["up"][:n], _POW["down"][:n]


def prefix_hash(data: np.ndarray, second: bool = False) -> np.ndarray:
    """h with h[i] = hash of data[:i]; see ``span_hash``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE2 if second else _TABLE)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that do not depend on where the span lies."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start])


_LAST = [0.0]


def give_back() -> None:
    """Return freed memory to the system, at most once a second: a worker lives on, beside others of its executor."""
    if time.monotonic() - _LAST[0] < 1:
        return
    _LAST[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def byte_chunks(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for slices of about ``limit`` bytes.

    Nulls count as empty texts.  A text longer than ``limit`` is a slice of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; a word never crosses a row's border."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_IS_SPACE[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    starts[borders] |= word[borders]
    ends[borders - 1] |= word[borders - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z in UTF-8 bytes."""
    return _FOLD[data]


def byte_planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, first all lowest bytes: bytes that are alike lie together and compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(raw, kind, n: int) -> np.ndarray:
    """The ``n`` numbers that ``byte_planes`` made the first bytes of ``raw`` from."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T.copy().view(kind).ravel()
