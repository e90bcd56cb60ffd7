"""Vectorised helpers over Arrow text columns, used inside Spark tasks.

A record batch holds its texts in one byte buffer.  The helpers cut that buffer into
runs of documents of a few megabytes and answer questions about all words of a run
with numpy: where words lie, what their 64-bit hashes are, and so on.  White space is
the six ASCII characters ``\\t \\n \\v \\f \\r`` and space throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; a longer document is a run of its own.
RUN_BYTES = 1 << 20
#: Bytes whose words are hashed at once.
HASH_BLOCK = 1 << 18

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 2**64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * HASH_BLOCK:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def runs(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, rows, bytes, offsets)`` over a text column; null reads as empty.

    ``offsets`` has one more entry than the run has rows and starts at 0.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        upto = int(np.searchsorted(offsets, offsets[at] + run_bytes, "right")) - 1
        upto = min(max(upto, at + 1), n)
        yield at, upto - at, raw[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def words(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, words per document)`` of the words of a run, which white space or other bytes separate."""
    n_docs = len(offsets) - 1
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(n_docs, np.int64)
    inside = ~between[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a document ends or begins before this byte
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)`` of a run; equal spans hash alike.

    Spans are in order and do not overlap; they are hashed block by block, which bounds memory.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(start, start[i] + HASH_BLOCK)), i + 1)
        low, high = int(start[i]), int(end[j - 1])
        s, e = start[i:j] - low, end[i:j] - low
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * _power(_P, high - low), dtype=np.uint64, out=total[1:])
        out[i:j] = (total[e] - total[s]) * _power(_PINV, high - low + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def windows(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n`` consecutive words within one document, and the document of each.

    The windows are those of ``window_places``, in that order.
    """
    places, doc = window_places(counts, n)
    h = hashes[places]
    for k in range(1, n):
        h = mix(h) * np.uint64(0xD6E8FEB86659FD93) + hashes[places + k]
    return mix(h + np.uint64(n)), doc


def window_places(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every ``n``-word window that stays within its document, and the document."""
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(doc))
    places = np.flatnonzero(left >= n)
    return places, doc[places]


def crc32_of_id(ids: pa.Array) -> np.ndarray:
    """``crc32`` of each id written as text; a null id counts as the empty text."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) for x in ids.to_pylist()), np.int64, len(ids))


def trimmed(batches):
    """The batches, with what a task has freed given back to the system before and after: workers are reused."""
    give_back()
    yield from batches
    give_back()


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
