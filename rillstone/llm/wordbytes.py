"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A column's UTF-8 bytes are classified with a 256-entry table, word borders come
from two shifted comparisons and word hashes from one wrapped prefix sum.  Bytes
of characters beyond ASCII are all 0x80 or more, so byte classes are exact for
the two word patterns used here:

* ``ALNUM``: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z;
* ``SPACED``: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

Null texts count as empty.  A word hash is a 64-bit polynomial of the word's
bytes, mixed; different words share one with probability about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
ALNUM = (((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 97) & (_CODES <= 122)) | _UPPER | (_CODES >= 128))
SPACED = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))

_tables: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; grown by doubling and kept."""
    if len(_tables["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, factor in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"][:n], _tables["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(column: pa.Array, limit: int = 1 << 20):
    """Yield ``(first_row, offsets, data)`` for runs of rows of about ``limit`` bytes.

    ``data`` is a uint8 view of the run's bytes and ``offsets`` (len rows + 1)
    gives each row's place in it.  A row longer than ``limit`` is a run of its own.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Words of one run: ``(hashes, starts, ends, first)``.

    ``starts``/``ends`` are byte places in the run; ``first`` (len rows + 1) gives
    the index of each row's first word, so row r owns words first[r]:first[r + 1].
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    up, down = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (len - k + 1 values; none if shorter)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)


def crc_rest(ids: list, modulus: int) -> list:
    """crc32 of each id's text modulo ``modulus``; null ids give None."""
    import zlib

    return [None if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids]
