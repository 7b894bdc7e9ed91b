"""Words and word hashes of Arrow text columns, vectorised over whole batches.

A word is a maximal run of word bytes; both word classes used here are defined by ASCII separators, so
working on UTF-8 bytes equals working on characters. A word's 64-bit hash depends on its bytes alone:
polynomial prefix sums over the batch give every word's value without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18       # bytes hashed at a time, cut between words
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (every input bit reaches every output bit)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordClass:
    """A word class given by its separator bytes; ``lower`` folds A-Z."""

    def __init__(self, separators: set[int], lower: bool, seed: int = 1):
        self.is_word = np.array([b not in separators for b in range(256)])
        # values of the bytes: one fixed random 64-bit number each, the same for both cases if folded
        ids = [b + 32 if lower and 65 <= b <= 90 else b for b in range(256)]
        self.value = mix(mix(np.array(ids, np.uint64) + np.uint64(1)) + np.uint64(seed))


_SPACES = {0x20, *range(0x09, 0x0E)}
SPACED = WordClass(_SPACES, lower=False)                # [^\x20\x09-\x0D]+ unchanged
SPACED_LOWER = WordClass(_SPACES, lower=True)           # the same, A-Z folded
ALNUM_LOWER = WordClass({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)

_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        _POWERS[name] = powers(base, max(n, SEGMENT + 4096))
    return _POWERS[name][:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (a null row is empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: WordClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (n + 1 values).
    Words never run across rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = kind.is_word[data]
    begins = word[:-1].copy()
    begins[1:] &= ~word[:-2]
    ends = word[:-1] & ~word[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]          # first byte of each row that has any
    begins[inner] = word[:-1][inner]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = word[:-1][last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: WordClass) -> np.ndarray:
    """The 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(ends, starts[a] + SEGMENT, side="right")))
        base = int(starts[a])
        piece = kind.value[data[base:int(ends[z - 1])]]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _powers("up", _P, len(piece)), out=total[1:])
        s, e = starts[a:z] - base, ends[a:z] - base
        raw = (total[e] - total[s]) * _powers("down", _P_INV, len(piece))[s]
        out[a:z] = mix(raw + (e - s).astype(np.uint64))
        a = z
    return out


def hashed_words(col: pa.Array, kind: WordClass) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column, and each row's first word (n + 1 values)."""
    data, offsets = text_bytes(col)
    starts, ends, first = word_spans(data, offsets, kind)
    return word_hashes(data, starts, ends, kind), first


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``max_bytes`` of text (one row at least), to bound working memory."""
    col = batch.column(batch.schema.get_field_index(text))
    if not len(col):
        return
    part = text_bytes(col)[1]
    a = 0
    while a < len(col):
        z = max(a + 1, int(np.searchsorted(part, part[a] + max_bytes, side="right")) - 1)
        yield batch.slice(a, z - a)
        a = z


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (``len(words) - width + 1`` values, or none)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(salt)) * powers(_P, len(words)), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(_P_INV, n) + np.uint64(salt))
