"""Substring dedup by recompression: remove every word that lies in a window of ``WINDOW`` words which
also starts anywhere else.

Recompression renames a text round by round. The first round names runs of equal words; each further round
halves the symbols by a hash bit into left and right ones and names every adjacent (left, right) pair. A
name is a hash of what it stands for, so it is the same in every document of every task, and where a symbol
begins and ends depends only on a few words around it. For each symbol those words (its extent) are kept, so
two equal windows hold the same symbols, at the same places, whenever the extents lie inside.

Jobs, on chunks of a few MB of text that are written once (compressed) to the shared folder:

1. Every window gets one *unit*: of the short runs of high-level symbols whose extents it contains, the one
   that ends first. Equal windows have equal units. The distinct unit names of a chunk are packed by hash
   bucket; one task per bucket finds the names that occur in two chunks, and answers with one bit per name.
2. Windows whose unit occurs twice (in two chunks, or at two places of one), and the few windows without a
   unit (inside long runs), are candidates. Their 96-bit hashes are exchanged in the same way.
3. Each chunk marks the windows that occur twice, and drops the words they cover.

A name is sent once per chunk, however often it occurs, so a passage that a third of all rows share costs
one entry per chunk. Buckets grow in number with the chunks. No pairs are formed. Lost executors repeat
their tasks from the written chunks.

Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged. Defined cases: null or empty text has no words; texts
of fewer than ``WINDOW`` words lose none; windows are judged on the input, so all copies of a passage go,
repeated rows included; long texts are handled whole; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm import words as W
from themelens.session import stage

WINDOW = 35
ROUNDS = 4                  # of pair naming
LONGEST = 12                # words of a pair's name at most
SPAN = 8                    # words of a unit at least
CHUNK_BYTES = 4 << 20
CHUNKS_PER_BUCKET = 4       # buckets: one per so many chunks
PARSE_WORDS = 1 << 16       # words renamed at a time (whole texts)
NAME_BYTES, WINDOW_BYTES = 6, 12

_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8862B)


# -- recompression --------------------------------------------------------------------------------------

class Symbols:
    """Symbols of some rows: names, word spans [s, e), extents [lo, hi) and rows."""

    def __init__(self, words: np.ndarray, row: np.ndarray):
        n = len(words)
        new = np.ones(n, bool)
        new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
        self.s = np.flatnonzero(new)
        self.e = np.append(self.s[1:], n)
        self.name = W.mix(words[self.s] + (self.e - self.s).astype(np.uint64) * _K1)
        self.row = row[self.s]
        self.lo, self.hi = self.s - 1, self.e + 1      # a run is seen to end by its neighbours

    def pair_round(self, k: int) -> None:
        """Name all adjacent (left, right) pairs of at most ``LONGEST`` words."""
        left = (W.mix(self.name + np.uint64(k)) >> np.uint64(63)).astype(bool)
        width = self.e - self.s
        next_ = np.append(self.row[1:] == self.row[:-1], False)     # has a right neighbour in its row
        prev = np.append(False, next_[:-1])
        pair = next_ & left & ~np.append(left[1:], True) & np.append(width[1:] + width[:-1] <= LONGEST, False)
        # an unpaired left symbol was seen not to fit its right neighbour, a right one its left neighbour;
        # at the end of a row that takes a word outside it, which no window holds
        lo_next, hi_next = np.append(self.lo[1:], 0), np.append(self.hi[1:], 0)
        lo_prev, hi_prev = np.append(0, self.lo[:-1]), np.append(0, self.hi[:-1])
        lo = np.minimum(self.lo, np.where(left, np.where(next_, lo_next, self.lo), np.where(prev, lo_prev, self.s - 1)))
        hi = np.maximum(self.hi, np.where(left, np.where(next_, hi_next, self.e + 1), np.where(prev, hi_prev, self.hi)))
        i = np.flatnonzero(pair)
        lo[i], hi[i] = np.minimum(self.lo[i], self.lo[i + 1]), np.maximum(self.hi[i], self.hi[i + 1])
        self.name[i] = W.mix(self.name[i] * _K1 + self.name[i + 1] * _K2 + np.uint64(k))
        self.e[i] = self.e[i + 1]
        keep = np.ones(len(pair), bool)
        keep[i + 1] = False
        self.name, self.s, self.e, self.row = self.name[keep], self.s[keep], self.e[keep], self.row[keep]
        self.lo, self.hi = lo[keep], hi[keep]


def window_units(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word that starts a window, the name of the window's unit (0: none) and where that unit
    begins. ``first``: row starts."""
    n, none, begins = len(words), np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
    if n < WINDOW:
        return none, begins
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sym = Symbols(words, row)
    for k in range(ROUNDS):
        sym.pair_round(k)
    m = len(sym.s)
    at = np.arange(m)
    stop = np.searchsorted(sym.e, sym.s + SPAN)         # last symbol of the unit that starts here
    ok = stop < m
    stop = np.minimum(stop, m - 1)
    ok &= (sym.row[stop] == sym.row) & (stop - at <= SPAN)
    lo, hi, name = sym.lo.copy(), sym.hi.copy(), sym.name.copy()
    for q in range(1, SPAN + 1):
        i = np.flatnonzero(ok & (stop - at >= q))
        if not len(i):
            break
        lo[i], hi[i] = np.minimum(lo[i], sym.lo[i + q]), np.maximum(hi[i], sym.hi[i + q])
        name[i] = W.mix(name[i] + sym.name[i + q] * _K1)
    ok &= (hi - lo <= WINDOW) & (lo >= first[sym.row]) & (hi <= first[sym.row + 1])
    units = np.flatnonzero(ok)
    # of the units that begin at or after a word, the one that ends first (suffix minimum)
    by = units[np.argsort(-hi[units], kind="stable")]
    best = np.full(n, -1)
    best[lo[by]] = by
    end = np.where(best >= 0, hi[best], np.iinfo(np.int64).max)
    least = np.minimum.accumulate(end[::-1])[::-1]
    where = np.minimum.accumulate(np.where(end == least, np.arange(n), n)[::-1])[::-1]
    starts = np.arange(n)
    inside = (least <= starts + WINDOW) & (where < n)
    chosen = best[where[inside]]
    none[inside] = np.maximum(name[chosen], np.uint64(1 << 16))
    begins[inside] = sym.s[chosen]
    return none, begins


def all_units(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``window_units`` of a chunk, some whole rows at a time so that the arrays stay small."""
    out, begins, a = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64), 0
    while a < len(first) - 1:
        z = max(a + 1, int(np.searchsorted(first, first[a] + PARSE_WORDS, "right")) - 1)
        p, q = int(first[a]), int(first[z])
        out[p:q], at = window_units(words[p:q], first[a:z + 1] - p)
        begins[p:q] = at + p
        a = z
    return out, begins


# -- chunks -----------------------------------------------------------------------------------------------

def _pack(kind: pa.DataType | None = None):
    """Rows of (id, text) into chunks: (chunk, ids, sizes, compressed text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            texts = [W.text_bytes(b.column(1)) for b in held]
            data = b"".join(d.tobytes() for d, _ in texts)
            sizes = np.concatenate([np.diff(o) for _, o in texts])
            packed = pa.compress(data, codec="zstd", asbytes=True)
            one = np.array([0, len(ids)], np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.ListArray.from_arrays(one, ids),
                 pa.ListArray.from_arrays(one, pa.array(sizes, pa.int64())), pa.array([packed], pa.binary())],
                ["chunk", "ids", "sizes", "packed"])

        for batch in batches:
            for piece in W.slices(batch, "text", CHUNK_BYTES // 4):
                held.append(piece)
                size += int(W.text_bytes(piece.column(1))[1][-1])
                if size >= CHUNK_BYTES:
                    yield chunk()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield chunk()

    return run


def _chunk_words(packed: bytes, sizes: list[int]):
    """Bytes, word spans, row starts and word hashes of a chunk."""
    offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    total = int(offsets[-1])
    data = np.frombuffer(pa.decompress(packed, total, codec="zstd"), np.uint8) if total else np.zeros(0, np.uint8)
    starts, ends, first = W.word_spans(data, offsets, W.SPACED)
    return data, starts, ends, first, W.word_hashes(data, starts, ends, W.SPACED)


def _buckets(names: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each name (uint64), a function of its high bits."""
    return ((names >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _by_bucket(chunk: int, rows: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """One row per bucket of packed names; ``rows`` are sorted, so buckets are consecutive."""
    cuts = np.flatnonzero(np.diff(buckets)) + 1 if len(buckets) else np.zeros(0, np.int64)
    a, z = [0, *cuts.tolist()], [*cuts.tolist(), len(buckets)]
    spans = [(p, q) for p, q in zip(a, z) if q > p]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(buckets[p]) for p, _ in spans], pa.int64()), pa.array([chunk] * len(spans), pa.int64()),
         pa.array([rows[p:q].tobytes() for p, q in spans], pa.binary())], ["bucket", "chunk", "names"])


def _names(units: np.ndarray) -> np.ndarray:
    """Sorted distinct 48-bit names of the units of a chunk, in the high bits of 64."""
    found = np.unique(units[units != 0] >> np.uint64(16))
    return found << np.uint64(16)


def _low_bytes(values: np.ndarray, shift: int, width: int) -> np.ndarray:
    return np.ascontiguousarray((values >> np.uint64(shift)).view(np.uint8).reshape(-1, 8)[:, :width])


def _send_units(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, packed in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                *_, first, words = _chunk_words(packed, sizes)
                names = _names(all_units(words, first)[0])
                yield _by_bucket(chunk, _low_bytes(names, 16, NAME_BYTES), _buckets(names, n))

    return run


def _twice(width: int):
    """In one bucket: a bit for every name of every chunk, set if another chunk sent it too."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, np.uint8).reshape(-1, width) for b in rows["names"]]
        every = np.concatenate(parts)
        wide = np.zeros((len(every), 16), np.uint8)
        wide[:, :width] = every
        low, high = wide.view(np.uint64)[:, 0], wide.view(np.uint64)[:, 1]
        order = np.lexsort((high, low)) if width > 8 else np.argsort(low, kind="stable")
        same = (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])
        hit = np.zeros(len(every), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"],
                             "bits": [np.packbits(x).tobytes() for x in np.split(hit, cuts)]})

    return run


def _exchange(sent: DataFrame, width: int) -> DataFrame:
    """``(chunk, answers)``: for each chunk the bits of its names by bucket."""
    found = sent.groupBy("bucket").applyInPandas(_twice(width), "chunk long, bucket long, bits binary")
    return found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def _answered(answers: list[dict] | None, buckets: np.ndarray) -> np.ndarray:
    """The bits of a chunk's sorted names, from the answers of their buckets."""
    out = np.zeros(len(buckets), bool)
    for a in answers or ():
        p, q = np.searchsorted(buckets, [a["bucket"], a["bucket"] + 1])
        out[p:q] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=q - p).astype(bool)
    return out


def _window_names(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """96-bit names of the windows that start at ``places``, as rows of two 64-bit numbers."""
    one, two = W.window_hashes(words, WINDOW), W.window_hashes(words, WINDOW, salt=7)
    return np.stack([one[places], two[places] & np.uint64(0xFFFFFFFF)], axis=1)


def _distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows, the index of each row among them, and how often each occurs."""
    if not len(names):
        return names, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((names[:, 1], names[:, 0]))
    sorted_ = names[order]
    new = np.ones(len(names), bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    index = np.empty(len(names), np.int64)
    index[order] = np.cumsum(new) - 1
    return sorted_[new], index, np.bincount(index)


def _send_windows(n: int):
    """Candidate windows by bucket, and (bucket -1) the candidate starts of the chunk as bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, packed, answers in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                *_, first, words = _chunk_words(packed, sizes)
                units, begins = all_units(words, first)
                window = np.arange(len(words)) + WINDOW <= np.repeat(first[1:], np.diff(first))
                names = _names(units)
                often = _answered(answers, _buckets(names, n))
                index = np.searchsorted(names, units & ~np.uint64(0xFFFF))
                index = np.minimum(index, max(0, len(names) - 1))
                has = units != 0
                if len(names):
                    often |= _at_two_places(index[has], begins[has], len(names))
                candidate = window & (~has | (often[index] if len(names) else False))
                found, _, _ = _distinct(_window_names(words, np.flatnonzero(candidate)) if candidate.any()
                                        else np.zeros((0, 2), np.uint64))
                rows = np.concatenate([found[:, :1].copy().view(np.uint8).reshape(-1, 8),
                                       found[:, 1:].copy().view(np.uint8).reshape(-1, 8)[:, :4]], axis=1)
                yield _by_bucket(chunk, rows, _buckets(found[:, 0], n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int64()), pa.array([chunk], pa.int64()),
                     pa.array([pa.compress(np.packbits(candidate).tobytes(), codec="zstd", asbytes=True)], pa.binary())],
                    ["bucket", "chunk", "names"])

    return run


def _at_two_places(index: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """Names that stand for units at two places of the chunk."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, index, begins)
    np.maximum.at(high, index, begins)
    return low < high


def _keep(n: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                sizes, packed, bits, answers = (one.column(i)[0].as_py() for i in (2, 3, 4, 5))
                data, starts, ends, first, words = _chunk_words(packed, sizes)
                gone = np.zeros(len(words) + 1, np.int64)
                raw = pa.decompress(bits, (len(words) + 7) // 8, codec="zstd", asbytes=True) if len(words) else b""
                places = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), count=len(words)))
                if len(places):
                    found, index, times = _distinct(_window_names(words, places))
                    twice = _answered(answers, _buckets(found[:, 0], n)) | (times > 1)
                    at = places[twice[index]]
                    gone[at] += 1
                    gone[at + WINDOW] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                yield pa.RecordBatch.from_arrays(
                    [one.column(1)[0].values, *_texts(data, starts, ends, first, stay)],
                    ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _texts(data, starts, ends, first, stay) -> list[pa.Array]:
    """Per row: words, removed words, and the kept words joined by one space."""
    kept = np.flatnonzero(stay)
    per_row = np.searchsorted(kept, first)              # kept words before each row
    n_kept = np.diff(per_row)
    begin, size = starts[kept], ends[kept] - starts[kept]
    wide = size + 1                                     # each kept word and a space after it
    at = np.concatenate([[0], np.cumsum(wide)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    index = np.arange(int(at[-1])) - np.repeat(at[:-1] - begin, wide)
    body = np.ones(int(at[-1]), bool)
    body[at[1:] - 1] = False
    out[body] = data[index[body]]
    last = np.zeros(int(at[-1]), bool)                  # the space after a row's last word goes
    last[at[per_row[1:]][n_kept > 0] - 1] = True
    out = out[~last]
    offsets = at[per_row] - np.concatenate([[0], np.cumsum(n_kept > 0)])
    texts = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    n_words = np.diff(first)
    return [pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), texts.cast(pa.string())]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)``, one row per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    chunks = stage(rows.mapInArrow(_pack(), f"chunk long, ids array<{kind}>, sizes array<long>, packed binary"), "chunks")
    n = -(-chunks.count() // CHUNKS_PER_BUCKET) or 1
    sent = "bucket long, chunk long, names binary"
    texts = chunks.select("chunk", "sizes", "packed")
    units = _exchange(texts.mapInArrow(_send_units(n), sent), NAME_BYTES)
    asked = texts.join(units, "chunk", "left").select("chunk", "sizes", "packed", "answers")
    windows = stage(asked.mapInArrow(_send_windows(n), sent), "windows")
    again = _exchange(windows.where("bucket >= 0"), WINDOW_BYTES)
    places = windows.where("bucket = -1").select("chunk", F.col("names").alias("bits"))
    marked = chunks.join(places, "chunk").join(again, "chunk", "left").select(
        "chunk", "ids", "sizes", "packed", "bits", "answers")
    return marked.mapInArrow(_keep(n, kind), f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """Word counts and the digest of the kept words, one row per document."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
