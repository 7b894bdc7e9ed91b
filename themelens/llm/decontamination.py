"""Benchmark decontamination with suffix arrays of the training documents.

Documents are read in shards of a few MB. For each shard a suffix array over its words is built (prefix
doubling; a suffix ends with its document), and every test suffix is found in it by binary search, word by
word, for all test suffixes at once. A range of the suffix array is all places of a match. From each place the
document is followed in the suffix array of the test block, over all test suffixes that begin with the match,
until none is left: the longest verbatim match.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after folding A-Z. A test window is ``WINDOW``
consecutive words of a benchmark item, or the whole item if it is shorter.

There is no shuffle: the work grows with the documents, one shard at a time. The benchmark is measured first
and dealt out in blocks of about ``BLOCK_BYTES`` of text; each block is broadcast as flat arrays of at most 29 bytes
a word and the item ids (``BLOCK_BYTES`` of five-letter words: 80 MB) and the documents stream through one pass
per block. A lost executor only repeats its tasks.

Defined cases: null or wordless text has no words and no hits; a null or wordless item has no window; items
with a null id count for hits but are not listed; equal ids are one item; texts longer than a shard are cut
into shards that overlap by a window. Repeated rows each get their row. Extra columns are kept by
``drop_contaminated`` and ignored by ``contamination``. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm import words as W

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 16 << 20


# -- suffix arrays -------------------------------------------------------------------------------------

def suffix_array(words: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` words. ``ends[i]`` is where suffix i ends."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.ones(n, bool)
    first[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    known = 1
    while known < depth:
        # only suffixes that share their rank with another are still open
        tied = ~first
        tied[:-1] |= ~first[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        after = at + known
        second = np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        first[slots] = new
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        known *= 2
    return order


class TestBlock:
    """The suffix array of a block of items, and its ranges that begin with the same window.

    ``order`` holds the places where a window starts, sorted by the suffix that starts there. Window w is
    ``length[w]`` words long and starts at ``order[cut[w]:cut[w + 1]]``; ``item`` says whose place it is.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.string())
        words, first = W.hashed_words(texts, W.ALNUM_LOWER)
        self.words = np.where(words == 0, np.uint64(1), words)
        size = np.diff(first)
        self.ids = [None if k is None else str(k) for k, _ in items]
        self.item = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.ends = np.repeat(first[1:], size).astype(np.int32)         # where the item of each word ends
        width = np.repeat(np.minimum(window, size), size).astype(np.int16)
        order = suffix_array(self.words, self.ends, int(size.max(initial=0))).astype(np.int32)
        self.order = order[order + width[order] <= self.ends[order]]
        new = np.ones(len(self.order), bool)
        wide = width[self.order]
        if len(self.order):
            same = wide[1:] == wide[:-1]
            for d in range(window):
                word = _value(self.words, self.ends, self.order, d)
                same &= (word[1:] == word[:-1]) | (wide[1:] <= d)
            new[1:] = ~same
        self.cut = np.append(np.flatnonzero(new), len(self.order)).astype(np.int32)
        self.length = wide[self.cut[:-1]]
        self.start = self.order[self.cut[:-1]]
        self.depth = int(self.length.max(initial=0))

    def items_of(self, windows: np.ndarray) -> set[str]:
        """The ids of all items that hold one of these windows."""
        at = [self.order[self.cut[w]:self.cut[w + 1]] for w in windows.tolist()]
        return {self.ids[k] for k in np.unique(self.item[np.concatenate(at)]).tolist()} - {None}


def _value(words: np.ndarray, ends: np.ndarray, at: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """The word ``depth`` places into each suffix; 0, below every word, past its end."""
    place = at + depth
    return np.where(place < ends[at], words[np.minimum(place, len(words) - 1)], np.uint64(0))


def _narrow(words, ends, order, lo, hi, depth, target):
    """Sub-ranges of ``order[lo:hi]`` whose word at ``depth`` equals ``target`` (all ranges at once)."""
    out = []
    for right in (False, True):
        a, z = lo.copy(), hi.copy()
        while (open_ := a < z).any():
            mid = (a + z) >> 1
            value = _value(words, ends, order[np.minimum(mid, len(order) - 1)], depth)
            below = open_ & ((value <= target) if right else (value < target))
            a = np.where(below, mid + 1, a)
            z = np.where(open_ & ~below, mid, z)
        out.append(a)
    return out


def occurrences(words: np.ndarray, ends: np.ndarray, test: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Places of all test windows in a shard: ``(window, place)`` pairs."""
    none = np.zeros(0, np.int64)
    if not len(words) or not len(test.start):
        return none, none
    order = suffix_array(words, ends, test.depth)
    heads = words[order]
    live = np.arange(len(test.start))
    target = test.words[test.start]
    lo, hi = np.searchsorted(heads, target, "left"), np.searchsorted(heads, target, "right")
    found_w, found_p, depth = [], [], 1
    while True:
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
        done = test.length[live] == depth
        for w, a, z in zip(live[done].tolist(), lo[done].tolist(), hi[done].tolist()):
            found_w.append(np.full(z - a, w))
            found_p.append(order[a:z])
        live, lo, hi = live[~done], lo[~done], hi[~done]
        if not len(live):
            break
        lo, hi = _narrow(words, ends, order, lo, hi, depth, test.words[test.start[live] + depth])
        depth += 1
    return (np.concatenate(found_w), np.concatenate(found_p)) if found_w else (none, none)


def longest_from(words: np.ndarray, ends: np.ndarray, test: TestBlock, which: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Length of each match when the document is followed through all test suffixes that begin with it."""
    length = test.length[which].astype(np.int64)
    live, lo, hi = np.arange(len(which)), test.cut[which].astype(np.int64), test.cut[which + 1].astype(np.int64)
    while len(live):
        on = place[live] + length[live] < ends[place[live]]
        live, lo, hi = live[on], lo[on], hi[on]
        if not len(live):
            break
        lo, hi = _narrow(test.words, test.ends, test.order, lo, hi, length[live], words[place[live] + length[live]])
        on = lo < hi
        live, lo, hi = live[on], lo[on], hi[on]
        length[live] += 1
    return length


# -- documents -------------------------------------------------------------------------------------------

def matches(col: pa.Array, test: TestBlock, shard_words: int = SHARD_WORDS) -> list[tuple[int, np.ndarray, set[str], int]]:
    """For each text: number of words, covered intervals (flat, merged), item ids, longest match."""
    words, first = W.hashed_words(col, W.ALNUM_LOWER)
    words = np.where(words == 0, np.uint64(1), words)
    rows = len(first) - 1
    ends = np.repeat(first[1:], np.diff(first))
    w_all, p_all, l_all = [], [], []
    for a in range(0, len(words), shard_words):
        z = min(len(words), a + shard_words + max(0, test.depth - 1))
        part, part_ends = words[a:z], np.minimum(ends[a:z], z) - a
        w, p = occurrences(part, part_ends, test)
        w_all.append(w)
        p_all.append(p + a)
    w = np.concatenate(w_all) if w_all else np.zeros(0, np.int64)
    p = np.concatenate(p_all) if p_all else w
    by = np.argsort(p, kind="stable")
    w, p = w[by], p[by]
    l_all = longest_from(words, ends, test, w, p)
    row = np.searchsorted(first, p, "right") - 1
    cuts = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for r in range(rows):
        a, z, n = cuts[r], cuts[r + 1], int(first[r + 1] - first[r])
        if a == z:
            out.append((n, np.zeros(0, np.int64), set(), 0))
            continue
        begin = p[a:z] - first[r]
        reach = np.maximum.accumulate(begin + test.length[w[a:z]])
        new = np.ones(z - a, bool)
        new[1:] = begin[1:] > reach[:-1]
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [z - a - 1]])
        spans = np.stack([begin[new], reach[last]], axis=1).ravel()
        out.append((n, spans, test.items_of(np.unique(w[a:z])), int(l_all[a:z].max())))
    return out


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[TestBlock]:
    """The benchmark in blocks of at most about ``block_bytes`` of text."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        yield TestBlock([tuple(r) for r in part.collect()])     # bounded by block_bytes


_FOUND = "_words long, _spans array<long>, _items array<string>, _longest long"


def _merge(a: list[int], b: np.ndarray) -> list[int]:
    """The union of two flat lists of intervals."""
    if not a or not len(b):
        return list(a or b)
    pairs = sorted([*zip(a[::2], a[1::2]), *zip(b[::2].tolist(), b[1::2].tolist())])
    out = [*pairs[0]]
    for s, e in pairs[1:]:
        if s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _scan(shared, text_col: str, first_pass: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col):
                found = matches(part.column(part.schema.get_field_index(text_col)), shared.value)
                if first_pass:
                    keep = part.columns
                    cols = [[n for n, *_ in found], [s.tolist() for _, s, *_ in found],
                            [sorted(i) for _, _, i, _ in found], [m for *_, m in found]]
                else:
                    keep = part.columns[:-4]
                    was = [c.to_pylist() for c in part.columns[-4:]]
                    cols = [was[0], [_merge(o, s) for o, (_, s, *_) in zip(was[1], found)],
                            [sorted({*o, *i}) for o, (_, _, i, _) in zip(was[2], found)],
                            [max(o, m) for o, (*_, m) in zip(was[3], found)]]
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()]
                names = part.schema.names if first_pass else part.schema.names[:-4]
                yield pa.RecordBatch.from_arrays([*keep, *[pa.array(c, t) for c, t in zip(cols, types)]],
                                                 [*names, "_words", "_spans", "_items", "_longest"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, spans`` (flat list of covered word intervals), ``items`` (sorted ids)
    and ``longest_match`` in words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    for k, block in enumerate(test_blocks(benchmark, item_col, item_text_col)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        rows = rows.mapInArrow(_scan(shared, "text", k == 0), f"doc_id {kind}, text string, {_FOUND}")
    return rows.select("doc_id", F.col("_words").alias("n_words"), F.col("_spans").alias("spans"),
                       F.col("_items").alias("items"), F.col("_longest").alias("longest_match"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The counts and the digest of the item ids, one row per document; ``longest_match`` in words (0 without a hit)
    and ``spans``, the covered word intervals ``start:end`` (from 0, end exclusive, comma-joined)."""
    found = contamination(docs, benchmark)
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
                      lambda acc, x: F.struct((acc["n"] + acc["sign"] * x).alias("n"), (-acc["sign"]).alias("sign")))
    return found.select(
        "doc_id", "n_words", hit["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "longest_match",
        F.regexp_replace(F.array_join("spans", ","), r"([0-9]+),([0-9]+)", "$1:$2").alias("spans"))


def _clean(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col):
                found = matches(part.column(part.schema.get_field_index(text_col)), shared.value)
                yield part.filter(pa.array([len(s) == 0 for _, s, *_ in found], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a test window; all columns kept."""
    for block in test_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(_clean(shared, text_col), docs.schema)
    return docs
