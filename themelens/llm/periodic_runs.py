"""Runs: maximal periodic stretches of words, by maximal pairs of a suffix tree.

1. The words of each document get dense ranks, which prefix doubling refines to a suffix order; the ranks of
   every level are kept, so that the longest common prefix (LCP) of two suffixes is found by descending the
   levels. Only suffixes whose first four words occur twice in their document are ordered further.
2. The LCP-interval tree is walked bottom up with a stack. A node holds the places of its suffixes as sorted
   lists, one per left word. When a child joins a node of LCP value l, two places i < j of different sides and
   different left words form a maximal pair: the l words at both are equal, and neither neighbour is. The
   smaller side is looked up in the lists of the larger one, within the distance that the lengths allow.
3. A maximal pair of distance p and length l is a stretch of l + p words of period p that no neighbour extends.
   With l >= 3 p and l + p >= 6 it is a run, its smallest period being the smallest distance found for the same
   stretch. No stretch is extended or verified afterwards. Nodes with l < 5 cannot give one and are not built.

A document is the unit of work; there is no shuffle. Documents are taken in slices of ``SLICE_BYTES`` of text, a
longer document is a slice of its own, whose memory grows with that document (about 150 bytes a word). Words
are compared by 64-bit hashes.

Defined cases: null or empty text, or text of separators only, has no words and no runs. Null ids are kept.
Repeated rows get equal answers; extra columns are ignored; an empty table gives an empty result. Of runs of
equal length the one that starts first, then the one of smaller period, counts as the longest.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm import words as W
from themelens.llm.substrings import _texts as kept_texts

SLICE_BYTES = 4 << 20
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
LEAST_LCP = 5               # of a pair: l >= 3 p and l + p >= 6


class SuffixOrder:
    """Suffixes of the rows of a slice that share their first four words with another of the same row, in
    order, with the LCP of neighbours."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n = len(words)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = np.repeat(first[1:], np.diff(first))
        distinct, word = np.unique(words, return_inverse=True)
        rank, todo = self._refine(np.zeros(n, np.int64), np.arange(n), row * max(1, len(distinct)) + word)
        self.levels, width, self.places = [rank], 1, None
        while True:
            if width >= 4 and self.places is None:
                self.places = todo
            if not len(todo):
                break
            # the rank of what follows; a suffix that ends before it comes first, and there is one such at most
            after = todo + width
            inside = after < self.end[todo]
            follow = np.where(inside, rank[np.minimum(after, n - 1)], -1)
            rank, todo = self._refine(rank, todo, follow)
            self.levels.append(rank)
            width *= 2
        self.places = self.places[np.argsort(rank[self.places])] if self.places is not None else todo
        self.lcp = self._lcp(self.places[:-1], self.places[1:])

    @staticmethod
    def _refine(rank: np.ndarray, todo: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (the number of smaller suffixes) split by ``by`` inside equal ranks, and the places whose
        rank is still shared."""
        if not len(todo):
            return rank, todo
        both = rank[todo] * (int(by.max()) + 2) + by        # below words * rows * words of a slice
        order = np.argsort(both)
        at, key = todo[order], by[order]
        old = rank[at]
        group = np.ones(len(at), bool)
        group[1:] = old[1:] != old[:-1]
        new = group.copy()
        new[1:] |= key[1:] != key[:-1]
        i = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(group, i, 0))
        sub = np.maximum.accumulate(np.where(new, i, 0))
        out = rank.copy()
        out[at] = old + (sub - begin)
        single = new & np.append(new[1:], True)
        return out, at[~single]

    def _lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            p, q = a + out, b + out
            ok = (p < self.end[a]) & (q < self.end[b])
            p, q = np.where(ok, p, 0), np.where(ok, q, 0)
            out += np.where(ok & (rank[p] == rank[q]), 1 << k, 0)
        return out


def _joined(a, b, lcp: int, left: list[int], found: list) -> tuple[list[int], dict[int, list[int]]]:
    """The node of two children; maximal pairs across them go to ``found`` as (start, length, period)."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    places, classes = a
    reach = lcp // (LEAST_EXPONENT - 1)
    for word, smaller in b[1].items():
        if len(classes) > 1 or word not in classes:
            for j in smaller:
                lo, hi = bisect_left(places, j - reach), bisect_right(places, j + reach)
                if hi - lo <= len(classes):
                    near = [i for i in places[lo:hi] if left[i] != word]
                else:
                    near = [i for other, held in classes.items() if other != word
                            for i in held[bisect_left(held, j - reach):bisect_right(held, j + reach)]]
                for i in near:
                    period = abs(i - j)
                    if lcp + period >= LEAST_LENGTH:
                        found.append((min(i, j), lcp + period, period))
    for j in b[0]:
        if j > places[-1]:
            places.append(j)
        else:
            insort(places, j)
    for word, smaller in b[1].items():
        held = classes.get(word)
        if held is None:
            classes[word] = smaller
        else:
            for j in smaller:
                if j > held[-1]:
                    held.append(j)
                else:
                    insort(held, j)
    return places, classes


def maximal_pairs(places: list[int], lcps: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """Maximal pairs of sorted suffixes whose distance makes them runs. ``left`` is the left word of a place."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, tuple]] = []
    node = None
    for i, p in enumerate(places):
        leaf = ([p], {left[p]: [p]})
        lcp = lcps[i - 1] if i else 0
        if node is not None:
            while stack and stack[-1][0] > lcp:
                value, other = stack.pop()
                node = _joined(other, node, value, left, found)
            if lcp < LEAST_LCP:         # what follows shares too little with all before it
                stack.clear()
            elif stack and stack[-1][0] == lcp:
                stack[-1] = (lcp, _joined(stack[-1][1], node, lcp, left, found))
            else:
                stack.append((lcp, node))
        node = leaf
    while stack:
        value, other = stack.pop()
        node = _joined(other, node, value, left, found)
    return found


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of all rows of a slice, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < LEAST_LENGTH:
        return none
    order = SuffixOrder(words, first)
    share = order.lcp >= LEAST_LCP
    near = np.append(share, False) | np.append(False, share)
    at = np.flatnonzero(near)
    if not len(at):
        return none
    # the LCP between suffixes that are no neighbours any more is below LEAST_LCP, as all left out are
    lcps = np.where(np.diff(at) == 1, order.lcp[at[:-1]], 0)
    _, word = np.unique(words, return_inverse=True)
    left = np.append(-1, word[:-1])
    left[first[:-1][np.diff(first) > 0]] = -1           # one place of a row has no left word
    found = maximal_pairs(order.places[at].tolist(), lcps.tolist(), left.tolist())
    if not found:
        return none
    runs = np.array(found, np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)      # of one stretch the smallest distance
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated_tails(ids: list, first: np.ndarray) -> np.ndarray:
    """The word that stands at each place once the tails of a tenth of the documents are made periodic, as the
    contract of the query says: h = crc32 of the decimal id, g = h // 10; if h % 10 = 0, every word i >= a
    becomes word a + (i - a) % p with a = g % n and p = 1 + (n - a) // (3 + g % 8)."""
    source = np.arange(int(first[-1]))
    for r, doc in enumerate(ids):
        n = int(first[r + 1] - first[r])
        if doc is None or not n:
            continue
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            begin = int(first[r]) + a
            source[begin:int(first[r + 1])] = begin + np.arange(n - a) % p
    return source


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[list, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Per document ``(doc_id, n_words, runs, collapsed)``: all runs as ``array<struct<start, length, period>>``
    by start, then period, and the text with every run cut to its first period, words joined by one space.
    ``rewrite`` may give, from ids and row starts, the word to stand at each place."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                ids = piece.column(0)
                data, offsets = W.text_bytes(piece.column(1))
                starts, ends, first = W.word_spans(data, offsets, W.SPACED)
                words = W.word_hashes(data, starts, ends, W.SPACED)
                if rewrite is not None:
                    source = rewrite(ids.to_pylist(), first)
                    words, starts, ends = words[source], starts[source], ends[source]
                runs = find_runs(words, first)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                n_words, _, texts = kept_texts(data, starts, ends, first, np.cumsum(gone[:-1]) == 0)
                row = np.searchsorted(first, runs[:, 0], side="right") - 1
                structs = pa.StructArray.from_arrays(
                    [pa.array(runs[:, 0] - first[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
                cuts = np.searchsorted(runs[:, 0], first)
                yield pa.RecordBatch.from_arrays(
                    [ids, n_words, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs), texts],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def runs_digest(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs, rewrite=repeated_tails)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"),
                       lambda acc, x: F.when(acc.isNull() | (x["length"] > acc["length"]), x).otherwise(acc))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
