"""Phrase collocations by best-first branch and bound.

A candidate is a phrase of 2 to ``LONGEST`` words that occurs ``LEAST`` times or more. With n words in a
language, a occurrences of the phrase and l, r of the two parts of a cut, the cut scores floor(1000 a n / (l r));
a phrase has the score of its worst cut. As a <= r, no phrase that begins with a word of count f scores above
floor(1000 n / f), and the same holds for its last word. So the counts of words, the shortest prefixes, bound
all that grows from them, and rare words come first.

1. Words are counted once. Texts are kept as word codes with a dictionary per slice (``coded``).
2. Waves. A wave takes the words whose counts lie in the next range [lo, hi) and, in the languages that are not
   settled, counts all phrases that begin or end with one of them and with no rarer word: first pairs, then
   pairs grown to three words, and so on up to ``LONGEST``. A phrase is grown only if its parts that the same
   wave counted are frequent. Phrases inside a candidate begin or end as it does, and so do the
   phrases that hold it with one word more; so all counts that its score and its survival need are known.
3. After a wave what is left has a first or last word of count hi or more and scores at most floor(1000 n / hi).
   A language is settled when ``TOP`` surviving phrases score more than that; ties would score the same and
   so are settled too. Waves end when all languages are settled or no words are left.
4. A candidate survives unless a phrase with one word more occurs as often (if a longer one does, so does that).

Exact: counts are sums over all slices, products are decimals of 38 digits. Filters sent to all tasks (words of
a wave, frequent phrases of the last length) are checked against ``SENT``; beyond it words are sent in parts by
hash, and phrases are grown without that filter, with the same results. Words are compared by 64-bit hashes.

Defined cases: null text is empty, null language is ``und``. Ids, repeated rows and extra columns are not looked
at: every row counts. Pieces without words count nothing. A language with fewer survivors returns all of them.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from themelens.llm import words as W
from themelens.session import stage

LEAST, LONGEST, TOP = 100, 5, 2000
WAVE = 8                    # a wave's largest count is so many times that of the wave before
SENT = 2_000_000            # words or phrases (8 to 12 bytes each) sent to every task
SLICE_BYTES = 8 << 20

_BREAKS = {*b".,;:!?", *range(0x0A, 0x0E)}
PIECE_WORDS = W.WordClass({0x20, 0x09, *_BREAKS}, lower=True)
_IS_BREAK = np.isin(np.arange(256), list(_BREAKS))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


# -- coded texts ------------------------------------------------------------------------------------------

def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The folded strings at the given bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], sizes)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_FOLD[data[index]]))


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) into rows of one language: its distinct words (hashes, strings, counts) and the words as
    numbers of these, a break being the number after the last."""
    for batch in batches:
        for piece in W.slices(batch, "text", SLICE_BYTES):
            data, offsets = W.text_bytes(piece.column(1))
            starts, ends, first = W.word_spans(data, offsets, PIECE_WORDS)
            if not len(starts):
                continue
            hashes = W.word_hashes(data, starts, ends, PIECE_WORDS)
            broken = np.concatenate([[0], np.cumsum(_IS_BREAK[data])])[starts]
            new = np.ones(len(starts), bool)
            new[1:] = broken[1:] != broken[:-1]
            new[first[:-1][np.diff(first) > 0]] = True
            langs = piece.column(0).dictionary_encode()
            of = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(first))
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(of == k)
                if not len(mine):
                    continue
                distinct, at, code, times = np.unique(hashes[mine], return_index=True, return_inverse=True, return_counts=True)
                begins = np.flatnonzero(new[mine])
                codes = np.insert(code, begins, len(distinct)).astype(np.int32)
                one, word = np.array([0, len(distinct)], np.int32), mine[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.ListArray.from_arrays(one, pa.array(distinct.view(np.int64))),
                     pa.ListArray.from_arrays(one, _strings(data, starts[word], ends[word] - starts[word])),
                     pa.ListArray.from_arrays(one, pa.array(times)),
                     pa.array([pa.compress(codes.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
                     pa.array([len(codes)], pa.int64())], ["lang", "words", "names", "times", "codes", "size"])


# -- phrases of a wave ------------------------------------------------------------------------------------

class Filters:
    """What a task knows in a pass: words by language with their counts, and frequent phrases one word shorter."""

    def __init__(self, words: dict[str, tuple[np.ndarray, np.ndarray]], lo: int, hi: int, every: bool, shorter: dict | None):
        self.words, self.lo, self.hi, self.every, self.shorter = words, lo, hi, every, shorter


def _phrase_hash(words: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row of words (for filters only: a collision costs a count, not a result)."""
    out = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        out = W.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[:, k] + np.uint64(k))
    return out


def _member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def count_phrases(words: np.ndarray, codes: np.ndarray, lang: str, k: int, f: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``k`` words of a slice that the wave counts (rows of word hashes), and their counts."""
    none = np.zeros((0, k), np.uint64), np.zeros(0, np.int64)
    if lang not in f.words or len(codes) < k:
        return none
    known, counts = f.words[lang]
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    count = np.where(known[at] == words, counts[at], -1)
    # of a word: 0 is no part of a phrase, 1 is, 2 belongs to the wave, 3 to an earlier one
    part = np.where(count < 0, 0 if f.every else 1, np.where(count < f.lo, 3, np.where(count < f.hi, 2, 1)))
    part = np.append(part, 0).astype(np.int8)[codes]
    n = len(codes) - k + 1
    a, z = part[:n], part[k - 1:]
    ok = ((a == 2) | (z == 2)) & (a != 3) & (z != 3)
    for j in range(k):
        ok &= (part[j:j + n] > 0) & (codes[j:j + n] < len(words))
    i = np.flatnonzero(ok)
    if k > 2 and f.shorter is not None:
        frequent, table = f.shorter.get(lang, np.zeros(0, np.uint64)), words
        head = np.stack([table[codes[i + j]] for j in range(k)], axis=1) if len(i) else none[0]
        # a part that ends in a word of an earlier wave was counted there
        keep = (a[i] != 2) | (part[i + k - 2] == 3) | _member(frequent, _phrase_hash(head[:, :-1]))
        keep &= (z[i] != 2) | (part[i + 1] == 3) | _member(frequent, _phrase_hash(head[:, 1:]))
        i = i[keep]
    if not len(i):
        return none
    rank = codes[i].astype(np.int64)
    for j in range(1, k):
        _, rank = np.unique(rank * (len(words) + 1) + codes[i + j], return_inverse=True)
    _, at, times = np.unique(rank, return_index=True, return_counts=True)
    return np.stack([words[codes[i[at] + j]] for j in range(k)], axis=1), times


def _count(k: int, shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                lang, size = batch.column(0)[r].as_py(), batch.column(3)[r].as_py()
                words = batch.column(1)[r].values.to_numpy().view(np.uint64)
                codes = np.frombuffer(pa.decompress(batch.column(2)[r].as_buffer(), size * 4, codec="zstd"), np.int32)
                found, times = count_phrases(words, codes, lang, k, shared.value)
                if len(found):
                    offsets = np.arange(len(found) + 1, dtype=np.int32) * (8 * k)
                    keys = pa.BinaryArray.from_buffers(pa.binary(), len(found), [
                        None, pa.py_buffer(offsets), pa.py_buffer(found.astype(">u8").tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), keys, pa.array(times)], ["lang", "p", "c"])

    return run


def _by_lang(rows: DataFrame) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each language, brought to the driver: only for tables of checked size."""
    found = rows.toArrow()
    for lang in found["lang"].unique():
        yield lang.as_py(), found.filter(pc.equal(found["lang"], lang))


def _sent_words(words: DataFrame, hi: int, every: bool) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """At most ``SENT`` words with their counts, by language, in order of their hashes."""
    out = {}
    for lang, mine in _by_lang((words if every else words.where(F.col("f") < hi)).select("lang", "w", "f")):
        w, f = mine["w"].to_numpy().view(np.uint64), mine["f"].to_numpy()
        order = np.argsort(w)
        out[lang] = (w[order], f[order])
    return out


def _sent_phrases(phrases: DataFrame) -> dict[str, np.ndarray] | None:
    """Hashes of the frequent phrases by language, or None if there are more than ``SENT``."""
    if phrases.count() > SENT:
        return None
    out = {}
    for lang, mine in _by_lang(phrases.select("lang", "p")):
        words = np.frombuffer(b"".join(mine["p"].to_pylist()), ">u8").astype(np.uint64).reshape(len(mine), -1)
        out[lang] = np.sort(_phrase_hash(words))
    return out


def count_wave(spark: SparkSession, coded: DataFrame, words: DataFrame, lo: int, hi: int, least: int = LEAST) -> list[DataFrame]:
    """``(lang, p, f)`` of the frequent phrases of the wave, one table for each length; ``p`` is eight bytes a
    word. ``words`` are the frequent words of the languages that are not settled."""
    texts = coded.select("lang", "words", "codes", "size")
    n = words.count()
    every = n <= SENT
    parts = 1 if every else -(-words.where(F.col("f").between(lo, hi - 1)).count() // SENT)
    tables = []
    for part in range(parts):
        mine = words if every else words.where(
            (F.col("f") >= lo) & (F.pmod(F.xxhash64("w"), F.lit(parts)) == part))
        sent, shorter = _sent_words(mine, hi, every), None
        if not sent:
            continue
        for k in range(2, LONGEST + 1):
            shared = spark.sparkContext.broadcast(Filters(sent, lo, hi, every, shorter))
            partial = texts.mapInArrow(_count(k, shared), "lang string, p binary, c long")
            found = stage(partial.groupBy("lang", "p").agg(F.sum("c").alias("f")).where(F.col("f") >= least), f"phrases-{k}")
            tables.append(found)
            shorter = _sent_phrases(found)
            shared.destroy()
            if shorter == {}:       # nothing to grow
                break
    return tables


# -- scores -----------------------------------------------------------------------------------------------

def _key(word: Column | str) -> Column:
    return F.unhex(F.lpad(F.hex(word), 16, "0"))


def survivors(counts: DataFrame, words: DataFrame, totals: DataFrame, hi: int | None) -> DataFrame:
    """``(lang, p, a, l, r, n, score)`` of the surviving candidates whose first and last word have counts below
    ``hi``. ``counts`` holds all phrases of two words and more that were counted."""
    size = (F.octet_length("p") / 8).cast("int")
    single = words.select("lang", _key("w").alias("p"), "f")
    longer = counts.where(size > 2)
    tops = longer.select("lang", F.expr("substring(p, 1, octet_length(p) - 8)").alias("p"), "f").unionByName(
        longer.select("lang", F.expr("substring(p, 9)").alias("p"), "f")).groupBy("lang", "p").agg(F.max("f").alias("top"))
    open_ = counts.join(tops, ["lang", "p"], "left").where(F.col("top").isNull() | (F.col("top") < F.col("f"))).drop("top")
    if hi is not None:
        ends = single.where(F.col("f") < hi).select("lang", "p")
        for end in ("substring(p, 1, 8)", "substring(p, octet_length(p) - 7)"):
            open_ = open_.withColumn("_end", F.expr(end)).join(ends.select(F.col("lang"), F.col("p").alias("_end")), ["lang", "_end"], "left_semi").drop("_end")
    every = counts.unionByName(single)
    cuts = open_.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("pl", F.expr("substring(p, 1, 8 * cut)")).withColumn("pr", F.expr("substring(p, 8 * cut + 1)"))
    cuts = (cuts.join(every.select("lang", F.col("p").alias("pl"), F.col("f").alias("l")), ["lang", "pl"])
            .join(every.select("lang", F.col("p").alias("pr"), F.col("f").alias("r")), ["lang", "pr"])
            .join(totals, "lang"))
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("f", "n", "l", "r")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide["f"] * wide["n"]), wide["l"] * wide["r"])
    worst = cuts.withColumn("score", score).groupBy("lang", "p", F.col("f").alias("a"), "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    return worst.select("lang", "p", "a", "w.l", "w.r", "n", "w.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", wave: int = WAVE, top: int = TOP,
                 least: int = LEAST) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` surviving phrases."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = stage(texts.mapInArrow(_code, "lang string, words array<long>, names array<string>, times array<long>, codes binary, size long"), "coded")
    each = coded.select("lang", F.explode(F.arrays_zip("words", "names", "times")).alias("x"))
    counted = stage(each.groupBy("lang", F.col("x.words").alias("w"), F.col("x.names").alias("name")).agg(
        F.sum("x.times").alias("f")), "words")
    totals = stage(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = stage(counted.where(F.col("f") >= least), "frequent")
    most = words.agg(F.max("f")).first()[0]
    lo, open_langs, counts, found = least, totals.select("lang"), None, None
    while most is not None and lo <= most:
        hi = lo * wave
        for table in count_wave(spark, coded, words.join(open_langs, "lang", "left_semi"), lo, hi, least):
            counts = table if counts is None else counts.unionByName(table)
        if counts is not None:
            counts = stage(counts.dropDuplicates(["lang", "p"]), "counts")      # parts of a wave may count the same phrase
            found = stage(survivors(counts, words, totals, hi if hi <= most else None), "survivors")
            bound = F.floor(F.col("n") * 1000 / F.lit(hi))
            done = found.where(F.col("score") > bound).groupBy("lang").agg(F.count("*").alias("m")).where(F.col("m") >= top)
            open_langs = stage(totals.select("lang").join(done, "lang", "left_anti"), "open")
            if open_langs.isEmpty():
                break
        lo = hi
    if found is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    size = (F.octet_length("p") / 8).cast("int")
    at = found.select("lang", "p", "score", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    at = at.withColumn("w", F.conv(F.hex(F.expr("substring(p, 8 * i - 7, 8)")), 16, -10).cast("long"))
    named = at.join(words.select("lang", "w", "name"), ["lang", "w"]).groupBy("lang", "p").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), " ").alias("phrase"))
    order = Win.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = found.join(named, ["lang", "p"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
