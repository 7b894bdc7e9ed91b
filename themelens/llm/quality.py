"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes.

1. Evidence. Two logistic models score every document: ``quality`` (is it poor?) and ``toxic``. Their
   features are style shares (symbols, capitals, repeated words ...) and the presence of words that the
   labels single out (seen in ``LEAST_SEEN`` labelled texts or more). They are fitted on a bounded sample of
   labelled documents (``FIT_ROWS``, the ids with the smallest hashes; equal texts once, with the mean of
   their labels); everything else covers all rows.
2. Sites. The scores of all documents are summed by path (host and language) and host. The variance between
   hosts and between the paths of a host is estimated with the part that sampling alone would give taken off
   (nested analysis of variance). The global rate is the prior of the hosts, a host's posterior the prior of
   its paths; each level weighs a site's own mean by its variance against the sampling variance of a mean of
   that many documents, and never by more than n / (n + ``LEAST_STRENGTH``). Sites that differ by chance only
   so get the global rate.
3. A document's posterior adds the log odds of its path to its own evidence, less the global log odds; its own
   score is left out of all three rates. The shift is bounded by ``MAX_SHIFT``, so a bad site alone never
   rejects a document with clear evidence.

A document is rejected if either posterior exceeds one half.

Sums are grouped with map-side combine, so a host with a third of the rows costs one row per task. The site
table is broadcast only below ``SITE_LIMIT`` rows and the library's limit of bytes. Scoring is one pass
without a shuffle, in which words are hashed once for both models; ``keep_good`` writes its result once.

Defined cases: null or empty text has the style features of an empty text and no words; null host or
language is a site of its own. Null labels are not used; repeated labels of an id count once each. Without
labelled rows (or with one class only) the evidence is the constant rate and nothing is rejected. Repeated
rows are scored alike. Extra columns are kept by ``keep_good``, those named like its helpers (``_qc_``) too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelens.llm import words as W
from themelens.session import is_small, stage

FIT_ROWS = 12_000           # labelled documents of the fit
LEXICON = 64                # words of each model
LEAST_Z = 8.0               # how far a word's rate must be from chance
LEAST_SEEN = 10             # labelled texts that hold a word of the lexicon
RIDGE = 1.0
MAX_SHIFT = 1.5             # log odds that a site can add
LEAST_STRENGTH = 20         # documents that a prior weighs at least
SITE_LIMIT = 200_000        # rows of a site table that may be broadcast
TARGETS = ("quality", "toxic")

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([b in b"#$%&*@^~=+<>{}[]\\" for b in range(256)])
_BAR = np.array([b == ord("|") for b in range(256)])
_SHOUT = np.array([b in b"!?" for b in range(256)])
STYLE = ("letters", "capitals", "digits", "marks", "bars", "shouts", "repeats", "distinct", "log_words")


def features(col: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """Style shares and word presence (sorted word hashes ``lexicon``) of each text."""
    data, offsets = W.text_bytes(col)
    starts, ends, first = W.word_spans(data, offsets, W.SPACED_LOWER)
    words = W.word_hashes(data, starts, ends, W.SPACED_LOWER)
    rows, n_words = len(offsets) - 1, np.diff(first)
    size = np.maximum(1, np.diff(offsets))
    counts = {}
    for name, table in (("letters", _LETTER), ("capitals", _UPPER), ("digits", _DIGIT), ("marks", _MARK),
                        ("bars", _BAR), ("shouts", _SHOUT)):
        total = np.concatenate([[0], np.cumsum(table[data])])
        counts[name] = np.diff(total[offsets])
    row = np.repeat(np.arange(rows), n_words)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    distinct = np.array([len(np.unique(words[a:z])) for a, z in zip(first[:-1].tolist(), first[1:].tolist())], float)
    per_word, per_byte = np.maximum(1, n_words), size
    style = [counts["letters"] / per_byte, counts["capitals"] / per_byte, counts["digits"] / per_byte,
             np.minimum(1, counts["marks"] / per_word), np.minimum(1, counts["bars"] / per_word),
             np.minimum(1, counts["shouts"] / per_word), np.bincount(row[again], minlength=rows) / per_word,
             distinct / np.sqrt(per_word), np.log1p(n_words)]
    out = np.zeros((rows, len(style) + len(lexicon)))
    out[:, :len(style)] = np.array(style).T
    if len(lexicon) and len(data):
        # words of letters only, so that "word," and "word" are one
        s, e, f = W.word_spans(data, offsets, W.ALNUM_LOWER)
        h = W.word_hashes(data, s, e, W.ALNUM_LOWER)
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        hit = np.flatnonzero(lexicon[at] == h)
        r = np.searchsorted(f, hit, "right") - 1
        out[r, len(style) + at[hit]] = 1.0
    return out


class Model:
    """A ridge logistic model on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, lexicon: np.ndarray):
        self.lexicon, self.ok = lexicon, bool(len(y)) and 0 < y.mean() < 1
        self.rate = float(y.mean()) if len(y) else 0.0
        if not self.ok:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE)
        ridge[0] = 0.0
        for _ in range(30):     # Newton steps, damped by the ridge
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + ridge * w
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6)
            step = np.linalg.solve(hess, grad)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.full(len(x), np.log(max(1e-6, self.rate) / max(1e-6, 1 - self.rate)) if self.rate < 0.5 else -1.0)
        z = (x - self.mean) / self.scale
        return np.clip(self.w[0] + z @ self.w[1:], -20, 20)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Model]:
    """Models of poor quality and toxicity from a bounded sample of labelled documents."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    sample = known.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(FIT_ROWS).select(
        F.col(id_col).alias("doc_id"), (1 - F.col("quality")).alias("quality"), "toxic")
    sample = stage(sample, "fit-labels")        # FIT_ROWS rows of three numbers
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(texts.join(F.broadcast(sample), "doc_id").groupBy("text").agg(
        F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")), "fit-texts")
    n, poor, toxic = rows.agg(F.count("*"), F.sum("quality"), F.sum("toxic")).first()
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.array_distinct(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), lambda w: w != "")
    seen = rows.select(F.explode(words).alias("word"), "quality", "toxic").groupBy("word").agg(
        F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST_SEEN)
    out = {}
    for target, total in zip(TARGETS, (poor or 0, toxic or 0)):
        rate = total / n if n else 0.0
        z = (F.col(target) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1e-9)
        top = seen.select("word", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(LEXICON)
        lexicon = [r["word"] for r in top.collect()] if 0 < rate < 1 else []        # LEXICON words
        hashes = np.unique(W.hashed_words(pa.array(lexicon, pa.string()), W.ALNUM_LOWER)[0])
        out[target] = _fitted(rows, target, hashes)
    return out


def _fitted(rows: DataFrame, target: str, lexicon: np.ndarray) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                x = features(part.column(0), lexicon)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1)], ["x", "y"])

    found = rows.select("text", F.col(target).cast("double").alias("y")).mapInArrow(run, "x array<double>, y double")
    got = found.toPandas()                      # at most FIT_ROWS rows
    x = np.array(got["x"].tolist()).reshape(len(got), len(STYLE) + len(lexicon))
    order = np.lexsort((*x.T[:8], got["y"])) if len(got) else []
    return Model(x[order], got["y"].to_numpy()[order], lexicon)


def _score(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        words = np.unique(np.concatenate([models[t].lexicon for t in TARGETS]))
        use = {t: np.concatenate([np.arange(len(STYLE)), len(STYLE) + np.searchsorted(words, models[t].lexicon)]) for t in TARGETS}
        for batch in batches:
            for part in W.slices(batch, batch.schema.names[text_at]):
                x = features(part.column(text_at), words)
                cols = [pa.array(np.round(models[t].log_odds(x[:, use[t]]), 6)) for t in TARGETS]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *[f"_qc_{t}" for t in TARGETS]])

    return run


def evidence(docs: DataFrame, models: dict[str, Model], text_col: str = "text") -> DataFrame:
    """``docs`` plus the log odds ``_qc_quality`` and ``_qc_toxic`` of its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(f"_qc_{t}", T.DoubleType()) for t in TARGETS]])
    return docs.mapInArrow(_score(shared, docs.columns.index(text_col)), schema)


def _probability(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _odds(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


@dataclass(frozen=True)
class Spread:
    """Documents, summed scores, and the variances of one target: between hosts, between the paths of a host,
    and of one document's class around its path's rate."""

    n: int
    total: float
    host: float
    path: float
    noise: float


def site_sums(scored: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Per path: documents and, for each target, the sums of scores and of their squares; the same of its host
    and the squares of the host's path sizes."""
    p = {t: _probability(F.col(f"_qc_{t}")) for t in TARGETS}
    paths = stage(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(
        F.count("*").alias("n"), *[F.sum(p[t]).alias(t) for t in TARGETS],
        *[F.sum(p[t] * p[t]).alias(f"{t}_squares") for t in TARGETS]), "paths")
    size = F.col("n").cast("double")
    hosts = paths.groupBy(F.col("host").alias("_host")).agg(
        F.sum("n").alias("host_n"), F.sum(size * size).alias("host_sizes"), *[F.sum(t).alias(f"host_{t}") for t in TARGETS])
    return stage(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "sites")


def spreads(sums: DataFrame) -> dict[str, Spread]:
    """The variance components of each target (nested analysis of variance, unbalanced), none below zero."""
    share = F.col("n") / F.col("host_n")                # a host's values once, dealt over its paths
    one = sums.agg(
        F.sum("n").alias("n"), F.count("*").alias("paths"), F.count_distinct(F.struct("host")).alias("hosts"),
        F.sum(F.col("n") * share).alias("in_host"), F.sum(F.col("n").cast("double") * F.col("n")).alias("path_sizes"),
        F.sum(share * F.col("host_n") * F.col("host_n")).alias("host_sizes"),
        *[F.sum(t).alias(t) for t in TARGETS], *[F.sum(f"{t}_squares").alias(f"{t}_0") for t in TARGETS],
        *[F.sum(F.col(t) * F.col(t) / F.col("n")).alias(f"{t}_1") for t in TARGETS],
        *[F.sum(share * F.col(f"host_{t}") * F.col(f"host_{t}") / F.col("host_n")).alias(f"{t}_2") for t in TARGETS]).first()
    out, n = {}, one["n"] or 0
    for t in TARGETS:
        if not n:
            out[t] = Spread(0, 0.0, 0.0, 0.0, 0.25)
            continue
        rate = one[t] / n
        within = max(0.0, one[f"{t}_0"] - one[f"{t}_1"]) / max(1, n - one["paths"])
        free = n - one["in_host"]
        path = max(0.0, (one[f"{t}_1"] - one[f"{t}_2"] - (one["paths"] - one["hosts"]) * within) / free) if free > 1e-6 * n else 0.0
        free = n - one["host_sizes"] / n
        extra = path * (one["in_host"] - one["path_sizes"] / n)
        host = max(0.0, (one[f"{t}_2"] - one[t] * rate - (one["hosts"] - 1) * within - extra) / free) if free > 1e-6 * n else 0.0
        out[t] = Spread(n, one[t], host, path, max(0.0, rate * (1 - rate) - host - path))
    return out


def _weight(between: float, sampling: Column, n: Column) -> Column:
    """Of a site's own mean against its prior."""
    if between < 1e-12:
        return F.lit(0.0)
    own = F.least(n / (n + F.lit(float(LEAST_STRENGTH))), F.lit(between) / (F.lit(between) + sampling))
    return F.when(n > 0, own).otherwise(0.0)


def _rates(s: Spread, t: str, left_out: Column | None = None) -> tuple[Column, Column, Column]:
    """Global rate and posteriors of host and path, from the columns of ``site_sums``; a document's own score
    ``left_out`` counts in none of them."""
    k, own = (0, F.lit(0.0)) if left_out is None else (1, left_out)
    n, host_n = F.col("n") - k, F.col("host_n") - k
    sizes = F.col("host_sizes") - k * (2 * F.col("n") - 1)
    top = F.lit(s.total) if s.n <= k else F.lit(s.total) - own
    whole = F.least(F.lit(0.999), F.greatest(F.lit(1e-4), top / F.lit(float(max(1, s.n - k if s.n > k else s.n)))))
    at_least = F.greatest(host_n, F.lit(1))
    host_noise = F.lit(s.path) * sizes / (at_least * at_least) + F.lit(s.noise) / at_least
    host_w = _weight(s.host, host_noise, host_n)
    host = _inside(whole + host_w * ((F.col(f"host_{t}") - own) / at_least - whole))
    path_w = _weight(s.path, F.lit(s.noise) / F.greatest(n, F.lit(1)), n)
    return whole, host, _inside(host + path_w * ((F.col(t) - own) / F.greatest(n, F.lit(1)) - host))


def _inside(p: Column) -> Column:
    return F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))


def _shift(path: Column, whole: Column) -> Column:
    return F.greatest(F.lit(-MAX_SHIFT), F.least(F.lit(MAX_SHIFT), _odds(path) - _odds(whole)))


def site_posteriors(scored: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Per path: host, path, documents, and for each target the posteriors of host and path and the shift of
    the log odds, with all documents of the site."""
    sums = site_sums(scored, host, path)
    found = spreads(sums)
    cols = []
    for t in TARGETS:
        whole, host_p, path_p = _rates(found[t], t)
        cols += [host_p.alias(f"{t}_host"), path_p.alias(f"{t}_path"), _shift(path_p, whole).alias(f"{t}_shift")]
    return sums.select("host", "path", "n", *cols)


def posteriors(scored: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``scored`` plus ``_qc_site_<target>_host`` and ``_path``, the site's posteriors without the document itself,
    and the combined probability ``_qc_p_<target>``."""
    sums = site_sums(scored, host, path)
    found = spreads(sums)
    side = F.broadcast(sums) if is_small(sums, SITE_LIMIT) else sums
    row = scored.select(F.struct("*").alias("_row"))
    own = {t: F.col(f"_row._qc_{t}") for t in TARGETS}
    both = row.join(side, F.col(f"_row.{host}").eqNullSafe(F.col("host")) & F.col(f"_row.{path}").eqNullSafe(F.col("path")))
    cols = []
    for t in TARGETS:
        whole, host_p, path_p = _rates(found[t], t, _probability(own[t]))
        cols += [host_p.alias(f"_qc_site_{t}_host"), path_p.alias(f"_qc_site_{t}_path"),
                 _probability(own[t] + _shift(path_p, whole)).alias(f"_qc_p_{t}")]
    return both.select("_row.*", *cols)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: evidence, site posteriors, combined probabilities and the decision."""
    models = fit(docs, labels)
    scored = evidence(docs.select("doc_id", "text", "source", "lang"), models).drop("text")
    p = posteriors(stage(scored, "evidence"))
    return p.select("doc_id", *[F.col(f"_qc_{t}").alias(f"{t}_evidence") for t in TARGETS],
                    *[F.round(f"_qc_site_{t}_{x}", 6).alias(f"{t}_{x}") for t in TARGETS for x in ("host", "path")],
                    *[F.round(f"_qc_p_{t}", 6).alias(f"p_{'poor' if t == 'quality' else t}") for t in TARGETS],
                    (F.greatest("_qc_p_quality", "_qc_p_toxic") <= 0.5).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns kept."""
    models = fit(docs, labels)
    mine = [c for c in docs.columns if c.lower().startswith("_qc_")]        # kept under other names meanwhile
    taken, other = {c.lower() for c in docs.columns}, {}
    for c in mine:
        name = f"kept{c}"
        while name.lower() in taken:
            name = f"kept{name}"
        taken.add(name.lower())
        other[c] = name
    p = posteriors(stage(evidence(docs.withColumnsRenamed(other), models), "evidence"))
    return p.where(F.greatest("_qc_p_quality", "_qc_p_toxic") <= 0.5).select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])
