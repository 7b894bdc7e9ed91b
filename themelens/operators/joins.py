"""Joins (J1-J6). J7 lives in ``vectors``.

Broadcast hints are only used for the two fixed lookup lists (J5, J6), whose size is a constant.
Every other join is left to the planner: AQE turns it into a broadcast at run time when the
measured side is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``, and splits skewed
partitions otherwise. Containment joins (J2, J3) use the rarest inner word of a quote as their key; where
a quote has none they salt the review side by measured counts, because a single cluster can hold a
third of all reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens import KEYS
from themelens import constants as C
from themelens.functions.text import normalise_whitespace, title_word
from themelens.session import BROADCAST_BYTES, checked_broadcast, stage, written_bytes

FEW_QUOTES = 64             # quotes of a cluster that every review of it may be compared with
ROWS_PER_SALT = 50_000      # reviews of a cluster in one task when they meet its short quotes


def attach_labels(reviews: DataFrame, labels: DataFrame,
                  on=("product_id", "iso_week", "review_id", "source")) -> DataFrame:
    """Cluster labels to reviews, by review key (the positional zip, as an equi join)."""
    return reviews.join(labels, list(on))


def stop_words_df(spark: SparkSession, words=C.STOP_WORDS) -> DataFrame:
    # as an expression: no Python worker has to start for it
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in dict.fromkeys(words)])).alias("word"))


def functional_map_df(spark: SparkSession, pairs=C.FUNCTIONAL_MAP) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(w).alias("map_word"), F.lit(name).alias("mapped_name")) for w, name in pairs])
    return spark.range(1).select(F.inline(rows))


def drop_stop_words(words: DataFrame, stop: DataFrame | None = None, col: str = "word") -> DataFrame:
    """Anti join with the stop list. The own list is a fixed 74 words; a caller's is broadcast only after
    a check of its size."""
    own = stop is None
    stop = stop_words_df(words.sparkSession) if own else stop
    stop = stop.select(F.col(stop.columns[0]).alias(col))
    return words.join(F.broadcast(stop) if own else checked_broadcast(stop), col, "left_anti")


def map_functional(words: DataFrame, col: str = "word", fmap: DataFrame | None = None) -> DataFrame:
    """Word -> formal theme name, default ``Analysis of {Word} and Product Operations``.

    The lookup key is ``lower(title(word))``, as the name is looked up from the title-cased word."""
    fmap = F.broadcast(functional_map_df(words.sparkSession)) if fmap is None else checked_broadcast(fmap)
    titled = words.withColumn("title", title_word(col)).withColumn("_k", F.lower("title"))
    joined = titled.join(fmap, F.col("_k") == F.col("map_word"), "left")
    before, after = C.UNMAPPED_NAME.split("{word}")
    default = F.concat(F.lit(before), F.col("title"), F.lit(after))
    return joined.withColumn("candidate", F.coalesce("mapped_name", default)).drop("_k", "map_word",
                                                                                  "mapped_name")


def _checked(quotes: DataFrame, on: list[str], max_rows: int) -> tuple[DataFrame, bool]:
    """Write the quotes once, then test on the written copy whether they may be broadcast: few rows and bytes,
    and at most ``FEW_QUOTES`` in a cluster, so that a review is compared with a handful."""
    staged = stage(quotes, "quotes")
    if max_rows <= 0 or written_bytes(staged.sparkSession, staged) > BROADCAST_BYTES:
        return staged, False
    total, most = staged.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    return staged, (total or 0) <= max_rows and (most or 0) <= FEW_QUOTES


def _words(text: str) -> Column:
    return F.filter(F.array_distinct(F.split(text, " ")), lambda w: w != "")


def containment_candidates(quotes: DataFrame, reviews: DataFrame, on: list[str]) -> DataFrame:
    """``on``, ``quote_idx``, ``_rid``: the reviews that hold the rarest inner word of a quote of their cluster.

    ``quotes``: ``on``, ``quote_idx``, ``_ql``; ``reviews``: ``on``, ``_rid``, ``_rl``. A text that contains a quote contains
    the words between its first and its last one as words of its own, so the rarest of these, by the number
    of the cluster's reviews that hold it, is an equi-join key. Only ids and words are shuffled. Quotes of one
    or two words have no inner word and give nothing here (see ``short_quotes``)."""
    inner = F.expr("slice(split(_ql, ' '), 2, greatest(size(split(_ql, ' ')) - 2, 0))")
    of_quotes = quotes.select(*on, "quote_idx", F.explode(F.filter(F.array_distinct(inner), lambda w: w != "")).alias("word"))
    of_reviews = reviews.select(*on, "_rid", F.explode(_words("_rl")).alias("word"))
    held = stage(of_reviews.join(of_quotes.select(*on, "word").distinct(), [*on, "word"], "left_semi"), "held-words")
    counts = held.groupBy(*on, "word").agg(F.count(F.lit(1)).alias("n"))
    # a word that no review holds rules its quote out
    rarest = of_quotes.join(counts, [*on, "word"], "left").groupBy(*on, "quote_idx").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("k")).where("k.n > 0")
    return held.join(rarest.select(*on, "quote_idx", F.col("k.word").alias("word")), [*on, "word"]).select(*on, "quote_idx", "_rid")


def short_quotes(quotes: DataFrame) -> DataFrame:
    """The quotes without an inner word."""
    inner = F.expr("slice(split(_ql, ' '), 2, greatest(size(split(_ql, ' ')) - 2, 0))")
    return quotes.where(F.size(F.filter(inner, lambda w: w != "")) == 0)


def _pairs(quotes: DataFrame, reviews: DataFrame, on: list[str], salts: int | None) -> DataFrame:
    """Quotes (``_ql`` and what else they carry) with the reviews of their cluster that contain them.

    Long quotes meet the reviews of ``containment_candidates``; distinct short ones meet every review of their
    cluster, spread over salts of about ``ROWS_PER_SALT`` reviews of the largest cluster."""
    contains = F.instr(F.col("_rl"), F.col("_ql")) > 0
    reviews = stage(reviews.withColumn("_rid", F.monotonically_increasing_id()), "reviews")
    found = containment_candidates(quotes, reviews, on)
    long = found.join(quotes, [*on, "quote_idx"]).join(reviews.drop(*on), "_rid").where(contains)
    short = stage(short_quotes(quotes), "short-quotes")
    if short.isEmpty():
        return long
    if salts is None:
        most = reviews.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        salts = max(1, -(-most // ROWS_PER_SALT))
    spread = reviews.withColumn("_salt", F.pmod(F.xxhash64("_rid"), F.lit(salts)).cast("int"))
    texts = short.select(*on, "_ql").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = spread.join(texts, [*on, "_salt"]).where(contains).drop("_salt")
    return long.unionByName(hits.join(short, [*on, "_ql"]).select(*long.columns))


def ground_quotes(quotes: DataFrame, clustered: DataFrame, keys=KEYS, salts: int | None = None,
                  keep_unmatched: bool = False, broadcast_max_rows: int = 100_000) -> DataFrame:
    """Ground each proposed quote in its own cluster.

    Both sides are whitespace-normalised and compared case-insensitively; the first review (by
    ``ord``) that contains the quote wins and the output takes the *review's* casing. Unmatched
    quotes are dropped (or kept with ``matched = false``). ``quotes``: keys, ``cluster_id``,
    ``quote_idx``, ``quote``. Output: keys, ``cluster_id``, ``quote_idx``, ``text``,
    ``source_review_id``.

    Plan: proposed quotes are few (a handful per top cluster). After a check of their size and of
    their number in a cluster they are broadcast, so the review text is never shuffled and a hot
    cluster costs nothing extra. Beyond either limit (``broadcast_max_rows``, ``FEW_QUOTES``) the rarest
    inner word of each quote is an equi-join key and only the reviews that hold it are compared, so
    comparisons per review do not grow with the quotes of its cluster. Either way the residual ``instr``
    test picks matches and ``min_by`` over them is a partial aggregate.
    """
    on = [*keys, "cluster_id"]
    q = (quotes.withColumn("_qn", normalise_whitespace("quote"))
               .withColumn("_ql", F.lower("_qn")))
    r = (clustered.select(*on, "ord", "review_id", normalise_whitespace("content").alias("_rn"))
                  .withColumn("_rl", F.lower("_rn")))
    qsel, small = _checked(q.select(*on, "quote_idx", "_qn", "_ql"), on, broadcast_max_rows)
    if small:
        j = r.join(F.broadcast(qsel), on).where(F.instr(F.col("_rl"), F.col("_ql")) > 0)
    else:
        j = _pairs(qsel, r, on, salts)
    # only the quoted piece goes through the aggregate, not the review text
    j = j.select(*on, "quote_idx", "ord", F.col("review_id").alias("source_review_id"),
                 F.expr("substring(_rn, instr(_rl, _ql), char_length(_qn))").alias("text"))
    best = j.groupBy(*on, "quote_idx").agg(
        F.min_by(F.struct("text", "source_review_id"), F.col("ord")).alias("m"))
    out = best.select(*on, "quote_idx", "m.text", "m.source_review_id")
    if not keep_unmatched:
        return out
    return (quotes.select(*on, "quote_idx", "quote").join(out, [*on, "quote_idx"], "left")
                  .withColumn("matched", F.col("source_review_id").isNotNull()))


def ground_quotes_loose(quotes: DataFrame, clustered: DataFrame, keys=KEYS,
                        salts: int | None = None, broadcast_max_rows: int = 100_000) -> DataFrame:
    """Keep a quote (in its own casing, no whitespace change) if any review of its cluster
    contains it, case-insensitively. Same plan choice as J2."""
    on = [*keys, "cluster_id"]
    q = quotes.withColumn("_ql", F.lower("quote"))
    r = clustered.select(*on, "review_id", F.lower("content").alias("_rl"))
    qsel, small = _checked(q.select(*on, "quote_idx", "_ql"), on, broadcast_max_rows)
    if small:
        j = r.join(F.broadcast(qsel), on).where(F.instr(F.col("_rl"), F.col("_ql")) > 0)
    else:
        j = _pairs(qsel, r, on, salts)
    return quotes.join(j.select(*on, "quote_idx").distinct(), [*on, "quote_idx"], "left_semi")


def run_history(runs: DataFrame, reviews: DataFrame, summaries: DataFrame) -> DataFrame:
    """What was sent when, for which week: runs with their review and summary counts."""
    rc = reviews.groupBy("run_id").agg(F.count(F.lit(1)).alias("reviews"))
    sc = summaries.groupBy("run_id").agg(F.count(F.lit(1)).alias("summaries"),
                                         F.max("generated_at").alias("last_summary_at"))
    return (runs.join(rc, "run_id", "left").join(sc, "run_id", "left")
                .withColumn("reviews", F.coalesce("reviews", F.lit(0)))
                .withColumn("summaries", F.coalesce("summaries", F.lit(0))))
