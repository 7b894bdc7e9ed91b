"""Aggregations (A1-A16). Each is a ``groupBy`` with partial (map-side) aggregation; list-building
aggregates only ever collect a bounded number of elements per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themelens import KEYS
from themelens import constants as C
from themelens.functions.text import tokens


def cluster_sizes(clustered: DataFrame, keys=KEYS) -> DataFrame:
    """A1: reviews per cluster, with the first-seen review (``min_ord``) for stable tie-breaks."""
    return clustered.groupBy(*keys, "cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.min("ord").alias("min_ord"))


def collect_clusters(clustered: DataFrame, keys=KEYS, cols=("review_id", "content")) -> DataFrame:
    """A2: every review of every cluster, one row each, with ``ord`` as its order inside the cluster.

    A cluster may hold a third of all rows, so its reviews stay rows; a bounded list for a prompt is
    W3/T1, counts come from A1 and quote checks from a join (J2)."""
    return clustered.select(*keys, "cluster_id", "ord", *cols)


def total_reviews(clustered: DataFrame, keys=KEYS) -> DataFrame:
    """A3: reviews per key, noise included."""
    return clustered.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_reviews"))


def token_rows(df: DataFrame, text_col: str = "content", keep=("cluster_id", "ord")) -> DataFrame:
    """S4 applied to a table: one row per token with its position in the text."""
    return df.select(*[c for c in df.columns if c in (*KEYS, *keep)],
                     F.posexplode(tokens(text_col)).alias("tok_pos", "word"))


def term_counts(clustered: DataFrame, stop_words: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """A4: token frequency per cluster (stop words removed by J5), with the first position
    ``(ord, token index)`` so ties keep first-seen order."""
    from themelens.operators.joins import drop_stop_words
    toks = token_rows(clustered)
    toks = drop_stop_words(toks, stop_words)
    return toks.groupBy(*keys, "cluster_id", "word").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct(F.col("ord"), F.col("tok_pos"))).alias("first_pos"))


def cluster_stats(clustered: DataFrame, stop_words: DataFrame | None = None, keys=KEYS,
                  windows: str | None = None) -> DataFrame:
    """A1 + A4 (+ first review) from one aggregation: every review contributes its tokens plus one marker row
    that carries its text, so the same groups yield the cluster sizes, each cluster's first review (marker
    rows) and the term counts (token rows). Spark shares the shuffle between branches that read the same
    columns of it; a branch that prunes some tokenises again.

    ``windows`` names a column with a review's groups, an array of structs (keys, ``cluster_id``), where a
    review belongs to several: it is tokenised once and its tokens are dealt to all of them."""
    from themelens.operators.joins import drop_stop_words
    none = F.lit(None).cast("string")
    marker = F.struct(none.alias("w"), F.col("content").alias("c"))
    elems = F.concat(F.array(marker),
                     F.transform(tokens("content"), lambda t: F.struct(t.alias("w"), none.alias("c"))))
    group = [windows] if windows else [*keys, "cluster_id"]
    toks = (clustered.select(*group, "ord", F.posexplode(elems).alias("tok_pos", "e"))
                     .select(*group, "ord", "tok_pos", F.col("e.w").alias("word"), F.col("e.c").alias("_text")))
    toks = drop_stop_words(toks, stop_words)       # a null word never matches, so markers stay
    if windows:
        toks = toks.select("ord", "tok_pos", "word", "_text", F.inline(windows))
    pos = F.struct(F.col("ord"), F.col("tok_pos"))
    # ``is_marker`` is an aggregate output on purpose: a filter on it cannot be pushed below the
    # aggregation, so the size and term branches share one shuffle (and one tokenisation)
    return toks.groupBy(*keys, "cluster_id", "word").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(pos).alias("first_pos"),
        F.max(F.col("tok_pos") == 0).alias("is_marker"),
        F.min_by(F.col("_text"), pos).alias("first_text"))


def review_age():
    """``ord.age`` as a number that sorts like it (a null one first)."""
    return F.coalesce(F.col("ord.age"), F.lit(-(1 << 63)))


def counted_sizes(clustered: DataFrame, keys=KEYS) -> DataFrame:
    """A1 over the reviews that have a text."""
    return cluster_sizes(clustered.where(F.col("content").isNotNull()), keys)


def word_counts(clustered: DataFrame, stop_words: DataFrame | None = None, keys=KEYS, windows: str | None = None) -> DataFrame:
    """A4 with numbers only, so that Spark aggregates tokens in a hash table and neither sorts nor spills them:
    keys, ``cluster_id``, ``word``, ``count`` and ``first_age``, the ``review_age`` of the word's first review. The exact
    first position is found afterwards for the few words that need it (``themes.exact_top_terms``). ``windows`` as
    in ``cluster_stats``."""
    from themelens.operators.joins import drop_stop_words
    group = [windows] if windows else [*keys, "cluster_id"]
    toks = clustered.select(*group, review_age().alias("_age"), F.explode(tokens("content")).alias("word"))
    toks = drop_stop_words(toks, stop_words)
    if windows:
        toks = toks.select("_age", "word", F.inline(windows))
    return toks.groupBy(*keys, "cluster_id", "word").agg(F.count(F.lit(1)).alias("count"), F.min("_age").alias("first_age"))


#: Hash buckets that a cluster's tokens are counted in before its words are.
WORD_SLOTS = 4096
#: Buckets, over all clusters, whose keys may be sent to every task.
SENT_SLOTS = 500_000


def frequent_word_counts(clustered: DataFrame, top: DataFrame, n: int, stop_words: DataFrame | None = None, keys=KEYS,
                         slots: int = WORD_SLOTS) -> DataFrame:
    """``word_counts`` of the clusters in ``top``, for the words that may be among the ``n`` most frequent of their cluster:
    every word as frequent as the ``n``-th, and some more. Every token of every review is counted.

    Texts are tokenised once, into a stored table. Tokens are first counted by hash bucket (one number a group, so few rows
    are shuffled and nothing is sorted): no word is more frequent than its bucket. Words of buckets at least half as full as
    the ``n``-th fullest are then counted exactly, and so are those of any other bucket not below the ``n``-th of these
    words. Clusters of rare words only keep all their buckets; if too many are left, all words are counted."""
    from themelens.operators.joins import drop_stop_words
    from themelens.session import checked_broadcast, is_small, stage
    on = [*keys, "cluster_id"]
    ids = checked_broadcast(top.select(*on).distinct().withColumn("_c", F.monotonically_increasing_id()))
    toks = clustered.join(ids, on).select("_c", review_age().alias("_age"), F.explode(tokens("content")).alias("word"))
    toks = stage(drop_stop_words(toks, stop_words).select("_c", "_age", "word"), "tokens")
    slot = (F.col("_c") * slots + F.pmod(F.xxhash64("word"), F.lit(slots))).alias("_slot")

    def counted(part: DataFrame) -> DataFrame:
        return part.groupBy("_c", "word").agg(F.count(F.lit(1)).alias("count"), F.min("_age").alias("first_age"))

    def words_of(some: DataFrame) -> DataFrame:
        return stage(counted(toks.select("*", slot).join(F.broadcast(some.select("_slot")), "_slot", "left_semi")), "word-counts")

    def nth(counts: DataFrame) -> DataFrame:
        w = Window.partitionBy("_c").orderBy(F.col("count").desc())
        best = counts.select("_c", "count", F.row_number().over(w).alias("_rank")).where(F.col("_rank") <= n)
        return best.groupBy("_c").agg(F.min("count").alias("_least"))

    filled = toks.groupBy("_c", slot).agg(F.count(F.lit(1)).alias("count"))
    filled = stage(filled, "word-slots")
    filled = stage(filled.join(nth(filled), "_c").select("_c", "_slot", "count", (F.col("count") * 2 >= F.col("_least")).alias("_first")),
                   "word-slots")
    few = lambda some: is_small(some, SENT_SLOTS, 1 << 62)
    words, first = None, filled.where("_first")
    if few(first):
        words = words_of(first)
        rest = stage(filled.where("not _first").join(nth(words), "_c").where(F.col("count") >= F.col("_least")), "word-slots")
        if not few(rest):
            words = None
        elif not rest.isEmpty():
            words = words.unionByName(words_of(rest))
    return (counted(toks) if words is None else words).join(ids, "_c").drop("_c")


def roll_up_stats(stats: DataFrame, keys=KEYS) -> DataFrame:
    """Merge cluster statistics of finer groups into ``keys`` (counts add, first positions and
    first reviews take the minimum), so a statistic computed once per calendar week can serve every
    report window containing that week."""
    pos = F.col("first_pos")
    return stats.groupBy(*keys, "cluster_id", "word").agg(
        F.sum("count").alias("count"), F.min(pos).alias("first_pos"),
        F.max("is_marker").alias("is_marker"), F.min_by(F.col("first_text"), pos).alias("first_text"))


def sizes_of(stats: DataFrame, keys=KEYS) -> DataFrame:
    """Cluster sizes with the first review (``min_ord``, ``first_content``, ``first_review_id``)."""
    return stats.where(F.col("is_marker")).select(
        *keys, "cluster_id", F.col("count").alias("size"), F.col("first_pos.ord").alias("min_ord"),
        F.col("first_text").alias("first_content"), F.col("first_pos.ord.review_id").alias("first_review_id"))


def terms_of(stats: DataFrame) -> DataFrame:
    return stats.where(~F.col("is_marker")).drop("is_marker", "first_text")


def rating_kpis(reviews: DataFrame, by=KEYS) -> DataFrame:
    """A5: count, mean rating and the share (percent) of ratings >= 4."""
    return reviews.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.avg("rating").alias("avg_rating"),
        (F.avg(F.when(F.col("rating") >= 4, 1).otherwise(0)) * 100).alias("positive_pct"))


def rating_distribution(reviews: DataFrame, by=()) -> DataFrame:
    """Count per rating, nulls dropped (order by ``rating`` when shown)."""
    return (reviews.where(F.col("rating").isNotNull())
                   .groupBy(*by, "rating").agg(F.count(F.lit(1)).alias("count")))


def theme_distribution(summaries: DataFrame, keys=KEYS, label_len: int = 30) -> DataFrame:
    """Theme name (cut to 30 characters for labels), review count and its share of the shown
    themes. At most five themes per key, so the window is over a bounded group."""
    from themelens.functions.text import shorten
    t = summaries.select(*keys, F.posexplode("top_themes").alias("pos", "theme"))
    w = Window.partitionBy(*keys)
    return t.select(
        *keys, (F.col("pos") + 1).alias("rank"), F.col("theme.name").alias("name"),
        shorten(F.col("theme.name"), label_len).alias("label"),
        F.col("theme.review_count").alias("review_count"),
        (F.col("theme.review_count") / F.sum("theme.review_count").over(w)).alias("share"))


def needs_fallback(clustered: DataFrame, keys=KEYS, min_clusters: int = 2) -> DataFrame:
    """Keys with fewer than two non-noise clusters."""
    n = F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id")))
    return clustered.groupBy(*keys).agg(n.alias("n_clusters")).withColumn(
        "needs_fallback", F.col("n_clusters") < min_clusters)


def assemble_summary(themes: DataFrame, totals: DataFrame, keys=KEYS,
                     data_window=None, generated_at=None, usage: DataFrame | None = None) -> DataFrame:
    """Themes (at most five per key) -> one nested row per key, in rank order."""
    theme = F.struct("name", "summary", "review_count", "quotes", "action_ideas", "sentiment_score")
    nested = themes.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("rank"), theme.alias("t")))),
                    lambda x: x["t"]).alias("top_themes"))
    out = totals.join(nested, list(keys), "left").withColumn(
        "top_themes", F.coalesce("top_themes", F.array().cast(nested.schema["top_themes"].dataType)))
    if usage is None:
        metrics = F.struct(F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"),
                           F.lit(0.0).alias("total_cost"))
    else:
        out = out.join(usage, list(keys), "left")
        metrics = F.struct(F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
                           F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"),
                           F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"))
    from themelens.functions.text import report_anchor
    window = data_window if data_window is not None else F.lit(C.DEFAULT_DATA_WINDOW)
    gen = generated_at if generated_at is not None else F.lit(None).cast("timestamp_ntz")
    return out.select(
        report_anchor("product_id", "iso_week").alias("run_id"), *keys,
        (window if not isinstance(window, str) else F.lit(window)).alias("data_window"),
        F.col("total_reviews").alias("total_reviews_analyzed"), "top_themes",
        metrics.alias("metrics"),
        (gen if not isinstance(gen, str) else F.lit(gen).cast("timestamp_ntz")).alias("generated_at"))


def usage_totals(responses: DataFrame, cap: float | None = None, keys=KEYS) -> DataFrame:
    """A10: tokens and cost per run; ``over_cap`` when the cost is above ``cap``."""
    out = responses.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost").alias("total_cost"))
    return out.withColumn("over_cap", F.col("total_cost") > F.lit(cap) if cap is not None else F.lit(False))


def quote_veracity(grounded_flags: DataFrame, keys=KEYS) -> DataFrame:
    """Share of proposed quotes that ground (input: one row per proposed quote with
    ``matched`` from ``ground_quotes(..., keep_unmatched=True)``)."""
    return grounded_flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("proposed"),
        F.sum(F.col("matched").cast("int")).alias("grounded"),
        F.avg(F.col("matched").cast("int")).alias("veracity"))


def clustering_coverage(clustered: DataFrame, keys=KEYS) -> DataFrame:
    """Share of reviews that are not noise."""
    return clustered.groupBy(*keys).agg(
        F.avg(F.when(F.col("cluster_id") != -1, 1).otherwise(0)).alias("coverage"))


def pii_leaks(texts: DataFrame, text_col: str, by=()) -> DataFrame:
    """PII hits by kind left in published text (each pattern alone). As in S1, texts without
    ``@`` (or without a digit) cannot match and skip the regex scan."""
    t = F.col(text_col)
    has_at = F.instr(t, "@") > 0
    has_digit = t.rlike(r"\p{Nd}")

    def hits(p, gate):
        n = F.size(F.regexp_extract_all(t, F.lit("(?U)" + p), 0))
        return F.sum(F.when(gate, n).otherwise(F.when(t.isNotNull(), F.lit(0))))
    return texts.groupBy(*by).agg(
        hits(C.EMAIL_PATTERN, has_at).alias("email_hits"),
        hits(C.PHONE_PATTERN, has_digit).alias("phone_hits"),
        hits(C.CARD_PATTERN, has_digit).alias("card_hits"))


def duplicate_deliveries(deliveries: DataFrame, keys=KEYS, channel: str = "channel") -> DataFrame:
    """Keys delivered more than once on a channel (target: none)."""
    return (deliveries.where(F.col("delivery_id").isNotNull())
                      .groupBy(*keys, channel).agg(F.count(F.lit(1)).alias("deliveries"))
                      .where(F.col("deliveries") > 1))


def delivery_success(deliveries: DataFrame, by=(), channel: str = "channel") -> DataFrame:
    """Share of deliveries that succeeded on the first attempt."""
    ok = (F.col("delivery_id").isNotNull() & (F.col("attempts") == 1)).cast("int")
    return deliveries.groupBy(*by, channel).agg(F.avg(ok).alias("success_rate"),
                                                F.count(F.lit(1)).alias("deliveries"))


def label_agreement(clustered: DataFrame, labels: DataFrame, on: str, label_col: str = "label",
                    by=()) -> DataFrame:
    """Cluster purity against a labelled table: sum over clusters of the largest label
    count, over all labelled rows. Contingency counts first, so only (cluster, label) rows move."""
    cont = (clustered.join(labels, on).groupBy(*by, "cluster_id", label_col)
                     .agg(F.count(F.lit(1)).alias("n")))
    per_cluster = cont.groupBy(*by, "cluster_id").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per_cluster.groupBy(*by).agg(
        (F.sum("top") / F.sum("n")).alias("purity"), F.sum("n").alias("labelled"),
        F.count(F.lit(1)).alias("clusters"))


def human_rating_means(ratings: DataFrame, keys=KEYS) -> DataFrame:
    """Mean coherence (1-5) and share of ideas judged useful, per key."""
    return ratings.groupBy(*keys).agg(
        F.avg("coherence").alias("coherence"),
        F.avg(F.col("useful").cast("int")).alias("actionability"),
        F.count(F.lit(1)).alias("ratings"))
