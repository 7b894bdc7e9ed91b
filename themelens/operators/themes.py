"""Theme operators.

Counting, ranking and grounding are distributed (A4, W1-W3, J2, J6). The only sequential step is
T3's naming, where each name depends on the names taken earlier in the same product-week; it runs
as one ``aggregate()`` over at most five rank-ordered clusters per key, each with at most ten words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens import KEYS
from themelens import constants as C
from themelens.functions.text import extract_json, normalise_ideas, normalise_whitespace
from themelens.operators.joins import ground_quotes, map_functional
from themelens.operators.windows import sample_first, top_clusters, top_terms
from themelens.session import checked_broadcast, stage

QUOTE = "struct<text:string,source_review_id:string>"
IDEA = "struct<title:string,description:string>"


def fill(template: str, **values) -> Column:
    """Template with ``{name}`` holes -> ``concat`` of literals and columns."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                cols.append(F.lit(p))
        else:
            v = values[p]
            cols.append(v if isinstance(v, Column) else F.lit(str(v)))
    return F.concat(*cols) if len(cols) > 1 else cols[0]


# ------------------------------------------------------------------------------------------------
# T1
# ------------------------------------------------------------------------------------------------
PROMPT = (
    "Review analysis for {product}.\n\n"
    "Write one theme for the reviews below.\n"
    "- name: a specific, formal concept of 3 to 6 words about a concrete feature, error or area; "
    "no one-word names, no subjective adjectives, no generic words.\n"
    "- summary: exactly two full sentences; the first states the issue or praise, the second its "
    "impact on users.\n"
    "- quotes: 3 full sentences copied verbatim from the reviews.\n"
    "- action_ideas: 1 idea as an object with a title and a description.\n\n"
    "Reviews:\n{reviews}\n\n"
    'Answer with one JSON object with the keys "name", "summary", "quotes", "action_ideas".'
)


def theme_prompts(clustered: DataFrame, top: DataFrame, n: int = C.PROMPT_REVIEWS,
                  keys=KEYS, template: str = PROMPT) -> DataFrame:
    """One prompt per top cluster holding its first ``n`` reviews as ``- review`` lines."""
    sel = clustered.join(top.select(*keys, "cluster_id"), [*keys, "cluster_id"], "left_semi")
    first = sample_first(sel, n, keys)
    lines = first.groupBy(*keys, "cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "content"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["content"])), "\n")
    return lines.join(top.select(*keys, "cluster_id", "rank"), [*keys, "cluster_id"]).select(
        *keys, "cluster_id", "rank", F.size("r").alias("n_reviews"),
        fill(template, product=F.col("product_id"), reviews=text).alias("prompt"))


# ------------------------------------------------------------------------------------------------
# T2
# ------------------------------------------------------------------------------------------------
RESPONSE_SCHEMA = "struct<name:string,summary:string,quotes:array<string>,action_ideas:array<string>>"


def parse_theme_responses(responses: DataFrame, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """T2 (first half): response text -> theme fields, plus a rejects table.

    A response is rejected when it holds no ``{...}``, the text is not a JSON object, or the object
    is empty. Missing keys take the defaults; a key present with null, or an idea object without
    title or description, makes the theme invalid (F9 drops it later)."""
    js = extract_json("response")
    r = responses.withColumn("_js", js).withColumn("_keys", F.json_object_keys("_js"))
    bad = (F.col("_js") == "") | F.col("_keys").isNull() | (F.size("_keys") == 0)
    rejects = r.where(bad).select(*keys, "cluster_id", F.lit("no JSON object").alias("reason"))
    p = r.where(~bad).withColumn("_p", F.from_json("_js", RESPONSE_SCHEMA))

    def field(name, default):
        return F.when(F.array_contains("_keys", name), F.col(f"_p.{name}")).otherwise(default)

    parsed = p.select(
        *keys, "cluster_id",
        field("name", F.lit(C.DEFAULT_THEME_NAME)).alias("name"),
        field("summary", F.lit(C.DEFAULT_THEME_SUMMARY)).alias("summary"),
        field("quotes", F.array().cast("array<string>")).alias("proposed_quotes"),
        normalise_ideas(F.when(F.array_contains("_keys", "action_ideas"), F.get_json_object("_js", "$.action_ideas"))
                        .otherwise(F.lit("[]"))).alias("action_ideas"),
    )
    return parsed, rejects


def themes_from_responses(responses: DataFrame, clustered: DataFrame, top: DataFrame,
                          keys=KEYS) -> DataFrame:
    """Parsed responses + grounded quotes (J2) + validity (F9) -> theme rows."""
    from themelens.operators.filters import valid_themes
    parsed, _ = parse_theme_responses(responses, keys)
    parsed = parsed.where(F.col("summary").isNotNull() & F.col("proposed_quotes").isNotNull()
                          & F.col("action_ideas").isNotNull())
    quotes = parsed.select(*keys, "cluster_id",
                           F.posexplode("proposed_quotes").alias("quote_idx", "quote"))
    grounded = ground_quotes(quotes, clustered, keys)
    qa = grounded.groupBy(*keys, "cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("quote_idx", "text", "source_review_id"))),
                    lambda x: F.struct(x["text"].alias("text"),
                                       x["source_review_id"].alias("source_review_id"))).alias("quotes"))
    themes = (parsed.join(top.select(*keys, "cluster_id", "rank", "size"), [*keys, "cluster_id"])
                    .join(qa, [*keys, "cluster_id"], "left")
                    .select(*keys, "cluster_id", "rank", "name", "summary",
                            F.col("size").alias("review_count"),
                            F.coalesce("quotes", F.array().cast(f"array<{QUOTE}>")).alias("quotes"),
                            "action_ideas", F.lit(0.0).alias("sentiment_score")))
    return valid_themes(themes)


# ------------------------------------------------------------------------------------------------
# T3 + T4
# ------------------------------------------------------------------------------------------------
_OUT = ("struct<rank:int,cluster_id:int,name:string,primary:string,words:array<string>>")


def _name_step(acc, x):
    used = acc["used"]
    cands = x["cands"]
    free = F.filter(cands, lambda w: ~F.array_contains(used, w["candidate"]))
    first_free = F.get(free, 0)
    first = F.get(cands, 0)
    has_free = F.size(free) > 0
    has_words = F.size(cands) > 0
    primary = (F.when(has_free, first_free["title"]).when(has_words, first["title"])
                .otherwise(F.lit(C.NO_WORD_PRIMARY)))
    base = (F.when(has_words, first["candidate"]).otherwise(F.lit(C.NO_WORD_NAME)))
    prefix, suffix = C.GROUP_SUFFIX.split("{letter}")
    tries = F.transform(F.sequence(F.lit(0), F.size(used) + 1),
                        lambda k: F.when(k == 0, base).otherwise(
                            F.concat(base, F.lit(prefix), F.char(F.lit(64) + k), F.lit(suffix))))
    fallback = F.get(F.filter(tries, lambda s: ~F.array_contains(used, s)), 0)
    name = F.when(has_free, first_free["candidate"]).otherwise(fallback)
    entry = F.struct(x["rank"].cast("int").alias("rank"), x["cluster_id"].cast("int").alias("cluster_id"),
                     name.alias("name"), primary.alias("primary"),
                     F.transform(cands, lambda w: w["title"]).alias("words"))
    return F.struct(F.array_append(used, name).alias("used"),
                    F.array_append(acc["out"], entry).alias("out"))


def name_themes(top: DataFrame, terms: DataFrame, keys=KEYS) -> DataFrame:
    """Names without a model. Walk the clusters by rank; take the first of the top-10 words
    whose name is not yet used in this product-week; if none, the first word's name (or the
    no-word name) with `` (Group A)``, `` (Group B)``, ... until unique.

    ``top``: keys, cluster_id, rank. ``terms``: keys, cluster_id, term_rank, word (W2 output)."""
    if "rank" not in terms.columns:
        terms = terms.join(top.select(*keys, "cluster_id", "rank"), [*keys, "cluster_id"])
    mapped = map_functional(terms)

    def entry(rank, cluster, term_rank, title, cand):
        return F.struct(rank.cast("int").alias("rank"), cluster.cast("int").alias("cluster_id"),
                        term_rank.cast("int").alias("term_rank"), title.alias("title"), cand.alias("candidate"))

    none = F.lit(None).cast("string")
    marks = top.select(*keys, entry(F.col("rank"), F.col("cluster_id"), F.lit(0), none, none).alias("e"))
    words = mapped.select(*keys, entry(F.col("rank"), F.col("cluster_id"), F.col("term_rank"), F.col("title"),
                                       F.col("candidate")).alias("e"))
    # one shuffle: each key's clusters (term_rank 0) and their words, at most 5 + 50 entries
    per_key = marks.unionByName(words).groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("es"))
    es = F.col("es")
    clusters = F.transform(F.filter(es, lambda e: e["term_rank"] == 0), lambda c: F.struct(
        c["rank"].alias("rank"), c["cluster_id"].alias("cluster_id"),
        F.transform(F.filter(es, lambda w: (w["rank"] == c["rank"]) & (w["term_rank"] > 0)),
                    lambda w: F.struct(w["title"].alias("title"), w["candidate"].alias("candidate")))
        .alias("cands")))
    per_key = per_key.select(*keys, clusters.alias("clusters"))
    zero = F.struct(F.array().cast("array<string>").alias("used"),
                    F.array().cast(f"array<{_OUT}>").alias("out"))
    named = per_key.select(*keys, F.explode(F.aggregate("clusters", zero, _name_step)["out"]).alias("t"))
    return named.select(*keys, "t.*")


def describe_themes(named: DataFrame, first_reviews: DataFrame, sizes: DataFrame,
                    keys=KEYS) -> DataFrame:
    """T4: two template sentences (primary word; words 2-3 of the top list when it has more than
    two, else ``overall app workflow``), one ``Optimize {Word} Flow`` idea, and the cluster's first
    review, whitespace-normalised, as its quote (it always grounds in itself)."""
    words = F.col("words")
    second = F.when(F.size(words) > 2, F.array_join(F.slice(words, 2, 2), ", ")).otherwise(
        F.lit(C.NO_SECOND_WORDS))
    low = F.lower("primary")
    summary = F.concat(fill(C.SENTENCE_1, word=low), F.lit(" "), fill(C.SENTENCE_2, words=second))
    idea = F.struct(fill(C.IDEA_TITLE, word=F.col("primary")).alias("title"),
                    fill(C.IDEA_DESCRIPTION, word=low).alias("description"))
    quote = F.struct(normalise_whitespace("first_content").alias("text"),
                     F.col("first_review_id").alias("source_review_id"))
    return (named.join(sizes.select(*keys, "cluster_id", "size"), [*keys, "cluster_id"])
                 .join(first_reviews, [*keys, "cluster_id"], "left")
                 .select(*keys, "cluster_id", "rank", "name", summary.alias("summary"),
                         F.col("size").alias("review_count"),
                         F.when(F.col("first_content").isNull(), F.array().cast(f"array<{QUOTE}>"))
                          .otherwise(F.array(quote)).alias("quotes"),
                         F.array(idea).alias("action_ideas"), F.lit(0.0).alias("sentiment_score")))


def first_reviews(clustered: DataFrame, keys=KEYS) -> DataFrame:
    """First review of each cluster, as a ``min_by`` aggregate."""
    m = F.min_by(F.struct("content", "review_id"), "ord")
    return clustered.groupBy(*keys, "cluster_id").agg(m.alias("f")).select(
        *keys, "cluster_id", F.col("f.content").alias("first_content"),
        F.col("f.review_id").alias("first_review_id"))


def local_themes(clustered: DataFrame, keys=KEYS, n: int = C.TOP_THEMES,
                 stop_words: DataFrame | None = None) -> DataFrame:
    """T3 + T4 over clustered reviews (noise already handled by F5): valid theme rows per key. ``clustered`` is read
    several times: a stored copy of an expensive one is better."""
    from themelens.operators.aggregates import counted_sizes, frequent_word_counts, review_age
    on = [*keys, "cluster_id"]
    top = stage(top_clusters(counted_sizes(clustered, keys), n, keys), "top-clusters")
    aged = clustered.withColumn("_age", review_age())
    return themes_from_counts(top, frequent_word_counts(clustered, top, C.TOP_TERMS, stop_words, keys),
                              lambda ages: aged.join(ages, [*on, "_age"], "left_semi"), keys)


def exact_top_terms(counts: DataFrame, reviews_at, keys=KEYS, n: int = C.TOP_TERMS) -> DataFrame:
    """W2 from ``word_counts``. By count and age of the first review a few words more than ``n`` may be among the first
    ``n``: those that tie in both. Only the reviews of these ages are read again for the exact first positions.
    ``reviews_at(ages)`` gives the reviews (``on``, ``ord``, ``_age``, ``content``) of the ages (``on``, ``_age``)."""
    from themelens.functions.text import tokens
    on = [*keys, "cluster_id"]
    order = Window.partitionBy(*on).orderBy(F.col("count").desc(), F.col("first_age"))
    likely = counts.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= n).drop("_rank")
    likely = stage(likely.withColumnRenamed("first_age", "_age"), "likely-terms")
    few = reviews_at(checked_broadcast(likely.select(*on, "_age").distinct()))
    words = few.select(*on, "_age", "ord", F.posexplode(tokens("content")).alias("tok_pos", "word"))
    first = words.join(likely.select(*on, "_age", "word"), [*on, "_age", "word"], "left_semi").groupBy(*on, "word").agg(
        F.min(F.struct("ord", "tok_pos")).alias("first_pos"))
    return top_terms(likely.drop("_age").join(first, [*on, "word"]), n, keys)


def themes_from_counts(top: DataFrame, counts: DataFrame, reviews_at, keys=KEYS) -> DataFrame:
    """T3 + T4 from the top clusters (W1, staged) and ``word_counts``; ``reviews_at`` as in ``exact_top_terms``."""
    from themelens.operators.filters import valid_themes
    on = [*keys, "cluster_id"]
    age = F.col("min_ord.age")
    newest = reviews_at(checked_broadcast(top.select(*on, F.coalesce(age, F.lit(-(1 << 63))).alias("_age"))))
    newest = newest.where(F.col("content").isNotNull()).withColumn("review_id", F.col("ord.review_id"))
    firsts = stage(first_reviews(newest, keys), "first-reviews")
    terms = exact_top_terms(counts.join(checked_broadcast(top.select(*on)), on, "left_semi"), reviews_at, keys)
    named = name_themes(top, stage(terms, "top-terms"), keys)
    return valid_themes(describe_themes(named, firsts, top.select(*on, "size"), keys))


def themes_from_stats(stats: DataFrame, keys=KEYS, n: int = C.TOP_THEMES) -> DataFrame:
    """T3 + T4 from cluster statistics (A1 + A4 with first reviews, see ``cluster_stats``); the
    statistics may also be rolled up from finer keys (P2)."""
    from themelens.operators.aggregates import sizes_of, terms_of
    from themelens.operators.filters import valid_themes
    top = top_clusters(sizes_of(stats, keys), n, keys)
    on = [*keys, "cluster_id"]
    terms = top_terms(terms_of(stats).join(top.select(*on, "rank"), on), C.TOP_TERMS, keys)
    named = name_themes(top, terms, keys)
    firsts = top.select(*on, "first_content", "first_review_id")    # from the same pass
    return valid_themes(describe_themes(named, firsts, top.select(*on, "size"), keys))


def themes_with_fallback(responses: DataFrame, clustered: DataFrame, top: DataFrame, keys=KEYS,
                         stop_words: DataFrame | None = None) -> DataFrame:
    """T2 where the model answered, T3 + T4 for top clusters without a response (their call failed), with
    one set of used names per key. A response that cannot be parsed is a reject, not a failed call."""
    on = [*keys, "cluster_id"]
    failed = top.join(responses.select(*on), on, "left_anti").select(*on, "rank")
    # a handful of clusters per key; Spark broadcasts them if they are small
    rest = clustered.join(failed.select(*on), on, "left_semi")
    local = local_themes(rest, keys, stop_words=stop_words)
    local = local.drop("rank").join(failed, on)         # the rank among all clusters
    answered = themes_from_responses(responses, clustered, top, keys)
    return answered.unionByName(local.select(*answered.columns))


# ------------------------------------------------------------------------------------------------
# T5, T6
# ------------------------------------------------------------------------------------------------
def fallback_theme(totals: DataFrame, themes: DataFrame, keys=KEYS) -> DataFrame:
    """T5: keys where no theme survived get one ``General Feedback`` theme over all reviews."""
    missing = totals.join(themes.select(*keys), list(keys), "left_anti")
    idea = F.struct(F.lit(C.FALLBACK_IDEA_TITLE).alias("title"),
                    F.lit(C.FALLBACK_IDEA_DESCRIPTION).alias("description"))
    return missing.select(
        *keys, F.lit(-1).alias("cluster_id"), F.lit(1).alias("rank"),
        F.lit(C.FALLBACK_THEME_NAME).alias("name"),
        fill(C.FALLBACK_THEME_SUMMARY, n=F.col("total_reviews").cast("string")).alias("summary"),
        F.col("total_reviews").alias("review_count"), F.array().cast(f"array<{QUOTE}>").alias("quotes"),
        F.array(idea).alias("action_ideas"), F.lit(0.0).alias("sentiment_score"))


# FIXED VALUES: words a theme name must not use (content rules of the prompt).
BANNED_NAME_PHRASES = ("Analysis", "User Interaction", "Product Operations", "General Feedback")
BANNED_ADJECTIVES = ("Worst", "Best", "Great", "Good", "Bad", "Fantastic", "Terrible", "Excellent")


def theme_lint(themes: DataFrame) -> DataFrame:
    """Flag themes that break the content rules."""
    n_words = F.size(F.split(F.trim("name"), r"\s+"))
    banned = "(?i)\\b(" + "|".join(re.escape(w) for w in BANNED_NAME_PHRASES + BANNED_ADJECTIVES) + ")\\b"
    sentences = F.size(F.regexp_extract_all(F.trim("summary"), F.lit(r"[^.!?]+[.!?]+"), 0))
    return themes.select(
        "*",
        (n_words == 1).alias("one_word_name"),
        F.col("name").rlike(banned).alias("banned_words"),
        (sentences != 2).alias("not_two_sentences"),
        (~n_words.between(3, 6)).alias("bad_name_length"))
