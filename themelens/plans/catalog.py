"""Registered queries: one per operator of SURVEY §2, each ``(spark, sf_dir) -> DataFrame`` over
the driver's tables (or data Spark derives from them). Oracle SQL for each is in ``oracle.py``.

Parameters used by the registered queries are fixed here once, chosen for the driver's invented
text (the default keyword lists never occur in it; see SURVEY §7.4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens import KEYS
from themelens import constants as C
from themelens.functions import text as T
from themelens.operators import aggregates as A
from themelens.operators import windows as W
from themelens.sources import testdata as D

# Parameters of the registered queries.
DRIVER_GROUPS = (("ering",), ("thing",))
AS_OF = "2024-01-29 00:00:00"

_registry: dict = {}


def register(name: str):
    def deco(fn):
        _registry[name] = fn
        return fn
    return deco


def registry() -> dict:
    return dict(_registry)


# ------------------------------------------------------------------------------------------------
# Shared derived views
# ------------------------------------------------------------------------------------------------
def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reviews(spark, sf_dir).withColumn("content", T.scrub_pii("content"))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrubbed reviews with keyword groups 0/1/2 as clusters (M5's grouping)."""
    return scrubbed(spark, sf_dir).withColumn("cluster_id", T.keyword_group("content", DRIVER_GROUPS))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``grouped``, but the last group is noise (-1), so noise handling is exercised."""
    g = grouped(spark, sf_dir)
    return g.withColumn("cluster_id", F.when(F.col("cluster_id") == len(DRIVER_GROUPS), F.lit(-1))
                        .otherwise(F.col("cluster_id")))


# ------------------------------------------------------------------------------------------------
# Flagship: top words of the top keyword groups per product-week
# ------------------------------------------------------------------------------------------------
def top_theme_words(g: DataFrame, n_clusters: int = 5, n_terms: int = 10) -> DataFrame:
    """One pass over the text: sizes and term counts from one aggregation (A1 + A4), then the top
    clusters (W1) and their top words (W2)."""
    stats = A.cluster_stats(g)
    sizes = W.top_clusters(A.sizes_of(stats), n_clusters)
    terms = W.top_terms(A.terms_of(stats).join(sizes.select(*KEYS, "cluster_id"), [*KEYS, "cluster_id"],
                                               "left_semi"), n_terms)
    return (sizes.join(terms, [*KEYS, "cluster_id"])
                 .select(*KEYS, "rank", "cluster_id", "size", "term_rank", "word", "count"))


@register("top_theme_words")
def q_top_theme_words(spark, sf_dir):
    return top_theme_words(grouped(spark, sf_dir))


# ------------------------------------------------------------------------------------------------
# Column functions applied to whole tables
# ------------------------------------------------------------------------------------------------
@register("scrub_pii")
def q_scrub_pii(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    return r.select("review_id", T.scrub_pii("content").alias("content"))


@register("iso_week")
def q_iso_week(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    return e.select("event_id", T.iso_week("ts").alias("iso_week"))


@register("report_anchor")
def q_report_anchor(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    return r.select(*KEYS).distinct().select(*KEYS, T.report_anchor("product_id", "iso_week").alias("anchor"))


@register("tokenise")
def q_tokenise(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    t = T.tokens("content")
    return r.select("review_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("title_word")
def q_title_word(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    w = r.select(F.explode(T.tokens("content")).alias("word")).distinct()
    return w.select("word", T.title_word("word").alias("title"))


@register("extract_json")
def q_extract_json(spark, sf_dir):
    c = D.table(spark, sf_dir, "conversations")
    # every third turn holds an object, across lines, with text around it
    holds = F.concat(F.lit("So:\n"), F.to_json(F.struct("conv_id", F.struct("role", "text").alias("said"))), F.lit("\nDone."))
    text = F.when(F.col("turn") % 3 == 0, holds).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.extract_json(text).alias("json_text"))


@register("contains_ci")
def q_contains_ci(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    return r.select("review_id", T.contains_ci("content", F.lit("THING")).alias("has_thing"),
                    T.contains_ci("content", F.upper(F.substring("user_name", 1, 5))).alias("has_user"))


@register("keyword_group")
def q_keyword_group(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    return r.select("review_id", T.keyword_group("content", DRIVER_GROUPS).alias("grp"),
                    T.keyword_group("content").alias("default_grp"))


@register("normalise_ideas")
def q_normalise_ideas(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    # a string (the whole text), objects, a string that begins like an object, and what must be skipped
    raw = F.concat(F.lit("["), _js("content"), F.lit(", null, 5, "),
                   F.to_json(F.struct(F.col("user_name").alias("title"), F.col("review_id").alias("description"))),
                   F.lit(", [1], "), F.to_json(F.struct(F.col("user_name").alias("title"))), F.lit(', "{menu} is hidden"]'))
    ideas = r.select("review_id", F.posexplode(T.normalise_ideas(raw)).alias("idea_idx", "idea"))
    return ideas.select("review_id", "idea_idx", F.col("idea.title").alias("title"),
                        F.col("idea.description").alias("description"))


# ------------------------------------------------------------------------------------------------
# F1-F9
# ------------------------------------------------------------------------------------------------
from themelens.operators import filters as Fl  # noqa: E402


@register("review_window")
def q_review_window(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    return Fl.review_window(r, AS_OF, weeks=2).select("review_id", "product_id", "review_ts")


def _landed_fields(r: DataFrame) -> DataFrame:
    """Text fields as a store would land them: malformed ratings and dates by a fixed rule."""
    doc = F.col("review_id").cast("long")
    iso = F.date_format("review_ts", "yyyy-MM-dd'T'HH:mm:ss")
    date_text = (F.when(doc % 7 == 0, F.lit("not a date"))
                  .when(doc % 7 == 1, F.concat(iso, F.lit("-07:00")))
                  .when(doc % 7 == 2, F.concat(iso, F.lit("Z")))
                  .when(doc % 7 == 3, F.date_format("review_ts", "yyyy-MM-dd"))
                  .otherwise(iso))
    rating_text = F.when(doc % 11 == 0, F.lit("x")).otherwise(F.col("rating").cast("string"))
    return r.withColumn("rating_text", rating_text).withColumn("date_text", date_text)


@register("parse_review_fields")
def q_parse_review_fields(spark, sf_dir):
    r = _landed_fields(D.reviews(spark, sf_dir, with_order=False))
    p = Fl.parse_review_fields(r, AS_OF)
    return p.select("review_id", "rating", F.unix_micros("review_ts").alias("review_us"))


@register("flatten_newlines")
def q_flatten_newlines(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    return r.select("review_id", T.flatten_newlines("content").alias("content"))


@register("normalise_whitespace")
def q_normalise_whitespace(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    return r.select("review_id", T.normalise_whitespace("content").alias("content"))


@register("drop_noise")
def q_drop_noise(spark, sf_dir):
    c = clustered(spark, sf_dir)
    # one product keeps only noise, so the keep-noise branch is exercised too
    c = c.withColumn("cluster_id", F.when(F.col("product_id") == "src1", F.lit(-1)).otherwise(F.col("cluster_id")))
    return Fl.drop_noise(c).groupBy(*KEYS, "cluster_id").agg(F.count(F.lit(1)).alias("n"))


def _keys(spark, sf_dir) -> DataFrame:
    return D.reviews(spark, sf_dir, with_order=False).select(*KEYS).distinct()


def _runs(spark, sf_dir) -> DataFrame:
    """Stored runs, one per key, status by a fixed rule on the key."""
    k = _keys(spark, sf_dir)
    wk = F.substring("iso_week", 7, 2).cast("int")
    pn = F.substring("product_id", 4, 4).cast("int")
    status = (F.when((pn + wk) % 3 == 0, F.lit("COMPLETED")).when((pn + wk) % 3 == 1, F.lit("FAILED"))
               .otherwise(F.lit("IN_PROGRESS")))
    return k.select(T.report_anchor("product_id", "iso_week").alias("run_id"), *KEYS, status.alias("status"))


@register("runs_to_do")
def q_runs_to_do(spark, sf_dir):
    return Fl.runs_to_do(_keys(spark, sf_dir), _runs(spark, sf_dir))


@register("nonempty_runs")
def q_nonempty_runs(spark, sf_dir):
    k = _keys(spark, sf_dir)
    requested = k.unionByName(k.select("product_id", F.lit("2024-W05").alias("iso_week")).distinct())
    return Fl.nonempty_runs(requested, D.reviews(spark, sf_dir, with_order=False))


@register("shorten")
def q_shorten(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    return r.select("review_id", T.shorten("content", 30).alias("label30"),
                    T.shorten("content", 25).alias("label25"),
                    T.shorten("content", 100, always=True).alias("summary100"))


# ------------------------------------------------------------------------------------------------
# A1-A16
# ------------------------------------------------------------------------------------------------
@register("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    return A.cluster_sizes(clustered(spark, sf_dir)).select(*KEYS, "cluster_id", "size",
                                                            F.col("min_ord.review_id").alias("first_review_id"))


@register("collect_clusters")
def q_collect_clusters(spark, sf_dir):
    c = A.collect_clusters(grouped(spark, sf_dir))
    return c.select(*KEYS, "cluster_id", F.col("ord.age").alias("age"), "review_id", "content")


@register("total_reviews")
def q_total_reviews(spark, sf_dir):
    return A.total_reviews(clustered(spark, sf_dir))


@register("term_counts")
def q_term_counts(spark, sf_dir):
    t = A.term_counts(grouped(spark, sf_dir))
    return t.select(*KEYS, "cluster_id", "word", "count",
                    F.col("first_pos.ord.review_id").alias("first_review_id"),
                    F.col("first_pos.tok_pos").alias("first_tok_pos"))


@register("rating_kpis")
def q_rating_kpis(spark, sf_dir):
    k = A.rating_kpis(D.reviews(spark, sf_dir, with_order=False), by=["product_id"])
    return k.select("product_id", "total_reviews", F.round("avg_rating", 6).alias("avg_rating"),
                    F.round("positive_pct", 6).alias("positive_pct"))


@register("rating_distribution")
def q_rating_distribution(spark, sf_dir):
    return A.rating_distribution(D.reviews(spark, sf_dir, with_order=False))


@register("needs_fallback")
def q_needs_fallback(spark, sf_dir):
    c = clustered(spark, sf_dir)
    c = c.withColumn("cluster_id", F.when(F.col("iso_week") == "2024-W02", F.lit(-1))
                     .when(F.col("iso_week") == "2024-W03", F.lit(0)).otherwise(F.col("cluster_id")))
    return A.needs_fallback(c)


@register("clustering_coverage")
def q_clustering_coverage(spark, sf_dir):
    return A.clustering_coverage(clustered(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


@register("pii_leaks")
def q_pii_leaks(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    raw = A.pii_leaks(r, "content", by=["product_id"]).withColumn("stage", F.lit("raw"))
    s = r.withColumn("content", T.scrub_pii("content"))
    after = A.pii_leaks(s, "content", by=["product_id"]).withColumn("stage", F.lit("scrubbed"))
    return raw.unionByName(after)


def _deliveries(spark, sf_dir) -> DataFrame:
    """Delivery log by a fixed rule on the runs: doc and email per key; some retried, some failed,
    some sent twice."""
    runs = _runs(spark, sf_dir)
    wk = F.substring("iso_week", 7, 2).cast("int")
    pn = F.substring("product_id", 4, 4).cast("int")
    d = runs.withColumn("channel", F.explode(F.array(F.lit("doc"), F.lit("email"))))
    d = d.withColumn("copies", F.when((pn + wk) % 5 == 0, F.lit(2)).otherwise(F.lit(1)))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    ok = ~(((pn + wk) % 4 == 1) & (F.col("channel") == "email"))
    return d.select(*KEYS, "run_id", "channel",
                    F.when(ok, F.concat_ws(":", "channel", "run_id", F.col("copy").cast("string")))
                     .alias("delivery_id"),
                    F.when(pn % 3 == 2, F.lit(2)).otherwise(F.lit(1)).alias("attempts"))


@register("duplicate_deliveries")
def q_duplicate_deliveries(spark, sf_dir):
    return A.duplicate_deliveries(_deliveries(spark, sf_dir))


@register("delivery_success")
def q_delivery_success(spark, sf_dir):
    return A.delivery_success(_deliveries(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 6))


@register("label_agreement")
def q_label_agreement(spark, sf_dir):
    c = grouped(spark, sf_dir).withColumn("doc_id", F.col("review_id").cast("long"))
    lab = D.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return A.label_agreement(c, lab, "doc_id", by=["product_id"]).withColumn("purity", F.round("purity", 6))


@register("human_rating_means")
def q_human_rating_means(spark, sf_dir):
    lab = D.table(spark, sf_dir, "labels")
    r = D.reviews(spark, sf_dir, with_order=False).withColumn("doc_id", F.col("review_id").cast("long"))
    ratings = r.join(lab, "doc_id").select(*KEYS, (F.lit(1) + F.col("quality") * 3 + F.col("toxic")).alias("coherence"),
                                           (F.col("toxic") == 0).alias("useful"))
    m = A.human_rating_means(ratings)
    return m.select(*KEYS, F.round("coherence", 6).alias("coherence"),
                    F.round("actionability", 6).alias("actionability"), "ratings")


# ------------------------------------------------------------------------------------------------
# W1-W6, D1
# ------------------------------------------------------------------------------------------------
@register("top_clusters")
def q_top_clusters(spark, sf_dir):
    return W.top_clusters(A.cluster_sizes(grouped(spark, sf_dir)), 2).select(*KEYS, "rank", "cluster_id", "size")


@register("top_terms")
def q_top_terms(spark, sf_dir):
    return W.top_terms(A.term_counts(grouped(spark, sf_dir)), 10).select(
        *KEYS, "cluster_id", "term_rank", "word", "count")


@register("sample_first")
def q_sample_first(spark, sf_dir):
    return W.sample_first(grouped(spark, sf_dir), 3).select(*KEYS, "cluster_id", "pos", "review_id")


@register("newest_n")
def q_newest_n(spark, sf_dir):
    return W.newest_n(D.reviews(spark, sf_dir, with_order=False), 5).select(*KEYS, "recency", "review_id")


@register("take_until_older")
def q_take_until_older(spark, sf_dir):
    # source order is by store, then id (not by time), so the first old row cuts each key
    r = D.reviews(spark, sf_dir, with_order=False).withColumn(
        "ord", F.struct(F.col("source"), F.col("review_id")))
    weekly = r.withColumn("_cut", F.expr("date_trunc('WEEK', review_ts) + INTERVAL 3 DAYS"))
    return W.take_until_older(weekly, F.col("_cut")).select(*KEYS, "review_id")


def _stored_reviews(spark, sf_dir) -> DataFrame:
    """Review log with re-inserted copies: a forced re-run of week 4 stored its reviews again."""
    r = D.reviews(spark, sf_dir, with_order=False)
    first = r.withColumn("scraped_at", F.expr("review_ts + INTERVAL 1 HOUR")).withColumn("run", F.lit(1))
    again = (r.where(F.col("iso_week") == "2024-W04")
              .withColumn("scraped_at", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
              .withColumn("rating", F.lit(5)).withColumn("run", F.lit(2)))
    return first.unionByName(again)


@register("dedup_reviews")
def q_dedup_reviews(spark, sf_dir):
    return W.dedup_reviews(_stored_reviews(spark, sf_dir)).select("source", "review_id", "rating", "run")


# ------------------------------------------------------------------------------------------------
# Model responses (T2 input): one per top cluster, shaped by a fixed rule on the data so every
# response shape is exercised: clean JSON, JSON inside prose, an idea without description, a
# two-character name, missing keys, and no JSON at all.
# ------------------------------------------------------------------------------------------------
from themelens.operators import joins as J  # noqa: E402
from themelens.operators import themes as Th  # noqa: E402


def _js(c):
    """A JSON string literal for ``c``."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def grouped_staged(spark, sf_dir) -> DataFrame:
    """``grouped`` written once to the checkpoint folder, for queries that read it several times
    (responses, their grounding and the top clusters), so the scan and the regexes run once."""
    from themelens.session import stage
    return stage(grouped(spark, sf_dir), "grouped")


def top_of_grouped(spark, sf_dir, g: DataFrame | None = None) -> DataFrame:
    g = g if g is not None else grouped(spark, sf_dir)
    return W.top_clusters(A.cluster_sizes(g), C.TOP_THEMES)


def responses(spark, sf_dir, g: DataFrame | None = None) -> DataFrame:
    g = g if g is not None else grouped(spark, sf_dir)
    top = W.top_clusters(A.cluster_sizes(g), C.TOP_THEMES)
    t = top.join(Th.first_reviews(g), [*KEYS, "cluster_id"])
    # a quote that only the last review of the cluster holds, and one that many hold
    last = g.groupBy(*KEYS, "cluster_id").agg(F.max_by("content", F.col("ord")).alias("last_content"))
    t = t.join(last, [*KEYS, "cluster_id"])
    q4 = _js(F.substring(T.normalise_whitespace("last_content"), 3, 45))
    q5 = _js(F.lit("er"))
    fn = T.normalise_whitespace("first_content")
    q1 = _js(F.lower(F.substring(fn, 1, 40)))
    q2 = _js(F.replace(F.substring(fn, 5, 30), F.lit(" "), F.lit("  ")))
    q3 = _js(F.lit("zzqx is not a quote"))
    name = _js(F.concat(F.lit("Theme "), F.col("product_id"), F.lit(" "), F.col("rank").cast("string")))
    summary = _js(F.lit("Users report this. It matters."))
    obj = F.concat(F.lit('{"title": '), _js(F.concat(F.lit("Fix "), F.col("product_id"))),
                   F.lit(', "description": '), _js(F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))),
                   F.lit("}"))
    clean = F.concat(F.lit('{"name": '), name, F.lit(', "summary": '), summary, F.lit(', "quotes": ['),
                     q4, F.lit(", "), q1, F.lit(", "), q2, F.lit(", "), q3, F.lit(", "), q5, F.lit('], "action_ideas": ['), obj,
                     F.lit(', "Plain idea"]}'))
    variant = (F.col("rank") + F.substring("product_id", 4, 4).cast("int")) % 6
    resp = (F.when(variant == 0, clean)
             .when(variant == 1, F.concat(F.lit("Sure, here it is:\n"), clean, F.lit("\nThanks.")))
             .when(variant == 2, F.concat(F.lit('{"name": '), name, F.lit(', "summary": '), summary,
                                          F.lit(', "quotes": ['), q1, F.lit('], "action_ideas": [{"title": "Only title"}]}')))
             .when(variant == 3, F.concat(F.lit('{"name": "ab", "summary": '), summary, F.lit(', "quotes": ['),
                                          q2, F.lit('], "action_ideas": []}')))
             .when(variant == 4, F.concat(F.lit('{"name": '), name, F.lit("}")))
             .otherwise(F.lit("I cannot answer that.")))
    pt = (F.length("first_content") % 1000).cast("int")
    ct = (F.lit(50) + F.col("rank")).cast("int")
    return t.select(*KEYS, "cluster_id", "rank", resp.alias("response"), pt.alias("prompt_tokens"),
                    ct.alias("completion_tokens"), (pt * 0.000001 + ct * 0.000002).alias("cost"))


def _flat_themes(t: DataFrame) -> DataFrame:
    return t.select(
        *KEYS, "cluster_id", "rank", "name", "summary", "review_count",
        F.size("quotes").alias("n_quotes"),
        F.array_join(F.transform("quotes", lambda q: F.concat_ws("@", q["text"], q["source_review_id"])), " | ")
        .alias("quotes"),
        F.array_join(F.transform("action_ideas", lambda a: F.concat_ws(": ", a["title"], a["description"])), " | ")
        .alias("ideas"))


@register("parse_theme_responses")
def q_parse_theme_responses(spark, sf_dir):
    g = grouped_staged(spark, sf_dir)
    t = Th.themes_from_responses(responses(spark, sf_dir, g), g, top_of_grouped(spark, sf_dir, g))
    return _flat_themes(t)


@register("mixed_themes")
def q_mixed_themes(spark, sf_dir):
    """Every fourth call failed: those clusters get a local theme."""
    g = grouped_staged(spark, sf_dir)
    r = responses(spark, sf_dir, g).where((F.col("rank") * 3 + F.substring("product_id", 4, 4).cast("int")) % 4 != 0)
    return _flat_themes(Th.themes_with_fallback(r, g, top_of_grouped(spark, sf_dir, g)))


@register("valid_themes")
def q_valid_themes(spark, sf_dir):
    parsed, _ = Th.parse_theme_responses(responses(spark, sf_dir, grouped_staged(spark, sf_dir)))
    ok = Fl.valid_themes(parsed.where(F.col("summary").isNotNull()))
    return ok.select(*KEYS, "cluster_id", "name", F.size("action_ideas").alias("n_ideas"))


def _proposed_quotes(spark, sf_dir, g: DataFrame) -> DataFrame:
    parsed, _ = Th.parse_theme_responses(responses(spark, sf_dir, g))
    return parsed.select(*KEYS, "cluster_id", F.posexplode("proposed_quotes").alias("quote_idx", "quote"))


@register("ground_quotes")
def q_ground_quotes(spark, sf_dir):
    g = grouped_staged(spark, sf_dir)
    return J.ground_quotes(_proposed_quotes(spark, sf_dir, g), g)


@register("ground_quotes_loose")
def q_ground_quotes_loose(spark, sf_dir):
    g = grouped_staged(spark, sf_dir)
    return J.ground_quotes_loose(_proposed_quotes(spark, sf_dir, g), g)


@register("quote_veracity")
def q_quote_veracity(spark, sf_dir):
    g = grouped_staged(spark, sf_dir)
    flags = J.ground_quotes(_proposed_quotes(spark, sf_dir, g), g, keep_unmatched=True)
    return A.quote_veracity(flags).withColumn("veracity", F.round("veracity", 6))


@register("usage_totals")
def q_usage_totals(spark, sf_dir):
    u = A.usage_totals(responses(spark, sf_dir, grouped_staged(spark, sf_dir)), cap=0.0015)
    return u.withColumn("total_cost", F.round("total_cost", 9))


@register("theme_prompts")
def q_theme_prompts(spark, sf_dir):
    g = grouped_staged(spark, sf_dir)
    return Th.theme_prompts(g, top_of_grouped(spark, sf_dir, g), C.PROMPT_REVIEWS)


@register("fallback_theme")
def q_fallback_theme(spark, sf_dir):
    g = grouped_staged(spark, sf_dir)
    themes = Th.themes_from_responses(responses(spark, sf_dir, g), g, top_of_grouped(spark, sf_dir, g))
    return _flat_themes(Th.fallback_theme(A.total_reviews(g), themes))


@register("name_themes")
def q_name_themes(spark, sf_dir):
    g = grouped_staged(spark, sf_dir)
    top = W.top_clusters(A.cluster_sizes(g), C.TOP_THEMES)
    terms = W.top_terms(A.term_counts(g), C.TOP_TERMS)
    n = Th.name_themes(top, terms)
    return n.select(*KEYS, "rank", "cluster_id", "name", "primary", F.array_join("words", ",").alias("words"))


@register("describe_themes")
def q_describe_themes(spark, sf_dir):
    return _flat_themes(Th.local_themes(grouped_staged(spark, sf_dir)))


@register("theme_lint")
def q_theme_lint(spark, sf_dir):
    t = Th.theme_lint(Th.local_themes(grouped_staged(spark, sf_dir)))
    return t.select(*KEYS, "cluster_id", "one_word_name", "banned_words", "not_two_sentences", "bad_name_length")


# ------------------------------------------------------------------------------------------------
# J1, J4-J6
# ------------------------------------------------------------------------------------------------
@register("attach_labels")
def q_attach_labels(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    lab = grouped(spark, sf_dir).select(*KEYS, "review_id", "source", "cluster_id")
    return J.attach_labels(r, lab).select(*KEYS, "review_id", "source", "rating", "cluster_id")


@register("drop_stop_words")
def q_drop_stop_words(spark, sf_dir):
    toks = A.token_rows(D.reviews(spark, sf_dir, with_order=False).select("review_id", "product_id", "iso_week", "content"),
                        keep=("review_id",))
    kept = J.drop_stop_words(toks)
    return kept.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_kept"), F.min("tok_pos").alias("first_kept"))


@register("map_functional")
def q_map_functional(spark, sf_dir):
    w = D.reviews(spark, sf_dir, with_order=False).select(F.explode(T.tokens("content")).alias("word")).distinct()
    return J.map_functional(w).select("word", "title", "candidate")


# ------------------------------------------------------------------------------------------------
# P1 and what reads its summaries
# ------------------------------------------------------------------------------------------------
from themelens.operators import reports as R  # noqa: E402
from themelens.plans import weekly as P  # noqa: E402


def summaries(spark, sf_dir) -> DataFrame:
    return P.run_weekly(D.reviews(spark, sf_dir), groups=DRIVER_GROUPS, generated_at=AS_OF)


def _flat_summary(s: DataFrame) -> DataFrame:
    return s.select("run_id", *KEYS, "data_window", "total_reviews_analyzed",
                    F.size("top_themes").alias("n_themes"),
                    F.array_join(F.transform("top_themes", lambda t: t["name"]), " | ").alias("theme_names"),
                    F.array_join(F.transform("top_themes", lambda t: t["review_count"].cast("string")), ",")
                    .alias("theme_counts"),
                    F.col("metrics.total_cost").alias("total_cost"), "generated_at")


@register("assemble_summary")
def q_assemble_summary(spark, sf_dir):
    return _flat_summary(summaries(spark, sf_dir))


@register("weekly_run")
def q_weekly_run(spark, sf_dir):
    """P1 with the idempotency gate: keys already COMPLETED are skipped."""
    s = P.run_weekly(D.reviews(spark, sf_dir), requested=_keys(spark, sf_dir), runs=_runs(spark, sf_dir),
                     groups=DRIVER_GROUPS, generated_at=AS_OF)
    return R.report_markdown(s)


@register("weekly_job")
def q_weekly_job(spark, sf_dir):
    """The main path with real clusters: density clusters of the stored vectors. Every product asks for one
    more week that has no reviews (EMPTY); every 17th review has lost its text (a reject)."""
    r = D.reviews(spark, sf_dir, with_order=False)
    r = r.withColumn("content", F.when(F.col("review_id").cast("long") % 17 == 0, F.lit(None)).otherwise(F.col("content")))
    v = D.vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("review_id"), "vec")
    keys = _keys(spark, sf_dir)
    wanted = keys.unionByName(keys.select("product_id").distinct().withColumn("iso_week", F.lit("2024-W40")))
    paths = P.weekly_job(r, v, wanted, _runs(spark, sf_dir), St.scratch(spark, "weekly-job"), eps=DENSITY_EPS_WEEK,
                         generated_at=AS_OF, groups=DRIVER_GROUPS)
    runs = spark.read.parquet(paths["runs"]).select(*KEYS, "run_id", "status")
    s = Tb.load_summaries(spark, paths["summaries"]).select(
        *KEYS, F.get_json_object("summary_json", "$.total_reviews_analyzed").cast("long").alias("total"),
        F.get_json_object("summary_json", "$.top_themes[*].name").alias("names"),
        F.get_json_object("summary_json", "$.top_themes[*].review_count").alias("counts"))
    # one match is a bare value, several are a list
    flat = lambda c: F.regexp_replace(F.col(c), r'[\[\]"]', "").alias(c)
    rejects = spark.read.parquet(paths["rejects"]).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rejects"))
    return (runs.join(s.select(*KEYS, "total", flat("names"), flat("counts")), list(KEYS), "left")
            .join(rejects, list(KEYS), "left").withColumn("rejects", F.coalesce("rejects", F.lit(0))))


@register("theme_distribution")
def q_theme_distribution(spark, sf_dir):
    d = A.theme_distribution(summaries(spark, sf_dir))
    return d.withColumn("share", F.round("share", 6))


def _summary_history(spark, sf_dir) -> DataFrame:
    """Two generations of summaries: the first run, and a forced re-run of week 4 a day later."""
    s = summaries(spark, sf_dir)
    again = (s.where(F.col("iso_week") == "2024-W04")
              .withColumn("generated_at", F.col("generated_at") + F.expr("INTERVAL 1 DAY")))
    return s.unionByName(again)


@register("latest_summary")
def q_latest_summary(spark, sf_dir):
    return _flat_summary(W.latest_summary(_summary_history(spark, sf_dir)))


@register("report_markdown")
def q_report_markdown(spark, sf_dir):
    return R.report_markdown(summaries(spark, sf_dir))


@register("report_lines")
def q_report_lines(spark, sf_dir):
    return R.report_lines(summaries(spark, sf_dir))


@register("email_teasers")
def q_email_teasers(spark, sf_dir):
    return R.email_teasers(summaries(spark, sf_dir))


@register("delivery_outbox")
def q_delivery_outbox(spark, sf_dir):
    return R.delivery_outbox(summaries(spark, sf_dir), _deliveries(spark, sf_dir))


@register("run_history")
def q_run_history(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    stored = D.reviews(spark, sf_dir, with_order=False).withColumn("run_id", T.report_anchor("product_id", "iso_week"))
    return J.run_history(runs, stored, _summary_history(spark, sf_dir)).select(
        "run_id", *KEYS, "status", "reviews", "summaries", "last_summary_at")


@register("keyword_fallback")
def q_keyword_fallback(spark, sf_dir):
    from themelens.operators.clusters import keyword_fallback
    c = clustered(spark, sf_dir)
    # weeks 1-2 keep their clusters; weeks 3-4 lost theirs (everything noise) and fall back
    c = c.withColumn("cluster_id", F.when(F.col("iso_week") >= "2024-W03", F.lit(-1)).otherwise(F.col("cluster_id")))
    fb = keyword_fallback(c, groups=DRIVER_GROUPS)
    return fb.groupBy(*KEYS, "cluster_id").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------
# J7, M1-M7, U1 on the embeddings table (one whole-table group: blocks split it)
# ------------------------------------------------------------------------------------------------
from themelens.operators import clusters as M  # noqa: E402
from themelens.operators import hierarchy as H  # noqa: E402
from themelens.operators import vectors as V  # noqa: E402

PAIR_THRESHOLD = 0.40
DENSITY_EPS = 0.60
DENSITY_EPS_WEEK = 0.75
MERGE_THRESHOLD = 0.20
# block size for the registered vector queries: small enough that even sf0.01 spreads over several
# block pairs (so the blocked path is what is checked), large enough to keep tasks efficient
VEC_BLOCK = 128


@register("similar_pairs")
def q_similar_pairs(spark, sf_dir):
    p = V.similar_pairs(D.vectors(spark, sf_dir), PAIR_THRESHOLD, block_size=VEC_BLOCK)
    return p.select("id_a", "id_b", F.round("cosine", 6).alias("cosine"))


@register("nearest_neighbours")
def q_nearest_neighbours(spark, sf_dir):
    n = V.nearest_neighbours(D.vectors(spark, sf_dir), 3, block_size=VEC_BLOCK)
    return n.select("id", "nbr", "nn_rank", F.round("cosine", 6).alias("cosine"))


@register("density_cluster")
def q_density_cluster(spark, sf_dir):
    """Reviews clustered inside their product-week by the vectors of the same id (string review ids)."""
    v = D.vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("review_id"), "vec")
    r = D.reviews(spark, sf_dir, with_order=False).select(*KEYS, "review_id").join(v, "review_id")
    return M.density_cluster(r, DENSITY_EPS_WEEK, min_cluster_size=2, min_samples=1, id_col="review_id", keys=KEYS,
                             block_size=VEC_BLOCK)


@register("density_cluster_table")
def q_density_cluster_table(spark, sf_dir):
    """The whole vector table as one group: the blocked path."""
    return M.density_cluster(D.vectors(spark, sf_dir), DENSITY_EPS, min_cluster_size=3, min_samples=2,
                             block_size=VEC_BLOCK)


def _week_vectors(spark, sf_dir):
    v = D.vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("review_id"), "vec")
    return D.reviews(spark, sf_dir, with_order=False).select(*KEYS, "review_id").join(v, "review_id")


@register("spanning_forest")
def q_spanning_forest(spark, sf_dir):
    """Weight of each product-week's minimum spanning tree of mutual reachability (two samples)."""
    rows = _week_vectors(spark, sf_dir)
    core = H.core_distances(rows, 2, "review_id", "vec", KEYS, VEC_BLOCK)
    forest = H.spanning_forest(V.spanning_edges(rows, core, "review_id", "vec", KEYS, block_size=8), KEYS)
    return forest.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("w"), 6).alias("weight"))


@register("density_hierarchy")
def q_density_hierarchy(spark, sf_dir):
    """Clusters of the hierarchy, without a threshold, in every product-week."""
    return M.density_cluster(_week_vectors(spark, sf_dir), min_cluster_size=2, id_col="review_id", keys=KEYS, block_size=VEC_BLOCK)


@register("density_hierarchy_table")
def q_density_hierarchy_table(spark, sf_dir):
    """The whole vector table as one group, by spanning edges of its block pairs."""
    return M.density_cluster(D.vectors(spark, sf_dir), min_cluster_size=3, min_samples=2, block_size=VEC_BLOCK)


@register("merge_similar_clusters")
def q_merge_similar_clusters(spark, sf_dir):
    v = D.vectors(spark, sf_dir).withColumnRenamed("label", "cluster_id")
    return M.merge_similar_clusters(v, MERGE_THRESHOLD)


@register("cluster_representatives")
def q_cluster_representatives(spark, sf_dir):
    v = D.vectors(spark, sf_dir).withColumnRenamed("label", "cluster_id")
    r = M.cluster_representatives(v, 3)
    return r.select("cluster_id", "vec_id", "rep_rank", F.round("cosine", 6).alias("cosine"))


@register("embed_texts")
def q_embed_texts(spark, sf_dir):
    e = V.embed_texts(D.reviews(spark, sf_dir, with_order=False), num_features=256)
    return e.select("review_id", F.size("vec").alias("dims"),
                    F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@register("embed_texts_versioned")
def q_embed_texts_versioned(spark, sf_dir):
    """Two weekly runs: the second counts only its own week and embeds all reviews with the first run's version."""
    reviews = D.reviews(spark, sf_dir, with_order=False)
    path = St.scratch(spark, "document-counts")
    last = reviews.agg(F.max("iso_week")).first()[0]
    for part in (reviews.where(F.col("iso_week") < last), reviews.where(F.col("iso_week") == last)):
        Tb.write_document_counts(V.document_counts(part, num_features=256), path)
    counts = Tb.load_document_counts(spark, path)
    before = counts.where(F.col("iso_week") < last).agg(F.max("iso_week").alias("w"), F.sum("n_docs").alias("n")).first()
    e = V.embed_with_counts(reviews, counts, before["w"], dense=True)
    return e.select("review_id", F.size("vec").alias("dims"), "vec_version", F.lit(before["n"]).alias("n_docs"),
                    F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@register("reduce_dims")
def q_reduce_dims(spark, sf_dir):
    r = V.reduce_dims(D.vectors(spark, sf_dir), k=5)
    """What makes them principal components: any two are uncorrelated, and the variances fall."""
    x = [F.col("vec_k")[i] for i in range(5)]
    stats = r.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(x[i]).alias(f"v{i}") for i in range(5)],
                  *[F.corr(x[i], x[j]).alias(f"c{i}{j}") for i in range(5) for j in range(i + 1, 5)])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.round(F.abs(F.col(f"c{i}{j}")), 6).alias("correlation"),
                              (F.col(f"v{i}") >= F.col(f"v{j}")).alias("falls")) for i in range(5) for j in range(i + 1, 5)])
    return stats.select("n", F.explode(rows).alias("r")).select("n", "r.*")


@register("kmeans_fallback")
def q_kmeans_fallback(spark, sf_dir):
    """Vectors in ten groups by their label; groups 0 to 4 are noise throughout, the others keep their ids.
    The labels of a noise group are 0 to k - 1 and none is empty."""
    v = D.vectors(spark, sf_dir).withColumn("cluster_id", F.when(F.col("label") < 5, F.lit(-1)).otherwise((F.col("vec_id") % 3).cast("int")))
    out = M.kmeans_fallback(v, k=3, keys=("label",))
    return out.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cluster_id").alias("n_clusters"), F.min("cluster_id").alias("lowest"),
        F.max("cluster_id").alias("highest"),
        F.sum((F.col("cluster_id") == F.col("vec_id") % 3).cast("int") * (F.col("label") >= 5).cast("int")).alias("kept"))


def _letter_counts(texts):
    """A small user embedder: letter frequencies a-z, for the U1 hook."""
    out = []
    for t in texts:
        low = t.lower()
        out.append([float(low.count(ch)) for ch in "abcdefghijklmnopqrstuvwxyz"])
    return out


@register("embed_with")
def q_embed_with(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False).select("review_id", "content")
    e = V.embed_with(r, _letter_counts)
    return e.select("review_id", F.size("vec").alias("dims"), *[
        F.col("vec")[i].cast("long").alias(f"{c}_count") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz") if c in "aez"])


# ------------------------------------------------------------------------------------------------
# SRC1-SRC7: landed exports and stored tables, written by Spark from the driver's tables into the
# shared checkpoint folder, then read back through the operators.
# ------------------------------------------------------------------------------------------------
from themelens.sources import feeds as Src  # noqa: E402
from themelens.sources import tables as Tb  # noqa: E402
from themelens.streaming import reviews as St  # noqa: E402


def _iso_text(ts: str = "review_ts"):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def land_app_feed(spark, sf_dir) -> str:
    """App-store reviews as feed pages of at most 50 entries (JSON lines), with the feed's quirks:
    entries without author, dates with and without offsets, bad and missing dates, bad ratings."""
    r = D.reviews(spark, sf_dir, with_order=False).where(F.col("source") == "app_store")
    doc = F.col("review_id").cast("long")
    updated = (F.when(doc % 5 == 0, F.lit("bad date")).when(doc % 5 == 1, F.concat(_iso_text(), F.lit("-07:00")))
                .when(doc % 5 == 2, F.concat(_iso_text(), F.lit("Z"))).otherwise(_iso_text()))
    lab = lambda c: F.struct(c.alias("label"))
    entry = F.struct(
        lab(F.col("review_id")).alias("id"),
        F.when(doc % 13 == 0, F.lit(None)).otherwise(F.struct(lab(F.col("user_name")).alias("name"))).alias("author"),
        lab(F.col("content")).alias("content"),
        lab(F.when(doc % 7 == 0, F.lit("five")).otherwise(F.col("rating").cast("string"))).alias("im:rating"),
        F.when(doc % 5 == 3, F.lit(None)).otherwise(lab(updated)).alias("updated"))
    pages = r.groupBy(F.floor(doc / 200).alias("page")).agg(F.collect_list(entry).alias("entry"))
    path = St.scratch(spark, "landed-app")
    pages.select(F.to_json(F.struct(F.struct("entry").alias("feed"))).alias("value")).write.text(path)
    return path


def land_play_reviews(spark, sf_dir) -> str:
    r = D.reviews(spark, sf_dir, with_order=False).where(F.col("source") == "google_play")
    path = St.scratch(spark, "landed-play")
    r.select(F.col("review_id").alias("reviewId"), F.col("user_name").alias("userName"),
             F.col("rating").alias("score"), "content", _iso_text().alias("at")).write.json(path)
    return path


def _canonical_out(df: DataFrame) -> DataFrame:
    return df.select("source", "review_id", "user_name", "rating", "content",
                     F.unix_micros("review_ts").alias("review_us"))


@register("read_app_store_feed")
def q_read_app_store_feed(spark, sf_dir):
    return _canonical_out(Src.read_app_store_feed(spark, land_app_feed(spark, sf_dir), AS_OF, multi_line=False))


@register("app_store_feed_rejects")
def q_app_store_feed_rejects(spark, sf_dir):
    """A cut-off copy of every page lands beside it; the pages are read, the copies are rejects."""
    good = spark.read.text(land_app_feed(spark, sf_dir))
    path = St.scratch(spark, "landed-app-bad")
    # a fixed marker after the cut keeps the record recognisable
    cut = F.concat(F.regexp_extract("value", r'"id":\{"label":"([0-9]+)"', 1), F.lit(" cut off {"))
    good.unionByName(good.select(cut.alias("value"))).write.text(path)
    bad = Src.app_store_feed_rejects(spark, path, multi_line=False)
    page = F.floor(F.regexp_extract("record", "^([0-9]+) cut off", 1).cast("long") / 200).cast("string")
    return bad.select(page.alias("page"), "reason")


@register("read_play_reviews")
def q_read_play_reviews(spark, sf_dir):
    return _canonical_out(Src.read_play_reviews(spark, land_play_reviews(spark, sf_dir)))


@register("unify_reviews")
def q_unify_reviews(spark, sf_dir):
    u = Src.unify_reviews(Src.read_app_store_feed(spark, land_app_feed(spark, sf_dir), AS_OF, multi_line=False),
                          Src.read_play_reviews(spark, land_play_reviews(spark, sf_dir)))
    return u.select("source", "review_id", "rating")


@register("append_reviews")
def q_append_reviews(spark, sf_dir):
    path = St.scratch(spark, "reviews-raw")
    # numeric product ids with leading zeros, as the stores have them
    s = scrubbed(spark, sf_dir).drop("ord").withColumn("product_id", F.concat(F.lit("00"), F.substring("product_id", 4, 9)))
    Tb.append_reviews(s.withColumn("run", F.lit(1)), path)
    Tb.append_reviews(s.where(F.col("iso_week") == "2024-W04").withColumn("run", F.lit(2)), path)
    stored = Tb.load_reviews(spark, path, "run int")
    return stored.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("last_run"))


@register("upsert_runs")
def q_upsert_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    # failed runs change twice, and every key gets a run of a new week without a status
    failed = runs.where(F.col("status") == "FAILED").select(*KEYS, F.lit("COMPLETED").alias("status"))
    again = failed.withColumn("status", F.lit("ACTIVE"))
    new = runs.select("product_id", F.concat(F.lit("2025"), F.substring("iso_week", 5, 4)).alias("iso_week"),
                      F.lit(None).cast("string").alias("status"))
    snap = Tb.upsert_runs(runs, failed.unionByName(again).unionByName(new), St.scratch(spark, "runs"))
    return spark.read.parquet(snap)


@register("append_summaries")
def q_append_summaries(spark, sf_dir):
    path = St.scratch(spark, "summaries")
    Tb.append_summaries(summaries(spark, sf_dir), path)
    s = Tb.load_summaries(spark, path)
    return s.select("run_id", *KEYS,
                    F.get_json_object("summary_json", "$.total_reviews_analyzed").cast("long").alias("total"),
                    F.json_array_length(F.get_json_object("summary_json", "$.top_themes")).alias("n_themes"),
                    F.get_json_object("summary_json", "$.top_themes[0].name").alias("top_theme"))


@register("write_reports")
def q_write_reports(spark, sf_dir):
    path = St.scratch(spark, "reports")
    Tb.write_reports(R.report_markdown(summaries(spark, sf_dir)), path)
    return Tb.load_reports(spark, path)


# ------------------------------------------------------------------------------------------------
# ST1, ST2: drained with availableNow, then the sink is compared
# ------------------------------------------------------------------------------------------------
@register("stream_reviews")
def q_stream_reviews(spark, sf_dir):
    r = D.reviews(spark, sf_dir, with_order=False)
    landing = St.scratch(spark, "landing-reviews")
    # four parts land one after another, one of them twice; a micro-batch takes about a part's files
    late = F.pmod(F.dayofyear("review_ts"), F.lit(4))
    for part in (3, 2, 1, 0, 3):
        r.where(late == part).repartitionByRange(F.desc("review_ts")).write.mode("append").parquet(landing)
    files = len(spark.read.schema(r.schema).parquet(landing).inputFiles())
    sink = St.scratch(spark, "sink-reviews")
    q = St.stream_reviews(spark, landing, r.schema, sink, St.scratch(spark, "ckpt-reviews"), max_files=max(1, files // 5))
    q.awaitTermination()
    out = St.load_stream(spark, sink, r.schema)
    return out.select("product_id", "iso_week", "source", "review_id", "content")


@register("weekly_counts_stream")
def q_weekly_counts_stream(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    landing = St.scratch(spark, "landing-events")
    # in order of time: one file per part of the time range, as many as Spark makes
    e.repartitionByRange("ts").write.parquet(landing)
    table = St.scratch(spark, "weekly-counts")
    q = St.weekly_counts_stream(spark, landing, e.schema, table, St.scratch(spark, "ckpt-weekly"))
    q.awaitTermination()
    t = spark.read.parquet(table)
    return t.select("week_start", "event_type", "n", F.round("avg_value", 6).alias("avg_value"))


# ------------------------------------------------------------------------------------------------
# P2
# ------------------------------------------------------------------------------------------------
BACKFILL = ("2024-W02", "2024-W04", 4)


@register("backfill")
def q_backfill(spark, sf_dir):
    """The roll-up plan with the gate: report weeks whose run is completed are not done again."""
    start, end, weeks = BACKFILL
    r = D.reviews(spark, sf_dir)
    wanted = P.week_keys(r.select("product_id").distinct(), start, end).select(*KEYS)
    s = P.backfill(r, start, end, weeks=weeks, groups=DRIVER_GROUPS, generated_at=AS_OF, requested=wanted,
                   runs=_runs(spark, sf_dir))
    return _flat_summary(s)


@register("backfill_clustered")
def q_backfill_clustered(spark, sf_dir):
    """Real clusters in every report window: the stored vectors, compared once for all windows."""
    start, end, weeks = BACKFILL
    r = D.reviews(spark, sf_dir)
    v = D.vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("review_id"), "vec")
    wanted = P.week_keys(r.select("product_id").distinct(), start, end).select(*KEYS)
    s = P.backfill(r, start, end, weeks=weeks, vectors=v, eps=DENSITY_EPS_WEEK, groups=DRIVER_GROUPS,
                   generated_at=AS_OF, requested=wanted, runs=_runs(spark, sf_dir))
    return _flat_summary(s)


@register("review_rejects")
def q_review_rejects(spark, sf_dir):
    """Every 17th review has lost its text: it is a reject, not a silent loss."""
    r = D.reviews(spark, sf_dir)
    lost = r.withColumn("content", F.when(F.col("review_id").cast("long") % 17 == 0, F.lit(None)).otherwise(F.col("content")))
    return P.review_rejects(lost)


@register("response_rejects")
def q_response_rejects(spark, sf_dir):
    """Model responses without a JSON object."""
    return Th.parse_theme_responses(responses(spark, sf_dir, grouped_staged(spark, sf_dir)))[1]
