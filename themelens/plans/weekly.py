"""P1 ``run_weekly`` and P2 ``backfill``: the whole weekly job for every requested product-week at once.
A few small tables and the scrubbed reviews are written while the plan is built (size checks, the shared
review table); the rest is one plan whose shuffles are on the product-week, plus the cluster for themes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens import KEYS
from themelens import constants as C
from themelens.functions.text import iso_week, keyword_group, scrub_pii
from themelens.operators.aggregates import assemble_summary, counted_sizes, needs_fallback, review_age, word_counts
from themelens.operators.clusters import density_cluster, density_cluster_windows, keyword_fallback
from themelens.operators.filters import drop_noise, noise_flags, review_window, runs_to_do
from themelens.operators.themes import fallback_theme, local_themes, themes_from_counts
from themelens.operators.windows import dedup_reviews, newest_n, top_clusters
from themelens.session import checked_broadcast, stage
from themelens.sources.tables import append_reviews, append_summaries, load_reviews, upsert_runs
from themelens.sources.testdata import with_ord


def split_rejects(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with null content cannot be stored (content is NOT NULL): they go to a rejects table
    instead of failing the run."""
    ok = F.col("content").isNotNull()
    return reviews.where(ok), reviews.where(~ok)


def review_rejects(reviews: DataFrame) -> DataFrame:
    """The rejects table of P1 and P2: reviews that cannot be stored, with the reason."""
    return split_rejects(reviews)[1].select("product_id", "iso_week", "source", "review_id",
                                            F.lit("content is null").alias("reason"))


def window_of(ts: str = "review_ts") -> Column:
    """Aggregate: ``first date to last date``."""
    return F.concat(F.date_format(F.min(ts), "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.max(ts), "yyyy-MM-dd"))


def run_weekly(reviews: DataFrame, *, requested: DataFrame | None = None, runs: DataFrame | None = None,
               force: bool = False, cluster_fn: Callable[[DataFrame], DataFrame] | None = None,
               groups=C.DEFAULT_KEYWORD_GROUPS, n_themes: int = C.TOP_THEMES,
               generated_at: str | Column | None = None, keys=KEYS, materialize: bool = True) -> DataFrame:
    """F6 -> F7 -> S1 -> clustering (``cluster_fn``, default: none, everything noise) -> A8/M5
    -> F5 -> W1 -> T3/T4 -> F9 -> T5 -> A9. ``reviews`` must carry keys and ``ord`` and already be
    windowed (F1) and capped (W4) if the caller wants that. Returns one summary row per key."""
    if requested is not None:
        todo = runs_to_do(requested, runs, force, keys) if runs is not None else requested
        # the keys to run are usually few: broadcast them (after a size check) so the review text
        # is filtered where it is read instead of being shuffled to meet them
        todo = checked_broadcast(todo.select(*keys).distinct())
        reviews = reviews.join(todo, list(keys), "left_semi")                   # F7 on the way
    reviews, _ = split_rejects(reviews)
    scrubbed = reviews.withColumn("content", scrub_pii("content"))
    clustered = cluster_fn(scrubbed) if cluster_fn else scrubbed.withColumn("cluster_id", F.lit(-1))
    clustered = keyword_fallback(clustered, keys, groups)
    if materialize:
        # the stored review table: scrubbing and grouping run once; every later branch (sizes,
        # terms, first reviews, totals, windows) scans the Parquet copy and reads only its columns
        clustered = stage(clustered, "reviews-clustered")
    # one per-key aggregation: A3 totals, the data window and F5's noise flag
    per_key = clustered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_reviews"), window_of("review_ts").alias("data_window"),
        noise_flags(clustered, keys))
    themes = local_themes(drop_noise(clustered, keys, per_key), keys, n_themes)
    themes = themes.unionByName(fallback_theme(per_key, themes, keys))
    gen = F.lit(generated_at).cast("timestamp_ntz") if isinstance(generated_at, str) else generated_at
    return assemble_summary(themes, per_key.drop("_has_clusters"), keys,
                            data_window=F.col("data_window"), generated_at=gen)


def weekly_job(reviews: DataFrame, vectors: DataFrame, requested: DataFrame, runs: DataFrame, store: str, *,
               eps: float | None = None, min_cluster_size: int = 2, min_samples: int = 1, as_of=None, weeks: int = 4,
               cap: int | None = None, force: bool = False, generated_at: str, **report_args) -> dict[str, str]:
    """The main path as one job, on unified reviews (SRC3) and their vectors ``(review_id, vec)``:

    F6 the keys to do -> runs IN_PROGRESS (SRC5) -> D1, F1, F7, W4 (off by default) -> null texts to the
    rejects table -> S1 -> the review log (SRC4) -> M3 per product-week on the log's partitions of those
    keys -> J1 -> P1's second half (A8/M5, F5, themes, T5, A9) -> the summary log (SRC6) -> runs COMPLETED,
    or EMPTY for a requested key without reviews. Returns the paths of what it wrote under ``store``."""
    spark, root = reviews.sparkSession, store.rstrip("/")
    keys = list(KEYS)
    todo = stage(runs_to_do(requested, runs, force).select(*keys).distinct(), "todo")
    started = upsert_runs(runs, todo.withColumn("status", F.lit("IN_PROGRESS")), f"{root}/runs")
    r = dedup_reviews(reviews) if "scraped_at" in reviews.columns else reviews
    r = review_window(r, as_of, weeks) if as_of is not None else r
    r = r.join(checked_broadcast(todo), keys, "left_semi")
    r = newest_n(with_ord(r), cap).drop("ord") if cap else r
    good, _ = split_rejects(r)
    paths = {"reviews": f"{root}/reviews", "rejects": f"{root}/rejects", "summaries": f"{root}/summaries"}
    review_rejects(r).write.mode("append").parquet(paths["rejects"])
    stamped = good.withColumn("content", scrub_pii("content")).withColumn("scraped_at", F.lit(generated_at).cast("timestamp_ntz"))
    columns = ["source", "review_id", "user_name", "rating", "content", "review_ts", *keys, "scraped_at"]
    append_reviews(stamped.select(*columns), paths["reviews"])
    # read back only the partitions of the keys to do; a forced re-run inserts again, so the latest copy counts
    log = load_reviews(spark, paths["reviews"], "scraped_at timestamp_ntz").join(checked_broadcast(todo), keys, "left_semi")
    log = stage(with_ord(dedup_reviews(log).drop("scraped_at")), "log")
    points = log.select(*keys, "review_id").join(vectors, "review_id")
    labels = stage(density_cluster(points, eps, min_cluster_size, min_samples, "review_id", "vec", keys), "labels")

    def by_density(df: DataFrame) -> DataFrame:
        # a review without a vector is noise
        out = df.join(labels, [*keys, "review_id"], "left")
        return out.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))

    summaries = stage(run_weekly(log, cluster_fn=by_density, generated_at=generated_at, **report_args), "summaries")
    append_summaries(summaries, paths["summaries"])
    done = summaries.select(*keys, F.lit("COMPLETED").alias("status"))
    empty = todo.join(done, keys, "left_anti").withColumn("status", F.lit("EMPTY"))
    paths["runs"] = upsert_runs(spark.read.schema(runs.schema).parquet(started), done.unionByName(empty), f"{root}/runs")
    return paths


def monday_of(week: Column) -> Column:
    """Monday (a date) of an ISO week given as ``YYYY-Www`` text."""
    year = F.substring(week, 1, 4).cast("int")
    num = F.substring(week, 7, 2).cast("int")
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    week1 = F.date_sub(jan4, (F.dayofweek(jan4) + 5) % 7)          # Monday of ISO week 1
    return F.date_add(week1, (num - 1) * 7)


def week_keys(products: DataFrame, start_week: str, end_week: str) -> DataFrame:
    """ISO weeks from ``start_week`` to ``end_week`` (``YYYY-Www``) for each product: a ``sequence``
    of Mondays, exploded per product (no cross join)."""
    def monday(w: str) -> Column:
        year, week = int(w[:4]), int(w[6:])
        jan4 = F.make_date(F.lit(year), F.lit(1), F.lit(4))
        week1 = F.date_sub(jan4, (F.dayofweek(jan4) + 5) % 7)      # Monday of ISO week 1
        return F.date_add(week1, 7 * (week - 1))
    mondays = F.sequence(monday(start_week), monday(end_week), F.expr("INTERVAL 7 DAYS"))
    return products.select("product_id", F.explode(mondays).alias("week_start")).select(
        "product_id", iso_week(F.col("week_start").cast("timestamp_ntz")).alias("iso_week"),
        F.col("week_start").cast("timestamp_ntz").alias("week_start"))


def backfill(reviews: DataFrame, start_week: str, end_week: str, weeks: int = 4, rollup_min_weeks: int = 3,
             vectors: DataFrame | None = None, eps: float | None = None, min_cluster_size: int = 2, **run_args) -> DataFrame:
    """P1 for every ISO week in a range; each week's window is the ``weeks`` weeks ending with it.

    Without a clustering model (keyword groups), cluster statistics are additive, so the text is
    scrubbed, grouped and tokenised once per calendar week and the aggregated statistics are rolled
    up into every report window that contains the week: raw text is never copied per window.
    With ``vectors`` (``review_id``, ``vec``) reviews are clustered by density (M3, one sample, ``eps`` or the
    hierarchy). Clusters depend on the window's set of reviews, but vectors are compared once per product and
    text is scrubbed and tokenised once: windows get copies of ids, tree edges and tokens.
    With a ``cluster_fn`` (any other model) the clusters depend on the window's set of reviews, so each window gets its
    own copy of its reviews (F1 as a range join: equi on product and week bucket, then the bounds).

    The plans give the same result. The roll-up pays a second aggregation over the statistics, so
    it is used once a review would be copied into ``rollup_min_weeks`` or more windows (a 4-week
    window copies each review 4 times); for shorter windows copying is cheaper."""
    if vectors is not None:
        if run_args.get("cluster_fn") is not None:
            raise TypeError("vectors and cluster_fn exclude each other")
        return _backfill_by_vectors(reviews, vectors, start_week, end_week, weeks, eps, min_cluster_size, **run_args)
    if run_args.get("cluster_fn") is not None or weeks < rollup_min_weeks:
        return _backfill_by_copy(reviews, start_week, end_week, weeks, **run_args)
    known = {"keys", "groups", "n_themes", "generated_at", "requested", "runs", "force", "materialize", "cluster_fn"}
    if unknown := set(run_args) - known:
        raise TypeError(f"unknown arguments: {sorted(unknown)}")
    keys = list(run_args.get("keys", KEYS))
    groups = run_args.get("groups", C.DEFAULT_KEYWORD_GROUPS)
    n_themes = run_args.get("n_themes", C.TOP_THEMES)
    generated_at = run_args.get("generated_at")
    reviews, _ = split_rejects(reviews)
    weekly = (reviews.withColumn("content", scrub_pii("content"))
                     .withColumn("cluster_id", keyword_group("content", groups))
                     .withColumn("cal_week", iso_week("review_ts")))
    if run_args.get("materialize", True):
        weekly = stage(weekly, "reviews-grouped")
    cal = ["product_id", "cal_week"]
    sizes, words = counted_sizes(weekly, cal), word_counts(weekly, keys=cal)
    per_cal = weekly.groupBy(*cal).agg(F.count(F.lit(1)).alias("n"), F.min("review_ts").alias("lo"),
                                       F.max("review_ts").alias("hi"))

    span = F.sequence(F.lit(0), F.lit(weeks - 1))

    def to_reports(df: DataFrame) -> DataFrame:
        # each calendar week feeds the report weeks 0 .. weeks-1 after it; the Monday comes from the
        # week text and the range test is on ``YYYY-Www`` text (it sorts like the weeks), so this is
        # narrow: no join, no shuffle
        monday = monday_of(F.col("cal_week"))
        b = df.withColumn("_b", F.explode(span))
        b = b.withColumn("iso_week", iso_week((monday + F.col("_b") * 7).cast("timestamp_ntz")))
        return b.where(F.col("iso_week").between(start_week, end_week)).drop("_b", "cal_week")

    on = [*keys, "cluster_id"]
    sizes = to_reports(sizes).groupBy(*on).agg(F.sum("size").alias("size"), F.min("min_ord").alias("min_ord"))
    words = to_reports(words).groupBy(*on, "word").agg(F.sum("count").alias("count"), F.min("first_age").alias("first_age"))
    per_key = (to_reports(per_cal).groupBy(*keys)
                      .agg(F.sum("n").alias("total_reviews"),
                           F.concat(F.date_format(F.min("lo"), "yyyy-MM-dd"), F.lit(" to "),
                                    F.date_format(F.max("hi"), "yyyy-MM-dd")).alias("data_window")))
    requested, runs = run_args.get("requested"), run_args.get("runs")
    if requested is not None:       # the same gate as P1's, on the report weeks
        todo = runs_to_do(requested, runs, run_args.get("force", False), keys) if runs is not None else requested
        todo = checked_broadcast(todo.select(*keys).distinct())
        sizes, words, per_key = (x.join(todo, keys, "left_semi") for x in (sizes, words, per_key))
    aged = weekly.drop("iso_week").withColumn("_age", review_age())

    def reviews_at(ages: DataFrame) -> DataFrame:
        # the few reviews of these ages first, then their copies in the windows
        few = aged.join(checked_broadcast(ages.select("product_id", "cluster_id", "_age").distinct()), ["product_id", "cluster_id", "_age"], "left_semi")
        return to_reports(few).join(ages, [*on, "_age"], "left_semi")

    themes = themes_from_counts(stage(top_clusters(sizes, n_themes, keys), "top-clusters"), words, reviews_at, keys)
    themes = themes.unionByName(fallback_theme(per_key, themes, keys))
    gen = F.lit(generated_at).cast("timestamp_ntz") if isinstance(generated_at, str) else generated_at
    return assemble_summary(themes, per_key, keys, data_window=F.col("data_window"), generated_at=gen)


def week_number(week: Column) -> Column:
    """Weeks from 1970-W02 to an ISO week given as ``YYYY-Www`` text."""
    return (F.datediff(monday_of(week), F.lit("1970-01-05").cast("date")) / 7).cast("long")


def _backfill_by_vectors(reviews: DataFrame, vectors: DataFrame, start_week: str, end_week: str, weeks: int,
                         eps: float | None, min_cluster_size: int, *, requested: DataFrame | None = None,
                         runs: DataFrame | None = None, force: bool = False, groups=C.DEFAULT_KEYWORD_GROUPS,
                         n_themes: int = C.TOP_THEMES, generated_at: str | Column | None = None) -> DataFrame:
    keys = list(KEYS)
    # plain arithmetic on two constants
    first, last = reviews.sparkSession.range(1).select(week_number(F.lit(start_week)), week_number(F.lit(end_week))).first()
    reviews, _ = split_rejects(reviews)
    texts = stage(reviews.drop("iso_week").withColumn("content", scrub_pii("content"))
                  .withColumn("_group", keyword_group("content", groups))
                  .withColumn("_step", week_number(iso_week("review_ts")))
                  .where(F.col("_step").between(first - weeks + 1, last))
                  .withColumn("_row", F.monotonically_increasing_id()), "reviews-grouped")
    monday = F.date_add(F.lit("1970-01-05").cast("date"), (F.col("window") * 7).cast("int"))
    to_week = iso_week(monday.cast("timestamp_ntz"))
    rows = texts.select("product_id", "review_id", "review_ts", "_group", "_row", F.explode(F.sequence(
        F.greatest("_step", F.lit(first)), F.least(F.col("_step") + weeks - 1, F.lit(last)))).alias("window"))
    rows, wanted = rows.withColumn("iso_week", to_week), None
    if requested is not None:
        todo = runs_to_do(requested, runs, force, keys) if runs is not None else requested
        todo = todo.select(*keys).distinct()
        wanted = todo.select("product_id", week_number(F.col("iso_week")).alias("window"))
        rows = rows.join(checked_broadcast(todo), keys, "left_semi")
    points = texts.select("product_id", "review_id", F.col("_step").alias("step")).join(vectors, "review_id")
    labels = density_cluster_windows(points, weeks, first, last, eps, min_cluster_size, "review_id", "vec", wanted=wanted)
    labels = labels.where("cluster_id >= 0").dropDuplicates(["product_id", "window", "review_id"])
    rows = rows.join(labels, ["product_id", "window", "review_id"], "left")
    rows = stage(rows.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))), "window-rows")
    # A8/M5 on ids: the keyword group of every review is known already
    flags = checked_broadcast(needs_fallback(rows, keys).select(*keys, "needs_fallback"))
    rows = rows.join(flags, keys).withColumn(
        "cluster_id", F.when(F.col("needs_fallback"), F.col("_group")).otherwise(F.col("cluster_id")))
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_reviews"), window_of("review_ts").alias("data_window"),
                                      noise_flags(rows, keys))
    kept = drop_noise(rows, keys, per_key)
    # at most ``weeks`` windows hold a review; they meet its text once
    places = kept.groupBy("_row").agg(F.collect_list(F.struct(*keys, "cluster_id")).alias("_windows"))
    dealt = stage(texts.select("_row", "ord", "content").join(places, "_row").drop("_row"), "dealt")
    copies = dealt.select("ord", "content", F.inline("_windows")).withColumn("_age", review_age())
    themes = themes_from_counts(stage(top_clusters(counted_sizes(copies, keys), n_themes, keys), "top-clusters"),
                                word_counts(dealt, keys=keys, windows="_windows"),
                                lambda ages: copies.join(ages, [*keys, "cluster_id", "_age"], "left_semi"), keys)
    themes = themes.unionByName(fallback_theme(per_key, themes, keys))
    gen = F.lit(generated_at).cast("timestamp_ntz") if isinstance(generated_at, str) else generated_at
    return assemble_summary(themes, per_key.drop("_has_clusters"), keys, data_window=F.col("data_window"), generated_at=gen)


def _backfill_by_copy(reviews: DataFrame, start_week: str, end_week: str, weeks: int, **run_args) -> DataFrame:
    products = reviews.select("product_id").distinct()
    wk = week_keys(products, start_week, end_week)
    lo = F.col("week_start") - F.make_dt_interval(days=F.lit(7 * (weeks - 1)))
    hi = F.col("week_start") + F.make_dt_interval(days=F.lit(7))
    r = reviews.drop("iso_week")
    r = r.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    r = r.withColumn("_wk", iso_week(F.col("review_ts") + F.make_dt_interval(days=F.col("_bucket") * 7)))
    j = r.join(wk.withColumnRenamed("iso_week", "_wk"), ["product_id", "_wk"])
    j = j.where((F.col("review_ts") >= lo) & (F.col("review_ts") < hi)).withColumnRenamed("_wk", "iso_week")
    j = j.drop("_bucket", "week_start")
    return run_weekly(j, **run_args)
