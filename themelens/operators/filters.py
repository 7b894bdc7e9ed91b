"""Row filters and predicates (F1, F2, F5, F6, F7, F9). All are narrow or semi/anti joins on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens import KEYS
from themelens import constants as C
from themelens.session import checked_broadcast


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp_ntz")


def review_window(df: DataFrame, as_of, weeks: int = 4, ts_col: str = "review_ts",
                  end_exclusive: bool = False) -> DataFrame:
    """keep ``ts >= as_of - weeks`` (a row exactly on the cutoff is kept). With
    ``end_exclusive`` also ``ts < as_of``, so a window can end at the end of an ISO week."""
    end = _ts(as_of)
    cond = F.col(ts_col) >= end - F.make_dt_interval(days=F.lit(7 * weeks))
    if end_exclusive:
        cond = cond & (F.col(ts_col) < end)
    return df.where(cond)


def parse_review_fields(df: DataFrame, as_of, rating_col: str = "rating_text",
                        date_col: str = "date_text") -> DataFrame:
    """rating text -> int (0 when missing or malformed: one bad row never aborts the rest);
    ISO date text, with or without offset -> timestamp; an unparsable date falls back to ``as_of``
    (the job's fixed time, so runs repeat exactly)."""
    rating = F.coalesce(F.expr(f"try_cast(trim({rating_col}) AS INT)"), F.lit(0))
    return (df.withColumn("rating", rating.cast("int"))
              .withColumn("review_ts", F.coalesce(parse_instant(F.col(date_col)), parse_instant(F.lit(as_of)))))


def parse_instant(text: Column) -> Column:
    """ISO-8601 text -> instant. ``Z`` and ``+hh:mm`` offsets are honoured; text without an offset
    is read as UTC, so the result never depends on the session time zone. Null when unparsable."""
    t = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    t = F.when(t.rlike(r"[+-]\d\d:\d\d$"), t).otherwise(F.concat(t, F.lit("+00:00")))
    t = F.regexp_replace(t, r"^(\d{4}-\d\d-\d\d) ", "$1T")
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm[.SSSSSS]XXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-ddXXX")),
    )


def noise_flags(df: DataFrame, keys=KEYS) -> Column:
    """Aggregate for F5: 1 when the key has a cluster other than noise."""
    return F.max((F.col("cluster_id") != -1).cast("int")).alias("_has_clusters")


def drop_noise(df: DataFrame, keys=KEYS, flags: DataFrame | None = None) -> DataFrame:
    """drop ``cluster_id = -1``; a key with no other cluster keeps its noise as one cluster.

    The per-key flag is a partial aggregate joined back on the key, not a window over the key, so
    a hot product-week is never sorted in one task. ``flags`` (keys, ``_has_clusters``) may come
    from a per-key aggregation the caller computes anyway."""
    if flags is None:
        flags = df.groupBy(*keys).agg(noise_flags(df, keys))
    flags = checked_broadcast(flags.select(*keys, "_has_clusters"))     # one row per key
    return (df.join(flags, list(keys))
              .where((F.col("cluster_id") != -1) | (F.col("_has_clusters") == 0))
              .drop("_has_clusters"))


def runs_to_do(requested: DataFrame, runs: DataFrame, force: bool = False, keys=KEYS) -> DataFrame:
    """requested keys minus those already ``COMPLETED`` (unless forced)."""
    if force:
        return requested
    done = runs.where(F.col("status") == "COMPLETED").select(*keys)
    return requested.join(done, list(keys), "left_anti")


def nonempty_runs(requested: DataFrame, reviews: DataFrame, keys=KEYS) -> DataFrame:
    """keys with at least one review go on; the rest are reported ``EMPTY`` by the caller."""
    return requested.join(reviews.select(*keys), list(keys), "left_semi")


def valid_themes(themes: DataFrame) -> DataFrame:
    """name of 3-100 characters and every idea with a title and a description; any other
    theme is dropped (its cluster yields no theme)."""
    name_ok = F.length("name").between(C.THEME_NAME_MIN, C.THEME_NAME_MAX)
    ideas_ok = F.coalesce(
        F.forall("action_ideas", lambda x: x.isNotNull() & x["title"].isNotNull() & x["description"].isNotNull()),
        F.lit(True))
    return themes.where(F.col("name").isNotNull() & name_ok & ideas_ok)
