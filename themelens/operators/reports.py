"""Report tables (R1-R4), built from the nested summary row with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens import KEYS
from themelens import constants as C
from themelens.functions.text import report_anchor, shorten
from themelens.operators.themes import fill


def _str(c: Column) -> Column:
    return c.cast("string")


def _theme_md(t: Column, i: Column) -> Column:
    head = fill(C.REPORT_THEME_HEAD, i=_str(i + 1), name=t["name"], n=_str(t["review_count"]))
    quotes = F.when(F.size(t["quotes"]) > 0, F.concat(
        F.array(F.lit(C.REPORT_QUOTES_HEAD)),
        F.transform(t["quotes"], lambda q: fill(C.REPORT_QUOTE, text=q["text"])),
        F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    ideas = F.when(F.size(t["action_ideas"]) > 0, F.concat(
        F.array(F.lit(C.REPORT_IDEAS_HEAD)),
        F.transform(t["action_ideas"], lambda a: fill(C.REPORT_IDEA, title=a["title"],
                                                       description=a["description"])),
        F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(head, F.concat(t["summary"], F.lit("\n"))), quotes, ideas,
                    F.array(F.lit(C.REPORT_RULE)))


def report_markdown(summaries: DataFrame, product_col: str = "product_id") -> DataFrame:
    """One Markdown document per product-week (the chart-image line is left out)."""
    themes = F.col("top_themes")
    header = F.array(
        fill(C.REPORT_TITLE, product=F.col(product_col), week=F.col("iso_week")),
        fill(C.REPORT_PERIOD, window=F.col("data_window")),
        fill(C.REPORT_TOTAL, n=_str(F.col("total_reviews_analyzed"))),
        fill(C.REPORT_ID, anchor=report_anchor(product_col, "iso_week")),
        F.lit(C.REPORT_RULE), F.lit(C.REPORT_TOP))
    none = F.when(F.size(themes) == 0, F.array(F.lit(C.REPORT_NO_THEMES))).otherwise(
        F.array().cast("array<string>"))
    body = F.flatten(F.transform(themes, lambda t, i: _theme_md(t, i)))
    md = F.array_join(F.concat(header, none, body), "\n")
    return summaries.select("run_id", *KEYS, md.alias("markdown"))


def _theme_lines(t: Column, i: Column) -> Column:
    return F.concat(
        F.array(fill(C.LINES_THEME_HEAD, i=_str(i + 1), name=t["name"], n=_str(t["review_count"])),
                F.concat(t["summary"], F.lit("\n")), F.lit(C.LINES_QUOTES_HEAD)),
        F.transform(t["quotes"], lambda q: fill(C.LINES_QUOTE, text=q["text"])),
        F.array(F.lit(C.LINES_IDEAS_HEAD)),
        F.transform(t["action_ideas"], lambda a: fill(C.LINES_IDEA, title=a["title"],
                                                       description=a["description"])))


def report_lines(summaries: DataFrame, product_col: str = "product_id") -> DataFrame:
    """R2: the document as ordered text inserts, in reading order (line_no from 0)."""
    head = F.array(
        fill(C.LINES_ID, anchor=report_anchor(product_col, "iso_week")),
        fill(C.LINES_TITLE, product=F.col(product_col), week=F.col("iso_week")),
        fill(C.LINES_META, window=F.col("data_window"), n=_str(F.col("total_reviews_analyzed"))),
        F.lit(C.LINES_TOP))
    lines = F.concat(head, F.flatten(F.transform("top_themes", lambda t, i: _theme_lines(t, i))))
    return summaries.select("run_id", *KEYS, F.posexplode(lines).alias("line_no", "text"))


# FIXED VALUES: the shorter plain-text teaser sent with the run.
TEASER_SUBJECT = "Review Pulse: {product} ({week})"
TEASER_HEAD = ("Weekly Review Pulse: {product} ({week})\n-------------------------------------------\n\n"
               "Analyzed {n} reviews and identified {k} key themes.\n\n")
TEASER_THEME = "{i}. {name} ({n} reviews)\n   {summary}\n\n"
TEASER_TAIL = "View the full report here: {link}\n\nBest,\nPulse Engine"


def email_teasers(summaries: DataFrame, doc_link: str = "#", product_col: str = "product_id") -> DataFrame:
    """Subject and plain-text body of the report mail, plus the shorter teaser."""
    themes = F.col("top_themes")
    top = F.coalesce(F.get(themes, 0)["name"], F.lit(C.EMAIL_NO_TOP))
    subject = fill(C.EMAIL_SUBJECT, product=F.col(product_col), week=F.col("iso_week"), top=top)
    body = F.concat(
        fill(C.EMAIL_TEXT_HEAD, product=F.col(product_col), week=F.col("iso_week"),
             n=_str(F.col("total_reviews_analyzed"))),
        F.array_join(F.transform(themes, lambda t, i: fill(C.EMAIL_TEXT_THEME, i=_str(i + 1), name=t["name"],
                                                           summary=t["summary"])), ""),
        fill(C.EMAIL_TEXT_TAIL, link=doc_link))
    teaser = F.concat(
        fill(TEASER_HEAD, product=F.col(product_col), week=F.col("iso_week"),
             n=_str(F.col("total_reviews_analyzed")), k=_str(F.size(themes))),
        F.array_join(F.transform(themes, lambda t, i: fill(
            TEASER_THEME, i=_str(i + 1), name=t["name"], n=_str(t["review_count"]),
            summary=shorten(t["summary"], 100, always=True))), ""),
        fill(TEASER_TAIL, link=doc_link))
    return summaries.select(
        "run_id", *KEYS, subject.alias("subject"), body.alias("text_body"),
        fill(TEASER_SUBJECT, product=F.col(product_col), week=F.col("iso_week")).alias("teaser_subject"),
        teaser.alias("teaser_body"))


def delivery_outbox(summaries: DataFrame, deliveries: DataFrame,
                    channels=("doc", "email"), keys=KEYS) -> DataFrame:
    """What is still to send: every summarised key on every channel, minus deliveries that got
    an id. Failed or pending deliveries stay in the outbox for the next run."""
    want = summaries.select(*keys, "run_id").withColumn(
        "channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    done = deliveries.where(F.col("delivery_id").isNotNull()).select(*keys, "channel")
    return want.join(done, [*keys, "channel"], "left_anti")
