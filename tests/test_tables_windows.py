"""Sources, stored tables, windows, dedup, filters, reports and streams on literal fixtures."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from themelens.operators import filters as Fl
from themelens.operators import reports as R
from themelens.operators import windows as W
from themelens.sources import feeds, tables
from themelens.streaming import reviews as St

AS_OF = "2026-05-20 00:00:00"


def test_app_store_feed_edges(spark, tmp_path):
    def e(i, author=True, rating="4", updated="2026-05-01T10:00:00Z"):
        d = {"id": {"label": i}, "content": {"label": "text " + i}, "im:rating": {"label": rating}}
        if author:
            d["author"] = {"name": {"label": "u" + i}}
        if updated is not None:
            d["updated"] = {"label": updated}
        return d
    feed = {"feed": {"entry": [e("1", author=False), e("2", updated="2026-05-01T10:00:00-07:00"), e("3"),
                               e("4", updated="yesterday"), e("5", rating="x"), e("6", updated=None)]}}
    (tmp_path / "feed.json").write_text(json.dumps(feed, indent=2))
    (tmp_path / "empty.json").write_text(json.dumps({"feed": {"entry": []}}))
    got = {r.review_id: r for r in feeds.read_app_store_feed(spark, str(tmp_path), AS_OF, multi_line=True).collect()}
    assert sorted(got) == ["2", "3", "4", "5", "6"]
    micros = {r.review_id: r.us for r in feeds.read_app_store_feed(spark, str(tmp_path), AS_OF, multi_line=True)
              .select("review_id", F.unix_micros("review_ts").alias("us")).collect()}
    base = int(dt.datetime(2026, 5, 1, 10, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    assert micros["3"] == base and micros["2"] == base + 7 * 3600 * 10**6
    as_of = int(dt.datetime(2026, 5, 20, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    assert micros["4"] == as_of and micros["6"] == as_of
    assert got["5"].rating == 0 and got["3"].rating == 4


def test_play_reviews_and_window(spark, tmp_path):
    rows = [{"reviewId": "a", "userName": "x", "score": 5, "content": "new", "at": "2026-05-19T00:00:00"},
            {"reviewId": "b", "userName": "y", "score": 1, "content": "edge", "at": "2026-04-22T00:00:00"},
            {"reviewId": "c", "userName": "z", "score": 3, "content": "old", "at": "2026-04-21T23:59:59"}]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(r) for r in rows))
    df = feeds.read_play_reviews(spark, str(tmp_path))
    ntz = df.withColumn("review_ts", F.to_utc_timestamp("review_ts", spark.conf.get("spark.sql.session.timeZone"))
                        .cast("timestamp_ntz"))
    kept = sorted(r.review_id for r in Fl.review_window(ntz, AS_OF, weeks=4).collect())
    assert kept == ["a", "b"]                       # exactly on the cutoff is kept


def test_upsert_runs_new_snapshot(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "p", "w1", "COMPLETED"), ("r2", "p", "w2", "FAILED")],
                                 "run_id string, product_id string, iso_week string, status string")
    changes = spark.createDataFrame([("p", "w2", "IN_PROGRESS"), ("p", "w3", "IN_PROGRESS")],
                                    "product_id string, iso_week string, status string")
    path = tables.upsert_runs(runs, changes, str(tmp_path))
    got = sorted((r.iso_week, r.status, r.run_id) for r in spark.read.parquet(path).collect())
    assert got == [("w1", "COMPLETED", "r1"), ("w2", "IN_PROGRESS", "pulse-p-w2"), ("w3", "IN_PROGRESS", "pulse-p-w3")]
    todo = Fl.runs_to_do(spark.read.parquet(path).select("product_id", "iso_week"), spark.read.parquet(path))
    assert sorted(r.iso_week for r in todo.collect()) == ["w2", "w3"]


def test_dedup_hot_group_of_copies(spark):
    # one review copied many times (a hot group): the latest copy wins
    rows = [("google_play", "x", i, dt.datetime(2026, 5, 1) + dt.timedelta(minutes=i)) for i in range(500)]
    rows += [("app_store", "x", 7, dt.datetime(2026, 5, 1))]
    df = spark.createDataFrame(rows, "source string, review_id string, rating int, scraped_at timestamp_ntz")
    got = sorted((r.source, r.rating) for r in W.dedup_reviews(df.repartition(7)).collect())
    assert got == [("app_store", 7), ("google_play", 499)]


def test_take_until_older_and_drop_noise(spark):
    rows = [("p", "w", i, dt.datetime(2026, 5, 10 - (i if i != 3 else 9))) for i in range(6)]
    df = spark.createDataFrame(rows, "product_id string, iso_week string, o int, review_ts timestamp_ntz")
    df = df.withColumn("ord", F.col("o"))
    got = sorted(r.o for r in W.take_until_older(df, "2026-05-06 00:00:00").collect())
    assert got == [0, 1, 2]
    c = spark.createDataFrame([("p", "a", -1), ("p", "a", 1), ("p", "b", -1), ("p", "b", -1)],
                              "product_id string, iso_week string, cluster_id int")
    assert sorted((r.iso_week, r.cluster_id) for r in Fl.drop_noise(c).collect()) == [("a", 1), ("b", -1), ("b", -1)]


def _summary(spark):
    theme = {"name": "Login Failure After Update", "summary": "S1. S2.", "review_count": 3,
             "quotes": [{"text": "q1", "source_review_id": "1"}], "action_ideas": [{"title": "T", "description": "D"}],
             "sentiment_score": 0.0}
    schema = ("run_id string, product_id string, iso_week string, data_window string, total_reviews_analyzed long, "
              "top_themes array<struct<name:string,summary:string,review_count:long,"
              "quotes:array<struct<text:string,source_review_id:string>>,"
              "action_ideas:array<struct<title:string,description:string>>,sentiment_score:double>>")
    return spark.createDataFrame([("pulse-groww-2026-W20", "Groww", "2026-W20", "Last 4 weeks", 10, [theme]),
                                  ("pulse-groww-2026-W21", "Groww", "2026-W21", "Last 4 weeks", 0, [])], schema)


def python_markdown(product, week, window, total, themes):
    md = [f"# Weekly Review Pulse — {product} — {week}", f"**Period:** {window}",
          f"**Total Reviews Analyzed:** {total}", f"**ID:** `pulse-{product.lower()}-{week}`", "\n---",
          "\n## Top Themes\n"]
    if not themes:
        md.append("_No specific themes identified for this period._")
    for i, t in enumerate(themes):
        md.append(f"### {i+1}. {t['name']} ({t['review_count']} reviews)")
        md.append(f"{t['summary']}\n")
        if t["quotes"]:
            md.append("**Representative Quotes:**")
            md += [f"> \"{q['text']}\"" for q in t["quotes"]]
            md.append("")
        if t["action_ideas"]:
            md.append("**Product Action Ideas:**")
            md += [f"- **{a['title']}**: {a['description']}" for a in t["action_ideas"]]
            md.append("")
        md.append("\n---")
    return "\n".join(md)


def test_report_markdown_layout(spark):
    got = {r.iso_week: r.markdown for r in R.report_markdown(_summary(spark)).collect()}
    t = {"name": "Login Failure After Update", "summary": "S1. S2.", "review_count": 3, "quotes": [{"text": "q1"}],
         "action_ideas": [{"title": "T", "description": "D"}]}
    assert got["2026-W20"] == python_markdown("Groww", "2026-W20", "Last 4 weeks", 10, [t])
    assert got["2026-W21"] == python_markdown("Groww", "2026-W21", "Last 4 weeks", 0, [])


def test_report_lines_and_email(spark):
    lines = [r.text for r in R.report_lines(_summary(spark)).where("iso_week = '2026-W20'").orderBy("line_no").collect()]
    assert lines[0] == "ID: pulse-groww-2026-W20\n" and lines[3] == "\n--- Top Themes ---\n"
    assert lines[4:] == ["1. Login Failure After Update (3 reviews)\n", "S1. S2.\n", "Representative Quotes:\n",
                         '" q1 "\n', "Action Ideas:\n", "• T: D\n"]
    mails = {r.iso_week: r for r in R.email_teasers(_summary(spark)).collect()}
    assert mails["2026-W20"].subject == "[Weekly Pulse] Groww — 2026-W20 — Login Failure After Update"
    assert mails["2026-W21"].subject.endswith("General Updates")


def test_delivery_outbox(spark):
    d = spark.createDataFrame([("Groww", "2026-W20", "doc", "id1"), ("Groww", "2026-W20", "email", None)],
                              "product_id string, iso_week string, channel string, delivery_id string")
    got = sorted((r.iso_week, r.channel) for r in R.delivery_outbox(_summary(spark), d).collect())
    assert got == [("2026-W20", "email"), ("2026-W21", "doc"), ("2026-W21", "email")]


def test_stream_reviews_drops_repeats(spark, tmp_path):
    schema = "product_id string, iso_week string, source string, review_id string, content string, review_ts timestamp_ntz"
    rows = [("p", "w", "google_play", str(i), f"mail me a{i}@b.com", dt.datetime(2026, 5, 1, i)) for i in range(5)]
    landing = str(tmp_path / "landing")
    spark.createDataFrame(rows, schema).write.parquet(landing)
    spark.createDataFrame(rows[:2], schema).write.mode("append").parquet(landing)
    sink = str(tmp_path / "sink")
    q = St.stream_reviews(spark, landing, spark.createDataFrame([], schema).schema, sink, str(tmp_path / "ckpt"))
    q.awaitTermination()
    out = St.load_stream(spark, sink, spark.createDataFrame([], schema).schema).collect()
    assert sorted(r.review_id for r in out) == ["0", "1", "2", "3", "4"]
    assert all(r.content == "mail me [EMAIL_REDACTED]" for r in out)


def test_stream_keeps_late_files(spark, tmp_path):
    """Newest week first, one file per micro-batch: nothing is lost, and a restart adds only what is new."""
    schema = "product_id string, iso_week string, source string, review_id string, content string, review_ts timestamp_ntz"
    landing, sink = str(tmp_path / "landing"), str(tmp_path / "sink")
    for w in (4, 3, 2, 1, 3):
        rows = [("p", f"w{w}", "google_play", f"{w}-{i}", "x", dt.datetime(2026, 5, w * 7, i)) for i in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    kind = spark.createDataFrame([], schema).schema
    for extra in (0, 1):
        if extra:
            rows = [("p", "w9", "google_play", "9-0", "x", dt.datetime(2026, 1, 1)), ("p", "w1", "google_play", "1-0", "x", dt.datetime(2026, 5, 7))]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        St.stream_reviews(spark, landing, kind, sink, str(tmp_path / "ckpt"), max_files=1).awaitTermination()
        ids = [r.review_id for r in St.load_stream(spark, sink, kind).collect()]
        assert sorted(ids) == sorted([f"{w}-{i}" for w in (1, 2, 3, 4) for i in range(5)] + ["9-0"] * extra)


def test_stream_state_holds_the_keys_not_the_sink(spark, tmp_path):
    """A micro-batch reads its own files only, and a restarted query knows the keys of the one before."""
    schema = "product_id string, iso_week string, source string, review_id string, content string, review_ts timestamp_ntz"
    landing, sink, ckpt = str(tmp_path / "landing"), str(tmp_path / "sink"), str(tmp_path / "ckpt")
    kind = spark.createDataFrame([], schema).schema
    seen = set()
    for run in range(3):
        ids = [*(f"{run}-{i}" for i in range(20)), *(f"{max(0, run - 1)}-{i}" for i in range(5)), f"{run}-0", None, None]
        seen |= set(ids)
        rows = [("p", "w", "google_play", i, "x", dt.datetime(2026, 5, 1)) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        q = St.stream_reviews(spark, landing, kind, sink, ckpt)
        q.awaitTermination()
        last = [p for p in q.recentProgress if p["numInputRows"]][-1]
        assert last["numInputRows"] == len(ids)                 # not the rows of earlier batches
        assert last["stateOperators"][0]["numRowsTotal"] == len(seen)
        assert any("rocksdb" in k.lower() for k in last["stateOperators"][0]["customMetrics"])
        got = [r.review_id for r in St.load_stream(spark, sink, kind).collect()]
        assert len(got) == len(seen) and set(got) == seen
    with pytest.raises(ValueError):
        St.stream_reviews(spark, landing, kind, sink, str(tmp_path / "another"))


def test_feed_rejects_and_stored_ids(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.json").write_text(json.dumps({"feed": {"entry": []}}, indent=1))
    (tmp_path / "in/bad.json").write_text('{"feed": {"entry": [')
    got = feeds.app_store_feed_rejects(spark, str(tmp_path / "in")).collect()
    assert [(r.file.rsplit("/", 1)[-1], r.reason) for r in got] == [("bad.json", "not JSON")]
    rows = spark.createDataFrame([("0071404", "2026-W01", "google_play", "007", "u", 5, "t", dt.datetime(2026, 1, 1))], tables.REVIEW_SCHEMA)
    tables.append_reviews(rows, str(tmp_path / "log"))
    back = tables.load_reviews(spark, str(tmp_path / "log")).first()
    assert (back.product_id, back.review_id, back.rating) == ("0071404", "007", 5)


def test_upsert_partitions_rewrites_only_touched_weeks(spark, tmp_path):
    schema = "week_start string, event_type string, n long"
    table = str(tmp_path / "t")
    St.upsert_partitions(spark.createDataFrame([("w1", "a", 1), ("w1", "b", 2), ("w2", "a", 3)], schema),
                         table, ["week_start", "event_type"], "week_start")
    St.upsert_partitions(spark.createDataFrame([("w2", "a", 30), ("w3", "c", 4)], schema),
                         table, ["week_start", "event_type"], "week_start")
    got = sorted(tuple(r) for r in spark.read.parquet(table).select("week_start", "event_type", "n").collect())
    assert got == [("w1", "a", 1), ("w1", "b", 2), ("w2", "a", 30), ("w3", "c", 4)]
