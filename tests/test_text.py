"""S1-S9, F3, F4, F8 on literal fixtures (FIXTURES.md §1.1, 1.2, 1.8, 1.9)."""
import datetime as dt

from pyspark.sql import functions as F

from themelens.functions import text as T

PII = [
    ("Contact me at user@example.com or call 123-456-7890. My card is 1234-5678-9012-3456.",
     "Contact me at [EMAIL_REDACTED] or call [PHONE_REDACTED]. My card is [CARD_REDACTED]."),
    ("1234567890123", "[PHONE_REDACTED]"),
    ("12345678901234", "[CARD_REDACTED]"),
    ("4111111111111111", "[CARD_REDACTED]"),
    ("call +91 98765 43210", "call +91 98765 43210"),
    ("+91-9876543210", "+[PHONE_REDACTED]"),
    ("(022) 123-4567", "([PHONE_REDACTED]"),
    ("é9876543210", "é9876543210"),
    ("", ""),
    (None, None),
]

RAW_REVIEWS = [
    "The app is crashing on my phone. My email is test@gmail.com",
    "Login fails every time I open the app.",
    "Crashes during trading hours, very annoying.",
    "Beautiful UI and very fast.",
    "I love the new design, it's very sleek.",
    "Interface is great but login is slow.",
]


def test_scrub_pii_table(spark):
    df = spark.createDataFrame(PII, "text string, expected string")
    rows = df.select(T.scrub_pii("text").alias("out"), "expected").collect()
    for r in rows:
        assert r.out == r.expected


def test_scrub_is_idempotent(spark):
    df = spark.createDataFrame([(a,) for a, _ in PII], "text string")
    once = df.select(T.scrub_pii("text").alias("t"))
    twice = once.select(T.scrub_pii("t").alias("t2"), "t")
    assert all(r.t == r.t2 for r in twice.collect())


def test_scrub_raw_reviews(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(RAW_REVIEWS)], "i int, text string")
    out = {r.i: r.s for r in df.select("i", T.scrub_pii("text").alias("s")).collect()}
    assert out[0].endswith("[EMAIL_REDACTED]")
    assert all(out[i] == RAW_REVIEWS[i] for i in range(1, 6))


def test_keyword_groups_default_lists(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(RAW_REVIEWS)], "i int, text string")
    got = {r.i: r.g for r in df.select("i", T.keyword_group("text").alias("g")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 1}


def test_keyword_group_matches_inside_words(spark):
    df = spark.createDataFrame([("Great feedback",), ("coffee break",), ("server crash with fee",)], "t string")
    assert [r.g for r in df.select(T.keyword_group("t").alias("g")).collect()] == [0, 0, 0]


def test_iso_week(spark):
    df = spark.createDataFrame([(dt.datetime(2027, 1, 1),), (dt.datetime(2026, 5, 13),), (dt.datetime(2026, 5, 11),)],
                               "ts timestamp_ntz")
    assert [r.w for r in df.select(T.iso_week("ts").alias("w")).collect()] == ["2026-W53", "2026-W20", "2026-W20"]


def test_report_anchor(spark):
    df = spark.createDataFrame([("Groww", "2026-W20")], "p string, w string")
    assert df.select(T.report_anchor("p", "w")).first()[0] == "pulse-groww-2026-W20"


def test_tokens_match_python_word_class(spark):
    import re
    texts = ["সত্যি !অসাধারণ এপ্লিকেশন।", "naïve_abc and abcd", "Hello WORLD_x 12345 straße", "ab_cdefg ÉCOLE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [list(r.k) for r in df.select(T.tokens("t").alias("k")).collect()]
    assert got == [re.findall(r"\w{5,}", t.lower()) for t in texts]


def test_title_word_is_python_title(spark):
    words = ["abc_def", "a1b", "hello", "ßachen", "x2y_z9", "éclair"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.t for r in df.select(T.title_word("w").alias("t")).collect()]
    assert got == [w.title() for w in words]


def test_extract_json_first_to_last_brace(spark):
    df = spark.createDataFrame([("Sure:\n{\"a\": {\"b\": 1}}\nbye",), ("no json",)], "t string")
    assert [r.j for r in df.select(T.extract_json("t").alias("j")).collect()] == ['{"a": {"b": 1}}', ""]


def test_normalise_whitespace_and_newlines(spark):
    df = spark.createDataFrame([("  a \t b\n\nc  ",)], "t string")
    r = df.select(T.normalise_whitespace("t").alias("n"), T.flatten_newlines("t").alias("f")).first()
    assert r.n == " ".join("  a \t b\n\nc  ".split())
    assert r.f == "  a \t b  c  "


def test_shorten(spark):
    df = spark.createDataFrame([("x" * 31,), ("y" * 30,)], "t string")
    rows = df.select(T.shorten("t", 30).alias("a"), T.shorten("t", 100, always=True).alias("b")).collect()
    assert rows[0].a == "x" * 30 + "..." and rows[1].a == "y" * 30
    assert rows[1].b == "y" * 30 + "..."


def test_contains_ci(spark):
    df = spark.createDataFrame([("The App CRASHES", "app crashes"), ("abc", "")], "a string, b string")
    assert [r.c for r in df.select(T.contains_ci("a", "b").alias("c")).collect()] == [True, True]


def test_normalise_ideas(spark):
    raw = '["Do this", null, 5, [1], {"title": "T", "description": "D"}, {"title": "only"}, "{menu} is hidden"]'
    df = spark.createDataFrame([(raw,), ("[]",), ('"x"',), (None,)], "ideas string")
    got = [r.i for r in df.select(T.normalise_ideas("ideas").alias("i")).collect()]
    assert [tuple(g) for g in got[0]] == [("Action Item", "Do this"), ("T", "D"), ("only", None), ("Action Item", "{menu} is hidden")]
    assert got[1:] == [[], None, None]


def test_title_and_whitespace_edges(spark):
    words = ["\u4e2dabc\u4e2d", "\u0906abcd", "abc_def", "a1b", "\u00c9tude"]
    got = [r.t for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.title_word("w").alias("t")).collect()]
    assert got == [w.title() for w in words]
    texts = [" a\x1cb\x1d\x1e c\x1f", "\u00a0x \u2003 y\t", "\x1c"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "w string").select(T.normalise_whitespace("w").alias("t")).collect()]
    assert got == [" ".join(t.split()) for t in texts]
