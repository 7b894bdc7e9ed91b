"""Column functions (S1-S9, F3, F4, F8). All JVM-side built-ins: they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from themelens import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java(pattern: str) -> str:
    # Unicode-aware \b \d \s \w, as in the patterns' original dialect.
    return "(?U)" + pattern


def scrub_email(c) -> Column:
    return F.regexp_replace(_col(c), _java(C.EMAIL_PATTERN), C.EMAIL_MASK)


def scrub_phone(c) -> Column:
    return F.regexp_replace(_col(c), _java(C.PHONE_PATTERN), C.PHONE_MASK)


def scrub_card(c) -> Column:
    return F.regexp_replace(_col(c), _java(C.CARD_PATTERN), C.CARD_MASK)


def scrub_pii(c) -> Column:
    """Email, then phone, then card. Null and empty text pass through unchanged.

    Each pattern needs a character most texts lack (``@``; a decimal digit), so a cheap test skips
    the full regex scan for them; the result is the same as applying the three regexes always."""
    c = _col(c)
    emailed = F.when(F.instr(c, "@") > 0, scrub_email(c)).otherwise(c)
    digits = F.when(c.rlike(r"\p{Nd}"), scrub_card(scrub_phone(emailed))).otherwise(emailed)
    return digits


def iso_week(ts) -> Column:
    """``YYYY-Www`` with the ISO week-numbering year (2027-01-01 -> 2026-W53)."""
    ts = _col(ts)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def report_anchor(product, week) -> Column:
    """S3: ``pulse-{lower(product)}-{week}``."""
    return F.concat(F.lit("pulse-"), F.lower(_col(product)), F.lit("-"), _col(week))


def tokens(c) -> Column:
    """Lower-cased runs of >= 5 letters, digits or underscores, in text order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(C.TOKEN_PATTERN), 0)


def title_word(c) -> Column:
    """Python ``str.title()`` of a token: every run of cased letters gets a capital first letter,
    the rest lower; digits, ``_`` and letters without case start a new run (``abc_def`` -> ``Abc_Def``,
    ``a1b`` -> ``A1B``)."""
    parts = F.regexp_extract_all(_col(c), F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def extract_json(c) -> Column:
    """First ``{`` to last ``}``, across newlines; empty string when there is none."""
    return F.regexp_extract(_col(c), r"(?s)\{.*\}", 0)


def contains_ci(a, b) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(_col(a)), F.lower(_col(b)))


def keyword_group(c, groups: Sequence[Iterable[str]] = C.DEFAULT_KEYWORD_GROUPS) -> Column:
    """Index of the first group with a word that occurs as a substring of the lower-cased
    text; ``len(groups)`` when none does."""
    low = F.lower(_col(c))
    expr = None
    for i, words in enumerate(groups):
        hit = None
        for w in words:
            t = F.instr(low, F.lit(w.lower())) > 0
            hit = t if hit is None else (hit | t)
        if hit is None:
            continue
        expr = F.when(hit, F.lit(i)) if expr is None else expr.when(hit, F.lit(i))
    other = F.lit(len(groups))
    return other if expr is None else expr.otherwise(other)


def normalise_ideas(ideas) -> Column:
    """A JSON array (text) of ideas -> ``array<struct<title,description>>``, by the type of each
    element: a string becomes ``('Action Item', s)``, an object its title and description; elements of
    other types (null, numbers, lists) are skipped. Null when the text is no JSON array."""
    every = F.try_variant_get(F.try_parse_json(_col(ideas)), "$", "array<variant>")
    kept = F.filter(every, lambda x: (F.schema_of_variant(x) == "STRING") | F.schema_of_variant(x).startswith("OBJECT"))

    def one(x):
        own = F.struct(F.try_variant_get(x, "$.title", "string").alias("title"),
                       F.try_variant_get(x, "$.description", "string").alias("description"))
        return F.when(F.schema_of_variant(x) == "STRING", F.struct(
            F.lit(C.STRING_IDEA_TITLE).alias("title"), F.try_variant_get(x, "$", "string").alias("description"))).otherwise(own)

    return F.transform(kept, one)


def flatten_newlines(c) -> Column:
    """newline -> space."""
    return F.replace(_col(c), F.lit("\n"), F.lit(" "))


def normalise_whitespace(c) -> Column:
    """split on any whitespace run, join with one space (``" ".join(s.split())``)."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)[\s\x1C-\x1F]+", " "))


def shorten(c, n: int, always: bool = False) -> Column:
    """F8: first ``n`` characters plus ``...``; only when longer than ``n`` unless ``always``."""
    c = _col(c)
    cut = F.concat(F.substring(c, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(c) > n, cut).otherwise(c)
