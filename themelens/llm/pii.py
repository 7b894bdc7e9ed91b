"""PII: regular expressions propose spans, checksums confirm them, context words adjust the score.

Native: every step is a Spark SQL expression on one row, so there is no shuffle and no Python, and a
lost executor only costs its tasks.

Kinds, in order. The first four are the base; their validated spans are always reported.

==========  ==========================================  ==============================  =====
kind        proposal                                    confirmation                    score
==========  ==========================================  ==============================  =====
email       local part, ``@``, dotted domain            none                            0.9
ip          four dotted numbers                         each at most 255                0.7
card        digits with single spaces or hyphens        16 to 19 digits, Luhn           0.8
phone       ``+`` and digits, spaces, ``().-``          8 to 15 digits                  0.6
iban        country code, two digits, its length        mod-97 is 1                     0.8
ssn         ``ddd-dd-dddd``                             group rules                     0.3
card_in     a card inside a ``card`` run that fails     issuer, layout, Luhn            0.7
phone_in    a phone at the start of a run that fails    8 to 15 digits in whole groups  0.5
==========  ==========================================  ==============================  =====

A context word of the kind within 48 characters of unmatched text adds 0.2 to the score (at most 1);
a word that speaks against it (version, example, order ...) takes 0.2 away. ``iban`` and ``ssn`` are
reported from a score of ``min_score`` (0.5) on, so a bare ``ssn`` shape needs its context word.

A number next to other digits (a card after a house number, a phone before a date) makes the whole run fail the
base check, which is not tried again. ``card_in`` finds cards inside such runs: 16 to 19 digits at a stretch, or
four groups of four and up to three more digits, that begin like a card and pass Luhn; every start is tried, so
spans of this kind may overlap. ``phone_in`` is as much of a longer run as a phone number can have, up to the
end of a digit group. Cards inside account numbers are not reported.

An account number has the length that its country code fixes (``IBAN_LENGTHS``), so what follows it does not
matter; other codes have no account numbers. Every start is tried, also one inside a number that fails.

Defined cases: a null text is empty (no spans, counts 0, the digest of the empty string). Null ids,
repeated rows and extra columns pass through. Texts are handled whole; matching is linear in the text.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.llm import spans as S

# Lengths of account numbers by country code (IBAN registry, and codes in use outside it).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
# The first four characters of a proposed number; group 1 is all of it. So proposals may overlap, and one that
# fails its check hides no other.
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?=((?:%s)(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}" % "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
# Proposals by kind. Possessive and anchored at the start of a run, so that long runs
# cost one attempt; `\G` lets an email start right after the one before it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
INSIDE = ("card_in", "phone_in")
KINDS = BASE + ADDED + INSIDE
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "card_in": 0.7, "phone_in": 0.5}
# How a card number begins (issuers with 16 digits or more), and its layouts inside a longer run.
ISSUER = r"(?:2[2-7][0-9]{2}|3[0-9]{3}|4[0-9]{3}|5[1-5][0-9]{2}|6[0-9]{3})"
CARD_LAYOUTS = (ISSUER + r"[0-9]{12,15}(?![0-9])", ISSUER + r"(?:[\x20-][0-9]{4}){3}(?![0-9])",
                ISSUER + r"(?:[\x20-][0-9]{4}){3}[\x20-][0-9]{1,3}(?![0-9])")
CARD_START = rf"(?<![0-9])(?={'|'.join(CARD_LAYOUTS)})[0-9]"
PHONE_PART = r"^\+[0-9](?:[\x20().-]*+[0-9]){7,14}(?![0-9])"
# only texts with more digits in a run than a number can have are looked at again
LONG_RUNS = {"card_in": r"[0-9](?:[\x20-]?[0-9]){16}", "phone_in": r"\+[0-9](?:[\x20().-]*+[0-9]){15}"}
# Context words by kind, and words that speak against any kind.
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "ip|address|host|server",
    "card": "card|visa|mastercard|amex|payment|credit|debit",
    "phone": "phone|call|tel|mobile|fax|whatsapp",
    "iban": "iban|bank|account|konto|transfer",
    "ssn": "ssn|social security",
}
CONTEXT |= {"card_in": CONTEXT["card"], "phone_in": CONTEXT["phone"]}
AGAINST = "version|example|order|invoice|isbn|sample"
CONTEXT_STEP = 0.2


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits: from the right, every second digit doubled, nines cast out."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            (c.cast("int") * 2) % 10 + F.when(c.cast("int") >= 5, 1).otherwise(0))),
        F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def mod97(match: Column) -> Column:
    """ISO 7064 mod-97 of an account number: first four characters to the end, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(
        F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97)))
    return rest == 1


def valid(kind: str, match: Column) -> Column:
    """Whether a proposed match of ``kind`` passes its check."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return S.let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def iban_pattern(text: Column) -> Column:
    """The pattern of the account numbers of ``text`` that pass their check; null if there are none."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(IBAN), F.lit(1)), lambda m: valid("iban", m)))
    return S.let(found, lambda m: F.when(F.size(m) > 0, F.concat(
        F.lit(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"), F.array_join(m, "|"), F.lit(")(?![A-Za-z0-9])"))))


PART = "array<struct<start:int,match:string>>"


def parts(kind: str, run: Column) -> Column:
    """The numbers inside a run that fails the check of its base kind, by start: ``array<struct<start, match>>``."""
    if kind == "phone_in":
        m = F.regexp_extract(run, PHONE_PART, 0)
        return F.when(m != "", F.array(F.struct(F.lit(0).alias("start"), m.alias("match")))).otherwise(F.array()).cast(PART)

    def number(s: Column) -> Column:
        # 16 to 19 digits and at most four separators
        tail = F.substr(run, s["start"] + 1, F.lit(24))
        forms = F.array(*[F.regexp_extract(tail, f"^{p}", 0) for p in CARD_LAYOUTS])
        good = F.filter(forms, lambda m: (m != "") & valid("card", m))
        return F.struct(s["start"].alias("start"), F.get(good, F.lit(0)).alias("match"))

    found = F.transform(S.find(run, CARD_START), number)
    return F.filter(found, lambda p: p["match"].isNotNull()).cast(PART)


def _inside(text: Column, kind: str) -> Column:
    """Spans of ``parts`` with their places in ``text`` and the context of their run."""
    base = kind.removesuffix("_in")
    source = F.when(text.rlike(LONG_RUNS[kind]), text).otherwise("")
    failed = F.filter(S.find(source, PATTERNS[base]), lambda s: ~valid(base, s["match"]))
    found = F.flatten(F.transform(failed, lambda s: F.transform(parts(kind, s["match"]), lambda p: F.struct(
        (s["start"] + p["start"]).alias("start"), p["match"].alias("match"), s["before"].alias("before"),
        s["after"].alias("after")))))
    if kind == "phone_in":
        return found
    return S.let(found, lambda w: F.when(F.size(w) == 0, w).otherwise(S.let(pii_spans(text, "iban", 0.0), lambda b: F.filter(
        w, lambda s: ~F.exists(b, lambda t: (t["start"] < s["start"] + F.length(s["match"])) & (s["start"] < t["end"]))))))


def _cut(run: Column, kind: str, tag: str) -> Column:
    """``run`` with its ``parts`` replaced by ``tag``; parts that overlap share one. Ends rise with starts."""
    def rebuilt(w: Column) -> Column:
        end = lambda i: F.when(i > 0, w[i - 1]["start"] + F.length(w[i - 1]["match"])).otherwise(0)
        pieces = F.transform(w, lambda p, i: F.when((i > 0) & (p["start"] < end(i)), F.lit("")).otherwise(
            F.concat(F.substr(run, end(i) + 1, p["start"] - end(i)), F.lit(tag))))
        return F.concat(F.array_join(pieces, ""), F.substr(run, end(F.size(w)) + 1))

    return S.let(parts(kind, run), lambda w: F.when(F.size(w) == 0, run).otherwise(rebuilt(w)))


def _score(kind: str, span: Column) -> Column:
    near = F.lower(F.concat(span["before"], F.lit(" "), span["after"]))
    up = F.when(near.rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})"), CONTEXT_STEP).otherwise(0.0)
    down = F.when(near.rlike(rf"(?<![a-z])(?:{AGAINST})"), CONTEXT_STEP).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(SCORES[kind]) + up - down), 2)


def pii_spans(text: Column, kind: str, min_score: float = 0.5) -> Column:
    """Confirmed spans of one kind with their score: ``array<struct<start, end, match, score>>``."""
    text = F.coalesce(text, F.lit(""))
    # a byte search rules most texts out before the regular expression
    need = {"email": "@", "phone": "+", "ssn": "-"}.get(kind)
    source = F.when(F.contains(text, F.lit(need)), text).otherwise("") if need else text
    if kind in INSIDE:
        ok = _inside(text, kind)
    elif kind == "iban":
        ok = S.let(iban_pattern(text), lambda p: F.when(p.isNull(), F.array().cast(S.EMPTY)).otherwise(S.find(text, p)))
    else:
        ok = F.filter(S.find(source, PATTERNS[kind]), lambda s: valid(kind, s["match"]))
    scored = F.transform(ok, lambda s: F.struct(
        s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("match"),
        _score(kind, s).alias("score")))
    return scored if kind not in ADDED else F.filter(scored, lambda s: s["score"] >= min_score)


def find_pii(docs: DataFrame, text_col: str = "text", prefix: str = "pii_", min_score: float = 0.5) -> DataFrame:
    """``docs`` plus one array column ``<prefix><kind>`` of confirmed spans for each kind."""
    return docs.select("*", *[pii_spans(F.col(text_col), k, min_score).alias(f"{prefix}{k}") for k in KINDS])


def redact(text: Column, min_score: float = 0.5) -> Column:
    """``text`` with every confirmed span replaced by ``[KIND]``. A null text stays null.

    Kinds are replaced one after another, those that may contain another first (an address holds
    dotted numbers, an account number holds digit runs), each in one linear rebuild of the text. Cards inside
    failed runs go before phones, whose runs they lengthen."""
    out = text
    for kind in ("email", "iban", "card_in", "phone", "card", "ip"):
        if kind == "card_in":
            cut = lambda m: F.when(valid("card", m), m).otherwise(_cut(m, "card_in", "[CARD]"))
            out = S.let(out, lambda t: F.when(t.rlike(LONG_RUNS["card_in"]), S.replace_matches(
                t, PATTERNS["card"], lambda m: F.lit(False), "", cut)).otherwise(t))
        elif kind == "phone":
            out = S.replace_matches(out, PATTERNS[kind], lambda m: valid("phone", m), "[PHONE]",
                                    lambda m: _cut(m, "phone_in", "[PHONE]"))
        elif kind == "iban":
            out = S.let(out, lambda t: S.let(iban_pattern(t), lambda p: F.when(
                p.isNotNull(), F.regexp_replace(t, p, F.lit("[IBAN]"))).otherwise(t)))
        else:
            out = S.replace_matches(out, PATTERNS[kind], lambda m, k=kind: valid(k, m), f"[{kind.upper()}]")

    def scored(t: Column) -> Column:    # the one kind that needs its context word
        return S.let(pii_spans(t, "ssn", min_score), lambda w: F.when(F.size(w) > 0, S.replace_matches(
            t, PATTERNS["ssn"], lambda m: F.exists(w, lambda s: s["match"] == m), "[SSN]")).otherwise(t))

    return S.let(out, scored)


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans."""
    found = find_pii(docs.select("doc_id", "text"))

    def joined(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.concat(*[S.label(k, F.col(f"pii_{k}")) for k in kinds]), ",")

    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(BASE), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"))
