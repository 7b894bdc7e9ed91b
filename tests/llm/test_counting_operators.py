"""Runs, collocations and exact duplicates against plain Python on small awkward tables."""
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import reference as R
from tests.llm.test_text_operators import ODD, key, table
from themelens.llm import collocations, exact_duplicates, periodic_runs

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- runs -------------------------------------------------------------------------------------------------

def plain_runs(w):
    best = {}
    for q in range(len(w) // 4, 0, -1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best[i, j - i + q] = q
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda x: (x[0], x[2]))


def plain_digest(doc, text):
    w = R.spaced_words(text)
    n = len(w)
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    return (doc, len(runs), s, m, q, 1000 * m // q if runs else None, R.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            R.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def _words(kind, n):
    if kind == 0:
        return [str(random.randrange(2)) for _ in range(n)]
    if kind == 1:
        unit = [str(random.randrange(4)) for _ in range(random.randrange(1, 9))]
        return ["x"] * 3 + (unit * 30)[:n] + [str(random.randrange(4)) for _ in range(5)] + (unit * 9)[:n // 2]
    if kind == 2:
        return ["same"] * n
    return [f"w{random.randrange(30)}" for _ in range(n)]


@pytest.mark.parametrize("slice_bytes", [4 << 20, 300])
def test_runs_digest(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(periodic_runs, "SLICE_BYTES", slice_bytes)
    random.seed(11)
    rows = ODD + [(i, " ".join(_words(i % 4, random.randrange(0, 120)))) for i in range(160)]
    rows += [(5000, "long " * 4000), (5000, "long " * 4000), (5001, "a b c " * 900), (5002, "é b c\x0bd " * 7)]
    got = periodic_runs.runs_digest(table(spark, rows, True)).collect()
    assert key(tuple(g) for g in got) == key(plain_digest(d, t) for d, t in rows)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows)


def test_runs_keep_their_place_and_text(spark):
    rows = [(1, "go now now now now now now stop"), (2, None), (3, "one two")]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(table(spark, rows)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 6, 1)] and got[1].collapsed == "go now stop" and got[1].n_words == 8
    assert got[2].runs == [] and got[2].collapsed == "" and got[3].collapsed == "one two"
    assert periodic_runs.runs_digest(table(spark, rows).limit(0)).count() == 0


def test_nested_runs_of_two_periods():
    inner = ["a", "a", "a", "a", "a", "a", "b"]
    words = inner * 5
    ids = np.array([hash(x) & 0xFFFF for x in words], np.uint64)
    assert [tuple(x) for x in periodic_runs.find_runs(ids, np.array([0, len(ids)])).tolist()] == plain_runs(words)


# -- collocations -----------------------------------------------------------------------------------------

def plain_collocations(rows, least, top):
    import re
    pieces = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            pieces.setdefault(lang or "und", []).append(re.findall(r"[^\x20\x09]+", piece))
    out = []
    for lang, ps in pieces.items():
        n = sum(map(len, ps))
        f = Counter(tuple(p[i:i + k]) for p in ps for k in range(1, 6) for i in range(len(p) - k + 1))
        good = [p for p, c in f.items() if len(p) > 1 and c >= least]
        found = []
        for p in good:
            if any(len(q) > len(p) and f[q] >= f[p] and any(q[i:i + len(p)] == p for i in range(len(q))) for q in good):
                continue
            score, cut = min((1000 * f[p] * n // (f[p[:c]] * f[p[c:]]), c) for c in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p], f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, p.decode(), a, x, r, n, -s) for i, (s, _, p, a, x, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def _prose(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "the", "Of"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    fixed = ["alpha beta gamma", "one two three four five six seven", "the Of the", "zz zz zz zz"]
    rows = [(None, None), ("en", ""), (None, "a b. a b! a b\na\tb a,b"), ("xx", ".,;"), ("yy", "lonely")]
    for i in range(150):
        words = rng.choices(vocab, weights, k=rng.randrange(1, 60))
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), rng.choice(fixed))
        rows.append((["en", "de", None][i % 3], "".join(w + rng.choice([" ", " ", " ", "  ", ", ", ".\n"]) for w in words)))
    return rows + rows[20:40] * 3


@pytest.mark.parametrize("wave, sent, top", [(5, 2_000_000, 2000), (7, 4, 25), (1000, 2_000_000, 3)])
def test_collocations(spark, monkeypatch, wave, sent, top):
    monkeypatch.setattr(collocations, "SENT", sent)
    rows = _prose(wave)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS p", "'x' AS words", "2 AS n", "3 AS rank")
    got = collocations.collocations(docs, wave=wave, top=top, least=4).collect()
    want = plain_collocations(rows, 4, top)
    assert want and sorted(tuple(g) for g in got) == want


def test_collocations_stop_early_and_on_nothing(spark, monkeypatch):
    waves = []
    count = collocations.count_wave
    monkeypatch.setattr(collocations, "count_wave", lambda *a: waves.append(a[3:5]) or count(*a))
    rows = [("en", "rare pair. " * 4 + "of the of a the of " * 400)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(docs, wave=2, top=1, least=4).collect()
    assert [(g.phrase, g.a, g.l, g.r) for g in got] == [("rare pair", 4, 4, 4)] and waves == [(4, 8)]
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs).where("phrase like '%rare%'").count() == 0


# -- exact duplicates -------------------------------------------------------------------------------------

def plain_duplicates(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(d)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return [(d, keep[t], len(groups[t]), d == keep[t], R.sha(t)) for d, t in ((d, (t or "").translate(FOLD)) for d, t in rows)]


def _copies():
    rng = random.Random(2)
    rows = ODD + [(i, rng.choice(["Same text", "same TEXT", "École", "école", "ÉCOLE", "x" * 5000, "other"])) for i in range(200)]
    return rows + [(1000 + i, f"single {i}") for i in range(200)] + [(2000 + i, "HOT " * 50) for i in range(400)] + [(5, "same text"), (199, "other")]


@pytest.mark.parametrize("bucket_bytes, max_buckets, weak", [(1 << 18, 1 << 16, False), (600, 1 << 16, False), (600, 4, False), (300, 1 << 16, True)])
def test_exact_duplicates(spark, monkeypatch, bucket_bytes, max_buckets, weak):
    """Also with buckets that split, keys that need pages, and keys that collide."""
    monkeypatch.setattr(exact_duplicates, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(exact_duplicates, "MAX_BUCKETS", max_buckets)
    if weak:
        monkeypatch.setattr(exact_duplicates, "text_key", lambda t: F.shiftleft(F.octet_length(t).cast("long") % 3, 60))
    rows = _copies()
    got = exact_duplicates.exact_duplicates_digest(table(spark, rows, True)).collect()
    assert key(tuple(g) for g in got) == key(plain_duplicates(rows))


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(i << 52, 10) for i in range(100)] + [(-1, 5000), (1 << 62, 10)], "key long, bytes long")
    slots = exact_duplicates.directory(keys, 300, 12).collect()
    sizes = Counter()
    for r in keys.collect():
        slot = next(s for s in slots if s.slot == (r.key % (1 << 64)) >> 52)
        sizes[slot.bucket] += r.bytes
        assert slot.bucket == slot.slot >> (12 - slot.local_depth) << (12 - slot.local_depth)
    assert sorted(sizes.values())[-1] == 5000 and all(v <= 300 for v in sorted(sizes.values())[:-1])
    assert len(sizes) >= 5


def test_drop_exact_duplicates(spark):
    rows = _copies()
    docs = table(spark, rows, True).withColumn("_row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("bucket", F.lit("b"))
    kept = exact_duplicates.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    want = {(R.sha((t or "").translate(FOLD)), k) for (_, t), (_, k, *_) in zip(rows, plain_duplicates(rows))}
    got = [(R.sha((r.text or "").translate(FOLD)), r.doc_id) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    assert exact_duplicates.drop_exact_duplicates(docs.limit(0)).count() == 0
    assert exact_duplicates.exact_duplicates_digest(docs.limit(0)).count() == 0
