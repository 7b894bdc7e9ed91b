"""License scans by canonical digest lookup.

A text is brought to a canonical form (case, punctuation and white space, copyright lines, equivalent
spellings), hashed, and joined by hash to the digests of known licence texts. The whole text is looked up,
and so is each of its lines, because notices stand on a line of their own. A line is hashed only if a known
entry has its canonical length; no other line can match.

Known are the notices and short texts of ``KNOWN`` and the whole texts of ``license_texts``.

Native: Spark SQL functions only. The known table is a constant of some thousand short rows and is broadcast; the
join of line hits back to documents moves ids and digests, never text.

Defined cases: null text counts as empty; its canonical form is empty and matches nothing. Documents that
repeat id and text get equal answers; null ids are kept. Texts and lines of any length are hashed whole.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.llm import spans as S
from themelens.llm.license_texts import whole_texts
from themelens.session import stage

# Equivalent spellings, applied to the canonical text in this order.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"),
    ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("sub license", "sublicense"), ("whilst", "while"), ("wilful", "willful"), ("https ", "http "),
)
# Public licence notices and short licence texts, (id, text).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A line that starts with a copyright sign or word and holds a year, or says that all rights are reserved.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright [^\n]*[0-9]{4}[^\n]*|all rights reserved[^a-z0-9\n]*)"
# ASCII punctuation, control characters and spaces, but not the line feed.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """The non-empty lines of a text in canonical form."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.replace(F.replace(out, F.lit("(c)"), F.lit("copyright ")), F.lit("©"), F.lit("copyright "))
    for _ in range(2):      # twice: two such lines in a row share the line feed between them
        out = S.let(out, lambda t: F.when(F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("all rights reserved")),
                                          F.regexp_replace(t, COPYRIGHT_LINE, "\n")).otherwise(t))
    out = F.regexp_replace(out, PUNCTUATION, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``(digest, license, n_chars)`` of the known texts and the whole texts, one row per digest."""
    rows = spark.createDataFrame([*known], "license string, text string")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    more = spark.createDataFrame(whole_texts(), "digest string, license string, n_chars int")
    return rows.select(F.sha2(whole, 256).alias("digest"), "license", F.length(whole).alias("n_chars")).unionByName(more).groupBy(
        "digest").agg(F.min("license").alias("license"), F.min("n_chars").alias("n_chars"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """Per document: the digest of its canonical text, the licence that is its whole text (or null), the
    number of lines that are known notices, and the licences found, sorted and comma-joined."""
    table = stage(known_licenses(docs.sparkSession, known), "known-licenses")
    sizes = [r[0] for r in table.select("n_chars").distinct().collect()]     # a constant's worth of rows
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    hashed = F.transform(F.filter("lines", lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256))
    found = stage(lines.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("canonical_sha256"),
                               hashed.alias("digests")), "digests")
    some = found.where(F.size("digests") > 0).dropDuplicates(["doc_id", "canonical_sha256"])
    hits = some.select("doc_id", "canonical_sha256", F.explode("digests").alias("digest")).join(
        F.broadcast(table), "digest").groupBy("doc_id", "canonical_sha256").agg(
        F.count("*").alias("n"), F.collect_set("license").alias("names"))     # at most as many as are known
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("canonical_sha256").alias("hit_digest"), "n", "names")
    whole = table.select(F.col("digest").alias("canonical_sha256"), F.col("license").alias("text_license"))
    out = found.join(F.broadcast(whole), "canonical_sha256", "left").join(
        hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("canonical_sha256") == F.col("hit_digest")), "left")
    names = F.array_union(F.coalesce("names", F.array().cast("array<string>")),
                          F.filter(F.array("text_license"), lambda x: x.isNotNull()))
    return out.select("doc_id", "canonical_sha256", "text_license", F.coalesce("n", F.lit(0)).cast("long").alias("n_notice_lines"),
                      F.array_join(F.array_sort(names), ",").alias("licenses"))
