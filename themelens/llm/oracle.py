"""DuckDB SQL for the operators that SQL can express. The others (model fitting, tokenising, sharding with
CRC-32, inferred grammars) are tested against plain Python forms.

DuckDB's regular expressions are linear, so the plain patterns of the contracts are used here, without the
look-behinds and possessive quantifiers of the Spark forms. The SQL of ``op6_pii`` lists the four base kinds
and the numbers inside failed runs: the documents of the test tables hold none of the other added kinds.
"""

from __future__ import annotations

from themelens.llm import licenses as L

UPPER, LOWER = L.UPPER, L.LOWER


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lower(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"


# -- op1 ---------------------------------------------------------------------------------------------------

def _canonical(x: str) -> str:
    out = f"replace(replace({_lower(x)}, '(c)', 'copyright '), '©', 'copyright ')"
    for _ in range(2):
        out = f"regexp_replace({out}, {lit(L.COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {lit(L.PUNCTUATION)}, ' ', 'g')"
    for a, b in L.SPELLINGS:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return (f"list_filter(list_transform(string_split({out}, chr(10)), lambda s: trim(s)), lambda s: s <> '')")


OP1 = f"""
WITH known AS (
    SELECT sha256(array_to_string({_canonical('t')}, ' ')) AS digest, min(license) AS license
    FROM (VALUES {', '.join(f'({lit(k)}, {lit(t)})' for k, t in L.KNOWN)}) AS v(license, t) GROUP BY 1),
d AS (SELECT doc_id, {_canonical('text')} AS lines FROM documents),
whole AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS canonical_sha256 FROM d),
hits AS (SELECT doc_id, count(*) AS n, list(DISTINCT license) AS names
         FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d) JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.canonical_sha256, k.license AS text_license, coalesce(h.n, 0) AS n_notice_lines,
       array_to_string(list_sort(list_distinct(list_filter(
           list_concat(coalesce(h.names, []), [k.license]), lambda x: x IS NOT NULL))), ',') AS licenses
FROM whole w LEFT JOIN hits h ON h.doc_id = w.doc_id LEFT JOIN known k ON k.digest = w.canonical_sha256"""

# -- op5 ---------------------------------------------------------------------------------------------------

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP5 = f"""
WITH items AS (SELECT item_id, regexp_extract_all({_lower('text')}, {_ALNUM}) AS w FROM benchmark),
wins AS (
    SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
          FROM items WHERE len(w) > 0)),
wplaces AS (        -- every place of a window, by row of the benchmark
    SELECT r, n, p AS q, array_to_string(w[p:p + n - 1], ' ') AS win
    FROM (SELECT r, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
          FROM (SELECT row_number() OVER () AS r, w FROM items) WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_ALNUM}) AS w FROM documents),
places AS (
    SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
          FROM docs JOIN (SELECT DISTINCT n FROM wins) ON len(w) >= n)),
found AS (SELECT doc_id, item_id, places.n AS n, p FROM places JOIN wins ON wins.n = places.n AND wins.win = places.win),
runs AS (           -- a longest match is a run of windows at one distance between document and item
    SELECT doc_id, n + count(*) - 1 AS words
    FROM (SELECT doc_id, r, n, p - q AS gap, p - row_number() OVER (PARTITION BY doc_id, r, n, p - q ORDER BY p) AS run
          FROM places JOIN wplaces USING (n, win))
    GROUP BY doc_id, r, n, gap, run),
longest AS (SELECT doc_id, max(words) AS longest_match FROM runs GROUP BY doc_id),
covered AS (
    SELECT doc_id, string_agg((a - 1) || ':' || z, ',' ORDER BY a) AS spans
    FROM (SELECT doc_id, min(x) AS a, max(x) AS z
          FROM (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS run
                FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS x FROM found))
          GROUP BY doc_id, run)
    GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest_match, 0) AS longest_match, coalesce(spans, '') AS spans
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN longest USING (doc_id)
     LEFT JOIN covered USING (doc_id)"""

# -- op6 ---------------------------------------------------------------------------------------------------

_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
     r"regexp_full_match(m, '(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", """length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(
        range(1, length(dg) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr(dg, length(dg) - j + 1, 1) AS INT)
        ELSE (CAST(substr(dg, length(dg) - j + 1, 1) AS INT) * 2) % 10
             + CAST(substr(dg, length(dg) - j + 1, 1) AS INT) // 5 END)) % 10 = 0"""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(dg) BETWEEN 8 AND 15"),
)


def _pii_runs(pattern: str) -> str:
    return f"""
         (SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS dg,
                 CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
          FROM (SELECT doc_id, ms, g, i, ms[i] AS m
                FROM (SELECT doc_id, ms, g, unnest(range(1, len(ms) + 1)) AS i
                      FROM (SELECT doc_id, regexp_extract_all(text, {lit(pattern)}) AS ms,
                                   string_split_regex(text, {lit(pattern)}) AS g FROM documents WHERE text IS NOT NULL))))"""


def _pii_spans(rank: int, kind: str, pattern: str, valid: str) -> str:
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(m) AS e FROM {_pii_runs(pattern)} WHERE {valid}"""


# runs that fail: groups of digits, and from each group on a card of one of the layouts
_CARD, _PHONE = _PII[2], _PII[3]
_ISSUER = "^(2[2-7]|3|4|5[1-5]|6)"
_PII_INSIDE = (f"""
    SELECT doc_id, 6 AS rank, 'card_in' AS kind, s + o AS s, s + o + length(c) AS e
    FROM (SELECT doc_id, s, o, min_by(c, length(c)) AS c FROM (
        SELECT doc_id, s, o, c, regexp_replace(c, '[^0-9]', '', 'g') AS dg
        FROM (SELECT doc_id, s, length(array_to_string(g[1:i], ' ')) - length(g[i]) AS o,
                     unnest([CASE WHEN length(g[i]) BETWEEN 16 AND 19 THEN substr(m, o + 1, length(g[i])) END,
                             CASE WHEN lens[i:i + 3] = [4, 4, 4, 4] THEN substr(m, o + 1, 19) END,
                             CASE WHEN lens[i:i + 3] = [4, 4, 4, 4] AND lens[i + 4] < 4
                                  THEN substr(m, o + 1, 20 + lens[i + 4]) END]) AS c
              FROM (SELECT *, list_transform(g, lambda x: CAST(length(x) AS INT)) AS lens, unnest(range(1, len(g) + 1)) AS i
                    FROM (SELECT doc_id, s, m, string_split_regex(m, '[ -]') AS g
                          FROM {_pii_runs(_CARD[1])} WHERE length(dg) > 16 AND NOT ({_CARD[2]}))))
        WHERE c IS NOT NULL AND regexp_matches(c, '{_ISSUER}')) WHERE {_CARD[2]} GROUP BY doc_id, s, o)""", f"""
    SELECT doc_id, 7 AS rank, 'phone_in' AS kind, s, s + length(c) AS e
    FROM (SELECT doc_id, s, regexp_extract(m || ' ', '^(\\+[0-9](?:[ ().-]*[0-9]){{7,14}})[^0-9]', 1) AS c
          FROM {_pii_runs(_PHONE[1])} WHERE length(dg) > 15) WHERE c <> ''""")


OP6 = f"""
WITH spans AS ({' UNION ALL '.join([_pii_spans(k, *x) for k, x in enumerate(_PII)] + list(_PII_INSIDE))}),
one AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (rank < 4) AS base, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in _PII)},
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, *_ in _PII)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN one ON one.doc_id = d.doc_id"""

# -- op8 ---------------------------------------------------------------------------------------------------

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

# -- op9, op10 -----------------------------------------------------------------------------------------------

_SPACED = r"'[^\x20\x09-\x0D]+'"
OP9 = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS win
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM docs WHERE len(w) >= 35)),
twice AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM wins JOIN twice USING (win)),
kept AS (SELECT u.doc_id, count(*) AS n, string_agg(u.word, ' ' ORDER BY u.q) AS s
         FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM docs) u
         LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.q = u.q WHERE g.q IS NULL GROUP BY u.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

OP10 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_SPACED}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS x
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
           FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(node, label) AS (SELECT doc_id, doc_id FROM docs UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node),
comp AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d JOIN comp ON comp.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


# -- op11 --------------------------------------------------------------------------------------------------
# equal words q apart, in stretches (islands) of every q; CRC-32 by its bitwise definition

_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda h, b: list_reduce(list_prepend(xor(h, b), list_transform(range(8), lambda z: CAST(z AS BIGINT))), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
OP11 = f"""
WITH docs AS (SELECT doc_id, w, len(w) AS n, {_CRC} AS h FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents)),
plan AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM docs),
tail AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM plan),
t AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS x
      FROM (SELECT *, unnest(range(n)) AS i FROM tail)),
same AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM t u JOIN t v ON u.doc_id = v.doc_id AND u.x = v.x AND v.i > u.i
         WHERE 4 * (v.i - u.i) <= u.n),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island
            HAVING m >= 6 AND m >= 4 * q),
runs AS (SELECT doc_id, s, m, min(q) AS q FROM stretch GROUP BY doc_id, s, m),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.i) AS c FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id),
one AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS r,
               arg_min({{'s': s, 'm': m, 'q': q}}, {{'a': -m, 'b': s, 'c': q}}) AS best FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.m AS length, best.q AS period,
       1000 * best.m // best.q AS exponent_milli, sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM docs LEFT JOIN one USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# -- op12 --------------------------------------------------------------------------------------------------
# all frequent phrases, grown from frequent ones; survival by all longer candidates


def _grown(k: int) -> str:
    return f"""
o{k} AS MATERIALIZED (SELECT a.lang, a.piece, a.i, a.p || ' ' || b.p AS p FROM o{k - 1} a JOIN f{k - 1} f ON f.lang = a.lang AND f.p = a.p
       JOIN o1 b ON b.piece = a.piece AND b.i = a.i + {k - 1}),
f{k} AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM o{k} GROUP BY lang, p HAVING count(*) >= 100)"""


OP12 = rf"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, w FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_lower('text')}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents)),
o1 AS MATERIALIZED (SELECT lang, piece, unnest(range(len(w))) AS i, unnest(w) AS p FROM pieces WHERE len(w) > 0),
f1 AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM o1 GROUP BY lang, p HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM o1 GROUP BY lang),
{','.join(_grown(k) for k in range(2, 6))},
f AS MATERIALIZED (SELECT *, len(string_split(p, ' ')) AS k FROM ({' UNION ALL '.join(f'SELECT * FROM f{k}' for k in range(1, 6))})),
inside AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS p, max(f) AS top
           FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM (SELECT lang, f, string_split(p, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2))
           GROUP BY ALL),
alive AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, p) WHERE k > 1 AND (top IS NULL OR top < f)),
cuts AS (SELECT c.lang, c.p, c.f AS a, n, c.cut, l.f AS l, r.f AS r,
                CAST((CAST(1000 AS HUGEINT) * c.f * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
         FROM (SELECT *, string_split(p, ' ') AS w, unnest(range(1, k)) AS cut FROM alive) c JOIN n USING (lang)
         JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.w[1:c.cut], ' ')
         JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.w[c.cut + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM worst QUALIFY rank <= 2000"""

# -- op13 --------------------------------------------------------------------------------------------------

OP13 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_lower('text')} AS t FROM documents) WINDOW w AS (PARTITION BY t)"""


def oracle() -> dict[str, str]:
    return {"op1_licenses": OP1, "op5_decontamination": OP5, "op6_pii": OP6, "op8_top_k": OP8, "op9_substrings": OP9,
            "op10_near_duplicates": OP10, "op11_periodic_runs": OP11, "op12_collocations": OP12,
            "op13_exact_duplicates": OP13}
