"""DuckDB oracle SQL, one string per registered query. Same names and aliases as ``catalog``.

DuckDB's RE2 has no ``(?U)``; its ASCII ``\\b \\d \\s`` agree with Java's Unicode classes on the
driver's documents (SURVEY §2.3), and non-ASCII edges are tested on literal fixtures instead.
"""

from __future__ import annotations

from themelens import constants as C
from themelens.plans.catalog import DENSITY_EPS_WEEK, DRIVER_GROUPS
from themelens.sources.testdata import SQL_VIEWS, sql_with

_sql: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scrub_sql(x: str) -> str:
    e = f"regexp_replace({x}, {lit(C.EMAIL_PATTERN)}, {lit(C.EMAIL_MASK)}, 'g')"
    p = f"regexp_replace({e}, {lit(C.PHONE_PATTERN)}, {lit(C.PHONE_MASK)}, 'g')"
    return f"regexp_replace({p}, {lit(C.CARD_PATTERN)}, {lit(C.CARD_MASK)}, 'g')"


def group_sql(x: str, groups=DRIVER_GROUPS) -> str:
    whens = []
    for i, words in enumerate(groups):
        cond = " OR ".join(f"contains(lower({x}), {lit(w)})" for w in words)
        whens.append(f"WHEN {cond} THEN {i}")
    return f"(CASE {' '.join(whens)} ELSE {len(groups)} END)"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(C.TOKEN_PATTERN)})"


def title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), "
            f"lambda p: (CASE WHEN p[1] = 'ß' THEN 'Ss' ELSE upper(p[1]) END) || lower(p[2:])), '')")


def norm_ws_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


STOP_LIST = "(" + ", ".join(lit(w) for w in dict.fromkeys(C.STOP_WORDS)) + ")"
FMAP_VALUES = "(VALUES " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in C.FUNCTIONAL_MAP) + ") AS fm(map_word, mapped_name)"

SQL_VIEWS["scrubbed"] = f"""
    SELECT * REPLACE ({scrub_sql('content')} AS content) FROM reviews"""
SQL_VIEWS["grouped"] = f"""
    SELECT *, {group_sql('content')} AS cluster_id FROM scrubbed"""
SQL_VIEWS["clustered"] = f"""
    SELECT * REPLACE (CASE WHEN cluster_id = {len(DRIVER_GROUPS)} THEN -1 ELSE cluster_id END AS cluster_id)
    FROM grouped"""
SQL_VIEWS["top_theme_words_of_grouped"] = f"""
    WITH sizes AS (
        SELECT product_id, iso_week, cluster_id, count(*) AS size, min(ord) AS min_ord
        FROM grouped GROUP BY ALL),
    top AS (
        SELECT *, row_number() OVER (PARTITION BY product_id, iso_week ORDER BY size DESC, min_ord) AS rank
        FROM sizes QUALIFY rank <= {C.TOP_THEMES}),
    toks AS (
        SELECT product_id, iso_week, cluster_id, ord, unnest(t) AS word, unnest(range(len(t))) AS tok_pos
        FROM (SELECT g.*, {tokens_sql('content')} AS t FROM grouped g
              SEMI JOIN top USING (product_id, iso_week, cluster_id))),
    counts AS (
        SELECT product_id, iso_week, cluster_id, word, count(*) AS count,
               min({{'ord': ord, 'tok_pos': tok_pos}}) AS first_pos
        FROM toks WHERE word NOT IN {STOP_LIST} GROUP BY ALL),
    terms AS (
        SELECT *, row_number() OVER (PARTITION BY product_id, iso_week, cluster_id
                                     ORDER BY count DESC, first_pos) AS term_rank
        FROM counts QUALIFY term_rank <= {C.TOP_TERMS})
    SELECT t.product_id, t.iso_week, t.rank, t.cluster_id, t.size, m.term_rank, m.word, m.count
    FROM top t JOIN terms m USING (product_id, iso_week, cluster_id)"""
_DEPS_EXTRA = {"scrubbed": ["reviews"], "grouped": ["scrubbed"], "clustered": ["grouped"],
               "top_theme_words_of_grouped": ["grouped"]}

from themelens.sources import testdata as _td  # noqa: E402

_td._DEPS.update(_DEPS_EXTRA)


def register(name: str, body: str, *views: str) -> None:
    _sql[name] = sql_with(body, *views)


def oracle() -> dict[str, str]:
    return dict(_sql)


register("top_theme_words", "SELECT * FROM top_theme_words_of_grouped", "top_theme_words_of_grouped")

# ------------------------------------------------------------------------------------------------
# S1-S9
# ------------------------------------------------------------------------------------------------
register("scrub_pii", f"SELECT review_id, {scrub_sql('content')} AS content FROM reviews0", "reviews0")
register("iso_week", "SELECT event_id, strftime(ts, '%G-W%V') AS iso_week FROM events")
register("report_anchor", """
    SELECT DISTINCT product_id, iso_week, 'pulse-' || lower(product_id) || '-' || iso_week AS anchor
    FROM reviews""", "reviews")
register("tokenise", f"""
    SELECT review_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM (SELECT review_id, {tokens_sql('content')} AS t FROM reviews0)""", "reviews0")
register("title_word", f"""
    SELECT word, {title_sql('word')} AS title
    FROM (SELECT DISTINCT unnest({tokens_sql('content')}) AS word FROM reviews0)""", "reviews0")
register("extract_json", """
    SELECT conv_id, turn, regexp_extract(CASE WHEN turn % 3 = 0
        THEN 'So:' || chr(10) || to_json({'conv_id': conv_id, 'said': {'role': role, 'text': text}}) || chr(10) || 'Done.'
        ELSE text END, '(?s)\\{.*\\}') AS json_text FROM conversations""")
register("contains_ci", """
    SELECT review_id, contains(lower(content), lower('THING')) AS has_thing,
           contains(lower(content), lower(upper(substring(user_name, 1, 5)))) AS has_user
    FROM reviews0""", "reviews0")
register("keyword_group", f"""
    SELECT review_id, {group_sql('content')} AS grp, {group_sql('content', C.DEFAULT_KEYWORD_GROUPS)} AS default_grp
    FROM reviews0""", "reviews0")
register("normalise_ideas", f"""
    SELECT review_id, i - 1 AS idea_idx,
           CASE WHEN i IN (1, 4) THEN {lit(C.STRING_IDEA_TITLE)} ELSE user_name END AS title,
           CASE i WHEN 1 THEN content WHEN 2 THEN review_id WHEN 4 THEN '{{menu}} is hidden' ELSE NULL END AS description
    FROM reviews0, range(1, 5) r(i)""", "reviews0")

# ------------------------------------------------------------------------------------------------
# F1-F9
# ------------------------------------------------------------------------------------------------
AS_OF_SQL = "TIMESTAMP '2024-01-29 00:00:00'"
register("review_window", f"""
    SELECT review_id, product_id, review_ts FROM reviews0
    WHERE review_ts >= {AS_OF_SQL} - INTERVAL 14 DAYS""", "reviews0")
register("parse_review_fields", f"""
    SELECT review_id,
           CASE WHEN CAST(review_id AS BIGINT) % 11 = 0 THEN 0 ELSE rating END AS rating,
           CASE CAST(review_id AS BIGINT) % 7
                WHEN 0 THEN epoch_us({AS_OF_SQL})
                WHEN 1 THEN epoch_us(review_ts) + CAST(7 * 3600 AS BIGINT) * 1000000
                WHEN 3 THEN epoch_us(date_trunc('day', review_ts))
                ELSE epoch_us(review_ts) END AS review_us
    FROM reviews0""", "reviews0")
register("flatten_newlines", "SELECT review_id, replace(content, chr(10), ' ') AS content FROM reviews0", "reviews0")
register("normalise_whitespace", f"SELECT review_id, {norm_ws_sql('content')} AS content FROM reviews0", "reviews0")
register("drop_noise", """
    WITH c AS (SELECT * REPLACE (CASE WHEN product_id = 'src1' THEN -1 ELSE cluster_id END AS cluster_id)
               FROM clustered),
    f AS (SELECT product_id, iso_week, max(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END) AS has FROM c GROUP BY ALL)
    SELECT product_id, iso_week, cluster_id, count(*) AS n
    FROM c JOIN f USING (product_id, iso_week)
    WHERE cluster_id <> -1 OR has = 0 GROUP BY ALL""", "clustered")
SQL_VIEWS["run_keys"] = "SELECT DISTINCT product_id, iso_week FROM reviews"
SQL_VIEWS["runs"] = """
    SELECT 'pulse-' || lower(product_id) || '-' || iso_week AS run_id, product_id, iso_week,
           CASE (CAST(substring(product_id, 4, 4) AS INT) + CAST(substring(iso_week, 7, 2) AS INT)) % 3
                WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'IN_PROGRESS' END AS status
    FROM run_keys"""
_td._DEPS.update({"run_keys": ["reviews"], "runs": ["run_keys"]})
register("runs_to_do", """
    SELECT product_id, iso_week FROM run_keys
    EXCEPT SELECT product_id, iso_week FROM runs WHERE status = 'COMPLETED'""", "runs")
register("nonempty_runs", """
    SELECT product_id, iso_week FROM run_keys""", "run_keys")
register("shorten", """
    SELECT review_id,
           CASE WHEN length(content) > 30 THEN substring(content, 1, 30) || '...' ELSE content END AS label30,
           CASE WHEN length(content) > 25 THEN substring(content, 1, 25) || '...' ELSE content END AS label25,
           substring(content, 1, 100) || '...' AS summary100
    FROM reviews0""", "reviews0")

# ------------------------------------------------------------------------------------------------
# A1-A16
# ------------------------------------------------------------------------------------------------
register("cluster_sizes", """
    SELECT product_id, iso_week, cluster_id, count(*) AS size, min(ord).review_id AS first_review_id
    FROM clustered GROUP BY ALL""", "clustered")
register("collect_clusters", f"""
    SELECT product_id, iso_week, cluster_id, ord.age AS age, review_id, content FROM grouped""", "grouped")
register("total_reviews", "SELECT product_id, iso_week, count(*) AS total_reviews FROM clustered GROUP BY ALL",
         "clustered")
SQL_VIEWS["term_counts"] = f"""
    SELECT product_id, iso_week, cluster_id, word, count(*) AS count,
           min({{'ord': ord, 'tok_pos': tok_pos}}) AS first_pos
    FROM (SELECT product_id, iso_week, cluster_id, ord, unnest(t) AS word, unnest(range(len(t))) AS tok_pos
          FROM (SELECT *, {tokens_sql('content')} AS t FROM grouped))
    WHERE word NOT IN {STOP_LIST} GROUP BY ALL"""
_td._DEPS["term_counts"] = ["grouped"]
register("term_counts", """
    SELECT product_id, iso_week, cluster_id, word, count, first_pos.ord.review_id AS first_review_id,
           first_pos.tok_pos AS first_tok_pos FROM term_counts""", "term_counts")
register("rating_kpis", """
    SELECT product_id, count(*) AS total_reviews, round(avg(rating), 6) AS avg_rating,
           round(avg(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) * 100, 6) AS positive_pct
    FROM reviews0 GROUP BY ALL""", "reviews0")
register("rating_distribution", """
    SELECT rating, count(*) AS count FROM reviews0 WHERE rating IS NOT NULL GROUP BY ALL""", "reviews0")
register("needs_fallback", """
    SELECT product_id, iso_week, n_clusters, n_clusters < 2 AS needs_fallback
    FROM (SELECT product_id, iso_week,
                 count(DISTINCT CASE WHEN c <> -1 THEN c END) AS n_clusters
          FROM (SELECT *, CASE WHEN iso_week = '2024-W02' THEN -1 WHEN iso_week = '2024-W03' THEN 0
                               ELSE cluster_id END AS c FROM clustered)
          GROUP BY ALL)""", "clustered")
register("clustering_coverage", """
    SELECT product_id, iso_week, round(avg(CASE WHEN cluster_id <> -1 THEN 1 ELSE 0 END), 6) AS coverage
    FROM clustered GROUP BY ALL""", "clustered")


def _hits(p: str) -> str:
    return f"sum(len(regexp_extract_all(content, {lit(p)})))"


register("pii_leaks", f"""
    SELECT product_id, {_hits(C.EMAIL_PATTERN)} AS email_hits, {_hits(C.PHONE_PATTERN)} AS phone_hits,
           {_hits(C.CARD_PATTERN)} AS card_hits, 'raw' AS stage FROM reviews0 GROUP BY ALL
    UNION ALL
    SELECT product_id, {_hits(C.EMAIL_PATTERN)}, {_hits(C.PHONE_PATTERN)}, {_hits(C.CARD_PATTERN)}, 'scrubbed'
    FROM (SELECT product_id, {scrub_sql('content')} AS content FROM reviews0) GROUP BY ALL""", "reviews0")
SQL_VIEWS["deliveries"] = """
    SELECT product_id, iso_week, run_id, channel,
           CASE WHEN ((pn + wk) % 4 = 1 AND channel = 'email') THEN NULL
                ELSE channel || ':' || run_id || ':' || CAST(copy AS VARCHAR) END AS delivery_id,
           CASE WHEN pn % 3 = 2 THEN 2 ELSE 1 END AS attempts
    FROM (SELECT *, CAST(substring(product_id, 4, 4) AS INT) AS pn, CAST(substring(iso_week, 7, 2) AS INT) AS wk
          FROM runs) r,
         (VALUES ('doc'), ('email')) ch(channel),
         range(1, 3) cp(copy)
    WHERE copy = 1 OR (pn + wk) % 5 = 0"""
_td._DEPS["deliveries"] = ["runs"]
register("duplicate_deliveries", """
    SELECT product_id, iso_week, channel, count(*) AS deliveries FROM deliveries
    WHERE delivery_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""", "deliveries")
register("delivery_success", """
    SELECT channel, round(avg(CASE WHEN delivery_id IS NOT NULL AND attempts = 1 THEN 1 ELSE 0 END), 6)
           AS success_rate, count(*) AS deliveries
    FROM deliveries GROUP BY ALL""", "deliveries")
register("label_agreement", """
    WITH cont AS (SELECT product_id, cluster_id, l.quality AS label, count(*) AS n
                  FROM grouped g JOIN labels l ON l.doc_id = CAST(g.review_id AS BIGINT) GROUP BY ALL),
    pc AS (SELECT product_id, cluster_id, max(n) AS top, sum(n) AS n FROM cont GROUP BY ALL)
    SELECT product_id, round(sum(top) / sum(n), 6) AS purity, sum(n) AS labelled, count(*) AS clusters
    FROM pc GROUP BY ALL""", "grouped")
register("human_rating_means", """
    SELECT product_id, iso_week, round(avg(1 + quality * 3 + toxic), 6) AS coherence,
           round(avg(CASE WHEN toxic = 0 THEN 1 ELSE 0 END), 6) AS actionability, count(*) AS ratings
    FROM reviews r JOIN labels l ON l.doc_id = CAST(r.review_id AS BIGINT) GROUP BY ALL""", "reviews")

# ------------------------------------------------------------------------------------------------
# W1-W6, D1
# ------------------------------------------------------------------------------------------------
register("top_clusters", """
    SELECT product_id, iso_week, row_number() OVER (PARTITION BY product_id, iso_week
                                                    ORDER BY size DESC, min_ord) AS rank, cluster_id, size
    FROM (SELECT product_id, iso_week, cluster_id, count(*) AS size, min(ord) AS min_ord FROM grouped GROUP BY ALL)
    QUALIFY rank <= 2""", "grouped")
register("top_terms", f"""
    SELECT product_id, iso_week, cluster_id,
           row_number() OVER (PARTITION BY product_id, iso_week, cluster_id ORDER BY count DESC, first_pos)
           AS term_rank, word, count
    FROM term_counts QUALIFY term_rank <= {C.TOP_TERMS}""", "term_counts")
register("sample_first", """
    SELECT product_id, iso_week, cluster_id,
           row_number() OVER (PARTITION BY product_id, iso_week, cluster_id ORDER BY ord) AS pos, review_id
    FROM grouped QUALIFY pos <= 3""", "grouped")
register("newest_n", """
    SELECT product_id, iso_week,
           row_number() OVER (PARTITION BY product_id, iso_week ORDER BY review_ts DESC, source, review_id)
           AS recency, review_id
    FROM reviews QUALIFY recency <= 5""", "reviews")
register("take_until_older", """
    WITH r AS (SELECT *, date_trunc('week', review_ts) + INTERVAL 3 DAYS AS cut FROM reviews),
    w AS (SELECT *, max(CASE WHEN review_ts < cut THEN 1 ELSE 0 END)
                     OVER (PARTITION BY product_id, iso_week ORDER BY source, review_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_old FROM r)
    SELECT product_id, iso_week, review_id FROM w WHERE seen_old = 0""", "reviews")
register("dedup_reviews", """
    WITH s AS (SELECT source, review_id, rating, 1 AS run, review_ts + INTERVAL 1 HOUR AS scraped_at FROM reviews
               UNION ALL
               SELECT source, review_id, 5, 2, TIMESTAMP '2024-02-01 00:00:00' FROM reviews
               WHERE iso_week = '2024-W04')
    SELECT source, review_id, rating, run FROM s
    QUALIFY row_number() OVER (PARTITION BY source, review_id ORDER BY scraped_at DESC) = 1""", "reviews")

# ------------------------------------------------------------------------------------------------
# Responses, T2, F9, J2, J3, A10, A11
# ------------------------------------------------------------------------------------------------
def jsq(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


SQL_VIEWS["topg"] = f"""
    SELECT *, row_number() OVER (PARTITION BY product_id, iso_week ORDER BY size DESC, min_ord) AS rank
    FROM (SELECT product_id, iso_week, cluster_id, count(*) AS size, min(ord) AS min_ord FROM grouped GROUP BY ALL)
    QUALIFY rank <= {C.TOP_THEMES}"""
SQL_VIEWS["firsts"] = """
    SELECT product_id, iso_week, cluster_id, arg_min(content, ord) AS first_content,
           arg_min(review_id, ord) AS first_review_id
    FROM grouped GROUP BY ALL"""
_fn = norm_ws_sql("first_content")
_q1 = jsq(f"lower(substring({_fn}, 1, 40))")
_q2 = jsq(f"replace(substring({_fn}, 5, 30), ' ', '  ')")
_q3 = jsq("'zzqx is not a quote'")
_q4 = jsq(f"substring({norm_ws_sql('last_content')}, 3, 45)")
_q5 = jsq("'er'")
SQL_VIEWS["lasts"] = """
    SELECT product_id, iso_week, cluster_id, arg_max(content, ord) AS last_content FROM grouped GROUP BY ALL"""
_td._DEPS["lasts"] = ["grouped"]
_name = jsq("'Theme ' || product_id || ' ' || CAST(rank AS VARCHAR)")
_summary = jsq("'Users report this. It matters.'")
_obj = (f"""'{{"title": ' || {jsq("'Fix ' || product_id")} || ', "description": ' || """
        f"""{jsq("'Cluster ' || CAST(cluster_id AS VARCHAR)")} || '}}'""")
_clean = (f"""'{{"name": ' || {_name} || ', "summary": ' || {_summary} || ', "quotes": [' || {_q4} || ', ' || {_q1} || ', ' || {_q2}"""
          f""" || ', ' || {_q3} || ', ' || {_q5} || '], "action_ideas": [' || {_obj} || ', "Plain idea"]}}'""")
SQL_VIEWS["responses"] = f"""
    SELECT product_id, iso_week, cluster_id, rank,
           CASE (rank + CAST(substring(product_id, 4, 4) AS INT)) % 6
             WHEN 0 THEN {_clean}
             WHEN 1 THEN 'Sure, here it is:' || chr(10) || {_clean} || chr(10) || 'Thanks.'
             WHEN 2 THEN '{{"name": ' || {_name} || ', "summary": ' || {_summary} || ', "quotes": [' || {_q1}
                         || '], "action_ideas": [{{"title": "Only title"}}]}}'
             WHEN 3 THEN '{{"name": "ab", "summary": ' || {_summary} || ', "quotes": [' || {_q2} || '], "action_ideas": []}}'
             WHEN 4 THEN '{{"name": ' || {_name} || '}}'
             ELSE 'I cannot answer that.' END AS response,
           CAST(length(first_content) % 1000 AS INT) AS prompt_tokens, CAST(50 + rank AS INT) AS completion_tokens,
           CAST(length(first_content) % 1000 AS DOUBLE) * 0.000001 + CAST(50 + rank AS DOUBLE) * 0.000002 AS cost
    FROM topg JOIN firsts USING (product_id, iso_week, cluster_id) JOIN lasts USING (product_id, iso_week, cluster_id)"""
SQL_VIEWS["parsed"] = f"""
    SELECT product_id, iso_week, cluster_id,
           CASE WHEN list_contains(k, 'name') THEN js->>'$.name' ELSE {lit(C.DEFAULT_THEME_NAME)} END AS name,
           CASE WHEN list_contains(k, 'summary') THEN js->>'$.summary' ELSE {lit(C.DEFAULT_THEME_SUMMARY)} END AS summary,
           CASE WHEN list_contains(k, 'quotes') THEN json_extract_string(js, '$.quotes[*]') ELSE [] END AS proposed_quotes,
           CASE WHEN list_contains(k, 'action_ideas') THEN list_transform(json_extract(js, '$.action_ideas[*]'),
                lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN {{'title': x->>'$.title', 'description': x->>'$.description'}}
                               ELSE {{'title': {lit(C.STRING_IDEA_TITLE)}, 'description': x->>'$'}} END)
                ELSE [] END AS action_ideas
    FROM (SELECT *, CASE WHEN js <> '' AND json_valid(js) AND json_type(js) = 'OBJECT' THEN json_keys(js) END AS k
          FROM (SELECT *, regexp_extract(response, '(?s)\\{{.*\\}}') AS js FROM responses))
    WHERE len(k) > 0"""
SQL_VIEWS["pq"] = """
    SELECT product_id, iso_week, cluster_id, unnest(range(len(proposed_quotes))) AS quote_idx,
           unnest(proposed_quotes) AS quote
    FROM parsed"""
SQL_VIEWS["grounded"] = f"""
    SELECT product_id, iso_week, cluster_id, quote_idx,
           substring(m.rn, instr(lower(m.rn), lower(m.qn)), length(m.qn)) AS text, m.review_id AS source_review_id
    FROM (SELECT q.product_id, q.iso_week, q.cluster_id, q.quote_idx,
                 arg_min({{'rn': r.rn, 'qn': {norm_ws_sql('q.quote')}, 'review_id': r.review_id}}, r.ord) AS m
          FROM pq q JOIN (SELECT product_id, iso_week, cluster_id, review_id, ord, {norm_ws_sql('content')} AS rn
                          FROM grouped) r USING (product_id, iso_week, cluster_id)
          WHERE instr(lower(r.rn), lower({norm_ws_sql('q.quote')})) > 0
          GROUP BY ALL)"""
SQL_VIEWS["t2themes"] = """
    SELECT p.product_id, p.iso_week, p.cluster_id, t.rank, p.name, p.summary, t.size AS review_count,
           coalesce((SELECT list({'text': g.text, 'source_review_id': g.source_review_id} ORDER BY g.quote_idx)
                     FROM grounded g WHERE g.product_id = p.product_id AND g.iso_week = p.iso_week
                       AND g.cluster_id = p.cluster_id), []) AS quotes,
           p.action_ideas, 0.0 AS sentiment_score
    FROM parsed p JOIN topg t USING (product_id, iso_week, cluster_id)
    WHERE p.summary IS NOT NULL AND p.proposed_quotes IS NOT NULL AND p.action_ideas IS NOT NULL
      AND p.name IS NOT NULL AND length(p.name) BETWEEN 3 AND 100
      AND coalesce(list_bool_and(list_transform(p.action_ideas,
                   lambda a: a.title IS NOT NULL AND a.description IS NOT NULL)), true)"""
_td._DEPS.update({"topg": ["grouped"], "firsts": ["grouped"], "responses": ["topg", "firsts", "lasts"],
                  "parsed": ["responses"], "pq": ["parsed"], "grounded": ["pq", "grouped"],
                  "t2themes": ["grounded", "topg"]})

FLAT_THEMES = """
    SELECT product_id, iso_week, cluster_id, rank, name, summary, review_count, len(quotes) AS n_quotes,
           array_to_string(list_transform(quotes, lambda q: concat_ws('@', q.text, q.source_review_id)), ' | ') AS quotes,
           array_to_string(list_transform(action_ideas, lambda a: concat_ws(': ', a.title, a.description)), ' | ') AS ideas
    FROM {src}"""
register("parse_theme_responses", FLAT_THEMES.format(src="t2themes"), "t2themes")
register("valid_themes", """
    SELECT product_id, iso_week, cluster_id, name, len(action_ideas) AS n_ideas FROM parsed
    WHERE summary IS NOT NULL AND name IS NOT NULL AND length(name) BETWEEN 3 AND 100
      AND coalesce(list_bool_and(list_transform(action_ideas,
                   lambda a: a.title IS NOT NULL AND a.description IS NOT NULL)), true)""", "parsed")
register("ground_quotes", "SELECT * FROM grounded", "grounded")
register("ground_quotes_loose", """
    SELECT q.product_id, q.iso_week, q.cluster_id, q.quote_idx, q.quote FROM pq q
    WHERE EXISTS (SELECT 1 FROM grouped r WHERE r.product_id = q.product_id AND r.iso_week = q.iso_week
                  AND r.cluster_id = q.cluster_id AND instr(lower(r.content), lower(q.quote)) > 0)""", "pq")
register("quote_veracity", """
    SELECT q.product_id, q.iso_week, count(*) AS proposed, sum(CASE WHEN g.text IS NOT NULL THEN 1 ELSE 0 END) AS grounded,
           round(avg(CASE WHEN g.text IS NOT NULL THEN 1 ELSE 0 END), 6) AS veracity
    FROM pq q LEFT JOIN grounded g USING (product_id, iso_week, cluster_id, quote_idx) GROUP BY ALL""", "pq", "grounded")
register("usage_totals", """
    SELECT product_id, iso_week, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens,
           round(sum(cost), 9) AS total_cost, sum(cost) > 0.0015 AS over_cap
    FROM responses GROUP BY ALL""", "responses")


def _fill_sql(template: str, **values: str) -> str:
    import re
    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(lit(p))
        else:
            out.append(f"({values[p]})")
    return " || ".join(out)


from themelens.operators.themes import PROMPT as _PROMPT  # noqa: E402

register("theme_prompts", f"""
    SELECT product_id, iso_week, cluster_id, rank, n_reviews,
           {_fill_sql(_PROMPT, product='product_id', reviews='lines')} AS prompt
    FROM (SELECT product_id, iso_week, cluster_id, count(*) AS n_reviews,
                 string_agg('- ' || content, chr(10) ORDER BY ord) AS lines
          FROM (SELECT g.*, row_number() OVER (PARTITION BY product_id, iso_week, cluster_id ORDER BY ord) AS pos
                FROM grouped g SEMI JOIN topg USING (product_id, iso_week, cluster_id)
                QUALIFY pos <= {C.PROMPT_REVIEWS})
          GROUP BY ALL) JOIN topg USING (product_id, iso_week, cluster_id)""", "topg")

# ------------------------------------------------------------------------------------------------
# The model-free themes (recursive CTE for the sequential naming)
# ------------------------------------------------------------------------------------------------
_prefix, _suffix = C.GROUP_SUFFIX.split("{letter}")
SQL_VIEWS["tterms"] = f"""
    SELECT product_id, iso_week, cluster_id, word,
           row_number() OVER (PARTITION BY product_id, iso_week, cluster_id ORDER BY count DESC, first_pos) AS term_rank
    FROM term_counts QUALIFY term_rank <= {C.TOP_TERMS}"""
SQL_VIEWS["cands"] = f"""
    SELECT product_id, iso_week, cluster_id,
           list({{'title': title, 'candidate': coalesce(fm.mapped_name, 'Analysis of ' || title || ' and Product Operations')}}
                ORDER BY term_rank) AS cands
    FROM (SELECT *, {title_sql('word')} AS title FROM tterms) t
    LEFT JOIN {FMAP_VALUES} ON lower(t.title) = fm.map_word
    GROUP BY ALL"""
SQL_VIEWS["pc"] = """
    SELECT t.product_id, t.iso_week, t.cluster_id, t.rank, t.size,
           coalesce(c.cands, []::STRUCT(title VARCHAR, candidate VARCHAR)[]) AS cands
    FROM topg t LEFT JOIN cands c USING (product_id, iso_week, cluster_id)"""
_free = "list_filter(p.cands, lambda w: NOT list_contains(r.used, w.candidate))"
_base = f"CASE WHEN len(p.cands) > 0 THEN p.cands[1].candidate ELSE {lit(C.NO_WORD_NAME)} END"
_tries = (f"list_transform(range(0, len(r.used) + 2), lambda k: CASE WHEN k = 0 THEN {_base} "
          f"ELSE {_base} || {lit(_prefix)} || chr(CAST(64 + k AS INT)) || {lit(_suffix)} END)")
SQL_VIEWS["named"] = f"""
    WITH RECURSIVE rec(product_id, iso_week, rank, used, cluster_id, name, primary_word, words) AS (
        SELECT DISTINCT product_id, iso_week, 0, []::VARCHAR[], NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR,
               NULL::VARCHAR[]
        FROM pc
        UNION ALL
        SELECT product_id, iso_week, rank, list_append(used, name), cluster_id, name, primary_word, words
        FROM (SELECT r.product_id, r.iso_week, p.rank, r.used, p.cluster_id,
                     CASE WHEN len({_free}) > 0 THEN {_free}[1].candidate
                          ELSE list_filter({_tries}, lambda s: NOT list_contains(r.used, s))[1] END AS name,
                     CASE WHEN len({_free}) > 0 THEN {_free}[1].title
                          WHEN len(p.cands) > 0 THEN p.cands[1].title ELSE {lit(C.NO_WORD_PRIMARY)} END AS primary_word,
                     list_transform(p.cands, lambda w: w.title) AS words
              FROM rec r JOIN pc p ON p.product_id = r.product_id AND p.iso_week = r.iso_week
                                  AND p.rank = r.rank + 1))
    SELECT product_id, iso_week, rank, cluster_id, name, primary_word, words FROM rec WHERE rank > 0"""
_low = "lower(n.primary_word)"
_second = f"CASE WHEN len(n.words) > 2 THEN array_to_string(n.words[2:3], ', ') ELSE {lit(C.NO_SECOND_WORDS)} END"
SQL_VIEWS["lthemes"] = f"""
    SELECT n.product_id, n.iso_week, n.cluster_id, n.rank, n.name,
           {_fill_sql(C.SENTENCE_1, word=_low)} || ' ' || {_fill_sql(C.SENTENCE_2, words=_second)} AS summary,
           p.size AS review_count,
           CASE WHEN f.first_content IS NULL THEN []::STRUCT(text VARCHAR, source_review_id VARCHAR)[]
                ELSE [{{'text': {norm_ws_sql('f.first_content')}, 'source_review_id': f.first_review_id}}] END AS quotes,
           [{{'title': {_fill_sql(C.IDEA_TITLE, word='n.primary_word')},
              'description': {_fill_sql(C.IDEA_DESCRIPTION, word=_low)}}}] AS action_ideas,
           0.0 AS sentiment_score
    FROM named n JOIN pc p USING (product_id, iso_week, cluster_id)
    LEFT JOIN firsts f USING (product_id, iso_week, cluster_id)
    WHERE length(n.name) BETWEEN {C.THEME_NAME_MIN} AND {C.THEME_NAME_MAX}"""
_td._DEPS.update({"tterms": ["term_counts"], "cands": ["tterms"], "pc": ["topg", "cands"],
                  "named": ["pc"], "lthemes": ["named", "firsts"]})
register("name_themes", """
    SELECT product_id, iso_week, rank, cluster_id, name, primary_word AS "primary", array_to_string(words, ',') AS words
    FROM named""", "named")
register("describe_themes", FLAT_THEMES.format(src="lthemes"), "lthemes")
_banned = "(?i)\\b(" + "|".join(
    __import__("re").escape(w) for w in ("Analysis", "User Interaction", "Product Operations", "General Feedback",
                                          "Worst", "Best", "Great", "Good", "Bad", "Fantastic", "Terrible",
                                          "Excellent")) + ")\\b"
register("theme_lint", f"""
    SELECT product_id, iso_week, cluster_id, nw = 1 AS one_word_name, regexp_matches(name, {lit(_banned)}) AS banned_words,
           len(regexp_extract_all(trim(summary), '[^.!?]+[.!?]+')) <> 2 AS not_two_sentences,
           NOT (nw BETWEEN 3 AND 6) AS bad_name_length
    FROM (SELECT *, len(string_split_regex(trim(name), '\\s+')) AS nw FROM lthemes)""", "lthemes")
_fallback_summary = _fill_sql(C.FALLBACK_THEME_SUMMARY, n="CAST(total_reviews AS VARCHAR)")
SQL_VIEWS["fallback_of_t2"] = f"""
    SELECT product_id, iso_week, -1 AS cluster_id, 1 AS rank, {lit(C.FALLBACK_THEME_NAME)} AS name,
           {_fallback_summary} AS summary, total_reviews AS review_count,
           []::STRUCT(text VARCHAR, source_review_id VARCHAR)[] AS quotes,
           [{{'title': {lit(C.FALLBACK_IDEA_TITLE)}, 'description': {lit(C.FALLBACK_IDEA_DESCRIPTION)}}}] AS action_ideas
    FROM (SELECT product_id, iso_week, count(*) AS total_reviews FROM grouped GROUP BY ALL) tot
    ANTI JOIN t2themes USING (product_id, iso_week)"""
_td._DEPS["fallback_of_t2"] = ["t2themes"]
register("fallback_theme", FLAT_THEMES.format(src="fallback_of_t2"), "fallback_of_t2")

# ------------------------------------------------------------------------------------------------
# J1, J5, J6, M5
# ------------------------------------------------------------------------------------------------
register("attach_labels", """
    SELECT r.product_id, r.iso_week, r.review_id, r.source, r.rating, g.cluster_id
    FROM reviews r JOIN grouped g USING (product_id, iso_week, review_id, source)""", "grouped")
register("drop_stop_words", f"""
    SELECT review_id, count(*) AS n_kept, min(tok_pos) AS first_kept
    FROM (SELECT review_id, unnest(t) AS word, unnest(range(len(t))) AS tok_pos
          FROM (SELECT review_id, {tokens_sql('content')} AS t FROM reviews0))
    WHERE word NOT IN {STOP_LIST} GROUP BY ALL""", "reviews0")
register("map_functional", f"""
    SELECT word, title, coalesce(fm.mapped_name, 'Analysis of ' || title || ' and Product Operations') AS candidate
    FROM (SELECT word, {title_sql('word')} AS title
          FROM (SELECT DISTINCT unnest({tokens_sql('content')}) AS word FROM reviews0)) w
    LEFT JOIN {FMAP_VALUES} ON lower(w.title) = fm.map_word""", "reviews0")
register("keyword_fallback", f"""
    WITH c AS (SELECT *, CASE WHEN iso_week >= '2024-W03' THEN -1 ELSE cluster_id END AS c0 FROM clustered),
    f AS (SELECT product_id, iso_week, count(DISTINCT CASE WHEN c0 <> -1 THEN c0 END) < 2 AS fb FROM c GROUP BY ALL)
    SELECT product_id, iso_week, CASE WHEN fb THEN {group_sql('content')} ELSE c0 END AS cluster_id, count(*) AS n
    FROM c JOIN f USING (product_id, iso_week) GROUP BY ALL""", "clustered")

# ------------------------------------------------------------------------------------------------
# P1 summaries and what reads them
# ------------------------------------------------------------------------------------------------
SQL_VIEWS["allthemes"] = f"""
    SELECT product_id, iso_week, cluster_id, rank, name, summary, review_count, quotes, action_ideas FROM lthemes
    UNION ALL
    SELECT product_id, iso_week, -1, 1, {lit(C.FALLBACK_THEME_NAME)}, {_fallback_summary}, total_reviews,
           []::STRUCT(text VARCHAR, source_review_id VARCHAR)[],
           [{{'title': {lit(C.FALLBACK_IDEA_TITLE)}, 'description': {lit(C.FALLBACK_IDEA_DESCRIPTION)}}}]
    FROM (SELECT product_id, iso_week, count(*) AS total_reviews FROM grouped GROUP BY ALL)
    ANTI JOIN lthemes USING (product_id, iso_week)"""
SQL_VIEWS["summ"] = f"""
    SELECT 'pulse-' || lower(k.product_id) || '-' || k.iso_week AS run_id, k.product_id, k.iso_week,
           strftime(k.lo, '%Y-%m-%d') || ' to ' || strftime(k.hi, '%Y-%m-%d') AS data_window,
           k.total AS total_reviews_analyzed,
           coalesce(t.themes, []) AS top_themes, 0.0 AS total_cost, {AS_OF_SQL} AS generated_at
    FROM (SELECT product_id, iso_week, count(*) AS total, min(review_ts) AS lo, max(review_ts) AS hi
          FROM grouped GROUP BY ALL) k
    LEFT JOIN (SELECT product_id, iso_week,
                      list({{'name': name, 'summary': summary, 'review_count': review_count, 'quotes': quotes,
                             'action_ideas': action_ideas}} ORDER BY rank) AS themes
               FROM allthemes GROUP BY ALL) t USING (product_id, iso_week)"""
_td._DEPS.update({"allthemes": ["lthemes"], "summ": ["allthemes"]})
FLAT_SUMMARY = """
    SELECT run_id, product_id, iso_week, data_window, total_reviews_analyzed, len(top_themes) AS n_themes,
           array_to_string(list_transform(top_themes, lambda t: t.name), ' | ') AS theme_names,
           array_to_string(list_transform(top_themes, lambda t: CAST(t.review_count AS VARCHAR)), ',') AS theme_counts,
           total_cost, generated_at
    FROM {src}"""
register("assemble_summary", FLAT_SUMMARY.format(src="summ"), "summ")
NL = "chr(10)"
_md = f"""
    array_to_string(list_concat(
        ['# Weekly Review Pulse — ' || product_id || ' — ' || iso_week,
         '**Period:** ' || data_window,
         '**Total Reviews Analyzed:** ' || CAST(total_reviews_analyzed AS VARCHAR),
         '**ID:** `pulse-' || lower(product_id) || '-' || iso_week || '`',
         {NL} || '---', {NL} || '## Top Themes' || {NL}],
        CASE WHEN len(top_themes) = 0 THEN [{lit(C.REPORT_NO_THEMES)}] ELSE []::VARCHAR[] END,
        flatten(list_transform(top_themes, lambda t, i: list_concat(
            ['### ' || CAST(i AS VARCHAR) || '. ' || t.name || ' (' || CAST(t.review_count AS VARCHAR) || ' reviews)',
             t.summary || {NL}],
            CASE WHEN len(t.quotes) > 0 THEN list_concat(['**Representative Quotes:**'],
                 list_transform(t.quotes, lambda q: '> "' || q.text || '"'), ['']) ELSE []::VARCHAR[] END,
            CASE WHEN len(t.action_ideas) > 0 THEN list_concat(['**Product Action Ideas:**'],
                 list_transform(t.action_ideas, lambda a: '- **' || a.title || '**: ' || a.description), [''])
                 ELSE []::VARCHAR[] END,
            [{NL} || '---'])))), {NL})"""
register("report_markdown", f"SELECT run_id, product_id, iso_week, {_md} AS markdown FROM summ", "summ")
register("weekly_run", f"""
    SELECT run_id, product_id, iso_week, {_md} AS markdown FROM summ
    WHERE (product_id, iso_week) NOT IN (SELECT (product_id, iso_week) FROM runs WHERE status = 'COMPLETED')""",
         "summ", "runs")
register("report_lines", f"""
    SELECT run_id, product_id, iso_week, unnest(range(len(l))) AS line_no, unnest(l) AS text
    FROM (SELECT *, list_concat(
            ['ID: pulse-' || lower(product_id) || '-' || iso_week || {NL},
             'Weekly Review Pulse — ' || product_id || ' — ' || iso_week || {NL},
             'Period: ' || data_window || {NL} || 'Total Reviews Analyzed: ' || CAST(total_reviews_analyzed AS VARCHAR) || {NL},
             {NL} || '--- Top Themes ---' || {NL}],
            flatten(list_transform(top_themes, lambda t, i: list_concat(
                [CAST(i AS VARCHAR) || '. ' || t.name || ' (' || CAST(t.review_count AS VARCHAR) || ' reviews)' || {NL},
                 t.summary || {NL}, 'Representative Quotes:' || {NL}],
                list_transform(t.quotes, lambda q: '" ' || q.text || ' "' || {NL}),
                ['Action Ideas:' || {NL}],
                list_transform(t.action_ideas, lambda a: '• ' || a.title || ': ' || a.description || {NL}))))) AS l
          FROM summ)""", "summ")
register("email_teasers", f"""
    SELECT run_id, product_id, iso_week,
           '[Weekly Pulse] ' || product_id || ' — ' || iso_week || ' — ' || coalesce(top_themes[1].name, 'General Updates')
               AS subject,
           'Weekly Pulse for ' || product_id || ' (' || iso_week || ')' || {NL} || {NL} || 'Total Reviews: '
               || CAST(total_reviews_analyzed AS VARCHAR) || {NL} || {NL}
               || array_to_string(list_transform(top_themes, lambda t, i: CAST(i AS VARCHAR) || '. ' || t.name || ': '
                                                 || t.summary || {NL}), '')
               || {NL} || 'Read full report at: #' AS text_body,
           'Review Pulse: ' || product_id || ' (' || iso_week || ')' AS teaser_subject,
           'Weekly Review Pulse: ' || product_id || ' (' || iso_week || ')' || {NL}
               || '-------------------------------------------' || {NL} || {NL}
               || 'Analyzed ' || CAST(total_reviews_analyzed AS VARCHAR) || ' reviews and identified '
               || CAST(len(top_themes) AS VARCHAR) || ' key themes.' || {NL} || {NL}
               || array_to_string(list_transform(top_themes, lambda t, i: CAST(i AS VARCHAR) || '. ' || t.name || ' ('
                                                 || CAST(t.review_count AS VARCHAR) || ' reviews)' || {NL} || '   '
                                                 || substring(t.summary, 1, 100) || '...' || {NL} || {NL}), '')
               || 'View the full report here: #' || {NL} || {NL} || 'Best,' || {NL} || 'Pulse Engine' AS teaser_body
    FROM summ""", "summ")
register("theme_distribution", """
    SELECT product_id, iso_week, rank, t.name AS name,
           CASE WHEN length(t.name) > 30 THEN substring(t.name, 1, 30) || '...' ELSE t.name END AS label,
           t.review_count AS review_count,
           round(t.review_count / sum(t.review_count) OVER (PARTITION BY product_id, iso_week), 6) AS share
    FROM (SELECT product_id, iso_week, unnest(top_themes) AS t, unnest(range(1, len(top_themes) + 1)) AS rank FROM summ)""",
         "summ")
SQL_VIEWS["summ_hist"] = """
    SELECT * FROM summ
    UNION ALL SELECT * REPLACE (generated_at + INTERVAL 1 DAY AS generated_at) FROM summ WHERE iso_week = '2024-W04'"""
_td._DEPS["summ_hist"] = ["summ"]
register("latest_summary", FLAT_SUMMARY.format(src="""(SELECT * FROM summ_hist QUALIFY row_number() OVER
    (PARTITION BY product_id ORDER BY generated_at DESC, run_id DESC) = 1)"""), "summ_hist")
register("delivery_outbox", """
    SELECT s.product_id, s.iso_week, s.run_id, ch.channel FROM summ s, (VALUES ('doc'), ('email')) ch(channel)
    WHERE NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.product_id = s.product_id AND d.iso_week = s.iso_week
                      AND d.channel = ch.channel AND d.delivery_id IS NOT NULL)""", "summ", "deliveries")
register("run_history", """
    SELECT r.run_id, r.product_id, r.iso_week, r.status, coalesce(rc.n, 0) AS reviews, coalesce(sc.n, 0) AS summaries,
           sc.last_at AS last_summary_at
    FROM runs r
    LEFT JOIN (SELECT 'pulse-' || lower(product_id) || '-' || iso_week AS run_id, count(*) AS n FROM reviews GROUP BY ALL) rc
           USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) AS n, max(generated_at) AS last_at FROM summ_hist GROUP BY ALL) sc USING (run_id)""",
         "runs", "summ_hist")

# ------------------------------------------------------------------------------------------------
# J7, M3, M6, M7 (brute force in SQL: fine for an oracle on the small check scale)
# ------------------------------------------------------------------------------------------------
from themelens.plans.catalog import DENSITY_EPS, MERGE_THRESHOLD, PAIR_THRESHOLD  # noqa: E402

SQL_VIEWS["allpairs"] = """
    SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_cosine_similarity(a.vec, b.vec) AS cosine
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id"""
_td._DEPS["allpairs"] = ["vectors"]
register("similar_pairs", f"""
    SELECT id_a, id_b, round(cosine, 6) AS cosine FROM allpairs WHERE id_a < id_b AND cosine >= {PAIR_THRESHOLD}""",
         "allpairs")
register("nearest_neighbours", """
    SELECT id_a AS id, id_b AS nbr, row_number() OVER (PARTITION BY id_a ORDER BY cosine DESC, id_b) AS nn_rank,
           round(cosine, 6) AS cosine
    FROM allpairs QUALIFY nn_rank <= 3""", "allpairs")
SQL_VIEWS["weekvecs"] = """
    SELECT r.product_id, r.iso_week, r.review_id, v.vec
    FROM reviews r JOIN vectors v ON CAST(v.vec_id AS VARCHAR) = r.review_id"""
_td._DEPS["weekvecs"] = ["reviews", "vectors"]
_DENSITY_WEEK = f"""
    WITH RECURSIVE p AS (
        SELECT a.product_id, a.iso_week, a.review_id AS id_a, b.review_id AS id_b,
               list_cosine_similarity(a.vec, b.vec) AS cosine
        FROM weekvecs a JOIN weekvecs b
          ON a.product_id = b.product_id AND a.iso_week = b.iso_week AND a.review_id <> b.review_id),
    core AS (SELECT product_id, iso_week, id_a AS id, 1 - max(cosine) AS core FROM p GROUP BY ALL),
    e AS (SELECT p.product_id, p.iso_week, p.id_a AS src, p.id_b AS dst FROM p
          JOIN core ca ON ca.product_id = p.product_id AND ca.iso_week = p.iso_week AND ca.id = p.id_a
          JOIN core cb ON cb.product_id = p.product_id AND cb.iso_week = p.iso_week AND cb.id = p.id_b
          WHERE p.cosine >= {1.0 - DENSITY_EPS_WEEK} AND greatest(ca.core, cb.core, 1 - p.cosine) <= {DENSITY_EPS_WEEK}),
    reach(product_id, iso_week, node, label) AS (
        SELECT product_id, iso_week, review_id, review_id FROM weekvecs
        UNION
        SELECT e.product_id, e.iso_week, e.dst, r.label FROM reach r
        JOIN e ON e.src = r.node AND e.product_id = r.product_id AND e.iso_week = r.iso_week),
    lab AS (SELECT product_id, iso_week, node, min(label) AS label FROM reach GROUP BY ALL),
    sizes AS (SELECT product_id, iso_week, label, count(*) AS size FROM lab GROUP BY ALL HAVING count(*) >= 2),
    num AS (SELECT product_id, iso_week, label, CAST(row_number() OVER (
        PARTITION BY product_id, iso_week ORDER BY size DESC, label) - 1 AS INT) AS cluster_id FROM sizes)
    SELECT l.product_id, l.iso_week, l.node AS review_id, coalesce(n.cluster_id, -1) AS cluster_id
    FROM lab l LEFT JOIN num n ON n.product_id = l.product_id AND n.iso_week = l.iso_week AND n.label = l.label"""
register("density_cluster", _DENSITY_WEEK, "weekvecs")
# Prim: a tree grows from the smallest id by the lightest edge that leaves it
register("spanning_forest", """
    WITH RECURSIVE p AS (
        SELECT a.product_id, a.iso_week, a.review_id AS a, b.review_id AS b, 1 - list_cosine_similarity(a.vec, b.vec) AS d
        FROM weekvecs a JOIN weekvecs b
          ON a.product_id = b.product_id AND a.iso_week = b.iso_week AND a.review_id <> b.review_id),
    core AS (SELECT product_id, iso_week, a AS id, coalesce(nth_value(d, 2) OVER (PARTITION BY product_id, iso_week, a ORDER BY d
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS core FROM p),
    one AS (SELECT DISTINCT * FROM core),
    e AS (SELECT p.product_id, p.iso_week, a, b, round(greatest(d, ca.core, cb.core), 12) AS w FROM p
          JOIN one ca ON ca.product_id = p.product_id AND ca.iso_week = p.iso_week AND ca.id = a
          JOIN one cb ON cb.product_id = p.product_id AND cb.iso_week = p.iso_week AND cb.id = b),
    prim(product_id, iso_week, held, edges, weight) AS (
        SELECT product_id, iso_week, [min(a)], CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM e GROUP BY ALL
        UNION ALL
        SELECT r.product_id, r.iso_week, list_append(r.held, arg_min(e.b, e.w)), r.edges + 1, r.weight + min(e.w)
        FROM prim r JOIN e ON e.product_id = r.product_id AND e.iso_week = r.iso_week
             AND list_contains(r.held, e.a) AND NOT list_contains(r.held, e.b)
        GROUP BY r.product_id, r.iso_week, r.held, r.edges, r.weight)
    SELECT product_id, iso_week, max(edges) AS edges, round(max(weight), 6) AS weight FROM prim GROUP BY ALL""", "weekvecs")
register("kmeans_fallback", """
    SELECT label, count(*) AS n, CASE WHEN label < 5 THEN 3 ELSE count(DISTINCT vec_id % 3) END AS n_clusters,
           CASE WHEN label < 5 THEN 0 ELSE min(vec_id % 3) END AS lowest,
           CASE WHEN label < 5 THEN 2 ELSE max(vec_id % 3) END AS highest,
           CASE WHEN label < 5 THEN 0 ELSE count(*) END AS kept
    FROM embeddings GROUP BY label""")
register("embed_with", """
    SELECT review_id, 26 AS dims, length(t) - length(replace(t, 'a', '')) AS a_count,
           length(t) - length(replace(t, 'e', '')) AS e_count, length(t) - length(replace(t, 'z', '')) AS z_count
    FROM (SELECT review_id, lower(content) AS t FROM reviews0)""", "reviews0")
register("reduce_dims", """
    SELECT n, CAST(i AS INT) AS i, CAST(j AS INT) AS j, 0.0 AS correlation, true AS falls
    FROM (SELECT count(*) AS n FROM embeddings), range(5) a(i), range(5) b(j) WHERE i < j""")
register("embed_texts", f"""
    SELECT review_id, 256 AS dims, CASE WHEN len({tokens_sql('content')}) > 0 THEN 1.0 ELSE 0.0 END AS norm
    FROM reviews0""", "reviews0")
register("embed_texts_versioned", f"""
    WITH w AS (SELECT max(iso_week) AS last FROM reviews),
    v AS (SELECT max(iso_week) AS vec_version, count(*) AS n_docs FROM reviews, w WHERE iso_week < last)
    SELECT review_id, 256 AS dims, vec_version, n_docs,
           CASE WHEN len({tokens_sql('content')}) > 0 THEN 1.0 ELSE 0.0 END AS norm
    FROM reviews, v""", "reviews")
register("density_cluster_table", f"""
    WITH RECURSIVE core AS (
        SELECT id_a AS id, 1 - cosine AS core FROM allpairs
        QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY cosine DESC, id_b) = 2),
    e AS (SELECT p.id_a AS src, p.id_b AS dst FROM allpairs p
          JOIN core ca ON ca.id = p.id_a JOIN core cb ON cb.id = p.id_b
          WHERE p.cosine >= {1.0 - DENSITY_EPS} AND greatest(ca.core, cb.core, 1 - p.cosine) <= {DENSITY_EPS}),
    reach(node, label) AS (
        SELECT vec_id, vec_id FROM vectors
        UNION
        SELECT e.dst, r.label FROM reach r JOIN e ON e.src = r.node),
    lab AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
    sizes AS (SELECT label, count(*) AS size FROM lab GROUP BY label HAVING count(*) >= 3),
    num AS (SELECT label, CAST(row_number() OVER (ORDER BY size DESC, label) - 1 AS INT) AS cluster_id FROM sizes)
    SELECT l.node AS vec_id, coalesce(n.cluster_id, -1) AS cluster_id FROM lab l LEFT JOIN num n USING (label)""",
         "allpairs")
SQL_VIEWS["centroids"] = """
    SELECT label AS cluster_id, list(x ORDER BY d) AS centroid
    FROM (SELECT label, d, avg(vec[d]) AS x FROM vectors, range(1, 65) r(d) GROUP BY ALL) GROUP BY ALL"""
_td._DEPS["centroids"] = ["vectors"]
register("merge_similar_clusters", f"""
    WITH RECURSIVE e AS (
        SELECT a.cluster_id AS src, b.cluster_id AS dst FROM centroids a JOIN centroids b
        ON a.cluster_id <> b.cluster_id AND list_cosine_similarity(a.centroid, b.centroid) >= {MERGE_THRESHOLD}),
    reach(node, label) AS (
        SELECT cluster_id, cluster_id FROM centroids
        UNION
        SELECT e.dst, r.label FROM reach r JOIN e ON e.src = r.node)
    SELECT node AS cluster_id, min(label) AS merged_id FROM reach GROUP BY node""", "centroids")
register("cluster_representatives", """
    SELECT v.label AS cluster_id, v.vec_id,
           row_number() OVER (PARTITION BY v.label ORDER BY list_cosine_similarity(v.vec, c.centroid) DESC, v.vec_id)
               AS rep_rank,
           round(list_cosine_similarity(v.vec, c.centroid), 6) AS cosine
    FROM vectors v JOIN centroids c ON c.cluster_id = v.label QUALIFY rep_rank <= 3""", "centroids")

# ------------------------------------------------------------------------------------------------
# SRC1-SRC7, ST1, ST2, P2
# ------------------------------------------------------------------------------------------------
_doc = "CAST(review_id AS BIGINT)"
SQL_VIEWS["app_expected"] = f"""
    SELECT source, review_id, user_name, CASE WHEN {_doc} % 7 = 0 THEN 0 ELSE rating END AS rating, content,
           CASE {_doc} % 5 WHEN 0 THEN epoch_us({AS_OF_SQL}) WHEN 3 THEN epoch_us({AS_OF_SQL})
                           WHEN 1 THEN epoch_us(review_ts) + CAST(7 * 3600 AS BIGINT) * 1000000
                           ELSE epoch_us(review_ts) END AS review_us
    FROM reviews0 WHERE source = 'app_store' AND {_doc} % 13 <> 0"""
SQL_VIEWS["play_expected"] = """
    SELECT source, review_id, user_name, rating, content, epoch_us(review_ts) AS review_us
    FROM reviews0 WHERE source = 'google_play'"""
_td._DEPS.update({"app_expected": ["reviews0"], "play_expected": ["reviews0"]})
register("read_app_store_feed", "SELECT * FROM app_expected", "app_expected")
register("app_store_feed_rejects", """
    SELECT CAST(CAST(review_id AS BIGINT) // 200 AS VARCHAR) AS page, 'not JSON' AS reason
    FROM reviews0 WHERE source = 'app_store' GROUP BY ALL""", "reviews0")
register("review_rejects", """
    SELECT product_id, iso_week, source, review_id, 'content is null' AS reason FROM reviews
    WHERE CAST(review_id AS BIGINT) % 17 = 0""", "reviews")
register("response_rejects", """
    SELECT product_id, iso_week, cluster_id, 'no JSON object' AS reason FROM responses
    WHERE response = 'I cannot answer that.'""", "responses")
register("read_play_reviews", "SELECT * FROM play_expected", "play_expected")
register("unify_reviews", """
    SELECT source, review_id, rating FROM app_expected UNION ALL SELECT source, review_id, rating FROM play_expected""",
         "app_expected", "play_expected")
register("append_reviews", """
    SELECT '00' || substring(product_id, 4, 9) AS product_id, iso_week, count(*) * CASE WHEN iso_week = '2024-W04' THEN 2 ELSE 1 END AS n,
           CASE WHEN iso_week = '2024-W04' THEN 2 ELSE 1 END AS last_run
    FROM reviews GROUP BY product_id, iso_week""", "reviews")
register("upsert_runs", """
    SELECT run_id, product_id, iso_week, status FROM runs WHERE status <> 'FAILED'
    UNION ALL SELECT run_id, product_id, iso_week, 'COMPLETED' FROM runs WHERE status = 'FAILED'
    UNION ALL SELECT 'pulse-' || lower(product_id) || '-2025' || substring(iso_week, 5, 4), product_id,
                     '2025' || substring(iso_week, 5, 4), 'PENDING' FROM runs""", "runs")
register("append_summaries", """
    SELECT run_id, product_id, iso_week, total_reviews_analyzed AS total, len(top_themes) AS n_themes,
           top_themes[1].name AS top_theme FROM summ""", "summ")
register("write_reports", f"""
    SELECT product_id, iso_week, {_md} || chr(10) AS markdown FROM summ""", "summ")
register("stream_reviews", "SELECT product_id, iso_week, source, review_id, content FROM scrubbed", "scrubbed")
register("weekly_counts_stream", """
    SELECT date_trunc('week', ts) AS week_start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value
    FROM events GROUP BY ALL""")


def _backfill_sql() -> str:
    from themelens.plans.catalog import BACKFILL
    start, end, weeks = BACKFILL
    weeks_sql = """
        SELECT p.product_id, w.iso_week, w.week_start
        FROM (SELECT DISTINCT product_id FROM scrubbed) p,
             (SELECT strftime(d, '%G-W%V') AS iso_week, d AS week_start
              FROM range(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-22' + INTERVAL 1 DAY, INTERVAL 7 DAY) t(d)) w"""
    assert (start, end) == ("2024-W02", "2024-W04")
    grouped_bf = f"""
        SELECT s.* REPLACE (w.iso_week AS iso_week), {group_sql('s.content')} AS cluster_id
        FROM scrubbed s JOIN ({weeks_sql}) w ON s.product_id = w.product_id
         AND s.review_ts >= w.week_start - INTERVAL {7 * (weeks - 1)} DAY AND s.review_ts < w.week_start + INTERVAL 7 DAY
        WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.product_id = s.product_id AND u.iso_week = w.iso_week
                          AND u.status = 'COMPLETED')"""
    saved = SQL_VIEWS["grouped"]
    SQL_VIEWS["grouped"] = grouped_bf
    try:
        return sql_with(FLAT_SUMMARY.format(src="summ"), "runs", "summ")
    finally:
        SQL_VIEWS["grouped"] = saved


_sql["backfill"] = _backfill_sql()



def _weekly_job_sql() -> str:
    """The main path: density clusters of the reviews that have a text, keyword groups in weeks with fewer
    than two clusters, then the summaries and the run states."""
    has_text = "CAST(review_id AS BIGINT) % 17 <> 0"
    own = {
        "todo": """
            SELECT * FROM (SELECT product_id, iso_week FROM run_keys
                           UNION ALL SELECT DISTINCT product_id, '2024-W40' FROM run_keys)
            EXCEPT SELECT product_id, iso_week FROM runs WHERE status = 'COMPLETED'""",
        "jobvecs": f"SELECT * FROM weekvecs WHERE {has_text}",
        "joblabels": _DENSITY_WEEK.replace("weekvecs", "jobvecs"),
        "grouped": f"""
            WITH c AS (SELECT s.*, coalesce(l.cluster_id, -1) AS c0 FROM scrubbed s JOIN todo USING (product_id, iso_week)
                       LEFT JOIN joblabels l ON l.product_id = s.product_id AND l.iso_week = s.iso_week
                         AND l.review_id = s.review_id WHERE CAST(s.review_id AS BIGINT) % 17 <> 0),
            f AS (SELECT product_id, iso_week, count(DISTINCT CASE WHEN c0 <> -1 THEN c0 END) < 2 AS fb FROM c GROUP BY ALL)
            SELECT c.* EXCLUDE (c0), CASE WHEN fb THEN {group_sql('content')} ELSE c0 END AS cluster_id
            FROM c JOIN f USING (product_id, iso_week)""",
        "topg": SQL_VIEWS["topg"].replace("FROM grouped GROUP BY ALL", "FROM grouped WHERE cluster_id <> -1 GROUP BY ALL"),
    }
    saved = {k: SQL_VIEWS.get(k) for k in own}
    deps = dict(_td._DEPS)
    SQL_VIEWS.update(own)
    _td._DEPS.update({"todo": ["runs"], "jobvecs": ["weekvecs"], "joblabels": ["jobvecs"],
                      "grouped": ["scrubbed", "todo", "joblabels"]})
    try:
        return sql_with("""
            SELECT k.product_id, k.iso_week, 'pulse-' || lower(k.product_id) || '-' || k.iso_week AS run_id,
                   CASE WHEN t.product_id IS NULL THEN r.status WHEN s.product_id IS NULL THEN 'EMPTY'
                        ELSE 'COMPLETED' END AS status,
                   s.total_reviews_analyzed AS total,
                   array_to_string(list_transform(s.top_themes, lambda x: x.name), ',') AS names,
                   array_to_string(list_transform(s.top_themes, lambda x: CAST(x.review_count AS VARCHAR)), ',') AS counts,
                   coalesce(j.rejects, 0) AS rejects
            FROM (SELECT product_id, iso_week FROM todo UNION SELECT product_id, iso_week FROM runs) k
            LEFT JOIN todo t USING (product_id, iso_week) LEFT JOIN runs r USING (product_id, iso_week)
            LEFT JOIN summ s USING (product_id, iso_week)
            LEFT JOIN (SELECT product_id, iso_week, count(*) AS rejects FROM reviews JOIN todo USING (product_id, iso_week)
                       WHERE CAST(review_id AS BIGINT) % 17 = 0 GROUP BY ALL) j USING (product_id, iso_week)""",
                        "runs", "todo", "summ")
    finally:
        for k, v in saved.items():
            if v is None:
                SQL_VIEWS.pop(k)
            else:
                SQL_VIEWS[k] = v
        _td._DEPS.clear()
        _td._DEPS.update(deps)


_sql["weekly_job"] = _weekly_job_sql()


def _backfill_clustered_sql() -> str:
    """Density clusters of the reviews of every window, keyword groups in windows with fewer than two clusters."""
    from themelens.plans.catalog import BACKFILL
    own = {
        "windowed": f"""
            SELECT s.* REPLACE (strftime(w.d, '%G-W%V') AS iso_week) FROM scrubbed s
            JOIN range(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-22' + INTERVAL 1 DAY, INTERVAL 7 DAY) w(d)
              ON s.review_ts >= w.d - INTERVAL {7 * (BACKFILL[2] - 1)} DAY AND s.review_ts < w.d + INTERVAL 7 DAY
            WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.product_id = s.product_id
                              AND u.iso_week = strftime(w.d, '%G-W%V') AND u.status = 'COMPLETED')""",
        "winvecs": """
            SELECT r.product_id, r.iso_week, r.review_id, v.vec
            FROM windowed r JOIN vectors v ON r.review_id = CAST(v.vec_id AS VARCHAR)""",
        "winlabels": _DENSITY_WEEK.replace("weekvecs", "winvecs"),
        "grouped": f"""
            WITH c AS (SELECT s.*, coalesce(l.cluster_id, -1) AS c0 FROM windowed s
                       LEFT JOIN winlabels l ON l.product_id = s.product_id AND l.iso_week = s.iso_week
                         AND l.review_id = s.review_id),
            f AS (SELECT product_id, iso_week, count(DISTINCT CASE WHEN c0 <> -1 THEN c0 END) < 2 AS fb FROM c GROUP BY ALL)
            SELECT c.* EXCLUDE (c0), CASE WHEN fb THEN {group_sql('content')} ELSE c0 END AS cluster_id
            FROM c JOIN f USING (product_id, iso_week)""",
        "topg": SQL_VIEWS["topg"].replace("FROM grouped GROUP BY ALL", "FROM grouped WHERE cluster_id <> -1 GROUP BY ALL"),
    }
    saved, deps = {k: SQL_VIEWS.get(k) for k in own}, dict(_td._DEPS)
    SQL_VIEWS.update(own)
    _td._DEPS.update({"windowed": ["scrubbed", "runs"], "winvecs": ["windowed", "vectors"], "winlabels": ["winvecs"],
                      "grouped": ["windowed", "winlabels"]})
    try:
        return sql_with(FLAT_SUMMARY.format(src="summ"), "summ")
    finally:
        for k, v in saved.items():
            if v is None:
                SQL_VIEWS.pop(k)
            else:
                SQL_VIEWS[k] = v
        _td._DEPS.clear()
        _td._DEPS.update(deps)


_sql["backfill_clustered"] = _backfill_clustered_sql()


def _mixed_themes_sql() -> str:
    """Model themes of the answered clusters, local themes (naming over those clusters alone) of the rest."""
    import re
    failed = "(rank * 3 + CAST(substring(product_id, 4, 4) AS INT)) % 4 = 0"
    chain = {"topg": "topm", "pc": "pcm", "named": "namedm", "lthemes": "lthemesm"}

    def renamed(body: str) -> str:
        for a, b in chain.items():
            body = re.sub(rf"\b{a}\b", b, body)
        return body

    own = {b: renamed(SQL_VIEWS[a]) for a, b in chain.items() if a != "topg"}
    own["topm"] = f"""
        SELECT * REPLACE (row_number() OVER (PARTITION BY product_id, iso_week ORDER BY rank) AS rank)
        FROM topg WHERE {failed}"""
    own["responses"] = f"SELECT * FROM ({SQL_VIEWS['responses']}) WHERE NOT {failed}"
    saved, deps = {k: SQL_VIEWS.get(k) for k in own}, dict(_td._DEPS)
    SQL_VIEWS.update(own)
    _td._DEPS.update({"topm": ["topg"], "pcm": ["topm", "cands"], "namedm": ["pcm"], "lthemesm": ["namedm", "firsts"]})
    try:
        both = """(SELECT product_id, iso_week, cluster_id, rank, name, summary, review_count, quotes, action_ideas FROM t2themes
            UNION ALL SELECT l.product_id, l.iso_week, l.cluster_id, t.rank, l.name, l.summary, l.review_count, l.quotes,
                             l.action_ideas FROM lthemesm l JOIN topg t USING (product_id, iso_week, cluster_id))"""
        return sql_with(FLAT_THEMES.format(src=both), "t2themes", "lthemesm")
    finally:
        for k, v in saved.items():
            if v is None:
                SQL_VIEWS.pop(k)
            else:
                SQL_VIEWS[k] = v
        _td._DEPS.clear()
        _td._DEPS.update(deps)


_sql["mixed_themes"] = _mixed_themes_sql()
