"""DuckDB SQL that the queries are held against.

DuckDB's regular expressions know no lookaround, so boundaries are written out where they matter; the texts that the two dialects
would see differently don't occur in the tables.
"""

from __future__ import annotations

from .functions.constants import MARKS, PLAIN_QUOTES, QUOTES, SHORT_LINKS, SPACE, STOPWORDS, TOP_LEVEL

_S = SPACE.replace(r"\x85", r"\x{85}").replace(r"\xa0", r"\x{a0}")
WS, NOT_WS = f"[{_S}]", f"[^{_S}]"
EDGE = r"[\p{P}$+<=>^|~`]"
W = r"[\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINK = rf"(?:https?://|www\.){NOT_WS}+|(?:{SHORT_LINKS})/{NOT_WS}*|[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{TOP_LEVEL})\b(?:/{NOT_WS}*)?"
WORLD = rf"\+\p{{Nd}}(?:[{_S}\-().]?\p{{Nd}}){{7,14}}"
LOCAL = r"(^|[^\p{Nd}])\p{Nd}(?:[ \-]?\p{Nd}){8,14}($|[^\p{Nd}])"


def clean(text: str = "text") -> str:
    return f"lower(trim(regexp_replace(translate(coalesce({text}, ''), {q(MARKS)}, ''), {q(WS + '+')}, ' ', 'g')))"


def urls(c: str) -> str:
    return f"regexp_replace({c}, {q('(?i)' + LINK)}, ' <URL> ', 'g')"


def phones(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {q(WORLD)}, ' <PHONE> ', 'g'), {q(LOCAL)}, {q(chr(92) + '1 <PHONE> ' + chr(92) + '2')}, 'g')"


def quotes(c: str) -> str:
    return f"translate({c}, {q(QUOTES)}, {q(PLAIN_QUOTES)})"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {q('^' + EDGE + '+')}, ''), {q(EDGE + '+$')}, '')"


def split(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, {q(WS + '+')}), lambda t: CASE WHEN t IN ('<URL>', '<PHONE>') THEN t ELSE {strip('t')} END), lambda t: t <> '')"


def analysis(c: str) -> str:
    marked = f"regexp_replace(regexp_replace({c}, {q('(?i)^' + WS + '*' + chr(92) + '[forwarded' + chr(92) + ']' + WS + '*')}, ''), {q('(?i)' + WS + '*<this message was edited>' + WS + '*$')}, '')"
    return split(quotes(phones(urls(marked))))


STOP = "(" + ", ".join(map(q, STOPWORDS)) + ")"

#: corpus: line_start, sender, message, tokens, terms (no stop words), masked, is_repeat.
CORPUS = f"""
WITH t0 AS (SELECT doc_id AS line_start, source AS sender, coalesce(text, '') AS message, {analysis(clean())} AS tokens FROM documents),
t1 AS (SELECT *, array_to_string(tokens, ' ') AS masked, list_filter(tokens, lambda t: t NOT IN {STOP}) AS content FROM t0),
corpus AS (SELECT *, row_number() OVER (PARTITION BY masked ORDER BY line_start) > 1 AS is_repeat FROM t1)
"""
VARIANTS = "variants AS (SELECT 'all' AS variant, * FROM corpus UNION ALL SELECT 'unique' AS variant, * FROM corpus WHERE NOT is_repeat)"
TFIDF = f"""{CORPUS}, {VARIANTS},
post AS (SELECT variant, line_start, term, count(*) AS tf FROM (SELECT variant, line_start, unnest(list_filter(content, lambda t: t NOT IN ('<URL>', '<PHONE>'))) AS term FROM variants) GROUP BY ALL),
size AS (SELECT variant, count(*) AS n FROM variants GROUP BY variant),
idf AS (SELECT p.variant, p.term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM post p JOIN size s ON s.variant = p.variant GROUP BY p.variant, p.term),
raw AS (SELECT p.*, df, idf, tf * idf AS tfidf_raw FROM post p JOIN idf i ON i.variant = p.variant AND i.term = p.term),
norm AS (SELECT *, tfidf_raw / sqrt(sum(tfidf_raw * tfidf_raw) OVER (PARTITION BY variant, line_start)) AS tfidf_norm FROM raw),
w AS (SELECT *, row_number() OVER (PARTITION BY variant, line_start ORDER BY round(tfidf_norm, 12) DESC, term) AS rank_in_message FROM norm),
tops AS (SELECT variant, term, any_value(df) AS df, any_value(idf) AS idf, sum(tfidf_norm) AS total_tfidf, avg(tfidf_norm) AS mean_tfidf_in_docs, count(*) FILTER (rank_in_message <= 3) AS n_docs_top3 FROM w GROUP BY variant, term)
"""


def script(t: str) -> str:
    return f"CASE WHEN {t} IN ('<URL>', '<PHONE>') THEN 'placeholder' WHEN regexp_matches({t}, {q('[' + chr(92) + 'x{900}-' + chr(92) + 'x{97F}]')}) THEN 'devanagari' WHEN regexp_matches({t}, '[A-Za-z]') THEN 'latin' ELSE 'other' END"


def ngram_cte(n: int, column: str) -> str:
    """g: line_start, copy, ngram; table: the n-gram table."""
    grams = column if n == 1 else f"list_transform(range(1, greatest(len({column}) - {n - 2}, 1)), lambda i: array_to_string({column}[i : i + {n - 1}], ' '))"
    return f"""{CORPUS}, s AS (SELECT line_start, {column} AS tok, row_number() OVER (PARTITION BY {column} ORDER BY line_start) > 1 AS copy FROM corpus),
    g AS (SELECT line_start, copy, unnest({grams.replace(column, 'tok')}) AS ngram FROM s),
    ng AS (SELECT ngram, count(*) AS count_all, count(*) FILTER (NOT copy) AS count_unique, count(DISTINCT line_start) AS msgs_all FROM g GROUP BY ngram)"""


#: ev: events as messages; dates are those of the export.
EVENTS = """
WITH ev AS (SELECT event_id, ts AS datetime, CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS sender,
    CASE WHEN event_type = 'signup' THEN 'system' ELSE 'user' END AS message_type,
    CASE event_type WHEN 'signup' THEN '' WHEN 'purchase' THEN 'media' WHEN 'error' THEN 'deleted' ELSE 'text' END AS kind FROM events),
daily AS (SELECT date, count(*) FILTER (kind = 'text') AS text_messages, count(*) FILTER (kind = 'media') AS media_rows, count(*) FILTER (kind = 'deleted') AS deleted_rows, count(*) FILTER (message_type = 'system') AS system_rows FROM ev GROUP BY date),
cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM ev)
"""
WEEKDAY = "CASE isodow(date) WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' ELSE 'Sunday' END"
#: cv: conversations as messages.
TURNS = f"""
WITH c0 AS (SELECT CAST(conv_id AS VARCHAR) AS chat, turn AS line_start, role, coalesce(text, '') AS message, CASE WHEN role = 'system' THEN 'system' ELSE 'user' END AS message_type FROM conversations),
cv AS (SELECT *, CASE WHEN message_type = 'user' THEN 'text' ELSE '' END AS kind, lower(message) AS low FROM c0)
"""
