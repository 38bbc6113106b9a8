"""The registry: every query of the engine by name, with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from .functions import classify, scripts, text
from .operators import activity, corpus, gates, key_terms, ngrams, privacy, quality, repetition, script_mix, tfidf
from .plans.shared import release_shuffles, remove, stored, write_shared
from .sources import export, synthetic, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.from_documents(tables.widened(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tokens: worked out once and written to the shared folder, since a query's branches share them. Of what is written, a branch reads the columns it uses."""
    rows = stored(corpus.masked_rows(_documents(spark, sf_dir)).drop("text_masked"), "tokens")
    return rows.withColumns({"text_masked": F.array_join("tokens", " "), "tokens_no_stopwords": text.remove_stopwords(F.col("tokens"))})


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_rows with repeats flagged."""
    return corpus.with_repeats(_rows(spark, sf_dir))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.documents(_corpus(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.prepare(tables.from_conversations(_table(spark, sf_dir, "conversations")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.prepare(tables.from_events(_table(spark, sf_dir, "events")))


def _per_document(spark: SparkSession, sf_dir: str, name: str, value: Callable[[Column], Column]) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("line_start").alias("doc_id"), value(F.col("clean_message")).alias(name))


# ---- text functions over documents


@query(f"SELECT doc_id, {o.clean()} AS clean FROM documents")
def clean_text(spark, sf_dir):
    return _per_document(spark, sf_dir, "clean", lambda c: c)


@query(f"SELECT doc_id, array_to_string({o.split(o.quotes(o.clean()))}, ' ') AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return _per_document(spark, sf_dir, "tokens", lambda c: F.array_join(text.tokenize(c), " "))


@query(f"SELECT doc_id, {o.urls(o.clean())} AS masked FROM documents")
def mask_urls(spark, sf_dir):
    return _per_document(spark, sf_dir, "masked", text.mask_urls)


@query(f"SELECT doc_id, {o.phones(o.clean())} AS masked FROM documents")
def mask_phones(spark, sf_dir):
    return _per_document(spark, sf_dir, "masked", text.mask_phones)


@query(f"SELECT doc_id, array_to_string({o.analysis(o.clean())}, ' ') AS tokens FROM documents")
def analysis_tokens(spark, sf_dir):
    return _per_document(spark, sf_dir, "tokens", lambda c: F.array_join(text.analysis_tokens(c), " "))


@query(f"{o.CORPUS} SELECT line_start AS doc_id, array_to_string(content, ' ') AS tokens FROM corpus")
def stopword_filter(spark, sf_dir):
    return _per_document(spark, sf_dir, "tokens", lambda c: F.array_join(text.remove_stopwords(text.analysis_tokens(c)), " "))


@query(f"{o.CORPUS}, t AS (SELECT unnest(tokens) AS t FROM corpus) SELECT {o.script('t')} AS script, count(*) AS n FROM t GROUP BY 1")
def token_script_counts(spark, sf_dir):
    counts = ngrams.token_counts(corpus.masked_rows(_documents(spark, sf_dir)))
    return counts.groupBy(scripts.token_script(F.col("token")).alias("script")).agg(F.sum("n").alias("n"))


@query(
    f"{o.CORPUS}, m AS (SELECT 'characters_masked_text' AS measure, CAST(length(masked) AS DOUBLE) AS v FROM corpus UNION ALL SELECT 'tokens', CAST(len(tokens) AS DOUBLE) FROM corpus) "
    "SELECT measure, count(*) AS n, min(v) AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, max(v) AS max, round(avg(v), 2) AS mean FROM m GROUP BY measure"
)
def text_length_summary(spark, sf_dir):
    return activity.length_summary(corpus.masked_rows(_documents(spark, sf_dir)))


@query(f"SELECT doc_id, regexp_matches(coalesce(text, ''), {o.q('(?i)https?://|www[.]|@|chat[.]whatsapp|wa[.]me|whatsapp[.]com')}) OR length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) >= 7 OR regexp_matches(coalesce(text, ''), {o.q('(?i)' + chr(92) + 'b[a-z0-9-]+[.](com|org|net|edu|gov|in|co|io|app|me|ly|info|biz|us|uk)' + chr(92) + 'b')}) AS sensitive FROM documents")
def sensitive_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.looks_sensitive(F.coalesce("text", F.lit(""))).alias("sensitive"))


# ---- n-grams


_RATIO = "round_even(count_all / nullif(count_unique, 0), 2) AS repetition_ratio"


def _ngram_query(n: int, column: str, name: str) -> None:
    sql_column = "content" if column == "tokens_no_stopwords" else "tokens"
    sql = f"{o.ngram_cte(n, sql_column)} SELECT ngram, count_all, count_unique, msgs_all, {_RATIO} FROM ng"

    def run(spark, sf_dir):
        return ngrams.ngram_table(_rows(spark, sf_dir), n, column)

    run.__name__ = name
    query(sql)(run)


_ngram_query(1, "tokens_no_stopwords", "ngram_unigrams")
_ngram_query(1, "tokens", "ngram_unigrams_with_stopwords")
_ngram_query(2, "tokens", "ngram_bigrams")
_ngram_query(3, "tokens", "ngram_trigrams")


@query(f"{o.ngram_cte(1, 'content')} SELECT ngram, count_all, count_unique, msgs_all, {_RATIO} FROM ng ORDER BY count_unique DESC, ngram LIMIT 20")
def ngram_topk_by_unique(spark, sf_dir):
    return ngrams.top(ngrams.ngram_table(_rows(spark, sf_dir), 1, "tokens_no_stopwords"), 20, "count_unique")


@query(f"{o.ngram_cte(2, 'tokens')} SELECT ngram, count_all, count_unique, msgs_all, {_RATIO} FROM ng ORDER BY count_all DESC, ngram LIMIT 20")
def ngram_topk_bigrams(spark, sf_dir):
    return ngrams.top(ngrams.ngram_table(_rows(spark, sf_dir), 2), 20)


@query(f"{o.ngram_cte(1, 'content')} SELECT count(*) AS terms, count(*) FILTER (count_all > count_unique) AS inflated FROM (SELECT * FROM ng ORDER BY count_all DESC, ngram LIMIT 15)")
def inflated_terms(spark, sf_dir):
    return ngrams.inflated(ngrams.ngram_table(_rows(spark, sf_dir), 1, "tokens_no_stopwords"))


@query(
    f"{o.CORPUS}, t AS (SELECT unnest(tokens) AS t FROM corpus), k AS (SELECT {o.script('t')} AS script, count(*) AS b, count(*) FILTER (t NOT IN {o.STOP}) AS a FROM t GROUP BY 1) "
    "SELECT d.script, coalesce(b, 0) AS tokens_before, coalesce(a, 0) AS tokens_after, round_even(100.0 :: DOUBLE * (b - a) / nullif(b, 0), 1) AS pct_removed FROM (VALUES ('latin'), ('devanagari'), ('placeholder'), ('other')) d(script) LEFT JOIN k ON k.script = d.script"
)
def script_diagnostics(spark, sf_dir):
    return ngrams.script_diagnostics(_rows(spark, sf_dir))


# ---- repetition


@query(f"{o.CORPUS} SELECT line_start AS doc_id, is_repeat FROM corpus")
def is_repeat_flags(spark, sf_dir):
    return _corpus(spark, sf_dir).select(F.col("line_start").alias("doc_id"), "is_repeat")


_RAW = f"trim(translate(message, '‎', ''), {o.q(' ' + chr(10) + chr(9) + chr(13) + chr(0xA0))})"
_REPEATS = f"""{o.CORPUS}, raw AS (SELECT *, {_RAW} AS r FROM corpus), m AS (SELECT masked, count(*) AS n, count(DISTINCT r) AS raws, bool_and(list_contains(tokens, '<URL>')) AS url, min(line_start) AS first FROM raw GROUP BY masked),
    x AS (SELECT r, count(*) AS n FROM raw GROUP BY r), a AS (SELECT sum(n) AS texts, count(*) AS uniq, sum(n - 1) AS repeats, count(*) FILTER (n > 1) AS groups, max(n) AS largest FROM m), b AS (SELECT count(*) FILTER (n > 1) AS eg, sum(n - 1) AS er FROM x)"""


@query(
    f"{_REPEATS} SELECT metric, CAST(c AS BIGINT) AS count, CAST(d AS BIGINT) AS denominator, label AS denominator_label FROM a, b, LATERAL (VALUES ('text_messages', texts, texts, 'text messages'), ('unique_texts_after_masking', uniq, texts, 'text messages'), "
    "('repeat_messages_after_masking', repeats, texts, 'text messages'), ('template_groups', groups, uniq, 'unique texts'), ('largest_template_group_size', largest, texts, 'text messages'), ('exact_raw_duplicate_groups', eg, texts, 'text messages'), "
    "('exact_raw_repeat_messages', er, texts, 'text messages'), ('repeats_visible_only_after_masking', repeats - er, repeats, 'repeat messages after masking')) v(metric, c, d, label)"
)
def repetition_summary(spark, sf_dir):
    return repetition.summary(_corpus(spark, sf_dir))


_GROUPS = f"{_REPEATS}, g AS (SELECT 'T' || row_number() OVER (ORDER BY first) AS template_id, n AS occurrences, n - 1 AS repeat_messages, raws AS distinct_raw_texts, raws = 1 AS exact_raw_identical, url AS contains_url, CAST(0 AS BIGINT) AS forwarded_messages, CAST(NULL AS VARCHAR) AS first_date, CAST(NULL AS VARCHAR) AS last_date, CAST(0 AS BIGINT) AS active_dates FROM m WHERE n > 1)"


@query(f"{_GROUPS} SELECT * FROM g")
def repetition_groups(spark, sf_dir):
    return repetition.groups(_corpus(spark, sf_dir)).drop("chat")


@query(f"{_GROUPS} SELECT template_id, occurrences FROM g ORDER BY occurrences DESC, template_id LIMIT 10")
def top_templates(spark, sf_dir):
    return repetition.top_templates(repetition.groups(_corpus(spark, sf_dir))).select("template_id", "occurrences")


# ---- TF-IDF


@query(f"{o.TFIDF} SELECT variant, line_start AS doc_id, term, tf, df, idf, tfidf_raw, tfidf_norm, rank_in_message FROM w")
def tfidf_long(spark, sf_dir):
    return tfidf.weights(_docs(spark, sf_dir)).select("variant", F.col("line_start").alias("doc_id"), "term", "tf", "df", "idf", "tfidf_raw", "tfidf_norm", "rank_in_message")


_TOPS = "term, df, idf, total_tfidf, mean_tfidf_in_docs, n_docs_top3"


def _tops(spark, sf_dir) -> DataFrame:
    return tfidf.top_terms(tfidf.weights(_docs(spark, sf_dir)))


@query(f"{o.TFIDF} SELECT {_TOPS} FROM tops WHERE variant = 'all'")
def tfidf_top_terms_all(spark, sf_dir):
    return _tops(spark, sf_dir).where("variant = 'all'").drop("variant", "script")


@query(f"{o.TFIDF} SELECT {_TOPS} FROM tops WHERE variant = 'unique'")
def tfidf_top_terms_unique(spark, sf_dir):
    return _tops(spark, sf_dir).where("variant = 'unique'").drop("variant", "script")


@query(f"{o.TFIDF} SELECT term, total_tfidf FROM tops WHERE variant = 'all' ORDER BY round(total_tfidf, 12) DESC, term LIMIT 10")
def tfidf_topk_total(spark, sf_dir):
    return tfidf.top_list(_tops(spark, sf_dir), "all").select("term", "total_tfidf")


@query(f"{o.TFIDF} SELECT term, mean_tfidf_in_docs FROM tops WHERE variant = 'unique' ORDER BY round(mean_tfidf_in_docs, 10) DESC, term LIMIT 15")
def tfidf_topk_mean(spark, sf_dir):
    return _tops(spark, sf_dir).where("variant = 'unique'").orderBy(F.round("mean_tfidf_in_docs", 10).desc(), "term").limit(15).select("term", "mean_tfidf_in_docs")


_COMPARED = f"""{o.TFIDF}, r AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY round(total_tfidf, 12) DESC) AS rank FROM tops),
    s AS (SELECT content AS tok, row_number() OVER (PARTITION BY content ORDER BY line_start) > 1 AS copy FROM corpus), g AS (SELECT copy, unnest(tok) AS term FROM s),
    uni AS (SELECT term, count(*) AS count_all, count(*) FILTER (NOT copy) AS count_unique FROM g GROUP BY term),
    pairs AS (SELECT term, max(total_tfidf) FILTER (variant = 'all') AS total_tfidf_all, max(rank) FILTER (variant = 'all') AS rank_all, max(total_tfidf) FILTER (variant = 'unique') AS total_tfidf_unique, max(rank) FILTER (variant = 'unique') AS rank_unique FROM r GROUP BY term),
    compared AS (SELECT p.*, rank_unique - rank_all AS rank_change, count_all, count_unique FROM pairs p LEFT JOIN uni ON uni.term = p.term)"""


def _compared(spark, sf_dir) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    return tfidf.variant_comparison(tfidf.top_terms(tfidf.weights(tfidf.documents(rows))), ngrams.ngram_table(rows, 1, "tokens_no_stopwords"))


@query(f"{_COMPARED} SELECT * FROM compared")
def tfidf_variant_comparison(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(f"{_COMPARED} SELECT * FROM compared ORDER BY rank_all NULLS LAST, term LIMIT 15")
def repetition_effect(spark, sf_dir):
    return tfidf.repetition_effect(_compared(spark, sf_dir))


@query(f"{o.TFIDF} SELECT variant, line_start AS doc_id, term, rank_in_message FROM w WHERE rank_in_message <= 3")
def tfidf_per_doc_top3(spark, sf_dir):
    return tfidf.weights(_docs(spark, sf_dir)).where("rank_in_message <= 3").select("variant", F.col("line_start").alias("doc_id"), "term", "rank_in_message")


@query(
    f"{o.TFIDF}, v AS (SELECT variant, count(*) AS n_documents, count(*) FILTER (len(list_filter(content, lambda t: t NOT IN ('<URL>', '<PHONE>'))) = 0) AS n_empty_documents, count(*) FILTER (is_repeat) AS n_repeat_documents, CAST(0 AS BIGINT) AS n_forwarded_documents, "
    "count(*) FILTER (list_contains(tokens, '<URL>')) AS n_documents_with_url, count(*) FILTER (list_contains(tokens, '<PHONE>')) AS n_documents_with_phone FROM variants GROUP BY variant) "
    "SELECT v.*, (SELECT count(*) FROM tops t WHERE t.variant = v.variant) AS vocabulary_size FROM v"
)
def tfidf_variant_meta(spark, sf_dir):
    return tfidf.variant_metadata(_docs(spark, sf_dir))


@query(f"{o.TFIDF}, k AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY round(total_tfidf, 12) DESC, term) AS r FROM tops) SELECT count(*) / 10.0 :: DOUBLE AS overlap FROM k a JOIN k b ON a.term = b.term WHERE a.variant = 'all' AND b.variant = 'unique' AND a.r <= 10 AND b.r <= 10")
def tfidf_top_overlap(spark, sf_dir):
    return tfidf.top_overlap(_tops(spark, sf_dir))


@query()
def tfidf_stability(spark, sf_dir):
    """Leave-one-out overlap of the documents' best terms for each variant; checked against a brute-force loop in the tests."""
    docs = tfidf.documents(corpus.masked_rows(_documents(spark, sf_dir)).withColumn("tokens_no_stopwords", text.remove_stopwords(F.col("tokens"))))
    rows = docs.select("chat", "line_start", F.monotonically_increasing_id().alias("_id"), F.md5("text_masked").alias("key"), tfidf.counted(F.col("terms")).alias("counted"))
    made, out = [write_shared(rows, "counted")], []
    try:
        rows = spark.read.parquet(made[0])
        for v in corpus.VARIANTS:
            if v == "unique":
                made.append(write_shared(corpus.select_variant(corpus.with_repeats(rows, key=F.col("key")), v), "counted"))
                remove(spark, made[0])
                rows = spark.read.parquet(made[1])
            out.append(tfidf.overlaps(tfidf.leave_one_out_counted(rows)).select(F.lit(v).alias("variant"), "*"))
            release_shuffles(spark)
    finally:
        for path in made:
            remove(spark, path)
    return out[0].unionByName(out[1])


# ---- key terms


_KEYS = f"""{o.TFIDF}, cover AS (SELECT term, count(*) FILTER (variant = 'all') AS messages_containing, count(*) FILTER (variant = 'unique') AS unique_texts_containing FROM post GROUP BY term),
    s AS (SELECT line_start, content AS tok, row_number() OVER (PARTITION BY content ORDER BY line_start) > 1 AS copy FROM corpus), g AS (SELECT copy, unnest(tok) AS term FROM s),
    uni AS (SELECT term, count(*) AS occurrences_all, count(*) FILTER (NOT copy) AS occurrences_unique FROM g GROUP BY term),
    keys AS (SELECT c.term, messages_containing, unique_texts_containing, t.total_tfidf AS tfidf_total_unique, occurrences_all, occurrences_unique FROM cover c LEFT JOIN tops t ON t.term = c.term AND t.variant = 'unique' LEFT JOIN uni u ON u.term = c.term WHERE unique_texts_containing >= 1)"""


def _keys(spark, sf_dir) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    docs = tfidf.documents(rows)
    return key_terms.key_terms(docs, tfidf.top_terms(tfidf.weights(docs)), ngrams.ngram_table(rows, 1, "tokens_no_stopwords"))


@query(f"{_KEYS} SELECT *, {o.script('term')} AS script, round_even(occurrences_all / nullif(occurrences_unique, 0), 2) AS repetition_ratio FROM keys")
def key_term_table(spark, sf_dir):
    return _keys(spark, sf_dir)


@query(f"{_KEYS} SELECT term, unique_texts_containing, row_number() OVER (ORDER BY unique_texts_containing DESC, term) AS rank FROM keys QUALIFY rank <= 15")
def key_terms_topk(spark, sf_dir):
    return key_terms.ranked(_keys(spark, sf_dir), 15).select("term", "unique_texts_containing", "rank")


@query(f"{_KEYS} SELECT term, messages_containing FROM keys WHERE messages_containing >= 2 AND length(regexp_replace(term, '[^0-9]', '', 'g')) < 7 AND NOT regexp_matches(term, {o.q('https?://|www[.]|@|chat[.]whatsapp|wa[.]me|whatsapp[.]com|' + chr(92) + 'b[a-z0-9-]+[.](com|org|net|edu|gov|in|co|io|app|me|ly|info|biz|us|uk)' + chr(92) + 'b')})")
def key_terms_display(spark, sf_dir):
    return privacy.display_tables({"key_terms": _keys(spark, sf_dir)})["key_terms"].select("term", "messages_containing")


@query(f"{o.CORPUS}, t AS (SELECT is_repeat, unnest(list_distinct(list_filter(content, lambda t: t NOT IN ('<URL>', '<PHONE>')))) AS term FROM corpus) SELECT term, count(*) AS messages_containing, count(*) FILTER (NOT is_repeat) AS unique_texts_containing FROM t GROUP BY term")
def coverage_check(spark, sf_dir):
    return key_terms.coverage(_docs(spark, sf_dir))


# ---- script mix (the tables hold Latin letters, so the SQL side is short)


_PROFILE = f"""{o.CORPUS}, p AS (SELECT line_start, is_repeat, list_filter(tokens, lambda t: t NOT IN ('<URL>', '<PHONE>') AND regexp_matches(t, {o.q(chr(92) + 'p{L}')})) AS letters FROM corpus), prof AS (SELECT *, len(letters) AS n FROM p),
    pv AS (SELECT 'all' AS variant, * FROM prof UNION ALL SELECT 'unique', * FROM prof WHERE NOT is_repeat)"""


@query(f"{_PROFILE} SELECT line_start AS doc_id, n AS alphabetic_tokens, n AS latin_tokens, CASE WHEN n = 0 THEN 'no_alphabetic' ELSE 'latin_only' END AS message_class, n <= 3 AS is_short FROM prof")
def script_mix_profiles(spark, sf_dir):
    return script_mix.profiles(_corpus(spark, sf_dir)).select(F.col("line_start").alias("doc_id"), "alphabetic_tokens", "latin_tokens", "message_class", "is_short")


@query(
    f"{_PROFILE}, k AS (SELECT variant, CASE WHEN n = 0 THEN 'no_alphabetic' ELSE 'latin_only' END AS message_class, count(*) AS m, count(*) FILTER (n <= 3) AS s FROM pv GROUP BY ALL), d AS (SELECT variant, count(*) AS denominator FROM pv GROUP BY variant) "
    "SELECT d.variant, c.message_class, coalesce(m, 0) AS messages, d.denominator, coalesce(s, 0) AS short_messages FROM d CROSS JOIN (VALUES ('latin_only'), ('devanagari_only'), ('mixed_script'), ('other_script_only'), ('no_alphabetic')) c(message_class) LEFT JOIN k ON k.variant = d.variant AND k.message_class = c.message_class"
)
def script_mix_summary(spark, sf_dir):
    return script_mix.summary(script_mix.profiles(_corpus(spark, sf_dir)))


_NO_MIX = ", ".join(f"('{k}', 0, 0)" for k in ("mixed_messages_with_alternation", "share_0_to_0.25", "share_0.25_to_0.5", "share_0.5_to_0.75", "share_0.75_to_1", "mixed_messages_devanagari_share_0", "mixed_messages_devanagari_share_1"))
_NO_VALUE = ", ".join(f"('{k}', NULL, 0)" for k in ("median_alternations_mixed", "max_alternations_mixed", "min_devanagari_share_mixed", "median_devanagari_share_mixed", "max_devanagari_share_mixed"))


@query(
    f"{_PROFILE}, a AS (SELECT variant, count(*) AS m, count(*) FILTER (n = 0) AS none, count(*) FILTER (n <= 3) AS short, sum(n) AS tokens, sum(length(regexp_replace(array_to_string(letters, ''), {o.q('[^' + chr(92) + 'p{L}]')}, '', 'g'))) AS chars FROM pv GROUP BY variant) "
    "SELECT variant, metric, CAST(v AS DOUBLE) AS value, CAST(d AS BIGINT) AS denominator FROM a, LATERAL (VALUES ('mixed_script_messages', 0, m), ('total_alternations', 0, NULL), ('no_alphabetic_messages', none, m), ('short_messages_all_classes', short, m), "
    f"('alphabetic_tokens_latin', tokens, tokens), ('alphabetic_tokens_devanagari', 0, tokens), ('alphabetic_tokens_other', 0, tokens), ('alphabetic_tokens_mixed', 0, tokens), ('letters_latin', chars, NULL), ('letters_devanagari', 0, NULL), ('letters_other', 0, NULL), {_NO_MIX}, {_NO_VALUE}) t(metric, v, d)"
)
def script_mixing_stats(spark, sf_dir):
    return script_mix.stats(script_mix.profiles(_corpus(spark, sf_dir)))


# Turns with Devanagari and Greek put in, by turn: the SQL side has plain ranges of letters of its own.
_SCRIPTS = ("", "सुप्रभात रहा ", "कल ok ", "καλημέρα ", "सुxप्रभात ")
_WRITTEN = f"""WITH x AS (SELECT CAST(conv_id AS VARCHAR) AS chat, turn AS line_start, list_extract([{", ".join(map(o.q, _SCRIPTS))}], CAST(turn % 5 AS INTEGER) + 1) || CASE WHEN turn % 5 = 1 THEN '' ELSE coalesce(text, '') END AS said FROM conversations WHERE role <> 'system'),
    t AS (SELECT *, list_transform(list_filter({o.analysis(o.clean("said"))}, lambda t: t NOT IN ('<URL>', '<PHONE>') AND regexp_matches(t, '[a-zß-öø-ɏऄ-हक़-ॡα-ωά-ώ]')),
        lambda t: CASE CAST(regexp_matches(t, '[a-zß-öø-ɏ]') AS INT) + 2 * CAST(regexp_matches(t, '[ऄ-हक़-ॡ]') AS INT) + 4 * CAST(regexp_matches(t, '[α-ωά-ώ]') AS INT) WHEN 1 THEN 'latin' WHEN 2 THEN 'devanagari' WHEN 4 THEN 'other' ELSE 'mixed' END) AS l FROM x),
    p AS (SELECT chat, line_start, len(l) AS alphabetic_tokens, len(list_filter(l, lambda k: k = 'latin')) AS latin_tokens, len(list_filter(l, lambda k: k = 'devanagari')) AS devanagari_tokens, len(list_filter(l, lambda k: k = 'other')) AS other_tokens,
        len(list_filter(l, lambda k: k = 'mixed')) AS mixed_token_tokens, len(list_filter(range(1, len(l)), lambda i: l[i] <> l[i + 1])) AS alternations FROM t)"""


def _written(spark, sf_dir) -> DataFrame:
    put = F.get(F.array(*map(F.lit, _SCRIPTS)), (F.col("turn") % 5).cast("int"))
    c = _table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") != "system", F.concat(put, F.when(F.col("turn") % 5 == 1, "").otherwise(F.coalesce("text", F.lit(""))))).otherwise(F.col("text")))
    return script_mix.profiles(corpus.with_repeats(corpus.masked_rows(tables.from_conversations(c))))


@query(
    f"{_WRITTEN} SELECT *, devanagari_tokens / nullif(alphabetic_tokens, 0) AS devanagari_share, alphabetic_tokens <= 3 AS is_short, CASE alphabetic_tokens WHEN 0 THEN 'no_alphabetic' WHEN latin_tokens THEN 'latin_only' WHEN devanagari_tokens THEN 'devanagari_only' WHEN other_tokens THEN 'other_script_only' ELSE 'mixed_script' END AS message_class FROM p"
)
def script_profiles_of_turns(spark, sf_dir):
    return _written(spark, sf_dir).drop("is_repeat", "latin_letters", "devanagari_letters", "other_letters")


# ---- conversations


_SYS = "CASE WHEN contains(low, 'security code changed') THEN 'security_code_changed' WHEN regexp_matches(low, '\\b(added|joined)\\b') THEN 'member_added' WHEN contains(low, 'changed settings') OR contains(low, 'changed this group''s settings') OR regexp_matches(low, 'changed (the|this) group(''s)? (name|subject|description|icon)|changed the subject') THEN 'settings_changed' ELSE 'other_system_event' END"


@query(
    f"{o.TURNS}, x AS (SELECT 'parsed_rows' AS g, message_type AS c, 'parsed rows' AS l FROM cv UNION ALL SELECT 'user_rows', kind, 'user rows' FROM cv WHERE message_type = 'user' UNION ALL SELECT 'system_category', {_SYS}, 'system rows' FROM cv WHERE message_type = 'system'), "
    "dom AS (SELECT * FROM (VALUES ('parsed_rows', 'header', 'parsed rows'), ('parsed_rows', 'system', 'parsed rows'), ('parsed_rows', 'user', 'parsed rows'), ('user_rows', 'text', 'user rows'), ('user_rows', 'media', 'user rows'), ('user_rows', 'deleted', 'user rows'), "
    "('system_category', 'security_code_changed', 'system rows'), ('system_category', 'member_added', 'system rows'), ('system_category', 'settings_changed', 'system rows'), ('system_category', 'other_system_event', 'system rows')) t(g, c, l)) "
    'SELECT d.g AS "group", d.c AS category, d.l AS denominator_label, count(x.c) AS count, CAST(sum(count(x.c)) OVER (PARTITION BY d.g) AS BIGINT) AS denominator FROM dom d LEFT JOIN x ON x.g = d.g AND x.c = d.c GROUP BY d.g, d.c, d.l'
)
def row_composition(spark, sf_dir):
    return activity.row_composition(_turns(spark, sf_dir))


@query(f"{o.TURNS} SELECT chat, line_start, {_SYS} AS category FROM cv WHERE message_type = 'system'")
def system_categories(spark, sf_dir):
    return _turns(spark, sf_dir).where("message_type = 'system'").select("chat", "line_start", F.col("sys_cat").alias("category"))


_WHO = f"{o.TURNS}, f AS (SELECT chat, role, min(line_start) AS first_seen, count(*) AS user_rows FROM cv WHERE message_type = 'user' AND role IS NOT NULL GROUP BY chat, role), n AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY first_seen) AS k, CAST(sum(user_rows) OVER (PARTITION BY chat) AS BIGINT) AS of_user_rows FROM f)"


@query(f"{_WHO} SELECT chat, 'Participant_' || k AS participant_id, user_rows, user_rows AS text_messages, of_user_rows FROM n")
def sender_counts(spark, sf_dir):
    return activity.sender_counts(_turns(spark, sf_dir)).select("chat", "participant_id", "user_rows", "text_messages", "of_user_rows")


@query(f"{_WHO} SELECT chat, role AS sender, 'Participant_' || k AS pseudonym, first_seen FROM n")
def pseudonyms_first_appearance(spark, sf_dir):
    return corpus.pseudonyms(_turns(spark, sf_dir).where("message_type = 'user'"), "Participant_").select("chat", "sender", "pseudonym", "first_seen")


# ---- activity over events


_META = f"""{o.EVENTS}, a AS (SELECT count(*) FILTER (message_type = 'user') AS u, count(*) FILTER (kind = 'text') AS t, count(*) FILTER (kind = 'media') AS m, count(*) FILTER (kind = 'deleted') AS d FROM ev),
    sec AS (SELECT date, datetime, count(*) AS n FROM ev WHERE kind = 'deleted' GROUP BY ALL), dt AS (SELECT date, sum(n) AS n, max(n) AS s FROM sec GROUP BY date), b AS (SELECT count(*) AS dates, max(n) AS md, max(s) AS ms FROM dt)"""


@query(
    f"{_META} SELECT metric, CAST(coalesce(c, 0) AS BIGINT) AS count, CAST(e AS BIGINT) AS denominator, label AS denominator_label FROM a, b, LATERAL (VALUES ('forwarded_user_rows', 0, u, 'user rows'), ('forwarded_text_messages', 0, t, 'text messages'), ('forwarded_media_rows', 0, m, 'media rows'), ('forwarded_deleted_rows', 0, d, 'deleted rows'), "
    "('non_forwarded_text_messages', t, t, 'text messages'), ('deleted_rows', d, u, 'user rows'), ('deleted_by_admin_rows', 0, d, 'deleted rows'), ('dates_with_deleted_rows', dates, d, 'deleted rows'), ('max_deleted_rows_on_one_date', md, d, 'deleted rows'), ('max_deleted_rows_in_one_second', ms, d, 'deleted rows'), "
    "('media_rows', m, u, 'user rows'), ('album_rows', 0, m, 'media rows'), ('text_messages_with_url', 0, t, 'text messages'), ('text_messages_with_phone_pattern', 0, t, 'text messages')) v(metric, c, e, label)"
)
def metadata_counts(spark, sf_dir):
    d = _events(spark, sf_dir)
    return activity.metadata_counts(d, corpus.masked_rows(d.withColumn("clean_message", text.clean_text(F.col("message")))))


_DAILY = f"{o.EVENTS}, full_days AS (SELECT cal.date, {o.WEEKDAY.replace('date)', 'cal.date)')} AS weekday, coalesce(text_messages, 0) AS text_messages, coalesce(media_rows, 0) AS media_rows, coalesce(deleted_rows, 0) AS deleted_rows, coalesce(system_rows, 0) AS system_rows FROM cal LEFT JOIN daily ON daily.date = cal.date), d2 AS (SELECT *, text_messages + media_rows + deleted_rows + system_rows AS total_rows FROM full_days)"


@query(f"{_DAILY} SELECT * REPLACE (CAST(date AS VARCHAR) AS date), total_rows > 0 AS is_active FROM d2")
def daily_activity(spark, sf_dir):
    return activity.daily_activity(_events(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query(f"{_DAILY} SELECT CAST(date AS VARCHAR) AS date, total_rows FROM d2 ORDER BY total_rows DESC, date LIMIT 1")
def busiest_date(spark, sf_dir):
    return activity.busiest_date(activity.daily_activity(_events(spark, sf_dir))).select(F.col("date").cast("string").alias("date"), "total_rows")


@query(f"{o.EVENTS} SELECT h.h AS hour_as_exported, count(ev.kind) FILTER (message_type = 'user') AS user_rows, count(ev.kind) FILTER (message_type = 'system') AS system_rows FROM (SELECT CAST(range AS BIGINT) AS h FROM range(24)) h LEFT JOIN ev ON hour(ev.datetime) = h.h GROUP BY h.h")
def hour_histogram(spark, sf_dir):
    return activity.hour_histogram(_events(spark, sf_dir))


@query(
    f"{o.EVENTS}, c AS (SELECT {o.WEEKDAY} AS weekday, count(*) AS calendar_days_in_range FROM cal GROUP BY 1), e AS (SELECT {o.WEEKDAY} AS weekday, count(DISTINCT date) AS active_dates, count(*) FILTER (message_type = 'user') AS user_rows, count(*) FILTER (message_type = 'system') AS system_rows FROM ev GROUP BY 1) "
    "SELECT w.weekday, coalesce(calendar_days_in_range, 0) AS calendar_days_in_range, coalesce(active_dates, 0) AS active_dates, coalesce(user_rows, 0) AS user_rows, coalesce(system_rows, 0) AS system_rows FROM (VALUES ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'), ('Friday'), ('Saturday'), ('Sunday')) w(weekday) LEFT JOIN c ON c.weekday = w.weekday LEFT JOIN e ON e.weekday = w.weekday"
)
def weekday_table(spark, sf_dir):
    return activity.weekday_table(_events(spark, sf_dir))


@query(f"{o.EVENTS} SELECT printf('%02d-%02d', hour(datetime), (hour(datetime) + 1) % 24) AS period, count(*) AS rows FROM ev GROUP BY 1")
def period_buckets(spark, sf_dir):
    return activity.period_buckets(_events(spark, sf_dir))


@query(f"{o.EVENTS} SELECT max(n) AS max_rows FROM (SELECT count(*) AS n FROM ev GROUP BY datetime)")
def max_rows_one_second(spark, sf_dir):
    return activity.max_in_one_second(_events(spark, sf_dir))


@query(f"{o.EVENTS}, f AS (SELECT sender, min(event_id) AS first_seen, count(*) AS user_rows, count(*) FILTER (kind = 'media') AS media_rows, count(*) FILTER (kind = 'deleted') AS deleted_rows FROM ev WHERE message_type = 'user' GROUP BY sender) SELECT 'Participant_' || row_number() OVER (ORDER BY first_seen) AS participant_id, user_rows, media_rows, deleted_rows FROM f")
def event_participants(spark, sf_dir):
    return activity.sender_counts(_events(spark, sf_dir)).select("participant_id", "user_rows", "media_rows", "deleted_rows")


# ---- parser


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as exports: chat, value. Turns are a minute apart."""
    c = _table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("turn") * 60)
    who = F.when(F.col("role") == "system", "- ").otherwise(F.concat("role", F.lit(": ")))
    line = F.concat(F.lit("["), synthetic.stamp(at), F.lit("] "), who, F.coalesce("text", F.lit("")))
    rows = c.select(F.col("conv_id").cast("string").alias("chat"), "turn", line.alias("line"))
    return rows.groupBy("chat").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("value"))


_ROWS = "SELECT CAST(conv_id AS VARCHAR) AS chat, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE WHEN role = 'system' THEN 'system' ELSE 'user' END AS message_type, CASE WHEN role <> 'system' THEN role END AS sender, coalesce(text, '') AS message, TIMESTAMP '2026-01-01 00:00:00' + to_minutes(turn) AS datetime FROM conversations"


@query(_ROWS)
def parse_export_roundtrip(spark, sf_dir):
    from pyspark.sql import Window as W

    m, _ = export.messages(export.split_lines(export_lines(spark, sf_dir)))
    number = F.row_number().over(W.partitionBy("chat").orderBy("line_start")).cast("long")
    return m.select("chat", number.alias("n"), "message_type", "sender", "message", "datetime")


@query("WITH c AS (SELECT conv_id, turn, 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS k FROM conversations), s AS (SELECT *, CAST(sum(k) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e FROM c) SELECT CAST(conv_id AS VARCHAR) AS chat, e - k + 1 AS line_start, e AS line_end FROM s")
def line_span(spark, sf_dir):
    entries, _ = export.parse(export.split_lines(export_lines(spark, sf_dir)))
    return entries.select("chat", "line_start", "line_end")


@query("SELECT count(*) AS rows, count(*) AS stamped, count(*) AS valid, CAST(max(month(d)) AS INTEGER) AS max_first, CAST(max(day(d)) AS INTEGER) AS max_second, count(*) FILTER (role <> 'system') AS texts FROM (SELECT role, TIMESTAMP '2026-01-01 00:00:00' + to_minutes(turn) AS d FROM conversations)")
def date_order_evidence(spark, sf_dir):
    m, _ = export.messages(export.split_lines(export_lines(spark, sf_dir)))
    return quality.date_evidence(m).select("rows", "stamped", "valid", "max_first", "max_second", "texts")


_CASES = (
    ("<image omitted> look at this", "image"), ("image omitted", "image"), ("I said image omitted yesterday", None), ("Missed voice call", "call"), ("<3", None), ("<Media omitted>", "media"), ("PTT omitted", "audio"), ("<contact card omitted>", "contact"),
    ("<attached: 0001-PHOTO.jpg>", "attachment"), ("<album message>", "album"), ("<unknown message>", "unknown"), ("photo omitted\nmore", None),
)


_KIND = "list_extract([" + ", ".join("NULL" if k is None else o.q(k) for _, k in _CASES) + f"], CAST(turn % {len(_CASES) + 1} AS INTEGER))"


@query(f"SELECT CAST(conv_id AS VARCHAR) AS chat, turn AS line_start, CASE WHEN role <> 'system' THEN {_KIND} END AS media_type FROM conversations")
def media_classification(spark, sf_dir):
    """All turns; most say one of the cases, by turn, instead of their text."""
    case = F.get(F.array(*[F.lit(m) for m, _ in _CASES]), (F.col("turn") % (len(_CASES) + 1)).cast("int") - 1)
    c = _table(spark, sf_dir, "conversations").withColumn("text", F.coalesce(case, "text"))
    return tables.from_conversations(c).select("chat", "line_start", "media_type")


# ---- quality, privacy, gates


@query(
    f"{o.TURNS}, k AS (SELECT count(*) AS n FROM cv GROUP BY chat, role, message), l AS (SELECT avg(length(message)) + 3 * stddev_samp(length(message)) AS t FROM cv) SELECT metric, CAST(v AS BIGINT) AS value FROM (SELECT count(*) AS r, count(*) FILTER (role = 'system') AS ns, count(*) FILTER (trim(message, {o.q(' ' + chr(10) + chr(9) + chr(13))}) = '') AS e, count(DISTINCT CASE WHEN role <> 'system' THEN role END) AS u, (SELECT sum(n - 1) FROM k) AS d, count(*) FILTER (length(message) > t) AS big FROM cv, l), "
    "LATERAL (VALUES ('total_rows', r), ('missing_chat', 0), ('missing_line_start', 0), ('missing_sender', ns), ('missing_message_type', 0), ('missing_message', 0), ('empty_messages', e), ('unique_senders', u), ('unexpected_users', 0), ('duplicate_rows', d), ('unusually_long_messages', big)) t(metric, v)"
)
def quality_report(spark, sf_dir):
    turns = _turns(spark, sf_dir).select("chat", "line_start", "sender", "message_type", "message")
    return quality.quality_report(turns, columns=("chat", "message_type", "sender", "message"))


@query(f"{o.TURNS}, l AS (SELECT avg(length(message)) + 3 * stddev_samp(length(message)) AS t FROM cv) SELECT chat, line_start, CASE WHEN role <> 'system' THEN role END AS sender, length(message) AS n_chars FROM cv, l WHERE length(message) > t")
def long_messages(spark, sf_dir):
    return quality.long_messages(_turns(spark, sf_dir))


@query(f"{o.TURNS} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM cv GROUP BY role, message)")
def duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(_turns(spark, sf_dir), ("message_type", "sender", "message"))


@query(f"{o.ngram_cte(1, 'content')} SELECT ngram, msgs_all FROM ng WHERE msgs_all >= 2 AND length(regexp_replace(ngram, '[^0-9]', '', 'g')) < 7 AND NOT regexp_matches(ngram, {o.q('https?://|www[.]|@|chat[.]whatsapp|wa[.]me|whatsapp[.]com|' + chr(92) + 'b[a-z0-9-]+[.](com|org|net|edu|gov|in|co|io|app|me|ly|info|biz|us|uk)' + chr(92) + 'b')})")
def display_filter_ngrams(spark, sf_dir):
    t = ngrams.ngram_table(_rows(spark, sf_dir), 1, "tokens_no_stopwords")
    return privacy.display_tables({"ngram_unigrams": t})["ngram_unigrams"].select("ngram", "msgs_all")


@query(f"{o.ngram_cte(1, 'content')} SELECT count(*) FILTER (msgs_all < 2) AS hidden_rare, count(*) FILTER (msgs_all >= 2 AND (length(regexp_replace(ngram, '[^0-9]', '', 'g')) >= 7 OR regexp_matches(ngram, {o.q('https?://|www[.]|@|chat[.]whatsapp|wa[.]me|whatsapp[.]com|' + chr(92) + 'b[a-z0-9-]+[.](com|org|net|edu|gov|in|co|io|app|me|ly|info|biz|us|uk)' + chr(92) + 'b')}))) AS hidden_sensitive FROM ng")
def hidden_terms(spark, sf_dir):
    return privacy.hidden_counts(ngrams.ngram_table(_rows(spark, sf_dir), 1, "tokens_no_stopwords"), "ngram", "msgs_all")


_HIDES = f"length(regexp_replace(term, '[^0-9]', '', 'g')) >= 7 OR regexp_matches(term, {o.q('https?://|www[.]|@|chat[.]whatsapp|wa[.]me|whatsapp[.]com|' + chr(92) + 'b[a-z0-9-]+[.](com|org|net|edu|gov|in|co|io|app|me|ly|info|biz|us|uk)' + chr(92) + 'b')})"


@query(
    f"{_KEYS}, df AS (SELECT term, max(df) FILTER (variant = 'all') AS n FROM tops GROUP BY term), x AS (SELECT term, messages_containing < 2 AS rare FROM keys UNION ALL SELECT t.term, coalesce(d.n < 2, false) FROM tops t JOIN df d ON d.term = t.term) "
    f"SELECT 2 AS min_messages, false AS shown_single_message_terms, count(*) FILTER (rare) AS rows_hidden_single_message, count(*) FILTER (NOT rare AND ({_HIDES})) AS rows_hidden_sensitive_pattern FROM x"
)
def display_notice(spark, sf_dir):
    rows = _corpus(spark, sf_dir)
    docs = tfidf.documents(rows)
    tops = tfidf.top_terms(tfidf.weights(docs))
    return privacy.display_notice({"key_terms": key_terms.key_terms(docs, tops, ngrams.ngram_table(rows, 1, "tokens_no_stopwords")), "tfidf_top_terms": tops})


@query(f"{o.TURNS}, c AS (SELECT count(*) AS r, count(*) FILTER (message_type = 'user') AS u, count(*) FILTER (message_type = 'system') AS s, count(*) FILTER (kind = 'text') AS t FROM cv) SELECT 'rows' AS name, r AS value FROM c UNION ALL SELECT 'user', u FROM c UNION ALL SELECT 'text', t FROM c UNION ALL SELECT 'system', s FROM c")
def reconciliation_totals(spark, sf_dir):
    d = _turns(spark, sf_dir).withColumn("datetime", F.lit(None).cast("timestamp_ntz"))
    return gates.totals(d).select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("rows", "user", "text", "system")])))


@query()
def reconciliation_checks(spark, sf_dir):
    """Every gate over the conversations as exports; rows: check, left, right, passed."""
    from .plans.run import analyse, checked

    m, _ = export.messages(export.split_lines(export_lines(spark, sf_dir)))
    a = analyse(m)
    try:
        meta = checked(a)
    finally:
        a.release()
    return spark.createDataFrame([(str(c["check"]), c["left"], c["right"], c["passed"]) for k in ("checks", "script_checks", "key_term_checks") for c in meta[k]], "check string, left long, right long, passed boolean")
