"""A whole run: read, analyse, check, publish."""

from __future__ import annotations

import hashlib
import io
import json
import os
import time
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import MESSAGE_CLASSES, SHORT_TOKENS
from ..operators import activity, corpus, gates, key_terms, ngrams, privacy, quality, repetition, script_mix, tfidf
from ..sources import export
from ..sources.files import pre_validate
from . import orders, shared
from .config import Config, UserFacingError

README = "Aggregate tables of one chat. Terms of few messages and private-looking ones are left out. Times are as in the export; participants' numbers mean nothing beyond this run.\n"
#: Lines of empty documents that the metadata of a run lists; their number is exact.
EMPTY_LISTED = 10_000


@dataclass
class Analysis:
    """Lazy tables of one set of messages; messages and corpus are kept while they are in use."""

    messages: DataFrame
    corpus: DataFrame
    prepared: DataFrame
    docs: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    profiles: DataFrame | None = None

    def release(self) -> None:
        for df in (self.corpus, self.messages):
            df.unpersist()


def analyse(messages: DataFrame) -> Analysis:
    """All artefacts of messages, as plans."""
    messages = messages.persist(StorageLevel.MEMORY_AND_DISK)
    rows = corpus.build_corpus(messages).persist(StorageLevel.MEMORY_AND_DISK)
    prepared, docs = activity.prepare(messages), tfidf.documents(rows)
    weighted = tfidf.long_table(docs)
    tops = tfidf.top_terms(weighted)
    unigrams = ngrams.ngram_table(rows, 1, "tokens_no_stopwords")
    daily, profiled = activity.daily_activity(prepared), script_mix.profiles(rows)
    tables = {
        "ngram_unigrams": unigrams, "ngram_unigrams_with_stopwords": ngrams.ngram_table(rows, 1), "ngram_bigrams": ngrams.ngram_table(rows, 2), "ngram_trigrams": ngrams.ngram_table(rows, 3), "ngram_script_diagnostics": ngrams.script_diagnostics(rows),
        "tfidf_terms_by_message": weighted, "tfidf_top_terms": tops, "tfidf_variant_comparison": tfidf.variant_comparison(tops, unigrams), "key_terms": key_terms.key_terms(docs, tops, unigrams),
        "script_mix_summary": script_mix.summary(profiled), "script_mixing_stats": script_mix.stats(profiled),
        "analytics_row_composition": activity.row_composition(prepared), "analytics_metadata_counts": activity.metadata_counts(prepared, rows), "analytics_daily_activity": daily, "analytics_repetition_summary": repetition.summary(rows),
        "analytics_repetition_groups": repetition.groups(rows), "analytics_sender_counts": activity.sender_counts(prepared), "analytics_hour_histogram": activity.hour_histogram(prepared), "analytics_weekday_table": activity.weekday_table(prepared),
        "analytics_text_length_summary": activity.length_summary(rows),
    }
    return Analysis(messages, rows, prepared, docs, tables, profiled)


def tfidf_metadata(a: Analysis, full: int = 200, runs: int = 60) -> dict:
    out: dict = {"formula": {"tf": "count", "idf": "ln((1+N)/(1+df)) + 1", "normalisation": "L2"}, "variants": {}}
    rows = {r["variant"]: r.asDict() for r in tfidf.variant_metadata(a.docs).collect()}
    for v in corpus.VARIANTS:
        meta = rows.get(v, {"n_documents": 0, "n_empty_documents": 0, "vocabulary_size": 0})
        meta["empty_document_line_start"] = [r["line_start"] for r in tfidf.empty_documents(a.docs).where(F.col("variant") == v).orderBy("chat", "line_start").limit(EMPTY_LISTED).collect()]
        meta["top10_terms_by_total_tfidf"] = [r["term"] for r in tfidf.top_list(a.tables["tfidf_top_terms"], v).collect()]
        if meta["n_documents"]:
            meta["leave_one_out_top_k"] = tfidf.stability(corpus.select_variant(a.docs, v), full=full, runs=runs).first().asDict()
            meta["leave_one_out_top_k"]["mode"] = "all documents" if meta["n_documents"] <= full else "evenly spaced documents"
        out["variants"][v] = meta
    out["top10_overlap_between_variants"] = tfidf.top_overlap(a.tables["tfidf_top_terms"]).first()[0]
    return out


def checked(a: Analysis) -> dict:
    """All gates; raises CheckFailed before anything is written. Returns the metadata of a run."""
    n = {r["variant"]: r["n"] for r in tfidf.document_counts(a.docs).collect()}
    analytics = gates.require(gates.analytics_checks(a.prepared, a.tables, n))
    scripts, agreement = gates.script_checks(a.profiles, a.tables["script_mix_summary"], a.tables["script_mixing_stats"], a.tables["ngram_script_diagnostics"])
    terms = gates.key_term_checks(a.tables["key_terms"], a.corpus)
    gates.require(scripts + terms)
    times = a.messages.agg(F.min("datetime").alias("a"), F.max("datetime").alias("b"), F.count("datetime").alias("n"), F.count("date_str").alias("stamped")).first()
    flags = {"no_text_messages": n.get("all", 0) == 0, "no_valid_timestamps": times["n"] == 0, "some_rows_have_unreadable_timestamps": times["stamped"] > times["n"]}
    return {"checks": analytics, "script_checks": scripts, "script_agreement": agreement, "key_term_checks": terms, "limitations": flags, "first_timestamp": str(times["a"]) if times["a"] else None, "last_timestamp": str(times["b"]) if times["b"] else None}


def metadata(a: Analysis, meta: dict) -> dict[str, dict]:
    """What is written beside the tables, by file name: definitions, counts and the checks that held."""
    passed = lambda checks: {"n_reconciliation_checks": len(checks), "all_reconciliation_checks_passed": all(c["passed"] for c in checks), "reconciliation_checks": checks}
    reasons = [k for k, v in meta["limitations"].items() if v]
    n = {r["variant"]: r["n"] for r in tfidf.document_counts(a.docs).collect()}
    n = {v: n.get(v, 0) for v in corpus.VARIANTS}
    return {
        "analytics_run_metadata": {
            "first_timestamp_as_exported": meta["first_timestamp"], "last_timestamp_as_exported": meta["last_timestamp"], "timestamps": "as written in the export, without a time zone",
            **passed(meta["checks"]), **({"limited_result": True, "limitation_reasons": reasons} if reasons else {}),
        },
        "tfidf_run_metadata": tfidf_metadata(a),
        "script_mix_metadata": {"n_messages": n, "message_classes": list(MESSAGE_CLASSES), "short_message_tokens": SHORT_TOKENS, **passed(meta["script_checks"]), "agreement_with_existing_script_diagnostics": meta["script_agreement"]},
        "key_terms_metadata": {"ranking": "unique_texts_containing descending, then term", "n_terms": a.tables["key_terms"].count(), "n_messages": n["all"], "n_unique_messages": n["unique"], "checks": meta["key_term_checks"]},
    }


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Parquet, each table in its own order."""
    for name, df in tables.items():
        orders.ordered(name, df).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_json(spark: SparkSession, files: dict[str, dict], folder: str) -> None:
    for name, meta in files.items():
        shared.write_text(spark, f"{folder}/{name}.json", as_json(meta))


def as_json(meta: dict) -> str:
    return json.dumps(meta, indent=2, ensure_ascii=False, sort_keys=True, default=str)


def write_csv(name: str, df: DataFrame, path: str) -> None:
    """Arrays joined by spaces; one file, for tables that are small."""
    text = [F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    orders.ordered_file(name, df).select(*text).write.mode("overwrite").csv(path, header=True, nullValue="", escape='"')


def run_export(spark: SparkSession, path: str, folder: str, csv: bool = False) -> dict:
    """Exports at path to all artefacts in folder, tables and metadata: nothing is written unless every gate holds."""
    began = time.time()
    messages, _ = export.read_export(spark, path)
    a = analyse(messages)
    try:
        meta = checked(a)
        write_tables({"processed_chat": a.messages, "analysis_corpus": a.corpus, **a.tables}, folder)
        write_json(spark, metadata(a, meta), folder)
        if csv:
            for name, df in a.tables.items():
                write_csv(name, df, f"{folder}/csv/{name}")
    finally:
        a.release()
    return meta | {"seconds": round(time.time() - began, 2)}


def load_run(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict, dict]:
    """What may be published of a finished run: allow-listed tables (an internal column in one is an error), analytics metadata, redacted TF-IDF metadata."""
    tables = privacy.approved({name: spark.read.parquet(f"{folder}/{name}") for name in (*privacy.ANALYTICS, *privacy.NLP)})
    read = lambda name: json.loads(spark.read.text(f"{folder}/{name}.json", wholetext=True).first()[0])
    return tables, read("analytics_run_metadata"), privacy.redacted(read("tfidf_run_metadata"))


@dataclass
class Result:
    filename: str
    sha256: str
    info: dict
    warnings: list[str]
    tables: dict
    analytics_meta: dict
    tfidf_meta: dict
    seconds: dict[str, float]


def run_upload(spark: SparkSession, data: bytes, filename: str, config: Config | None = None) -> Result:
    """One upload to publishable tables (pandas, since an upload is limited), by way of a folder of its own that is removed whatever happens."""
    config = config or Config()
    text = pre_validate(data, filename, config)
    folder = f"{shared.shared_folder(spark)}/run-{uuid.uuid4().hex}"
    seconds: dict[str, float] = {}
    a = None
    try:
        mark = time.time()
        whole = spark.createDataFrame([(filename, text)], "chat string, value string")
        messages, failures = export.messages(export.split_lines(whole))
        info, warnings = quality.post_validate(messages, failures, config)
        seconds["read"], mark = time.time() - mark, time.time()
        a = analyse(messages)
        meta = checked(a)
        seconds["analyse"], mark = time.time() - mark, time.time()
        write_tables(privacy.approved(a.tables), folder)
        write_json(spark, metadata(a, meta), folder)
        shown, analytics, tf = load_run(spark, folder)
        tables = {k: orders.ordered(k, v).drop("chat").toPandas() for k, v in shown.items()}
        seconds["publish"] = time.time() - mark
        return Result(filename, hashlib.sha256(data).hexdigest(), info, warnings, tables, analytics, tf, seconds)
    except (UserFacingError, gates.CheckFailed):
        raise
    except Exception as e:  # what the engine says may quote the input
        raise UserFacingError("analysis_failed", f"The analysis failed ({type(e).__name__}).") from None
    finally:
        if a is not None:
            a.release()
        shared.remove(spark, folder)


class RunManager:
    """Keeps the last good result; the same content under the same name is not run again, and a failure leaves it as it was."""

    def __init__(self, spark: SparkSession, config: Config | None = None, runner: Callable[..., Result] = run_upload):
        self.spark, self.config, self.runner = spark, config or Config(), runner
        self.result: Result | None = None

    def submit(self, data: bytes, filename: str) -> tuple[Result, bool]:
        """The result, and whether it is new."""
        same = self.result is not None and (self.result.sha256, self.result.filename) == (hashlib.sha256(data).hexdigest(), filename)
        if not same:
            self.result = self.runner(self.spark, data, filename, self.config)
        return self.result, not same

    def clear(self) -> None:
        self.result = None


def _term_tables(spark: SparkSession, result: Result) -> dict[str, DataFrame]:
    return {k: spark.createDataFrame(v) for k, v in result.tables.items() if len(v) and k in privacy.TERM}


def displayed(spark: SparkSession, result: Result, min_messages: int = 2, show_single: bool = False) -> dict:
    """The term tables of a result as they may be shown, in order."""
    return {k: orders.ordered(k, v).toPandas() for k, v in privacy.display_tables(_term_tables(spark, result), min_messages, show_single).items()}


def notice(spark: SparkSession, result: Result, min_messages: int = 2, show_single: bool = False) -> dict:
    """How many rows displayed() hides, and why."""
    tables = _term_tables(spark, result)
    nothing = {"min_messages": min_messages, "shown_single_message_terms": show_single, "rows_hidden_single_message": 0, "rows_hidden_sensitive_pattern": 0}
    return privacy.display_notice(tables, min_messages, show_single).first().asDict() if tables else nothing


def build_bundle(spark: SparkSession, result: Result, min_messages: int = 2, show_single: bool = False) -> bytes:
    """A zip of the publishable tables, filtered for display, and the metadata."""
    shown = displayed(spark, result, min_messages, show_single)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("README.txt", README)
        for name in (*privacy.ANALYTICS, *privacy.NLP):
            z.writestr(f"{name}.csv", shown.get(name, result.tables[name]).to_csv(index=False))
        for name, meta in (("analytics_run_metadata", result.analytics_meta), ("tfidf_run_metadata", result.tfidf_meta)):
            z.writestr(f"{name}.json", as_json(meta))
    return out.getvalue()


def summarise(spark: SparkSession, folder: str) -> dict:
    """The counts that a command line shows of a finished run."""
    tables, analytics, tf = load_run(spark, folder)
    comp = {(r["group"], r["category"]): r["count"] for r in tables["analytics_row_composition"].collect()}
    every = tf["variants"]["all"]
    return {
        "parsed_rows": sum(v for (g, _), v in comp.items() if g == "parsed_rows"), "system_rows": comp["parsed_rows", "system"], "user_rows": comp["parsed_rows", "user"],
        "text_messages": comp["user_rows", "text"], "media_rows": comp["user_rows", "media"], "deleted_rows": comp["user_rows", "deleted"], "participants": tables["analytics_sender_counts"].count(),
        "tfidf_documents": every["n_documents"], "tfidf_stability_mode": every.get("leave_one_out_top_k", {}).get("mode"),
        "reconciliation_checks_passed": analytics["n_reconciliation_checks"] if analytics["all_reconciliation_checks_passed"] else "FAILED", "output_files": len(shared.names_in(spark, folder)),
    }


def key_findings(spark: SparkSession, result: Result, min_messages: int = 2) -> list[str]:
    """At most four sentences from the tables, terms as they are displayed."""
    shown = displayed(spark, result, min_messages)
    out: list[str] = []
    comp = result.tables["analytics_row_composition"].set_index(["group", "category"])["count"].to_dict()
    daily, mix = (result.tables[k] for k in ("analytics_daily_activity", "script_mix_summary"))
    uni, terms = (shown.get(k, result.tables[k]) for k in ("ngram_unigrams", "key_terms"))
    rep = result.tables["analytics_repetition_summary"].set_index("metric")["count"]
    user = comp.get(("parsed_rows", "user"), 0)
    if user:
        text, media, deleted = (comp.get(("user_rows", k), 0) for k in ("text", "media", "deleted"))
        out.append(f"Participants wrote {user:,} messages: {text:,} with text, {media:,} media, {deleted:,} deleted.")
    if daily["total_rows"].sum():
        d = daily.sort_values(["total_rows", "date"], ascending=[False, True]).iloc[0]
        out.append(f"Of {daily['total_rows'].sum():,} dated rows, {d['total_rows']:,} fall on {d['date']}, the busiest date; {daily['is_active'].sum()} of {len(daily)} days have any.")
    if rep["text_messages"]:
        said = f"{rep['repeat_messages_after_masking']:,} of {rep['text_messages']:,} text messages repeat an earlier one ({rep['template_groups']} templates)."
        first = uni.head(15)
        more = int((first["count_all"] > first["count_unique"]).sum())
        out.append(said + (f" Repetition raises the counts of {more} of the {len(first)} most frequent terms." if more else ""))
    scripts = mix[mix["variant"] == "all"].set_index("message_class")
    if len(scripts) and scripts["denominator"].iloc[0]:
        latin, devanagari, mixed = (scripts.loc[k, "messages"] for k in ("latin_only", "devanagari_only", "mixed_script"))
        out.append(f"By writing system (not language), {latin} of {scripts['denominator'].iloc[0]} text messages are Latin only, {devanagari} Devanagari only, {mixed} mixed.")
    if len(terms):
        t = terms.iloc[0]
        out.append(f"“{t['term']}” is in the most different texts: {t['unique_texts_containing']} of {rep['unique_texts_after_masking']}.")
    return out[:4]


if __name__ == "__main__":
    import sys

    if len(sys.argv) != 3 or not os.path.exists(sys.argv[1]):
        sys.exit("usage: python -m palaver.plans.run EXPORT FOLDER")
    session = SparkSession.builder.getOrCreate()
    run_export(session, sys.argv[1], sys.argv[2])
    print(as_json(summarise(session, sys.argv[2])))
