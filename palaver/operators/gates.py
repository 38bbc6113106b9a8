"""Checks that must hold before anything is written: name, left, right, passed."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.constants import MESSAGE_CLASSES
from .corpus import VARIANTS
from .key_terms import verify

Check = dict[str, object]


class CheckFailed(RuntimeError):
    def __init__(self, checks: list[Check]):
        self.failed = [c for c in checks if not c["passed"]]
        super().__init__("; ".join(f"{c['check']}: {c['left']} and {c['right']}" for c in self.failed))


def _collector() -> tuple[list[Check], Callable[[str, object, object], None]]:
    out: list[Check] = []
    return out, lambda name, left, right: out.append({"check": name, "left": int(left or 0), "right": int(right or 0), "passed": int(left or 0) == int(right or 0)})


def require(checks: list[Check]) -> list[Check]:
    if not all(c["passed"] for c in checks):
        raise CheckFailed(checks)
    return checks


def totals(prepared: DataFrame) -> DataFrame:
    """One row: rows by type and kind, all and stamped."""
    user, stamped = F.col("message_type") == "user", F.col("datetime").isNotNull()
    kinds = {"text": F.col("kind") == "text", "media": F.col("kind") == "media", "deleted": F.col("kind") == "deleted", "system": F.col("message_type") == "system"}
    return prepared.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(user).alias("user"), F.count_if(stamped).alias("stamped"), F.count_if(user & F.col("is_media") & F.col("is_deleted")).alias("both"),
        *[F.count_if(c).alias(k) for k, c in kinds.items()], *[F.count_if(c & stamped).alias(f"{k}_stamped") for k, c in kinds.items()],
    )


def _by(rows: Iterable[Row], *keys: str) -> dict:
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}


def analytics_checks(prepared: DataFrame, tables: dict[str, DataFrame], tfidf_documents: dict[str, int] | None = None) -> list[Check]:
    """Every total of the analytics tables against the others and against the rows. The tables are small; the rows are aggregated where they are."""
    t = totals(prepared).first()
    comp = {k: r["count"] for k, r in _by(tables["analytics_row_composition"].collect(), "group", "category").items()}
    meta = {k: r["count"] for k, r in _by(tables["analytics_metadata_counts"].collect(), "metric").items()}
    rep = {k: r["count"] for k, r in _by(tables["analytics_repetition_summary"].collect(), "metric").items()}
    add_up = lambda name, *columns: tables[name].agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in columns]).first()
    groups = add_up("analytics_repetition_groups", "occurrences")
    who = add_up("analytics_sender_counts", "user_rows", "text_messages", "media_rows", "deleted_rows", "forwarded_rows")
    daily = tables["analytics_daily_activity"].agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("quiet"), *[F.sum(c).alias(c) for c in ("text_messages", "media_rows", "deleted_rows", "system_rows", "total_rows")]).first()
    hour, week = add_up("analytics_hour_histogram", "user_rows", "system_rows"), add_up("analytics_weekday_table", "user_rows", "system_rows", "calendar_days_in_range")
    length = tables["analytics_text_length_summary"].where("measure = 'tokens'").first()
    group = lambda g: sum(v for (a, _), v in comp.items() if a == g)
    out, add = _collector()
    for name, left, right in (
        ("rows by type == rows", group("parsed_rows"), t["rows"]), ("user rows by kind == user rows", group("user_rows"), t["user"]), ("no row is media and deleted", t["both"], 0),
        ("media types == media rows", group("media_type"), comp["user_rows", "media"]), ("system categories == system rows", group("system_category"), comp["parsed_rows", "system"]),
        ("unique + repeats == texts", rep["unique_texts_after_masking"] + rep["repeat_messages_after_masking"], rep["text_messages"]), ("texts == text rows", rep["text_messages"], comp["user_rows", "text"]),
        ("template sizes == repeats", (groups["occurrences"] or 0) - groups["_n"], rep["repeat_messages_after_masking"]), ("participants' rows == user rows", who["user_rows"], t["user"]),
        ("participants' texts == text rows", who["text_messages"], comp["user_rows", "text"]), ("participants' media == media rows", who["media_rows"], comp["user_rows", "media"]),
        ("participants' deleted == deleted rows", who["deleted_rows"], comp["user_rows", "deleted"]), ("participants' forwarded == forwarded rows", who["forwarded_rows"], meta["forwarded_user_rows"]),
        ("forwarded by kind == forwarded rows", meta["forwarded_text_messages"] + meta["forwarded_media_rows"] + meta["forwarded_deleted_rows"], meta["forwarded_user_rows"]),
        ("forwarded + other texts == text rows", meta["forwarded_text_messages"] + meta["non_forwarded_text_messages"], comp["user_rows", "text"]),
        ("daily rows == stamped rows", daily["total_rows"], t["stamped"]), ("daily kinds == stamped rows", sum(daily[c] or 0 for c in ("text_messages", "media_rows", "deleted_rows", "system_rows")), t["stamped"]),
        ("daily texts == stamped texts", daily["text_messages"], t["text_stamped"]), ("daily media == stamped media", daily["media_rows"], t["media_stamped"]), ("daily deleted == stamped deleted", daily["deleted_rows"], t["deleted_stamped"]),
        ("daily system == stamped system", daily["system_rows"], t["system_stamped"]), ("calendar == active + quiet days", daily["_n"], daily["active"] + daily["quiet"]),
        ("hours == stamped rows", (hour["user_rows"] or 0) + (hour["system_rows"] or 0), t["stamped"]), ("weekdays == stamped rows", (week["user_rows"] or 0) + (week["system_rows"] or 0), t["stamped"]),
        ("weekdays' calendar == calendar", week["calendar_days_in_range"], daily["_n"]), ("measured texts == texts", length["n"], rep["text_messages"]),
    ):
        add(name, left, right)
    if tfidf_documents is not None:
        add("TF-IDF documents == texts", tfidf_documents.get("all", 0), rep["text_messages"])
        add("TF-IDF unique documents == unique texts", tfidf_documents.get("unique", 0), rep["unique_texts_after_masking"])
    return out


def script_checks(profiled: DataFrame, summary: DataFrame, stats: DataFrame, diagnostics: DataFrame | None = None) -> tuple[list[Check], dict | None]:
    """Hard checks of the script tables, and (for information) how they agree with the token diagnostics."""
    mixed = F.col("message_class") == "mixed_script"
    t = profiled.agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("is_repeat")).alias("unique"), F.count_if("is_repeat").alias("repeats"), F.sum(F.when(~mixed, F.col("alternations"))).alias("outside"), F.count_if(mixed & (F.col("latin_tokens") == F.col("alphabetic_tokens"))).alias("one")).first()
    rows, value = summary.collect(), {(r["variant"], r["metric"]): r["value"] or 0 for r in stats.collect()}
    out, add = _collector()
    for v in VARIANTS:
        mine = [r for r in rows if r["variant"] == v and r["message_class"] in MESSAGE_CLASSES]
        add(f"{v}: classes == messages", sum(r["messages"] for r in mine), t[v])
        add(f"{v}: short <= messages", sum(r["short_messages"] for r in mine) <= sum(r["messages"] for r in mine), True)
        add(f"{v}: bands == mixed messages", sum(x for (w, m), x in value.items() if w == v and (m.startswith("share_") or m.startswith("mixed_messages_devanagari"))), value.get((v, "mixed_script_messages"), 0))
    add("messages == corpus", sum(r["messages"] for r in rows if r["variant"] == "all"), t["all"])
    add("unique + repeats == all", t["unique"] + t["repeats"], t["all"])
    add("no alternation outside mixed messages", t["outside"], 0)
    add("no mixed message of one script", t["one"], 0)
    if diagnostics is None:
        return out, None
    d = {r["script"]: r["tokens_before"] for r in diagnostics.collect()}
    got = lambda m: int(value.get(("all", m), 0))
    both = {"latin_tokens": [got("alphabetic_tokens_latin"), d.get("latin", 0)], "devanagari_tokens_incl_mixed_tokens": [got("alphabetic_tokens_devanagari") + got("alphabetic_tokens_mixed"), d.get("devanagari", 0)]}
    return out, both | {"agrees": all(a == b for a, b in both.values())}


def key_term_checks(table: DataFrame, corpus: DataFrame) -> list[Check]:
    """Coverage is positive, unique is no more than all, terms are distinct, and a count from the corpus agrees."""
    u, m = F.col("unique_texts_containing"), F.col("messages_containing")
    t = table.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("terms"), F.count_if(u < 1).alias("none"), F.count_if(u > m).alias("more")).first()
    out, add = _collector()
    add("terms are distinct", t["terms"], t["n"])
    add("every term is in a unique text", t["none"], 0)
    add("unique texts <= messages", t["more"], 0)
    add("coverage agrees with the corpus", verify(table, corpus).count(), 0)
    return out
