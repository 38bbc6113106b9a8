"""Data quality of parsed messages, and whether an export can be read at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text
from ..plans.config import Config, UserFacingError

SUBSTANCE = ("date_str", "time_str", "sender", "message_type", "message")


def duplicate_rows(messages: DataFrame, columns: tuple[str, ...] = SUBSTANCE) -> DataFrame:
    """duplicate_rows: copies beyond the first."""
    return messages.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def long_threshold(messages: DataFrame) -> DataFrame:
    """threshold: mean plus three (sample) standard deviations of the characters of a message."""
    size = F.char_length(F.coalesce("message", F.lit("")))
    return messages.agg((F.avg(size) + 3 * F.stddev_samp(size)).alias("threshold"))


def long_messages(messages: DataFrame) -> DataFrame:
    """chat, line_start, sender, n_chars of messages above the threshold."""
    size = F.char_length(F.coalesce("message", F.lit(""))).cast("long")
    return messages.join(F.broadcast(long_threshold(messages)), size > F.col("threshold")).select("chat", "line_start", "sender", size.alias("n_chars"))  # one row


def quality_report(messages: DataFrame, failures: DataFrame | None = None, columns: tuple[str, ...] = SUBSTANCE) -> DataFrame:
    """metric, value: rows, nulls by column, duplicates, empty messages, invalid timestamps, failures, senders, unlikely senders, long messages."""
    who = F.when(F.col("message_type") == "user", F.col("sender"))
    odd = who.contains(":") | who.contains("changed settings") | who.contains(" added ")
    names = [c for c in messages.columns if messages.schema[c].dataType.typeName() not in ("array",)]
    facts = {
        "total_rows": F.count(F.lit(1)), **{f"missing_{c}": F.count_if(F.col(c).isNull()) for c in names}, "empty_messages": F.count_if(text.strip_space(F.coalesce("message", F.lit(""))) == ""),
        "unique_senders": F.count_distinct(who), "unexpected_users": F.count_distinct(F.when(odd, who)),
    }
    if "datetime" in messages.columns:
        facts["invalid_timestamps"] = F.count_if(F.col("datetime").isNull())
    wide = messages.agg(*[v.cast("long").alias(k) for k, v in facts.items()]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in facts])))
    more = [duplicate_rows(messages, columns).select(F.lit("duplicate_rows").alias("metric"), F.col("duplicate_rows").alias("value")), long_messages(messages).agg(F.count(F.lit(1)).alias("value")).select(F.lit("unusually_long_messages").alias("metric"), "value")]
    if failures is not None:
        more.append(failures.agg(F.count(F.lit(1)).alias("value")).select(F.lit("parsing_failures").alias("metric"), "value"))
    for m in more:
        wide = wide.unionByName(m)
    return wide


def date_evidence(messages: DataFrame) -> DataFrame:
    """One row: stamped and valid rows, the greatest first and second number of dates, first and last time, texts, unrecognised placeholders."""
    part = lambda n: F.try_element_at(F.split("date_str", "/"), F.lit(n)).try_cast("int")
    conversational = (F.col("message_type") == "user") & ~F.col("is_media") & ~F.col("is_deleted")
    return messages.agg(
        F.count(F.lit(1)).alias("rows"), F.count("date_str").alias("stamped"), F.count("datetime").alias("valid"), F.max(part(1)).alias("max_first"), F.max(part(2)).alias("max_second"),
        F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.count_if(conversational).alias("texts"), F.count_if(conversational & classify.unknown_placeholder(F.col("message"))).alias("unrecognised"),
    )


def post_validate(messages: DataFrame, failures: DataFrame, config: Config) -> tuple[dict, list[str]]:
    """Facts of a readable export and warnings, or UserFacingError."""
    r = date_evidence(messages).first()
    failed = failures.count()
    if not r["stamped"]:
        raise UserFacingError("unsupported_format", "No line looks like [M/D/YY, H:MM:SS AM/PM] Name: message.")
    day_first, second = r["max_first"] > 12, r["max_second"] > 12
    if day_first and second:
        raise UserFacingError("date_order_inconsistent", "Both numbers of the dates exceed 12 in some rows, so their order can't be told.")
    if day_first:
        raise UserFacingError("date_order_unsupported", "The dates seem to be Day/Month/Year; only Month/Day/Year is read.")
    if not r["valid"]:
        raise UserFacingError("dates_invalid", "No timestamp could be read as Month/Day/Year with a 12-hour clock.")
    if config.max_parsed_rows and r["rows"] > config.max_parsed_rows:
        raise UserFacingError("too_many_rows", f"The chat has more than {config.max_parsed_rows:,} rows.")
    if config.max_text_messages and r["texts"] > config.max_text_messages:
        raise UserFacingError("too_many_messages", f"The chat has more than {config.max_text_messages:,} text messages.")
    order = "A day above 12 occurs, as Month/Day/Year would have it." if second else "No number is above 12, so the order of month and day can't be confirmed."
    said = [
        (r["stamped"] > r["valid"], f"{r['stamped'] - r['valid']} row(s) have a time that could not be read."),
        (failed, f"{failed} line(s) could not be interpreted."),
        (r["unrecognised"], f"{r['unrecognised']} message(s) look like media placeholders of an unknown kind; they count as text."),
        (r["texts"] == 0, "There are no text messages."),
        (0 < r["texts"] < config.tiny_chat_text_messages, f"Only {r['texts']} text message(s): rankings mean nothing at this size."),
        (config.tiny_chat_text_messages <= r["texts"] < config.small_chat_text_messages, f"Small chat ({r['texts']} text messages): take rankings as illustrations."),
        (not second, order),
    ]
    when = lambda t: t.strftime("%Y-%m-%d %H:%M:%S")
    info = {"n_rows": r["rows"], "n_text_messages": r["texts"], "first_timestamp": when(r["first"]), "last_timestamp": when(r["last"]), "date_order_evidence": order, "parse_failures": failed, "unrecognised_placeholders": r["unrecognised"]}
    return info, [text for holds, text in said if holds]
