"""Bracketed chat exports: text files to typed messages.

A file is a chat. Lines that begin with a stamp open a row; others continue the row above, or come before the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, text
from ..functions.constants import MARKS, WS

# The stamp that opens a row, after marks at the line's front: [M/D/YY, H:MM:SS AM] rest
STAMP = rf"(?d)\A\[([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{2}}), ([0-9]{{1,2}}):([0-9]{{2}}):([0-9]{{2}}){WS}?([AP]M)\] (.*)\z"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines of exports: chat, line_no (from 1), line. Any line ending counts; empty lines at the end don't."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chat"), F.col("value"))
    return split_lines(whole)


def split_lines(whole: DataFrame) -> DataFrame:
    """chat, value -> chat, line_no, line."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\A\x{FEFF}", ""), r"\r\n?", "\n"), r"\n+\z", "")
    return whole.select("chat", F.posexplode(F.split(body, "\n", -1)).alias("at", "line")).select("chat", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chat, line_no, line -> (entries, failures). Failures are lines before the first stamp, but for the first line, which is a header."""
    bare = F.regexp_replace("line", f"^[{MARKS}]+", "")
    marked = lines.withColumn("_bare", bare).withColumn("_opens", F.col("_bare").rlike(STAMP))
    run = W.partitionBy("chat").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = marked.withColumn("_group", F.sum(F.col("_opens").cast("long")).over(run))
    failures = marked.where((F.col("_group") == 0) & (F.col("line_no") > 1)).select("chat", "line_no", "line")
    rows = marked.where((F.col("_group") > 0) | (F.col("line_no") == 1))
    part = lambda n: F.regexp_extract("_bare", STAMP, n)
    rows = rows.withColumn("_rest", F.when(F.col("_opens"), F.regexp_replace(part(8), f"^[{MARKS}]+", "")).otherwise(F.col("line")))
    stamp = F.when(F.col("_opens"), F.struct(F.concat_ws("/", part(1), part(2), part(3)).alias("d"), F.concat(part(4), F.lit(":"), part(5), F.lit(":"), part(6), F.lit(" "), part(7)).alias("t")))
    entry = rows.withColumn("_stamp", stamp).groupBy("chat", "_group").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.max("_stamp").alias("_stamp"), F.sort_array(F.collect_list(F.struct("line_no", "_rest"))).alias("_lines")
    )
    entry = entry.withColumn("_first", F.col("_lines")[0]["_rest"]).withColumn("_more", F.transform(F.expr("slice(_lines, 2, greatest(size(_lines) - 1, 0))"), lambda x: x["_rest"]))
    first = F.col("_first")
    candidate = F.substring_index(first, ": ", 1)
    user = (F.instr(first, ": ") > 0) & ~first.startswith("- ") & ~classify.system_sentence(candidate)
    kind = F.when(F.col("_group") == 0, "header").when(user, "user").otherwise("system")
    said = F.when(F.col("_group") == 0, first).when(first.startswith("- "), F.substr(first, F.lit(3))).when(user, F.substr(first, F.char_length(candidate) + 3)).otherwise(first)
    entries = entry.select(
        "chat", "line_start", "line_end", F.col("_stamp.d").alias("date_str"), F.col("_stamp.t").alias("time_str"),
        F.when((F.col("_group") > 0) & user, candidate).alias("sender"), kind.alias("message_type"), F.array_join(F.concat(F.array(said), F.col("_more")), "\n").alias("message"),
    )
    return entries, failures


def add_times(entries: DataFrame) -> DataFrame:
    """datetime (no time zone; null if it can't be) and its parts."""
    stamp = F.try_to_timestamp(F.concat_ws(" ", "date_str", "time_str"), F.lit("M/d/yy h:mm:ss a")).cast("timestamp_ntz")
    return with_parts(entries.withColumn("datetime", F.when(F.col("date_str").isNotNull(), stamp)))


def with_parts(df: DataFrame) -> DataFrame:
    at = F.col("datetime")
    return df.withColumns({"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "day_name": F.date_format(at, "EEEE"), "hour": F.hour(at), "minute": F.minute(at)}).withColumn("period", period(F.col("hour")))


def period(hour: Column) -> Column:
    """The hour and the one after it: 09-10, 23-00."""
    return F.when(hour.isNotNull(), F.format_string("%02d-%02d", hour, F.pmod(hour + 1, F.lit(24))))


def add_content(df: DataFrame) -> DataFrame:
    """What a row is, and its clean text and tokens."""
    m = F.col("message")
    df = df.withColumn("media_type", F.when(F.col("message_type") == "user", classify.media_type(m)))
    user = F.col("message_type") == "user"
    df = df.withColumns({"is_media": F.col("media_type").isNotNull(), "is_deleted": user & classify.is_deleted(m), "is_forwarded": user & classify.is_forwarded(m), "clean_message": text.clean_text(m)})
    df = df.withColumn("tokens", text.tokenize(F.col("clean_message")))
    return df.withColumn("tokens_no_stopwords", text.remove_stopwords(F.col("tokens")))


def messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines -> (messages, failures)."""
    entries, failures = parse(lines)
    return add_content(add_times(entries)), failures


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One export, or a folder or pattern of them."""
    return messages(read_lines(spark, path))
