"""Who wrote what and when: composition, calendars, participants, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.constants import PHONE, SYSTEM_CATEGORIES, URL, WEEKDAYS
from .corpus import pseudonyms


def prepare(messages: DataFrame) -> DataFrame:
    """messages with kind, date, sys_cat and deleted_by_admin."""
    d = messages.withColumn("kind", classify.user_kind(F.col("message_type"), F.col("is_media"), F.col("is_deleted")))
    d = d.withColumn("sys_cat", F.when(F.col("message_type") == "system", classify.system_category(F.col("message"))).otherwise(""))
    d = d.withColumn("deleted_by_admin", classify.deleted_by_admin(F.col("message"), F.col("is_deleted")))
    return d.withColumn("date", F.to_date("datetime")) if "datetime" in d.columns else d


def _long(columns: list[tuple[str, Column, Column, str]], name: str = "metric") -> Column:
    return F.array(*[F.struct(F.lit(m).alias(name), F.coalesce(c, F.lit(0)).cast("long").alias("count"), F.coalesce(d, F.lit(0)).cast("long").alias("denominator"), F.lit(label).alias("denominator_label")) for m, c, d, label in columns])


def row_composition(d: DataFrame) -> DataFrame:
    """group, category, count, denominator, denominator_label: one grouped pass, then fixed domains."""
    counts = d.groupBy("message_type", "kind", "media_type", "sys_cat").agg(F.count(F.lit(1)).alias("n"))
    kind, user, system, media = F.col("kind"), F.col("message_type") == "user", F.col("message_type") == "system", F.col("kind") == "media"
    groups = {"parsed_rows": (F.lit(True), F.col("message_type"), "parsed rows", ("header", "system", "user")), "user_rows": (user, kind, "user rows", ("text", "media", "deleted")), "media_type": (media, F.col("media_type"), "media rows", ()), "system_category": (system, F.col("sys_cat"), "system rows", SYSTEM_CATEGORIES)}
    each = F.filter(F.array(*[F.when(w, F.struct(F.lit(g).alias("group"), c.alias("category"), F.lit(label).alias("denominator_label"))) for g, (w, c, label, _) in groups.items()]), lambda x: x.isNotNull())
    found = counts.select("n", F.inline(each)).groupBy("group", "category", "denominator_label").agg(F.sum("n").alias("count"))
    fixed = d.sparkSession.createDataFrame([(g, c, label) for g, (_, _, label, domain) in groups.items() for c in domain], "group string, category string, denominator_label string").withColumn("count", F.lit(0).cast("long"))
    out = found.unionByName(fixed).groupBy("group", "category", "denominator_label").agg(F.sum("count").alias("count"))
    return out.withColumn("denominator", F.sum("count").over(W.partitionBy("group")))  # a few rows


def calendar(d: DataFrame) -> DataFrame:
    """Every date from the first to the last; none without dates."""
    return d.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))


def _names(day: Column) -> Column:
    return F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day))


def daily_activity(d: DataFrame) -> DataFrame:
    """date, weekday, text_messages, media_rows, deleted_rows, system_rows, total_rows, is_active: quiet days too."""
    kinds = {"text_messages": F.col("kind") == "text", "media_rows": F.col("kind") == "media", "deleted_rows": F.col("kind") == "deleted", "system_rows": F.col("message_type") == "system"}
    counts = d.where("date is not null").groupBy("date").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    out = calendar(d).join(counts, "date", "left").select("date", _names(F.col("date")).alias("weekday"), *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
    total = F.col("text_messages") + F.col("media_rows") + F.col("deleted_rows") + F.col("system_rows")
    return out.withColumn("total_rows", total).withColumn("is_active", F.col("total_rows") > 0)


def busiest_date(daily: DataFrame) -> DataFrame:
    return daily.orderBy(F.col("total_rows").desc(), "date").limit(1)


def _sides(d: DataFrame, by: Column, name: str, *more: Column) -> DataFrame:
    return d.where("datetime is not null").groupBy(by.alias(name)).agg(F.count_if(F.col("message_type") == "user").alias("user_rows"), F.count_if(F.col("message_type") == "system").alias("system_rows"), *more)


def hour_histogram(d: DataFrame) -> DataFrame:
    """hour_as_exported (0 to 23), user_rows, system_rows."""
    hours = d.sparkSession.range(24).select(F.col("id").alias("hour_as_exported"))
    return hours.join(_sides(d, F.hour("datetime").cast("long"), "hour_as_exported"), "hour_as_exported", "left").na.fill(0)


def weekday_table(d: DataFrame) -> DataFrame:
    """weekday, calendar_days_in_range, active_dates, user_rows, system_rows."""
    days = calendar(d).groupBy(F.weekday("date").alias("_w")).agg(F.count(F.lit(1)).alias("calendar_days_in_range"))
    counts = _sides(d, F.weekday("date"), "_w", F.count_distinct(F.when(F.col("message_type").isin("user", "system"), F.col("date"))).alias("active_dates"))
    week = d.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "_w int, weekday string")
    return week.join(days, "_w", "left").join(counts, "_w", "left").na.fill(0).select("weekday", "calendar_days_in_range", "active_dates", "user_rows", "system_rows")


def period_buckets(d: DataFrame) -> DataFrame:
    """period, rows: by hour and the one after."""
    return d.where("period is not null").groupBy("period").agg(F.count(F.lit(1)).alias("rows"))


def sender_counts(d: DataFrame) -> DataFrame:
    """participant_id, user_rows, text_messages, media_rows, deleted_rows, forwarded_rows, of_user_rows; the senders themselves aren't in it."""
    user = d.where("message_type = 'user' and sender is not null")
    kinds = {"text_messages": F.col("kind") == "text", "media_rows": F.col("kind") == "media", "deleted_rows": F.col("kind") == "deleted", "forwarded_rows": F.col("is_forwarded")}
    counts = user.groupBy("chat", "sender").agg(F.count(F.lit(1)).alias("user_rows"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    out = counts.join(pseudonyms(user, "Participant_"), ["chat", "sender"])
    return out.withColumn("of_user_rows", F.sum("user_rows").over(W.partitionBy("chat"))).select("chat", F.col("pseudonym").alias("participant_id"), "user_rows", *kinds, "of_user_rows")


def metadata_counts(d: DataFrame, corpus: DataFrame) -> DataFrame:
    """14 metrics with their denominators."""
    user, kind, forwarded = F.col("message_type") == "user", F.col("kind"), F.col("is_forwarded")
    text, media, deleted = (kind == k for k in ("text", "media", "deleted"))
    c = F.count_if
    sums = d.agg(
        c(user).alias("user"), c(text).alias("text"), c(media).alias("media"), c(deleted).alias("deleted"), c(user & forwarded).alias("fwd"), c(text & forwarded).alias("fwd_text"),
        c(media & forwarded).alias("fwd_media"), c(deleted & forwarded).alias("fwd_deleted"), c(text & ~forwarded).alias("plain_text"), c(deleted & F.col("deleted_by_admin")).alias("by_admin"), c(media & (F.col("media_type") == "album")).alias("album"),
    )
    seconds = d.where(deleted & F.col("datetime").isNotNull()).groupBy("date", "datetime").agg(F.count(F.lit(1)).alias("n"))
    dates = seconds.groupBy("date").agg(F.sum("n").alias("n"), F.max("n").alias("in_second")).agg(F.count(F.lit(1)).alias("del_dates"), F.max("n").alias("max_date"), F.max("in_second").alias("max_second"))
    tokens = corpus.agg(F.count(F.lit(1)).alias("corpus"), c(F.array_contains("tokens", URL)).alias("url"), c(F.array_contains("tokens", PHONE)).alias("phone"))
    one = sums.join(F.broadcast(dates), F.lit(True)).join(F.broadcast(tokens), F.lit(True))  # one row each
    col = F.col
    rows = [
        ("forwarded_user_rows", col("fwd"), col("user"), "user rows"), ("forwarded_text_messages", col("fwd_text"), col("text"), "text messages"), ("forwarded_media_rows", col("fwd_media"), col("media"), "media rows"),
        ("forwarded_deleted_rows", col("fwd_deleted"), col("deleted"), "deleted rows"), ("non_forwarded_text_messages", col("plain_text"), col("text"), "text messages"), ("deleted_rows", col("deleted"), col("user"), "user rows"),
        ("deleted_by_admin_rows", col("by_admin"), col("deleted"), "deleted rows"), ("dates_with_deleted_rows", col("del_dates"), col("deleted"), "deleted rows"), ("max_deleted_rows_on_one_date", col("max_date"), col("deleted"), "deleted rows"),
        ("max_deleted_rows_in_one_second", col("max_second"), col("deleted"), "deleted rows"), ("media_rows", col("media"), col("user"), "user rows"), ("album_rows", col("album"), col("media"), "media rows"),
        ("text_messages_with_url", col("url"), col("corpus"), "text messages"), ("text_messages_with_phone_pattern", col("phone"), col("corpus"), "text messages"),
    ]
    return one.select(F.inline(_long(rows)))


def length_summary(corpus: DataFrame) -> DataFrame:
    """measure, n, min, q25, median, q75, max, mean of masked characters and of tokens; quantiles are exact. Values are counted before they are ranked."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("v")) for m, v in (("characters_masked_text", F.char_length("text_masked")), ("tokens", F.size("tokens")))])
    counts = corpus.select(F.inline(measures)).groupBy("measure", "v").agg(F.count(F.lit(1)).alias("f"))
    q = lambda p: F.percentile("v", p, F.col("f"))
    sums = counts.groupBy("measure").agg(F.sum("f").alias("n"), F.min("v").alias("min"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max("v").alias("max"), F.bround(F.sum(F.col("v") * F.col("f")) / F.sum("f"), 2).alias("mean"))
    domain = corpus.sparkSession.createDataFrame([("characters_masked_text",), ("tokens",)], "measure string")
    return domain.join(sums, "measure", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def max_in_one_second(d: DataFrame) -> DataFrame:
    """The most rows that share a second."""
    return d.where("datetime is not null").groupBy("datetime").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_rows"))
