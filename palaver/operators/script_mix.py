"""Script composition of messages, by variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scripts, text
from ..functions.constants import MESSAGE_CLASSES, SHARE_BANDS
from .corpus import VARIANTS, variant_rows

FIELDS = ("alphabetic_tokens", "latin_tokens", "devanagari_tokens", "other_tokens", "mixed_token_tokens", "latin_letters", "devanagari_letters", "other_letters", "alternations")


def profiles(corpus: DataFrame) -> DataFrame:
    """chat, line_start, is_repeat and the profile of each message."""
    return scripts.with_profile(corpus).select("chat", "line_start", "is_repeat", *FIELDS, "devanagari_share", "message_class", "is_short")


def profile_text(spark: SparkSession, said: str | None) -> dict:
    """The profile of one text; null is a text without a token."""
    row = spark.createDataFrame([(said,)], "said string").select(text.analysis_tokens(text.clean_text(F.coalesce("said", F.lit("")))).alias("tokens"))
    return scripts.with_profile(row).select(F.size("tokens").alias("n_tokens"), *FIELDS, "devanagari_share", "message_class", "is_short").first().asDict()


def summary(profiled: DataFrame) -> DataFrame:
    """variant, message_class, messages, denominator, short_messages: all classes of both variants."""
    counts = variant_rows(profiled).groupBy("variant", "message_class").agg(F.count(F.lit(1)).alias("m"), F.count_if("is_short").alias("s"))
    domain = profiled.sparkSession.createDataFrame([(v, c) for v in VARIANTS for c in MESSAGE_CLASSES], "variant string, message_class string")
    full = domain.join(counts, ["variant", "message_class"], "left").select("variant", "message_class", F.coalesce("m", F.lit(0)).alias("messages"), F.coalesce("s", F.lit(0)).alias("short_messages"))
    return full.withColumn("denominator", F.sum("messages").over(W.partitionBy("variant")))  # ten rows


def band_name(low: float, high: float) -> str:
    return f"share_{low:g}_to_{high:g}"


def stats(profiled: DataFrame) -> DataFrame:
    """variant, metric, value, denominator: 23 metrics of both variants, null where there is none."""
    mixed = F.col("message_class") == "mixed_script"
    share, alternations = F.when(mixed, F.col("devanagari_share")), F.when(mixed, F.col("alternations"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n, m, tokens = F.count(F.lit(1)), F.count_if(mixed), total("alphabetic_tokens")
    metrics = {
        "mixed_script_messages": (m, n), "mixed_messages_with_alternation": (F.count_if(mixed & (F.col("alternations") > 0)), m), "total_alternations": (total("alternations"), None),
        "median_alternations_mixed": (F.percentile(alternations, 0.5), m), "max_alternations_mixed": (F.max(alternations), m),
        "min_devanagari_share_mixed": (F.bround(F.min(share), 4), m), "median_devanagari_share_mixed": (F.bround(F.percentile(share, 0.5), 4), m), "max_devanagari_share_mixed": (F.bround(F.max(share), 4), m),
        **{band_name(a, b): (F.count_if((share > a) & (share <= b) & (share < 1.0)), m) for a, b in SHARE_BANDS},
        "mixed_messages_devanagari_share_0": (F.count_if(share == 0.0), m), "mixed_messages_devanagari_share_1": (F.count_if(share == 1.0), m),
        "no_alphabetic_messages": (F.count_if(F.col("message_class") == "no_alphabetic"), n), "short_messages_all_classes": (F.count_if("is_short"), n),
        **{f"alphabetic_tokens_{k}": (total(f"{c}_tokens"), tokens) for k, c in (("latin", "latin"), ("devanagari", "devanagari"), ("other", "other"), ("mixed", "mixed_token"))},
        **{f"letters_{k}": (total(f"{k}_letters"), None) for k in ("latin", "devanagari", "other")},
    }
    wide = variant_rows(profiled).groupBy("variant").agg(
        F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), (F.lit(None) if d is None else d).cast("long").alias("denominator")) for k, (v, d) in metrics.items()]).alias("rows")
    )
    return wide.select("variant", F.inline("rows"))
