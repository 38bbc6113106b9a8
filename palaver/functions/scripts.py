"""Writing systems of tokens and messages (not languages)."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DEVANAGARI, DEVANAGARI_BLOCK, LATIN, PHONE, SHORT_TOKENS, URL


def token_script(token: Column) -> Column:
    """placeholder, devanagari (any code point of the block), latin (any ASCII letter) or other."""
    return F.when(token.isin(URL, PHONE), "placeholder").when(token.rlike(DEVANAGARI_BLOCK), "devanagari").when(token.rlike("[A-Za-z]"), "latin").otherwise("other")


def _letters(token: Column, keep: str) -> Column:
    return F.char_length(F.regexp_replace(token, f"[^{keep}]", ""))


def token_profile(token: Column) -> Column:
    """label (latin, devanagari, other, mixed_token; null without letters) and the letters of each script."""
    # a token of ASCII alone needs no expression: its letters are Latin
    plain = F.octet_length(token) == F.char_length(token)
    none = F.lit(0)
    latin = F.when(plain, F.char_length(token) - F.char_length(F.translate(token, ascii_letters, ""))).otherwise(_letters(token, LATIN))
    devanagari = F.when(plain, none).otherwise(_letters(token, DEVANAGARI))
    other = F.when(plain, none).otherwise(_letters(token, r"\p{L}") - _letters(F.regexp_replace(token, f"[^{LATIN}{DEVANAGARI}]", ""), r"\p{L}"))

    def labelled(c: Column) -> Column:
        latin, devanagari, other = (c[k] for k in ("latin", "devanagari", "other"))
        kinds = (latin > 0).cast("int") + (devanagari > 0).cast("int") + (other > 0).cast("int")
        label = F.when(kinds == 0, F.lit(None).cast("string")).when(kinds > 1, "mixed_token").when(latin > 0, "latin").when(devanagari > 0, "devanagari").otherwise("other")
        return F.struct(label.alias("label"), latin.cast("long").alias("latin"), devanagari.cast("long").alias("devanagari"), other.cast("long").alias("other"))

    # by way of an array of one, so that the letters are counted once
    return F.transform(F.array(F.struct(latin.alias("latin"), devanagari.alias("devanagari"), other.alias("other"))), labelled)[0]


def lettered(tokens: Column) -> Column:
    """The profiles of the tokens that have letters."""
    return F.filter(F.transform(F.filter(tokens, lambda t: ~t.isin(URL, PHONE)), token_profile), lambda p: p["label"].isNotNull())


def message_profile(marked: Column) -> Column:
    """Counts of labels and letters, and alternations between neighbouring labels, of lettered()."""
    count = lambda name: F.size(F.filter(marked, lambda p: p["label"] == name)).cast("long")
    letters = lambda name: F.aggregate(marked, F.lit(0).cast("long"), lambda a, p: a + p[name])
    n = F.size(marked)
    rest = F.greatest(n - 1, F.lit(0))
    steps = F.zip_with(F.slice(marked, F.lit(1), rest), F.slice(marked, F.lit(2), rest), lambda a, b: a["label"] != b["label"])
    return F.struct(
        n.cast("long").alias("alphabetic_tokens"),
        *[count(k).alias(f"{k}_tokens") for k in ("latin", "devanagari", "other", "mixed_token")],
        *[letters(k).alias(f"{k}_letters") for k in ("latin", "devanagari", "other")],
        F.when(n > 1, F.size(F.filter(steps, lambda x: x))).otherwise(0).cast("long").alias("alternations"),
    )


def with_profile(df, tokens: str = "tokens"):
    """df with the profile's fields, devanagari_share (null without alphabetic tokens), message_class and is_short."""
    # in steps, so that the tokens' profiles are worked out once and not once for each field
    df = df.withColumn("_marked", lettered(F.col(tokens))).withColumn("_p", message_profile(F.col("_marked")))
    df = df.select("*", "_p.*").drop("_p", "_marked")
    n = F.col("alphabetic_tokens")
    only = lambda script: F.col(f"{script}_tokens") == n
    kind = F.when(n == 0, "no_alphabetic").when(only("latin"), "latin_only").when(only("devanagari"), "devanagari_only").when(only("other"), "other_script_only").otherwise("mixed_script")
    return df.withColumns({"devanagari_share": F.when(n > 0, F.col("devanagari_tokens") / n), "message_class": kind, "is_short": n <= SHORT_TOKENS})
