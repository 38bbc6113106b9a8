"""Cleaning, masking and tokens as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BOUND, EDGE, MARKS, NOT_WS, PHONE, PLAIN_QUOTES, QUOTES, SENSITIVE, SENSITIVE_DIGITS, SHORT_LINKS, SPACE, STOPWORDS, TOP_LEVEL, URL, WS

LINK = (
    rf"(?iu)(?:https?://|www\.){NOT_WS}+"
    rf"|{BOUND}(?:{SHORT_LINKS})/{NOT_WS}*"
    rf"|{BOUND}[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+{BOUND}"
    rf"|{BOUND}[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{TOP_LEVEL}){BOUND}(?:/{NOT_WS}*)?"
)
#: A dot before a letter, or :// or @ or www. stands in every link.
LINK_SIGN = r"(?iu)\.\p{L}|://|@|www\."
#: Punctuation at the edges of words, but for the placeholders' own brackets.
EDGES = rf"(?={EDGE})(?:(?<![^ ])(?!(?:{URL}|{PHONE})(?![^ ])){EDGE}+|(?<!{URL[:-1]})(?<!{PHONE[:-1]}){EDGE}+(?![^ ]))"
#: Digits that a phone number has at least.
PHONE_SIGN = r"\+\p{Nd}|\p{Nd}(?:[ \-]?\p{Nd}){8}"
_ODD_SPACE = SPACE.replace(r"\x20", r"\x1f")
WORLD_PHONE = rf"\+\p{{Nd}}(?:[{SPACE}\-().]?\p{{Nd}}){{7,14}}"
_LOCAL = r"\p{Nd}(?:[ \-]?\p{Nd}){8,14}"
_DATE = r"\p{Nd}{1,4}[-/.]\p{Nd}{1,2}[-/.]\p{Nd}{2,4}"
#: A number that begins like a date is kept, by way of group 1.
LOCAL_PHONE = rf"(?<!\p{{Nd}})(?:((?={_DATE}){_LOCAL})|{_LOCAL})(?!\p{{Nd}})"


def strip_invisible(text: Column) -> Column:
    return F.translate(text, MARKS, "")


def strip_space(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def clean_text(text: Column) -> Column:
    """No invisible marks, single spaces, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(strip_invisible(F.coalesce(text, F.lit(""))), f"{WS}{{2,}}|[{_ODD_SPACE}]", " ")))


def normalise_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES, PLAIN_QUOTES)


def strip_edges(token: Column) -> Column:
    """Without punctuation at either end."""
    return F.regexp_replace(token, f"^{EDGE}+|{EDGE}+$", "")


def _where(text: Column, sign: str, change: Callable[[Column], Column]) -> Column:
    """change(text) where the text shows a sign, else the text, which is worked out once."""
    return F.transform(F.array(text), lambda t: F.when(t.rlike(sign), change(t)).otherwise(t))[0]


def _stripped_tokens(clean: Column) -> Column:
    """Tokens of a clean text (its white space is U+0020) without punctuation at their edges, placeholders as they are. All edges go in one pass, before the split."""
    return F.array_remove(F.split(F.regexp_replace(clean, EDGES, ""), " "), "")


def tokenize(clean: Column) -> Column:
    """Tokens of a clean text, edge punctuation gone, empty ones dropped."""
    return _stripped_tokens(normalise_quotes(clean))


def mask_urls(text: Column) -> Column:
    """Links, addresses and bare domains become the link placeholder. Only texts that hold what every link has go through the long expression."""
    return _where(text, LINK_SIGN, lambda t: F.regexp_replace(t, LINK, f" {URL} "))


def mask_phones(text: Column) -> Column:
    """Phone numbers become the phone placeholder; what begins like a date stays."""

    def masked(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, WORLD_PHONE, f" {PHONE} "), LOCAL_PHONE, "\u0001$1\u0002")
        return F.replace(t, F.lit("\u0001\u0002"), F.lit(f" {PHONE} "))

    return F.translate(_where(text, PHONE_SIGN, masked), "\u0001\u0002", "")


def strip_forwarded(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?iu)^{WS}*\[forwarded\]{WS}*", "")


def strip_edited(text: Column) -> Column:
    return _where(text, "<[^<>]*>", lambda t: F.regexp_replace(t, rf"(?iu){WS}*<this message was edited>{WS}*$", ""))


def analysis_tokens(clean: Column) -> Column:
    """Tokens for the text analyses: markers stripped, links and phone numbers masked, placeholders kept verbatim."""
    return _stripped_tokens(normalise_quotes(mask_phones(mask_urls(strip_edited(strip_forwarded(clean))))))


def remove_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def ngrams(tokens: Column, n: int) -> Column:
    """Every n consecutive tokens, joined by a space."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return tokens
    some = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<string>"))


def looks_sensitive(term: Column) -> Column:
    """A link, an address, a domain, or many digits."""
    digits = F.char_length(F.regexp_replace(term, r"[^\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]", ""))
    return term.rlike(f"(?iu){SENSITIVE}") | (digits >= SENSITIVE_DIGITS)


def clean_raw(text: Column) -> Column:
    return strip_space(F.translate(text, "‎", ""))

