"""What a row is: media, deleted, forwarded, system sentences and their categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BOUND, MEDIA_KINDS, MEDIA_LABELS, SYSTEM_QUOTES, SYSTEM_VERBS, WS
from .text import strip_invisible, strip_space

_WORDLIKE = r"\p{L}\p{N}_"


def media_type(message: Column) -> Column:
    """The kind of a media placeholder, else null: bracketed ones anywhere in the text, bare ones as the whole of a one-line text."""
    text = strip_space(strip_invisible(message))
    one_line = ~text.contains("\n")
    kind = lambda pattern: F.lower(F.regexp_extract(text, pattern, 1))
    bracketed, bare = rf"(?iu)<({MEDIA_KINDS}) omitted>", rf"(?iu)\A({MEDIA_KINDS}) omitted\z"
    call = rf"(?iu)\A(?:missed )?(?:voice|video) call(?:, [{_WORDLIKE} :.]{{1,30}})?\z"
    found = (
        F.when(text.rlike(bracketed), kind(bracketed))
        .when(text.rlike(r"(?iu)<unknown message>"), "unknown")
        .when(text.rlike(r"(?iu)<album message>"), "album")
        .when(text.rlike(r"(?iu)<attached: [^<>\n]{1,200}>"), "attachment")
        .when(one_line & text.rlike(bare), kind(bare))
        .when(one_line & text.rlike(call), "call")
    )
    labels = F.create_map(*[F.lit(x) for pair in MEDIA_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, found), found)


def is_deleted(message: Column) -> Column:
    text = strip_space(strip_invisible(message))
    return text.rlike(rf"(?iu)\A[^{_WORDLIKE}<\n]{{0,3}}{WS}*(?:this message was deleted|you deleted this message)")


def is_forwarded(message: Column) -> Column:
    return strip_space(strip_invisible(message)).startswith("[Forwarded]")


def system_sentence(sender: Column) -> Column:
    """Whether what stands before a colon reads like a system event: a system verb, and four words or a quotation mark."""
    words = F.size(F.filter(F.split(sender, f"{WS}+"), lambda w: w != ""))
    return sender.rlike(rf"(?iu){BOUND}(?:{SYSTEM_VERBS}){BOUND}") & ((words >= 4) | sender.rlike(f"[{SYSTEM_QUOTES}]"))


def user_kind(message_type: Column, media: Column, deleted: Column) -> Column:
    """media, deleted or text for user rows; empty for others."""
    return F.when(message_type != "user", "").when(media, "media").when(deleted, "deleted").otherwise("text")


def system_category(message: Column) -> Column:
    """The kind of a system event, by its wording."""
    text = F.lower(F.coalesce(message, F.lit("")))
    settings = r"changed settings|changed this group's settings|changed (?:the|this) group(?:'s)? (?:name|subject|description|icon)|changed the subject"
    return (
        F.when(text.contains("security code changed"), "security_code_changed")
        .when(text.rlike(f"{BOUND}(?:added|joined){BOUND}"), "member_added")
        .when(text.rlike(settings), "settings_changed")
        .otherwise("other_system_event")
    )


def deleted_by_admin(message: Column, deleted: Column) -> Column:
    return deleted & F.lower(message).contains("deleted by admin")


def unknown_placeholder(message: Column) -> Column:
    """A short text that ends in "omitted" and is no known placeholder."""
    return message.rlike(rf"(?iu)\A{WS}*<?{WS}*(?:[{_WORDLIKE}-]+ ){{0,2}}[{_WORDLIKE}-]+ omitted{WS}*>?{WS}*\z")
