import pytest
from pyspark.sql import functions as F

from palaver.functions import classify, scripts, text


def values(spark, texts, f):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["v"] for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_clean_and_tokens(spark):
    assert values(spark, ["  A‎  B c\n", None, ""], text.clean_text) == ["a b c", "", ""]
    assert values(spark, ["रहा।", "don’t", "!!!", "a-b", "(x) “y”"], text.tokenize) == [["रहा"], ["don't"], [], ["a-b"], ["x", "y"]]


def test_masking(spark):
    got = values(
        spark,
        ["join https://chat.whatsapp.com/abc?x=1&y=2 now", "call +91 12345 67890 today", "meeting on 10-03-2026 14:30 at 5 pm paid 500 rupees", "[forwarded] [forwarded] x", "see [forwarded] note", "a.b@c-d.org, foo.com/x and éfoo.com", "नमस्तेfoo.com 9876543210", "x <this message was edited>"],
        text.analysis_tokens,
    )
    assert got[0] == ["join", "<URL>", "now"]
    assert got[1] == ["call", "<PHONE>", "today"]
    assert "<PHONE>" not in got[2]
    assert got[3] == ["forwarded", "x"]
    assert got[4] == ["see", "forwarded", "note"]
    assert got[5][:3] == ["<URL>", "<URL>", "and"] and "<URL>" not in got[5][3:]
    assert got[6] == ["नमस्ते", "<URL>", "<PHONE>"]
    assert got[7] == ["x"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(text.ngrams(F.col("t"), 2)).collect()] == [["a b", "b c"], [], []]
    with pytest.raises(ValueError):
        text.ngrams(F.col("t"), 0)


@pytest.mark.parametrize(
    ("message", "kind"),
    [("<image omitted> look at this", "image"), ("image omitted", "image"), ("I said image omitted yesterday", None), ("Missed voice call", "call"), ("<3", None), ("‎Video omitted", "video"), ("contact card omitted", "contact"), ("voice call, 3 min", "call")],
)
def test_media(spark, message, kind):
    assert values(spark, [message], classify.media_type) == [kind]


def test_rows(spark):
    assert values(spark, ["🚫 This message was deleted", "the file was deleted by mistake", "You deleted this message", "<this message was deleted"], classify.is_deleted) == [True, False, True, False]
    assert values(spark, ["Security code changed.", "A added B", "madded", "A changed the group name", "x"], classify.system_category) == ["security_code_changed", "member_added", "other_system_event", "settings_changed", "other_system_event"]
    assert values(spark, ['Asha changed the subject from "A', "Ann added", "Ann Lee of York added"], classify.system_sentence) == [True, False, True]
    assert values(spark, ["foo@bar", "a1 234-5678 9", "word", "see foo.com"], text.looks_sensitive) == [True, True, False, True]
    assert values(spark, ["<sticker pack omitted>", "omitted", "two words omitted"], classify.unknown_placeholder) == [True, False, True]


def test_scripts(spark):
    df = spark.createDataFrame([(1, ["group", "सुप्रभात", "रहा", "join"]), (2, ["<URL>", "12"]), (3, ["日本"]), (4, ["abcक"]), (5, ["a"])], "k int, tokens array<string>")
    got = {r["k"]: r for r in scripts.with_profile(df).collect()}
    assert (got[1]["message_class"], got[1]["alternations"], got[1]["devanagari_share"]) == ("mixed_script", 2, 0.5)
    assert (got[2]["message_class"], got[2]["devanagari_share"], got[2]["is_short"]) == ("no_alphabetic", None, True)
    assert [got[k]["message_class"] for k in (3, 4, 5)] == ["other_script_only", "mixed_script", "latin_only"]


def test_numbers_one_character_apart(spark):
    """The reference looks around a number and uses up no character, so both are masked."""
    assert values(spark, ["e6405768150e0411590525cf", "5405768150,7411590525"], text.analysis_tokens) == [["e", "<PHONE>", "e", "<PHONE>", "cf"], ["<PHONE>", "<PHONE>"]]
