import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.operators import activity, corpus, key_terms, ngrams, privacy, quality, repetition, script_mix, tfidf
from palaver.plans.config import UserFacingError
from palaver.sources import files, tables


def messages(spark, texts, senders=None):
    rows = [("c", k + 1, (senders or ["Ann"] * len(texts))[k], t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chat string, line_start long, sender string, message string")
    return df.selectExpr("*", "'user' message_type", "false is_media", "false is_deleted", "false is_forwarded").withColumn("clean_message", text.clean_text(F.col("message")))


def test_ngram_table(spark):
    rows = spark.createDataFrame([("c", k, t) for k, t in enumerate([["share", "photo"]] * 3 + [["share", "size"]])], "chat string, line_start long, tokens array<string>")
    got = {r["ngram"]: r for r in ngrams.ngram_table(rows, 2).collect()}
    assert (got["share photo"]["count_all"], got["share photo"]["count_unique"], got["share photo"]["msgs_all"], got["share photo"]["repetition_ratio"]) == (3, 1, 3, 3.0)
    assert ngrams.ngram_table(rows, 3).count() == 0


def docs(spark, lists):
    df = spark.createDataFrame([("c", k, t, False) for k, t in enumerate(lists)], "chat string, line_start long, tokens_no_stopwords array<string>, is_repeat boolean")
    return tfidf.documents(df.withColumn("tokens", F.col("tokens_no_stopwords")))


def test_tfidf(spark):
    w = tfidf.weights(docs(spark, [["a", "b", "b"], ["a", "c"], ["d"]])).where("variant = 'all'")
    got = {r["term"]: (r["df"], r["idf"]) for r in w.collect()}
    assert {t: d for t, (d, _) in got.items()} == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert got["a"][1] == pytest.approx(math.log(4 / 3) + 1) and got["d"][1] == pytest.approx(math.log(2) + 1)
    for r in w.groupBy("line_start").agg(F.sum(F.col("tfidf_norm") ** 2).alias("n")).collect():
        assert r["n"] == pytest.approx(1)
    with_empty = docs(spark, [["a"], [], ["a", "b"]])
    assert {r["variant"]: r["n"] for r in tfidf.document_counts(with_empty).collect()} == {"all": 3, "unique": 3}
    assert {r["term"]: r["df"] for r in tfidf.weights(with_empty).where("variant = 'all'").collect()} == {"a": 2, "b": 1}


def test_ranks_share_the_lowest(spark):
    tops = spark.createDataFrame([("all", "a", 2.0), ("all", "b", 2.0), ("all", "c", 1.0), ("all", "d", 0.001), ("unique", "a", 1.0)], "variant string, term string, total_tfidf double")
    got = {r["term"]: (r["rank_all"], r["rank_unique"], r["rank_change"]) for r in tfidf.variant_comparison(tops).collect()}
    assert got == {"a": (1, 1, 0), "b": (1, None, None), "c": (3, None, None), "d": (4, None, None)}


def test_key_terms(spark):
    rows = corpus.build_corpus(messages(spark, ["apple berry", "apple berry", "apple cherry"]))
    d = tfidf.documents(rows)
    table = key_terms.key_terms(d, tfidf.top_terms(tfidf.weights(d)), ngrams.ngram_table(rows, 1, "tokens_no_stopwords"))
    got = {r["term"]: (r["messages_containing"], r["unique_texts_containing"]) for r in table.collect()}
    assert got == {"apple": (3, 2), "berry": (2, 1), "cherry": (1, 1)}
    assert [r["term"] for r in key_terms.ranked(table, 2).orderBy("rank").collect()] == ["apple", "berry"] and key_terms.verify(table, rows).count() == 0


def test_repetition(spark):
    rows = corpus.build_corpus(messages(spark, ["see https://a.com/1", "see https://a.com/2", "hello", "hello", "once"], ["Ann", "Ben", "Ann", "Ann", "Cy"]))
    s = {r["metric"]: r["count"] for r in repetition.summary(rows).collect()}
    assert list(s.values()) == [5, 3, 2, 2, 2, 1, 1, 1]
    g = {r["template_id"]: r for r in repetition.groups(rows).collect()}
    assert (g["T1"]["distinct_raw_texts"], g["T1"]["contains_url"], g["T2"]["exact_raw_identical"], g["T2"]["first_date"]) == (2, True, True, None)
    assert {r["sender"]: r["sender_anon"] for r in rows.collect()} == {"Ann": "Sender_1", "Ben": "Sender_2", "Cy": "Sender_3"}
    with pytest.raises(ValueError):
        corpus.select_variant(rows, "other")


def test_calendar(spark):
    at = lambda d, h: dt.datetime(2026, 3, d, h)
    rows = [("c", 1, "user", "A", at(10, 9), False, False), ("c", 2, "user", "B", at(10, 9), True, False), ("c", 3, "system", None, at(13, 23), False, False), ("c", 4, "user", "A", None, False, False), ("c", 5, "user", "A", at(13, 1), False, True)]
    m = spark.createDataFrame(rows, "chat string, line_start long, message_type string, sender string, datetime timestamp_ntz, is_media boolean, is_deleted boolean").selectExpr("*", "'image' media_type", "false is_forwarded", "'x' message")
    d = activity.prepare(m)
    daily = activity.daily_activity(d).orderBy("date").collect()
    assert [r["total_rows"] for r in daily] == [2, 0, 0, 2] and [r["is_active"] for r in daily] == [True, False, False, True] and daily[0]["weekday"] == "Tuesday"
    assert {r["hour_as_exported"]: r["user_rows"] for r in activity.hour_histogram(d).collect()}[9] == 2
    week = {r["weekday"]: r for r in activity.weekday_table(d).collect()}
    assert week["Tuesday"]["active_dates"] == 1 and week["Monday"]["calendar_days_in_range"] == 0
    assert activity.daily_activity(d.where("date is null")).count() == 0
    assert {r["participant_id"]: r["user_rows"] for r in activity.sender_counts(d).collect()} == {"Participant_1": 3, "Participant_2": 1}


def test_empty_corpus_keeps_its_tables(spark):
    rows = corpus.build_corpus(messages(spark, ["x"])).where("false")
    assert [(r["n"], r["min"]) for r in activity.length_summary(rows).collect()] == [(0, None), (0, None)]
    assert {r["script"]: r["tokens_before"] for r in ngrams.script_diagnostics(rows).collect()} == dict.fromkeys(("latin", "devanagari", "placeholder", "other"), 0)
    assert script_mix.summary(script_mix.profiles(rows)).count() == 10
    assert all(r["count"] == 0 for r in repetition.summary(rows).collect())


def test_script_stats(spark):
    rows = corpus.build_corpus(messages(spark, ["group सुप्रभात रहा join", "सुप्रभात hello", "plain words", "!!"]))
    s = {(r["variant"], r["metric"]): r["value"] for r in script_mix.stats(script_mix.profiles(rows)).collect()}
    assert len(s) == 46 and (s["all", "mixed_script_messages"], s["all", "total_alternations"], s["all", "median_alternations_mixed"]) == (2, 3, 1.5)
    assert s["all", "share_0.25_to_0.5"] == 2 and s["all", "no_alphabetic_messages"] == 1


def test_privacy(spark):
    t = spark.createDataFrame([("word", 5), ("rare", 1), ("foo.com", 4), ("12345678", 4)], "ngram string, msgs_all long")
    shown = privacy.display_tables({"ngram_bigrams": t, "analytics_daily_activity": t})
    assert [r["ngram"] for r in shown["ngram_bigrams"].collect()] == ["word"] and shown["analytics_daily_activity"].count() == 4
    assert tuple(privacy.hidden_counts(t, "ngram", "msgs_all").first()) == (1, 2)
    with pytest.raises(UserFacingError) as e:
        privacy.approved({"key_terms": t.withColumn("sender", F.lit("x"))})
    assert e.value.code == "output_withheld"
    assert privacy.redacted({"a": {"top10_terms_by_total_tfidf": [1], "n": 2}}) == {"a": {"n": 2}}


def test_quality(spark):
    m = messages(spark, ["hi", "hi", "", "x" * 500] + ["hello there"] * 20, ["Ann", "Ann", "Ben", "A: b"] + [f"s{k}" for k in range(20)])
    got = {r["metric"]: r["value"] for r in quality.quality_report(m, columns=("sender", "message")).collect()}
    assert (got["total_rows"], got["duplicate_rows"], got["empty_messages"], got["unexpected_users"], got["unusually_long_messages"]) == (24, 1, 1, 1, 1)
    assert quality.long_messages(m).first()["n_chars"] == 500


def test_files(spark, tmp_path):
    schema = spark.createDataFrame([("a", 1)], "term string, n long").schema
    (tmp_path / "t.csv").write_text('term,n\n007,1\nNone,2\n"a ""b""",\n', encoding="utf-8")
    (tmp_path / "e.csv").write_text("", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv_typed(spark, str(tmp_path / "t.csv"), schema).collect()] == [("007", 1), ("None", 2), ('a "b"', None)]
    assert files.read_csv_typed(spark, str(tmp_path / "e.csv"), schema).count() == 0 and files.optional(spark, str(tmp_path / "none.csv"), schema) is None
    with pytest.raises(FileNotFoundError):
        files.required(spark, str(tmp_path / "none.csv"), schema, "run the step before")


def test_repository(spark, tmp_path):
    import zipfile

    from palaver.sources import repository

    lines = {
        "a.txt": ["ok", "call +44 7700 900123 4", "mail me@site.io", "mail me@example.com but 0207 is short and 5554443331 is not", "U+2066-2069", "https://example.org/x https://intern.al/x", "https://wa.me/1 chat.whatsapp.com/Gk3dQwErTy123"],
        "b.py": ['token = "s3cretvalue"  # example.com 12345', "AKIA" + "Q" * 16, "-----BEGIN RSA PRIVATE KEY-----", "number 9876512345"],
        ".env": ["x=1"],
    }
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows), encoding="utf-8")
    (tmp_path / "pic.png").write_bytes(b"\x89 me@site.io")
    (tmp_path / "raw.bin").write_bytes(b"\xff\xfe me@site.io")
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("inner.txt", "one\nmail me@site.io")
    (tmp_path / "priv").mkdir()
    chat = tmp_path / "priv" / "chat.txt"
    chat.write_text("[3/9/26, 9:00:00 AM] Quentin: the vault opens with the blue lever\n", encoding="utf-8")
    (tmp_path / "c.md").write_text("Said quentin: The vault opens with the BLUE lever.", encoding="utf-8")
    files = repository.candidates(str(tmp_path), everything=True)
    assert set(files) == {*lines, "pic.png", "raw.bin", "in.zip", "c.md", "priv/chat.txt"}
    got = sorted(map(tuple, repository.scan(spark, str(tmp_path), [f for f in files if "priv" not in f], str(chat)).collect()))
    assert got == sorted([
        ("a.txt", 2, "phone"), ("a.txt", 3, "email"), ("a.txt", 4, "phone"), ("a.txt", 6, "url"), ("a.txt", 7, "invite"), ("b.py", 1, "assignment"), ("b.py", 2, "key"), ("b.py", 3, "private_key"),
        (".env", 0, "file"), ("in.zip", 0, "file"), ("in.zip", 2, "email"), ("c.md", 1, "private sender"), ("c.md", 1, "private message"),
    ])


def test_library_agrees(spark):
    """TF-IDF against pyspark.ml: CountVectorizer, its inverse frequencies plus one, Normalizer."""
    import numpy as np
    from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    rows = corpus.build_corpus(messages(spark, ["apple berry apple", "berry cherry", "the", "apple berry apple", "date fig grape apple", "fig fig fig"]))
    d = tfidf.documents(rows)
    for v in corpus.VARIANTS:
        some = corpus.select_variant(d, v).select("line_start", "terms")
        counter = CountVectorizer(inputCol="terms", outputCol="tf", minDF=1).fit(some)
        tf = counter.transform(some)
        idf = IDF(inputCol="tf", outputCol="_").fit(tf).idf.toArray() + 1
        norm = Normalizer(inputCol="raw", outputCol="norm", p=2.0).transform(ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="raw").transform(tf))
        want = {(r["line_start"], counter.vocabulary[i]): x for r in norm.collect() for i, x in zip(r["norm"].indices, r["norm"].values, strict=True)}
        got = {(r["line_start"], r["term"]): r["tfidf_norm"] for r in tfidf.weights(d).where(F.col("variant") == v).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12 and np.isfinite(idf).all()


def test_notice_and_views(spark):
    rows = corpus.build_corpus(messages(spark, ["apple berry", "apple berry", "apple cherry", "see foo.com now", "12345678 apple"]))
    d = tfidf.documents(rows)
    uni, tops = ngrams.ngram_table(rows, 1, "tokens_no_stopwords"), tfidf.top_terms(tfidf.weights(d))
    every = {"ngram_unigrams": uni, "tfidf_top_terms": tops, "tfidf_variant_comparison": tfidf.variant_comparison(tops, uni), "key_terms": key_terms.key_terms(d, tops, uni)}
    for single in (False, True):
        shown, notice = privacy.display_tables(every, 2, single), privacy.display_notice(every, 2, single).first()
        assert sum(t.count() for t in every.values()) - sum(t.count() for t in shown.values()) == notice["rows_hidden_single_message"] + notice["rows_hidden_sensitive_pattern"]
        assert (notice["rows_hidden_single_message"] == 0) == single and notice["min_messages"] == 2
    assert tuple(ngrams.inflated(uni, 3).first()) == (3, 2)
    first = [r["term"] for r in tfidf.repetition_effect(every["tfidf_variant_comparison"], 2).collect()]
    assert len(first) == 2 and first[0] == "apple"
    p = script_mix.profile_text(spark, "सुप्रभात Hello https://a.com/x 12")
    assert (p["n_tokens"], p["latin_tokens"], p["devanagari_tokens"], p["message_class"]) == (4, 1, 1, "mixed_script") and script_mix.profile_text(spark, None)["message_class"] == "no_alphabetic"


def test_adapters(spark):
    c = spark.createDataFrame([(1, 0, "system", "Be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r["line_start"]: (r["message_type"], r["sender"], r["message"]) for r in tables.from_conversations(c).collect()}
    assert got == {0: ("system", None, "Be kind"), 1: ("user", "user", "hi"), 2: ("user", "assistant", "")}


def test_stability_of_documents(spark, tmp_path):
    """The registered query reads documents, leaves out 60 of more than 200, and agrees with a loop."""
    import math
    import random
    from collections import Counter

    from palaver.operators import tfidf
    from palaver.queries import QUERIES

    r = random.Random(3)
    words = [a + b for a in ("zor", "kel", "mip", "tav", "rud") for b in ("ka", "lo", "mi", "nu", "pe", "sa")]
    docs = [r.choices(words, weights=range(30, 60), k=r.randint(1, 12)) for _ in range(230)]
    docs[40] = docs[7]
    spark.createDataFrame([(10 * k, " ".join(d), "en", "web", 1) for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def best(some):
        n, df, total = len(some), Counter(t for d in some for t in set(d)), Counter()
        for d in some:
            raw = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(d).items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            total.update({t: v / norm for t, v in raw.items()})
        return {t for _, t in sorted((-round(v, 12), t) for t, v in total.items())[:10]}

    got = {x["variant"]: x for x in QUERIES["tfidf_stability"](spark, str(tmp_path)).collect()}
    for variant, some in (("all", docs), ("unique", [d for k, d in enumerate(docs) if d not in docs[:k]])):
        want = [len(best(some) & best(some[:i] + some[i + 1 :])) / 10 for i in tfidf.stability_indices(len(some))]
        assert len(want) == got[variant]["runs"] == 60 and got[variant]["min_overlap"] == min(want) and got[variant]["argmin"] == want.index(min(want))
        assert abs(got[variant]["mean_overlap"] - sum(want) / 60) < 1e-4 and min(want) < 1


def test_stability_leaves_no_tables_and_joins_rare_terms_alike(spark, tmp_path, monkeypatch):
    import os
    import random

    from palaver.operators import tfidf
    from palaver.plans import shared
    from palaver.queries import QUERIES

    r = random.Random(5)
    words = [a + b for a in ("zor", "kel", "mip", "tav", "rud") for b in ("ka", "lo", "mi", "nu", "pe", "sa")]
    docs = [(k, " ".join(r.choices(words, weights=range(30, 60), k=r.randint(0, 12)))) for k in range(230)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' lang", "'web' source", "1L n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    got = [sorted(map(tuple, QUERIES["tfidf_stability"](spark, str(tmp_path)).collect()))]
    monkeypatch.setattr(tfidf, "FREQUENT", 5)  # the other terms meet their documents by a shuffle
    got.append(sorted(map(tuple, QUERIES["tfidf_stability"](spark, str(tmp_path)).collect())))
    assert got[0] == got[1] and got[0][0][3] < 1 and os.listdir(f"{tmp_path}/shared") == []


def test_ratio_is_rounded_as_a_number(spark):
    rows = spark.createDataFrame([("c", k, ["x"] * n) for k, n in enumerate((29, 11, 11))], "chat string, line_start long, tokens array<string>")
    got = ngrams.ngram_table(rows, 1).first()
    assert (got["count_all"], got["count_unique"], got["repetition_ratio"]) == (51, 40, 1.27)


def test_equal_totals_share_a_rank_in_any_order_of_rows(spark):
    """Two terms with the same 20,000 weights, which come in the opposite order."""
    row = lambda term, at: spark.range(0, 20000, 1, 1).select(F.lit("all").alias("variant"), F.lit(term).alias("term"), F.lit("latin").alias("script"), F.lit(20000).alias("df"), F.lit(1.0).alias("idf"), (F.sqrt(at + 1) / 150).alias("tfidf_norm"), F.lit(9).alias("rank_in_message"))
    tops = tfidf.top_terms(row("a", F.col("id")).unionByName(row("b", 19999 - F.col("id"))).coalesce(1))
    got = {r["term"]: r for r in tops.collect()}
    assert got["a"]["total_tfidf"] == got["b"]["total_tfidf"] == pytest.approx(math.fsum(math.sqrt(k + 1) / 150 for k in range(20000)), rel=1e-15)
    assert got["a"]["mean_tfidf_in_docs"] == pytest.approx(got["a"]["total_tfidf"] / 20000)
    assert [r["rank_all"] for r in tfidf.variant_comparison(tops).collect()] == [1, 1]
