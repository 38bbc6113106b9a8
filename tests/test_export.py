import pytest
from pyspark.sql import functions as F

from palaver.operators import gates, quality
from palaver.plans.config import Config, UserFacingError
from palaver.plans.run import RunManager, analyse, build_bundle, checked, key_findings, load_run, notice, run_export, summarise
from palaver.sources import export, synthetic
from palaver.sources.files import pre_validate


def parsed(spark, *lines):
    return export.messages(export.split_lines(spark.createDataFrame([("c", "\n".join(lines))], "chat string, value string")))


def test_rows_and_continuations(spark):
    m, failures = parsed(spark, "notice", "lost", "[1/2/27, 9:05:06 AM] Ann: hi", "more", "", "‎[1/2/27, 12:00:00 AM] - Bob left", "[13/2/27, 1:00:00 PM] Bob: x: y", '[1/3/27, 1:00:00 PM] Asha changed the subject from "A: B"', "[1/3/27, 1:00:01 PM] no colon", "", "")
    got = [(r["line_start"], r["line_end"], r["message_type"], r["sender"], r["message"], r["hour"], r["period"]) for r in m.orderBy("line_start").collect()]
    assert got == [
        (1, 1, "header", None, "notice", None, None), (3, 5, "user", "Ann", "hi\nmore\n", 9, "09-10"), (6, 6, "system", None, "Bob left", 0, "00-01"), (7, 7, "user", "Bob", "x: y", None, None),
        (8, 8, "system", None, 'Asha changed the subject from "A: B"', 13, "13-14"), (9, 9, "system", None, "no colon", 13, "13-14"),
    ]
    assert [r["line"] for r in failures.collect()] == ["lost"]


def test_whole_run_and_gates(spark, tmp_path):
    path = tmp_path / "chat.txt"
    path.write_text("\r\n".join(synthetic.SMALL) + "\r\n", encoding="utf-8")
    meta = run_export(spark, str(path), str(tmp_path / "out"))
    assert len(meta["checks"]) == 28 and all(c["passed"] for c in meta["checks"]) and meta["script_agreement"]["agrees"]
    comp = {(r["group"], r["category"]): r["count"] for r in spark.read.parquet(str(tmp_path / "out" / "analytics_row_composition")).collect()}
    assert (comp["user_rows", "media"], comp["user_rows", "deleted"], comp["user_rows", "text"], comp["parsed_rows", "header"], comp["parsed_rows", "system"]) == (5, 3, 23, 1, 6)
    m, _ = export.read_export(spark, str(path))
    found = summarise(spark, str(tmp_path / "out"))
    assert (found["parsed_rows"], found["text_messages"], found["participants"], found["reconciliation_checks_passed"], found["output_files"]) == (38, 23, 4, 28, 26) and len(found) == 11
    terms = [(-r["count_all"], r["ngram"]) for r in spark.read.parquet(str(tmp_path / "out" / "ngram_unigrams")).collect()]
    assert terms == sorted(terms) and len(terms) > 20
    tables, analytics, tf = load_run(spark, str(tmp_path / "out"))
    assert len(tables) == 19 and analytics["all_reconciliation_checks_passed"] and tf["variants"]["all"]["leave_one_out_top_k"]["runs"] == 23 and "empty_document_line_start" not in tf["variants"]["all"]
    tables["key_terms"].withColumn("sender", F.lit("x")).write.parquet(str(tmp_path / "bad" / "key_terms"))
    for name in tables.keys() - {"key_terms"}:
        tables[name].write.parquet(str(tmp_path / "bad" / name))
    with pytest.raises(UserFacingError):
        load_run(spark, str(tmp_path / "bad"))
    a = analyse(m)
    a.tables["analytics_hour_histogram"] = a.tables["analytics_hour_histogram"].where("hour_as_exported <> 9")
    with pytest.raises(gates.CheckFailed, match="hours"):
        checked(a)
    a.release()


def test_upload(spark):
    data = "\n".join(synthetic.SMALL).encode()
    manager = RunManager(spark)
    result, new = manager.submit(data, "chat.txt")
    assert new and not manager.submit(data, "chat.txt")[1]
    assert "sender" not in result.tables["analytics_sender_counts"].columns and "top10_terms_by_total_tfidf" not in str(result.tfidf_meta)
    assert 1 <= len(key_findings(spark, result)) <= 4
    assert build_bundle(spark, result)[:2] == b"PK" and notice(spark, result)["rows_hidden_single_message"] > 0
    assert list(result.tables["analytics_sender_counts"]["participant_id"]) == [f"Participant_{k}" for k in range(1, 5)]
    with pytest.raises(UserFacingError):
        manager.submit(b"no stamps here", "other.txt")
    assert manager.result is result


@pytest.mark.parametrize(("data", "name", "code"), [(b"x", "a.csv", "wrong_type"), (b"", "a.txt", "empty"), (b" \n", "a.txt", "empty"), (b"\xff\xfe", "a.txt", "not_utf8"), (b"x" * 2000, "a.txt", "too_large")])
def test_upload_codes(data, name, code):
    with pytest.raises(UserFacingError) as e:
        pre_validate(data, name, Config(max_upload_mb=0.001))
    assert e.value.code == code


@pytest.mark.parametrize(
    ("lines", "code"),
    [(["hello"], "unsupported_format"), (["[13/14/26, 1:00:00 PM] A: x", "[1/20/26, 1:00:00 PM] A: x"], "date_order_inconsistent"), (["[13/1/26, 1:00:00 PM] A: x"], "date_order_unsupported"), (["[2/30/26, 1:00:00 PM] A: x"], "dates_invalid"), (["[1/1/26, 1:00:00 PM] A: x"] * 3, "too_many_rows")],
)
def test_validation_codes(spark, lines, code):
    with pytest.raises(UserFacingError) as e:
        quality.post_validate(*parsed(spark, *lines), Config(max_parsed_rows=2))
    assert e.value.code == code


def test_config():
    assert Config.from_env({"WA_MAX_PARSED_ROWS": "7", "WA_TOP_K_DEFAULT": "x"}) == Config(max_parsed_rows=7)


def test_generator(spark):
    m, failures = export.messages(synthetic.synthetic_lines(spark, 100))
    assert m.count() == 100 and failures.count() == 0 and m.where("is_media").count() > 3 and m.where("is_deleted").count() == 2


def test_fixture_chat(spark):
    lines = synthetic.fixture_lines(spark, 700, seed=4, phone_sender="+91 90000 54321").orderBy("line_no")
    rows = [r["line_no"] for r in lines.collect()]
    assert rows == list(range(1, len(rows) + 1)) and lines.collect() == synthetic.fixture_lines(spark, 700, seed=4, phone_sender="+91 90000 54321").repartition(5).orderBy("line_no").collect()
    m, failures = export.messages(lines)
    kinds = {r["k"]: r["n"] for r in m.selectExpr("case when message_type <> 'user' then message_type when is_media then 'media' when is_deleted then 'deleted' when is_forwarded then 'forwarded' when line_end > line_start then 'long' else 'text' end k").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert failures.count() == 0 and kinds["header"] == 1 and kinds["system"] == 5 and kinds["long"] == 21 and 20 < kinds["media"] < 70 and 8 < kinds["deleted"] < 40 and 8 < kinds["forwarded"] < 40
    assert m.where("sender like '+91%'").count() > 30 and m.where("datetime is null and message_type = 'user'").count() == 0


def test_stability_against_a_loop(spark):
    import math
    from collections import Counter

    from palaver.operators import tfidf

    docs = [["x", "x", "x", "y"], ["p"], ["q"], ["r"], ["x", "q"]]

    def best(some, k):
        n, df = len(some), Counter(t for d in some for t in set(d))
        total = Counter()
        for d in some:
            raw = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(d).items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            for t, v in raw.items():
                total[t] += v / norm
        return {t for _, t in sorted((-round(v, 12), t) for t, v in total.items())[:k]}

    want = [len(best(docs, 2) & best(docs[:i] + docs[i + 1 :], 2)) / 2 for i in range(len(docs))]
    got = tfidf.stability(spark.createDataFrame([("c", k, d) for k, d in enumerate(docs)], "chat string, line_start long, terms array<string>"), k=2).first()
    assert (got["runs"], got["min_overlap"], got["argmin"]) == (5, min(want), want.index(min(want)))
    assert got["mean_overlap"] == pytest.approx(sum(want) / 5, abs=1e-4)
    assert tfidf.stability_indices(1000)[:3] == [0, 17, 34] and len(tfidf.stability_indices(1000)) == 60
