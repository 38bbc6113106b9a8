import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(8)
    words = "the and of to in that is was for with this from house river tree light stone water road field cloud paper".split()
    text = lambda n: " ".join(r.choices(words, k=n))
    docs = [(k, text(r.randint(30, 80)), "en", f"s{k % 3}", 0) for k in range(80)]
    item = text(30)
    docs += [(100, docs[3][1], "en", "s0", 0), (101, docs[4][1] + " end", "en", "s1", 0), (102, f"{text(20)} {item} {text(20)}", "en", "s2", 0), (103, None, "en", "s0", 0), (104, "12 34 56", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == names
        now.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        left.append({x["doc_id"] for x in now.collect()})
    assert left[0] == {d[0] for d in docs} - {103, 104}
    assert left[1] == left[0] - {100, 101}
    assert left[2] == left[1] - {102}
    assert left[3] <= left[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in out) == sorted(x["doc_id"] for x in now.collect())


def test_empty_table_and_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own, null and repeated ids, and no row at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, item_ids string, class_id string, score string, size string, kept string, node string, t string"
    more = ("i", "c", "s", "z", "k", "n", "t")
    a, b = "the house of the river and the light of the stone on the road " * 3, "a tree and a field of water that was in the cloud with this paper " * 3
    rows = [(1, a, "en", "x", 1, *more), (1, a, "en", "x", 1, *more), (1, b, "en", "x", 1, *more), (None, a + "once", "en", None, None, *more), (2, None, None, None, None, *more), (3, "", "en", "x", 0, *more)]
    spark.createDataFrame([(7, "an item of the benchmark that nothing holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some, want in ((rows, [{1, None}, {1, None}, {1, None}]), ([], [set()] * 3)):
        now = spark.createDataFrame(some, schema)
        for (_, stage), left in zip(corpus_pipeline.STAGES[:3], want, strict=False):
            now = stage(spark, now, str(tmp_path))
            assert now.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            found = now.select(*[f"`{c}`" for c in now.columns]).collect()
            assert {x["doc_id"] for x in found} == left
            now = spark.createDataFrame(found, schema)
        assert not some or sorted((x["doc_id"] or 0, x["text"]) for x in found) == [(0, a + "once"), (1, b), (1, a)]
        mixed = corpus_pipeline.mix(spark, now, str(tmp_path))
        assert mixed.columns == now.columns
        assert corpus_pipeline.tokens(spark, mixed, str(tmp_path)).count() == mixed.count()
