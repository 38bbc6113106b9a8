import random
from collections import defaultdict

import pytest

from palaver.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def filled(sizes, weights=(5, 2, 1), ratio=1.5, most=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, free = ratio * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def made():
    r = random.Random(9)
    docs = [(k, " ".join(["w"] * r.choice([0, 1, 5, 20, 60])), r.choice(["a", "b", "b", "b", "c", "d", "é", None])) for k in range(600)]
    return docs + [(700, None, "a"), (701, "", "empty"), (702, "x y", "b"), (702, "x y", "b")]


def test_targets_and_samples(spark):
    docs = made()
    df = spark.createDataFrame(docs, SCHEMA)
    rows = mixing.mix_copies(df).collect()
    assert len(rows) == len(docs)
    size, taken, target, biggest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for i, t, s in docs:
        size[s] += len((t or "").split())
        biggest[s] = max(biggest[s], len((t or "").split()))
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 and r["source_size"] == size[r["source"]]
    want = filled(size)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= biggest[s]
    key = lambda rs: sorted((r["doc_id"], r["source"] or "", r["copies"]) for r in rs)
    assert key(rows) == key(mixing.mix_copies(df.repartition(5)).collect())
    assert key(rows) != key(mixing.mix_copies(df, seed=18).collect())


def test_order_by_ranks(spark):
    """The documents taken are the first ones by rank, whatever the histograms do."""
    df = spark.createDataFrame([(k, "w w w", "b" if k % 4 else "a") for k in range(400)], SCHEMA)
    again = mixing.mix_copies(df).collect()
    by = defaultdict(list)
    for r in again:
        by[r["source"]].append(r["copies"])
    for s, copies in by.items():
        target = next(r["target"] for r in again if r["source"] == s)
        assert abs(sum(copies) * 3 - target) <= 1.5 and max(copies) - min(copies) <= 1


def test_importance(spark):
    df = spark.createDataFrame([(k, "w " * 10, s, 3.0 if k % 2 else 1.0) for k in range(2000) for s in ("a", "b")], f"{SCHEMA}, imp double")
    n = defaultdict(int)
    for r in mixing.mix_copies(df, weights=(1,), ratio=0.4, importance="imp").collect():
        n[r["doc_id"] % 2] += r["copies"]
    assert 2.2 < n[1] / n[0] < 3.8  # inclusion follows importance
    assert n[0] + n[1] == pytest.approx(0.4 * 4000, abs=2)


def test_apply_and_edges(spark):
    df = spark.createDataFrame(made(), SCHEMA).selectExpr("*", "'x' size", "1 copies")
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    want = sum(r["copies"] for r in mixing.mix_copies(df).collect() if r["size"])
    assert out.count() == want
    assert mixing.mix_copies(df.where("false")).count() == 0 and mixing.apply_mix(df.where("false")).count() == 0


def test_pareto_order_with_unequal_odds(spark):
    """Which documents are taken: all of them ranked one by one in plain Python, with importances, repeated rows and a null doc_id."""
    r = random.Random(12)
    docs = [(k, " ".join(["w"] * r.choice([1, 3, 9, 30])), r.choice(["a", "b", "c"]), r.choice([0.5, 1.0, 2.0, 4.0])) for k in range(500)]
    docs += [(None, "w w", "a", 1.0), *[(900, "w " * 40, "a", 2.0)] * 7]
    df = spark.createDataFrame(docs, f"{SCHEMA}, imp double")
    keys = {(x["doc_id"], x["text"]): (x["k"], x["u"]) for x in df.select("doc_id", "text", mixing.text_key().alias("k")).selectExpr("doc_id", "text", "k", "(shiftrightunsigned(xxhash64(17, coalesce(doc_id, -1L), k), 12) + 0.5D) / 4503599627370496D u").collect()}
    size = lambda t: len(t.split())
    target = filled({s: sum(size(d[1]) for d in docs if d[2] == s) for s in "abc"}, (3, 2, 1), 0.6)
    want = defaultdict(int)
    for s in "abc":
        mine = [d for d in docs if d[2] == s]
        mass = sum(size(d[1]) * d[3] for d in mine)
        left, ranked = target[s], []
        for d in mine:
            e = min(2.0, target[s] * d[3] / mass)
            want[d[0], d[1]] += int(e + 1e-12)
            left -= size(d[1]) * int(e + 1e-12)
            p = e - int(e + 1e-12)
            k, u = keys[d[0], d[1]]
            if p > 0:
                ranked.append((int(u * (1 - p) / (u * (1 - p) + p * (1 - u)) * 2.0**48), -1 if d[0] is None else d[0], k, d))
        for *_, d in sorted(ranked, key=lambda x: x[:3]):
            if left < size(d[1]) / 2:
                break
            want[d[0], d[1]] += 1
            left -= size(d[1])
    got = defaultdict(int)
    for x in mixing.mix_copies(df, weights=(3, 2, 1), ratio=0.6, importance="imp").collect():
        got[x["doc_id"], x["text_key"]] += x["copies"]
    assert {(i, keys[i, t][0]): n for (i, t), n in want.items()} == dict(got)
