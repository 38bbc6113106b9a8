import random
import re
from math import comb

import numpy as np
import pytest

from palaver.llm import ngram_join as nj

SCHEMA = "doc_id long, text string"


def brute(docs, threshold=0.8):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    near = {i: set() for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                near[a].add(b)
                near[b].add(a)
    least = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least[i] = min(seen)
    return {i: (least[i], len(near[i]), least[i] == i) for i in ids}


def made(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out, bases = [], [[r.choice(words) for _ in range(r.randint(1, 120))] for _ in range(8)]
    for k in range(n):
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(words)
        out.append((k, r.choice([" ", "  ", "\n"]).join(t)))
    return out + [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "one"), (n + 6, "x " * 30_000), (n + 7, "x " * 29_000)]


@pytest.mark.parametrize("tile", [nj.TILE, 4])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(nj, "TILE", tile)
    docs = made(1, 150)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in nj.ngram_links(spark.createDataFrame(docs, SCHEMA).repartition(7)).collect()}
    assert got == brute(docs)
    assert max(v[1] for v in got.values()) > 5


def test_edges(spark):
    assert nj.ngram_links(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f", "x", "p"), (1, "a b c d e f", "x", "p"), (2, "A b c d e f", "y", "q"), (None, "a b c d e f", None, None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_links string, class_id string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["kept"]) for r in nj.ngram_links(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (4, 4, 0, True)]
    kept = nj.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4]


def test_rows_that_share_a_doc_id(spark):
    """Only linked rows go; a doc_id with other texts keeps them."""
    a, b, c = "one two three four five six seven", "red green blue black white brown grey", "up down left right in out over"
    rows = [(7, a), (7, b), (7, b), (8, A := a.upper()), (9, c), (9, c), (3, b), (None, a), (None, a)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in nj.ngram_links(df).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (3, 3, 2), (7, 3, 2), (7, 3, 2), (7, 7, 1), (8, 7, 1), (9, 9, 1), (9, 9, 1)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in nj.keep_one(df).collect())
    assert kept == [(0, a), (0, a), (3, b), (7, a), (9, c)] and A not in [t for _, t in kept]


def test_first_key_is_judged_on_the_values_of_the_keys():
    """Bands that agree in a signature share their key, so no pair waits for a key under which it never meets."""
    full = nj.signature(np.arange(1 << 20, 1 << 22, 4099, dtype=np.uint64) << np.uint64(30))
    x = (full & np.uint32(0xFFFF)).astype("<u2")
    y = x.copy()
    y[4:] += np.uint16(1)
    same = (x[: nj.BANDS * nj.ROWS] == y[: nj.BANDS * nj.ROWS]).reshape(nj.BANDS, nj.ROWS).all(axis=1)
    assert same.tolist() == [True] + [False] * (nj.BANDS - 1) and ((nj.band_keys(x) == nj.band_keys(y)) == same).all()


def test_hot_group(spark, monkeypatch):
    """A group of near copies in many small tiles, by brute force."""
    monkeypatch.setattr(nj, "TILE", 16)
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [r.choice(words) for _ in range(90)]
    docs = []
    for k in range(260):
        t = list(base)
        t[r.randrange(90)] = f"x{k}"
        docs.append((k, " ".join(t)))
    docs += [(1000 + k, " ".join(r.choice(words) for _ in range(60))) for k in range(40)]
    got = {x["doc_id"]: (x["class_id"], x["n_links"], x["kept"]) for x in nj.ngram_links(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute(docs)
    assert nj.keep_one(spark.createDataFrame(docs, SCHEMA)).count() == 41


def test_posterior():
    """The fewest matches that leave the tolerance, by numeric integration of the posterior."""
    least = nj.least_matches(0.8, 1e-6)
    assert len(least) == nj.HASHES // nj.STEP

    def tail(m, n, cells=20_000):
        f = lambda s: comb(n, m) * s**m * (1 - s) ** (n - m) * (n + 1)
        return sum(f(0.8 + 0.2 * (k + 0.5) / cells) for k in range(cells)) * 0.2 / cells

    for k, m in enumerate(least[:3]):
        n = nj.STEP * (k + 1)
        assert tail(m, n) >= 1e-6 and (m == 0 or tail(m - 1, n) < 1e-6)
