import numpy as np
import pytest

from palaver.llm import embed_dedup as e


def rows():
    r = np.random.default_rng(2)
    base = r.normal(size=(6, 16))
    x = [base[k % 6] + r.normal(size=16) * r.choice([0.02, 0.2, 0.4]) for k in range(120)] + list(r.normal(size=(40, 16)))
    out = [(k, [float(np.float32(c)) for c in v], k % 3) for k, v in enumerate(x)]
    out += [(200, out[5][1], 0), (201, out[5][1], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [None] + [1.0] * 15, 0), (205, [float("nan")] + [1.0] * 15, 0), (206, [float("inf")] + [1.0] * 15, 0), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0), (209, [], 0), (210, [1e-30] * 16, 0), (211, [2e-30] * 16, 0), (212, [-1e200] * 16, 0), (213, [-3e200] * 16, 0), (214, [-1e-200] * 16, 0)]
    return out


def brute(data):
    good = {i: np.array(v, float) / np.max(np.abs(v)) for i, v, _ in data if v and None not in v and np.isfinite(v).all() and np.any(v)}
    near = {i: set() for i, _, _ in data}
    for a, x in good.items():
        for b, y in good.items():
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                near[a].add(b)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("tile", [e.TILE, 20, 3])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(e, "TILE", tile)
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in e.link_embeddings(df).collect()}
    assert got == brute(data) and max(v[0] for v in got.values()) > 3


def test_bound_holds():
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, err = e.quantised(x)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(near - x @ x.T) <= err[:, None] + err + err[:, None] * err).all()


def test_edges(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert e.link_embeddings(df).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 7), (1, [1.0, 0.0], 7), (None, [1.0, 0.0], 7)], "vec_id long, embedding array<float>, n_links int")
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in e.link_embeddings(twice).collect())[1:] == [(1, 1), (1, 1)]
