import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from palaver.llm import common, ppm_score

DOCS = [(k, t) for k, t in enumerate(["the cat sat on the mat", "The CAT  sat\ton the hat", "a dog; a log", "", None, "über Äpfel und Öl", "zebra zzz qqq", "the cat sat on the mat", "x", "mat hat cat " * 40, "the", "cat cat", "other words here", "and more of the same", "last of the lot"])]
SCHEMA = "doc_id long, text string"


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(docs):
    low = {i: re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "") for i, t in docs}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t), None] for i, t in low.items()}
    c = Counter(w for i, t in docs if not held(i) for w in tokens[i])
    n, v = sum(c.values()), len(c)
    seen = defaultdict(Counter)
    for i, _ in docs:
        if not held(i):
            line = b"\xff" * 4 + low[i].encode() + b"\xff"
            for at in range(4, len(line)):
                for k in range(5):
                    seen[line[at - k : at]][line[at]] += 1

    def cost(context, symbol):
        total, gone = 0.0, set()
        for k in range(4, -1, -1):
            node = seen.get(context[4 - k :])
            if node is None:
                continue
            left = {s: x for s, x in node.items() if s not in gone}
            t, d = sum(left.values()), len(left)
            if symbol in left:
                return total + math.log10(left[symbol] / (t + d))
            if d:
                total += math.log10(d / (t + d))
            gone |= set(node)
        return total - math.log10(256 - len(gone))

    out = {}
    for i, _ in docs:
        line = b"\xff" * 4 + low[i].encode() + b"\xff"
        lm = sum(cost(line[at - 4 : at], line[at]) for at in range(4, len(line)))
        out[i] = (held(i), len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i]), lm)
    return out


@pytest.mark.parametrize("size", [1 << 20, 30])
def test_against_brute_force(spark, monkeypatch, size):
    """In one batch a task, and in batches of a document or two."""
    monkeypatch.setattr(ppm_score, "BATCH_BYTES", size)
    monkeypatch.setattr(common, "BLOCK_BYTES", size)
    monkeypatch.setattr(ppm_score, "blocks", lambda buf, offsets: common.blocks(buf, offsets, size))
    got = {r["doc_id"]: r for r in ppm_score.score(spark.createDataFrame(DOCS, SCHEMA).coalesce(2)).collect()}
    want = brute(DOCS)
    assert set(got) == set(want) and any(held(i) for i in want)
    for i, (out, n, known, train, base, lm) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(lm, rel=1e-9)


def test_empty_table_and_no_training(spark):
    assert ppm_score.score(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = next(i for i in range(100) if held(i))
    r = ppm_score.score(spark.createDataFrame([(alone, "ab")], SCHEMA)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (2, 0, 0, 0.0)
    assert r["score"] == pytest.approx(-3 * math.log10(256))
    none = spark.createDataFrame([(None, "the cat"), (None, None), (1, "the cat")], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"]) for r in ppm_score.score(none).collect()) == [(0, False, 1, 1), (0, False, 3, 3), (1, held(1), 3, 3)]
    extra = spark.createDataFrame([(1, "a", "x", 2.0)], "doc_id long, text string, held_out string, score double")
    assert ppm_score.score(extra).count() == 1
