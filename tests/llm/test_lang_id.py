import random
import zlib
from collections import Counter

from palaver.llm import lang_id as li

WORDS = {"en": "the and of to in that is was for with this from".split(), "de": "der und das ist nicht mit für auf über eine sich dem".split(), "fr": "le et les des est que pour dans une avec être très".split()}


def made(n=240):
    r = random.Random(1)
    out = []
    for k in range(n):
        lang = r.choice(list(WORDS))
        out.append((k, " ".join(r.choices(WORDS[lang], k=r.randint(8, 40))).capitalize() + ".", lang if k % 10 else None))
    return out


def test_held_out_accuracy(spark):
    docs = made()
    truth = {k: l for (k, _, _), l in zip(docs, [next(x for x in WORDS if set(t.lower().strip(".").split()) <= set(WORDS[x])) for _, t, _ in docs], strict=True)}
    got = li.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_counts_and_distance_against_brute_force(spark):
    docs = made(60)

    def grams(text):
        out = Counter()
        for w in "".join(c.lower() if c.isalpha() else " " for c in text).split():
            out.update(w)
            w = f" {w} "
            out.update(w[k : k + n] for n in (2, 3) for k in range(len(w) - n + 1))
        return out

    def code(g):
        v = 0
        for c in g:
            v = v << 21 | ord(c)
        return v

    def order(c):
        return [code(g) for g in sorted(c, key=lambda g: (-c[g], code(g)))[: li.PROFILE]]

    train = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 != 1 and d[2]]
    want = {lang: order(sum((grams(t) for _, t, x in train if x == lang), Counter())) for lang in {x for _, _, x in train}}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert li.train(df.where(~li.fold())) == want
    for r in li.identify(df).collect():
        mine = order(grams(docs[r["doc_id"]][1]))
        far = {lang: sum(abs(k - p.index(g)) if g in p else li.PROFILE for k, g in enumerate(mine)) for lang, p in want.items()}
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best and abs(r["score"] - (1 - far[best] / (li.PROFILE * len(mine)))) < 1e-12


def test_edges(spark):
    rows = [*made(90), (900, None, "en"), (901, "", "en"), (902, "12 !? \n", "en"), (903, "日本語の文章", None), (904, "the " * 50_000, None), (905, "İ", None)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    got = {r["doc_id"]: r for r in li.identify(df).collect()}
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and got[904]["lang_pred"] == "en"
    kept = li.keep_known(df)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns and not ids & {900, 901, 902, 903} and set(range(90)) <= ids
    assert li.identify(df.where("false")).count() == 0
    assert {r["lang_pred"] for r in li.identify(df.withColumn("lang", df["lang_pred"].substr(9, 1)).where("false").union(df.where("lang is null"))).collect()} <= {"und", "en", "de", "fr"}


def test_junk_and_unlearned_languages_go(spark):
    """Latin letters alone don't make a known language; every labelled row stays, short ones too."""
    import base64

    r = random.Random(5)
    docs = [*made(900), *[(2000 + k, " ".join(r.choices(WORDS[lang], k=r.randint(1, 3))), lang) for k, lang in enumerate(r.choices(list(WORDS), k=300))]]
    noise = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    junk = [" ".join(noise(r.randint(2, 9)) for _ in range(40)), base64.b64encode(r.randbytes(300)).decode(), r.randbytes(150).hex(), "joka oli mutta kun niin hänen ovat myös jälkeen kuin vuonna tämä voi mukaan sitä ollut joita yli " * 2]
    rows = [*docs, *[(5000 + k, t, None) for k, t in enumerate(junk)]]
    kept = {x["doc_id"] for x in li.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept & set(range(5000, 5000 + len(junk)))
    assert {d[0] for d in docs} <= kept
