import random

import pytest

from palaver.llm import decontaminate as d

ITEMS = [
    (1, "Alice has 3 apples and gives 2 kg of them to Bob. How many apples does Alice keep after Bob leaves with 3 more?"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank while it rains on the hill"),
    (3, "too short here"),
    (4, "seven plain words stand in this item"),
    (5, None),
]
DOCS = [
    (10, "intro words " + ITEMS[0][1] + " outro words"),
    (11, "x Carol has 7 apples and gives 5 kg of them to Dan. How many apples does Carol keep after Dan leaves with 7 more? y"),
    (12, "x Carol has 7 apples and gives 5 kg of them to Dan. How many apples does Erin keep after Fred leaves with 9 more? y"),
    (13, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG NEAR THE OLD RIVER BANK WHILE IT RAINS ON THE HILL"),
    (14, "the quick brown fox went home and the lazy dog slept near the old river all day long"),
    (15, "says: seven plain words stand in this item!"),
    (16, "too short here"),
    (17, None),
    (18, ""),
    (19, "und das ist ein ganz anderer Text ohne Bezug. " * 400),
]


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("bits", [d.FILTER_BITS, 6])
def test_planted(tables, monkeypatch, bits):
    """Also with a filter that lets nearly all windows pass."""
    monkeypatch.setattr(d, "FILTER_BITS", bits)
    docs, bench = tables
    marked = d.mark(docs, bench)
    got = {r["doc_id"]: r["item_ids"] for r in marked.where("coverage is not null").collect()}
    assert got == {10: [1], 11: [1], 13: [2], 15: [4], 16: [3]} and marked.count() == len(DOCS)


def test_filter_and_edges(spark, tables):
    docs, bench = tables
    more = docs.selectExpr("*", "'x' item_ids", "1 coverage", "doc_id other")
    kept = d.keep_clean(more.union(more), bench)
    assert kept.columns == more.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted([12, 14, 17, 18, 19] * 2)
    assert d.find(docs, bench.where("false")).count() == 0 and d.find(docs.where("false"), bench).count() == 0
    assert {r["doc_id"] for r in d.find(docs, bench).collect()} == {10, 11, 13, 15, 16}


def test_against_brute_force(spark):
    """Exact passages of random text, whole or cut: found if half of the item or 13 words in a row are there."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(3000)]
    items = [(k, " ".join(r.choices(words, k=r.randint(15, 50)))) for k in range(30)]
    docs, want = [], {}
    for k in range(200):
        text = r.choices(words, k=r.randint(0, 200))
        if k % 3 == 0:
            i, item = r.choice(items)
            w = item.split()
            a = r.randint(0, len(w) // 2)
            b = r.randint(a + 1, len(w))
            at = r.randint(0, len(text))
            text[at:at] = w[a:b]
            if b - a >= 13 or b - a >= 8 and (b - a) / len(w) >= 0.5:
                want[k] = [i]
        docs.append((k, " ".join(text)))
    found = d.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"]: x["item_ids"] for x in found.collect()} == want and len(want) > 20


def test_an_edited_slot(spark):
    """A changed number or name takes away its own windows only, in verbatim copies and in re-parameterised ones; a chance form stays out."""
    item = ITEMS[0][1]
    story = "In spring the 4 farmers sold 20 crates of red apples to the old mill. The miller paid 4 coins for each. In autumn the farmers came back with 20 more crates and the price fell by half."
    again = DOCS[1][1]
    docs = [
        (1, item.replace("3 more", "4 more")), (2, item.replace("has 3", "has 2")), (3, item.replace("Bob leaves", "Alice leaves")),
        (4, story.replace("In autumn", "By autumn").replace("20 more", "30 more")), (5, story.replace("The miller", "Her miller")), (6, "some words " + story.replace("paid 4", "paid 5") + " and more"),
        (7, again.replace("7 more", "8 more")), (8, DOCS[2][1]), (9, DOCS[4][1]),
    ]
    bench = spark.createDataFrame([(1, item), (2, story)], "item_id long, text string")
    got = {r["doc_id"]: r for r in d.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {k: r["item_ids"] for k, r in got.items()} == {1: [1], 2: [1], 3: [1], 4: [2], 5: [2], 6: [2], 7: [1]}
    assert got[1]["coverage"] == 22 / 24 and got[7]["coverage"] == 22 / 24


def test_re_parameterised_copies(spark):
    """Questions with other numbers and names, equal numbers among them, and with one slot at odds: at least 9 of 10 are found, and no unrelated question."""
    r = random.Random(11)
    plain = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(500)]
    names = ["Alice", "Bob", "Carol", "Dan", "Erin", "Fred", "Grace", "Hugo"]

    def question():
        return [("name", r.randrange(3)) if r.random() < 0.12 else ("number", r.randrange(3)) if r.random() < 0.15 else r.choice(plain) for _ in range(r.randint(24, 40))]

    def told(q, who, many):
        return [x if isinstance(x, str) else who[x[1]] if x[0] == "name" else many[x[1]] for x in q]

    bench, docs, want = [], [], {}
    for k in range(60):
        q = question()
        bench.append((k, " ".join(told(q, r.sample(names, 3), [str(n) for n in r.sample(range(2, 99), 3)]))))
        many = [str(n) for n in r.sample(range(2, 99), 3)]
        if k % 3 == 1:
            many = [many[0]] * 3  # numbers that became equal
        words = told(q, r.sample(names, 3), many)
        if k % 3 == 2:
            at = r.choice([j for j, x in enumerate(q) if not isinstance(x, str)] or [0])
            words[at] = "Zoe's" if words[at].isalpha() else "1000"
        docs.append((k, " ".join(r.choices(plain, k=30) + words + r.choices(plain, k=30))))
        want[k] = [k]
    docs += [(100 + k, " ".join(told(question(), names[:3], ["1", "2", "3"]))) for k in range(60)]
    found = d.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    got = {x["doc_id"]: x["item_ids"] for x in found.collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.9 * len(want)


def test_rows_that_share_a_doc_id(spark):
    item = ITEMS[1][1]
    docs = [(1, item), (1, "clean words of another text"), (1, item), (None, item), (None, None), (2, "clean words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (None, item), (7, item)], "item_id long, text string")
    assert sorted(((x["doc_id"] or 0), x["item_ids"]) for x in d.find(df, bench).collect()) == [(0, [None, 7]), (1, [None, 7]), (1, [None, 7])]
    assert sorted((x["doc_id"] or 0, x["text"]) for x in d.keep_clean(df, bench).collect() if x["text"]) == [(1, "clean words of another text"), (2, "clean words")]
