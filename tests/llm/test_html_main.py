import random
import time
from collections import Counter

from palaver.llm import html_main as h

LONG = "The quick brown fox is on the way to the big house, and it was not the first time that he had been there with all of them for some more food and so on in the end, as they all said to him at the time."


def test_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><!-- ad --><div class="ad">Buy now.</div>
    <header>Site name</header><article><h1>Head&amp;line</h1><p><b>One<i>two</i> three<br>four &#233;&nbsp;x.</p><aside>Side</aside><p>Short.<div class="comments"><p>{LONG}</p></div><form><p>Name</p></form>
    <ul><li>item one<li>item two</ul></article><section id="comments">{LONG}</section><footer>&copy; me</footer></body></html>"""
    assert h.main_text(page) == "Head&line Onetwo three four é x. Short. item one item two"


def test_without_an_article():
    page = f"<body><div class='sidebar'><p>{LONG}</p></div><div><h2>About it</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><p><a href=x>{LONG}</a></p></div><div class='cookie-notice'>{LONG}</div><p>Links: <a>one</a> <a>two</a></p></body>"
    assert h.main_text(page) == f"About it {LONG} Yes. {LONG}"


def test_broken_markup():
    assert h.main_text("<article><p>a < b <p>c <!-- open comment") == "a < b c"
    assert h.main_text("<article><p>a<script>x = 1") == "a"
    assert h.main_text("<article>x <b>bold</article><p><a>after</a>") == "x bold"
    assert h.main_text("<main><p title='a > b'>text</p></main>") == "text"
    assert h.main_text("plain text without any markup") in ("", "plain text without any markup")
    assert h.main_text("") == h.main_text("   ") == h.main_text("<p></p>") == ""
    assert h.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"


def test_rules_decide_without_containers():
    card = "<article class='card'><h3>Another story</h3><p>Read on.</p></article>"
    assert h.main_text(f"<body>{card}<div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div></body>") == f"{LONG} Yes. {LONG}"
    page = f"<body><nav><a href=x>Home page</a></nav><div>Buy it now.</div><article><h1>Title</h1><p>{LONG}</p><p>Kept.</p></article><div>Copyright © by all of us in the year.</div></body>"
    for tag in ("article", "div", "main", "section"):
        for hints in (True, False):
            assert h.main_text(page.replace("article", tag), hints) == f"Title {LONG} Kept."
    # the second pass settles what is short between blocks of links
    links = "<p><a href=x>one link after another</a></p>"
    assert h.main_text(f"<div><p>{LONG}</p>{links}<p>Share:</p>{links}<p>{LONG}</p></div>") == f"{LONG} {LONG}"
    # where nothing is good, the section with the most text
    assert h.main_text("<div>One.</div><div><h1>Head</h1><p>Two words.</p></div><p><a>x</a></p>") == "Head Two words."


def test_marks():
    for name in ("social-science", "no-share post-body", "adverse", "tags-of-life"):
        assert h.main_text(f"<div class='{name}'><p>{LONG}</p></div><div class='promo'><p>{LONG}</p></div>") == LONG
    assert h.main_text(f"<p>{LONG}</p><form><p>{LONG}</p></form><div class='comment-list'><p>{LONG}</p></div><div hidden>{LONG}</div>") == LONG
    assert h.main_text(f"<form><p>{LONG}</p></form>") == LONG  # a page in a form
    assert h.main_text(f"<p>{LONG}</p><p>{LONG} © {LONG}</p>") == f"{LONG} {LONG} © {LONG}"
    assert h.main_text(f"<p>{LONG}</p><script src='x' />var leak = 1;</script><p>{LONG}</p>") == f"{LONG} {LONG}"
    assert h.main_text(f"<p class='promo'>Buy<div><p>{LONG}</p></div><h2>Part</h2><p>{LONG}</p>") == f"{LONG} Part {LONG}"


def test_time_is_linear():
    """Hostile markup: four times as long takes about four times as long, not sixteen times."""
    for s in ('<a "', "<div>x", "</p>", "<p>x<b>y", "<p><b></p>", "<a href='"):
        took = []
        for n in (4000, 16000):
            began = time.process_time()
            h.main_text(s * n)
            took.append(time.process_time() - began)
        assert took[1] < 9 * max(took[0], 0.02), s


def slow_second_pass(page):
    """The rules once more, block by block."""
    if all(b.label != "good" for b in page):
        size = Counter()
        for b in page:
            if b.label != "bad":
                size[b.section] += len(b.text)
        main = min(size, key=lambda s: (-size[s], s), default=None)
        near = [b for b in page if b.label == "near" and 2 * size[b.section] >= size[main]]
        if not any(b.section == main for b in near):
            near = []
        for b in near or [b for b in page if b.section == main and b.label != "bad"]:
            b.label = "good"
    labels = [b.label for b in page]
    sure = [k for k, x in enumerate(labels) if x in ("good", "bad")]
    for k, b in enumerate(page):
        if k in sure:
            continue
        wall = next((j for j in range(k + 1, len(page)) if page[j].heading), len(page))
        for level in range(3):
            inside = (lambda j: page[j].section == b.section, lambda j: b.parent in (page[j].section, page[j].parent), lambda j: True)[level]
            left = max((j for j in sure if j < k and inside(j)), default=None)
            right = min((j for j in sure if j > k and inside(j)), default=None)
            if level and right is not None and not b.heading and right >= wall and page[wall].section != b.section:
                right = None
            if level < 2 and left is None and right is None or level == 1 and not b.parent:
                continue
            a, z = labels[left] if left is not None else None, labels[right] if right is not None else None
            if b.heading and z and (level < 2 or k + 1 == len(page) or page[k + 1].section != b.section):
                b.label = z
            elif level == 2:
                b.label = "good" if [a, z].count("good") >= (1 if labels[k] == "near" else 2) else "bad"
            elif not (a and z) or a == z:
                b.label = a or z
            elif k - left == right - k:
                b.label = "good" if labels[k] == "near" else "bad"
            else:
                b.label = a if k - left < right - k else z
            break


def test_two_passes_by_brute_force():
    r = random.Random(7)
    for _ in range(3000):
        sections = {0: 0}
        page = []
        for _ in range(r.randint(0, 14)):
            s = r.randrange(5)
            parent = sections.setdefault(s, r.randrange(max(1, s)))
            page.append((r.choice("ab") * r.randint(1, 40), s, parent, r.random() < 0.2, r.choice(["good", "bad", "near", "weak", "short", "short"])))
        mine, slow = ([h.Block(t, 0, head, s, p, False, False, label) for t, s, p, head, label in page] for _ in range(2))
        h.second_pass(mine)
        slow_second_pass(slow)
        assert [b.label for b in mine] == [b.label for b in slow], page


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<article>" + f"<p>{LONG}</p>" * 2000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in h.extract(df).collect()}
    assert got[1, "u"] == (LONG, len(LONG)) and got[2, None] == ("", 0) == got[None, "v"] and got[4, "w"][1] == 2000 * (len(LONG) + 1) - 1
    assert h.extract(df).count() == 5 and h.extract(df.where("false")).count() == 0
