"""Where the template decides: hosts without article marks or telling names, and classes against occurrence vectors."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from episodia.llm import html_extract as he


def name(rng):
    return "".join(rng.choice("bcdfghjkmnpqrtvwxz") for _ in range(7))


def words(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def host_pages(rng, pages):
    """Pages of a host with random names: a long text that all of them repeat, menus of plain text, and an article of its own in each."""
    a, b, c, d = (name(rng) for _ in range(4))
    terms, menu, tail = words(rng, 220), words(rng, 25), words(rng, 60)
    fixed = [f'<div class="{a}"><div><p>{terms}</p><p>{tail}</p></div></div>', f'<div class="{b}"><span>{menu}</span></div>']
    rng.shuffle(fixed)
    for _ in range(pages):
        paragraphs = [words(rng, rng.randrange(15, 40)) for _ in range(rng.randrange(1, 4))]
        article = f'<div class="{c}"><div class="{d}">' + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div></div>"
        yield f"<html><body>{fixed[0]}{article}{fixed[1]}</body></html>", " ".join(paragraphs)


def test_the_template_finds_what_a_page_alone_does_not(spark):
    rng = random.Random(6)
    rows = [(100 * h + i, f"http://host{h}.org/{i}", page, want) for h in range(5) for i, (page, want) in enumerate(host_pages(rng, 4 + h))]
    alone = [he.Page(page) for _, _, page, _ in rows]
    assert sum(p.text(p.largest()) == want for p, (*_, want) in zip(alone, rows)) == 0
    got = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {i: want for i, _, _, want in rows}


def test_pages_that_are_copies_keep_their_text(spark):
    rng = random.Random(7)
    page, want = next(host_pages(rng, 1))
    rows = [(i, "http://h.org/x", page) for i in range(6)] + [(10 + i, "http://m.org/x", "<body><article><p>Same text</p></article></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(want in got[i] for i in range(6)) and all(got[10 + i] == "Same text" for i in range(6))


def test_classes_are_those_of_the_occurrence_vectors(spark):
    rng = random.Random(8)
    rows = []
    for h in range(3):
        for i, (page, _) in enumerate(host_pages(rng, 6)):
            extra = "".join(f"<section class=s{k}><p>x</p></section>" for k in range(4) if rng.random() < 0.7) + "<i class=ad>y</i>" * rng.randrange(3)
            rows.append((i, f"http://h{h}.org/{i}", page.replace("</body>", extra + "</body>")))
    pages = he.with_wrappers(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame([], "host string, wrappers array<string>"))
    got = defaultdict(set)
    for r in he.equivalence_classes(pages).where("host is not null").collect():
        got[r["host"]].add(frozenset(m["token"] for m in r["members"]))
    want = defaultdict(set)
    for h in range(3):
        own = [he.Page(page) for _, url, page in rows if f"//h{h}." in url]
        vectors = defaultdict(lambda: [0] * len(own))
        for k, p in enumerate(own):
            for e in range(1, len(p.path)):
                vectors[he._hash(p.path[e])][k] += 1
            for e, text in p.blocks:
                vectors[he._hash(f"{p.path[e]}\t{text}")][k] += 1
        classes = defaultdict(set)
        for token, v in vectors.items():
            if sum(map(bool, v)) >= he.SUPPORT * len(own):
                classes[tuple(v)].add(token)
        want[f"h{h}.org"] = {frozenset(c) for c in classes.values()}
    assert got == want and all(len(c) > 2 for c in want.values())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><p>Lead</p><section id=related><p>Related work in words</p></section><section id=search><h2>Search</h2>methods</section></main>", "Lead Related work in words Search methods"),
        ("<article><p class=social>Social questions</p><p>More</p></article>", "Social questions More"),
        ("<article><p>Words of the text</p><div class=related><a href=1>One</a> <a href=2>Two</a></div></article>", "Words of the text"),
        ("<article><p>Since <math><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mn>4</mn><annotation>x^2</annotation></math> holds</p></article>", "Since x2=4 holds"),
        ("<body><header>Site</header><article><header><h1>Title</h1><p>The lead of it</p><nav>Up</nav></header><p>Body</p><footer>End</footer></article></body>", "Title The lead of it Body"),
    ],
)
def test_sections_of_the_article_stay(page, want):
    p = he.Page(page)
    assert p.text(p.largest()) == want


@pytest.mark.parametrize("page", [lambda n: "<x>" * n + "</y>" * n, lambda n: "<x>" * n + "<article>a</article>" * n, lambda n: "<y><td>" + "<x>" * n + "</y>" * n, lambda n: "<div>a" * n + "<article class=comment>b</article>" * n])
def test_deep_and_stray_tags_in_linear_time(page):
    def seconds(n):
        source = page(n)
        began = time.process_time()
        p = he.Page(source)
        p.text(p.climb(p.largest()))
        return time.process_time() - began

    seconds(2000)
    assert seconds(40_000) < 12 * max(seconds(8000), 0.05)
