"""Dealt operators on edge cases, against brute force and DuckDB."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from episodia.llm import html_extract as he, license_scan as ls, ngram_join as nj, quality_rules as qr, segment_sampling as ss, source_mix as sx, suffix_dedup as sd, topk_search as tk, url_filter as uf, warc
from episodia.llm.registry import ORACLES, QUERIES
from oracle import duck_rows, spark_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(ORACLES[name], sf)


def thue(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


THUE = thue(1024)  # a text and its complement have one polynomial hash modulo 2**64, whatever its odd base
ENUHT = THUE.translate(str.maketrans("ab", "ba"))


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [f"w{i}" for i in range(500)]


def fixture_docs():
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 4, 5, 40, 200, 300, 900, 3000)]
    out = [None, "", "   ", *base, *base[3:]]
    for text in base[3:] * 3:  # near copies
        w = text.split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
        out.append(" ".join(w))
    passage = words(rng, 120)
    out += [f"{words(rng, 80)} {passage} {words(rng, 60)}" for _ in range(12)]
    out += ["ab" * 600, "ab" * 450, "x" * 399, "x" * 400, "é" * 500, "\n".join(["same line here"] * 90)]
    out += [THUE, ENUHT, f"{THUE}\n{ENUHT}\n{THUE}", f"a b c {THUE} d e f", f"a b c {ENUHT} d e f"]
    return out


def table_of(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 4}" if i % 9 else None, "en", len(t or "")) for i, t in enumerate(texts)], DOCS)


def brute_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_ngram_join(spark):
    texts = fixture_docs()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.link_components(table_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts)


def test_ngram_join_in_blocks(spark):
    texts = fixture_docs()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.link_components(table_of(spark, texts), block=600).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts)


def test_ngram_join_empty_and_one_of_each(spark):
    assert nj.link_components(table_of(spark, ["a"]).limit(0)).count() == 0
    docs = table_of(spark, fixture_docs()).withColumn("n", F.lit(1))
    kept = nj.one_of_each(docs)
    heads = {i for i, (_, c) in enumerate(brute_links(fixture_docs())) if i == c}
    assert {r["doc_id"] for r in kept.collect()} == heads and kept.columns == docs.columns
    twice = docs.unionByName(docs)
    assert nj.one_of_each(twice).count() == len(heads)


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length,block", [(400, sd.BLOCK), (64, sd.BLOCK), (64, 4), (400, 3)])
def test_suffix_dedup(spark, length, block):
    texts = fixture_docs()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.remove_repeats(table_of(spark, texts), length=length, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_suffix_dedup_of_a_hot_passage_and_periodic_texts(spark):
    rng = random.Random(8)
    passage = words(rng, 90)
    texts = [f"{words(rng, rng.randrange(4, 30))} {passage[rng.randrange(30):]} {words(rng, rng.randrange(4, 30))}" for _ in range(60)]
    texts += [THUE, ENUHT, THUE[:300] + ENUHT[:500], "ab" * 300, "aab" * 400]
    for block in (5, sd.BLOCK):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.remove_repeats(table_of(spark, texts), length=100, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 100)


def test_contexts_in_pieces():
    rng = random.Random(2)
    data = np.frombuffer(" ".join(words(rng, 900) for _ in range(3)).encode(), np.uint8)
    starts = np.array([0, 50, 3000])
    ends = np.array([50, 3000, len(data)])
    p, lo, hi, anchor, digest, doc = sd.contexts(data, starts, ends, 100, limit=256)
    covered = sorted((d, s) for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist()) for s in range(a, b + 1))
    assert covered == [(d, s) for d in range(3) for s in range(int(starts[d]), int(ends[d]) - 99)]
    assert ((p >= hi) & (p + 50 <= lo + 100)).all()


def test_repeat_groups(spark):
    texts = fixture_docs()
    data = [(t or "").encode() for t in texts]
    gone = [np.zeros(len(b), bool) for b in data]
    groups = {}
    for r in sd.repeat_groups(table_of(spark, texts), length=64).collect():
        groups.setdefault(r["repeat"], set()).add((r["doc_id"], r["begin"], r["end"]))
        gone[r["doc_id"]][r["begin"] : r["end"]] = True
    for members in groups.values():
        assert len(members) > 1 and len({data[d][i:j] for d, i, j in members}) == 1
    assert [int(g.sum()) for g in gone] == [x[1] for x in brute_repeats(texts, 64)]


def test_suffix_dedup_cuts_text(spark):
    texts = fixture_docs()
    docs = table_of(spark, texts)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in sd.remove_repeats(docs).collect()}
    for i, (size, gone, _, sha) in enumerate(brute_repeats(texts, 400)):
        assert got[i][1] == gone
        if "é" not in (texts[i] or "é"):
            assert hashlib.sha256(got[i][0].encode()).hexdigest() == sha
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_repeat_tree_against_all_pairs():
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 60))) for _ in range(8)]
    length = 16
    tree = sd.RepeatTree(pieces, np.array([len(p) - length + 1 for p in pieces]), length)
    own = [(p, i) for p in range(len(pieces)) for i in range(len(pieces[p]) - length + 1)]
    got = set()
    for first, last, depth in zip(*tree.maximal()):
        members = frozenset((int(tree.piece[k]), int(tree.offset[k])) for k in tree.order[first : last + 1])
        p, i = next(iter(members))
        assert all(pieces[q][j : j + depth] == pieces[p][i : i + depth] for q, j in members)
        got.add((pieces[p][i : i + depth], members))
    want = set()
    strings = {pieces[p][i : i + n] for p, i in own for n in range(length, len(pieces[p]) - i + 1)}
    for s in strings:
        at = [(p, i) for p, i in own if pieces[p].startswith(s, i)]
        if len(at) < 2:
            continue
        left = {pieces[p][i - 1 : i] if i else (p, i) for p, i in at}
        right = {pieces[p][i + len(s) : i + len(s) + 1] or (p, i) for p, i in at}
        if len(left) > 1 and len(right) > 1:
            want.add((s, frozenset(at)))
    assert got == want


def test_topk_edges(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [-1.0, 0.004]), (100, [3.0]), (100, [3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", tk.quantised(F.col("v")).alias("vector"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in tk.search(df, F.col("id") % 50 == 0, k=2).collect()}
    assert got == {(0, 1): (1, 327680), (0, 2): (50, 327680), (50, 1): (0, 327680), (50, 2): (1, 327680)}
    assert tk.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_topk_many_copies_and_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 8))
    v[100:400] = v[7]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").select("id", tk.quantised(F.col("v")).alias("vector"))
    q = np.floor(v * 256).astype(np.int64)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in tk.search(df, F.col("id") % 50 == 0, block=64, query_block=4).collect()}
    for i in range(0, 600, 50):
        s = q @ q[i]
        best = [j for j in sorted(range(600), key=lambda j: (-s[j], j)) if j != i][:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, int(s[j])) for j in best]


def test_topk_clusters_ties_and_range(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6)) * 40
    v = np.concatenate([c + rng.normal(size=(70, 6)) for c in centres])
    v[200:260] = np.round(v[200:260] / 8)  # few distinct values: many equal scores
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (9000, [1.0, 2.0]), (9050, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", tk.quantised(F.col("v")).alias("vector"))
    q = np.floor(v * 256).astype(np.int64)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in tk.search(df, F.col("id") % 50 == 0, block=50, query_block=3).collect()}
    for i in range(0, len(v), 50):
        s = q @ q[i]
        best = [j for j in sorted(range(len(v)), key=lambda j: (-s[j], j)) if j != i][:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, int(s[j])) for j in best]
    assert got[9000, 1][0] == 9050 and (9000, 2) not in got
    huge = spark.createDataFrame([(0, [1e15, 1.0]), (50, [1e15, 2.0])], "id long, v array<double>").select("id", tk.quantised(F.col("v")).alias("vector"))
    got = {r["query_id"]: (r["vec_id"], r["score"]) for r in tk.search(huge, F.col("id") % 50 == 0).collect()}
    assert got == {0: (50, tk.MOST), 50: (0, tk.MOST)}  # a score beyond 64 bits is the greatest one and ends nothing


def test_cover_tree_invariants():
    rng = np.random.default_rng(6)
    m = np.concatenate([np.round(c + rng.normal(size=(200, 3)) * 9) for c in rng.normal(size=(8, 3)) * 900]).astype(np.int64)
    m = np.unique(m, axis=0)
    t = tk.CoverTree(m, leaf=16)
    assert sorted(t.order.tolist()) == list(range(len(m))) and len(t.start) > 8
    for i in range(len(t.start)):
        rows = m[t.order[t.start[i] : t.end[i]]]
        assert np.sqrt(((rows - m[t.centre[i]]) ** 2).sum(axis=1)).max() <= t.radius[i] + 1e-9
        kids = range(t.first[i], t.first[i] + t.count[i])
        assert not len(kids) or (t.start[kids[0]], t.end[kids[-1]]) == (t.start[i], t.end[i])
        inner = [k for k in kids if t.radius[k] <= t.radius[i] / 2]
        assert len(inner) >= len(kids) - 1
        for a in inner:
            for b in inner:
                if t.centre[a] != t.centre[b]:
                    assert np.sqrt(((m[t.centre[a]] - m[t.centre[b]]) ** 2).sum()) > t.radius[i] / 2


def test_topk_repeated_rows_in_a_group_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(1, 10) for _ in range(3)] + [(0, [1.0, 2.0])] * 6 + [(20 + i, [0.5, 0.25 * i]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", tk.quantised(F.col("v")).alias("vector"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in tk.search(df, F.col("id").isin(0, 3)).collect())
    assert got == [(0, k + 1, i, 327680) for k, i in enumerate((1, 2, 3, 4, 5))] + [(3, k + 1, i, 327680) for k, i in enumerate((0, 1, 2, 4, 5))]


def test_warc_round_trip_edges(spark, tmp_path):
    big = "p" * 200
    rows = [(1, "http://A.example.com/x?y", big), (2, None, big), (3, "no scheme\tx", None), (4, "http://b.org/", ""), (None, "http://c.org/", big), (5, "http://b.org/", "short"), (6, "http://b.org/", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = f"file://{tmp_path}/w"
    places = warc.write_archives(warc.captures(pages), root)
    asked = pages.select(warc.url_key(F.col("url")).alias("url_key"), "page_id")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_records(warc.lookup(warc.build_index(places, root, block_lines=2), asked, root), root).collect()}
    assert got == {1: (200, "response", None), 2: (200, "revisit", 1), 3: (0, "response", None), 4: (0, "response", None), None: (200, "revisit", 1), 5: (5, "response", None), 6: (5, "response", None)}


def test_url_filter_edges(spark):
    rows = [(1, None), (2, "example.net/en/"), (3, "http://a.EXAMPLE.net/en/x"), (4, "http://example.net/ENx"), (5, "http://notexample.com/de/"), (6, "http://x.example.com?q=/de/"), (7, "http://x.example.com/de/#a"), (8, "ftp://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("mine"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.filter_urls(pages, uf.rule_table(spark)).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"), 4: ("example.net", "/ENx", "net/", "block"), 5: ("notexample.com", "/de/", None, "allow"), 6: ("x.example.com", "", None, "allow"), 7: ("x.example.com", "/de/", "example.com/de/", "block"), 8: ("", "", None, "allow")}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="content"><h2>Title {0}</h2><p>First &amp; <b>bo</b>ld {0}<br>line&nbsp;two</p><form><input><button>Go</button></form><p>Second {0}</p><aside>Related</aside>
<script>var x = "<p>no</p>";</script></div><div id="comments"><p>Nice post {0}</p></div><footer>&copy; site</footer></body></html>"""


def test_html_extract_without_article_marks(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", PAGE.format(i)) for i in range(8)] + [(100, None, None), (101, "http://z.org/", "<p>alone <!-- no --> here"), (102, "x", "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in he.extract(pages).collect()}
    for i in range(8):
        want = f"Title {i} First & bold {i} line two Second {i}"
        assert got[i] == (want, len(want))
    assert got[100] == ("", 0) and got[101][0] == "alone here" and got[102] == ("", 0)
    assert he.extract(pages.limit(0)).count() == 0


def test_html_extract_articles(spark, sf):
    got = {r["page_id"]: r["text"] for r in QUERIES["op7_html_extract"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        m = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        want = html.unescape(re.sub(r"</?(?:p|br|h1)[^>]*>", " ", re.sub(r"</?b>", "", m[1])))
        assert got[r["page_id"]] == " ".join(want.split())


@pytest.mark.parametrize("before,after", [("<div class='content-sidebar-wrap'>", "</div>"), ("<div class='layout has-sidebar'>", "</div>"), ("<div class='post comments-open'>", "</div>"), ("<form id=aspnetForm>", "</form>")])
@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_html_extract_named_wrappers(spark, before, after, element):
    page = f"<html><body><nav>Menu</nav>{before}<{element}><h1>Title {{0}}</h1><p>First {{0}} and its words</p><div class=share>Share it</div></{element}>{after}<div class=related><article>Teaser {{0}}</article></div><div class=sidebar><p>Aside {{0}}</p></div></body></html>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(8)] + [(i, f"http://small{i}.org/", page.format(i)) for i in (8, 9)]
    got = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} First {i} and its words" for i in range(10)}


def test_html_extract_comments_stay_out(spark):
    page = "<html><body><article><header><h1>Title {0}</h1></header><p>Short {0}</p></article><div id=comments><article class=comment>A long comment {0} that outweighs the article by far</article><article class=comment>Another long comment {0} of that kind</article></div></body></html>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} Short {i}" for i in range(8)}


def test_html_extract_attributes_by_the_rules():
    def text(x):
        p = he.Page(x)
        return p.text(p.largest())

    assert text("<p title=it's>Hello</p><p>it's fine</p>") == "Hello it's fine"
    assert text("<p title='a > b' data-x=\"1 > 0\">one</p><p class = 'x'>two</p>") == "one two"
    assert text("a <b>c</b> 1 < 2 <p>x<y z") == "a c 1 < 2 x"
    assert text("<main><div class='related-work'>A</div><section class=search-methods>B</section><div class=related-posts>C</div><div class=comments>D</div></main>") == "A B"
    assert text("<p>x</p><!-- never closed <p>y</p>") == "x"


@pytest.mark.parametrize("piece", ['<a "', "<a ='", "<!", "<div>", "<a b=\"x' ", "</", "<p/", "&amp", "<article class=comment>x"])
def test_html_extract_broken_markup_in_linear_time(piece):
    import time

    def seconds(n):
        began = time.process_time()
        p = he.Page(piece * (n // len(piece)))
        p.text(p.largest())
        return time.process_time() - began

    assert seconds(1 << 20) < 30 and seconds(1 << 19) < 15


def shapes(i):
    intro, body = f"Intro {i} in a few words", f"Body {i} " + "with many more words " * 6
    want = f"{intro} {body.strip()}"
    yield f"<div class=content><section id=intro><p>{intro}</p></section><section id=body><p>{body}</p></section></div>", want
    yield f"<div class=content><div>{intro}</div><div><div>{body}</div></div></div>", want
    yield f"<div class=content><p>{intro}</p><blockquote><p>{body}</p></blockquote></div>", want
    yield f"<p>{intro}</p><ul><li>{body}</ul>", want
    yield f"<article><p>{intro}</p><div itemprop=articleBody><p>{body}</p></div></article>", want
    yield f"<main><p>{intro}</p><article><p>{body}</p></article></main>", want
    yield f"<div class=content><article><p>{intro}</p></article><article><p>{intro}</p></article></div>", f"{intro} {intro}"


@pytest.mark.parametrize("n", [8, 2])
def test_html_extract_split_containers(spark, n):
    page = "<html><body><nav>Menu</nav><div class=logo>Site</div>{}<footer>Imprint</footer></body></html>"
    all_ = [(100 * k + i, f"http://h{k}.org/{i}", page.replace("<div class=logo>Site</div>", "").format(x) if n < 4 else page.format(x), want) for i in range(n) for k, (x, want) in enumerate(shapes(i))]
    got = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame([r[:3] for r in all_], "page_id long, url string, html string")).collect()}
    assert got == {r[0]: r[3] for r in all_}


def brute_stats(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_statistics(spark):
    texts = [*fixture_docs(), "a\nb\na\n\n \na", "#x $y é"]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in qr.text_stats(table_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_stats(t) for t in texts]


def test_quality_rules_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = qr.judge(qr.text_stats(docs.select("doc_id", "text")), train).join(held, "doc_id")
    hit = judged.where("rule is not null")
    assert hit.where("quality = 1").count() <= 0.1 * max(hit.count(), 1)
    kept = qr.keep(docs, labels)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in qr.judge(qr.text_stats(docs.select("doc_id", "text")), labels).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert qr.judge(qr.text_stats(docs.select("doc_id", "text")), labels.limit(0)).where("rule is not null").count() == 0


def test_source_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sx.mix(docs, group=64, fan_in=4).collect()
    again = sx.mix(docs, group=64, fan_in=4).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    out = sx.materialise(docs, group=64, fan_in=4)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)
    assert sx.mix(table_of(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0
    assert sx.mix(docs.limit(0)).count() == 0


def test_segment_sampling(spark):
    texts = [None, "", " ", "a", "Hello  world ▁ é\U0001f600\n x" * 3, "x" * 3000]
    rows = ss.encode_samples(table_of(spark, texts), ss.default_model(), 3, ids=True).collect()
    assert all(r["round_trip"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
        assert 0 < r["inclusion"] <= 1
    assert len(by[0]) == len(by[1]) == 1 and all(len(set(v)) == len(v) for v in by.values())
    again = ss.encode_samples(table_of(spark, texts).repartition(3), ss.default_model(), 3, ids=True).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))


def test_sampled_frequencies_match_inclusion():
    m = ss.model(ss.default_model())
    keys = np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    r = ss.sample_batch(m, pa.array(["the cat"] * len(keys)), keys, 1)
    seen = Counter(tuple(x.tolist()) for x in r["ids"])
    p = {tuple(x.tolist()): np.exp(lp) for x, lp in zip(r["ids"], r["log_prob"])}
    for ids, n in seen.most_common(4):
        assert abs(n / len(keys) - p[ids]) < 4 * (p[ids] * (1 - p[ids]) / len(keys)) ** 0.5 + 1e-3


def test_license_scan_spellings(spark):
    from episodia.llm.license_texts import MIT

    texts = [MIT.upper().replace(",", " ,"), "Copyright (c) 2020 Someone\n" + MIT, "x\nreleased under the MIT Licence\ny", None, "", MIT[:-20]]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in ls.scan(table_of(spark, texts), ls.known_digests(spark)).collect()}
    assert [got[i] for i in range(6)] == [("MIT", ["MIT"]), ("MIT", ["MIT"]), (None, ["MIT"]), (None, []), (None, []), (None, [])]


def test_license_scan_whole_texts_and_spdx(spark):
    from pathlib import Path

    whole = {f.stem: f.read_text() for f in (Path(ls.__file__).parent / "licenses").glob("*.txt")}
    assert len(whole) == 14
    lines = {"# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "// SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "Released under the BSD 3-Clause License.": "BSD-3-Clause"}
    texts = [*whole.values(), *(f"x\n{x}\ny" for x in lines)]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in ls.scan(table_of(spark, texts), ls.known_digests(spark)).collect()}
    assert [got[i][0] for i in range(len(whole))] == list(whole)
    assert [got[len(whole) + i] for i in range(len(lines))] == [(None, [x]) for x in lines.values()]
