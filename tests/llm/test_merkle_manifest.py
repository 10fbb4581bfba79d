"""The Merkle manifest against trees built node by node."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from episodia.llm import merkle_manifest as mm


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    out = ""
    for v in (doc_id, source, lang, None if n_chars is None else n_chars + more, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def climb(nodes):
    """The root of the nodes, and of each the siblings on its way up: (before, after) pairs."""
    ways = [[] for _ in nodes]
    own = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        after, members = [], []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            after.append(h("".join(pair)))
            members.append([m for g in own[i : i + 2] for m in g])
            for m in own[i]:
                ways[m].append(("", "".join(pair[1:])))
            if len(pair) > 1:
                for m in own[i + 1]:
                    ways[m].append((pair[0], ""))
        nodes, own = after, members
    return nodes[0], ways


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = climb([leaf(r) for r in groups[lang]])
    root, upper = climb([trees[x][0] for x in langs])
    out = Counter()
    for x, up in zip(langs, upper):
        for r, way in zip(groups[x], trees[x][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = leaf(r, 1 if hit else 0)
            for before, after in way + up:
                at = h(before + at + after)
            out[(r[0], leaf(r), trees[x][0], root, h("".join(b + a for b, a in way + up)), at, at == root)] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_against_trees_built_node_by_node(spark, monkeypatch, levels):
    monkeypatch.setattr(mm, "LEVELS", levels)
    rng = random.Random(levels)
    sizes = {"en": 70, "dé": 33, None: 9, "x": 1, "": 2, "z": 64}
    ids = rng.sample(range(-50, 1000), 179)
    rows = []
    for lang, n in sizes.items():
        rows += [(ids.pop(), rng.choice(["", "ü" * rng.randrange(9), None, "a:b"]), lang, rng.choice([None, "s", "sé"]), rng.choice([None, 3, 9])) for _ in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("grp", "leaf", "place", "n", "_block", "steps", "node", "top", "_row")})
    got = Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in mm.verify(mm.manifest(docs)).collect())
    assert got == brute(rows)
    assert len({x[6] for x in got}) == 2


def test_repeated_and_null_ids(spark):
    rows = [(1, "a", "en", "s", 1)] * 5 + [(1, "b", "en", "s", 1)] * 2 + [(None, None, None, None, None)] * 3 + [(None, "c", "en", None, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mm.verify(mm.manifest(docs)).collect()
    want = brute(rows)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got) == want
    assert sorted(r["place"] for r in got if r["lang"] == "en") == list(range(9))


def test_a_changed_field_is_noticed(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    manifest = mm.manifest(docs).drop("changed")
    for column, value in (("source", "t"), ("text", "text"), ("lang", "de"), ("doc_id", 100)):
        now = docs.withColumn(column, F.when(F.col("doc_id") == 7, F.lit(value)).otherwise(F.col(column)))
        leaves = mm.leaves(now).select(F.col("leaf").alias("changed"), F.when(F.col("doc_id") == 100, 7).otherwise(F.col("doc_id")).alias("doc_id"))
        got = {r["doc_id"]: r["verified"] for r in mm.verify(manifest.join(leaves, "doc_id")).collect()}
        assert {k for k, ok in got.items() if not ok} == {7}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = mm.verify(mm.manifest(docs))
    assert out.count() == 0
