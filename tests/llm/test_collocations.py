"""Phrase collocations against a brute-force count, the perfect hash, and edges."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from episodia.llm import collocations as co
from episodia.llm.perfect_hash import PerfectHash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, best):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in often.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not 100 * inside[p] >= 100 * a:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best])]
    return sorted(out)


def corpus(rng, n):
    common = [["New", "york", "CITY"], ["a", "b", "a", "b", "a", "b"], ["once", "upon", "a", "time", "there"], ["über", "straße"], ["x\x0by"], ["tab\tbed", "nul\x00l"]]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 30)):
            parts += rng.choice(common) if rng.random() < 0.5 else [rng.choice("a b c d e f".split())]
            parts.append(rng.choice(["", "", "", ".", ",", "!?", "\n", "\r\n", ":"]))
        rows.append((" ".join(parts), rng.choice(["en", "de", None, "x y"])))
    return rows + [(None, "en"), ("", None), ("  \t ", "de"), (None, None)] + [("a b c. a b c", "rep")] * 40


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_against_brute_force(spark, monkeypatch, chunk):
    rows = corpus(random.Random(3), 400)
    monkeypatch.setattr(co, "CHUNK_BYTES", chunk)  # workers read the module themselves; the driver's plan is the same
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"gid": F.lit(1), "f": F.lit("x"), "chunk": F.lit(2)})
    got = sorted(tuple(r) for r in co.collocations(docs, 5, 20, 15).collect())
    assert got == brute(rows, 5, 20, 15)
    assert len(got) > 30


def test_small_chunks_in_one_process(monkeypatch):
    """Levels counted over many small chunks, with texts cut at breaks only."""
    monkeypatch.setattr(co, "CHUNK_BYTES", 64)
    text = ("w" * 100 + " b, c d. " + "e f " * 30).encode()
    parts = list(co._parts(text))
    assert b"".join(parts) == text and len(parts) > 1 and all(p[-1:] in b",." for p in parts[:-1])
    batch = pa.RecordBatch.from_pydict({"text": ["a b a b. a", None, "b a"] * 50, "lang": ["en", "en", "de"] * 50})
    out = pa.Table.from_batches(list(co._first_level(3)(iter([batch]))))
    words = Counter()
    for row in out.filter(pa.compute.greater_equal(out["shard"], 0)).to_pylist():
        at, keys = 0, co.unpack(row["keys"], "V1").tobytes()
        for size, count in zip(co.unpack(row["sizes"], "u4"), co.unpack(row["counts"], "u4")):
            words[keys[at : at + size]] += int(count)
            at += size
    assert words == {b"en a": 150, b"en b": 100, b"de b": 50, b"de a": 50}
    assert out["chunk"].to_pandas().nunique() > 5


def test_empty_and_null_tables(spark):
    docs = spark.createDataFrame([(None, None)] * 3, "text string, lang string")
    assert co.collocations(docs).count() == 0
    assert co.collocations(docs.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert co.collocations(docs.limit(0)).count() == 0


def test_best_of_cuts_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(co, "SORTED_ROWS", 50)
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 10)).alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    got = {(r["g"], r["rank"]): r["v"] for r in co.best_of(rows, 7, "g", F.desc("v")).collect()}
    want = defaultdict(list)
    for r in rows.collect():
        want[r["g"]].append(r["v"])
    assert got == {(g, i + 1): v for g, vs in want.items() for i, v in enumerate(sorted(vs, reverse=True)[:7])}


def test_perfect_hash():
    rng = random.Random(1)
    keys = pa.array(sorted({rng.randbytes(rng.randrange(0, 40)) for _ in range(20_000)}), pa.large_binary())
    table = PerfectHash(keys)
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert table.keys.take(pa.array(slots)).equals(keys)
    others = pa.array([b"other %d" % i for i in range(5000)], pa.large_binary())
    assert (table.slots(others) == -1).all()
    assert len(PerfectHash(pa.array([], pa.large_binary()))) == 0
    assert PerfectHash(pa.array([], pa.large_binary())).slots(others).max() == -1
    with pytest.raises(ValueError):
        PerfectHash(pa.array([b"a", b"a"], pa.large_binary()))
