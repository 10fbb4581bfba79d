"""Phrase collocation mining: perfect-hash counts of Apriori-safe phrases, scored by their worst cut.

Texts are cut into chunks of about ``CHUNK_BYTES`` of one language, each a
sequence of codes in which a break stands between pieces.  Level k counts
phrases of k words: a position is a candidate only where both phrases of k - 1
words in it were frequent (so no frequent phrase is missed), and a chunk counts
its distinct candidates in one array by local code.  Candidates go to shards by
hash, where a minimal perfect hash over the shard's distinct candidates gives
each a slot; the stored key is compared for every lookup.  The chunks' counts
are added up by slot (``bincount`` over pieces of chunks, summed in a tree), and
the frequent slots go back to the chunks that hold them, for the next level.

A frequent phrase is known by its shard and slot (``gid``).  It names its first
and its last k - 1 words by their gids, so the counts of all prefixes and
suffixes, hence of all cuts, are read by slot from the level below.

Sizes: a chunk sends each candidate once, so a phrase that is everywhere has one
entry a chunk; chunks and shards have bounded sizes, and shards follow the
number of words.  Nothing but counts of rows reaches the driver.

Defined cases: a null text is empty; a null ``lang`` is ``und``; very long texts
are cut at breaks only; repeated rows count as often as they stand there; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from episodia.llm.perfect_hash import PerfectHash, key_hashes
from episodia.llm.shared import drop, stored
from episodia.llm.textkernel import LOWER, buffers, release

LONGEST, LEAST, BEST = 5, 100, 2000
CHUNK_BYTES = 8 << 20
HELD_BYTES = 24 << 20  # texts of several languages that wait for their chunks
SHARD_WORDS = 1 << 20
SORTED_ROWS = 1 << 17
PAIR = 16  # bytes of two gids
BREAKS = b".,;:!?\n\x0b\x0c\r"
NONE = np.uint32(0xFFFFFFFF)  # a break, or a phrase that is not frequent
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(BREAKS)] = 2

LEVEL = "chunk string, shard int, lang string, words long, codes binary, first long, keys binary, sizes binary, counts binary"
FOUND = "chunk string, shard int, codes binary, slots binary, slot long, key binary, f long"


def pack(values: np.ndarray) -> bytes:
    """A compressed array: all lowest bytes first, then the next ones, so that small numbers and runs take little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes))


def unpack(data: bytes, dtype: np.typing.DTypeLike) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _bytes_of(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, begin, end = buffers(keys)
    return (end - begin).astype(np.uint32), raw


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about a chunk, cut at breaks only."""
    while len(text) > CHUNK_BYTES:
        cut = max(text.rfind(c, 0, CHUNK_BYTES) for c in (BREAKS[i : i + 1] for i in range(len(BREAKS))))
        if cut < 0:
            later = [x for x in (text.find(BREAKS[i : i + 1], CHUNK_BYTES) for i in range(len(BREAKS))) if x >= 0]
            if not later:
                break
            cut = min(later)
        yield text[: cut + 1]
        text = text[cut + 1 :]
    yield text


def _words(raw: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The codes of a chunk's words with a break between pieces, and the words by code."""
    raw = LOWER[raw]
    kind = _KIND[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = kind == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint32), pa.array([], pa.large_binary())
    words = _binary(end - begin, raw[kind == 0]).dictionary_encode()
    piece = np.cumsum(kind == 2)[begin]
    apart = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return np.insert(words.indices.to_numpy().astype(np.uint32), apart, NONE), words.dictionary


def _emit(chunk: str, lang: str | None, words: int, codes: np.ndarray, keys: pa.Array, counts: np.ndarray, shards: int) -> dict:
    """Rows of a chunk: its codes, and its keys by shard; codes are given anew in the order of the shards."""
    shard = (key_hashes(keys) >> np.uint64(24)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order) + 1, np.uint32)
    place[order] = np.arange(len(order))
    place[-1] = NONE
    codes = place[np.minimum(codes, len(order))]
    keys, counts, shard = keys.take(pa.array(order)), counts[order], shard[order]
    sizes, raw = _bytes_of(keys)
    width = PAIR if lang is None else 1  # pairs of gids are compressed byte by byte of their columns
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    cuts = np.flatnonzero(np.diff(shard)) + 1
    rows = {c.split()[0]: [] for c in LEVEL.split(", ")}
    for lo, hi in [(-1, -1), *zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(order)]]).tolist())]:
        part = lo >= 0
        for name, value in (
            ("chunk", chunk), ("shard", int(shard[lo]) if part else -1), ("lang", lang), ("words", None if part else words), ("codes", None if part else pack(codes)),
            ("first", lo if part else None), ("keys", pack(raw[at[lo] : at[hi]].view(f"V{width}")) if part else None), ("sizes", pack(sizes[lo:hi]) if part else None),
            ("counts", pack(counts[lo:hi].astype(np.uint32)) if part else None),
        ):
            rows[name].append(value)
    return rows


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: dict, schema: str) -> pa.Table:
    return pa.table({c: pa.array(rows[c], _TYPES[t]) for c, t in (x.split() for x in schema.split(", "))})


def _first_level(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            raw = np.frombuffer(b"\n".join(held.pop(lang)), np.uint8)
            del size[lang]
            codes, words = _words(raw)
            if not len(words):
                return
            counts = np.bincount(codes[codes != NONE], minlength=len(words))
            prefix = pa.scalar(lang.encode() + b" ", pa.large_binary())
            keys = pc.binary_join_element_wise(prefix, words, pa.scalar(b"", pa.large_binary()))
            yield from _table(_emit(uuid.uuid4().hex, lang, int(counts.sum()), codes, keys, counts, shards), LEVEL).to_batches()

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                for part in _parts((text.as_py() or "").encode()):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part) + 1
                    if size[lang] >= CHUNK_BYTES:
                        yield from flush(lang)
            while sum(size.values()) > HELD_BYTES:
                yield from flush(max(size, key=size.__getitem__))
        for lang in sorted(held):
            yield from flush(lang)
        release()

    return run


def _next_level(shards: int):
    def run(chunks: pa.Table, back: pa.Table) -> pa.Table:
        """The chunk's phrases of one word more, from its codes and the frequent ones among them."""
        empty = _table({c.split()[0]: [] for c in LEVEL.split(", ")}, LEVEL)
        if not chunks.num_rows or not back.num_rows:
            return empty
        codes = unpack(chunks["codes"][0].as_py(), np.uint32)
        known = int(codes[codes != NONE].max(initial=0)) + 1
        gid = np.full(known + 1, -1, np.int64)
        for shard, own, slots in zip(back["shard"].to_pylist(), back["codes"].to_pylist(), back["slots"].to_pylist()):
            gid[unpack(own, np.uint32)] = (shard << 32) | unpack(slots, np.uint32).astype(np.int64)
        frequent = np.flatnonzero(gid >= 0)
        rank = np.full(known + 1, -1, np.int64)
        rank[frequent] = np.arange(len(frequent))
        r = rank[np.minimum(codes, known)]
        both = (r[:-1] >= 0) & (r[1:] >= 0)
        if not both.any():
            return empty
        pairs, own, counts = np.unique((r[:-1] * len(frequent) + r[1:])[both], return_inverse=True, return_counts=True)
        new = np.full(len(both), NONE, np.uint32)
        new[both] = own
        keep = new != NONE
        keep[1:] |= keep[:-1] & (new[1:] == NONE)  # one break is enough
        left, right = gid[frequent[pairs // len(frequent)]], gid[frequent[pairs % len(frequent)]]
        raw = np.stack([left, right], 1).astype(">i8").view(np.uint8).ravel()
        keys = _binary(np.full(len(pairs), PAIR), raw)
        return _table(_emit(chunks["chunk"][0].as_py(), None, int(counts.sum()), new[keep], keys, counts, shards), LEVEL)

    return run


def _tally(least: int, width: int):
    def run(key: tuple, blobs: pa.Table) -> pa.Table:
        """Counts of a shard by slot; the frequent ones, and where they stand in each chunk's codes."""
        sizes = [unpack(x, np.uint32) for x in blobs["sizes"].to_pylist()]
        keys = pa.concat_arrays([_binary(s, unpack(k, f"V{width}").view(np.uint8)) for s, k in zip(sizes, blobs["keys"].to_pylist())])
        candidates = PerfectHash(pc.unique(keys))
        slots = candidates.slots(keys)
        if (slots < 0).any():
            raise AssertionError("a candidate is not at its slot")
        counts = np.concatenate([unpack(c, np.uint32) for c in blobs["counts"].to_pylist()])
        piece = max(len(candidates), 1 << 16)
        sums = [np.bincount(slots[i : i + piece], counts[i : i + piece], len(candidates)).astype(np.int64) for i in range(0, len(slots), piece)]
        while len(sums) > 1:
            sums = [sum(sums[i : i + 2]) for i in range(0, len(sums), 2)]
        f = sums[0]
        often = f >= least
        chosen = np.flatnonzero(often)
        rows = {c.split()[0]: [] for c in FOUND.split(", ")}
        shard = key[0].as_py()

        def add(**values) -> None:
            for name, column in rows.items():
                column.append(values.get(name))

        at = 0
        for chunk, first, own_sizes in zip(blobs["chunk"].to_pylist(), blobs["first"].to_pylist(), sizes):
            own = slots[at : at + len(own_sizes)]
            at += len(own)
            hit = np.flatnonzero(often[own])
            if len(hit):
                add(chunk=chunk, shard=shard, codes=pack((hit + first).astype(np.uint32)), slots=pack(own[hit].astype(np.uint32)))
        for slot, text, n in zip(chosen.tolist(), candidates.keys.take(pa.array(chosen)).to_pylist(), f[chosen].tolist()):
            add(shard=shard, slot=slot, key=text, f=n)
        release()
        return _table(rows, FOUND)

    return run


def _word_table(found: DataFrame) -> DataFrame:
    """Frequent words; the key is the language, a space and the word."""
    key = F.decode("key", "utf-8")
    word = F.substring_index(key, " ", -1)
    one = F.array("f")
    return found.withColumns({"_key": key, "_word": word}).select(
        "gid", F.expr("left(_key, char_length(_key) - char_length(_word) - 1)").alias("lang"), F.col("_word").alias("phrase"), F.col("_word").alias("last"), "f", one.alias("prefixes"), one.alias("suffixes"),
        F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"),
    )


def _long(key: str, begin: int) -> Column:
    """The big-endian 64-bit integer at a byte of a binary column."""
    return F.conv(F.hex(F.substring(key, begin, 8)), 16, 10).cast("long")


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` and, for each length, the frequent phrases with the counts of their prefixes and suffixes.

    A level has ``gid, lang, phrase, last, f, prefixes, suffixes, left, right``:
    ``prefixes[j - 1]`` counts the first j words, ``suffixes[j - 1]`` the last j;
    ``left`` and ``right`` are the gids of the phrase without its last and
    without its first word.
    """
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    level = stored(texts.mapInArrow(_first_level(-(-size // (4 * SHARD_WORDS)) or 1), LEVEL))
    totals = stored(level.where("shard < 0").groupBy("lang").agg(F.sum("words").alias("n")))
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        blobs = level.where("shard >= 0").select("chunk", "shard", "first", "keys", "sizes", "counts")
        found = stored(blobs.groupBy("shard").applyInArrow(_tally(least, 1 if k == 1 else PAIR), FOUND))
        table = found.where("slot is not null").select((F.col("shard").cast("long") * F.lit(1 << 32) + F.col("slot")).alias("gid"), "key", "f")
        if k == 1:
            rows = _word_table(table)
        else:
            below = levels[-1]
            a = below.select(F.col("gid").alias("left"), "lang", "phrase", "prefixes")
            b = below.select(F.col("gid").alias("right"), "last", "suffixes")
            pairs = table.select("gid", "f", _long("key", 1).alias("left"), _long("key", 9).alias("right"))
            rows = pairs.join(a, "left").join(b, "right").select(
                "gid", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
                F.concat("prefixes", F.array("f")).alias("prefixes"), F.concat("suffixes", F.array("f")).alias("suffixes"), "left", "right",
            )
        levels.append(stored(rows))
        if k == longest:
            break
        back = found.where("slot is null").select("chunk", "shard", "codes", "slots")
        left = level.where("shard < 0").agg(F.sum("words")).first()[0] or 0
        shards = -(-left // SHARD_WORDS) or 1
        chunks = level.where("shard < 0").select("chunk", "codes")
        following = stored(chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_next_level(shards), LEVEL))
        drop(level, found)
        level = following
    drop(level)
    return totals, levels


def best_of(rows: DataFrame, limit: int, group: str, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank``; a large group is cut in parts until what they keep fits one task."""
    while True:
        n = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if n <= max(SORTED_ROWS, 4 * limit):
            break
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(-(-n // SORTED_ROWS)))
        within = Window.partitionBy(group, "_part").orderBy(*order)
        rows = stored(rows.withColumn("_part", part).withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= limit).drop("_part", "_place"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= limit)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of 2 to ``longest`` words of each language."""
    totals, levels = frequent(docs, longest, least)
    out = None
    for k, level in enumerate(levels[1:], start=2):
        rows = level.join(totals, "lang")
        exact = lambda c: F.col(c).cast("decimal(20,0)")
        top = exact("f") * exact("n") * F.lit(1000).cast("decimal(4,0)")
        rows = rows.withColumn("_top", top.cast("decimal(38,0)"))

        def cut(j: int) -> Column:
            l, r = F.col("prefixes")[j - 1], F.col("suffixes")[k - j - 1]
            score = F.call_function("div", F.col("_top"), (l.cast("decimal(19,0)") * r.cast("decimal(19,0)")).cast("decimal(38,0)"))
            return F.struct(score.alias("score"), F.lit(j).alias("j"), l.alias("l"), r.alias("r"))

        worst = F.array_min(F.array(*(cut(j) for j in range(1, k))))
        rows = rows.withColumn("_cut", worst)
        if k < len(levels):  # the next longer phrases decide: a longer one is not more frequent than they are
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("gid"), F.col("f").alias("_f")).groupBy("gid").agg(F.max("_f").alias("_longer"))
            rows = rows.join(longer, "gid", "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("f") * 100))
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    ranked = best_of(stored(out), best, "lang", F.desc("score"), F.desc("a"), F.asc("phrase"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_level(k: int) -> str:
    words = ", ".join(f"w[i + {j}]" for j in range(k))
    return f"SELECT lang, {k} AS k, concat_ws(' ', {words}) AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})"


_CUTS = ", ".join(f"({j})" for j in range(1, LONGEST))
ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM ({" UNION ALL ".join(_sql_level(k) for k in range(1, LONGEST + 1))}) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, total.n, j.j, ((1000::HUGEINT * c.a * total.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN (VALUES {_CUTS}) j(j) ON j.j < c.k JOIN total ON total.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j.j + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS f FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS s FROM c, (VALUES (2), (3), (4)) v(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 100 * worst.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {BEST}
"""
