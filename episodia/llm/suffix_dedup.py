"""Suffix-array deduplication: maximal repeats from a common-prefix interval tree.

Every byte covered by a ``length``-byte string that also starts elsewhere is
found without sorting all suffixes of the corpus on one machine.

1. Each ``length``-byte window belongs to an anchor: the half-length gram with
   the least hash inside it.  The choice depends on the window's bytes alone, so
   equal windows have equal anchors at equal offsets.  The consecutive windows
   of one anchor make a context of at most 1.5 lengths.
2. One text pass counts (anchor, context digest).  A context that occurs twice
   is repeated as a whole.  An anchor with several contexts is ambiguous: these
   lie at the limits of repeats (or in shorter repeats).
3. A second pass sends one copy of each ambiguous context.  All contexts of an
   anchor hold all the suffixes that can share ``length`` bytes with each other,
   so each anchor is a subtree of the corpus's suffix tree.  Its enhanced suffix
   array is built, the stack scan of its common-prefix intervals is run, and
   intervals with diverse left extensions are the maximal repeats, each with all
   its occurrences.
4. An anchor with very many contexts is split by the bytes next to it: its
   windows are dealt by how far they reach to its left, and windows of one such
   range are keyed by all the bytes that they have in common.  What is still
   large is dealt to narrower ranges, down to single windows, whose keys are
   whole windows.  So no group is larger than ``BLOCK`` contexts, and a context
   makes ``FAN`` rows a level at most.
5. Covered ranges are brought back to the texts; only texts with ranges of
   their own, and copies, are shuffled.

``repeat_groups`` gives the maximal repeats themselves with all their
occurrences.  A gram's hash (64 bits, polynomial) only chooses places; contexts
and windows are told apart by 64-bit XXH3 digests within one anchor, texts by
128 bits of SHA-256.

Defined cases: a null text is empty (and stays null); a text under ``length``
bytes loses nothing; long texts are taken in pieces of bounded size, so memory
does not depend on a context's place; repeated rows are copies of each other; a
null ``doc_id`` is carried through; an empty table gives an empty result;
further columns pass through, but a result column replaces one of its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from episodia.llm import textkernel as tk
from episodia.llm.components import bit_set, filter_bits, has_bit
from episodia.llm.shared import drop, folded, stored, unfolded

U64 = np.uint64
LENGTH = 400  # at most 2000: distances between windows and anchors have ten bits
BLOCK = 512  # contexts in one suffix array
FAN = 6  # ranges that the windows of a large group are dealt to
RUN_BYTES = 1 << 18
PIECE_BYTES = 1 << 18
SEEN = 1 << 16  # keys that a task remembers; what it forgets is sent again and merged later
POSITION_BITS = 31
SEPARATOR = 0xFF  # never occurs in UTF-8


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive keys (prefix and suffix minima of blocks)."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Place of the anchor, first and last window start, and the anchor's hash, of each context in some texts of at least ``length`` bytes."""
    gram = length // 2
    prefix = tk.Prefix(raw)
    at = np.arange(len(raw) - gram + 1)
    h = tk.mix((prefix.sums[gram:] - prefix.sums[: len(at)]) * prefix.inverse[: len(at)])
    mask = U64((1 << POSITION_BITS) - 1)
    least = sliding_least((h & ~mask) | (mask - at.astype(np.uint64)), length - gram + 1)
    count = ends - starts - length + 1
    s = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    p = (mask - (least[s] & mask)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    lo, hi, p = s[cut], s[np.append(cut[1:], len(s)) - 1], p[cut]
    return p, lo, hi, tk.mix(h[p] + U64(1))  # mixed again: least hashes have equal leading bits


def _digests(view: memoryview, begin: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """64-bit digests of byte ranges."""
    one = xxhash.xxh3_64_intdigest
    return np.array([one(view[i:j], s) for i, j, s in zip(begin.tolist(), end.tolist(), seed.tolist())], np.uint64).view(np.int64)


def contexts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, limit: int = PIECE_BYTES) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: place, first and last window start, gram hash, context digest, text index.

    The texts are taken in pieces of about ``limit`` bytes; a longer text is cut
    at multiples of ``limit``, which only cuts contexts in two.
    """
    long = np.flatnonzero(ends - starts >= length)
    empty = np.zeros(0, np.int64)
    if not len(long):
        return (empty,) * 6
    times = -(-(ends[long] - starts[long] - length + 1) // limit)
    text = np.repeat(long, times)
    begin = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)) * limit
    end = np.minimum(ends[text], begin + limit + length - 1)
    size = end - begin
    run = (np.cumsum(size) - size) // limit
    view = memoryview(np.ascontiguousarray(raw))
    out = []
    for own in np.split(np.arange(len(text)), np.flatnonzero(np.diff(run)) + 1):
        local = np.cumsum(size[own]) - size[own]
        piece = np.concatenate([raw[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist())])
        p, lo, hi, anchor = _anchors(piece, local, local + size[own], length)
        k = tk.owner(p, local)
        shift = (begin[own] - local)[k]
        p, lo, hi = p + shift, lo + shift, hi + shift
        out.append((p, lo, hi, anchor.view(np.int64), _digests(view, lo, hi + length, ((p - lo) << 11) | (p - hi)), text[own][k]))
    return tuple(np.concatenate(x) for x in zip(*out))


class RepeatTree:
    """Enhanced suffix array over pieces of bytes, and its common-prefix intervals of at least ``length``.

    ``pieces`` are joined with separators; suffixes start at the first
    ``n_starts`` places of each piece and end with it.
    """

    def __init__(self, pieces: list[bytes], n_starts: np.ndarray, length: int):
        sizes = np.array([len(x) for x in pieces], np.int64)
        base = np.cumsum(sizes + 1) - sizes - 1
        data = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]) * (4 * length + 16), np.uint8)
        self.piece = np.repeat(np.arange(len(pieces)), n_starts)
        self.offset = np.arange(int(n_starts.sum())) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
        suffix = base[self.piece] + self.offset
        left_over = sizes[self.piece] - self.offset
        # ranks of all 8-byte strings, then by doubling of all strings of 16, 32, ... bytes
        wide = np.zeros(len(data) - 8, np.uint64)
        for k in range(8):
            wide = (wide << U64(8)) | data[k : len(data) - 8 + k]
        ranks = [(8, np.unique(wide, return_inverse=True)[1].astype(np.int32))]
        del wide
        while ranks[-1][0] * 2 <= length:
            step, r = ranks[-1]
            ranks.append((step * 2, np.unique(r[:-step].astype(np.int64) * (int(r.max()) + 1) + r[step:], return_inverse=True)[1].astype(np.int32)))
        step, top = ranks[-1]
        keys = [top[np.minimum(suffix + k, len(top) - 1)] for k in range(0, 2 * length, step)]
        order = np.lexsort(keys[::-1])
        self.order = order
        # common prefixes of neighbours, where they reach the length
        a, b = suffix[order[:-1]], suffix[order[1:]]
        same = np.flatnonzero((top[a] == top[b]) & (top[a + length - step] == top[b + length - step]))
        if step * 2 < length:
            same = same[[bool((data[x : x + length] == data[y : y + length]).all()) for x, y in zip(a[same], b[same])]]
        x, y = a[same], b[same]
        common = np.full(len(same), 0)
        for step, r in reversed(ranks):
            for _ in range(-(-2 * length // step) if step == ranks[-1][0] else 1):
                inside = np.minimum(np.maximum(x, y) + common, len(r) - 1) == np.maximum(x, y) + common
                common = common + step * (inside & (r[np.minimum(x + common, len(r) - 1)] == r[np.minimum(y + common, len(r) - 1)]))
        for _ in range(7):
            common = common + (data[x + common] == data[y + common])
        common = np.minimum(common, np.minimum(left_over[order[same]], left_over[order[same + 1]]))
        keep = common >= length
        self.lcp = np.zeros(len(order) + 1, np.int64)  # lcp[i]: of entries i - 1 and i
        self.lcp[same[keep] + 1] = common[keep]
        self.length = length
        # the byte before each suffix; the start of a piece is unlike any other
        before = data[np.maximum(suffix - 1, 0)].astype(np.int64)
        before[self.offset == 0] = -1 - np.flatnonzero(self.offset == 0)
        left = before[order]
        self.turns = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]) if len(left) else np.zeros(0, np.int64)

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All common-prefix intervals of at least the length: first and last entry, prefix length."""
        out: list[tuple[int, int, int]] = []
        hot = self.lcp >= self.length
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hot, [False]]).astype(np.int8)))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            values = self.lcp[lo:hi].tolist()
            stack: list[tuple[int, int]] = []  # prefix length, first entry
            for i in range(lo, hi + 1):
                now = values[i - lo] if i < hi else 0
                start = i - 1
                while stack and stack[-1][0] > now:
                    depth, start = stack.pop()
                    out.append((start, i - 1, depth))
                if now and (not stack or stack[-1][0] < now):
                    stack.append((now, start))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        first, last, depth = np.array(out, np.int64).T
        return first, last, depth

    def maximal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals whose occurrences have different left extensions: the maximal repeats."""
        first, last, depth = self.intervals()
        diverse = self.turns[last] > self.turns[first] if len(first) else np.zeros(0, bool)
        return first[diverse], last[diverse], depth[diverse]

    def covered(self) -> np.ndarray:
        """For each suffix (in the order of pieces and offsets) how many bytes a maximal repeat covers from it on."""
        first, last, depth = self.maximal()
        reach = np.zeros(len(self.order), np.int64)
        for k in np.argsort(depth, kind="stable").tolist():
            reach[first[k] : last[k] + 1] = depth[k]
        out = np.zeros(len(self.order), np.int64)
        out[self.order] = reach
        return out


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal disjoint runs (touching ranges are one run)."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    cut = np.append(True, begin[1:] > end[:-1])
    return begin[cut], end[np.append(np.flatnonzero(cut)[1:] - 1, len(end) - 1)]


def _key(raw: memoryview) -> tuple[int, int]:
    d = hashlib.sha256(raw).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)


def _counts(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, digest, n``: how often each context occurs (``a0`` is the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "a0"):
            _, _, _, anchor, digest, _ = contexts(*tk.buffers(b.column("a0")), length)
            order = np.lexsort((digest, anchor))
            a, d = anchor[order], digest[order]
            cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]))) if len(a) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[cut]), pa.array(d[cut]), pa.array(np.diff(np.append(cut, len(a))), pa.int64())], ["anchor", "digest", "n"])

    rows = docs.select("a0").mapInArrow(run, "anchor long, digest long, n long")
    return rows.groupBy("anchor", "digest").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, length: int, known: np.ndarray, unclear: np.ndarray) -> DataFrame:
    """Places of repeated anchors in each distinct text (``place``, and the first and last window's distance from it), with the bytes of contexts that are ambiguous (about once a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        sent: set = set()
        for b in tk.slices(batches, "a0"):
            raw, starts, ends = tk.buffers(b.column("a0"))
            view = memoryview(np.ascontiguousarray(raw))
            keep, keys = [], []
            for i in np.flatnonzero(ends - starts >= length).tolist():
                k = _key(view[starts[i] : ends[i]])
                if k not in seen:
                    seen.add(k)
                    keep.append(i)
                    keys.append(k)
            for held in (seen, sent):
                if len(held) > SEEN:
                    held.clear()
            p, lo, hi, a, digest, doc = contexts(raw, starts[keep], ends[keep], length)
            hit = np.flatnonzero(has_bit(known, a)) if len(a) else np.zeros(0, np.int64)
            if not len(hit):
                continue
            p, lo, hi, a, digest, doc = p[hit], lo[hit], hi[hit], a[hit], digest[hit], doc[hit]
            own: list[bytes | None] = [None] * len(p)
            for i in np.flatnonzero(has_bit(unclear, a)).tolist():
                pair = (int(a[i]), int(digest[i]))
                if pair not in sent:
                    sent.add(pair)
                    own[i] = bytes(view[lo[i] : hi[i] + length])
            d1, d2 = np.array(keys, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(digest), pa.array(p - starts[keep][doc]), pa.array((p - lo).astype(np.int16)), pa.array((p - hi).astype(np.int16)), pa.array(d1[doc]), pa.array(d2[doc]), pa.array(own, pa.binary())], PLACE_NAMES)

    return docs.select("a0").mapInArrow(run, PLACES)


PLACES = "anchor long, digest long, place long, most smallint, least smallint, d1 long, d2 long, bytes binary"
PLACE_NAMES = ["anchor", "digest", "place", "most", "least", "d1", "d2", "bytes"]


def _trees(rows: DataFrame, length: int, groups: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Covered ranges ``begin, end`` (from the anchor) of each context ``digest`` of each ``key``.

    ``groups``: the occurrences of maximal repeats instead, with ``repeat``.
    """
    wide = np.int64(1) << 40

    def solve(held: list[tuple]) -> pa.RecordBatch:
        pieces = [r[4] for r in held]
        most, least = np.array([r[2] for r in held], np.int64), np.array([r[3] for r in held], np.int64)
        key, digest = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
        tree = RepeatTree(pieces, most - least + 1, length)
        if groups:
            first, last, depth = tree.maximal()
            at = tree.order[np.repeat(first - (np.cumsum(last - first + 1) - (last - first + 1)), last - first + 1) + np.arange(int((last - first + 1).sum()))]
            size = np.repeat(depth, last - first + 1)
            piece, begin = tree.piece[at], tree.offset[at]
            repeat = np.array([xxhash.xxh3_64_intdigest(pieces[i][j : j + n]) for i, j, n in zip(piece.tolist(), begin.tolist(), size.tolist())], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key[piece]), pa.array(digest[piece]), pa.array(begin - most[piece]), pa.array(begin + size - most[piece]), pa.array(repeat)], ["key", "digest", "begin", "end", "repeat"])
        reach = tree.covered()
        hit = np.flatnonzero(reach)
        piece = tree.piece[hit]
        begin, end = merged(piece * wide + tree.offset[hit], piece * wide + tree.offset[hit] + reach[hit])
        piece = begin // wide
        return pa.RecordBatch.from_arrays([pa.array(key[piece]), pa.array(digest[piece]), pa.array(begin % wide - most[piece]), pa.array(end - piece * wide - most[piece])], ["key", "digest", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "most", "least", "bytes"))):
                if last == r[:2]:
                    continue
                if held and size >= run_bytes and last[0] != r[0]:
                    yield solve(held)
                    held, size = [], 0
                last = r[:2]
                held.append(r)
                size += len(r[4])
        if held:
            yield solve(held)
        tk.release()

    shape = "key long, digest long, begin long, end long" + (", repeat long" if groups else "")
    return rows.select("key", "digest", "most", "least", "bytes").repartition("key").sortWithinPartitions("key", "digest").mapInArrow(run, shape)


def _dealt(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Contexts cut by how far their windows reach to the left of the anchor, in ranges of ``width``; ``key``: the bytes that all windows of a range share, ``part``: its own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list[tuple] = []
            for a, d, most, least, data in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "most", "least", "bytes"))):
                for lo in range(least // width * width, most + 1, width):
                    low, high = max(least, lo), min(most, lo + width - 1)
                    fixed = data[most - lo : most + length - (lo + width - 1)]
                    part = data[most - high : most + length - low]
                    out.append((a, d, one(fixed, lo << 11 | width), one(part, high << 11 | low), high, low, part))
            if out:
                a, d, key, sub, high, low, part = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(np.array(sub, np.uint64).view(np.int64)), pa.array(high, pa.int16()), pa.array(low, pa.int16()), pa.array(part, pa.binary())], ["anchor", "digest", "key", "part", "most", "least", "bytes"])

    return rows.select("anchor", "digest", "most", "least", "bytes").mapInArrow(run, "anchor long, digest long, key long, part long, most smallint, least smallint, bytes binary")


def _split(rows: DataFrame, length: int, block: int) -> DataFrame:
    """Covered ranges ``anchor, digest, begin, end`` of contexts of anchors that have more than ``block`` of them."""
    found, width = [], length - length // 2 + 1
    rows = rows.groupBy("anchor", "digest").agg(F.first("most").alias("most"), F.first("least").alias("least"), F.first("bytes").alias("bytes"))
    while True:
        width = -(-width // FAN)
        level = stored(_dealt(rows, length, width))
        parts = level.groupBy("key", "part").agg(F.count("*").alias("n"))
        keys = stored(parts.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1"))
        twice = parts.where("n > 1").select("key", F.col("part").alias("digest"), F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"))
        some = level.join(keys.where((F.col("kinds") > 1) & (F.col("kinds") <= block)).select("key"), "key", "left_semi")
        trees = _trees(some.drop("digest").withColumnRenamed("part", "digest"), length)
        every = twice.unionByName(trees).withColumnRenamed("digest", "part")
        found.append(stored(level.select("anchor", "digest", "key", "part", "most", "least").join(every, ["key", "part"]).select(
            "anchor", "digest", F.coalesce("begin", -F.col("most")).alias("begin"), F.coalesce("end", length - F.col("least")).alias("end")
        )))
        hot = keys.where(F.col("kinds") > block).select("key")
        if width == 1 or not hot.limit(1).count():
            break
        rows = level.join(hot, "key", "left_semi")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _anchored(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: repeated anchors (``anchor, total, kinds``), contexts that occur twice, and their places."""
    counts = stored(_counts(docs, length))
    per = stored(counts.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1"))
    full = stored(counts.where("n > 1").select("anchor", "digest"))
    drop(counts)
    bits = filter_bits(per.count())
    rows = stored(_places(docs, length, bit_set(per.select("anchor"), bits), bit_set(per.where("kinds > 1").select("anchor"), bits)))
    return per, full, rows


def cover(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """``d1, d2, begin, end``: ranges of each distinct text (``a0``; key: the first halves of its SHA-256) that repeat."""
    per, full, rows = _anchored(docs, length)
    own = rows.where("bytes is not null").select("anchor", "digest", "most", "least", "bytes")
    some = own.join(per.where((F.col("kinds") > 1) & (F.col("kinds") <= block)).select("anchor"), "anchor", "left_semi")
    ranges = _trees(some.withColumn("key", F.col("anchor")), length).withColumnRenamed("key", "anchor")
    hot = per.where(F.col("kinds") > block).select("anchor")
    if hot.limit(1).count():
        ranges = ranges.unionByName(_split(own.join(hot, "anchor", "left_semi"), length, block))
    ranges = stored(ranges)
    # one join for both: a context that occurs twice is covered from its first window to its last
    every = ranges.unionByName(full.select("anchor", "digest", F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end")))
    return rows.drop("bytes").join(every, ["anchor", "digest"]).select(
        "d1", "d2", (F.col("place") + F.coalesce("begin", -F.col("most"))).alias("begin"), (F.col("place") + F.coalesce("end", length - F.col("least"))).alias("end")
    )


def repeat_groups(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``repeat, n_bytes, doc_id, begin, end``: maximal repeats of at least ``length`` bytes with all their occurrences.

    Repeats are maximal within the contexts of one anchor (1.5 lengths); a
    longer one appears as overlapping groups.  A context that occurs more than
    once is a group of its own.  The groups of an anchor are made in one task,
    so this is for inspection of corpora without very common passages;
    ``remove_repeats`` needs no such group.
    """
    rows = folded(docs.select("doc_id", text), text)
    per, full, places = _anchored(rows, length)
    some = places.where("bytes is not null").join(per.where("kinds > 1").select("anchor"), "anchor", "left_semi")
    trees = _trees(some.withColumn("key", F.col("anchor")), length, groups=True).withColumnRenamed("key", "anchor")
    whole = full.select("anchor", "digest", F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"), F.col("digest").alias("repeat"))
    at = places.drop("bytes").join(stored(trees.unionByName(whole)), ["anchor", "digest"]).select(
        "repeat", "d1", "d2", (F.col("place") + F.coalesce("begin", -F.col("most"))).alias("begin"), (F.col("place") + F.coalesce("end", length - F.col("least"))).alias("end")
    )
    known = _tagged(rows, length, None, None).select(F.col("row.c0").alias("doc_id"), "d1", "d2")
    return at.distinct().join(known, ["d1", "d2"]).select("repeat", (F.col("end") - F.col("begin")).alias("n_bytes"), "doc_id", "begin", "end")


def _tagged(docs: DataFrame, length: int, hits: np.ndarray | None, want: bool | None) -> DataFrame:
    """``row, a0, n_bytes, d1, d2, sha`` of the rows whose text is (``want``) or is not in the filter; without a filter those of at least ``length`` bytes, without text."""
    row = docs.schema["row"]
    bare = hits is None
    shape = T.StructType([row, *([] if bare else [docs.schema["a0"]]), *T._parse_datatype_string("n_bytes long, d1 long, d2 long, sha string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "a0"):
            raw, starts, ends = tk.buffers(b.column("a0"))
            view = memoryview(np.ascontiguousarray(raw))
            sha = [hashlib.sha256(view[i:j]).digest() for i, j in zip(starts.tolist(), ends.tolist())]
            d1, d2 = np.array([(int.from_bytes(x[:8], "big", signed=True), int.from_bytes(x[8:16], "big", signed=True)) for x in sha], np.int64).reshape(-1, 2).T
            mine = ends - starts >= length
            if not bare:
                mine = (mine & has_bit(hits, np.ascontiguousarray(d1))) == want
            at = pa.array(np.flatnonzero(mine))
            cols = [b.column("row"), *([] if bare else [b.column("a0")]), pa.array(ends - starts), pa.array(d1), pa.array(d2), pa.array([x.hex() for x in sha])]
            yield pa.RecordBatch.from_arrays([c.take(at) for c in cols], shape.names)

    return docs.select("row", "a0").mapInArrow(run, shape)


def _cut(rows: DataFrame) -> DataFrame:
    """Texts without their ``spans``: ``row, a0, n_bytes, n_removed, n_spans, kept_sha256``."""
    shape = T.StructType([rows.schema["row"], rows.schema["a0"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tk.slices(iter([whole]), "a0"):
                texts, gone, runs, digest = [], [], [], []
                for t, spans, sha in zip(b.column("a0").to_pylist(), b.column("spans"), b.column("sha").to_pylist()):
                    if not spans.is_valid:
                        for held, x in zip((texts, gone, runs, digest), (t, 0, 0, sha)):
                            held.append(x)
                        continue
                    data, flat = t.encode(), spans.values
                    begin, end = merged(flat.field("begin").to_numpy(zero_copy_only=False), np.minimum(flat.field("end").to_numpy(zero_copy_only=False), len(data)))
                    bounds = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(data)]
                    left = b"".join(data[i:j] for i, j in zip(bounds[::2], bounds[1::2]))
                    texts.append(left.decode("utf-8", "ignore"))
                    gone.append(int((end - begin).sum()))
                    runs.append(len(begin))
                    digest.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, b.column("a0").type), b.column("n_bytes"), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], shape.names)

    return rows.mapInArrow(run, shape)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """``docs`` with the covered bytes cut out of the text, and ``n_bytes, n_removed, n_spans, kept_sha256``.

    A character of which only a part is covered goes as a whole; the counts and
    the digest are those of the bytes.  Only rows whose text loses something
    are shuffled.
    """
    rows = folded(docs, text)
    keys = _tagged(rows, length, None, None).groupBy("d1", "d2").agg(F.count("*").alias("n"))
    twice = stored(keys.where("n > 1").select("d1", "d2"))
    span = F.struct("begin", "end")
    own = cover(rows, length, block).join(twice, ["d1", "d2"], "left_anti").groupBy("d1", "d2").agg(F.collect_list(span).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.lit(1 << 62).cast("long").alias("end")))
    covered = stored(own.unionByName(twice.withColumn("spans", whole)))
    hits = bit_set(covered.select("d1"), filter_bits(covered.count()))
    cut = _cut(_tagged(rows, length, hits, True).join(covered, ["d1", "d2"], "left"))
    none = F.lit(0).cast("long")
    rest = _tagged(rows, length, hits, False).select("row", "a0", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    results: dict[str, Column] = {c: F.col(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    return unfolded(cut.unionByName(rest), docs.columns, {text: "a0"}, results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


#: Every start of every text by its 400 bytes in hexadecimal; the starts are read from pieces of 512, as ``substr`` walks from the front.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT k, len(h) // 2 - 399 AS starts, o, substr(h, 2 * o + 1, 2 * (512 + 399)) AS part FROM (SELECT k, h, unnest(range(0, len(h) // 2 - 399, 512)) AS o FROM t WHERE len(h) >= 800)),
s AS (SELECT k, o + i AS i, md5(substr(part, 2 * i + 1, 800)) AS d FROM (SELECT k, o, part, unnest(range(0, least(512, starts - o))) AS i FROM o)),
c AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY d) AS n FROM s) WHERE n > 1),
g AS (SELECT k, i, CASE WHEN i - lag(i) OVER w <= 400 THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY k ORDER BY i)),
n AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS span FROM g),
r AS (SELECT k, span, min(i) AS b, max(i) + 400 AS e FROM n GROUP BY k, span),
q AS (SELECT k, b, coalesce(lag(e) OVER (PARTITION BY k ORDER BY b), 0) AS a FROM r UNION ALL SELECT t.k, len(h) // 2, coalesce(max(e), 0) FROM t LEFT JOIN r USING (k) GROUP BY t.k, h),
p AS (SELECT k, a, substr(h, 2 * a + 1, 2 * (b - a)) AS piece FROM q JOIN t USING (k)),
j AS (SELECT k, string_agg(piece, '' ORDER BY a) AS kept, string_agg(regexp_replace(regexp_replace(piece, '^([89AB].)+', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', ''), '' ORDER BY a) AS whole FROM p GROUP BY k)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST((len(h) - len(kept)) // 2 AS BIGINT) AS n_removed, (SELECT count(*) FROM r WHERE r.k = t.k) AS n_spans, sha256(unhex(kept)) AS kept_sha256,
CASE WHEN len(kept) = len(h) THEN text ELSE decode(unhex(whole)) END AS text FROM t JOIN j USING (k)
"""
