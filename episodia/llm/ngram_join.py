"""N-gram Jaccard join by T-occurrence search (DivideSkip), with its connected components.

Documents are sets of 64-bit hashes of lower-cased 5-word shingles; equal sets
collapse to a class first.  Two classes link when
100 * |A and B| >= 75 * |A or B|, so each shares at least ceil(0.75 n) of its n
shingles, whatever the other's size.

1. One text pass measures the sets and counts shingles in a table of fixed
   size; shingles in crowded buckets are taken as long lists.
2. A second pass sends the first n - ceil(0.75 n) + k shingles of each class in
   the order (short lists first, hash), k = n / 16: linked classes share at
   least k of these (that of the smaller one), and passages that very many
   documents hold come last and so hardly count.  A class with fewer than k
   shingles in lists of several classes is dropped, again and again for a few
   rounds: a passage in common doesn't make a candidate.  Of lists with the
   same members one is kept.  Within what is left of a list, without a gap in
   size that no link can cross, classes whose bitmaps leave a link possible (a
   bit that only one has stands for an element that only one has) are joined;
   the components of these edges are the candidate clusters.
3. A third pass sends the whole sets of clustered classes to their cluster.
   A set goes once for each task, not once for each copy.
4. Within a block of a cluster, breadth-first T-occurrence search finds the
   components: a popped set's short inverted lists are merged (or counted, where
   they hold more postings than the block has members), what reaches T - L is
   looked up in its L longest lists by binary search, and classes found need no
   second search from the same side.  Nothing expands
   groups of copies into pairs.
5. A cluster of more than ``BLOCK`` shingles is dealt to several blocks.
   Representatives of the blocks' components are joined first; then every class
   outside the cluster's largest component is searched for in all blocks, which
   leaves no link between different components unseen.

Shingles are told apart by 64-bit hashes, sets by 128 bits.

Defined cases: a document without words has n_shingles 0 and is its own
component; a text of under five words has one shingle; a null ``doc_id`` is not
a component's id unless it has no other; repeated rows get equal results; an
empty table gives an empty result.  ``link_components`` reads the id and the
text only; ``one_of_each`` returns the columns of its input whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodia.llm import textkernel as tk
from episodia.llm.components import bit_set, components, filter_bits, has_bit, packed, sum_arrays
from episodia.llm.shared import drop, folded, stored, unfolded

U64 = np.uint64
SHINGLE = 5
NUM, DEN = 75, 100  # similarity of at least NUM / DEN
BUCKET_BITS = 18
COUNT_SLICE = 1 << 14
BLOCK = 1 << 21
ROUNDS = 3
SKETCH_BITS = 1 << 13
LIST = 1 << 12


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of ``n`` shares with any set it links to."""
    return -(-n * NUM // DEN)


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shingles that the prefixes of linked sets share, by the size of the smaller one."""
    return np.maximum(1, n // 16)


def _class_hashes(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    out = []
    for c in (0x8CB92BA72F3D8DD7, 0xB5026F5AA96619E9):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(v ^ U64(c)), dtype=np.uint64)])
        out.append(tk.mix((total[at[1:]] - total[at[:-1]]) ^ np.diff(at).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (tk.mix(h ^ U64(0x51ED270B)) >> U64(64 - BUCKET_BITS)).astype(np.int64)


def _sets(b: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v, at = tk.shingle_sets(*tk.buffers(b.column(text)), SHINGLE)
    d1, d2 = _class_hashes(v, at)
    return v, at, np.diff(at), d1, d2


def _measure(docs: DataFrame, text: str) -> tuple[DataFrame, np.ndarray]:
    """Size and class digests of every document; which buckets of the count table are crowded."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        names = ["doc_id", "n", "d1", "d2", "slice", "part", "data"]
        kind = None
        for b in tk.slices(batches, text):
            v, _, n, d1, d2 = _sets(b, text)
            counts += np.bincount(_bucket(v), minlength=len(counts)).astype(np.uint32)
            kind = b.column("doc_id").type
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
        if kind is not None:
            rows = packed(counts, COUNT_SLICE)
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([TaskContext.get().partitionId()] * k, pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names)

    both = stored(docs.select("doc_id", text).mapInArrow(run, f"doc_id {id_type}, n long, d1 long, d2 long, slice int, part long, data binary"))
    counts = sum_arrays(both.where("slice is not null").select("slice", "part", "data"), COUNT_SLICE, (1 << BUCKET_BITS) // COUNT_SLICE, "uint32").astype(float)
    mean = counts.mean()
    return both.where("slice is null").select("doc_id", "n", "d1", "d2"), counts > mean + 8 * np.sqrt(mean) + 32


def _postings(docs: DataFrame, text: str, crowded: np.ndarray) -> DataFrame:
    """``shingle, d1, n`` for the prefix of each class, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in tk.slices(batches, text):
            v, at, n, d1, _ = _sets(b, text)
            keep = np.zeros(len(n), bool)
            for i, d in enumerate(d1.tolist()):
                if n[i] and d not in done:
                    done.add(d)
                    keep[i] = True
            doc = np.repeat(np.arange(len(n)), n)
            mine = keep[doc]
            v, doc = v[mine], doc[mine]
            late = crowded[_bucket(v)]
            # within each document the sorted hashes of short lists come first, then those of long ones
            early_n = np.bincount(doc[~late], minlength=len(n))
            running = np.cumsum(~late)
            first = np.searchsorted(doc, np.arange(len(n)))
            before = np.concatenate([[0], running])[first]
            rank = np.where(late, early_n[doc] + (np.arange(len(v)) - first[doc]) - (running - before[doc]), running - before[doc] - 1)
            chosen = rank < (n - least_overlap(n) + least_shared(n))[doc]
            v, doc = v[chosen], doc[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(d1[doc]), pa.array(n[doc].astype(np.int32))], ["shingle", "d1", "n"])

    return docs.select(text).mapInArrow(run, "shingle long, d1 long, n int")


def _runs(postings: DataFrame) -> DataFrame:
    """``shingle, d1, n, head``: postings in lists of several classes, once each; head: the first class of the list.

    A list is cut where a gap in size is too wide for any link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row before, the head of its run, whether it has been sent
        for b in batches:
            if not b.num_rows:
                continue
            s, d, n = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
            if last is not None:  # the row before goes in front again
                s, d, n = np.append(last[0], s), np.append(last[1], d), np.append(last[2], n)
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            s, d, n = s[fresh], d[fresh], n[fresh]
            cut = np.ones(len(s), bool)
            cut[1:] = (s[1:] != s[:-1]) | (n[:-1] * DEN < n[1:] * NUM)
            first = np.maximum.accumulate(np.where(cut, np.arange(len(s)), 0))
            head = d[first]
            if last is not None:
                head[first == 0] = last[3]
            alone = cut & np.append(cut[1:], True)
            send = ~alone
            send[-1] = not cut[-1]
            if last is not None:
                send[0] = not last[4] and len(s) > 1 and not cut[1]
            # the last row is sent later if it begins a run
            sent = bool(send[-1]) or (last is not None and len(s) == 1 and last[4])
            last = (s[-1:], d[-1:], n[-1:], head[-1], sent)
            if send.any():
                yield pa.RecordBatch.from_arrays([pa.array(s[send]), pa.array(d[send]), pa.array(n[send].astype(np.int32)), pa.array(head[send])], ["shingle", "d1", "n", "head"])

    return postings.select("shingle", "d1", "n").repartition("shingle").sortWithinPartitions("shingle", "n", "d1").mapInArrow(run, "shingle long, d1 long, n int, head long")


def _shared_lists(postings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The lists' rows, classes that share too little left out."""
    lists = stored(_runs(postings))
    smaller = F.ceil(F.col("n") * NUM / DEN).cast("int")
    for _ in range(rounds):
        enough = lists.groupBy("d1").agg(F.count("*").alias("_k"), F.max("n").alias("n")).where(F.col("_k") >= F.greatest(F.lit(1), F.floor(smaller / 16))).select("d1")
        left = stored(_runs(lists.join(enough, "d1", "left_semi")))
        drop(lists)
        lists = left
    return lists


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """One of all lists with the same members: the shingles of a passage say the same about its documents."""
    members = lists.groupBy("shingle", "head").agg(F.sum(F.xxhash64("d1").cast("decimal(20,0)")).alias("_s"), F.sum(F.xxhash64(F.lit(1), "d1").cast("decimal(20,0)")).alias("_t"), F.count("*").alias("_n"))
    one = members.groupBy("head", "_s", "_t", "_n").agg(F.min("shingle").alias("shingle")).select("shingle", "head")
    return lists.join(one, ["shingle", "head"], "left_semi")


def sketch(v: np.ndarray) -> bytes:
    """A bitmap of a set, of a power of two of bits: about one to two for each element, at most ``SKETCH_BITS``."""
    bits = min(max(64, 1 << int(len(v)).bit_length()), SKETCH_BITS)
    own = np.zeros(bits, bool)
    own[(tk.mix(v ^ U64(0x2545F491)) & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(own, bitorder="little").tobytes()


def may_link(one: np.ndarray, n: int, many: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sketches (rows of 64-bit words, equally wide) leave a link possible.

    Each bit of one sketch that the other lacks stands for an element that the other set lacks.
    """
    lacks = np.bitwise_count(one & ~many).sum(axis=1, dtype=np.int64)
    extra = np.bitwise_count(many & ~one).sum(axis=1, dtype=np.int64)
    shared = np.minimum(n - lacks, sizes - extra)
    return (shared > 0) & (shared * DEN >= NUM * (n + sizes - shared))


def _fold(own: list[bytes], n_bytes: int) -> np.ndarray:
    """Sketches of one width brought to ``n_bytes``, which is not more."""
    words = np.frombuffer(b"".join(own), np.uint64)
    return np.bitwise_or.reduce(words.reshape(len(own), -1, n_bytes // 8), axis=1)


def list_groups(n: np.ndarray, own: list[bytes]) -> np.ndarray:
    """Group number of each member of a list: groups are joined by pairs that may link (breadth first).

    A member is held against those of sizes it can link to only, at the narrower
    width of the two: folded to the width of the list's smallest set, the
    sketches of large ones would be full and say nothing.
    """
    label = np.full(len(n), -1)
    width = np.array([len(x) for x in own])
    row, known = np.zeros(len(n), np.int64), {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        row[at] = np.arange(len(at))
        known[w, w] = _fold([own[i] for i in at.tolist()], w)

    def words(w: int, to: int) -> np.ndarray:
        if (w, to) not in known:
            known[w, to] = np.bitwise_or.reduce(known[w, w].reshape(len(known[w, w]), -1, to // 8), axis=1)
        return known[w, to]

    left = np.argsort(n, kind="stable")
    number = 0
    while len(left):
        queue, left = [int(left[0])], left[1:]
        label[queue[0]] = number
        while queue and len(left):
            q = queue.pop()
            size, mine = int(n[q]), int(width[q])
            lo, hi = np.searchsorted(n[left], [-(-size * NUM // DEN), size * DEN // NUM + 1]).tolist()
            near = left[lo:hi]
            hit = np.zeros(len(near), bool)
            for w in np.unique(width[near]).tolist():
                some, to = np.flatnonzero(width[near] == w), min(w, mine)
                hit[some] = may_link(words(mine, to)[row[q]], size, words(w, to)[row[near[some]]], n[near[some]])
            found = near[hit]
            left = np.concatenate([left[:lo], near[~hit], left[hi:]])
            label[found] = number
            queue += found.tolist()
        number += 1
    return label


def _edges(lists: DataFrame) -> DataFrame:
    """Edges ``a, b`` between members of a list whose sketches leave a link possible, from the first of each group.

    A list of more than ``LIST`` members is taken in parts whose groups are then
    joined, which may only make a cluster larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key: tuple, rows: list[tuple], more: bool) -> None:
            d = np.array([r[0] for r in rows], np.int64)
            label = list_groups(np.array([r[1] for r in rows], np.int64), [r[2] for r in rows])
            _, first = np.unique(label, return_index=True)
            head = d[first][label] if not more else np.full(len(d), key[1])
            pairs.update(zip(head[head != d].tolist(), d[head != d].tolist()))

        pairs: set = set()
        key, held, parts = None, [], 0
        for b in batches:
            for s, h, d, n, x in zip(*(b.column(c).to_pylist() for c in ("shingle", "head", "d1", "n", "sketch"))):
                if (s, h) != key:
                    if held:
                        solve(key, held, parts > 0)
                    key, held, parts = (s, h), [], 0
                elif len(held) >= LIST:
                    solve(key, held, True)
                    held, parts = [], parts + 1
                held.append((d, n, x))
            if len(pairs) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])
                pairs.clear()
        if held:
            solve(key, held, parts > 0)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return lists.select("shingle", "head", "d1", "n", "sketch").repartition("shingle", "head").sortWithinPartitions("shingle", "head", "n", "d1").mapInArrow(run, "a long, b long").distinct()


def _sketches(docs: DataFrame, text: str, known: np.ndarray) -> DataFrame:
    """``d1, sketch`` of each class in the filter, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in tk.slices(batches, text):
            v, at, n, d1, _ = _sets(b, text)
            rows = []
            for i in np.flatnonzero(has_bit(known, d1) & (n > 0)).tolist():
                if int(d1[i]) not in done:
                    done.add(int(d1[i]))
                    rows.append((int(d1[i]), sketch(v[at[i] : at[i + 1]])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["d1", "sketch"])

    return docs.select(text).mapInArrow(run, "d1 long, sketch binary").groupBy("d1").agg(F.min("sketch").alias("sketch"))


def occurrences(postings: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending members of some lists (each ascending, one after the other) and how many lists hold each.

    The lists are merged as the runs they are; where they have more postings
    than there are members, an array of all members counts them.
    """
    if len(postings) > members:
        count = np.bincount(postings, minlength=members)
        found = np.flatnonzero(count)
        return found, count[found]
    merged = np.sort(postings, kind="stable")  # merges ascending runs, sorts nothing anew
    first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])) if len(merged) else np.zeros(0, np.int64)
    return merged[first], np.diff(np.append(first, len(merged)))


class Index:
    """Inverted lists of some sets, for T-occurrence search among those still wanted."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.sets = sets
        self._build(members)

    def _build(self, members: np.ndarray) -> None:
        self.members = members
        self.size = np.array([len(self.sets[i]) for i in members], np.int64)
        whole = np.concatenate([self.sets[i] for i in members]) if len(members) else np.zeros(0, np.uint64)
        who = np.repeat(np.arange(len(members)), self.size)
        order = np.argsort(whole, kind="stable")
        whole, self.lists = whole[order], who[order]
        first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, np.int64)
        self.keys, self.at = whole[first], np.append(first, len(whole))
        self.wanted = np.ones(len(members), bool)
        self.left = len(members)

    def drop(self, slots: np.ndarray) -> None:
        """Forget members; the lists are rebuilt when half of them are gone."""
        self.left -= int(self.wanted[slots].sum())
        self.wanted[slots] = False
        if self.left * 2 < len(self.members):
            self._build(self.members[self.wanted])

    def search(self, q: np.ndarray) -> np.ndarray:
        """Slots of wanted members that link to the set ``q``."""
        n = len(q)
        t = max(1, int(least_overlap(np.int64(n))))  # an empty set links with nothing
        where = np.searchsorted(self.keys, q)
        where = np.minimum(where, len(self.keys) - 1) if len(self.keys) else where
        hit = where[self.keys[where] == q] if len(self.keys) else where[:0]
        if len(hit) < t:
            return np.zeros(0, np.int64)
        length = self.at[hit + 1] - self.at[hit]
        # DivideSkip: the L longest lists are only probed, L = T / (mu log M + 1)
        n_long = min(int(t / (0.0085 * np.log2(length.max() + 1) + 1)), t - 1, len(hit) - 1)
        order = np.argsort(length, kind="stable")
        short, long = hit[order[: len(hit) - n_long]], hit[order[len(hit) - n_long :]]
        lo, span = self.at[short], self.at[short + 1] - self.at[short]
        gather = np.repeat(lo - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        cand, have = occurrences(self.lists[gather], len(self.members))
        on = (have >= t - n_long) & self.wanted[cand] & (self.size[cand] * DEN >= n * NUM) & (self.size[cand] * NUM <= n * DEN)
        cand, have = cand[on], have[on]
        # binary search in the long lists; a candidate goes once it cannot reach its own T any more
        need = -(-(n + self.size[cand]) * NUM // (NUM + DEN))
        for k, x in enumerate(long.tolist()):
            if not len(cand):
                break
            part = self.lists[self.at[x] : self.at[x + 1]]
            p = np.minimum(np.searchsorted(part, cand), len(part) - 1)
            have = have + (part[p] == cand)
            on = have + (len(long) - k - 1) >= need
            if not on.all():
                cand, need, have = cand[on], need[on], have[on]
        union = n + self.size[cand] - have
        return cand[DEN * have >= NUM * union]


def local_components(sets: list[np.ndarray]) -> np.ndarray:
    """Component number of each set (sorted hashes), by breadth-first search."""
    label = np.full(len(sets), -1)
    if len(sets) == 1:
        return np.zeros(1, np.int64)
    order = np.argsort([-len(s) for s in sets], kind="stable")
    index = Index(sets, np.arange(len(sets)))
    for number, root in enumerate(order.tolist()):
        if label[root] >= 0:
            continue
        label[root] = number
        index.drop(np.flatnonzero(index.members == root))
        queue = [root]
        while queue and index.left:
            slots = index.search(sets[queue.pop()])
            found = index.members[slots]
            label[found] = number
            queue += found.tolist()
            index.drop(slots)
    return label


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in keys])
        cuts = np.append(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, b.num_rows).tolist()
        lo = 0
        for hi in cuts:
            own = tuple(k[:, lo].tolist())
            if last is not None and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last, lo = own, hi
    if held:
        yield pa.Table.from_batches(held)


def _unpack(t: pa.Table) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """The distinct classes of a group and their sets."""
    seen: dict[tuple[int, int], np.ndarray] = {}
    for a, b, x in zip(t.column("d1").to_pylist(), t.column("d2").to_pylist(), t.column("items")):
        if (a, b) not in seen:
            seen[a, b] = np.frombuffer(x.as_buffer(), np.uint64)
    return list(seen), list(seen.values())


def _search_blocks(sets: DataFrame) -> DataFrame:
    """``cluster, d1, d2, root``: components within each (cluster, block); the root is the component's least d1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["cluster", "block"]):
            ids, items = _unpack(t)
            label = local_components(items)
            d1 = np.array([x[0] for x in ids], np.int64)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, label, d1)
            cluster, block = t.column("cluster")[0].as_py(), t.column("block")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([cluster] * len(ids), pa.int64()), pa.array([block] * len(ids), pa.int64()), pa.array(d1), pa.array([x[1] for x in ids], pa.int64()), pa.array(least[label]), pa.array([len(x) for x in items], pa.int64())], ["cluster", "block", "d1", "d2", "root", "n"])

    return sets.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(run, "cluster long, block long, d1 long, d2 long, root long, n long")


def _search_across(rows: DataFrame) -> DataFrame:
    """Edges ``a, b`` between components: asked classes (``asked``) of other blocks against a block's own ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["cluster", "block", "chunk"]):
            asked = np.array(t.column("asked").to_pylist(), bool)
            root = t.column("root").to_numpy()
            items = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("items")]
            own = np.flatnonzero(~asked)
            if not len(own) or not asked.any():
                continue
            index = Index(items, own)
            pairs = set()
            for q in np.flatnonzero(asked).tolist():
                for x in index.members[index.search(items[q])].tolist():
                    if root[x] != root[q]:
                        pairs.add((int(root[q]), int(root[x])))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return rows.repartition("cluster", "block", "chunk").sortWithinPartitions("cluster", "block", "chunk").mapInArrow(run, "a long, b long").distinct()


def _relabel(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` with roots merged along ``edges`` between roots; stored."""
    merged = components(edges)
    out = stored(comps.join(merged.withColumnRenamed("root", "_to"), comps["root"] == F.col("node"), "left").withColumn("root", F.coalesce("_to", "root")).drop("node", "_to"))
    drop(merged)
    return out


def link_components(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    measured, crowded = _measure(docs, text)
    shared = _shared_lists(_postings(docs, text, crowded))
    lists = stored(_distinct_lists(shared))
    drop(shared)
    sketches = _sketches(docs, text, bit_set(lists.select("d1"), filter_bits(lists.count())))
    edges = stored(_edges(lists.join(sketches, "d1")))
    drop(lists)
    clusters = components(edges).select(F.col("node").alias("d1"), F.col("root").alias("cluster"))
    drop(edges)
    known = bit_set(clusters.select("d1"), filter_bits(clusters.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in tk.slices(batches, text):
            v, at, n, d1, d2 = _sets(b, text)
            rows = []
            for i in np.flatnonzero(has_bit(known, d1) & (n > 0)).tolist():
                key = (int(d1[i]), int(d2[i]))
                if key not in done:
                    done.add(key)
                    rows.append((*key, int(n[i]), v[at[i] : at[i + 1]].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["d1", "d2", "n", "items"])

    classes = measured.where("n > 0").groupBy("d1", "d2").agg(F.max("n").alias("n")).join(clusters, "d1")
    weight = classes.groupBy("cluster").agg(F.sum("n").alias("_sum")).select("cluster", F.ceil(F.col("_sum") / F.lit(block)).cast("long").alias("blocks"))
    place = stored(clusters.join(weight, "cluster").select("d1", "cluster", "blocks", F.pmod(F.xxhash64("d1"), "blocks").alias("block")))
    sets = docs.select(text).mapInArrow(run, "d1 long, d2 long, n long, items binary").join(place, "d1")
    wide = place.where("blocks > 1").limit(1).count() > 0
    if wide:
        sets = stored(sets)
    comps = stored(_search_blocks(sets))
    if wide:
        own_blocks, comps = comps, _join_blocks(comps, sets, block)
        drop(own_blocks)
    own = F.when(F.col("n") > 0, F.coalesce("root", "d1"))
    named = stored(measured.join(comps.select("d1", "d2", "root").distinct(), ["d1", "d2"], "left").select("doc_id", "n", own.alias("c1"), F.when(F.col("root").isNull(), F.col("d2")).alias("c2")))
    drop(measured, clusters, place, comps, *([sets] if wide else []))
    ids = named.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("component_id"))
    joined = named.join(ids, named["c1"].eqNullSafe(ids["c1"]) & named["c2"].eqNullSafe(ids["c2"]), "left")
    return joined.select("doc_id", named["n"].alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _join_blocks(comps: DataFrame, sets: DataFrame, block: int, reps: int = 8) -> DataFrame:
    """Components of clusters that lie in several blocks, joined across blocks."""
    wide = sets.where("blocks > 1").select("cluster").distinct()
    many = comps.join(wide, "cluster", "left_semi")
    rest = comps.join(wide, "cluster", "left_anti")
    # a few representatives of each block's larger components, joined in one block of the cluster
    size = many.groupBy("cluster", "block", "root").agg(F.count("*").alias("_size"), F.min(F.struct(F.xxhash64("d1").alias("h"), "d1")).alias("_1"), F.max(F.struct("n", "d1")).alias("_2"), F.min(F.struct("n", "d1")).alias("_3"), F.max(F.struct(F.xxhash64("d1").alias("h"), "d1")).alias("_4"))
    chosen = size.where("_size > 1").select("root", F.explode(F.array_distinct(F.array("_1.d1", "_2.d1", "_3.d1", "_4.d1"))).alias("d1"))
    picked = sets.join(chosen, "d1", "left_semi").withColumn("block", F.lit(0).cast("long"))
    first = stored(_search_blocks(picked).select("d1", F.col("root").alias("meet")))
    meeting = many.select("d1", "root").join(first, "d1").select("meet", "root").distinct()
    edges = meeting.join(meeting.groupBy("meet").agg(F.min("root").alias("b")), "meet").select(F.col("root").alias("a"), "b")
    many = _relabel(many, edges)
    drop(first)
    # whatever is outside the cluster's largest component is searched for in all other blocks
    top = many.groupBy("cluster", "root").agg(F.count("*").alias("_k")).groupBy("cluster").agg(F.max(F.struct("_k", "root")).alias("_top")).select("cluster", F.col("_top.root").alias("_top"))
    rooted = sets.join(many.select("cluster", "d1", "d2", "root"), ["cluster", "d1", "d2"]).join(top, "cluster").dropDuplicates(["cluster", "d1", "d2"])
    cols = ["cluster", "block", "chunk", "root", "asked", "items"]
    out = rooted.where("root <> _top")
    loads = out.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(block)).cast("long").alias("chunks"))
    asked = out.join(loads, "cluster").withColumn("chunk", F.pmod(F.xxhash64("d2"), "chunks")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("_to <> block").withColumn("block", F.col("_to").cast("long")).withColumn("asked", F.lit(True)).select(*cols)
    own = rooted.join(loads, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("asked", F.lit(False)).select(*cols)
    joined = _relabel(many, _search_across(own.unionByName(asked)))
    out = stored(rest.unionByName(joined))
    drop(many, joined)
    return out


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component of ``docs``: that of the smallest id (ties: of the least hash of its text).

    A row with a null id stays if nothing else of its component has an id; of
    repeated rows one stays; one id on two unlike texts keeps both.
    """
    rows = folded(docs, "doc_id", text)
    none = F.col("a0").isNull()
    key = F.struct(none.alias("none"), F.coalesce("a0", F.lit(0)).alias("id"), F.xxhash64("a1").alias("h1"), F.xxhash64(F.lit(1), "a1").alias("h2"))
    keyed = rows.withColumn("key", key)
    found = link_components(keyed.select(F.col("key").alias("doc_id"), F.col("a1").alias("text")))
    heads = stored(found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("times")))
    kept = keyed.join(heads, "key")
    if heads.where("times > 1").limit(1).count():
        kept = kept.where("times = 1").unionByName(kept.where("times > 1").dropDuplicates(["key"]))
    return unfolded(kept, docs.columns, {"doc_id": "a0", text: "a1"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY 1) m ON m.node = n.doc_id
"""
