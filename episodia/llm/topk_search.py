"""Exact top-k search by inner product with two cover trees.

Vectors are integer-quantised.  Equal vectors collapse to one entry that keeps
its ``k + 1`` smallest ids (no query needs more of them).  Data and queries are
each indexed once, by a tree of three parts:

* groups of blocks and blocks of bounded size lie around pivots.  The pivots are
  in farthest-first order, so each prefix of them is a net: the first ones are
  the centres of the groups, all of them those of the blocks (nesting);
* within a block, a cover tree: a node's children are separated by more than
  half its radius and cover it within half its radius, the first child keeps
  its centre.  What falls to small children is one leaf; a node whose net would
  take more than an eighth of its rows is a leaf.

A pair of nodes is pruned when

    <q, r> + |q| R + |r| Q + Q R  <  worst kth score of the query group

with node centres q, r and covering radii Q, R: no descendant pair can enter any
of the group's lists.

1. Each query block is searched in the data block with the best bound, which
   gives every query block its worst kth score, and every query group the least
   of its blocks'.
2. Pairs of groups, then of a query block and a group, then of blocks, come from
   equi-joins with the children of the pairs that are left; the bound is tested
   at each level on narrow rows.  The blocks of the remaining pairs are searched
   by dual-tree traversal: the queries, a fiftieth of the rows, travel to the
   data blocks.
3. The best ``k + 1`` of each query's partial lists are kept by a window whose
   limit is applied before its shuffle; a query's own row is removed at the end.

The pivots are fitted on at most ``PIVOT_SAMPLE`` rows (of the least hashes);
every row is indexed, and the pivots do not change the result.  Vectors in
which nothing is near anything are compared block by block.

Defined cases: vectors that are null or hold null or non-finite components take
no part; zero vectors do; ties go to the smaller id; a query with fewer than k
other rows gets all of them; vectors of different lengths are never compared;
rows with a null id are candidates for nobody and ask nothing; repeated (id,
vector) rows count once; an empty table gives an empty result; components beyond
64 bits are the greatest or least integer, and so are scores.  Only the columns
``id`` and ``vector`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from episodia.llm.shared import least_hashes, stored

K = 5
EVERY = 50
SCALE = 256
BLOCK = 4096
QUERY_BLOCK = 1024
BLOCK_BYTES = 1 << 21  # of a block's vectors at eight bytes a component
PIVOT_SAMPLE = 4096
LEAF = 64
NONE = -(1 << 63)  # below every score
MOST = (1 << 63) - 1  # greatest score; scores beyond 64 bits count as MOST or -MOST
EXACT = 1 << 53


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as long; null unless all components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


class CoverTree:
    """A cover tree over the (integer) rows of a matrix, in flat arrays.

    ``order`` puts the rows of each node side by side: node i has the rows
    ``start[i]:end[i]`` of it, centre ``centre[i]`` (a row), ``radius[i]`` and the
    children ``first[i]:first[i] + count[i]``.
    """

    FIELDS = ("start", "end", "centre", "first", "count")

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        points = points.astype(np.float64)
        self.order = np.arange(len(points))
        out: dict[str, list] = {c: [] for c in (*self.FIELDS, "radius")}
        if len(points):
            exact = 4 * points.shape[1] * float(np.abs(points).max(initial=0)) ** 2 < EXACT
            square = np.einsum("ij,ij->i", points, points)

            def distance(rows: np.ndarray, to: int) -> np.ndarray:
                if exact:  # sums of integers below 2**53
                    return np.sqrt(square[rows] - 2 * (points[rows] @ points[to]) + square[to])
                d = points[rows] - points[to]
                return np.sqrt(np.einsum("ij,ij->i", d, d))

            middle = points.mean(axis=0)
            queue = [(0, len(points), int(np.argmin(((points - middle) ** 2).sum(axis=1))), True)]
            i = 0
            while i < len(queue):
                start, end, centre, may_split = queue[i]
                i += 1
                rows = self.order[start:end]
                d = distance(rows, centre)
                cells = self._cells(rows, centre, d, distance, leaf) if may_split and len(rows) > leaf else []
                for c, x in zip(out, (start, end, centre, len(queue), len(cells), float(d.max()))):
                    out[c].append(x)
                if cells:
                    self.order[start:end] = np.concatenate([own for own, _, _ in cells])
                for own, own_centre, split in cells:
                    queue.append((start, start + len(own), own_centre, split))
                    start += len(own)
        for c in self.FIELDS:
            setattr(self, c, np.array(out[c], np.int32))
        self.radius = np.array(out["radius"])

    @staticmethod
    def _cells(rows: np.ndarray, centre: int, d: np.ndarray, distance, leaf: int) -> list[tuple[np.ndarray, int, bool]]:
        """The rows by the nearest centre of a net at half the radius, farthest first; small cells together are a leaf around ``centre``."""
        near, nearest, centres = d.copy(), np.zeros(len(rows), np.int64), [centre]
        while near.max() > d.max() / 2:
            if len(centres) > len(rows) // 8:
                return []
            centres.append(int(rows[int(np.argmax(near))]))
            far = distance(rows, centres[-1])
            closer = far < near
            near[closer], nearest[closer] = far[closer], len(centres) - 1
        size = np.bincount(nearest, minlength=len(centres))
        large = np.flatnonzero(size > leaf)
        if not len(large) or d.max() == 0:
            return []
        rest = rows[size[nearest] <= leaf]
        return [(rows[nearest == c], centres[c], True) for c in large.tolist()] + ([(rest, centre, False)] if len(rest) else [])

    def packed(self) -> tuple[bytes, bytes]:
        return np.stack([getattr(self, c) for c in self.FIELDS]).tobytes(), self.radius.tobytes()

    @classmethod
    def unpacked(cls, nodes: bytes, radius: bytes) -> CoverTree:
        """The tree without ``order``: the rows are stored in it; centres are places in the stored rows."""
        tree = cls.__new__(cls)
        for c, x in zip(cls.FIELDS, np.frombuffer(nodes, np.int32).reshape(len(cls.FIELDS), -1)):
            setattr(tree, c, x)
        tree.radius = np.frombuffer(radius, np.float64)
        return tree


class Best:
    """The best ``k`` (score, least id) entries of each query."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: slice) -> int:
        return int(self.score[rows, -1].min())

    def offer(self, rows: slice, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        """Scores of the query rows with entries that have ``ids`` (ascending)."""
        least = self.score[rows, -1]
        if scores.shape[1] > self.k:  # what is below the kth of these alone cannot enter
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        q, e = np.nonzero(scores >= least[:, None])
        many = np.array([len(x) for x in ids], np.int64)
        times = many[e]
        at = np.repeat(np.cumsum(many)[e] - many[e] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        n, k = self.score[rows].shape
        who = np.concatenate([np.repeat(np.arange(n), k), np.repeat(q, times)])
        s = np.concatenate([self.score[rows].ravel(), np.repeat(scores[q, e], times)])
        i = np.concatenate([self.id[rows].ravel(), np.concatenate(ids)[at]])
        order = np.lexsort((i, ~s, who))  # ~s cannot overflow
        who = who[order]
        top = order[np.arange(len(who)) - np.searchsorted(who, who) < k].reshape(n, k)
        self.score[rows], self.id[rows] = s[top], i[top]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as long."""
    most = int(np.abs(a, dtype=np.float64).max(initial=0)) * int(np.abs(b, dtype=np.float64).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(np.int64) @ b.astype(np.int64).T  # modulo 2**64
    if most >= 1 << 62:
        # the sum is right wherever the score fits into 64 bits; where that is not sure it is taken again without a limit
        near = a.astype(np.float64) @ b.astype(np.float64).T
        size = np.abs(a.astype(np.float64)) @ np.abs(b.astype(np.float64)).T
        for i, j in zip(*np.nonzero(np.abs(near) + 1e-9 * size >= float(1 << 62))):
            exact[i, j] = min(max(sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist())), -MOST), MOST)
    return exact


def dual_search(queries: np.ndarray, q_tree: CoverTree, data: np.ndarray, d_tree: CoverTree, ids: list[np.ndarray], best: Best, floor: int) -> None:
    """Fill ``best``; pairs of nodes that cannot reach their group's worst kth score (or ``floor``) are pruned.

    The rows lie in the order of their trees; ``ids`` has those of each data row.
    """
    if not len(queries) or not len(data):
        return
    q_centres, d_centres = queries[q_tree.centre].astype(np.float64), data[d_tree.centre].astype(np.float64)
    q_norms, d_norms = np.sqrt((q_centres**2).sum(axis=1)), np.sqrt((d_centres**2).sum(axis=1))

    def bounds(q: int, r: np.ndarray) -> np.ndarray:
        up = d_centres[r] @ q_centres[q] + q_norms[q] * d_tree.radius[r] + d_norms[r] * q_tree.radius[q] + q_tree.radius[q] * d_tree.radius[r]
        # room for rounding, of the sum and of its terms
        return up + 1e-6 * np.abs(up) + 1e-12 * (q_norms[q] + q_tree.radius[q]) * (d_norms[r] + d_tree.radius[r]) + 1e-6

    heap: list[tuple] = [(-float(bounds(0, np.array([0]))[0]), 0, 0)]
    while heap:
        up, q, r = heapq.heappop(heap)
        rows = slice(int(q_tree.start[q]), int(q_tree.end[q]))
        if -up < max(best.worst(rows), floor):
            continue
        if not q_tree.count[q] and not d_tree.count[r]:
            lo, hi = int(d_tree.start[r]), int(d_tree.end[r])
            best.offer(rows, inner(queries[rows], data[lo:hi]), ids[lo:hi])
            continue
        split_q = q_tree.count[q] and (not d_tree.count[r] or q_tree.radius[q] >= d_tree.radius[r])
        to = np.array([r]) if split_q else d_tree.first[r] + np.arange(d_tree.count[r])
        for a in range(q_tree.first[q], q_tree.first[q] + q_tree.count[q]) if split_q else [q]:
            need = max(best.worst(slice(int(q_tree.start[a]), int(q_tree.end[a]))), floor)
            for c, u in zip(to.tolist(), bounds(a, to).tolist()):
                if u >= need:
                    heapq.heappush(heap, (-u, a, c))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``vector, ids``: each distinct vector with its ``keep`` smallest ids (limited before the shuffle); repeated rows count once."""
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.where(F.col("id").isNotNull()).withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= keep)
    return few.groupBy("vector").agg(F.slice(F.sort_array(F.collect_set("id")), 1, keep).alias("ids"))


def fit_pivots(vectors: DataFrame, rows_in_block: int, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """Pivots in farthest-first order for each vector length, one a block, from at most ``sample`` vectors."""
    rows = least_hashes(vectors.select("vector", F.xxhash64("vector").alias("h")), "h", sample)
    got = [np.array(r["vector"], np.int64) for r in rows.select("vector").collect()]
    counts = {r["n"]: r["k"] for r in vectors.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("k")).collect()}
    out = {}
    for size in sorted({len(v) for v in got}):
        m = np.array([v for v in got if len(v) == size], np.float64)
        chosen, near = [0], np.full(len(m), np.inf)
        while len(chosen) < -(-counts.get(size, 1) // rows_in_block):
            d = m - m[chosen[-1]]
            near = np.minimum(near, (d**2).sum(axis=1))
            if near.max() == 0:
                break
            chosen.append(int(np.argmax(near)))
        out[size] = m[chosen]
    return out


BLOCKS = "block string, grp string, size int, n int, centre array<double>, radius double, pivot array<double>, reach double, nodes binary, radii binary, kind string, vectors binary, counts binary, ids binary"


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of the lists of one length."""
    at = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == size)
    return at, np.array(column.take(pa.array(at)).flatten(), np.int64).reshape(len(at), size)


def blocks(vectors: DataFrame, pivots: dict[int, np.ndarray], rows_in_block: int) -> DataFrame:
    """Vectors packed into blocks of about ``rows_in_block`` around their pivots, each with its tree, centre and covering radius.

    ``grp`` is the nearest of the first pivots (the square root of their
    number), ``reach`` the radius around that pivot.
    """
    coarse = {}
    for size, p in pivots.items():
        head = p[: max(1, int(np.ceil(np.sqrt(len(p)))))]
        coarse[size] = np.argmin(((p[:, None, :] - head[None]) ** 2).sum(axis=2), axis=1) if len(p) * len(head) * size < 1 << 24 else np.array([int(np.argmin(((head - x) ** 2).sum(axis=1))) for x in p])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("vector")
            for size in np.unique(own.value_lengths().to_numpy(zero_copy_only=False)).tolist():
                at, m = _matrix(own, size)
                p = pivots.get(size, np.zeros((1, size)))
                near = np.concatenate([np.argmin((p**2).sum(axis=1) - 2 * (x @ p.T), axis=1) for x in np.array_split(m.astype(np.float64), -(-len(m) // 1024))])
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([own.take(take), b.column("ids").take(take), pa.array([size] * len(at), pa.int32()), pa.array(near, pa.int32())], ["vector", "ids", "size", "pivot"])

    dealt = stored(vectors.mapInArrow(assign, "vector array<bigint>, ids array<bigint>, size int, pivot int"))
    fit = F.least(F.lit(rows_in_block), F.greatest(F.lit(LEAF), F.floor(F.lit(BLOCK_BYTES / 8) / F.greatest("size", F.lit(1)))))
    parts = dealt.groupBy("size", "pivot").agg(F.ceil(F.count("*") / fit).cast("long").alias("_parts"))
    placed = dealt.join(parts, ["size", "pivot"]).select("size", "pivot", F.pmod(F.xxhash64("vector"), "_parts").alias("part"), "vector", "ids")

    def one(size: int, pivot: int, part: int, rows: list[tuple]) -> pa.RecordBatch:
        m = np.array([r[0] for r in rows], np.int64).reshape(len(rows), size)
        tree = CoverTree(m)
        place = np.empty(len(m), np.int32)
        place[tree.order] = np.arange(len(m))
        tree.centre = place[tree.centre]
        m = m[tree.order]
        ids = [np.array(rows[i][1], np.int64) for i in tree.order.tolist()]
        kind = next(t for t in ("int16", "int32", "int64") if t == "int64" or not m.size or (np.abs(m.astype(np.float64)).max() < np.iinfo(t).max))
        grp = int(coarse[size][pivot]) if size in coarse else 0
        around = pivots[size][grp] if size in pivots else np.zeros(size)
        reach = float(np.sqrt(((m - around) ** 2).sum(axis=1).max())) if m.size else 0.0
        centre = m[tree.centre[0]].astype(float)
        nodes, radii = tree.packed()
        row = [f"{size}.{pivot}.{part}", f"{size}.{grp}", size, len(m), centre.tolist(), float(tree.radius[0]), around.tolist(), reach, nodes, radii, kind, m.astype(kind).tobytes(), np.array([len(x) for x in ids], np.int32).tobytes(), np.concatenate(ids).tobytes()]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for *own, v, ids in zip(*(b.column(c).to_pylist() for c in ("size", "pivot", "part", "vector", "ids"))):
                if own != key and held:
                    yield one(*key, held)
                    held = []
                key = own
                held.append((v, ids))
        if held:
            yield one(*key, held)

    return placed.repartition("size", "pivot", "part").sortWithinPartitions("size", "pivot", "part", "vector").mapInArrow(pack, BLOCKS)


def _unpack(r: dict, side: str = "") -> tuple[np.ndarray, CoverTree, list[np.ndarray]]:
    n = np.frombuffer(r[side + "counts"], np.int32)
    m = np.frombuffer(r[side + "vectors"], r[side + "kind"]).reshape(len(n), r["size"])
    return m, CoverTree.unpacked(r[side + "nodes"], r[side + "radii"]), np.split(np.frombuffer(r[side + "ids"], np.int64), np.cumsum(n)[:-1])


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """``q_block, q_row, id, score``: each query's best within each pair of blocks (query columns start with ``q_``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None,)
        for b in batches:
            for j in range(b.num_rows):
                r = b.slice(j, 1).to_pylist()[0]
                if held[0] != r["block"]:
                    held = (r["block"], *_unpack(r))
                q, q_tree, _ = _unpack(r, "q_")
                best = Best(len(q), k)
                dual_search(q, q_tree, held[1], held[2], held[3], best, r["floor"])
                row, at = np.nonzero(best.id != np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]] * len(row), pa.string()), pa.array(row.astype(np.int32)), pa.array(best.id[row, at]), pa.array(best.score[row, at])], ["q_block", "q_row", "id", "score"])

    return pairs.mapInArrow(run, "q_block string, q_row int, id long, score long")


def _bound(q: str, q_radius: str, r: str, r_radius: str) -> Column:
    """Upper bound of the inner products between two balls, from columns."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    up = dot(r, q) + norm(q) * F.col(r_radius) + norm(r) * F.col(q_radius) + F.col(q_radius) * F.col(r_radius)
    return up + F.abs(up) * 1e-6 + (norm(q) + F.col(q_radius)) * (norm(r) + F.col(r_radius)) * 1e-12 + 1e-6


def search(rows: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``rows`` has ``id`` and ``vector`` (integers), queries are its rows with ``is_query``."""
    good = rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())).select("id", "vector")
    data = stored(distinct_vectors(good, k + 1))
    asked = good.where(is_query & F.col("id").isNotNull()).distinct()
    pivots = fit_pivots(data, block)
    q_vectors = stored(asked.select("vector").distinct().withColumn("ids", F.array(F.lit(0).cast("long"))))
    d_blocks, q_blocks = stored(blocks(data, pivots, block)), stored(blocks(q_vectors, pivots, query_block))
    narrow = d_blocks.select("block", "grp", "size", "centre", "radius")
    asking = q_blocks.select(F.col("block").alias("q_block"), F.col("grp").alias("q_grp"), F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"))
    groups = stored(d_blocks.groupBy("grp", "size").agg(F.first("pivot").alias("g_centre"), F.max("reach").alias("g_radius")))
    q_groups = q_blocks.groupBy(F.col("grp").alias("q_grp"), "size").agg(F.first("pivot").alias("qg_centre"), F.max("reach").alias("qg_radius"))
    payload = ["nodes", "radii", "kind", "vectors", "counts", "ids"]
    q_side = q_blocks.select(F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in payload))
    d_side = d_blocks.select("block", *payload)
    # the groups are few (the square root of the blocks): all pairs of one vector length are bounded
    met = stored(q_groups.join(groups, "size").withColumn("g_up", _bound("qg_centre", "qg_radius", "g_centre", "g_radius")))

    def moved(pairs: DataFrame) -> DataFrame:
        return pairs.join(q_side, "q_block").join(d_side, "block")

    # each query block's best group by its own bound, and the best block in it
    low = F.lit(NONE).cast("long")
    to_groups = asking.join(met.select("q_grp", "grp", "size", "g_centre", "g_radius", "g_up"), "q_grp").withColumn("b_up", _bound("q_centre", "q_radius", "g_centre", "g_radius"))
    by_bound = Window.partitionBy("q_block").orderBy(F.desc("b_up"), "grp")
    best_group = to_groups.withColumn("_r", F.row_number().over(by_bound)).where("_r = 1").select("q_block", "q_centre", "q_radius", "grp")
    in_group = best_group.join(narrow, "grp").withColumn("up", _bound("q_centre", "q_radius", "centre", "radius"))
    best_first = Window.partitionBy("q_block").orderBy(F.desc("up"), "block")
    first = stored(in_group.withColumn("_r", F.row_number().over(best_first)).where("_r = 1").select("q_block", "block", "size", low.alias("floor")))
    found = stored(_search(moved(first), k + 1))
    # the worst kth score of each query block, once all its queries have k + 1 entries, and of each group
    full = found.groupBy("q_block", "q_row").agg(F.count("*").alias("_n"), F.min("score").alias("worst")).groupBy("q_block").agg(F.min("_n").alias("_n"), F.min("worst").alias("worst"))
    floors = stored(asking.join(full, "q_block", "left").withColumn("floor", F.when(F.col("_n") > k, F.col("worst")).otherwise(low)).select("q_block", "q_grp", "q_centre", "q_radius", "floor"))
    group_floors = floors.groupBy("q_grp").agg(F.min("floor").alias("g_floor"))
    open_groups = met.join(group_floors, "q_grp").where(F.col("g_up") >= F.col("g_floor")).select("q_grp", "grp", "size", "g_centre", "g_radius")
    open_halves = floors.join(open_groups, "q_grp").where(_bound("q_centre", "q_radius", "g_centre", "g_radius") >= F.col("floor")).select("q_block", "q_centre", "q_radius", "floor", "grp")
    open_pairs = open_halves.join(narrow, "grp").where(_bound("q_centre", "q_radius", "centre", "radius") >= F.col("floor")).select("q_block", "block", "size", "floor")
    rest = open_pairs.join(first.select("q_block", "block"), ["q_block", "block"], "left_anti")
    every = found.unionByName(_search(moved(rest), k + 1))
    top = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "id")
    lists = every.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1).groupBy("q_block", "q_row").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("found"))

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = np.frombuffer(r["vectors"], r["kind"]).reshape(r["n"], r["size"]).astype(np.int64)
                at = pa.array(np.arange(len(m) + 1) * r["size"], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(m), pa.string()), pa.array(np.arange(len(m), dtype=np.int32)), pa.ListArray.from_arrays(at, pa.array(m.ravel()))], ["q_block", "q_row", "vector"])

    # back from the block's rows to the query vectors and their ids
    named = q_blocks.select("block", "size", "n", "kind", "vectors").mapInArrow(vectors_of, "q_block string, q_row int, vector array<bigint>").join(lists, ["q_block", "q_row"])
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    return asked.join(named, "vector").select(F.col("id").alias("query_id"), F.posexplode(others).alias("_p", "_x")).select(
        "query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.id").alias("vec_id"), (-F.col("_x.s")).alias("score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector"))
    return search(rows, F.col("id") % EVERY == 0)


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
