"""Exact vector retrieval with leave-one-episode-out filters, and vector diagnostics.

Queries meet rows in blocks: a pair of blocks is a matrix product, and only each
query's best rows or sums leave it.  Where only rows of the query's task count,
blocks are dealt within the tasks and meet in an equi-join on the task, so that
no block is sent to another task's; otherwise every query block meets every
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from episodia.sources.scratch import stored

BLOCK = 4096
DIGITS = 6  # of scores
SIDE = 16  # blocks of a task (or the table), where they have neither BLOCK rows nor LARGEST
LARGEST = 32768
STRIP = 1 << 21  # scores at a time
SLABS = 256  # groups of rows whose best scores bound a query's kth best
QUICK = 1e-3  # vectors so long that single precision says less are scored in double precision
FEW = 1 << 22  # values of a strip's likely pairs, which are scored one by one
WORK = 1 << 25  # scores in a task, if it has more than one pair of blocks
FEW_TASKS = 1 << 18  # rows of 40 bytes that may be sent to all
ROW = 1 << 10  # what reading a row counts, in scores


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column, eps: float = 1e-12) -> Column:
    """x / max(|x|, eps): a zero vector stays zero."""
    # the norm is an element, so that it is taken once a vector and not once an entry
    return F.transform(F.array(F.greatest(norm(a), F.lit(eps))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def softmax_mean(top: DataFrame, value: str, temperature: float) -> DataFrame:
    """Softmax-weighted mean of the retrieved values, per query and dimension."""
    w = Window.partitionBy("q_id")
    weight = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    own = top.withColumn("_w", weight).withColumn("_w", F.col("_w") / F.sum("_w").over(w))
    return own.select("q_id", "_w", F.posexplode(value).alias("dim", "x")).groupBy("q_id", "dim").agg(F.sum(F.col("_w") * F.col("x")).alias("value"))


def prototypes(bank: DataFrame, *keys: str) -> DataFrame:
    """Mean vector of each group, dimension by dimension."""
    return bank.select(*keys, F.posexplode("vector").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"), F.count("*").alias("n"))


def adaptive_pool(a: Column, size: int, out: int) -> Column:
    """Averages of the slices [floor(i L / L'), ceil((i + 1) L / L'))."""
    def one(i: int) -> Column:
        lo, hi = i * size // out, -(-(i + 1) * size // out)
        return F.aggregate(F.slice(a, lo + 1, hi - lo), F.lit(0.0), lambda s, x: s + x.cast("double")) / (hi - lo)

    return F.array(*[one(i) for i in range(out)])


def progression(points: DataFrame) -> DataFrame:
    """Movement of each episode's vectors along its direction from first to last (three points at least)."""
    w = Window.partitionBy("episode").orderBy("id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sub = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    steps = points.select("episode", "id", "unit", F.first("unit").over(whole).alias("_a"), F.last("unit").over(whole).alias("_b"), F.lead("unit").over(w).alias("_n"), F.count("*").over(Window.partitionBy("episode")).alias("n")).where("n >= 3 and _n is not null")
    move = dot(sub(F.col("_n"), F.col("unit")), l2_normalise(sub(F.col("_b"), F.col("_a"))))
    moved = steps.withColumn("_m", F.round(move, 9))
    return moved.groupBy("episode").agg(F.max("n").alias("n"), F.avg(F.abs("_m")).alias("mean_abs"), F.avg((F.col("_m") > 0).cast("double")).alias("positive"), F.avg((F.col("_m") >= 0.01).cast("double")).alias("clear"))


def _blocks(rows: DataFrame, block: int, by_task: bool = False) -> DataFrame:
    """Rows with a unit vector in one row a block: ``_t`` (its task, or 0), its number ``_b`` among the ``_n`` of the task (or the table).

    A block has about ``block`` rows; of many rows there are about ``SIDE``
    blocks, until they reach ``LARGEST``.
    """
    rows = stored(rows.select(F.col("id").cast("long").alias("id"), F.col("task").cast("long").alias("task"), F.col("episode").cast("long").alias("episode"), "unit"))
    rows = rows.withColumn("_t", F.col("task") if by_task else F.lit(0).cast("long"))
    size = F.greatest(F.lit(block), F.least(F.lit(LARGEST), F.ceil(F.count("*") / SIDE)))
    counts = rows.groupBy("_t").agg(F.ceil(F.count("*") / size).alias("_n"))  # one row a task
    own = F.pmod(F.xxhash64("id", "task", "episode", F.monotonically_increasing_id()), "_n")
    return stored(rows.join(counts, "_t").groupBy("_t", "_n", own.alias("_b")).agg(F.collect_list(F.struct("id", "task", "episode", "unit")).alias("rows"), F.count("*").alias("_c")))


def _matrix(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r = rows.values
    unit = r.field("unit")
    return *(r.field(c).to_numpy(zero_copy_only=False) for c in ("id", "task", "episode")), unit.flatten().to_numpy(zero_copy_only=False).reshape(len(r), -1)


def _met(queries: DataFrame, bank: DataFrame, per_pair, schema: str, block: int, by_task: bool) -> DataFrame:
    """``per_pair(query side, bank side)`` of every pair of blocks (of one task, with ``by_task``); a side is ids, tasks, episodes and unit vectors, the bank's ids ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_rows, rows in zip(b.column("q_rows"), b.column("rows")):
                held = _matrix(rows)
                order = np.argsort(held[0], kind="stable")
                for found in per_pair(_matrix(q_rows), tuple(x[order] for x in held)):
                    yield pa.RecordBatch.from_pydict(found)

    held = _blocks(bank, block, by_task)
    asked = held if queries is bank else _blocks(queries, block, by_task)
    # a stated query set meets all rows (of its task), block by block: each pair of blocks is a key of its own, and
    # the parts grow in number with the pairs, so that a task reads a few pairs however many blocks there are
    side = lambda blocks, n, c: blocks.groupBy("_t").agg(F.max("_n").alias(n), F.sum("_c").alias(c))
    sides = side(asked, "_i", "_q_rows").join(side(held, "_j", "_rows"), "_t")  # one row a task
    work = F.col("_q_rows") * F.col("_rows") + ROW * (F.col("_q_rows") * F.col("_j") + F.col("_rows") * F.col("_i"))
    parts, n = sides.agg(F.least(F.sum(F.col("_i") * F.col("_j")), F.ceil(F.sum(work.cast("double")) / WORK)), F.count("*")).first()
    parts = parts or 1
    if n <= FEW_TASKS:  # or a task's blocks would meet its row in one place
        sides = F.broadcast(sides)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sides, "_t").select("_t", F.col("_b").alias("_q"), F.col("rows").alias("q_rows"), upto("_j").alias("_b"))
    right = held.join(sides, "_t").select("_t", upto("_i").alias("_q"), "_b", "rows")
    key = ["_t", "_q", "_b"]
    return left.repartition(parts, *key).join(right.repartition(parts, *key).hint("merge"), key).select("q_rows", "rows").mapInArrow(run, schema)


def _strips(asked: tuple, held: tuple) -> Iterator[slice]:
    strip = max(1, STRIP // len(held[0]))
    return (slice(lo, lo + strip) for lo in range(0, len(asked[0]), strip))


def _leave_out(scores: np.ndarray, asked: tuple, held: tuple, at: slice, same_task: bool | None) -> np.ndarray:
    """``scores`` with -inf for pairs of one episode (and, with ``same_task``, those not of one task or not of two)."""
    scores[asked[2][at][:, None] == held[2]] = -np.inf
    if same_task is not None:
        scores[(asked[1][at][:, None] == held[1]) != same_task] = -np.inf
    return scores


def _scores(asked: tuple, held: tuple, at: slice, digits: int, same_task: bool | None) -> np.ndarray:
    scores = asked[3][at] @ held[3].T
    np.round(scores, digits, out=scores)
    return _leave_out(scores, asked, held, at, same_task)


def block_scores(queries: DataFrame, bank: DataFrame, per_strip, schema: str, block: int = BLOCK, digits: int = DIGITS, same_task: bool | None = None) -> DataFrame:
    """``per_strip(q_ids, q_tasks, ids, tasks, scores)`` of every pair of blocks, ``ids`` ascending, ``scores`` its own to change; pairs of one episode (and, with ``same_task``, those not of one task or not of two) score -inf."""

    def pair(asked: tuple, held: tuple) -> Iterator[dict]:
        for at in _strips(asked, held):
            yield per_strip(asked[0][at], asked[1][at], held[0], held[1], _scores(asked, held, at, digits, same_task))

    return _met(queries, bank, pair, schema, block, same_task is True)


def _slack(q: np.ndarray, m: np.ndarray, digits: int) -> float:
    """How far below the kth best of single precision a row can be and still be among the ``k`` best rounded scores.

    Conversion and products in single precision are wrong by (d + 2) 2**-24 |q| |m|
    at most; two scores take part, and rounding moves each by half a unit.
    """
    size = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
    return 1.01 * (2 * (q.shape[1] + 2) * 2.0**-24 * size(q) * size(m) + 10.0**-digits)


def _likely(rough: np.ndarray, k: int, slack: float, few: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows and columns of all scores that may be among their row's ``k`` best, or None if these are more than ``few``.

    The kth best of the slabs' maxima is no more than the kth best of all.
    """
    wide = rough.shape[1] // SLABS
    best = rough[:, : SLABS * wide].reshape(len(rough), wide, SLABS).max(axis=1)
    least = np.nextafter((np.partition(best, SLABS - k, axis=1)[:, SLABS - k].astype(np.float64) - slack).astype(np.float32), np.float32(-np.inf))
    hit = rough >= np.maximum(least, np.finfo(np.float32).min)[:, None]  # -inf takes no part
    return np.divmod(np.flatnonzero(hit), rough.shape[1]) if np.count_nonzero(hit) <= few else None


def block_top_k(queries: DataFrame, bank: DataFrame, k: int, block: int = BLOCK, same_task: bool | None = None) -> DataFrame:
    """The ``k`` best of each query over all tasks, its own (``same_task``) or the others; ties by id.

    Products in single precision leave out the rows that cannot be among the
    best; the rest are scored in double precision, strip by strip where they
    are many.
    """

    def best(asked: tuple, held: tuple) -> Iterator[dict]:
        (q_id, q_task, _, q), (id_, task, _, m) = asked, held
        slack = _slack(q, m, DIGITS) if len(id_) >= 4 * SLABS and k <= SLABS // 4 else np.inf
        quick = slack < QUICK  # neither is true of NaN
        if quick:
            q_short, m_short = q.astype(np.float32), m.astype(np.float32)
        for at in _strips(asked, held):
            found = _likely(_leave_out(q_short[at] @ m_short.T, asked, held, at, same_task), k, slack, FEW // m.shape[1]) if quick else None
            if found is not None:
                row, col = found
                s = np.round(np.einsum("ij,ij->i", q[at][row], m[col]), DIGITS)
            else:
                scores = _scores(asked, held, at, DIGITS, same_task)
                # everything that ties with the kth score takes part before ties go to the smaller id
                if k < scores.shape[1]:
                    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                else:
                    kth = np.full(len(scores), -np.inf)
                row, col = np.nonzero((scores >= kth[:, None]) & (scores > -np.inf))
                s = scores[row, col]
            by = np.lexsort((col, -s, row))
            row, col, s = row[by], col[by], s[by]
            first = np.searchsorted(row, np.arange(len(q_id[at])))
            keep = np.arange(len(row)) - first[row] < k
            row, col, s = row[keep], col[keep], s[keep]
            yield {"q_id": q_id[at][row], "q_task": q_task[at][row], "id": id_[col], "task": task[col], "score": s}

    found = _met(queries, bank, best, "q_id long, q_task long, id long, task long, score double", block, same_task is True)
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contrastive(queries: DataFrame, bank: DataFrame, temperature: float = 0.1, block: int = BLOCK) -> DataFrame:
    """``q_id, log_prob``: mean log softmax of the rows of the query's own task among all rows of other episodes."""

    def sums(q_id, q_task, id_, task, scores):
        m = scores.max(axis=1)
        some = np.isfinite(m)
        low = np.where(some, m, 0.0)
        same = q_task[:, None] == task
        same &= scores > -np.inf
        own = np.where(same, scores, 0.0).sum(axis=1) / temperature
        scores -= low[:, None]
        scores /= temperature
        e = np.exp(scores, out=scores).sum(axis=1)
        return {"q_id": q_id, "m": low / temperature, "e": e, "own": own, "n": np.count_nonzero(same, axis=1), "any": some}

    part = stored(block_scores(queries, bank, sums, "q_id long, m double, e double, own double, n long, any boolean", block).where("any"))
    top = part.groupBy("q_id").agg(F.max("m").alias("top"))
    g = part.join(top, "q_id").groupBy("q_id").agg(F.max("top").alias("top"), F.sum(F.col("e") * F.exp(F.col("m") - F.col("top"))).alias("e"), F.sum("own").alias("own"), F.sum("n").alias("n"))
    return g.where("n > 0").select("q_id", (F.col("own") / F.col("n") - F.col("top") - F.log("e")).alias("log_prob"))


def pair_means(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """``same_task, mean, pairs`` of the scores of all pairs of different episodes, from sums of unit vectors: no pairs are made."""
    keys = {"te": ["task", "episode"], "t": ["task"], "e": ["episode"], "a": []}

    def sums(rows: DataFrame, by: list[str], s: str) -> tuple[DataFrame, DataFrame]:
        x = rows.select(*by, F.posexplode("unit").alias("dim", "x")).groupBy(*by, "dim").agg(F.sum("x").alias(f"{s}x"))
        return x, rows.groupBy(*by).agg(F.count("*").alias(f"{s}n"))

    def both(by: list[str], name: str) -> DataFrame:
        (qx, qn), (bx, bn) = sums(queries, by, "q"), sums(bank, by, "b")
        dot_ = qx.join(bx, [*by, "dim"]).agg(F.coalesce(F.sum(F.col("qx") * F.col("bx")), F.lit(0.0)).alias(f"{name}_dot"))
        n = (qn.join(bn, by) if by else qn.crossJoin(bn)).agg(F.coalesce(F.sum(F.col("qn") * F.col("bn")), F.lit(0)).alias(f"{name}_n"))
        return dot_.crossJoin(n)

    one = None
    for name, by in keys.items():
        one = both(by, name) if one is None else one.crossJoin(both(by, name))
    diff = lambda c, s: F.col(f"t_{c}") - F.col(f"te_{c}") if s else F.col(f"a_{c}") - F.col(f"t_{c}") - F.col(f"e_{c}") + F.col(f"te_{c}")
    rows = F.array(*[F.struct(F.lit(s).alias("same_task"), diff("dot", s).alias("dot"), diff("n", s).alias("pairs")) for s in (True, False)])
    return one.select(F.inline(rows)).select("same_task", F.when(F.col("pairs") > 0, F.col("dot") / F.col("pairs")).alias("mean"), "pairs")
