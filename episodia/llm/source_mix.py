"""Mixing sources to target weights by pivotal dependent rounding.

A document's size is its number of words.  Targets share ``rate`` times all
sizes by the sources' weights and stop at ``cap`` times a source's own size;
the excess is shared again by weight (water filling, in window functions over
the table of sources).  A source with target t and size n asks for t / n copies
of each document: every document gets the whole part, and the fractional parts
are rounded together.  Two open documents exchange mass (size times probability)
at random, so that expectations and the source's total stay as they are, until
one of them is decided; one open document at most is left of each group.

Documents are dealt to groups of bounded size by a hash of their key, text and
number among repeated rows; a reduction tree of fixed fan-in combines what the groups leave open,
level by level, until one open document a source is left, which goes to the
nearer side.  So a source's taken words miss its target by half a document at
most.  Random numbers are hashes of (seed, key, level): reruns agree.

Defined cases: a null text has no words and is taken 0 times; sources are
ordered by code point with null last; equal rows are told apart by a number and
may get different counts; rows with a null id differ by their text; a source
without words has target 0; an empty table gives an empty result.  ``mix`` reads
``doc_id``, ``source`` and ``text`` only; ``materialise`` returns the columns of
its input whatever their names, and takes its rows from a table that does not
change between reads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from episodia.llm.shared import folded, stored, unfolded

WEIGHTS = (3.0, 1.0, 2.0)
RATE, CAP = 1.5, 2.0
GROUP, FAN_IN = 4096, 64
SEED = 20240229


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, rate: float = RATE, cap: float = CAP) -> DataFrame:
    """``source, source_size, source_docs, target`` from rows with ``source`` and ``size`` (and ``_times``, the documents that a row stands for).

    One row a source goes through the windows, whatever the number of documents.
    """
    docs = F.sum("_times") if "_times" in sizes.columns else F.count("*")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), docs.alias("source_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    # sources fill up in the order of cap * size / weight; those before the level are at their cap
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "_capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap),
        "_weights": F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)),
        "_total": F.sum("source_size").over(all_rows) * F.lit(rate),
    })
    level = (F.col("_total") - F.col("_capped")) / F.col("_weights")
    # the level of the first source that its share does not fill up holds for all after it
    open_level = F.min(F.when(level * F.col("weight") < F.col("source_size") * F.lit(cap), F.struct(F.col("_capped").alias("o"), level.alias("level")))).over(all_rows)["level"]
    share = F.coalesce(open_level * F.col("weight"), F.col("source_size") * F.lit(cap))
    return per.select("source", "source_size", "source_docs", F.least(share, F.col("source_size") * F.lit(cap)).alias("target"))


def _uniforms(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=seed & (2**64 - 1))).random(n)


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round fractional ``p`` so that sum(size * p) is kept and at most one entry stays open.

    Each step moves mass between the open entry and the next one: either way
    makes one of them 0 or 1, with odds that keep both expectations.
    """
    p = p.astype(float).copy()
    hold = -1
    for i in range(len(p)):
        if not 1e-12 < p[i] < 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if hold < 0:
            hold = i
            continue
        a, b = size[hold], size[i]
        up = min((1 - p[hold]) * a, p[i] * b)  # mass that can go to the held entry
        down = min(p[hold] * a, (1 - p[i]) * b)
        move = up if u[i] * (up + down) < down else -down
        x, y = p[hold] + move / a, p[i] - move / b
        x, y = (round(x) if abs(x - round(x)) < 1e-9 else x), (round(y) if abs(y - round(y)) < 1e-9 else y)
        p[hold], p[i] = x, y
        open_x, open_y = 0 < x < 1, 0 < y < 1
        hold = hold if open_x else i if open_y else -1
    return p


def _round_groups(df: DataFrame, level: int, seed: int) -> DataFrame:
    """Pivot within each (source, grp); ``p`` becomes 0 or 1 but for one open row a group.

    Long documents come first, so that the one left open tends to be short.
    """
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_order", "_text", "_number"], ascending=[False, True, True, True]).reset_index(drop=True)
        own = int(pdf["_order"].min()) * 31 + level * 1_000_003 + seed
        pdf["p"] = pivot(pdf["size"].to_numpy(), pdf["p"].to_numpy(), _uniforms(own, len(pdf)))
        return pdf

    return df.groupBy("_src", "_grp").applyInPandas(run, shape)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, rate: float = RATE, cap: float = CAP, seed: int = SEED, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs`` (and ``_text``, a hash of the text)."""
    counted = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text")).groupBy("doc_id", "source", "size", "_text").agg(F.count("*").alias("_times"))
    counted = stored(counted)
    per = targets(counted.select("source", (F.col("size") * F.col("_times")).alias("size"), "_times"), weights, rate, cap).withColumn("_groups", F.ceil(F.col("source_docs") / F.lit(group)).cast("long"))
    sizes = counted.withColumn("_number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    rows = sizes.join(per, sizes["source"].eqNullSafe(per["source"])).select(sizes["*"], "source_size", "target", "_groups")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_ratio": ratio, "_order": F.xxhash64(F.lit(seed), "doc_id", "size", "_text", "_number")}).select(
        "doc_id", "source", "size", "source_size", "target", F.floor("_ratio").alias("_whole"), (F.col("_ratio") - F.floor("_ratio")).alias("p"),
        "_order", F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none"),
        F.pmod("_order", "_groups").alias("_grp"), "_text", "_number", "_groups",
    ).withColumn("_src", F.concat(F.when(F.col("_none"), "0").otherwise("1"), F.col("_name"))).drop("_name", "_none")
    rounded = stored(_round_groups(rows.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0))), 0, seed))
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    done = [rounded.where(~is_open)]
    rest = rounded.where(is_open)
    groups = rounded.agg(F.max("_groups")).first()[0] or 0
    level = 1
    while groups > 1:
        rest = stored(_round_groups(rest.withColumn("_grp", F.floor(F.col("_grp") / F.lit(fan_in))), level, seed))
        done.append(rest.where(~is_open))
        rest = rest.where(is_open)
        groups = -(-groups // fan_in)
        level += 1
    done.append(rest.withColumn("p", F.when(F.col("p") >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = (F.col("_whole") + F.col("p").cast("long")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_text")


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; repeated rows share their copies evenly.

    Repeated rows are numbered within the part of the input that they are read
    from, so that a hot one is not gathered in one task.
    """
    key = ["k0", "k1", "k2", "k3"]
    sums = mix(docs, **options).groupBy(F.col("doc_id").alias("k0"), F.col("source").alias("k1"), F.col("size").alias("k2"), F.col("_text").alias("k3")).agg(F.sum("copies").alias("copies"), F.count("*").alias("times"))
    sums = stored(sums)
    rows = folded(docs, "doc_id", "source", "text").withColumns({"k2": word_count(F.col("a2")), "k3": F.xxhash64("a2"), "part": F.spark_partition_id()})

    def having(want: DataFrame) -> DataFrame:
        same = rows["a0"].eqNullSafe(want["k0"]) & rows["a1"].eqNullSafe(want["k1"]) & (rows["k2"] == want["k2"]) & (rows["k3"] == want["k3"])
        return rows.join(want, same).select(rows["*"], *(want[c] for c in want.columns if c not in key))

    once = having(sums.where("times = 1 and copies > 0")).select("row", "a0", "a1", "a2", "copies")
    many = sums.where("times > 1 and copies > 0")
    out = once
    if many.limit(1).count():
        parts = stored(having(many.select(*key)).groupBy(F.col("a0").alias("k0"), F.col("a1").alias("k1"), "k2", "k3", "part").agg(F.count("*").alias("own")))
        earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        place = parts.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
        place = place.join(many.withColumnsRenamed({c: f"m{c}" for c in key}), F.col("k0").eqNullSafe(F.col("mk0")) & F.col("k1").eqNullSafe(F.col("mk1")) & (F.col("k2") == F.col("mk2")) & (F.col("k3") == F.col("mk3"))).select(*key, F.col("part").alias("kp"), "before", "copies", "times")
        within = Window.partitionBy("a0", "a1", "k2", "k3", "part").orderBy(F.xxhash64("row"))
        numbered = having(place).where(F.col("part") == F.col("kp")).withColumn("number", F.col("before") + F.row_number().over(within))
        copies = F.floor(F.col("copies") / F.col("times")) + (F.col("number") <= F.pmod("copies", "times")).cast("long")
        out = out.unionByName(numbered.select("row", "a0", "a1", "a2", copies.cast("long").alias("copies")).where("copies > 0"))
    every = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unfolded(every, docs.columns, {"doc_id": "a0", "source": "a1", "text": "a2"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
