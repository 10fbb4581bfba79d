"""A Merkle manifest of a table: leaf digests, roots, and a proof for every row.

A row's leaf is the SHA-256 of its fields, each with its length before it.  The
leaves of a language ascend by ``doc_id``, and pairs of consecutive nodes become
one node until one is left: the language's subroot.  The subroots, by language,
make the root in the same way.

Leaves are dealt to aligned blocks of ``2 ** LEVELS`` places.  A block is one
Arrow table, in which DuckDB runs the levels (``string_agg`` in the order of
places, then ``sha256``) and gives each leaf its siblings; the block's node is a
leaf of the tree above, which is cut in blocks again.  Spark joins the siblings
of the trees above to those inside.  So no task sees more than a block, and only
the number of levels reaches the driver.

Places are given by ranges of (language, id, leaf) and offsets of the ranges, so
no task sorts a whole language.

Defined cases: a null field is ``-``; a null language is a group of its own, the
first; null ids come first, repeated ids ascend by leaf; equal rows are leaves of
their own with different proofs; a row of a lone leaf has no siblings below the
subroot, and the digest of an empty proof is that of the empty string; an empty
table gives an empty result.  A null id is not tampered with.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from episodia.llm.shared import stored

LEVELS = 12
STEPS = "array<struct<before:string,after:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(*values: Column) -> Column:
    """The fields of a leaf: ``-`` for null, else the number of bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, grp, leaf``, and ``changed``: the leaf of a row whose ``n_chars`` someone raised by one (null for rows left alone)."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    hit = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 0
    group = F.coalesce(F.concat(F.lit("="), lang), F.lit(""))  # the null language sorts first
    return docs.select(
        doc_id, lang, group.alias("grp"), F.sha2(framed(doc_id, source, lang, n_chars, text), 256).alias("leaf"),
        F.when(hit & n_chars.isNotNull(), F.sha2(framed(doc_id, source, lang, n_chars + 1, text), 256)).alias("changed"),
    )


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with their ``place`` (from 0) in their group's order and ``n``, the group's rows; equal rows take any order among them."""
    apart = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = stored(apart.repartitionByRange(F.col(group), *order, F.col("_row")).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy(group))}).drop("_n")
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, "_row")) - 1 + F.col("_before")
    return ranged.join(counts, [group, "_range"]).withColumn("place", place.cast("long")).drop("_range", "_before", "_row")


@lru_cache(maxsize=1)
def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})


def _levels_sql(levels: int) -> str:
    """Nodes of every level of a block, and each leaf's sibling at every level (empty strings where it has none)."""
    nodes = ["n0 AS MATERIALIZED (SELECT place, leaf AS digest FROM block)"]
    nodes += [f"n{k} AS MATERIALIZED (SELECT place >> 1 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM n{k - 1} GROUP BY 1)" for k in range(1, levels + 1)]
    steps = ", ".join(f"{{'before': CASE WHEN (b.place >> {k}) & 1 = 1 THEN coalesce(s{k}.digest, '') ELSE '' END, 'after': CASE WHEN (b.place >> {k}) & 1 = 0 THEN coalesce(s{k}.digest, '') ELSE '' END}}" for k in range(levels))
    siblings = " ".join(f"LEFT JOIN n{k} s{k} ON s{k}.place = xor(b.place >> {k}, 1)" for k in range(levels))
    list_ = f"[{steps}]" if levels else "[]::STRUCT(\"before\" VARCHAR, \"after\" VARCHAR)[]"
    return f"WITH {', '.join(nodes)} SELECT b.* EXCLUDE (n), {list_} AS steps, (SELECT digest FROM n{levels}) AS node FROM block b {siblings}"


def _block(schema: pa.Schema):
    def run(block: pa.Table) -> pa.Table:
        # a smaller tree ends below the block's height: it has one node by then
        levels = min(LEVELS, (block["n"][0].as_py() - 1).bit_length())
        engine = _engine()
        engine.register("block", block)
        out = engine.sql(_levels_sql(levels)).to_arrow_table()
        engine.unregister("block")
        return out.select(schema.names).cast(schema)

    return run


_ARROW = {"string": pa.string(), "bigint": pa.int64()}


def tree(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``grp, place, n, leaf``) and each one's ``steps`` up to its group's ``top``.

    A step holds the siblings before and after the node on the way up, as they
    stand in the digest's input.
    """
    kept = [c for c in rows.columns if c != "n"]
    schema = pa.schema([*((c, _ARROW[rows.schema[c].dataType.simpleString()]) for c in kept), ("steps", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))), ("node", pa.string())])
    ddl = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + f", steps {STEPS}, node string"
    block = F.shiftright("place", LEVELS)
    inside = rows.groupBy("grp", block.alias("_block")).applyInArrow(_block(schema), ddl)
    most = rows.agg(F.max("n")).first()[0] or 0
    if most <= 1 << LEVELS:
        return inside.withColumnRenamed("node", "top")
    inside = stored(inside)
    sizes = rows.groupBy("grp").agg(F.max("n").alias("_n"))
    above = inside.where(F.col("place") % F.lit(1 << LEVELS) == 0).join(sizes, "grp").select("grp", F.shiftright("place", LEVELS).alias("place"), F.col("node").alias("leaf"), F.shiftright(F.col("_n") + F.lit((1 << LEVELS) - 1), LEVELS).alias("n"))
    outer = tree(stored(above)).select(F.col("grp").alias("_g"), F.col("place").alias("_b"), F.col("steps").alias("_outer"), "top")
    both = inside.join(outer, (F.col("grp") == F.col("_g")) & (block == F.col("_b")))
    return both.withColumn("steps", F.concat("steps", "_outer")).drop("_g", "_b", "_outer", "node")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, place, leaf, changed, subroot, root, steps`` for every row."""
    rows = placed(stored(leaves(docs)), "grp", F.asc_nulls_first("doc_id"), F.asc("leaf"))
    own = stored(tree(stored(rows)))
    tops = stored(own.where("place = 0").select("grp", F.col("top").alias("leaf")))
    langs = placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "leaf"), "grp", F.asc("name"))
    upper = stored(tree(stored(langs))).select(F.col("name").alias("grp"), F.col("steps").alias("_upper"), F.col("top").alias("root"))
    return own.join(upper, "grp").withColumn("steps", F.concat("steps", "_upper")).select("doc_id", "lang", "place", "leaf", "changed", F.col("top").alias("subroot"), "root", "steps")


def verify(rows: DataFrame) -> DataFrame:
    """``rows`` of a manifest with the digest of each proof, the root recomputed from the row as it is now, and whether it is the manifest's."""
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    now = folded(F.coalesce("changed", "leaf"), F.col("steps"))
    return rows.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": now}).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verify(manifest(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _sql_tree(name: str, rows: str) -> str:
    """Recursive levels of trees: ``grp, level, nodes``."""
    pair = "sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))"
    return f"""{name}(grp, level, nodes) AS ({rows} UNION ALL
  SELECT grp, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: {pair}) FROM {name} WHERE len(nodes) > 1)"""


_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {_BIT})), 4294967295)"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("n_chars + 1")} AS other, {_CRC} % 7 = 0 AND n_chars IS NOT NULL AS hit FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
{_sql_tree("low", "SELECT grp, 0, list(leaf ORDER BY place) FROM r GROUP BY grp")},
sub AS (SELECT grp, nodes[1] AS subroot, row_number() OVER (ORDER BY grp) - 1 AS spot FROM low WHERE len(nodes) = 1),
{_sql_tree("high", "SELECT 0, 0, list(subroot ORDER BY spot) FROM sub")},
top AS (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1),
s AS (SELECT r.doc_id, r.leaf, r.place, r.grp, 0 AS part, low.level, (r.place >> low.level) & 1 AS side, low.nodes[xor(r.place >> low.level, 1) + 1] AS digest FROM r JOIN low ON low.grp = r.grp AND len(low.nodes) > 1
  UNION ALL SELECT r.doc_id, r.leaf, r.place, r.grp, 1, high.level, (sub.spot >> high.level) & 1, high.nodes[xor(sub.spot >> high.level, 1) + 1] FROM r JOIN sub ON sub.grp = r.grp JOIN high ON len(high.nodes) > 1),
steps AS (SELECT grp, place, list({{'side': side, 'digest': coalesce(digest, '')}} ORDER BY part, level) AS steps FROM s GROUP BY ALL),
f AS (SELECT r.*, coalesce(steps, []) AS steps FROM r LEFT JOIN steps USING (grp, place)),
walk(grp, place, k, digest, steps) AS (SELECT grp, place, 0, CASE WHEN hit THEN other ELSE leaf END, steps FROM f
  UNION ALL SELECT grp, place, k + 1, sha256(CASE WHEN steps[k + 1].side = 1 THEN steps[k + 1].digest || walk.digest ELSE walk.digest || steps[k + 1].digest END), steps FROM walk WHERE k < len(steps))
SELECT f.doc_id, f.leaf, sub.subroot, top.root, sha256(array_to_string(list_transform(f.steps, lambda x: x.digest), '')) AS proof_sha256, walk.digest AS folded_root, walk.digest = top.root AS verified
FROM f JOIN sub ON sub.grp = f.grp CROSS JOIN top JOIN walk ON walk.grp = f.grp AND walk.place = f.place AND walk.k = len(f.steps)
"""
