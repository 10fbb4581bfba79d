"""Rows carried whole, bounded samples, and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodia.sources.scratch import drop, folder, stored

__all__ = ["drop", "folded", "folder", "least_hashes", "named", "stored", "unfolded"]


def named(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of an Arrow batch of texts; the usual 10,000 take some hundred MB of a worker where texts are long.
BATCH_ROWS = 2000


def folded(docs: DataFrame, *apart: str) -> DataFrame:
    """``docs`` with all its columns but ``apart`` in one struct ``row``, where no name can clash; ``apart`` follow as ``a0, a1, ...``."""
    few = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(docs.sparkSession.conf.get(few)) > BATCH_ROWS:
        docs.sparkSession.conf.set(few, str(BATCH_ROWS))
    rest = [c for c in docs.columns if c not in apart]
    row = F.struct(F.lit(True).alias("_"), *(named(c).alias(f"c{i}") for i, c in enumerate(rest)))
    return docs.select(row.alias("row"), *(named(c).alias(f"a{i}") for i, c in enumerate(apart)))


def unfolded(rows: DataFrame, columns: list[str], apart: dict[str, str], results: dict[str, Column] | None = None) -> DataFrame:
    """The columns of the ``docs`` that ``folded`` took, in their order, and ``results``.

    ``apart`` names the columns that stand beside the struct.  A result replaces
    a column of its name.
    """
    results = results or {}
    rest = [c for c in columns if c not in apart]
    place = {c: F.col("row").getField(f"c{i}") for i, c in enumerate(rest)} | {c: F.col(k) for c, k in apart.items()}
    return rows.select(*(place[c].alias(c) for c in columns if c not in results), *(v.alias(k) for k, v in results.items()))


def least_hashes(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """The ``limit`` rows of the least 64-bit hashes in ``column`` (ties by the other columns).

    Rows are counted first, and only about that many go to the sort, whatever
    the number of partitions.
    """
    n = rows.count()
    if n > 2 * limit:
        share = (limit + 6 * limit**0.5 + 100) / n  # less than one in a billion tables has fewer rows below it
        rows = rows.where(F.col(column) < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.orderBy(column, *(c for c in rows.columns if c != column)).limit(limit)
