"""Licence scans by canonical digest.

A text is brought to a canonical form (case, punctuation, white space,
copyright lines and equivalent spellings do not matter) and its SHA-256 is
hash-joined with the digests of known licence texts.  Both the entire text and
each of its lines, taken as an entire text of its own, are looked up, so a
licence file and a document that carries a one-line notice are both found.
Everything is DataFrame functions; a line longer than any known text cannot
match and is not hashed.  Known digests are broadcast only while their measured
size is under ``BROADCAST_BYTES``: then the lines of a text meet them in the
text's own task, and the one shuffle carries a narrow row per text.  A larger
table is joined by a shuffle of the digests, whose skew adaptive execution
splits.

Defined cases: a null or empty text has the digest of the empty string and no
licence; repeated rows are judged one by one; an empty table of texts gives an
empty result, one of known texts leaves every row without a licence; further
columns pass through, but a result column replaces one of its name.  Rows are
numbered while they are read: give a table, or a plan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodia.llm.license_texts import KNOWN, further
from episodia.llm.shared import folded, unfolded

BROADCAST_BYTES = 8 << 20

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)|©|all rights reserved)[^\n]*"
NOT_WORDS = r"[ -/:-@\[-`{-~\t\r\x0B\f]+"
#: Spelling, canonical spelling; both are applied inside words, in this order.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("favour", "favor"), ("honour", "honor"),
    ("fulfill", "fulfil"), ("per cent", "percent"), ("noncommercial", "non commercial"), ("copyright owner", "copyright holder"),
]


def canonical_lines(text: Column) -> Column:
    """The non-empty lines of a text in canonical form."""
    t = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "$1")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), NOT_WORDS, " ")
    for other, one in SPELLINGS:
        t = F.replace(t, F.lit(other), F.lit(one))
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    lines = canonical_lines(F.col("known"))
    texts = spark.createDataFrame(KNOWN + further() if known is None else known, "license string, known string").select("license", F.array_join(lines, " ").alias("known"))
    return texts.groupBy(F.sha2("known", 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("known")).alias("n"))


def scan(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``text_digest``, ``license`` (of the entire text) and ``notices`` (of its lines)."""
    most = known.agg(F.max("n"), F.sum(F.lit(96) + F.octet_length("license"))).first()
    longest, weight = most[0] or 0, most[1] or 0
    rows = folded(docs, text).select("row", canonical_lines(F.col("a0")).alias("lines"), F.monotonically_increasing_id().alias("rid"))
    short = F.filter("lines", lambda x: F.length(x) <= longest)
    whole = F.array_join("lines", " ")
    hashed = rows.select("rid", "row", F.sha2(whole, 256).alias("text_digest"), F.transform(short, lambda x: F.sha2(x, 256)).alias("digests"))
    asked = hashed.select("rid", "row", "text_digest", F.explode(F.array_distinct(F.concat(F.array("text_digest"), "digests"))).alias("digest"))
    names = known.select("digest", F.col("license").alias("name"))
    found = asked.join(F.broadcast(names) if weight <= BROADCAST_BYTES else names, "digest", "left")
    per = found.groupBy("rid").agg(
        F.first("row").alias("row"), F.first("text_digest").alias("text_digest"),
        F.max(F.when(F.col("digest") == F.col("text_digest"), F.col("name"))).alias("license"),
        F.sort_array(F.collect_set("name")).alias("notices"),
    )
    return unfolded(per, [c for c in docs.columns if c != text], {}, {c: F.col(c) for c in ("text_digest", "license", "notices")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, known_digests(spark)).select("doc_id", "text_digest", "license", F.array_join("notices", ",").alias("notices"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_lines(column: str) -> str:
    t = f"translate(coalesce({column}, ''), '{CAPITALS}', '{SMALL}')"
    t = f"regexp_replace({t}, {_sql_text(COPYRIGHT_LINE)}, '\\1', 'g')"
    t = f"regexp_replace(replace({t}, '&', ' and '), {_sql_text(NOT_WORDS)}, ' ', 'g')"
    for other, one in SPELLINGS:
        t = f"replace({t}, '{other}', '{one}')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


ORACLE = f"""
WITH k(license, known) AS (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)}),
known AS (SELECT sha256(known) AS digest, min(license) AS license FROM (SELECT license, array_to_string({_sql_lines("known")}, ' ') AS known FROM k) GROUP BY 1),
d AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents),
w AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS text_digest, lines FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
      FROM (SELECT doc_id, unnest(list_append(list_transform(lines, lambda x: sha256(x)), text_digest)) AS digest FROM w) JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, known.license, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN known ON known.digest = w.text_digest LEFT JOIN n ON n.doc_id = w.doc_id
"""
