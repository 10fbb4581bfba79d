"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

Each rule names a host, which also stands for its subdomains, and the start of
a path.  A URL is expanded into its host suffixes times its path prefixes that
end in ``/`` (and the empty one), no deeper than the deepest rule, since deeper
expressions cannot match.  The first 32 bits of the expressions' SHA-256 join
the rules' prefixes; full digests and the rule's whole path confirm a hit, and
the longest rule wins (then the longer host, then block, then the rule's text).

Rules are broadcast only while their measured size is under ``BROADCAST_BYTES``:
then the expansions of a row are made and reduced in the same task, and the one
shuffle carries one row per URL.  A larger rule table is joined by a shuffle of
the expressions, whose skew (a frequent host) adaptive execution splits.

Defined cases: a null URL or one without ``://`` has an empty host and path and
gets the default verdict; an empty rule table gives it to every row; an empty
table of pages gives an empty result; repeated rows are judged one by one;
further columns pass through, but a result column replaces one of its name.
Rows are numbered while they are read: give a table, or a plan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodia.llm.shared import folded, unfolded

BROADCAST_BYTES = 8 << 20
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")


def _parts(text: Column, sep: str) -> Column:
    return F.split(text, sep, -1)


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Host suffixes of at most ``labels`` labels times path prefixes of at most ``depth`` slashes."""
    names, steps = _parts(host, r"\."), _parts(path, "/")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda i: F.array_join(F.slice(names, F.size(names) - i + 1, i), "."))
    paths = F.transform(
        F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(depth))),
        lambda j: F.when(j == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), j), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit(" "), p))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``."""
    known = rules.where(F.col("rule_host").isNotNull()).select(
        F.translate("rule_host", CAPITALS, SMALL).alias("_rh"), F.coalesce("rule_path", F.lit("")).alias("_rp"), F.col("verdict").alias("_rv")
    ).withColumn("_key", F.concat("_rh", F.lit(" "), F.regexp_extract("_rp", "(?s)^.*/", 0)))
    deepest = known.agg(F.max(F.size(_parts(F.col("_rh"), r"\."))), F.max(F.size(_parts(F.regexp_extract("_rp", "(?s)^.*/", 0), "/")) - 1), F.sum(F.lit(200) + 2 * F.octet_length("_key"))).first()
    labels, depth, weight = deepest[0] or 1, deepest[1] or 0, deepest[2] or 0
    known = known.withColumn("_digest", F.sha2("_key", 256)).select(
        F.substring("_digest", 1, 8).alias("_prefix"), F.col("_digest").alias("_full"), "_rp",
        F.struct(
            (F.length("_rh") + F.length("_rp")).alias("n"), F.length("_rh").alias("h"), (F.col("_rv") == "block").alias("b"),
            F.concat("_rh", "_rp").alias("rule"), F.col("_rv").alias("verdict"),
        ).alias("_hit"),
    )
    rows = folded(pages, url).select("row", "a0", host_of(F.col("a0")).alias("host"), path_of(F.col("a0")).alias("path"), F.monotonically_increasing_id().alias("rid"))
    asked = rows.withColumn("_digest", F.explode(F.transform(expressions(F.col("host"), F.col("path"), labels, depth), lambda e: F.sha2(e, 256)))).withColumn("_prefix", F.substring("_digest", 1, 8))
    sure = (F.col("_full") == F.col("_digest")) & F.startswith("path", "_rp")
    best = (
        asked.join(F.broadcast(known) if weight <= BROADCAST_BYTES else known, "_prefix", "left")
        .groupBy("rid").agg(F.first("row").alias("row"), F.first("a0").alias("a0"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(sure, F.col("_hit"))).alias("hit"))
    )
    results = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("hit.rule"), "verdict": F.coalesce("hit.verdict", F.lit(default))}
    return unfolded(best, pages.columns, {url: "a0"}, results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH r(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
               row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
        FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE k = 1
"""
