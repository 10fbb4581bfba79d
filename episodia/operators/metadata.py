"""Data-set metadata: versions, task tables, offsets, contracts as violation reports, and lookups that must not miss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodia.functions.text import normalise_text
from episodia.operators.keys import numbered


def require_version(found: str, wanted: str) -> str:
    """``found`` if its major version is the wanted one; an error otherwise."""
    if found.lstrip("v").split(".")[0] != wanted.lstrip("v").split(".")[0]:
        raise ValueError(f"version {found} where {wanted} is needed")
    return found


def per_episode_stats(version: str, stats: DataFrame, episodes: DataFrame) -> DataFrame:
    """Statistics of each episode: before version 2.1 the global rows hold for every episode."""
    if "episode_index" in stats.columns:
        return stats
    major, minor = (int(x) for x in version.lstrip("v").split(".")[:2])
    if (major, minor) >= (2, 1):
        raise ValueError(f"version {version} keeps statistics by episode")
    rows = stats.agg(F.collect_list(F.struct(*stats.columns)).alias("_all")).withColumn("_one", F.lit(1))  # a row a feature
    return episodes.select("episode_index", F.lit(1).alias("_one")).join(F.broadcast(rows), "_one").select("episode_index", F.inline("_all"))


def without_stats(episodes: DataFrame) -> DataFrame:
    """The episodes table without its ``stats/...`` columns."""
    return episodes.drop(*[c for c in episodes.columns if c.startswith("stats/")])


def task_column(table: DataFrame) -> str:
    """The column that holds the task text: ``task``, ``instruction``, or the only string column."""
    for name in ("task", "instruction"):
        if name in table.columns:
            return name
    texts = [f.name for f in table.schema.fields if f.dataType.simpleString() == "string"]
    if len(texts) != 1:
        raise ValueError(f"no single task column among {table.columns}")
    return texts[0]


def task_table(table: DataFrame, key: str = "task_index") -> DataFrame:
    """``task_index, task`` whatever the text's column is called."""
    return table.select(key, F.col(f"`{task_column(table)}`").alias("task"))


def text_conflicts(tasks: DataFrame, key: str = "task_index") -> DataFrame:
    """Normalised texts that stand for several keys."""
    return tasks.groupBy(normalise_text(F.col("task")).alias("text")).agg(F.countDistinct(key).alias("keys")).where("keys > 1")


def must_match(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of ``table``; a key without one fails the job."""
    found = rows.join(table.select(key, value), key, "left")
    missing = F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return found.withColumn(value, F.coalesce(value, F.raise_error(missing).cast(table.schema[value].dataType)))


def cached_context(prompts: DataFrame, cache: DataFrame, suffix: str = "") -> DataFrame:
    """``prompts`` with the cached ``context`` under the digest of their text; positions whose mask is false are zero."""
    named = prompts.withColumn("file", F.concat(F.sha2("prompt", 256), F.lit(suffix)))
    kept = F.zip_with("context", "mask", lambda x, m: F.when(m, x).otherwise(F.lit(0.0)))
    return must_match(named, cache.select("file", kept.alias("context")), "file", "context")


def segment_rows(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """Global row numbers (``row``) as data set ``ordinal`` and ``local`` row; one row a data set goes through the window."""
    before = F.coalesce(F.sum("size").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_start", before)
    bounds = starts.agg(F.sort_array(F.collect_list(F.struct(F.col("_start").alias("start"), F.col("ordinal"), F.col("size")))).alias("_s")).withColumn("_one", F.lit(1))
    own = F.get(F.filter("_s", lambda x: (x["start"] <= F.col("row")) & (F.col("row") < x["start"] + x["size"])), 0)
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one").withColumn("_own", own).drop("_s", "_one").select("*", F.col("_own.ordinal").alias("ordinal"), (F.col("row") - F.col("_own.start")).alias("local")).drop("_own")


def window_offsets(past: int, size: int, stride: int = 1, every: int = 1, fps: float = 1.0) -> list[float]:
    """Seconds of a window's steps: ``t * stride / fps`` for each ``every``-th t from ``-past`` on."""
    return [t * stride / fps for t in range(-past, -past + size, every)]


def frame_offsets(seconds: Column, fps: float, tolerance: float = 1e-4) -> Column:
    """Offsets in frames, half to even; an offset off the frame grid by more than the tolerance fails the job."""
    def one(t: Column) -> Column:
        n = F.rint(t * F.lit(float(fps)))
        off = F.abs(t * F.lit(float(fps)) - n) / F.lit(float(fps)) > tolerance
        return F.when(off, F.raise_error(F.concat(F.lit("no frame at "), t.cast("string"))).cast("double")).otherwise(n).cast("long")

    return F.transform(seconds, one)


def on_grid(seconds: Column, fps: float, tolerance: float = 1e-4) -> Column:
    return F.abs(seconds * F.lit(float(fps)) - F.rint(seconds * F.lit(float(fps)))) / F.lit(float(fps)) <= tolerance


def problems(checks: dict[str, Column]) -> Column:
    """The names of the checks that do not hold (null counts as not holding), in order."""
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.array_compact(F.array(*named))


def feature_problems(found: DataFrame, wanted: dict[str, str]) -> list[str]:
    """Missing and extra columns and differing types of a table against a feature set."""
    have = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    out = [f"missing {c}" for c in sorted(wanted.keys() - have.keys())] + [f"extra {c}" for c in sorted(have.keys() - wanted.keys())]
    return out + [f"{c} is {have[c]}, not {wanted[c]}" for c in sorted(wanted.keys() & have.keys()) if have[c] != wanted[c]]


#: Column types that a declared dtype stands for.
DTYPES = {"float32": "float", "float64": "double", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "uint8": "smallint", "bool": "boolean", "string": "string"}
PICTURES = ("image", "video")


def feature_report(rows: DataFrame, features: DataFrame) -> DataFrame:
    """``feature, problem, rows``: how a table differs from a feature set (``feature, dtype, shape``, one row a column).

    Missing and extra columns and other types are seen in the schema (``rows`` is
    null); values of another shape are counted in one pass over the table.  A
    shape ``[1]`` is a plain value or an array of one; a null value has no shape.
    """
    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    wanted = {r["feature"]: (r["dtype"], list(r["shape"])) for r in features.collect()}
    found = [(c, "missing", None) for c in sorted(wanted.keys() - have.keys())] + [(c, "extra", None) for c in sorted(have.keys() - wanted.keys())]
    counts = []
    for name in sorted(wanted.keys() & have.keys()):
        dtype, shape = wanted[name]
        column, depth, kind = F.col(f"`{name}`"), 0, have[name]
        while kind.startswith("array<"):
            depth, kind = depth + 1, kind[6:-1]
        if dtype not in PICTURES and kind != DTYPES.get(dtype, dtype):
            found.append((name, f"is {kind}, not {dtype}", None))
        elif depth != len(shape) and not (depth == 0 and shape == [1]) and dtype not in PICTURES:
            found.append((name, f"has {depth} dimensions, not {len(shape)}", None))
        elif depth:
            sound, at = F.size(column) == shape[0], column
            for level, n in enumerate(shape[1:]):
                at = F.flatten(at) if level else at
                sound = sound & F.forall(F.transform(at, F.size), lambda k: k == F.lit(n))  # noqa: B023  (used at once)
            counts.append(F.struct(F.lit(name).alias("feature"), F.lit(f"is not of shape {shape}").alias("problem"), F.count_if(column.isNotNull() & ~sound).alias("rows")))
    out = rows.sparkSession.createDataFrame(found, "feature string, problem string, rows long")
    if counts:
        out = out.unionByName(rows.agg(F.array(*counts).alias("_all")).select(F.inline("_all")).where("rows > 0"))
    return out


def buffer_problems(episodes: DataFrame, first: int = 0) -> DataFrame:
    """``episode_index, problems`` of episodes (``frames``, ``task``, ``indices``): each must have frames, a task, and frame numbers from ``first`` on."""
    checks = {
        "empty": F.size("frames") > 0, "no task": F.col("task").isNotNull(),
        "numbers": F.col("indices") == F.when(F.size("frames") > 0, F.sequence(F.lit(first).cast("long"), F.size("frames").cast("long") + (first - 1))).otherwise(F.array().cast("array<bigint>")),
    }
    return episodes.select("episode_index", problems(checks).alias("problems")).where(F.size("problems") > 0)


def cache_row_problems(rows: DataFrame, step: int = 4, effect_length: int = 16) -> DataFrame:
    """Rows (``start, stop, is_query``) whose steps are no multiples of ``step`` or whose effect has another length."""
    checks = {
        "step": (F.col("start") % step == 0) & (F.col("stop") % step == 0),
        "length": F.col("is_query") | (F.col("stop") - F.col("start") == effect_length),
    }
    return rows.withColumn("problems", problems(checks)).where(F.size("problems") > 0)


def stats_problems(stats: DataFrame) -> DataFrame:
    """Statistics rows (``feature, mean, std, min, max, count`` as arrays) that break the contract: equal sizes of at least one, one count."""
    same = reduce(lambda a, b: a & b, [F.size(c) == F.size("mean") for c in ("std", "min", "max")])
    checks = {"size": F.size("mean") >= 1, "shapes": same, "count": F.size("count") == 1, "order": F.forall(F.zip_with("min", "max", lambda a, b: a <= b), lambda x: x)}
    return stats.withColumn("problems", problems(checks)).where(F.size("problems") > 0)


def order_violations(rows: DataFrame, *keys: str, group: str | None = None, by: str = "place") -> DataFrame:
    """Rows (in the order of ``by``, of the whole table or of each ``group``) whose key is less than that of the row before.

    Without a group the table is numbered by ranges and each row meets the one
    before by its number, so no task orders all rows.
    """
    if group:
        key = F.struct(*keys)
        return rows.withColumn("_before", F.lag(key).over(Window.partitionBy(group).orderBy(by))).where(F.col("_before") > key).drop("_before")
    placed = numbered(rows, "_at", F.asc(by))
    before = placed.select((F.col("_at") + 1).alias("_next"), F.struct(*keys).alias("_before"))
    return placed.join(before, F.col("_at") == F.col("_next")).where(F.col("_before") > F.struct(*keys)).select(*rows.columns)


def validation_report(rows: DataFrame, id_: str, checks: dict[str, Column]) -> DataFrame:
    """One row: how many rows and ids there are, how many rows break each check (``bad_<name>``; null breaks it), and the ``status``.

    ``passed`` needs at least one row, no repeated id and no broken check.  Ids
    are counted one row an id, so a hot one is added up before it is shuffled.
    """
    bad = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"bad_{name}") for name, ok in checks.items()]
    per = rows.groupBy(id_).agg(F.count("*").alias("_n"), *bad)
    sums = [F.coalesce(F.sum(f"bad_{name}"), F.lit(0)).alias(f"bad_{name}") for name in checks]
    one = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("ids"), *sums)
    sound = (F.col("rows") > 0) & (F.col("rows") == F.col("ids"))
    for name in checks:
        sound = sound & (F.col(f"bad_{name}") == 0)
    return one.withColumn("status", F.when(sound, "passed").otherwise("failed"))


def write_progress(progress: DataFrame, path: str) -> None:
    """``part, total, next_offset`` as JSON, one folder a part."""
    progress.select("part", F.to_json(F.struct("total", "next_offset")).alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def remaining(rows: DataFrame, path: str, part: str = "part", place: str = "place") -> DataFrame:
    """The rows of each part from its next offset on; all rows of a part without a progress file.

    A total that is not the part's number of rows, or an offset outside of it,
    fails the job.
    """
    spark = rows.sparkSession
    read = spark.read.option("basePath", path).schema("value string, part string").text(path)
    known = read.select(F.col("part").alias("_p"), F.from_json("value", "total long, next_offset long").alias("_s")).select("_p", "_s.*")
    counts = rows.groupBy(part).agg(F.count("*").alias("_rows"))  # one row a part
    checked = counts.join(known, F.col(part).cast("string") == F.col("_p"), "left")
    wrong = F.col("_p").isNotNull() & ((F.col("total") != F.col("_rows")) | (F.col("next_offset") < 0) | (F.col("next_offset") > F.col("_rows")) | F.col("total").isNull() | F.col("next_offset").isNull())
    message = F.concat(F.lit("progress of part "), F.col("_p"), F.lit(" does not fit its rows"))
    offset = F.when(wrong, F.raise_error(message).cast("long")).otherwise(F.coalesce("next_offset", F.lit(0)))
    left = checked.select(F.col(part).alias("_part"), offset.alias("_from"))
    return rows.join(left, F.col(part).eqNullSafe(F.col("_part"))).where(F.col(place) >= F.col("_from")).drop("_part", "_from")


def canonical_from_path(paths: DataFrame, names: DataFrame) -> DataFrame:
    """``path, name, candidates``: the known name that a path part equals, begins with (``name_``) or ends with (``_name``).

    Parts and their ``_``-delimited heads and tails meet the names in an
    equi-join; several distinct names leave ``name`` null.
    """
    parts = paths.select("path", F.explode(F.split("path", "/")).alias("part")).where("part <> ''")
    words = F.split("part", "_")
    heads = F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.array_join(F.slice("words", 1, n), "_"))
    tails = F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.array_join(F.slice("words", F.size("words") - n + 1, n), "_"))
    tried = parts.withColumn("words", words).select("path", F.explode(F.array_distinct(F.concat(heads, tails))).alias("name"))
    hits = tried.join(names.select("name"), "name").groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("candidates"))
    return paths.join(hits, "path", "left").select("path", F.when(F.size("candidates") == 1, F.element_at("candidates", 1)).alias("name"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def mapped_tasks(rows: DataFrame, manual_index: DataFrame, manual_text: DataFrame, cache_text: DataFrame, layout: DataFrame) -> DataFrame:
    """``rows`` (``episode, task_index, text``) with ``name`` and its ``origin``.

    The episode's layout has the last word; without it a manual entry of the
    index, then of the text, then the cache's.  A text that the cache gives
    several names is ambiguous and gives none.
    """
    once = cache_text.groupBy("text").agg(F.min("name").alias("_c"), F.countDistinct("name").alias("_k")).where("_k = 1").drop("_k")
    out = rows.join(manual_index.withColumnRenamed("name", "_i"), "task_index", "left").join(manual_text.withColumnRenamed("name", "_t"), "text", "left").join(once, "text", "left").join(layout.withColumnRenamed("name", "_l"), "episode", "left")
    ways = [("_l", "layout"), ("_i", "manual index"), ("_t", "manual text"), ("_c", "cache text")]
    origin = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for c, name in ways])
    return out.withColumns({"name": F.coalesce(*[c for c, _ in ways]), "origin": origin, "conflict": F.col("_l").isNotNull() & F.coalesce(F.coalesce("_i", "_t", "_c") != F.col("_l"), F.lit(False))}).drop(*[c for c, _ in ways])


def memory_inputs(records: DataFrame, k: int = 4) -> DataFrame:
    """What each query sees: the last ``k`` effects of its attempt, and how many effects its session has kept.

    ``records``: ``episode, place, kind (effect, query, end, reset), effect``.  An
    effect is visible at once; the end of an attempt clears the recent effects
    and keeps the memory, a reset clears both.
    """
    so_far = Window.partitionBy("episode").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    turn = records.withColumns({
        "session": F.sum((F.col("kind") == "reset").cast("int")).over(so_far),
        "attempt": F.sum(F.col("kind").isin("end", "reset").cast("int")).over(so_far),
    })
    own = Window.partitionBy("episode", "attempt").orderBy("place")
    effects = turn.where("kind = 'effect'").withColumn("_tail", F.array_compact(F.array(*[F.lag("effect", j).over(own) for j in range(k - 1, 0, -1)], F.col("effect"))))
    rest = turn.where("kind = 'query'").withColumn("_tail", F.lit(None).cast(effects.schema["_tail"].dataType))
    both = effects.unionByName(rest)
    seen = F.coalesce(F.last("_tail", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.array().cast(effects.schema["_tail"].dataType))
    kept = F.sum((F.col("kind") == "effect").cast("long")).over(Window.partitionBy("episode", "session").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumns({"recent": seen, "kept": kept}).where("kind = 'query'").select("episode", "place", "attempt", "session", "recent", "kept")


def irregular_history(rows: DataFrame, step: int = 4) -> DataFrame:
    """Rows (``episode, raw_step``) that do not follow the one before by exactly ``step``."""
    gap = F.col("raw_step") - F.lag("raw_step").over(Window.partitionBy("episode").orderBy("raw_step"))
    return rows.withColumn("gap", gap).where(F.col("gap") != step)
