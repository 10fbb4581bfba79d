"""Transforms of features: reversible pipelines, sets of normalisers, pose representations, nested names, images and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from episodia.functions import rotations as ro
from episodia.functions.text import fixed
from episodia.operators.statistics import coefficients

WIDTHS = {"quaternion": 4, "matrix": 9, "axis_angle": 3, "rotation_6d": 6, "euler": 3}
PARTS = {"float32": T.FloatType(), "float64": T.DoubleType(), "int64": T.LongType(), "bool": T.BooleanType(), "string": T.StringType()}


@dataclass(frozen=True)
class Step:
    """A reversible transform of an array column, with the widths that it takes and gives."""

    forward: Callable[[Column], Column]
    backward: Callable[[Column], Column]
    takes: int
    gives: int


def _checked(x: Column, width: int) -> Column:
    return F.when(F.size(x) == width, x).otherwise(F.raise_error(F.concat(F.lit(f"a width of {width} is expected, found "), F.size(x))))


def forward(x: Column, steps: list[Step]) -> Column:
    for s in steps:
        x = _checked(s.forward(_checked(x, s.takes)), s.gives)
    return x


def backward(x: Column, steps: list[Step]) -> Column:
    """The steps undone, last one first."""
    for s in reversed(steps):
        x = _checked(s.backward(_checked(x, s.gives)), s.takes)
    return x


def scaled(by: float, width: int) -> Step:
    return Step(lambda x: F.transform(x, lambda v: v * by), lambda x: F.transform(x, lambda v: v / by), width, width)


def padded(width: int, wide: int) -> Step:
    return Step(lambda x: F.concat(x, F.array_repeat(F.lit(0.0), wide - width)), lambda x: F.slice(x, 1, width), width, wide)


@dataclass(frozen=True)
class Field:
    """A vector column of a normaliser set: its width, mode, and the column of its steps where statistics are kept for each step."""

    column: str
    width: int
    mode: str = "minmax"
    step: str | None = None


def field_stats(rows: DataFrame, field: Field) -> DataFrame:
    """``dims`` (array of min, max, mean, std) for all rows, or for each step: one row a step, whatever the number of rows."""
    x = [F.get(field.column, k).cast("double") for k in range(field.width)]
    dims = F.array(*[F.struct(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")) for v in x])
    return rows.groupBy(*([field.step] if field.step else [])).agg(dims.alias("dims"))


def _linear(mode: str, inverse: bool) -> Callable[[Column, Column], Column]:
    def one(x: Column, s: Column) -> Column:
        scale, offset = coefficients(mode, {k: s[k] for k in ("min", "max", "mean", "std")})
        return (x - offset) / scale if inverse else x * scale + offset

    return one


def normalise_set(rows: DataFrame, fields: list[Field], inverse: bool = False, stats: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rows`` with each field normalised (or, ``inverse``, restored) by its own mode and statistics."""
    for f in fields:
        held = (stats or {}).get(f.column)
        held = (field_stats(rows, f) if held is None else held).withColumnRenamed("dims", "_dims")
        key = f.step or "_one"
        if not f.step:  # the statistics are one row
            rows, held = rows.withColumn(key, F.lit(1)), F.broadcast(held.withColumn(key, F.lit(1)))
        rows = rows.join(held, key)

        rows = rows.withColumn(f.column, F.zip_with(F.col(f.column).cast("array<double>"), "_dims", _linear(f.mode, inverse))).drop("_dims", "_one")
    return rows


def signature_digest(*parts: Column) -> Column:
    """SHA-256 of a signature's JSON, the name under which statistics are kept."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def staged(df: DataFrame, name: str, parts: list[Column]) -> tuple[DataFrame, list[Column]]:
    """``parts`` as columns of their own, so that each is computed once however often it is used afterwards."""
    names = [f"_{name}{k}" for k in range(len(parts))]
    return df.withColumns(dict(zip(names, parts))), [F.col(n) for n in names]


def convert_pose(df: DataFrame, pose: str, source: str, target: str, rest: int = 0, convention: str = "XYZ") -> DataFrame:
    """``df`` with an array of position, rotation and ``rest`` further components, its rotation in another representation.

    Rotations go by way of their matrix; temporary columns begin with ``_``.
    """
    names, w = df.columns, WIDTHS[source]
    df, x = staged(df, "x", [F.get(pose, k).cast("double") for k in range(3 + w + rest)])
    r = x[3 : 3 + w]
    if source == "axis_angle":
        df, r = staged(df, "q", ro.axis_angle_to_quaternion(r))
    if source != "matrix":
        made = ro.euler_to_matrix(r, convention) if source == "euler" else ro.rotation_6d_to_matrix(r) if source == "rotation_6d" else ro.quaternion_to_matrix(r)
        df, r = staged(df, "m", made)
    if target in ("quaternion", "axis_angle"):
        df, r = staged(df, "q", ro.matrix_to_quaternion(r))
    if target == "axis_angle":
        r = ro.quaternion_to_axis_angle(r)
    elif target != "quaternion":
        r = {"matrix": lambda m: m, "rotation_6d": ro.matrix_to_rotation_6d, "euler": lambda m: ro.matrix_to_euler(m, convention)}[target](r)
    return df.withColumn(pose, F.array(*x[:3], *r, *x[3 + w :])).select(*names)


def noisy_pose(df: DataFrame, pose: str, key: str, representation: str, position_noise: float, angle_noise: float, seed: int = 0) -> DataFrame:
    """``df`` with normal noise on positions and on rotations, whose axis-angle vector takes it; the other components stay.

    Noise is a function of (seed, ``key``): reruns agree.
    """
    names, rest = df.columns, 0
    df, a = staged(df, "na", ro.normal_quartet(F.col(key), seed))
    df, b = staged(df, "nb", ro.normal_quartet(F.col(key), seed + 1))
    width = 3 + WIDTHS[representation]
    df = df.withColumn("_tail", F.slice(pose, F.lit(width + 1), F.size(pose))).withColumn(pose, F.slice(pose, 1, width))
    df = convert_pose(df, pose, representation, "axis_angle", rest)
    moved = [F.get(pose, k) + a[k] * position_noise for k in range(3)] + [F.get(pose, 3 + k) + b[k] * angle_noise for k in range(3)]
    df = convert_pose(df.withColumn(pose, F.array(*moved)), pose, "axis_angle", representation, rest)
    return df.withColumn(pose, F.concat(pose, "_tail")).select(*names)


def random_rotations(df: DataFrame, key: str, name: str, seed: int = 0) -> DataFrame:
    """``df`` with a uniformly distributed rotation (a quaternion) for each key; reruns agree."""
    names = [c for c in df.columns if c != name]
    df, g = staged(df, "g", ro.normal_quartet(F.col(key), seed))
    df, q = staged(df, "q", [x / F.sqrt(sum((y * y for y in g), F.lit(0.0))) for x in g])
    return df.select(*names, F.array(*ro.standardise(q)).alias(name))


def flatten_names(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns named by their paths."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for f in schema.fields:
            here = (*path, f.name)
            yield from leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [here]

    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p)) for p in leaves(df.schema, ())])


def unflatten_names(df: DataFrame, sep: str = "/") -> DataFrame:
    """Columns named by paths as nested structs."""
    tree: dict = {}
    for name in df.columns:
        *path, last = name.split(sep)
        here = tree
        for p in path:
            here = here.setdefault(p, {})
        here[last] = F.col(f"`{name}`")

    def column(node) -> Column:
        return F.struct(*[column(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node

    return df.select(*[column(v).alias(k) for k, v in tree.items()])


def feature_schema(features: dict[str, tuple[str, int]]) -> T.StructType:
    """A schema from feature names with element type and width; a width of 1 is a plain column."""
    return T.StructType([T.StructField(n, PARTS[t] if w == 1 else T.ArrayType(PARTS[t])) for n, (t, w) in features.items()])


def as_features(df: DataFrame, features: dict[str, tuple[str, int]]) -> DataFrame:
    """The columns of ``features``, cast to their types; other columns are left out."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in feature_schema(features).fields])


def name_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """``name, side``: columns that both tables have, or the left or right one alone (schemas only)."""
    side = {n: ("both" if n in right.columns else "left") for n in left.columns} | {n: "right" for n in right.columns if n not in left.columns}
    return left.sparkSession.createDataFrame(sorted(side.items()), "name string, side string")


def image_stride(height: Column, width: Column, target: int = 150, threshold: int = 300) -> Column:
    """The step at which a picture's rows and columns are read: 1 below the threshold."""
    side = F.greatest(height, width)
    return F.when(side < threshold, F.lit(1)).otherwise(F.floor(side / target)).cast("long")


def sampled_cells(picture: Column, stride: Column) -> Column:
    """Every ``stride``-th row and column of a picture (an array of rows), from the first on."""
    every = lambda a: F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.size(a).cast("long") - 1, F.lit(0)), stride), lambda i: F.get(a, i.cast("int")))
    return F.when(F.size(picture) > 0, F.transform(every(picture), every))


def _blur(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A separable convolution over the last two axes with zeros outside."""
    pad = len(kernel) // 2
    for axis in (-1, -2):
        wide = np.pad(x, [(pad, pad) if a == x.ndim + axis else (0, 0) for a in range(x.ndim)])
        n = x.shape[axis]
        x = sum(k * np.take(wide, range(i, i + n), axis) for i, k in enumerate(kernel))
    return x


def similarity(rows: DataFrame, key: str, left: str, right: str, height: int, width: int, size: int = 11, sigma: float = 1.5, span: float = 1.0) -> DataFrame:
    """``key, ssim``: structural similarity of two pictures a row (arrays of height * width), under a Gaussian window."""
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    schema = T.StructType([rows.schema[key], T.StructField("ssim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width) for c in ("_left", "_right"))
            mx, my = _blur(x, kernel), _blur(y, kernel)
            vx, vy, xy = _blur(x * x, kernel) - mx * mx, _blur(y * y, kernel) - my * my, _blur(x * y, kernel) - mx * my
            ratio = (2 * mx * my + c1) * (2 * xy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2) + 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(ratio.mean((1, 2)))], schema.names)

    cells = height * width
    sized = rows.where((F.size(left) == cells) & (F.size(right) == cells))
    return sized.select(key, F.col(left).cast("array<double>").alias("_left"), F.col(right).cast("array<double>").alias("_right")).mapInArrow(run, schema)


def task_summary(results: DataFrame, suites: list[str]) -> DataFrame:
    """``suite, task_id, trials, successes, rate, place`` from result files named ``gpuG_taskT_results.json``, suites in the given order."""
    task = F.regexp_extract("file", r"(?:^|/)gpu[^_/]*_task([0-9]+)_results\.json$", 1)
    place = F.array_position(F.array(*map(F.lit, suites)), F.col("suite"))
    named = results.withColumns({"_task": task, "place": place}).where((F.col("_task") != "") & (F.col("place") > 0))
    sums = named.groupBy("suite", "place", F.col("_task").cast("long").alias("task_id")).agg(F.sum("trials").alias("trials"), F.sum("successes").alias("successes"))
    return sums.withColumn("rate", F.col("successes") / F.col("trials"))


RESULT = "total_episodes long, successes long, duration double, task_description string, future_video_psnr_mean double"


def result_files(spark: SparkSession, path: str, suites: list[str]) -> DataFrame:
    """``suite, place, task_id, file`` and the numbers of every result file ``<suite>/gpuG_taskT_..._results.json`` of the given suites; other files are left out."""
    name = r"([^/]+)/([^/]*=)?(gpu[^/_]*_task([0-9]+)(_[^/]*)?_results\.json)(/|$)"
    at = F.col("_metadata.file_path")
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(at.alias("path"), F.from_json("value", RESULT).alias("r"))
    part = lambda k: F.regexp_extract("path", name, k)
    suite = F.regexp_replace(part(1), "^[^=]*=", "")
    place = F.array_position(F.array(*map(F.lit, suites)), suite)
    return rows.where(F.regexp_like("path", F.lit(name))).select(suite.alias("suite"), place.alias("place"), part(4).cast("long").alias("task_id"), part(3).alias("file"), "r.*").where("place > 0")


def suite_statistics(results: DataFrame) -> DataFrame:
    """Sums of each suite over all its files, and the mean of the picture similarities that there are."""
    return results.groupBy("suite", "place").agg(
        F.count("*").alias("total_tasks"), F.sum("total_episodes").alias("total_trials"), F.sum("successes").alias("total_successes"),
        F.sum("duration").alias("total_time"), F.max("duration").alias("max_time"), F.avg("future_video_psnr_mean").alias("average_psnr"),
    )


def task_lines(results: DataFrame) -> DataFrame:
    """``place, task_id, line``: the printed table of the tasks' success rates, its columns right-aligned; the heading has place 0.

    Of several files of a task the one of the greatest name counts.
    """
    last = results.groupBy("suite", "place", "task_id").agg(F.max_by(F.struct("total_episodes", "successes", "task_description", "future_video_psnr_mean"), "file").alias("r")).select("suite", "place", "task_id", "r.*")
    cells = {
        "Task": F.concat_ws("_", "suite", "task_id"), "Description": F.coalesce("task_description", F.lit("")),
        "Success Rate (%)": fixed(F.col("successes") * 100.0 / F.col("total_episodes"), 2), "Future Video PSNR (dB)": fixed(F.col("future_video_psnr_mean"), 4),
    }
    rows = last.select("place", "task_id", *(c.alias(name) for name, c in cells.items()))
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("task_id"), *(F.lit(name).alias(name) for name in cells))
    table = rows.select(F.col("place").cast("long").alias("place"), "task_id", *(f"`{name}`" for name in cells)).unionByName(head)
    widths = table.agg(*(F.max(F.char_length(f"`{name}`")).alias(f"w{k}") for k, name in enumerate(cells)))  # one row
    wide = table.join(F.broadcast(widths))
    return wide.select("place", "task_id", F.concat_ws(" ", *(F.lpad(F.col(f"`{name}`"), F.col(f"w{k}"), F.lit(" ")) for k, name in enumerate(cells))).alias("line"))


def transposed(rows: DataFrame, key: str, keys: list, measures: list[str]) -> DataFrame:
    """One row a measure, one column a key: the layout of a printed summary."""
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("m")).select(key, "m.*")
    return long.groupBy("measure").pivot(key, keys).agg(F.first("value"))
