"""A Spark data source for the metadata folder of an episode data set.

``spark.read.format("episode_metadata").option("table", t).load(root)`` reads one
of four tables, whichever layout the data set has:

* ``info``: one row a feature with the data set's version, rate and totals;
* ``tasks``: ``task_index, task``;
* ``episodes``: ``episode_index, tasks, length``, without statistics;
* ``stats``: one row a statistic of a feature, ``episode_index`` null where it
  holds for the whole data set.

Layouts: version 2 keeps JSON and JSON lines (``stats.json`` for the whole before
2.1, ``episodes_stats.jsonl`` from then on), version 3.0 keeps Parquet files of
tasks and of episodes, in chunks, with statistics in columns ``stats/...``.
Other versions are refused, and so is one that the reader does not ask for
(option ``version``).  A file may also be a folder of part files of that name.

Every file is a partition.  Comparisons of ``episode_index`` with numbers are
pushed down: they choose files by the Parquet footers, and rows in every file.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMAS = {
    "info": "version string, fps double, total_episodes long, total_frames long, feature string, dtype string, shape array<long>",
    "tasks": "task_index long, task string",
    "episodes": "episode_index long, tasks array<string>, length long",
    "stats": "episode_index long, feature string, statistic string, values array<double>",
}
FORMAT = "episode_metadata"
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class File(InputPartition):
    path: str
    kind: str  # json, lines or parquet


def number(version: str) -> tuple[int, int]:
    major, _, minor = str(version).lstrip("v").partition(".")
    return int(major), int(minor.split(".")[0] or 0)


def flat(value) -> list[float]:
    """The numbers of nested lists, in order."""
    return [x for v in value for x in flat(v)] if isinstance(value, (list, tuple)) else [float(value)]


class MetadataReader(DataSourceReader):
    def __init__(self, root: str, table: str, wanted: str | None):
        self.root, self.table, self.wanted, self.tests = root.rstrip("/"), table, wanted, []

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = isinstance(f, (*_COMPARE, In)) and f.attribute == ("episode_index",)
            values = getattr(f, "value", None)
            if known and self.table in ("episodes", "stats") and values is not None and (not isinstance(f, In) or None not in values):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, episode: int | None) -> bool:
        if episode is None:
            return not self.tests
        return all(episode in f.value if isinstance(f, In) else _COMPARE[type(f)](episode, f.value) for f in self.tests)

    def _may_pass(self, least: int, most: int) -> bool:
        """Whether an episode between the two could pass."""
        for f in self.tests:
            if isinstance(f, In):
                ok = any(least <= v <= most for v in f.value)
            elif isinstance(f, EqualTo):
                ok = least <= f.value <= most
            else:
                ok = _COMPARE[type(f)](most if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else least, f.value)
            if not ok:
                return False
        return True

    def _files(self, fs: pafs.FileSystem, path: str, suffix: str = "") -> list[str]:
        """The file, or the part files of the folder, of a name; none if it is not there."""
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [path]
        if info.type == pafs.FileType.NotFound:
            return []
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")) and f.path.endswith(suffix))

    def _json(self, fs: pafs.FileSystem, path: str):
        """A JSON document, in one file or in the lines of part files."""
        return json.loads("\n".join(fs.open_input_stream(f).read().decode() for f in self._files(fs, path)), strict=False)

    def partitions(self) -> list[File]:
        fs, root = self._fs()
        info = self._json(fs, f"{root}/meta/info.json")
        version = number(info["codebase_version"])
        if version[0] not in (2, 3) or (version[0] == 3 and version != (3, 0)):
            raise ValueError(f"version {info['codebase_version']} where 2 or 3.0 is needed")
        if self.wanted and number(self.wanted)[0] != version[0]:
            raise ValueError(f"version {info['codebase_version']} where {self.wanted} is needed")
        meta = f"{root}/meta"
        if self.table == "info":
            return [File(f"{meta}/info.json", "json")]
        if self.table == "stats" and version < (2, 1):
            return [File(f"{meta}/stats.json", "json")] if self._files(fs, f"{meta}/stats.json") else []
        if version[0] == 2:
            name = {"tasks": "tasks.jsonl", "episodes": "episodes.jsonl", "stats": "episodes_stats.jsonl"}[self.table]
            return [File(f, "lines") for f in self._files(fs, f"{meta}/{name}")]
        out = []
        for f in self._files(fs, f"{meta}/tasks.parquet" if self.table == "tasks" else f"{meta}/episodes", ".parquet"):
            if self.tests:
                footer = pq.ParquetFile(fs.open_input_file(f)).metadata
                place = footer.schema.names.index("episode_index")
                groups = [footer.row_group(i).column(place).statistics for i in range(footer.num_row_groups)]
                if not any(s is None or not s.has_min_max or self._may_pass(s.min, s.max) for s in groups):
                    continue
            out.append(File(f, "parquet"))
        if self.table == "stats" and not self.tests and self._files(fs, f"{meta}/stats.json"):
            out.append(File(f"{meta}/stats.json", "json"))
        return out

    def _rows(self, fs: pafs.FileSystem, part: File) -> Iterator[dict]:
        if part.kind == "json":
            yield self._json(fs, part.path)
        elif part.kind == "lines":
            for line in fs.open_input_stream(part.path).read().decode().split("\n"):
                if line.strip():
                    yield json.loads(line, strict=False)
        else:
            source = pq.ParquetFile(fs.open_input_file(part.path))
            names = source.schema_arrow.names
            wanted = [c for c in names if self.table != "episodes" or not c.startswith("stats/")]
            for batch in source.iter_batches(columns=wanted):
                yield from batch.to_pylist()

    def read(self, part: File | None) -> Iterator[tuple]:
        if part is None:  # no file at all
            return
        fs, _ = self._fs()
        for row in self._rows(fs, part):
            if self.table == "info":
                for name, feature in row["features"].items():
                    yield row["codebase_version"], float(row["fps"]), int(row["total_episodes"]), int(row["total_frames"]), name, feature["dtype"], [int(x) for x in feature["shape"]]
            elif self.table == "tasks":
                text = row["task"] if "task" in row else next(v for v in row.values() if isinstance(v, str))  # the text may be the table's index
                yield int(row["task_index"]), text
            elif self.table == "episodes":
                if self._passes(row["episode_index"]):
                    yield int(row["episode_index"]), list(row["tasks"]), int(row["length"])
            else:
                yield from self._stats(row, part.kind)

    def _stats(self, row: dict, kind: str) -> Iterator[tuple]:
        episode = None if kind == "json" else int(row["episode_index"])
        if not self._passes(episode):
            return
        if kind == "parquet":
            for name, value in row.items():
                if name.startswith("stats/") and value is not None:
                    feature, _, statistic = name.removeprefix("stats/").rpartition("/")
                    yield episode, feature, statistic, flat(value)
        else:
            for feature, own in (row["stats"] if kind == "lines" else row).items():
                for statistic, value in own.items():
                    yield episode, feature, statistic, flat(value)


class EpisodeMetadata(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema) -> MetadataReader:
        return MetadataReader(self.options["path"], self.options["table"], self.options.get("version"))


def read_metadata(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A metadata table of the data set at ``root``.

    A reader that takes filters needs the session to allow it, so the setting is turned on.
    """
    spark.dataSource.register(EpisodeMetadata)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("table", table)
    return (reader.option("version", version) if version else reader).load(root)


def write_info(spark: SparkSession, root: str, version: str, features: dict[str, tuple[str, list[int]]], episodes: int, frames: int, fps: float) -> None:
    info = {"codebase_version": version, "fps": fps, "total_episodes": episodes, "total_frames": frames, "features": {k: {"dtype": d, "shape": s} for k, (d, s) in features.items()}}
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.text(f"{root}/meta/info.json")
