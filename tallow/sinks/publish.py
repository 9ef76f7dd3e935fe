"""Putting staged days in place, each by itself.

A run stages its days below a folder of its own in the lake, ``<lake>/_run-<id>``, which readers
pass over. Then each day is published alone, and what fails is that day:

1. what is stored of it moves to ``old``, and a mark says so;
2. the staged folder takes its place;
3. a second mark says so, and ``old`` goes.

Every step can be repeated: a task that is lost and run again finds by the marks where the first
one was, so that a day holds either its old files or its new ones. If step 2 fails, the old files
are put back. Folders move by renaming where that is one step, else by copying (object stores).

Tasks publish, through Arrow's file systems. Where only Hadoop knows the file system (``viewfs``,
or ``hdfs`` without its native library), and where tasks may run twice at the same time
(``spark.speculation``), threads of the driver do, through Hadoop's.
"""

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions.paths import day_folder
from tallow.schema import DAY_KEY
from tallow.session import hadoop_folder, shared_path, stage
from tallow.sources.fetch import file_system

DAYS_PER_TASK = 16
MAX_TASKS = 10_000
THREADS = 32
CHUNK = 10_000  # days whose outcomes the driver holds at once

_OUTCOME = pa.schema([*((c, pa.string()) for c in DAY_KEY), ("error", pa.string()), ("kept", pa.string())])
_OUTCOME_DDL = ", ".join(f"{f.name} string" for f in _OUTCOME)


class ArrowFolders:
    """Folders on a file system that Arrow knows."""

    # of these Arrow renames a folder in one step
    RENAMING = ("local", "hdfs")

    def __init__(self, system):
        self.system = system
        self.renames = system.type_name in self.RENAMING

    def _type(self, path: str):
        return self.system.get_file_info(path).type

    def exists(self, path: str) -> bool:
        from pyarrow.fs import FileType

        found = self._type(path)
        if found == FileType.File:
            raise NotADirectoryError(f"a file lies in place of the folder {path}")
        return found == FileType.Directory

    def marked(self, path: str) -> bool:
        from pyarrow.fs import FileType

        return self._type(path) == FileType.File

    def mark(self, path: str) -> None:
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.system.open_output_stream(path).close()

    def unmark(self, path: str) -> None:
        self.system.delete_file(path)

    def delete(self, path: str) -> None:
        if self.exists(path):
            self.system.delete_dir(path)

    def place(self, source: str, target: str) -> None:
        """Make ``target`` what ``source`` is; the source may stay."""
        from pyarrow import fs

        self.delete(target)
        if self.renames:
            self.system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            self.system.move(source, target)
        else:
            self.system.create_dir(target, recursive=True)
            fs.copy_files(source, target, source_filesystem=self.system, destination_filesystem=self.system)


class HadoopFolders:
    """Folders on any file system of Hadoop, by way of the driver's JVM."""

    def __init__(self, spark: SparkSession, root: str):
        _, self.system = hadoop_folder(spark, root)
        self.path = spark._jvm.org.apache.hadoop.fs.Path

    def exists(self, path: str) -> bool:
        folder = self.path(path)
        if not self.system.exists(folder):
            return False
        if self.system.getFileStatus(folder).isFile():
            raise NotADirectoryError(f"a file lies in place of the folder {path}")
        return True

    def marked(self, path: str) -> bool:
        return self.system.exists(self.path(path))

    def mark(self, path: str) -> None:
        self.system.create(self.path(path)).close()

    def unmark(self, path: str) -> None:
        self.system.delete(self.path(path), False)

    def delete(self, path: str) -> None:
        if self.exists(path):
            self.system.delete(self.path(path), True)

    def place(self, source: str, target: str) -> None:
        self.delete(target)
        self.system.mkdirs(self.path(target).getParent())
        if not self.system.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} could not be renamed to {target}")


class KeptAside(Exception):
    """A day could not be published, nor its old files be put back."""

    def __init__(self, why: str, where: str):
        super().__init__(f"{why}; what was stored is in {where}")
        self.where = where


def publish_day(folders, run: str, root: str, day: str, empty: bool) -> None:
    """Put the staged ``day`` (its folder below ``root``) in place of the stored one.

    An ``empty`` day has nothing staged: what is stored of it goes. A day that should have been
    staged and was not is an error, and stays as it is.
    """
    target, new, old = f"{root}/{day}", f"{run}/new/{day}", f"{run}/old/{day}"
    aside, done = f"{run}/marks/{day}/aside", f"{run}/marks/{day}/done"
    if not folders.marked(done):
        stored, moved = folders.exists(target), folders.marked(aside)
        if not (empty or folders.exists(new) or (moved and stored)):
            raise FileNotFoundError(f"nothing is staged in {new}")
        if stored and not moved:
            folders.place(target, old)
        try:
            folders.mark(aside)
            if empty:
                folders.delete(target)
            elif folders.exists(new):
                folders.place(new, target)
            folders.mark(done)
        except Exception as error:
            _put_back(folders, old, target, aside, error)
            raise
    with suppress(Exception):  # the day is published; the rest goes with the run's folder
        folders.delete(new)
        folders.delete(old)


def _put_back(folders, old: str, target: str, aside: str, error: Exception) -> None:
    try:
        if folders.exists(old):
            folders.place(old, target)
        if folders.marked(aside):
            folders.unmark(aside)
    except Exception:
        raise KeptAside(_said(error), old) from error


def _said(error: Exception) -> str:
    java = getattr(error, "java_exception", None)
    return java.toString() if java is not None else f"{type(error).__name__}: {error}"


def _outcome(folders, run: str, root: str, day: dict) -> dict:
    """Publish one row of (day key, folder, empty); the outcome as a row."""
    row = {c: day[c] for c in DAY_KEY} | {"error": None, "kept": None}
    try:
        publish_day(folders, run, root, day["folder"], day["empty"])
    except KeptAside as error:
        row |= {"error": str(error), "kept": error.where}
    except Exception as error:
        row |= {"error": _said(error)}
    return row


def _by_tasks(days: DataFrame, run: str, root: str, path: str) -> DataFrame:
    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the folder of a day holds signs that a URI would read as escapes, so it joins the plain path
        system, base = file_system(root)
        own = f"{base}/{run.rsplit('/', 1)[1]}"
        folders = ArrowFolders(system)
        for batch in batches:
            rows = [_outcome(folders, own, base, day) for day in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, _OUTCOME)

    tasks = max(1, min(-(-days.count() // DAYS_PER_TASK), MAX_TASKS))
    return stage(days.repartition(tasks).mapInArrow(publish, _OUTCOME_DDL), "published", path)


def _by_threads(days: DataFrame, run: str, root: str, path: str) -> DataFrame:
    spark = days.sparkSession
    folders, rows = HadoopFolders(spark, root), days.toLocalIterator()
    spark.createDataFrame([], _OUTCOME_DDL).write.parquet(path)
    with ThreadPoolExecutor(THREADS) as pool:
        while chunk := [r.asDict() for r in islice(rows, CHUNK)]:
            found = list(pool.map(lambda day: _outcome(folders, run, root, day), chunk))
            told = [tuple(row[f.name] for f in _OUTCOME) for row in found]
            spark.createDataFrame(told, _OUTCOME_DDL).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(_OUTCOME_DDL).parquet(path)


def tasks_can_publish(spark: SparkSession, root: str) -> bool:
    """Whether Arrow reaches the file system, and no task runs twice at the same time."""
    if spark.conf.get("spark.speculation", "false").lower() == "true":
        return False
    try:
        file_system(root)
    except (OSError, ValueError, NotImplementedError):  # pa.ArrowInvalid is a ValueError
        return False
    return True


def publish_days(days: DataFrame, run: str, root: str, path: str | None = None) -> DataFrame:
    """Publish (day key, empty) from ``run`` to ``root``; per day its error, or null.

    The outcomes are written to ``path`` as the days are published. ``kept`` names the folder of
    old files that could not be put back.
    """
    spark = days.sparkSession
    folder = day_folder(*(F.col(c) for c in ["symbol", "interval", "date"]))
    listed = days.select(*DAY_KEY, F.coalesce("empty", F.lit(False)).alias("empty"), folder.alias("folder"))
    path = path or shared_path(spark, "published")
    publish = _by_tasks if tasks_can_publish(spark, root) else _by_threads
    outcomes = publish(listed, run, root, path)
    spark.catalog.refreshByPath(root)
    return outcomes
