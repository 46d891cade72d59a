"""A sink for many small files: staged by tasks, committed once, then published by links (elsewhere than on a local disk, by moves).

Spark runs a task again after a failure, and may run two copies of one at once. So
no task writes a target. Each attempt stages its files in a folder of its own; the
driver's commit names the attempts that count, one for each partition, and only then
a second job moves their files into place. That job may run again at any time: a
file that has been moved stays. If the first job fails, its staging folder goes and
no target was touched.

Where files come and go in rounds, the folders of a finished round can be kept as spare
ones (``spare_folders``), whose files later attempts write over: on a local disk making
and deleting a small file can cost ten times what writing and moving one does.
"""

from __future__ import annotations

import errno
import json
import os
import posixpath
import random
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from marlstone.sources.shared import settle, shared_folder

FOLDER_FILES = 1000  # staged files in one folder
LISTED = pa.schema([("staged", pa.string()), ("target", pa.string())])


def located(place: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(place))


@dataclass
class Staged(WriterCommitMessage):
    """An attempt that has staged all its files: the list of them, and how many."""

    listing: str
    files: int


def removed(folder: str, tries: int = 20) -> None:
    """Removes a staging folder; tasks that are being stopped may still put files into it meanwhile."""
    system, base = located(folder)
    for k in range(tries):
        if system.get_file_info(base).type == fs.FileType.NotFound:
            return
        try:
            system.delete_dir(base)
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(0.05 * (k + 1))


class _Stage:
    """The staged files of one attempt: new ones, FOLDER_FILES to a folder, or the files of spare folders, each of which one rename takes over."""

    def __init__(self, system: fs.FileSystem, own: str, spare: str | None):
        self.system, self.own, self.spare = system, own, spare
        self.local = isinstance(system, fs.LocalFileSystem)
        self.names: list[str] = []
        self.folders = 0
        self.made = False  # whether the next names are those of spare files
        system.create_dir(own, recursive=False)  # no attempt brings back a folder that an abort has removed

    def _taken(self, folder: str) -> list[str] | None:
        there = os.listdir(self.spare) if self.spare else []
        random.shuffle(there)  # attempts take their folders at once
        for name in there:
            try:
                os.rename(f"{self.spare}/{name}", folder)
            except FileNotFoundError:
                if not os.path.isdir(self.own):
                    raise  # an abort has removed it
                continue
            return [f"{folder}/{x}" for x in os.listdir(folder)]
        return None

    def _next(self) -> str:
        while not self.names:
            folder = f"{self.own}/{self.folders}"
            self.folders += 1
            taken = self._taken(folder)
            self.made = taken is not None
            if taken is None:
                self.system.create_dir(folder, recursive=False)
                taken = [f"{folder}/{k}" for k in reversed(range(FOLDER_FILES))]
            self.names = taken
        return self.names.pop()

    def put(self, body: memoryview) -> str:
        path = self._next()
        if self.local:
            h = os.open(path, os.O_WRONLY | (0 if self.made else os.O_CREAT), 0o666)
            try:
                left = body
                while left:
                    left = left[os.write(h, left) :]
                if self.made:
                    os.ftruncate(h, len(body))
            finally:
                os.close(h)
        else:
            with self.system.open_output_stream(path, compression=None) as out:
                out.write(body)
        return path


class _StagingWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, failing: int | None, spare: str | None = None):
        self.folder, self.failing, self.spare = folder, failing, spare

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        import pyarrow.parquet as pq

        task = TaskContext.get()
        system, base = located(self.folder)
        own = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        stage = _Stage(system, own, self.spare)
        n = 0
        listing = f"{own}/files.parquet"
        with pq.ParquetWriter(listing, LISTED, filesystem=system) as listed:
            for batch in iterator:
                staged = []
                for body in batch.column("body"):
                    staged.append(stage.put(memoryview(body.as_buffer() if body.is_valid else b"")))
                    n += 1
                    if self.failing == task.partitionId():
                        raise OSError("rehearsed failure of a task")
                listed.write_batch(pa.record_batch([pa.array(staged, pa.string()), batch.column("target").cast(pa.string())], schema=LISTED))
        return Staged(listing, n)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = located(self.folder)
        done = [m.listing for m in messages if m is not None and m.files]
        with system.open_output_stream(f"{base}/committed.json.part") as out:
            out.write(json.dumps(done).encode())
        system.move(f"{base}/committed.json.part", f"{base}/committed.json")

    def abort(self, messages: list[Staged | None]) -> None:
        removed(self.folder)


class StagedFiles(DataSource):
    """Sink "marlstone_files" of rows (target string, body binary); options folder: where attempts stage, spare: folders of files they may write over."""

    @classmethod
    def name(cls) -> str:
        return "marlstone_files"

    def schema(self) -> str:
        return "target string, body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        failing = self.options.get("failing")
        return _StagingWriter(self.options["folder"], None if failing is None else int(failing), self.options.get("spare"))


def _publish(overwrite: bool):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = fs.LocalFileSystem()
        for batch in batches:
            status = []
            for staged, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = (local, target) if target.startswith("/") and "://" not in target else located(target)
                status.append(place(system, staged, path, overwrite))
            yield pa.record_batch([batch.column(1), pa.array(status, pa.string())], names=["target", "status"])

    return move


def listed_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path) of the files below ``root``, without hidden ones, settled in the shared folder.

    Tasks list the folders of each level, so the driver sees folders only, and files
    aren't dealt out by their bytes: many small ones don't make many tasks.
    """
    system, base = located(root)
    prefix = "file:" if isinstance(system, fs.LocalFileSystem) else root[: root.index(base)]

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f for f in located(root)[0].get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith((".", "_"))]
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.record_batch([pa.array([f.path for f in some], pa.string()), pa.array([f.type == fs.FileType.Directory for f in some])], names=["path", "folder"])

    levels, folders = [], [base]
    while folders:
        tasks = min(len(folders), spark.sparkContext.defaultParallelism)
        level = settle(spark.createDataFrame([(f,) for f in folders], "path string").repartition(tasks).mapInArrow(listing, "path string, folder boolean"), "listed")
        levels.append(level.filter("not folder"))
        folders = [r[0] for r in level.filter("folder").select("path").collect()] if recursive else []
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    return every.select(F.concat(F.lit(prefix), "path").alias("path"))


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _dealt(files: DataFrame) -> DataFrame:
    """Paths over all cores, and over more tasks where one would get over 20,000."""
    return files.repartition(max(_tasks(files.sparkSession), files.count() // 20_000), "path")


def contents(files: DataFrame, at_once: int = 1 << 24) -> DataFrame:
    """(path, content) of files (path); a task holds some ``at_once`` bytes, or one larger file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            bodies: list[bytes] = []
            held = 0
            for path in batch.column(0).to_pylist():
                if path.startswith("file:/"):
                    with open(path[5:], "rb", buffering=0) as f:
                        bodies.append(f.read())
                else:
                    system, place = located(path)
                    with system.open_input_stream(place, compression=None) as f:
                        bodies.append(f.read())
                names.append(path)
                held += len(bodies[-1])
                if len(names) == 500 or held > at_once:
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])
                    names, bodies, held = [], [], 0
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])

    return _dealt(files.select("path")).mapInArrow(read, "path string, content binary")


def spare_folders(files: DataFrame, pool: str) -> None:
    """Moves the folders of files (path) that nobody needs any more below ``pool``, for ``write_files(spare=pool)``; elsewhere than on a local disk the files are deleted.

    They must hold files of finished jobs only: an attempt that was given up may still have its own open.
    """
    system, base = located(pool)
    if not isinstance(system, fs.LocalFileSystem):
        return delete_files(files)
    os.makedirs(base, exist_ok=True)
    folders = [r[0].removeprefix("file:") for r in files.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]
    for folder in sorted(folders, key=len, reverse=True):  # inner ones first
        os.rename(folder, f"{base}/{uuid.uuid4().hex}")


def delete_files(files: DataFrame) -> None:
    """Deletes files (path) by many tasks; one that has gone is no error."""

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = (fs.LocalFileSystem(), path[5:]) if path.startswith("file:/") else located(path)
                try:
                    system.delete_file(place)
                except FileNotFoundError:
                    pass
            yield batch

    _dealt(files.select("path")).mapInArrow(delete, "path string").write.format("noop").mode("overwrite").save()


def _linked(staged: str, target: str, overwrite: bool) -> str:
    """A link first, also where a file may be replaced: a disk does renames between folders one at a time."""
    try:
        os.link(staged, target)  # fails if the target is there, whoever made it
    except FileExistsError:
        if not os.path.samefile(staged, target):  # the same file: an earlier run was stopped after its link
            if not overwrite:
                return "exists"
            os.replace(staged, target)
            return "written"
    except OSError as e:
        if not overwrite or e.errno not in (errno.EPERM, errno.ENOTSUP, errno.EMLINK):  # a disk without links
            raise
        os.replace(staged, target)
        return "written"
    os.unlink(staged)
    return "written"


def place(system: fs.FileSystem, staged: str, target: str, overwrite: bool) -> str:
    """Moves a staged file to its target: "written", or "exists" if something else is there and must stay."""
    if isinstance(system, fs.LocalFileSystem):
        try:
            return _linked(staged, target, overwrite)
        except FileNotFoundError:
            pass  # no folder yet, or moved before
    here = system.get_file_info([staged, target])
    if here[0].type == fs.FileType.NotFound:
        return "written"  # an earlier run of this task moved it
    if isinstance(system, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(target), exist_ok=True)
        return place(system, staged, target, overwrite)
    if here[1].type != fs.FileType.NotFound and not overwrite:
        return "exists"
    system.create_dir(posixpath.dirname(target))
    system.move(staged, target)
    return "written"


def write_files(rows: DataFrame, overwrite: bool = True, staging: str | None = None, attempts: int = 2, failing: int | None = None, spare: str | None = None) -> DataFrame:
    """Writes ``body`` (binary or string) of each row to ``target`` (path or URI); returns (target, status).

    status is "written", or "exists" where ``overwrite`` is off and a file was there
    before. Two rows with one target are an error, found before anything is moved.
    ``staging`` must be on the targets' file system (default: the shared folder). A
    job that fails is repeated up to ``attempts`` times, with a new staging folder;
    ``failing`` makes the first one fail in that partition after its first file.
    ``spare`` (on a local disk) is a pool of ``spare_folders``, whose files are written over first.
    """
    spark = rows.sparkSession
    spark.dataSource.register(StagedFiles)
    rows = rows.select(F.col("target").cast("string").alias("target"), F.col("body").cast("binary").alias("body"))
    if failing is None:  # a file's work is in its creation, not in its bytes, by which partitions are made
        rows = rows.repartition(_tasks(spark), "target")
    for k in range(attempts):
        folder = f"{staging}/staging-{uuid.uuid4().hex}" if staging else shared_folder(spark, "staging")
        system, base = located(folder)
        system.create_dir(base)
        writer = rows.write.format("marlstone_files").mode("append").option("folder", folder)
        if spare and isinstance(system, fs.LocalFileSystem):
            os.makedirs(located(spare)[1], exist_ok=True)
            writer = writer.option("spare", located(spare)[1])
        try:
            (writer.option("failing", str(failing)) if failing is not None and k == 0 else writer).save()
            return publish(spark, folder, overwrite, spare)
        except Exception:
            if k + 1 == attempts:
                raise
    raise ValueError("attempts must be at least 1")


def publish(spark: SparkSession, folder: str, overwrite: bool, spare: str | None = None) -> DataFrame:
    """Moves the files of a committed staging folder to their targets; may be run again if it was interrupted. What is left of committed attempts goes back to ``spare``."""
    system, base = located(folder)
    with system.open_input_stream(f"{base}/committed.json") as f:
        listings = json.loads(f.read())
    if not listings:
        return spark.createDataFrame([], "target string, status string")
    scheme = folder[: folder.index(base)] if base in folder else ""
    listed = spark.read.schema("staged string, target string").parquet(*[scheme + x for x in listings])
    twice = listed.groupBy("target").count().filter("count > 1").select("target").first()
    if twice:
        system.delete_dir(base)
        raise ValueError(f"two rows for one file: {twice[0]}")
    done = settle(listed.repartition(_tasks(spark), "target").mapInArrow(_publish(overwrite), "target string, status string"), "published")
    for attempt in [posixpath.dirname(x) for x in listings] if spare and isinstance(system, fs.LocalFileSystem) else []:
        for left in [f.path for f in os.scandir(attempt) if f.is_dir()]:
            try:
                os.rmdir(left)
            except OSError:  # not empty
                os.rename(left, f"{located(spare)[1]}/{uuid.uuid4().hex}")
    removed(folder)
    return done


def sidecar_target(path, suffix: str):
    """``.txt`` replaces the image's suffix, others (``.xmp``) are added to it."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "") if suffix == ".txt" else path, F.lit(suffix))
