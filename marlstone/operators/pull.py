"""The pull stage: originals of planned assets, some at once in each task, each row with its own outcome."""

from __future__ import annotations

import os
import posixpath
import urllib.request
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.files import located

AT_ONCE = 4  # downloads in flight for each task


def fetch_uri(uri: str, headers: dict[str, str] | None = None, timeout: float = 30.0) -> bytes:
    """The bytes behind an http(s) URL (redirects are followed), another URI or a path."""
    if uri.startswith(("http://", "https://")):
        with urllib.request.urlopen(urllib.request.Request(uri, headers=headers or {}), timeout=timeout) as got:
            return got.read()
    system, path = located(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def put(folder: str, name: str, body: bytes) -> None:
    """Writes one file under a name of this attempt, then renames it; nothing is left behind if that fails."""
    system, base = located(folder)
    part, target = posixpath.join(base, f".{name}.{uuid.uuid4().hex}.part"), posixpath.join(base, name)
    try:
        with system.open_output_stream(part, compression=None) as out:
            out.write(body)
        if isinstance(system, fs.LocalFileSystem):
            os.replace(part, target)
        else:
            system.move(part, target)
    except BaseException:
        if system.get_file_info(part).type != fs.FileType.NotFound:
            system.delete_file(part)
        raise


def in_order(rows: Iterator[tuple], work: Callable[..., object], at_once: int) -> Iterator[tuple[tuple, Exception | None]]:
    """(row, error) in order of the rows; no more than ``at_once`` are begun before the oldest is taken."""
    with ThreadPoolExecutor(at_once) as pool:
        ahead: deque[tuple[tuple, Future]] = deque()
        for row in rows:
            if len(ahead) == at_once:
                first, done = ahead.popleft()
                yield first, done.exception()
            ahead.append((row, pool.submit(work, *row)))
        while ahead:
            first, done = ahead.popleft()
            yield first, done.exception()


def pull(planned: DataFrame, fetch: Callable[[str], bytes], folder: str, at_once: int = AT_ONCE) -> DataFrame:
    """Carries out a plan (``pull_plan``: id, basename, action): adds status and error.

    Rows to fetch are downloaded and stored in ``folder`` under their basename; status
    is downloaded, skipped or failed (collisions fail). A download that fails is that
    row's error and leaves no file. A task holds at most ``at_once`` bodies. A task
    that runs again stores the same files again, each by one rename. Reading the
    result twice pulls twice: write it, or settle it, first.
    """
    system, base = located(folder)
    system.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def store(key: str, name: str) -> None:
            put(folder, name, fetch(key))

        for batch in batches:
            asked = zip(batch.column("__key").to_pylist(), batch.column("basename").to_pylist())
            errors = [None if e is None else f"{type(e).__name__}: {e}" for _, e in in_order(asked, store, at_once)]
            yield batch.set_column(batch.schema.get_field_index("error"), "error", pa.array(errors, pa.string()))

    rows = planned.withColumn("__key", F.col("id").cast("string")).withColumn("error", F.when(F.col("action") == "collision", F.concat(F.lit("file already written: "), "basename")))
    wanted = F.col("action") == "fetch"
    got = rows.filter(wanted).mapInArrow(run, rows.schema)
    out = got.union(rows.filter(~F.coalesce(wanted, F.lit(False))))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("action") == "skip", "skipped").otherwise("downloaded")
    return out.withColumn("status", status).withColumn("warning", F.when(F.col("error").isNull(), F.col("warning"))).drop("__key")


def pull_summary(pulled: DataFrame) -> DataFrame:
    """One row: downloaded, skipped, failed."""
    return pulled.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("downloaded", "skipped", "failed")])
