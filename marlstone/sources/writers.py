"""Writers and the projections they write."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.sources.files import located, sidecar_target, write_files

CSV_COLUMNS = ["name", "final_caption", "selected_category", "backend_name", "training", "zeroshot", "raw_tags", "raw_prose"]


def csv_rows(results: DataFrame) -> DataFrame:
    """The fixed columns of a CSV export; training and zeroshot come out of the variants, "" if missing."""
    variant = lambda k: F.coalesce(F.try_element_at("caption_variants", F.lit(k)), F.lit("")).alias(k)
    return results.select("name", "final_caption", "selected_category", "backend_name", variant("training"), variant("zeroshot"), "raw_tags", "raw_prose")


def json_rows(results: DataFrame) -> DataFrame:
    """(value) one JSON object per row, nulls included."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def json_array(results: DataFrame, path: str, order: str | None = None, single: str | None = None) -> None:
    """One JSON array of all rows, in ``order`` (else as they come), written by many tasks.

    Rows are numbered by range partitions and offsets; the first one opens the array,
    each later one begins with a comma, and a last row closes it. So the part files
    are the array when read one after the other, which no task has to hold. ``single``
    names one file into which a commit step then streams the parts, by one rename.
    """
    from marlstone.operators.batch import image_index

    spark = results.sparkSession
    ordered = results if order else results.withColumn("__order", F.monotonically_increasing_id())
    numbered = image_index(ordered, order or "__order")
    row = F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"})
    lines = numbered.select(F.col("image_index").alias("at"), F.concat(F.when(F.col("image_index") == 0, "[").otherwise(","), row).alias("value"))
    count = numbered.count()
    end = spark.range(1).select(F.lit(count).cast("long").alias("at"), F.lit("]" if count else "[]").alias("value"))
    lines.union(end).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)
    if single:
        join_parts(path, single)


def join_parts(folder: str, target: str) -> None:
    """Streams a folder's part files, in order, into one file that appears at once."""
    system, base = located(folder)
    out_system, out = located(target)
    parts = sorted(f.path for f in system.get_file_info(fs.FileSelector(base)) if posixpath.basename(f.path).startswith("part-"))
    name = f"{out}.{uuid.uuid4().hex}.part"
    with out_system.open_output_stream(name, compression=None) as joined:
        for part in parts:
            with system.open_input_stream(part) as f:
                while chunk := f.read(1 << 20):
                    joined.write(chunk)
    out_system.move(name, out)


def export(results: DataFrame, path: str, fmt: str) -> None:
    """txt (one sidecar per image), jsonl, json (part files that make up one array) or csv."""
    if fmt == "txt":
        write_sidecars(results.select(F.col("path"), F.col("final_caption").alias("text")), ".txt")
    elif fmt == "jsonl":
        json_rows(results).write.text(path)
    elif fmt == "json":
        json_array(results, path)
    elif fmt == "csv":
        csv_rows(results).write.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: txt, json, jsonl or csv")


def write_sidecars(rows: DataFrame, suffix: str, overwrite: bool | None = None, staging: str | None = None) -> DataFrame:
    """Writes rows (path, text) beside their images, through the staged sink; returns (target, status).

    ``.txt`` replaces the image's suffix, others are added to it. Captions are
    replaced by default, metadata isn't, as it may hold what others wrote: if a file
    is there, all others are written and an error names one.
    """
    overwrite = suffix == ".txt" if overwrite is None else overwrite
    done = write_files(rows.select(sidecar_target(F.col("path"), suffix).alias("target"), F.coalesce("text", F.lit("")).alias("body")), overwrite, staging)
    there = done.filter("status = 'exists'").select("target").first()
    if there:
        raise FileExistsError(f"FileExistsError: {there[0]}")
    return done


# The packet of a metadata sidecar.
XMP_HEAD = '''<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/">
 <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
  <rdf:Description rdf:about=""
    xmlns:dc="http://purl.org/dc/elements/1.1/">
   <dc:subject>
    <rdf:Bag>
'''
XMP_MIDDLE = '''
    </rdf:Bag>
   </dc:subject>
   <dc:description>
    <rdf:Alt>
     <rdf:li xml:lang="x-default">'''
XMP_TAIL = '''</rdf:li>
    </rdf:Alt>
   </dc:description>
  </rdf:Description>
 </rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>
'''


def xmp(description: Column, keywords: Column) -> Column:
    items = F.array_join(F.transform(keywords, lambda k: F.concat(F.lit("     <rdf:li>"), T.xmp_text(k), F.lit("</rdf:li>"))), "\n")
    return F.concat(F.lit(XMP_HEAD), items, F.lit(XMP_MIDDLE), T.xmp_text(description), F.lit(XMP_TAIL))


def write_back(results: DataFrame, send: Callable[[str, str, list[str]], None]) -> DataFrame:
    """Sends (id, description, keywords) to a remote service; rows with neither are skipped; returns (id, error)."""
    rows = results.select("id", F.coalesce("final_caption", F.lit("")).alias("d"), T.tag_list(F.coalesce("raw_tags", F.lit(""))).alias("k")).filter("d <> '' or size(k) > 0")

    def run(batches):
        for batch in batches:
            errors = []
            for i, d, k in zip(batch["id"], batch["d"], batch["k"]):
                try:
                    send(i, d, list(k))
                    errors.append(None)
                except Exception as e:  # one row's failure is its own result
                    errors.append(str(e))
            yield batch[["id"]].assign(error=errors)

    return rows.mapInPandas(run, "id string, error string")


def provenance_json(p: Column) -> Column:
    return F.to_json(p, {"ignoreNullFields": "false"})


def keywords(raw_tags: Column) -> Column:
    return T.tag_list(F.coalesce(raw_tags, F.lit("")))


# A step of the write-back: (id, description, keywords) -> None; raises if the service refuses.
Step = Callable[[str, str, list[str]], None]
STEPS = ("description", "tags", "assign")


def write_back_steps(results: DataFrame, steps: dict[str, Step], ledger: str, batch_id: int) -> DataFrame:
    """Sends results (id, final_caption, raw_tags) to a service in the order of STEPS; returns (id, steps_done, error).

    description is left out without a caption, tags and assign without keywords; a
    row with neither sends nothing. The first step that fails ends its row. Rows that
    the ledger holds as finished in this batch aren't sent again, so that a batch of
    a stream (foreachBatch) may run again: use each batch's number. A task that dies
    midway repeats the rows it hadn't finished, so each step must bear repetition.
    """
    spark = results.sparkSession
    done = f"{ledger}/{batch_id}"
    rows = results.select("id", F.coalesce("final_caption", F.lit("")).alias("description"), keywords(F.col("raw_tags")).alias("keywords"))
    system, base = located(done)
    if system.get_file_info(base).type == fs.FileType.Directory:
        sent = spark.read.parquet(f"{done}/*").filter("error is null").select("id")
        rows = rows.join(sent, "id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, words in zip(*(c.to_pylist() for c in batch.columns)):
                through, error = [], None
                for step in STEPS:
                    if not (text if step == "description" else words):
                        continue
                    try:
                        steps[step](i, text, words)
                        through.append(step)
                    except Exception as e:  # one row's failure is its own result
                        error = f"{step}: {type(e).__name__}: {e}"
                        break
                yield pa.record_batch([pa.array([i], pa.string()), pa.array([through], pa.list_(pa.string())), pa.array([error], pa.string())], names=["id", "steps_done", "error"])

    got = rows.select(F.col("id").cast("string").alias("id"), "description", "keywords").mapInArrow(run, "id string, steps_done array<string>, error string")
    part = f"{done}/{uuid.uuid4().hex}"
    got.write.parquet(part)  # the ledger's lines: written once, then read
    return spark.read.schema("id string, steps_done array<string>, error string").parquet(part)
