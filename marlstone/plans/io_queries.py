"""Queries that write files, list, pull, ask and stream, and read back what came of it; with their SQL.

Everything they write is made from the given tables and lies in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import assembly as A
from marlstone.operators import batch as B
from marlstone.operators import contradiction as C
from marlstone.operators import evaluation as E
from marlstone.operators import pull as P
from marlstone.operators import verify as Q
from marlstone.operators.inference import caption_or_tags, infer
from marlstone.plans import caption_queries as CQ
from marlstone.plans import sqltext as S
from marlstone.plans.bridge import SQL_CAPTIONS, SQL_TAG_ROWS, captions, table, tag_rows
from marlstone.sources import images as I
from marlstone.sources import readers as R
from marlstone.sources import writers as W
from marlstone.sources.files import contents, listed_files, located, spare_folders, write_files
from marlstone.sources.listing import paged_listing
from marlstone.sources.shared import settle, shared_folder
from marlstone.streaming import progress as G

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark, root: str) -> DataFrame:
    return contents(listed_files(spark, root))


def _base(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


def _ordered_file(lines: DataFrame, order: str, name: str) -> str:
    """One text file of the column value, in order, written by many tasks."""
    folder = shared_folder(lines.sparkSession, name)
    lines.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(folder)
    W.join_parts(folder, f"{folder}.txt")
    return f"{folder}.txt"


# sidecars


SLICE = 250_000  # images whose sidecars lie on the disk at once

_PACKET = f"""'{W.XMP_HEAD}' || array_to_string(list_transform({S.pieces('tags', ',')}, lambda k: '     <rdf:li>' || k || '</rdf:li>'), chr(10)) || '{W.XMP_MIDDLE}' || prose || '{W.XMP_TAIL}'"""


@query(f"""{SQL_CAPTIONS} SELECT image_id, 'txt' AS kind, md5(prose) AS digest FROM cap
UNION ALL SELECT image_id, 'xmp', CASE WHEN image_id % 9 = 0 THEN md5('theirs') ELSE md5({_PACKET}) END FROM cap WHERE image_id % 3 = 0
UNION ALL SELECT NULL, 'other', NULL WHERE false""")
def sidecar_files(spark, d):
    """Captions beside their images, through a task that fails once; metadata that was there before stays. All files are read back.

    A small file takes a block of the disk, so images come in slices; once the digests
    of one are kept, its files are spare ones, which the next slice writes over. Those
    of the last one stay in the shared folder, like other scratch files.
    """
    made, digests, pool = (shared_folder(spark, name) for name in ("captions", "digests", "spare"))
    slices = max(1, -(-table(spark, d, "orders").count() // SLICE))
    rows = captions(spark, d).select("image_id", "prose", "tags", F.pmod(F.xxhash64("image_id"), F.lit(slices)).cast("int").alias("slice"))
    rows.write.partitionBy("slice").parquet(made)
    for n, (k,) in enumerate(spark.read.parquet(made).select("slice").distinct().orderBy("slice").collect()):
        root = shared_folder(spark, "gallery")
        path = F.concat(F.lit(f"{root}/"), (F.col("image_id") % 100).cast("string"), F.lit("/"), F.col("image_id").cast("string"), F.lit(".png"))
        part = spark.read.schema("image_id long, prose string, tags string").parquet(f"{made}/slice={k}").repartition(spark.sparkContext.defaultParallelism, "image_id").withColumn("path", path)
        xmp = part.filter("image_id % 3 = 0").select("image_id", F.concat("path", F.lit(".xmp")).alias("target"), W.xmp(F.col("prose"), W.keywords(F.col("tags"))).alias("body"))
        theirs = xmp.filter("image_id % 9 = 0").select("target", F.lit("theirs").alias("body"))
        texts = part.select(F.regexp_replace("path", "png$", "txt").alias("target"), F.col("prose").alias("body"))
        write_files(texts.union(theirs), failing=None if n else 0, spare=pool)
        write_files(xmp, overwrite=False, spare=pool)
        files = listed_files(spark, root)
        name = _base()
        kind = F.when(name.rlike(r"^\d+\.txt$"), "txt").when(name.rlike(r"^\d+\.png\.xmp$"), "xmp").otherwise("other")
        found = contents(files).select(F.regexp_extract(name, r"^\d+", 0).try_cast("long").alias("image_id"), kind.alias("kind"), F.md5("content").alias("digest"))
        found.write.mode("append").parquet(digests)
        spare_folders(files, pool)
    return spark.read.schema("image_id long, kind string, digest string").parquet(digests)


_ROWS = """r AS (SELECT o_orderkey AS idx, o_custkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'model failed' END AS failed,
  CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN '.jpg' ELSE '.png' END AS ext, CASE WHEN o_orderkey % 5 = 0 THEN '/x/d/../' ELSE '/x/' END AS dir FROM orders),
h AS (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY k, failed IS NULL ORDER BY idx) AS nt FROM r)"""
_BOTH = f"""WITH {_ROWS}, u AS (SELECT *, CASE WHEN failed IS NOT NULL THEN failed WHEN nt > 1 THEN 'sidecar already written: ' || k || '.txt' END AS e1 FROM t),
o AS (SELECT idx, CASE WHEN e1 IS NULL THEN '/x/' || k || '.txt' END AS sidecar,
  CASE WHEN e1 IS NULL AND NOT (ext = '.jpg' AND k IN (FROM h)) THEN dir || k || ext || '.xmp' END AS xmp_path,
  CASE WHEN e1 IS NOT NULL THEN e1 WHEN ext = '.jpg' AND k IN (FROM h) THEN 'metadata exists: ' || k || ext || '.xmp (its .txt sidecar was written)' END AS error FROM u)"""
_XMP = f"""WITH {_ROWS}, x AS (SELECT *, row_number() OVER (PARTITION BY k, ext, failed IS NULL ORDER BY idx) AS nx FROM r),
o AS (SELECT idx, CAST(NULL AS VARCHAR) AS sidecar, CASE WHEN failed IS NULL AND nx = 1 THEN dir || k || ext || '.xmp' END AS xmp_path,
  CASE WHEN failed IS NOT NULL THEN failed WHEN nx > 1 THEN 'metadata already written: ' || k || ext || '.xmp' END AS error FROM x)"""


def _manifest(spark, d, **how) -> DataFrame:
    i, k = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    path = F.concat(F.when(i % 5 == 0, "/x/d/../").otherwise("/x/"), k, F.when(i % 5 < 3, ".jpg").otherwise(".png"))
    rows = table(spark, d, "orders").select(i.alias("idx"), path.alias("path"), F.when(i % 11 == 0, "model failed").alias("error"))
    there = table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("/x/./"), F.col("c_custkey").cast("string"), F.lit(".jpg.xmp")).alias("path"))
    return B.manifest_outcomes(rows, there, **how)


@query(f"{_BOTH} SELECT * FROM o")
def manifest_outcomes(spark, d):
    """Both sidecars, metadata of others kept: images that share a stem, and one image spelled in two ways."""
    return _manifest(spark, d, write_xmp=True, xmp_overwrite=False).select("idx", "sidecar", "xmp_path", "error")


@query(f"{_XMP} SELECT * FROM o")
def manifest_metadata(spark, d):
    """Metadata sidecars only: here the order of rows decides by image, not by stem."""
    return _manifest(spark, d, write_txt=False, write_xmp=True).select("idx", "sidecar", "xmp_path", "error")


def _totals(cte: str, mode: str) -> str:
    return f"SELECT '{mode}' AS mode, * FROM ({cte} SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS captioned, count(error) AS failed, count(xmp_path) AS xmp_written FROM o)"


@query(f"{_totals(_BOTH, 'both')} UNION ALL {_totals(_XMP, 'metadata')}")
def manifest_totals(spark, d):
    both = B.summary(_manifest(spark, d, write_xmp=True, xmp_overwrite=False)).select(F.lit("both").alias("mode"), "*")
    return both.union(B.summary(_manifest(spark, d, write_txt=False, write_xmp=True)).select(F.lit("metadata").alias("mode"), "*"))


# listings


_UPDATED = "CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id // 7 * 1000) END"
_LISTED = f"SELECT CAST(page_id AS VARCHAR) AS id, strftime({_UPDATED}, '%Y-%m-%dT%H:%M:%S.000Z') AS updated_at FROM pages"
_services: dict[str, list[tuple[str, str]]] = {}  # listings of the service below, read once by each worker


def _service(spark, d):
    """A listing service over the pages: a third of them were updated at one instant."""
    at = F.when(F.col("page_id") % 3 == 0, F.lit("2024-03-01T00:00:00.000Z")).otherwise(
        F.date_format(F.timestamp_seconds(F.unix_timestamp(F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).cast("timestamp")) + F.floor(F.col("page_id") / 7) * 1000), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    )
    folder = shared_folder(spark, "service")
    table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), at.alias("updated_at")).write.parquet(folder)

    def fetch(page: int, size: int, after: str | None, before: str | None) -> dict:
        from bisect import bisect_left

        from marlstone.plans.io_queries import _services  # the worker's own: a sent function's globals are new in each task

        if folder not in _services:
            import pyarrow.dataset as ds

            system, path = located(folder)
            rows = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=True).to_table()
            _services[folder] = sorted(zip(rows.column("updated_at").to_pylist(), rows.column("id").to_pylist()))
        rows = _services[folder]
        begin, end = bisect_left(rows, (after or "",)), bisect_left(rows, (before,)) if before else len(rows)
        first, last = begin + (page - 1) * size, begin + page * size
        return {"items": [{"id": i, "updated_at": u} for u, i in rows[first : min(last, end)]], "next_page": page + 1 if last < end else None}

    return fetch


@query(f"SELECT *, true AS several FROM ({_LISTED})")
def listing_parts(spark, d):
    """The pages through the listing source, in ranges of 40 at most; the instant that many share comes as blocks of pages."""
    spark.dataSource.register(paged_listing(_service(spark, d), size=10, most=40))
    rows = spark.read.format("paged_assets").load()
    return rows.select("id", "updated_at", F.lit(rows.select(F.spark_partition_id()).distinct().count() > 1).alias("several"))


@query(f"SELECT id, updated_at, CASE WHEN updated_at < '2024-01-01T00:50:00.000Z' THEN 0 WHEN updated_at < '2024-03-01T00:00:00.000Z' THEN 1 ELSE 2 END AS trigger FROM ({_LISTED})")
def listing_stream(spark, d):
    """The same pages as a stream of three triggers; the second ends where the shared instant begins."""
    last = table(spark, d, "pages").agg(F.coalesce(F.max("page_id"), F.lit(0))).first()[0]
    past = datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=last // 7 * 1000 + 1)  # after all updates, however many pages there are
    instants = [datetime(2024, 1, 1, 0, 50, tzinfo=UTC), datetime(2024, 3, 1, tzinfo=UTC), max(past, datetime(2024, 3, 2, tzinfo=UTC))]
    calls: list[int] = []

    def clock() -> datetime:
        calls.append(1)
        return instants[min(len(calls), len(instants)) - 1]

    spark.dataSource.register(paged_listing(_service(spark, d), size=10, most=40, clock=clock))
    out, checkpoint = shared_folder(spark, "listed"), shared_folder(spark, "listed-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("trigger", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/{batch_id}")

    q = spark.readStream.format("paged_assets").load().writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("id string, updated_at string, trigger int").parquet(f"{out}/*")


_ALBUMS = "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL"


@query(f"SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 3 = 0 THEN '' ELSE 'Album ' || k END AS name, CASE WHEN k % 4 = 0 THEN 0 ELSE n END AS asset_count FROM ({_ALBUMS})")
def album_list(spark, d):
    from marlstone.sources.listing import album_list as listed

    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    fields = F.struct(F.col("k").cast("string").alias("id"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("Album "), F.col("k").cast("string"))).alias("albumName"), F.when(F.col("k") % 4 > 0, F.col("n")).alias("assetCount"))
    return listed(n.select(F.to_json(fields).alias("value")))


_PULL_NAME = "(page_id % 200) || CASE WHEN page_id % 4 = 3 THEN '' ELSE '.jpg' END"


@query(f"""WITH a AS (SELECT page_id, html, {_PULL_NAME} AS basename, page_id % 200 % 4 = 3 AS odd FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY basename ORDER BY page_id) > 1 AS late, page_id % 200 % 5 = 0 AS have, page_id % 7 = 0 AS gone FROM a)
SELECT page_id, basename, CASE WHEN late OR (gone AND NOT have) THEN 'failed' WHEN have THEN 'skipped' ELSE 'downloaded' END AS status,
  CASE WHEN late THEN 'file already written: ' || basename WHEN gone AND NOT have THEN 'FileNotFoundError' END AS error,
  CASE WHEN late OR (gone AND NOT have) THEN NULL WHEN odd THEN 'not captionable: file has no extension' END AS warning,
  CASE WHEN late OR (gone AND NOT have) THEN NULL WHEN have THEN md5('old') ELSE md5(html) END AS digest, 0 AS strays FROM n""")
def pull_pages(spark, d):
    """Plan, fetch and store: originals of pages from a store in which one of seven is missing; what lies in the folder is read back."""
    pages = table(spark, d, "pages")
    store, folder = shared_folder(spark, "originals"), shared_folder(spark, "pulled")
    name = F.concat((F.col("page_id") % 200).cast("string"), F.when(F.col("page_id") % 4 == 3, "").otherwise(".jpg"))
    write_files(pages.filter("page_id % 7 <> 0").select(F.concat(F.lit(f"{store}/"), F.col("page_id").cast("string")).alias("target"), F.col("html").alias("body")))
    have = pages.filter("page_id % 200 % 5 = 0").select(name.alias("basename")).distinct()
    write_files(have.select(F.concat(F.lit(f"{folder}/"), "basename").alias("target"), F.lit("old").alias("body")))
    assets = pages.select(F.col("page_id").alias("pos"), F.concat(F.lit(f"{store}/"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("album/"), name).alias("path"))
    pulled = settle(P.pull(B.pull_plan(assets, have), P.fetch_uri, folder), "pulls")
    files = _files(spark, folder).select(_base().alias("basename"), F.md5("content").alias("digest"))
    strays = files.join(pulled.filter("status <> 'failed'"), "basename", "left_anti").count()
    out = pulled.join(files, "basename", "left")
    return out.select(
        F.col("pos").alias("page_id"), "basename", "status", F.when(F.startswith("error", F.lit("file ")), F.col("error")).otherwise(F.split_part("error", F.lit(":"), F.lit(1))).alias("error"),
        "warning", F.when(F.col("status") != "failed", F.col("digest")).alias("digest"), F.lit(strays).alias("strays"),
    )


# streams


_EVENTS = f"""{SQL_CAPTIONS}, e AS (SELECT image_id, row_number() OVER (ORDER BY image_id // 4000, image_id) AS done, (SELECT count(*) FROM cap) AS total, CASE WHEN image_id % 13 = 0 THEN 'unreadable' END AS error FROM cap)"""


@query(f"""{_EVENTS} SELECT 'progress' AS type, done, total, image_id, error, NULL AS captioned, NULL AS failed FROM e
UNION ALL SELECT 'complete', NULL, count(*), NULL, NULL, count(*) FILTER (error IS NULL), count(error) FROM e""")
def stream_progress(spark, d):
    """Events of a caption stream that stops after some files, crashes once after a batch, and is started again; then its completion.

    Images arrive in order, in deliveries of some thousands each, eight at most: a
    delivery is one micro-batch, so the number of batches doesn't grow with the images.
    """
    rows = settle(captions(spark, d).select("image_id", F.when(F.col("image_id") % 13 == 0, "unreadable").alias("error")), "stream")
    total = rows.count()
    inbox, out, state = (shared_folder(spark, n) for n in ("inbox", "progress", "progress-state"))
    schema = "image_id long, error string"
    lowest, highest = rows.select(F.min(F.floor(F.col("image_id") / 4000)), F.max(F.floor(F.col("image_id") / 4000))).first()
    parts = [] if lowest is None else range(lowest, highest + 1, max(1, -(-(highest - lowest + 1) // 8)))

    def deliver(part: int) -> None:
        rows.filter(F.floor(F.col("image_id") / 4000).between(part, part + parts.step - 1)).write.mode("append").parquet(f"{inbox}/{part:05d}")

    def start(after=None):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(inbox)
        return G.follow(stream, lambda df: df, out, state, "image_id", total, after_batch=after)

    def crash(batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("rehearsed crash after the batch was recorded")

    located(inbox)[0].create_dir(located(inbox)[1])
    for part in parts[:2]:
        deliver(part)
        try:
            start(crash).awaitTermination()
        except Exception as e:
            if "rehearsed crash" not in str(e):
                raise
    for part in parts[2:]:
        deliver(part)
        start().awaitTermination()
    start().awaitTermination()
    end = G.completion(spark, out).select("type", F.lit(None).cast("long").alias("done"), "total", F.lit(None).cast("long").alias("image_id"), F.lit(None).cast("string").alias("error"), "captioned", "failed")
    none = F.lit(None).cast("long")
    return G.events(spark, out).select("type", "done", "total", "image_id", "error", none.alias("captioned"), none.alias("failed")).union(end)


# verifiers, errors, write-back, exports


def _hinted_model():
    """A stand-in for a verifier service: it fails on postures, abstains on hats, and else names the colour in its hint."""

    def call(asked: list[dict]) -> list[str | None]:
        if any(q["kind"] == "pose" for q in asked):
            raise RuntimeError("the model can't see postures")
        hints = [dict(x.split("=") for x in q["hint"].split(";")) for q in asked]
        return [None if q["subject"] == "hat" else f"It looks {h[q['subject']]}." for q, h in zip(asked, hints)]

    return call


@query(f"""{CQ.reconciled("bad AND kind = 'color' AND subject <> 'hat'")}, fa AS (SELECT image_id, count(*) AS e FROM al WHERE bad AND kind <> 'color' GROUP BY image_id)
SELECT rw.image_id, r.p AS prose, CAST(r.n AS INTEGER) AS changes, coalesce(e, 0) AS verify_errors FROM rw LEFT JOIN fa ON rw.image_id = fa.image_id""")
def reconcile_asked(spark, d):
    """Disputes put to a verifier that fails on postures: errors are counted, and the other disputes of the image are settled. Each case is worked out once."""

    def asked(cases: DataFrame) -> DataFrame:
        hint = F.array_join(F.transform(C.disputes(F.col("tags"), F.col("prose")), lambda x: F.concat(x["subject"], F.lit("="), C.tag_prior(x))), ";")
        hinted = settle(cases.withColumn("content", F.sha2("prose", 256)).withColumn("hint", hint), "hinted")
        return Q.reconcile_asked(hinted, "case", _hinted_model, same=("content", "hint"), batch=16, tasks=spark.sparkContext.defaultParallelism)

    out = C.case_by_case(captions(spark, d).select("image_id", "tags", "prose"), asked)
    return out.select("image_id", "prose", F.size("changes").alias("changes"), "verify_errors")


@query(f"""{CQ._CARD}, mg AS (SELECT * FROM mt WHERE image_id % 13 <> 0)
SELECT (SELECT count(*) FROM mt) AS n, (SELECT count(*) FROM mt WHERE image_id % 13 = 0) AS n_errors, {CQ._R('avg(rate)')} AS contradiction_rate_mean, CAST(sum(n) AS BIGINT) AS contradiction_total,
  {CQ._R('avg(CAST(ot AS INTEGER))')} AS over_budget_pct_training, {CQ._R('avg(recall)')} AS coverage_recall_mean FROM mg""")
def scorecard_errors(spark, d):
    """A run in which a thirteenth of the images fails: inference records the error, and all means are over the rest."""
    rows = captions(spark, d).withColumn("content", F.when(F.col("image_id") % 13 != 0, F.col("prose")).cast("binary"))
    judged = infer(rows.select("image_id", "content"), "stub-prose").select("image_id", F.col("error").alias("failed"))
    run = E.with_metrics(CQ._composed(spark, d).join(judged, "image_id").withColumn("error", F.col("failed")).withColumn("expected_tags", F.slice(T.tag_list(F.concat("tags", F.lit(", blue_sky"))), 1, 4)))
    card = E.scorecard(run)
    real = ["contradiction_rate_mean", "over_budget_pct_training", "coverage_recall_mean"]
    return card.select("n", "n_errors", "contradiction_total", *[F.round(c, 9).alias(c) for c in real])


@query(f"""{SQL_CAPTIONS}, w AS (SELECT image_id, {S.pieces('tags', ',')} AS k, CASE WHEN image_id % 4 = 0 THEN '' ELSE prose END AS p, image_id % 6 = 1 AS refused FROM cap)
SELECT CAST(image_id AS VARCHAR) AS id, CASE WHEN p = '' THEN '' ELSE 'description' END || CASE WHEN len(k) = 0 THEN '' ELSE CASE WHEN p = '' THEN '' ELSE '|' END || CASE WHEN refused THEN '' ELSE 'tags|assign' END END AS steps, len(k) > 0 AND refused AS failed, 0 AS again FROM w""")
def write_back_steps(spark, d):
    """Results sent step by step to a service that refuses some tags; the batch is then replayed, which sends only what failed."""
    rows = captions(spark, d).select(F.col("image_id").cast("string").alias("id"), F.when(F.col("image_id") % 4 != 0, F.col("prose")).otherwise("").alias("final_caption"), F.col("tags").alias("raw_tags"))

    def tags(i: str, text: str, words: list[str]) -> None:
        if int(i) % 6 == 1:
            raise PermissionError("403")

    steps = {"description": lambda i, t, w: None, "tags": tags, "assign": lambda i, t, w: None}
    ledger = shared_folder(spark, "ledger")
    first = W.write_back_steps(rows, steps, ledger, 0)
    again = W.write_back_steps(rows, steps, ledger, 0).filter("error is null").count()
    return first.select("id", F.array_join(F.concat("steps_done", F.when(F.startswith("error", F.lit("tags")) & (F.size("steps_done") > 0), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "|").alias("steps"), F.col("error").isNotNull().alias("failed"), F.lit(again).alias("again"))


@query(f"""{SQL_CAPTIONS} SELECT row_number() OVER (ORDER BY image_id) AS line, image_id, md5(prose) AS digest FROM cap""")
def json_array(spark, d):
    """One JSON array from many tasks: the joined file is read in splits; brackets, commas and objects of all lines, in order, are what makes it one array."""
    rows = captions(spark, d).select("image_id", "prose", "hybrid_preset")
    folder = shared_folder(spark, "array")
    W.json_array(rows, folder, "image_id", f"{folder}.json")
    lines = R.numbered_lines(spark, f"{folder}.json")
    last, end = lines.agg(F.max(F.struct("line", "value")).alias("x")).select("x.*").first()
    if end not in ("]", "[]"):
        raise ValueError("the array isn't closed")
    opened = F.startswith("value", F.when(F.col("line") == 1, "[").otherwise(","))
    row = F.from_json(F.when(opened, F.substr("value", F.lit(2))), "image_id long, prose string, hybrid_preset string")
    inside = lines.filter(F.col("line") < last).select(F.col("line").cast("long").alias("line"), row.alias("row"))
    return inside.select("line", "row.image_id", F.md5("row.prose").alias("digest"))


# images and files


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From numbers to files: five kinds of good and damaged images, made by arithmetic."""
    import struct

    for batch in batches:
        bodies = []
        for k in batch.column(0).to_pylist():
            w, h = 1 + k % 7, 1 + k % 5
            y, x = np.mgrid[0:h, 0:w]
            rgb = np.stack([(k + 3 * x + 5 * y) % 256, (2 * k + x) % 256, (7 * k + 11 * y) % 256], axis=2).astype(np.uint8)
            kind = k % 8
            if kind == 7:
                body = f"not an image {k}".encode()
            elif kind == 6:
                line = [r[:, ::-1].tobytes() for r in rgb[::-1]]
                data = b"".join(r + b"\0" * (-len(r) % 4) for r in line)
                body = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(data), 0, 0, 54, 40, w, h, 1, 24, 0, len(data), 0, 0, 0, 0) + data
            else:
                body = I.encode_png(rgb, [y % 3 for y in range(h)])
                if kind == 4:  # one byte of the image data is flipped
                    at = body.index(b"IDAT") + 6
                    body = body[:at] + bytes([body[at] ^ 255]) + body[at + 1 :]
                elif kind == 5:
                    body = body[:-20]
            bodies.append(body)
        yield pa.record_batch([batch.column(0), pa.array(bodies, pa.binary())], names=["k", "body"])


@query("""WITH p AS (SELECT p_partkey AS k, 1 + p_partkey % 7 AS w, 1 + p_partkey % 5 AS h, p_partkey % 8 AS m FROM part),
c AS (SELECT k, avg((k + 3 * x + 5 * y) % 256) AS r, avg((2 * k + x) % 256) AS g, avg((7 * k + 11 * y) % 256) AS b FROM (SELECT k, x, unnest(range(h)) AS y FROM (SELECT k, h, unnest(range(w)) AS x FROM p)) GROUP BY k)
SELECT k, CASE WHEN m = 6 THEN 'bmp' WHEN m < 6 THEN 'png' END AS kind, CASE m WHEN 4 THEN 'bad checksum of IDAT' WHEN 5 THEN 'truncated' WHEN 7 THEN 'not an image' END AS error,
  CASE WHEN m < 7 THEN CAST(w AS INTEGER) END AS width, CASE WHEN m < 7 THEN CAST(h AS INTEGER) END AS height, CASE WHEN m IN (4, 5, 7) THEN NULL ELSE round(r, 6) || '|' || round(g, 6) || '|' || round(b, 6) END AS mean FROM p JOIN c USING (k)""")
def image_files(spark, d):
    """Files written by this query, some damaged: what they are, their size and mean colour."""
    root = shared_folder(spark, "pictures")
    made = table(spark, d, "part").select(F.col("p_partkey").alias("k")).repartition("k").mapInArrow(_pictures, "k long, body binary")
    write_files(made.select(F.concat(F.lit(f"{root}/"), (F.col("k") % 50).cast("string"), F.lit("/"), F.col("k").cast("string"), F.lit(".png")).alias("target"), "body"))
    facts = I.with_image_facts(_files(spark, root).select("path", "content"))
    mean = F.array_join(F.transform("mean_rgb", lambda v: F.round(v, 6).cast("string")), "|")
    return facts.select(F.regexp_extract(_base(), r"^\d+", 0).cast("long").alias("k"), F.col("image_kind").alias("kind"), F.col("image_error").alias("error"), "width", "height", mean.alias("mean"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 6 AS m FROM part)
SELECT k, CASE m WHEN 0 THEN k || '.bin' WHEN 1 THEN k || '.bin' WHEN 2 THEN k || '.gone' WHEN 3 THEN NULL WHEN 4 THEN NULL END AS name,
  CASE WHEN m IN (0, 1, 3) THEN sha256('content ' || k) END AS sha256, CASE m WHEN 2 THEN 'FileNotFoundError' WHEN 4 THEN 'Error' WHEN 5 THEN 'ValueError' END AS error FROM p""")
def loaded_images(spark, d):
    """Sources of several kinds: paths and URIs of files that this query writes, one kind missing, data URLs good and bad, none at all."""
    root = shared_folder(spark, "sources")
    base = located(root)[1]
    k, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    body = F.concat(F.lit("content "), k)
    parts = table(spark, d, "part")
    write_files(parts.filter("p_partkey % 6 < 2").select(F.concat(F.lit(f"{root}/"), k, F.lit(".bin")).alias("target"), body.alias("body")))
    source = (
        F.when(m == 0, F.concat(F.lit(f"{base}/"), k, F.lit(".bin"))).when(m == 1, F.concat(F.lit(f"file://{base}/"), k, F.lit(".bin"))).when(m == 2, F.concat(F.lit(f"{base}/"), k, F.lit(".gone")))
        .when(m == 3, F.concat(F.lit("data:image/png;base64,"), F.base64(body.cast("binary")))).when(m == 4, F.lit("data:image/png;base64,%%"))
    )
    got = I.load_images(parts.select(F.col("p_partkey").alias("k"), source.alias("source")).repartition("k"))
    return got.select("k", "name", "sha256", F.split_part("load_error", F.lit(":"), F.lit(1)).alias("error"))


_EXT = "(CASE o_orderkey % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '.webp' WHEN 4 THEN '.jpeg' ELSE '.tif' END)"


def _tree(spark, d) -> str:
    root = shared_folder(spark, "tree")
    k = F.col("o_orderkey").cast("string")
    rows = table(spark, d, "orders").filter("o_custkey % 5 = 0")
    write_files(rows.select(F.concat(F.lit(f"{root}/"), F.when(F.col("o_orderkey") % 4 > 0, F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit("/"))).otherwise(""), k, F.expr(_EXT)).alias("target"), F.concat(F.lit("body "), k).alias("body")))
    return located(root)[1]


_SUFFIXES = ", ".join("'" + s + "'" for s in R.V.IMAGE_SUFFIXES)


@query(f"""SELECT CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4) || '/' ELSE '' END || o_orderkey || {_EXT} AS id, o_orderkey || {_EXT} AS name, sha256('body ' || o_orderkey) AS sha256
FROM orders WHERE o_custkey % 5 = 0 AND lower({_EXT}) IN ({_SUFFIXES})""")
def scanned_images(spark, d):
    """A tree of files: images by suffix in any case, with their content's hash."""
    return R.scan_images(spark, _tree(spark, d)).select("id", "name", "sha256")


@query(f"SELECT o_orderkey || {_EXT} AS name, sha256('body ' || o_orderkey) AS sha256 FROM orders WHERE o_custkey % 5 = 0 AND o_orderkey % 4 = 0 AND {_EXT} IN ('.png', '.jpg', '.jpeg', '.webp')")
def globbed_images(spark, d):
    return R.glob_images(spark, _tree(spark, d)).select(_base().alias("name"), "sha256")


@query("""WITH l AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS n, o_orderkey % 7 AS m FROM orders)
SELECT CAST(n AS INTEGER) AS line, CASE m WHEN 0 THEN 'in' WHEN 5 THEN 'in' WHEN 6 THEN 'out' END AS place, CASE WHEN m IN (0, 5, 6) THEN k || '.jpg' END AS name, CASE WHEN m IN (0, 6) THEN 'red hat|tree ' || k ELSE '' END AS tags,
  CASE m WHEN 2 THEN 'line ' || n || ': invalid JSON' WHEN 3 THEN 'line ' || n || ': not an object' WHEN 4 THEN 'line ' || n || ': missing image' WHEN 5 THEN 'line ' || n || ': expected_tags is no list' END AS error, m IN (0, 6) AS has_labels FROM l WHERE m <> 1""")
def eval_manifest_file(spark, d):
    """An evaluation manifest written to one file: blank lines count, bad ones are named."""
    k = F.col("o_orderkey").cast("string")
    cases = [
        F.concat(F.lit('{"image": "a/'), k, F.lit('.jpg", "expected_tags": [" red hat", "", "tree '), k, F.lit('"]}')), F.lit(""), F.lit("{bad"), F.lit("[1]"), F.lit('{"notes": "x"}'),
        F.concat(F.lit('{"image": "a/'), k, F.lit('.jpg", "expected_tags": 3}')), F.concat(F.lit('{"image": "/abs/'), k, F.lit('.jpg", "expected_tags": ["red hat", "tree '), k, F.lit('"]}')),
    ]
    lines = table(spark, d, "orders").select(F.col("o_orderkey"), F.element_at(F.array(*cases), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("value"))
    rows = R.eval_manifest(spark, _ordered_file(lines, "o_orderkey", "manifest"))
    place = F.when(F.startswith("image", F.lit("/abs/")), "out").when(F.contains("image", F.lit("/a/")), "in")
    return rows.select("line", place.alias("place"), _base("image").alias("name"), F.array_join("expected_tags", "|").alias("tags"), "error", F.coalesce("has_labels", F.lit(False)).alias("has_labels"))


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey AS k FROM part)
SELECT CAST(pos AS INTEGER) AS pos, CASE k % 3 WHEN 0 THEN 'tag' || k WHEN 1 THEN 'a,b ' || k ELSE 'say "' || k || '"' END AS name, CAST(k % 10 AS INTEGER) AS category FROM l""")
def vocabulary_file(spark, d):
    """A tagger's vocabulary as a CSV file whose names hold commas and quotes."""
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("tag"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('"a,b '), k, F.lit('"'))).otherwise(F.concat(F.lit('"say ""'), k, F.lit('"""')))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("at"), F.concat(k, F.lit(","), name, F.lit(","), (F.col("p_partkey") % 10).cast("string"), F.lit(",7")).alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit("tag_id,name,category,count").alias("value"))
    return R.tagger_vocabulary(spark, _ordered_file(head.union(rows), "at", "vocabulary"))


@query(f"""WITH tr AS ({SQL_TAG_ROWS}), tg AS (SELECT image_id, string_agg(label, ', ' ORDER BY nth, part) AS labels FROM tr GROUP BY image_id)
SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 3 > 0 THEN 'prose of ' || o_orderkey ELSE coalesce(labels, '') END AS caption FROM orders LEFT JOIN tg ON image_id = o_orderkey""")
def caption_strings(spark, d):
    """What a backend's output says as one string: its prose, or its labels if there is none."""
    labels = F.array_sort(F.collect_list(F.struct("nth", "part", "label")))
    tags = tag_rows(spark, d).groupBy("image_id").agg(labels.alias("rows"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")).join(tags, "image_id", "left")
    empty = F.array().cast("array<struct<nth: int, part: bigint, label: string>>")
    prose = F.when(F.col("image_id") % 3 > 0, F.concat(F.lit("prose of "), F.col("image_id").cast("string"))).otherwise("")
    said = F.transform(F.coalesce("rows", empty), lambda r: F.struct(r["label"].alias("label")))
    return rows.select("image_id", caption_or_tags(prose, said).alias("caption"))


@query(f"{SQL_CAPTIONS} SELECT image_id, len(k) AS n, md5(array_to_string(list_sort(k), '|')) AS digest, true AS stable FROM (SELECT image_id, {S.pieces('tags', ',')} AS k FROM cap)")
def diversity_keeps_all(spark, d):
    """The diversity pass drops and reorders fragments by hashes: what it keeps and drops is what was given, the same in two runs."""
    df = captions(spark, d).select("image_id", T.tag_list(F.col("tags")).alias("k"))
    once, again = (A.diversified(F.col("k"), "setting", F.col("image_id"), 0.4, 7) for _ in range(2))
    both = F.array_sort(F.concat(*once))
    return df.select("image_id", F.size(both).cast("long").alias("n"), F.md5(F.array_join(both, "|")).alias("digest"), ((once[0] == again[0]) & (once[1] == again[1])).alias("stable"))


@query("""SELECT source AS folder, least(count(*), 100) AS images FROM documents GROUP BY source""")
def folder_counts_capped(spark, d):
    return B.folder_counts(table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")), cap=100)


@query("""SELECT o_orderkey AS k, left(sha256('body ' || o_orderkey), 20) AS key, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'data:image/png;base64,' || base64(encode('body ' || o_orderkey)) END AS url,
  CASE o_orderkey % 4 WHEN 0 THEN 'one' || o_orderkey || 'two' WHEN 1 THEN 'text ' || o_orderkey END AS said FROM orders""")
def message_parts(spark, d):
    """Content keys, data URLs taken from chat messages (the last message with a list), and texts of responses."""
    k = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("body "), k).cast("binary")
    part = lambda t, text, url: F.struct(F.lit(t).alias("type"), text.cast("string").alias("text"), url.cast("string").alias("image_url"))
    none = F.lit(None)
    image = F.when(F.col("o_orderkey") % 4 != 3, T.data_url(body, none)).otherwise(F.lit("ftp://x"))
    content = F.array(part("text", F.lit("look"), none), part("image_url", none, image))
    empty = F.array().cast("array<struct<type: string, text: string, image_url: string>>")
    messages = F.array(F.struct(F.lit("user").alias("role"), empty.alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content")), F.struct(F.lit("user").alias("role"), F.when(F.col("o_orderkey") < 0, content).alias("content")))
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('[{"type":"text","text":"one'), k, F.lit('"},{"type":"image"},{"type":"text","text":"two"}]'))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('"text '), k, F.lit('"'))).when(F.col("o_orderkey") % 4 == 2, '""').otherwise("null")
    data = R.chat_image(messages)["data"]
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), T.content_key(body).alias("key"), F.when(data.isNotNull(), T.data_url(data, none)).alias("url"), R.message_text(said).alias("said"))


