"""Readers: image folders, evaluation and curator manifests, vocabularies, chat images, albums."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vocab as V
from marlstone.sources.files import contents, listed_files
from marlstone.sources.shared import settle

SUFFIX_PATTERN = "(?i)(" + "|".join(s.replace(".", r"\.") for s in V.IMAGE_SUFFIXES) + ")$"


def file_name(path: Column) -> Column:
    """The last path step before any query string; "image" if empty."""
    name = F.element_at(F.split(F.split_part(path, F.lit("?"), F.lit(1)), "/"), -1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("image"))


def scan_images(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(id, name, path, sha256) of the image files below ``root``, in path order; id is the relative path.

    sha256 is over the file's bytes; without ``content`` the bytes aren't read.
    """
    files = listed_files(spark, root).filter(F.col("path").rlike(SUFFIX_PATTERN))
    base = F.regexp_replace(F.lit(root), "/+$", "")
    rel = F.substr("path", F.instr(F.col("path"), base) + F.length(base) + 1)
    rows, sha = (contents(files), F.sha2("content", 256)) if content else (files, F.lit(None).cast("string"))
    # settled, as sorting reads its input twice
    return settle(rows.select(rel.alias("id"), file_name(F.col("path")).alias("name"), "path", sha.alias("sha256")), "scanned").orderBy("path")


def glob_pattern(pattern: str) -> str:
    """A file name's glob (``*``, ``?``, ``{a,b}``) as a regular expression for whole paths."""
    parts = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    return "/" + "".join(parts.get(c, c if c.isalnum() else "\\" + c) for c in pattern) + "$"


def glob_images(spark: SparkSession, root: str, pattern: str = "*.{png,jpg,jpeg,webp}") -> DataFrame:
    """(path, sha256) of files directly in ``root`` that match, case-sensitively."""
    files = listed_files(spark, root, recursive=False).filter(F.col("path").rlike(glob_pattern(pattern)))
    return settle(contents(files).select("path", F.sha2("content", 256).alias("sha256")), "globbed").orderBy("path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file, numbered from 1; blank lines count but are left out.

    The file is read in splits: a line's number is its place in its split, offset
    by the lines of earlier splits. So no task reads a large manifest whole.
    """
    rows = spark.read.text(path).withColumn("begin", F.col("_metadata.file_block_start")).withColumn("at", F.monotonically_increasing_id())
    sizes = rows.groupBy("begin").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("begin", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.join(F.broadcast(sizes), "begin").select((F.col("at") - F.col("first") + F.col("before") + 1).cast("int").alias("line"), "value")
    return numbered.filter(T.strip(F.col("value")) != "")


EVAL_SCHEMA = "image STRING, expected_tags STRING, target_caption STRING, target_style STRING, target_category STRING, target_backend STRING, notes STRING"


def eval_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items of a JSON-lines file; ``error`` names the line of a bad row.

    image is required; relative images belong to the manifest's folder; blank
    expected tags are dropped; has_labels tells tags or a target caption.
    """
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    rows = numbered_lines(spark, path).withColumn("j", F.try_parse_json("value"))
    kind = F.schema_of_variant("j")
    for name in ("image", "target_caption", "target_style", "target_category", "target_backend", "notes"):
        rows = rows.withColumn(name, F.try_variant_get("j", f"$.{name}", "string"))
    tags = F.try_variant_get("j", "$.expected_tags", "array<string>")
    given = F.try_variant_get("j", "$.expected_tags", "variant").isNotNull()
    problem = (
        F.when(F.col("j").isNull(), "invalid JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
        .when(F.coalesce("image", F.lit("")) == "", "missing image").when(given & tags.isNull(), "expected_tags is no list")
    )
    clean = F.filter(F.transform(F.coalesce(tags, V.empty()), lambda t: T.strip(t)), lambda t: t != "")
    out = rows.select(
        "line",
        F.when(F.startswith("image", F.lit("/")), F.col("image")).otherwise(F.concat(F.lit(folder + "/"), "image")).alias("image"),
        clean.alias("expected_tags"), "target_caption",
        F.coalesce("target_style", F.lit("photo")).alias("target_style"), F.coalesce("target_category", F.lit("identity")).alias("target_category"),
        F.coalesce("target_backend", F.lit("sdxl")).alias("target_backend"), F.coalesce("notes", F.lit("")).alias("notes"),
        F.when(problem.isNotNull(), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), problem)).alias("error"),
    )
    return out.withColumn("has_labels", (F.size("expected_tags") > 0) | (F.length(F.coalesce("target_caption", F.lit(""))) > 0))


def eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A manifest by its suffix, else the images of a folder as unlabelled items."""
    if path.endswith((".jsonl", ".ndjson")):
        return eval_manifest(spark, path)
    if "." in path.rsplit("/", 1)[-1]:
        raise ValueError(f"neither a folder nor a .jsonl or .ndjson file: {path}")
    rows = scan_images(spark, path, content=False)
    return rows.select(F.col("path").alias("image"), V.empty().alias("expected_tags"), F.lit(False).alias("has_labels"))


def curator_rows(lines: DataFrame, export_root: str | None = None) -> DataFrame:
    """Rows of a curator manifest (line, value): image_path, target_profile, error; ``fatal`` marks what rejects the file.

    Fatal: bad JSON, a row that is no object, a major version other than 1 or 2.
    Row errors: an exported_path that leaves the export root, no usable path, a
    target_profile that is no object.
    """
    from marlstone.operators.batch import plain_path

    rows = lines.withColumn("j", F.try_parse_json("value"))
    kind = F.schema_of_variant("j")
    version = F.coalesce(F.try_variant_get("j", "$.manifest_version", "string"), F.lit("1"))
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get("j", f"$.{k}", "variant")) == "STRING", F.try_variant_get("j", f"$.{k}", "string"))
    target = F.try_variant_get("j", "$.target_profile", "variant")
    rows = rows.select(
        "line", "j", kind.alias("kind"), F.split_part(version, F.lit("."), F.lit(1)).alias("major"), text("exported_path").alias("exported"), text("abs_path").alias("abs"),
        F.when(target.isNotNull(), F.schema_of_variant(target)).alias("profile_kind"), F.to_json(target).alias("target_profile"),
    )
    root = (export_root or "").rstrip("/")
    joined = plain_path(F.when(F.startswith("exported", F.lit("/")), F.col("exported")).otherwise(F.concat(F.lit(root + "/"), "exported")))
    use_export = F.lit(bool(root)) & F.col("exported").isNotNull()
    inside = F.startswith(joined, F.lit(root + "/"))
    bad = F.when(F.col("j").isNull(), "invalid JSON").when(~F.startswith("kind", F.lit("OBJECT")), "not an object").when(~F.col("major").isin("1", "2"), "unsupported manifest_version")
    problem = (
        F.when(use_export & ~inside, "exported_path leaves the export root").when(~use_export & (F.coalesce("abs", F.lit("")) == ""), "no image path")
        .when(F.col("profile_kind").isNotNull() & ~F.startswith("profile_kind", F.lit("OBJECT")), "target_profile must be an object")
    )
    return rows.select(
        "line", F.when(use_export & inside, joined).otherwise(F.when(~use_export, F.col("abs"))).alias("image_path"), "target_profile",
        F.when(bad.isNotNull(), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), bad)).alias("fatal"), F.when(bad.isNull(), problem).alias("error"),
    )


def curator_manifest(spark: SparkSession, path: str, export_root: str | None = None) -> DataFrame:
    """The rows of a manifest file; raises if a line rejects the whole file."""
    rows = curator_rows(numbered_lines(spark, path), export_root)
    first = rows.filter("fatal is not null").orderBy("line").select("fatal").first()
    if first:
        raise ValueError(first[0])
    return rows.drop("fatal")


def tagger_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, category) of a CSV file with columns name and category."""
    # quoted fields may hold commas; a field with a line break would make the file one split's work
    lines = numbered_lines(spark, path)
    head = lines.orderBy("line").first()
    fields = next(csv.reader([head["value"]]))
    if not {"name", "category"} <= {f.strip() for f in fields}:
        raise ValueError("a vocabulary needs the columns name and category")
    schema = ", ".join(f"c{i} string" for i in range(len(fields)))
    at = {f.strip(): f"v.c{i}" for i, f in enumerate(fields)}
    rows = lines.filter(F.col("line") > head["line"]).select("line", F.from_csv("value", schema, {"escape": '"'}).alias("v"))
    return rows.select((F.col("line") - head["line"] - 1).cast("int").alias("pos"), F.col(at["name"]).alias("name"), F.col(at["category"]).cast("int").alias("category"))


def chat_image(messages: Column) -> Column:
    """struct<data, url> of the first image part in the last message whose content is a list.

    ``messages``: array<struct<role, content: array<struct<type, text, image_url>>>>, content null for plain text.
    """
    lists = F.filter(messages, lambda m: m["content"].isNotNull())
    parts = F.get(lists, F.size(lists) - 1)["content"]
    url = F.get(F.filter(parts, lambda p: (p["type"] == "image_url") & p["image_url"].rlike("^(data:|https?://)")), F.lit(0))["image_url"]
    data = F.when(F.startswith(url, F.lit("data:")), F.unbase64(F.substr(url, F.instr(url, F.lit(",")) + 1)))
    return F.when(url.isNotNull(), F.struct(data.alias("data"), F.when(~F.startswith(url, F.lit("data:")), url).alias("url")))


def message_text(content: Column) -> Column:
    """Text of a response's content given as JSON: a string, or a list whose text parts are joined; null if neither."""
    v = F.try_parse_json(content)
    parts = F.try_variant_get(v, "$", "array<struct<type: string, text: string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "")
    return F.nullif(F.coalesce(joined, F.try_variant_get(v, "$", "string")), F.lit(""))


def album_assets(raw: DataFrame) -> DataFrame:
    """(id, name, updated_at) of an album's JSON rows (column value): images only, the name defaulting to the id."""
    field = lambda k: F.get_json_object("value", f"$.{k}")
    return raw.filter(field("type") == "IMAGE").select(field("id").alias("id"), F.coalesce(field("originalFileName"), field("id")).alias("name"), field("updatedAt").alias("updated_at"))
