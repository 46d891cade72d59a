"""Relational steps around captioning: replay of recorded captions, dedupe, skips, collisions, roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import vocab as V


def _newest_first(captions: DataFrame) -> list[Column]:
    """By version, then created_at; unknown ones count as newest. Equals go by their asset and their content, so that no order of reading decides."""
    body = F.to_json(F.struct(*[c for c in captions.columns if c != "asset_id"]))
    return [F.col("version").desc_nulls_first(), F.col("created_at").desc_nulls_first(), F.col("asset_id"), body]


def latest_captions(captions: DataFrame) -> DataFrame:
    """The newest recorded caption of each asset: by version, then created_at; unknown ones count as newest."""
    w = Window.partitionBy("asset_id").orderBy(*_newest_first(captions))
    return captions.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def replay(wanted: DataFrame, assets: DataFrame, captions: DataFrame, on_miss: str = "keep") -> DataFrame:
    """Recorded captions for ``wanted`` (sha256, uri): by sha256, and by uri where that finds none.

    Adds ``matched_by`` ("sha256", "uri" or null) and the caption's columns. Of equally
    new captions of assets with one key, that of the smallest asset id counts.
    ``on_miss``: keep the row, "skip" it, or "fail" the query.
    """
    body = [c for c in captions.columns if c != "asset_id"]

    def newest(key: str) -> DataFrame:
        rows = assets.select(F.col("id").alias("asset_id"), F.col(key).alias("__k")).filter("__k is not null").join(captions, "asset_id")
        w = Window.partitionBy("__k").orderBy(*_newest_first(captions))
        top = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
        return top.select(F.col("__k").alias(key), F.struct(*body).alias(f"by_{key}"))

    out = wanted.join(newest("sha256"), "sha256", "left").join(newest("uri"), "uri", "left")
    out = out.withColumn("matched_by", F.when(F.col("by_sha256").isNotNull(), "sha256").when(F.col("by_uri").isNotNull(), "uri"))
    out = out.withColumn("__hit", F.coalesce("by_sha256", "by_uri")).drop("by_sha256", "by_uri")
    if on_miss == "skip":
        out = out.filter("matched_by is not null")
    elif on_miss == "fail":
        out = out.withColumn("matched_by", F.when(F.col("matched_by").isNull(), F.raise_error("no recorded caption").cast("string")).otherwise(F.col("matched_by")))
    return out.select(*wanted.columns, "matched_by", *[F.col(f"__hit.{c}").alias(c) for c in body])


def replayed_results(hits: DataFrame, name: str = "replay", source: str = "recorded") -> DataFrame:
    """Hits of ``replay`` as caption results, with defaults for what wasn't recorded and a stamp of their origin.

    Recorded columns that may be missing or null: final_caption, caption_variants,
    raw_tags, raw_prose, backend_name, profile (map), version. Misses are left out.
    Adds selected_category and replay, a struct that tells a replayed result from a fresh one.
    """
    texts = "map<string, string>"
    kinds = {"final_caption": "string", "caption_variants": texts, "raw_tags": "string", "raw_prose": "string", "backend_name": "string", "profile": texts, "version": "bigint"}
    got = {c: F.col(c).cast(t) if c in hits.columns else F.lit(None).cast(t) for c, t in kinds.items()}
    none = F.create_map().cast(texts)
    profile = F.coalesce(got["profile"], none)
    stamp = F.struct(
        F.lit(source).alias("source"), F.col("sha256").alias("asset_sha256"), F.col("uri").alias("asset_uri"),
        got["version"].alias("caption_version"), got["backend_name"].alias("recorded_backend"), profile.alias("recorded_profile"),
    )
    blank = F.lit("")
    return hits.filter("matched_by is not null").withColumns({
        **{c: F.coalesce(got[c], blank) for c in ("final_caption", "raw_tags", "raw_prose")},
        "caption_variants": F.coalesce(got["caption_variants"], none), "backend_name": F.coalesce(F.nullif(got["backend_name"], blank), F.lit(name)),
        "selected_category": F.coalesce(F.nullif(F.try_element_at(profile, F.lit("target_category")), blank), F.lit("identity")), "replay": stamp,
    })


def infer_once(images: DataFrame, infer: Callable[[DataFrame], DataFrame], by: str = "sha256") -> DataFrame:
    """Runs ``infer`` on one image of each content hash and joins the results back to all.

    ``infer`` keeps the column ``by``. Images without a hash are each inferred: a
    mark of their own stands in for it.
    """
    from marlstone.sources.shared import settle

    lone = settle(images.filter(F.col(by).isNull()).withColumn(by, F.concat(F.lit("\0"), F.uuid())), "lone")  # a mark must not change when it is read twice
    keyed = images.filter(F.col(by).isNotNull()).unionByName(lone)
    done = keyed.join(infer(keyed.dropDuplicates([by])), by, "left")
    return done.withColumn(by, F.when(~F.startswith(by, F.lit("\0")), F.col(by)))


def last_wins(results: DataFrame, name: str = "name", idx: str = "idx") -> DataFrame:
    """One row per name: the last result, at the position of the first."""
    last = F.max_by(F.struct(*[c for c in results.columns if c != name]), idx)
    rows = results.groupBy(name).agg(last.alias("r"), F.min(idx).alias("position"))
    return rows.select(name, "position", *[F.col(f"r.{c}").alias(c) for c in results.columns if c not in (name, idx)])


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def skip_captioned(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Images without a .txt sidecar."""
    done = sidecars.filter(F.lower(F.col("path")).endswith(".txt")).select(stem(F.col("path")).alias("__stem")).distinct()
    return images.withColumn("__stem", stem(F.col("path"))).join(done, "__stem", "left_anti").drop("__stem")


def plain_path(path: Column) -> Column:
    """Without "." and "x/.." steps, by a fold over the path's parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


def sidecar_outcomes(rows: DataFrame, order: str = "idx") -> DataFrame:
    """Adds sidecar and error: of captioned rows with one sidecar path, the first writes it, later ones fail."""
    rows = rows.withColumn("sidecar", F.concat(stem(plain_path(F.col("path"))), F.lit(".txt")))
    w = Window.partitionBy("sidecar", F.col("error").isNull()).orderBy(order)
    rows = rows.withColumn("__n", F.row_number().over(w))
    clash = F.col("error").isNull() & (F.col("__n") > 1)
    return rows.withColumn("error", F.when(clash, F.concat(F.lit("sidecar already written: "), "sidecar")).otherwise(F.col("error"))).drop("__n")


def manifest_outcomes(
    rows: DataFrame, existing: DataFrame | None = None, write_txt: bool = True, write_xmp: bool = False, xmp_overwrite: bool = True, order: str = "idx"
) -> DataFrame:
    """What becomes of each row (path, error, and any others) if sidecars are written one row after the other, in ``order``.

    Adds sidecar and xmp_path (null unless written) and fills error. Paths are
    compared without "." and ".." steps. Of captioned rows with one ``.txt`` the first
    writes it and later ones fail as a whole; only rows that got that far want their
    ``.xmp``, where again the first one wins. Without ``xmp_overwrite`` an ``.xmp``
    among ``existing`` (path) fails each row that wants it, and none of them takes it.
    An ``.xmp`` failure says so if the row's ``.txt`` was written before.
    """
    plain = plain_path(F.col("path"))
    txt = F.concat(stem(plain), F.lit(".txt"))
    rows = rows.withColumn("__txt", txt if write_txt else F.lit(None).cast("string")).withColumn("__xmp", F.concat(plain, F.lit(".xmp")) if write_xmp else F.lit(None).cast("string"))
    failed, name = F.col("error").isNotNull(), F.element_at(F.split("path", "/"), -1)
    if write_txt:
        nth = F.row_number().over(Window.partitionBy("__txt", failed).orderBy(order))
        late = ~failed & (nth > 1)
        rows = rows.withColumn("error", F.when(late, F.concat(F.lit("sidecar already written: "), stem(name), F.lit(".txt"))).otherwise(F.col("error")))
    wrote_txt = ~failed & F.lit(write_txt)
    rows = rows.withColumn("sidecar", F.when(wrote_txt, F.col("__txt")))
    if write_xmp:
        rows = rows.withColumn("__there", F.lit(False))
        if existing is not None and not xmp_overwrite:
            there = existing.select(plain_path(F.col("path")).alias("__xmp")).distinct().withColumn("__is", F.lit(True))
            rows = rows.drop("__there").join(there, "__xmp", "left").withColumn("__there", F.coalesce("__is", F.lit(False))).drop("__is")
        wants = ~failed & ~F.col("__there")
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__xmp", wants).orderBy(order)))
        note = F.when(F.col("sidecar").isNotNull(), " (its .txt sidecar was written)").otherwise("")
        problem = F.when(failed, F.col("error")).when(F.col("__there"), F.concat(F.lit("metadata exists: "), name, F.lit(".xmp"), note)).when(F.col("__nth") > 1, F.concat(F.lit("metadata already written: "), name, F.lit(".xmp"), note))
        rows = rows.withColumn("error", problem).withColumn("xmp_path", F.when(F.col("error").isNull(), F.concat("path", F.lit(".xmp"))))
    else:
        rows = rows.withColumn("xmp_path", F.lit(None).cast("string"))
    return rows.drop("__txt", "__xmp", "__there", "__nth")


def summary(rows: DataFrame) -> DataFrame:
    """One row: total, captioned, failed, xmp_written."""
    xmp = F.count_if(F.col("xmp_path").isNotNull()) if "xmp_path" in rows.columns else F.lit(0).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("captioned"), F.count_if(F.col("error").isNotNull()).alias("failed"), xmp.alias("xmp_written"))


def pull_plan(assets: DataFrame, existing: DataFrame, order: str = "pos") -> DataFrame:
    """Adds action: collision (a basename's later rows), skip (the file exists) or fetch; and a warning for what can't be captioned."""
    base = F.element_at(F.split("path", "/"), -1)
    n = F.row_number().over(Window.partitionBy("basename").orderBy(order))
    have = existing.select("basename", F.lit(True).alias("__have")).distinct()
    rows = assets.withColumn("basename", base).withColumn("__n", n).join(have, "basename", "left")
    rows = rows.withColumn("action", F.when(F.col("__n") > 1, "collision").when(F.col("__have"), "skip").otherwise("fetch")).drop("__n", "__have")
    suffix = F.lower(F.regexp_extract("basename", r"[^.](\.[^.]+)$", 1))
    odd = F.when(suffix == "", "not captionable: file has no extension").otherwise(F.concat(F.lit("not captionable: '"), suffix, F.lit("' is not a supported image type")))
    return rows.withColumn("warning", F.when((F.col("action") != "collision") & ~suffix.isin(*V.IMAGE_SUFFIXES), odd))


def wanted_assets(assets: DataFrame, ids: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(the assets asked for, the ids that don't exist); no ids frame: all assets."""
    if ids is None:
        return assets, None
    return assets.join(ids.select("id"), "id", "left_semi"), ids.select("id").distinct().join(assets, "id", "left_anti").orderBy("id")


def folder_counts(files: DataFrame, cap: int = 5000) -> DataFrame:
    """(folder, images) by the first step of relative paths; hidden folders left out; the count stops at ``cap``."""
    parts = F.split("path", "/")
    rows = files.filter(F.size(parts) > 1).withColumn("folder", F.get(parts, F.lit(0))).filter(~F.startswith("folder", F.lit(".")))
    return rows.groupBy("folder").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("images"))


def browse(files: DataFrame, folder: str = "", cap: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(folders, here) of one folder, from the relative paths of all files below the root.

    folders: name, rel_path, image_count (all levels; stops at ``cap``),
    subfolder_count; hidden ones are left out. here: path, parent (null at the
    root), direct_image_count. Folders without any file aren't known.
    """
    inside = folder.strip("/")
    rest = F.substr("path", F.lit(len(inside) + 2)) if inside else F.col("path")
    parts = F.split(rest, "/")
    rows = files.filter(F.startswith("path", F.lit(inside + "/"))) if inside else files
    suffixes = "|".join(x.replace(".", r"\.") for x in V.IMAGE_SUFFIXES)
    rows = rows.select(parts.alias("parts"), F.lower(rest).rlike(f"[^/]({suffixes})$").alias("image"))
    below = F.get("parts", F.lit(1))
    shown = rows.filter((F.size("parts") > 1) & ~F.startswith(F.get("parts", F.lit(0)), F.lit("."))).groupBy(F.get("parts", F.lit(0)).alias("name"))
    folders = shown.agg(
        F.least(F.count_if("image"), F.lit(cap)).alias("image_count"),
        F.countDistinct(F.when((F.size("parts") > 2) & ~F.startswith(below, F.lit(".")), below)).alias("subfolder_count"),
    ).select("name", F.concat(F.lit(f"{inside}/" if inside else ""), "name").alias("rel_path"), "image_count", "subfolder_count")
    parent = F.lit(inside.rpartition("/")[0] if inside else None).cast("string")
    here = rows.agg(F.count_if(F.col("image") & (F.size("parts") == 1)).alias("direct_image_count"))
    return folders, here.select(F.lit(inside).alias("path"), parent.alias("parent"), "direct_image_count")


def image_index(df: DataFrame, order: str) -> DataFrame:
    """Adds image_index, the 0-based place in ``order``, by range partitions and offsets (no single-task window)."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__p", F.shiftright("__at", 33))
    from marlstone.sources.shared import settle

    ranged = settle(ranged, "indexed")
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    return ranged.join(offsets, "__p").withColumn("image_index", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__p", "__at", "__before")
