"""Sources, sinks and batch steps on awkward input."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import batch as B
from marlstone.operators import inference as I
from marlstone.sources import readers as R
from marlstone.sources import writers as W


def test_vocabulary_with_quotes(spark, tmp_path):
    path = tmp_path / "tags.csv"
    path.write_text('tag_id,name,category,count\n1,plain,0,5\n2,"a,b",4,6\n3,"say ""hi""",9,7\n')
    got = [tuple(r) for r in R.tagger_vocabulary(spark, str(path)).orderBy("pos").collect()]
    assert got == [(0, "plain", 0), (1, "a,b", 4), (2, 'say "hi"', 9)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        R.tagger_vocabulary(spark, str(tmp_path / "bad.csv"))


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    lines = ["" if i % 7 == 3 else f"row {i} " + "x" * (i % 50) for i in range(3000)]
    path.write_text("\n".join(lines) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = R.numbered_lines(spark, str(path))
        assert rows.select(F.spark_partition_id()).distinct().count() > 1
        got = {r["line"]: r["value"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {i + 1: line for i, line in enumerate(lines) if line}


def test_metadata_is_not_replaced_by_default(spark, tmp_path):
    image = str(tmp_path / "a.jpg")
    rows = spark.createDataFrame([(image, "new")], "path string, text string")
    with open(image + ".xmp", "w") as f:
        f.write("theirs")
    with pytest.raises(Exception, match="FileExistsError"):
        W.write_sidecars(rows, ".xmp")
    assert open(image + ".xmp").read() == "theirs"
    W.write_sidecars(rows, ".xmp", overwrite=True)
    W.write_sidecars(rows, ".txt")
    W.write_sidecars(rows, ".txt")
    assert open(image + ".xmp").read() == "new" and os.path.exists(str(tmp_path / "a.txt"))


def test_images_without_a_hash_are_each_inferred(spark):
    df = spark.createDataFrame([("h", 1), ("h", 2), (None, 3), (None, 4)], "sha256 string, n int")
    got = B.infer_once(df, lambda once: once.select("sha256", (F.col("n") * 10).alias("said")))
    rows = {r["n"]: (r["sha256"], r["said"]) for r in got.collect()}
    assert rows[3] == (None, 30) and rows[4] == (None, 40) and rows[1] == rows[2] and rows[1][0] == "h"


def test_out_of_memory_of_the_linear_algebra_library_is_retried():
    calls = []

    def infer(content):
        calls.append(content)
        if len(calls) == 1:
            raise RuntimeError("CUBLAS_STATUS_ALLOC_FAILED when calling")
        return "ok"

    assert I._with_retry(infer, b"x", first_s=0.0) == "ok" and len(calls) == 2


def test_pixels_keys_and_data_urls(spark):
    df = spark.createDataFrame([([(0, 10, 20), (10, 20, 41)], bytearray(b"img")), ([], bytearray(b""))], "p array<struct<r: int, g: int, b: int>>, c binary")
    a, b = df.select(T.mean_colour(F.col("p")).alias("m"), T.content_key(F.col("c")).alias("k"), T.data_url(F.col("c"), F.lit(None)).alias("u")).collect()
    assert tuple(a["m"]) == (5.0, 15.0, 30.5) and b["m"] is None
    assert a["k"] == hashlib.sha256(b"img").hexdigest()[:20] and a["u"] == "data:image/png;base64,aW1n"
