"""Exact dedup: a tree-merge of sorted digest runs, in built-in functions only.

Every input partition is a run of (digest, best row, count), written in order of
the digest. In a round, groups of ``fan_in`` neighbouring runs are merged into one
run of the next level; 16 takes four rounds of a binomial tree at once. The merge
is Spark's: an exchange brings the rows of one digest range together, a sort puts
them in order (runs that are sorted already cost one comparison a row or so), and
a sort-based aggregation keeps the best row of each stretch of equal digests. A
run is spread over tasks by digest, so no task ever holds a whole run. The result
is then sent down the same tree: a row of level r meets its parent of level r+1.
A digest shared by a third of all rows has one row per run, hence at most
``fan_in`` rows meet at any step and no join is skewed.

The digest is SHA-256; at every level identifiers are verified with the byte
length and an independent 64-bit hash, which are part of the merge key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.frames import first_of_repeats, id_key, lower_az, only, settle, stowed

KEY = ["digest", "n_bytes", "check"]


def exact_dedup(docs: DataFrame, keep: str = "min", fan_in: int = 16) -> DataFrame:
    """One row per document with the row that stays for its text.

    Texts are equal when identical after lower-casing A-Z. ``keep``: "min" or
    "max" doc_id stays. Null text counts as empty, so null and "" are equal. A
    null doc_id never wins against a number. Of repeated rows (same doc_id, same
    text) exactly one is kept. An empty table gives an empty result; other
    columns are ignored.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    if keep not in ("min", "max") or fan_in < 2:
        raise ValueError("keep is 'min' or 'max', fan_in at least 2")
    norm = lower_az(F.coalesce(F.col("text"), F.lit("")))
    rows = only(docs, "doc_id", "text").select("doc_id", norm.alias("norm"))
    leaf = settle(
        rows.select(
            "doc_id",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("check"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    if keep == "max":
        best, rank = F.max, F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row")
    else:
        best, rank = F.min, F.struct(F.col("doc_id").isNull().alias("has"), "doc_id", "row")
    runs = (leaf.agg(F.max("run")).first()[0] or 0) + 1

    level = leaf.groupBy("run", *KEY).agg(best(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    levels = [settle(level.sortWithinPartitions("run", "digest"), "run0")]
    while runs > 1:
        merged = (
            levels[-1]
            .withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *KEY)
            .agg(best("best").alias("best"), F.sum("n").alias("n"))
        )
        levels.append(settle(merged.sortWithinPartitions("run", "digest"), f"run{len(levels)}"))
        runs = -(-runs // fan_in)

    found = levels.pop()
    while levels:
        child = levels.pop().select("run", *KEY).withColumn("up", F.floor(F.col("run") / fan_in).cast("int"))
        found = child.join(found.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    return leaf.join(found, ["run", *KEY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` would drop; all columns stay, whatever their names.

    Null and empty texts are equal, so one of them stays. A null doc_id stays only
    where its text has no other; of rows that repeat a doc_id and its text one
    stays. Empty table: empty result. Very long texts are compared whole.
    """
    plain, (doc_id, text) = stowed(docs, "doc_id", "text")
    stay = exact_dedup(docs, keep).filter("kept").select(id_key("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    mine = plain.withColumn("id", id_key(doc_id)).withColumn("sha", F.sha2(lower_az(F.coalesce(F.col(text), F.lit(""))), 256))
    return first_of_repeats(mine.join(stay, ["id", "sha"], "left_semi"), ["id", "sha"]).select(plain.columns).toDF(*docs.columns)


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
