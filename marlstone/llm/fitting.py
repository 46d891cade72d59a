"""Bounded labelled samples and priors for the classifiers that are fitted here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.frames import crc_fold, only, settle

FOLDS = 5  # rows whose crc32(doc_id as text) modulo FOLDS is 0 are held out of every fit


def held_out(doc_id):
    return crc_fold(doc_id, FOLDS) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> tuple[list[tuple[str, int, str | None]], float]:
    """((text, label, lang) of up to ``per_class`` rows of each label, share of label 1).

    The rows are the first in order of a hash of doc_id among labelled rows that
    aren't held out, and as many as have ``max_bytes`` bytes together (one at least,
    whatever its size); they are taken whole, long or short. The share counts all
    labelled rows that aren't held out. A row whose label is null or no 0 or 1, or
    whose text is null, isn't used. A label row that repeats counts once; an id with
    both labels gives a row for each. lang is null where docs has none.
    """
    ok = only(labels, "doc_id", label).withColumnRenamed(label, "y").filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    n, ones = ok.agg(F.count(F.lit(1)), F.sum("y")).first()
    texts = only(docs, "doc_id", "text", *["lang"] * ("lang" in docs.columns)).filter("text is not null").withColumn("which", F.xxhash64("text"))
    if "lang" not in docs.columns:
        texts = texts.withColumn("lang", F.lit(None).cast("string"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("which")]
    # only rows with a text count towards the bounds
    usable = texts.select("doc_id", "which", F.octet_length("text").cast("long").alias("size")).join(ok.distinct(), "doc_id")
    usable = settle(usable.distinct(), "usable")
    ids = usable.filter("y = 1").orderBy(*order).limit(per_class).union(usable.filter("y = 0").orderBy(*order).limit(per_class))
    before = F.sum("size").over(Window.partitionBy("y").orderBy(*order)) - F.col("size")
    ids = ids.withColumn("before", before).filter(F.col("before") < max_bytes).select("doc_id", "which", "y")
    met = texts.join(F.broadcast(ids), ["doc_id", "which"]).dropDuplicates(["doc_id", "which", "y"])
    got = met.orderBy("y", *order).select("text", "y", "lang").toArrow()
    return list(zip(*(got.column(i).to_pylist() for i in range(3)))), (ones or 0) / n if n else 0.5
