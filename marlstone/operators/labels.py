"""Controlled vocabulary and provenance of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vocab as V


def canonical(label: Column, synonyms: dict[str, str] = V.SYNONYMS) -> Column:
    low = T.strip(F.lower(label))
    return F.coalesce(V.lookup(synonyms, low), low)


def expand(label: Column, synonyms: dict[str, str] = V.SYNONYMS, parents: dict[str, list[str]] = V.PARENTS) -> Column:
    """The canonical label and its ancestors; none for a blank."""
    c = canonical(label, synonyms)
    return F.when(c == "", V.empty()).otherwise(F.array_distinct(F.concat(F.array(c), F.coalesce(V.lookup(parents, c), V.empty()))))


def normalise_labels(labels: Column, with_parents: bool = False, synonyms: dict[str, str] = V.SYNONYMS, parents: dict[str, list[str]] = V.PARENTS) -> Column:
    """Distinct canonical labels, first seen first."""
    each = F.transform(labels, (lambda x: expand(x, synonyms, parents)) if with_parents else (lambda x: F.array(canonical(x, synonyms))))
    return F.filter(F.array_distinct(F.flatten(each)), lambda x: x != "")


def canonical_by_table(df: DataFrame, column: str, synonyms: DataFrame) -> DataFrame:
    """For vocabularies too large for literals: a join with (alias, canonical), single step. Spark picks the join by size."""
    keyed = df.withColumn("__low", T.strip(F.lower(F.col(column))))
    met = keyed.join(synonyms.select(F.col("alias").alias("__low"), F.col("canonical").alias("__to")), "__low", "left")
    return met.withColumn("canonical", F.coalesce("__to", "__low")).drop("__low", "__to")


def provenance(tags: Column, backend: Column, min_score: Column | None = None) -> Column:
    """struct<backend, min_score, tags>: every tag stays, flagged whether it is in the caption."""
    least = min_score if min_score is not None else F.lit(None).cast("double")

    def one(t: Column) -> Column:
        inside = least.isNull() | t["score"].isNull() | (t["score"] >= least)
        return F.struct(t["label"].alias("label"), t["score"].alias("score"), F.coalesce(t["source"], backend).alias("source"), inside.alias("included"))

    return F.struct(backend.alias("backend"), least.alias("min_score"), F.transform(tags, one).alias("tags"))


def select_tags(scores: DataFrame, vocabulary: DataFrame, threshold: float = 0.35, rating: int = 9) -> DataFrame:
    """(image_id, tags): names with a score strictly above the threshold, in vocabulary order, without ratings.

    ``scores``: image_id, pos, prob; ``vocabulary``: pos, name, category.
    """
    met = scores.filter(F.col("prob") > threshold).join(vocabulary.filter(F.col("category") != rating), "pos")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return met.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ", ").alias("tags"))
