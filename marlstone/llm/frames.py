"""Helpers shared by the corpus operators: column picking, shared tables, ASCII case."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_fallback: list[str] = []


def only(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the columns ``names``; any other column, whatever its name, is left out.

    Columns are found by exact name and position, so further columns that differ
    only in case, or repeat a name, do no harm (the first exact match counts).
    """
    plain, at = stowed(df, *names)
    return plain.select([F.col(c).alias(n) for c, n in zip(at, names)])


def stowed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed c0, c1 and so on, and the new names of ``names``.

    So helper columns can't clash with given ones, whatever these are called (two
    that differ in case only, say). ``toDF(*df.columns)`` gives the names back.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="marlstone-"))
    return _fallback[0]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the table, and
    nondeterministic columns (row numbers by partition) keep their values.
    """
    path = f"{shared_dir(df.sparkSession)}/marlstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def id_key(doc_id: str) -> Column:
    """A join key for a doc_id that may be null."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def first_of_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each run of rows that agree in ``keys``; the keys themselves are dropped."""
    w = Window.partitionBy(*keys).orderBy(*keys)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth", *keys)
