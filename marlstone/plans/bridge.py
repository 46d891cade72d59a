"""Caption relations made from the star-schema tables, in Spark and in SQL.

An image is an order; its tags are made from its line items, its prose from a
template over the order's keys. Only arithmetic decides, so any engine agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import vocab as V

LABELS = (
    "1girl, solo, sensitive, rating:general, looking_at_viewer, smile, upper_body, full_body, close-up, blue eyes, brown_hair, red_dress, blue shirt, black boots, "
    "white hat, gray_coat, green_scarf, leather jacket, standing, sitting, kneeling, arms crossed, from above, portrait, garden, kitchen, wooden floor, city street, "
    "beach, mountain, park bench, soft light, golden hour, neon, rim light, shadows, reading, holding umbrella, walking, drinking coffee, laughing, typing, 1boy, "
    "realistic, freckles, black_and_white, dark_blue, trees"
).split(", ")
COLOURS = ["red", "blue", "green", "black", "white", "grey"]
GARMENTS = ["dress", "shirt", "coat", "hat", "jacket"]
POSES = ["standing", "sitting", "kneeling"]
PLACES = ["garden", "kitchen", "city street", "sunny park"]
EXTRAS = [
    "She is reading a book with blue eyes", "There is a wooden table beside the window",
    "A golden glow lights the wall; soft shadows fall on the floor", "The photo shows smiling children",
]
STYLES = ["photo", "anime", " Photo ", None]
BACKENDS = ["sdxl", "flux", "sd3", None, "Kolors"]
CATEGORIES = ["identity", "wardrobe", "Pose-Composition", "setting", "lighting", "action", "unknown"]
PRESETS = ["tags", "Keywords", "balanced", "descriptive", "prose", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(V.strings(values), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, nth, part, label, score) of every line item."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("nth"), F.col("l_partkey").alias("part"),
        pick(LABELS, F.col("l_partkey") * 7 + F.col("l_linenumber") * 13).alias("label"), (F.col("l_quantity").cast("double") / 50).alias("score"),
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption inputs, one row per order, dealt out by it.

    The rows are small and the work on them is not, so their number of partitions
    follows the cores rather than their bytes. Both sides are dealt by the image
    once; grouping and join need no further exchange.
    """
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sorted_tags = F.sort_array(F.collect_list(F.struct("nth", "part", "label")))
    tags = tag_rows(spark, sf_dir).repartition(many, "image_id").groupBy("image_id").agg(F.array_join(sorted_tags["label"], ", ").alias("tags"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("c")).repartition(many, "image_id")
    i, c = F.col("image_id"), F.col("c")
    prose = F.concat(
        F.lit("The image shows a woman in a "), pick(COLOURS, c), F.lit(" "), pick(GARMENTS, i), F.lit(", "), pick(POSES, c),
        F.lit(" in a "), pick(PLACES, i), F.lit(". "), pick(EXTRAS, i + c), F.lit("."),
    )
    return o.join(tags, "image_id", "left").select(
        "image_id", F.coalesce("tags", F.lit("")).alias("tags"), prose.alias("prose"),
        F.when(i % 2 == 0, "sks").otherwise("").alias("trigger_word"), pick(STYLES, i).alias("target_style"),
        pick(CATEGORIES, i + c).alias("target_category"), pick(BACKENDS, c).alias("target_backend"),
        F.when(c % 2 == 0, "ponyXL").alias("checkpoint"), pick(PRESETS, c).alias("hybrid_preset"),
        F.when(i % 7 == 0, F.pmod(c, F.lit(11)) / 10).cast("double").alias("prose_bias"), (i % 4).cast("int").alias("image_index"),
    )


def quoted(values) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values: list, index: str) -> str:
    return f"({quoted(values)})[1 + ({index}) % {len(values)}]"


SQL_TAG_ROWS = f"""SELECT l_orderkey AS image_id, l_linenumber AS nth, l_partkey AS part,
  {sql_pick(LABELS, "l_partkey * 7 + l_linenumber * 13")} AS label, CAST(l_quantity AS DOUBLE) / 50 AS score FROM lineitem"""

SQL_CAPTIONS = f"""WITH tr AS ({SQL_TAG_ROWS}),
tg AS (SELECT image_id, string_agg(label, ', ' ORDER BY nth, part) AS tags FROM tr GROUP BY image_id),
oo AS (SELECT o_orderkey AS i, o_custkey AS c FROM orders),
cap AS (SELECT i AS image_id, coalesce(tags, '') AS tags,
  'The image shows a woman in a ' || {sql_pick(COLOURS, "c")} || ' ' || {sql_pick(GARMENTS, "i")} || ', ' || {sql_pick(POSES, "c")} || ' in a ' || {sql_pick(PLACES, "i")} || '. ' || {sql_pick(EXTRAS, "i + c")} || '.' AS prose,
  CASE WHEN i % 2 = 0 THEN 'sks' ELSE '' END AS trigger_word, {sql_pick(STYLES, "i")} AS target_style, {sql_pick(CATEGORIES, "i + c")} AS target_category,
  {sql_pick(BACKENDS, "c")} AS target_backend, CASE WHEN c % 2 = 0 THEN 'ponyXL' END AS checkpoint, {sql_pick(PRESETS, "c")} AS hybrid_preset,
  CASE WHEN i % 7 = 0 THEN CAST(c % 11 AS DOUBLE) / 10 END AS prose_bias, i % 4 AS image_index
  FROM oo LEFT JOIN tg ON tg.image_id = oo.i)"""
