"""Colours of tags and prose: each side is taken apart once for a row, however many nouns there are."""

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import contradiction as C


def test_tags_are_taken_apart_once(spark):
    df = spark.createDataFrame([("red dress, blue dress, dark_green hats, smile, grey coat", "A blue dress and a red hat, with a gray coat. Standing.")], "tags string, prose string")
    plan = df.select(C.colour_map(F.col("tags")).alias("m"))
    assert plan._jdf.queryExecution().analyzed().expressions().apply(0).sql().count("tags") == 1
    assert plan.first()["m"] == {"dress": ["blue", "red"], "hats": ["green"], "coat": ["gray"]}
    got = [(d["subject"], d["tags_say"], d["prose_says"]) for d in df.select(C.compared(F.col("tags"), F.col("prose")).alias("c")).first()["c"]]
    assert got == [("dress", ["blue", "red"], ["blue"]), ("hats", ["green"], ["red"]), ("coat", ["gray"], ["gray"])]
    assert df.select(T.split_words(F.lit(" a b \t c ")).alias("w")).first()["w"] == ["a", "b", "c"]
