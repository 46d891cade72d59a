"""Composition with a key: distinct tags and sentences are worked out once, with the same results."""

from pyspark.sql import functions as F

from marlstone.functions import vocab as V
from marlstone.operators import assembly as A

TAGS = ["standing, garden; red dress, brown_hair, 1girl, sensitive", "A photo of a cat. sitting,, there is a wooden floor", "", None, " , ", "standing, garden, smile"]
PROSE = ["The image shows a woman in a red dress, standing in a garden. Soft light; it is a photo.", None, "", "She is reading a book in a sunny park with blue eyes"]


def rows(spark, n):
    made = [(i, TAGS[i % len(TAGS)], PROSE[i // 2 % len(PROSE)], "sks" if i % 2 else "  ", ["sdxl", "flux", None][i % 3], i % 4) for i in range(n)]
    return spark.createDataFrame(made, "id int, tags string, prose string, trigger_word string, target_backend string, image_index int")


def test_a_key_changes_no_result(spark):
    df = rows(spark, 60)
    plain, keyed = A.compose(df), A.compose(df, key="id")
    assert plain.columns == keyed.columns
    assert [r.asDict() for r in plain.orderBy("id").collect()] == [r.asDict() for r in keyed.orderBy("id").collect()]


def test_each_distinct_part_is_worked_out_once(spark, monkeypatch):
    sizes, settle = [], A.settle
    monkeypatch.setattr(A, "settle", lambda df, name: (sizes.append((out := settle(df, name)).count()), out)[1])
    few, many = (A.with_buckets(A.with_profile(rows(spark, n)), key="id") for n in (12, 240))
    assert sizes[0] == sizes[1] and many.count() == 240
    got = many.select("id", F.col("b_pose_composition.f").alias("f")).filter("id % 24 = 0").distinct().collect()
    assert len(got) == 10 and len({tuple(r["f"]) for r in got}) == 1


def test_only_wanted_variants_are_held(spark):
    df = rows(spark, 24)
    whole = {r["id"]: r for r in A.compose(df).collect()}
    for r in A.compose(df, variants=["training", "setting"]).collect():
        assert r["caption_variants"] == {n: whole[r["id"]]["caption_variants"][n] for n in ("setting", "training")}
        assert (r["final_caption"], r["removed_phrases"]) == (whole[r["id"]]["final_caption"], whole[r["id"]]["removed_phrases"])


def test_what_fits_as_a_whole_is_as_the_fold_says(spark):
    texts = V.strings(["a b", "c", "d e f", "g,h_i"])
    for most in (2, 4, 5):
        for limit in range(1, 16):
            one = spark.range(1).select(
                A.pack_tokens(texts, F.lit("t u"), F.lit("sdxl"), F.lit(limit), F.lit(most)).alias("k"), A.pack_words(texts, F.lit("t u"), F.lit(most), F.lit(limit)).alias("w"),
            ).first()
            for got, costs, start, first in ((one["k"], [2, 1, 3, 3], 2, 1), (one["w"], [2, 1, 3, 1], 2, 0)):
                kept, used = [], start
                for text, cost in zip(["a b", "c", "d e f", "g,h_i"], costs):
                    cost += first if kept else 0
                    if (not first and not kept) or (len(kept) < most and used + cost <= limit):
                        kept, used = [*kept, text], used + cost
                assert got["kept"] == kept and got["used"] == used


def test_small_tables_of_parts_are_looked_up_and_no_row_is_taken_apart(spark, monkeypatch):
    df = rows(spark, 60)
    wanted = [r.asDict() for r in A.compose(df).orderBy("id").collect()]
    looked_up = A.with_buckets(A.with_profile(df), key="id").select("id", "enrichment", "b_identity")
    plan = looked_up._jdf.queryExecution().optimizedPlan().toString().split("scalar-subquery")
    assert "Generate" not in "".join(plan) and len(plan) == 3
    monkeypatch.setattr(A, "SLOTS", 2)
    assert [r.asDict() for r in A.compose(df, key="id").orderBy("id").collect()] == wanted
    monkeypatch.setattr(A, "SMALL", (3, 1 << 18))
    joined = A.compose(df, key="id")
    assert "Generate" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert [r.asDict() for r in joined.orderBy("id").collect()] == wanted


def test_nothing_to_look_up(spark):
    assert A.compose(rows(spark, 4).filter("id < 0"), key="id").collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", " ; ")], "id int, tags string, prose string")
    assert [r["final_caption"] for r in A.compose(blank, key="id").orderBy("id").collect()] == ["", ""]
