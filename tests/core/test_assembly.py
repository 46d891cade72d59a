import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vocab as V
from marlstone.operators import assembly as A


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("x")).first()["x"]


def array(*items):
    return V.strings(items)


def test_fillers(one):
    s = F.lit("The image shows a photo of  a cat.")
    assert value(one, T.without_fillers(s)) == "a cat"
    assert value(one, T.fillers_of(s)) == ["the image shows", "a photo of"]
    assert value(one, T.without_fillers(F.lit("a woman standing in a park"))) == "a woman standing in a park"
    assert value(one, T.fillers_of(F.lit("a woman standing in a park"))) == []


def test_words(one):
    assert set(value(one, T.tag_words(F.lit("red_dress, smiling, trees")))) == {"red_dress", "red_dres", "smiling", "smil", "trees", "tree"}
    assert value(one, T.dedupe(array("Hello", "hello", "World", " HELLO", " "))) == ["Hello", "World"]


@pytest.mark.parametrize("trigger,rest,out", [("sks", "hello", "sks, hello"), ("", "hello", "hello"), ("sks", "", "sks")])
def test_trigger(one, trigger, rest, out):
    assert value(one, T.with_trigger(F.lit(trigger), F.lit(rest))) == out


def test_tokens(one):
    s = F.lit("upper_body, red dress")
    assert (value(one, T.clip_tokens(s)), value(one, T.t5_tokens(s)), value(one, T.clip_tokens(F.lit("")))) == (5, 4, 0)
    got = [value(one, T.budget_of(F.lit(b), F.lit(o).cast("int"))) for b, o in (("sdxl", None), ("flux", None), ("sd3", None), ("sdxl", 100), ("other", None), ("flux-dev-1", None))]
    assert got == [60, 200, 200, 100, 60, 60]


def test_redundancy(one):
    kept = lambda p, t: value(one, T.kept_clauses(F.lit(p), F.lit(t), F.lit(0.5)))
    assert kept("She is cooking dinner in a modern kitchen.", "blonde hair") == ["She is cooking dinner in a modern kitchen"]
    assert kept("A red dress.", "red_dress") == ["A red dress"]
    assert kept("A red dress.", "red dress") == []
    assert value(one, T.redundant_clauses(F.lit("It is the woman."), F.lit("red dress"), F.lit(0.5))) == []


def test_prose_tokens(one):
    assert value(one, T.prose_tokens(array("she wears a gray sweater"), V.empty())) == ["gray_sweater", "wears", "gray", "sweater"]


@pytest.mark.parametrize(
    "fragment,category",
    [
        ("black t-shirt", "wardrobe"), ("living room with green curtains", "setting"), ("standing with arms crossed", "pose_composition"),
        ("dramatic backlighting with rim light", "lighting"), ("reading a book while drinking coffee", "action"), ("gentle dignified aura", "identity"),
        ("what a day", "wardrobe"), ("upper_body", "identity"), ("upper body", "pose_composition"),
    ],
)
def test_classify(one, fragment, category):
    assert value(one, A.classify(F.lit(fragment))) == category


def test_packing_goes_on_after_a_misfit(one):
    frags = array("a b c d", "e f g h i", "j")
    got = value(one, A.pack_tokens(frags, F.lit(""), F.lit("sdxl"), F.lit(10), F.lit(8)))
    assert got["kept"] == ["a b c d", "j"] and got["removed"] == ["e f g h i"]
    eight = value(one, A.pack_tokens(array(*"abcdefgh"), F.lit(""), F.lit("sdxl"), F.lit(60), F.lit(8)))
    assert eight["used"] == 15 and value(one, T.clip_tokens(F.lit(", ".join("abcdefgh")))) == 17


def test_first_fragment_of_a_category_variant_stays(one):
    got = value(one, A.pack_words(array("a b c", "d"), F.lit(""), F.lit(1), F.lit(1)))
    assert got["kept"] == ["a b c"]


def test_caps():
    assert {c.name: A.cap_of(c) for c in V.CATEGORIES} == {"identity": 3, "wardrobe": 1, "pose_composition": 2, "setting": 1, "lighting": 0, "action": 2}


def test_compose(spark):
    rows = [
        (0, "1girl, solo, sensitive, looking_at_viewer, smile, upper_body, red dress, black boots, white hat, brown_hair", "The image shows a woman reading a book in a sunny garden. She wears a red dress.", 0),
        (1, "standing, garden, red dress", "", 1), (2, None, None, 0), (3, "", "   ", 2),
    ]
    df = spark.createDataFrame(rows, "id int, tags string, prose string, image_index int").withColumn("trigger_word", F.lit("sks"))
    out = {r["id"]: r for r in A.compose(df).collect()}
    first = out[0]
    train = first["caption_variants"]["training"]
    assert train.startswith("sks, ") and "looking_at_viewer" in train and "upper_body" in train and "brown_hair" not in train
    assert "white hat" not in train and "1girl" not in train
    zero = first["caption_variants"]["zeroshot"]
    assert "1girl" in zero and "sensitive" not in zero
    assert "brown_hair" in first["removed_phrases"] and "the image shows" in first["removed_phrases"]
    assert "garden" not in out[1]["caption_variants"]["training"] and "garden" in out[1]["caption_variants"]["setting"]
    assert out[2]["final_caption"] == "sks" and out[3]["final_caption"] == "sks"
    assert "Stripped rating/meta tags that have no training value." in first["compaction_notes"]


def test_diversity_is_repeatable(spark):
    df = spark.createDataFrame([(i, "reading, walking, standing, room, window, red dress", "") for i in range(50)], "id int, tags string, prose string")
    df = df.withColumn("tags", F.concat("tags", F.lit(", cat"), F.col("id").cast("string")))
    a = A.compose(df, drop=0.5, seed=1).select("id", F.col("caption_variants")["training"].alias("t"))
    b = A.compose(df.repartition(7), drop=0.5, seed=1).select("id", F.col("caption_variants")["training"].alias("t"))
    assert dict(a.collect()) == dict(b.collect()) and len({t for _, t in a.collect()}) > 1


def test_categories_are_checked(spark):
    with pytest.raises(ValueError):
        A.compose(spark.createDataFrame([("a", "b")], "tags string, prose string"), [V.Category("mood", ["calm"])])
    custom = [*V.CATEGORIES, V.Category("mood", ["calm"], 2)]
    out = A.compose(spark.createDataFrame([("calm evening", "")], "tags string, prose string"), custom).first()
    assert out["caption_variants"]["mood"] == "calm evening"


def test_profiles(spark):
    assert "lora_training" in A.profiles()
    with pytest.raises(ValueError):
        A.register_profile("lora_training", lambda d: d)
    out = spark.createDataFrame([("standing, smile", "")], "tags string, prose string").transform(A.profile("lora_training")).first()
    assert out["final_caption"] == "standing, smile"


def test_profile_resolution(one):
    assert value(one, T.style_of(F.lit(None).cast("string"), F.lit("ponyXL"), F.lit("sdxl"))) == "anime"
    assert value(one, T.category_of(F.lit("Pose-Composition"), [c.name for c in V.CATEGORIES])) == "pose_composition"
    assert value(one, T.threshold_of(F.lit("Prose"), F.lit(None).cast("double"))) == 0.85
    assert value(one, T.threshold_of(F.lit("nope"), F.lit(None).cast("double"))) == 0.5
    assert abs(value(one, T.threshold_of(F.lit(None).cast("string"), F.lit(2.0))) - 0.9) < 1e-12
