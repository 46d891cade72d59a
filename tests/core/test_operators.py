import json
import os

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vocab as V
from marlstone.operators import batch as B
from marlstone.operators import contradiction as C
from marlstone.operators import evaluation as E
from marlstone.operators import inference as I
from marlstone.operators import labels as L
from marlstone.sources import readers as R
from marlstone.sources import writers as W
from marlstone.sources.listing import paged_listing
from marlstone.streaming import captions as S


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("x")).first()["x"]


def contradictions(spark, tags, prose):
    return C.with_contradictions(spark.createDataFrame([(tags, prose)], "raw_tags string, raw_prose string")).first()


def test_contradictions(spark):
    r = contradictions(spark, "red_dress, standing, 1girl", "A woman in a blue dress sitting on a chair.")
    assert (r["count"], r["checked"], r["rate"]) == (2, 2, 1.0)
    assert contradictions(spark, "grey_coat, blond_hair", "A gray coat, blonde hair.")["count"] == 0
    assert contradictions(spark, "black_and_white", "a red dress and white wall")["checked"] == 0
    assert contradictions(spark, "red_hair", "long hair, blue dress")["count"] == 0
    assert contradictions(spark, "red_dress", "two blue dresses")["count"] == 1
    assert contradictions(spark, None, None)["rate"] == 0.0


def test_colour_map(one):
    assert value(one, C.colour_map(F.lit("black_and_white, dark_blue, red_dress, blue eyes"))) == {"dress": ["red"], "eyes": ["blue"]}


@pytest.mark.parametrize(
    "prose,subject,new,out",
    [
        ("a blue dress, and a blue sky", "dress", "red", "a red dress, and a blue sky"),
        ("blue eyes in a red dress", "dress", "green", "blue eyes in a green dress"),
        ("Red dress on the chair.", "dress", "blue", "Blue dress on the chair."),
        ("a violet dress", "dress", "violet", "a violet dress"),
    ],
)
def test_recolour(one, prose, subject, new, out):
    assert value(one, C.recoloured(F.lit(prose), F.lit(subject), F.lit(new))) == out


def test_repose_and_reconcile(spark, one):
    got = value(one, C.reposed(F.lit("a sitting figure by a standing lamp"), V.strings(["sitting"]), F.lit("kneeling")))
    assert got == "a kneeling figure by a standing lamp"
    df = spark.createDataFrame([("red_dress, standing", "A blue dress. She is sitting."), ("", "blue"), ("red_dress", "a red dress")], "tags string, prose string")
    a, b, c = C.reconcile(df).collect()
    assert a["prose"] == "A red dress. She is standing." and len(a["changes"]) == 2 and a["prose_before"].startswith("A blue")
    assert b["changes"] == [] and c["prose"] == "a red dress"
    with pytest.raises(ValueError):
        C.verifier("nope")


def test_answers_and_colours(one):
    ask = lambda k, a: value(one, T.parse_answer(F.lit(k), F.lit(a)))
    assert [ask("color", "It is red."), ask("color", "Grey"), ask("pose", "The person is sitting down."), ask("color", "unsure")] == ["red", "gray", "sitting", None]
    near = lambda *c: value(one, T.nearest_colour(*[F.lit(x) for x in c]))
    assert near(250, 10, 10) == "red" and near(10, 20, 210) == "blue"


def test_labels(one):
    assert value(one, L.normalise_labels(V.strings(["automobile", "car", " ", "mountain"]), True)) == ["car", "mountain", "landscape", "nature"]
    assert value(one, L.canonical(F.lit("a"), {"a": "b", "b": "c"})) == "b"
    tags = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).cast("double").alias("score"), F.lit(None).cast("string").alias("source")) for n, s in (("mountain", 0.9), ("x", 0.2), ("nature", None))])
    p = value(one, L.provenance(tags, F.lit("ram"), F.lit(0.5)))
    assert [t["included"] for t in p["tags"]] == [True, False, True] and p["tags"][0]["source"] == "ram"
    assert value(one, T.tag_string(tags, F.lit(0.5))) == "mountain, nature"


def test_select_tags(spark):
    vocab = spark.createDataFrame([(0, "general", 9), (1, "sensitive", 9), (2, "1girl", 0), (3, "solo", 0), (4, "cat", 0), (5, "dog", 0)], "pos int, name string, category int")
    scores = spark.createDataFrame([(1, p, v) for p, v in enumerate([0.99, 0.95, 0.9, 0.5, 0.8, 0.35])], "image_id int, pos int, prob double")
    assert L.select_tags(scores, vocab).first()["tags"] == "1girl, solo, cat"


def test_coverage_and_scorecard(spark):
    rows = [("woman, red dress", "red_dress", ["red_dress", "blue_sky"], "a cat", ["x"], "red_dress", "blue dress", None), ("artist", "", ["art"], "word, " * 60, [], "", "", None), ("a", "", [], "", [], "", "", "boom")]
    df = spark.createDataFrame(rows, "final_caption string, raw_tags string, expected_tags array<string>, t string, removed_phrases array<string>, a string, raw_prose string, error string")
    df = df.withColumn("caption_variants", F.create_map(F.lit("training"), F.col("t"), F.lit("zeroshot"), F.lit("a cat"))).drop("t", "a")
    m = E.with_metrics(df)
    got = m.orderBy(F.length("final_caption").desc()).collect()
    assert got[0]["coverage"]["recall"] == 0.5 and got[0]["coverage"]["missed"] == ["blue_sky"]
    assert got[1]["coverage"]["recall"] == 0.0 and got[1]["over_training"] and not got[1]["over_zeroshot"] and got[2]["coverage"] is None
    card = E.scorecard(m)
    r = card.first()
    assert (r["n"], r["n_errors"], r["n_labelled"]) == (3, 1, 2) and r["over_budget_pct_training"] == 0.5 and r["coverage_recall_mean"] == 0.25
    assert E.passes(card)


def test_gate(spark):
    card = lambda rate, cov: spark.createDataFrame([(rate, cov)], "contradiction_rate_mean double, coverage_recall_mean double")
    got = {r["metric"]: r for r in E.compare(card(0.25, 0.9), card(0.10, 0.8)).collect()}
    assert got["contradiction_rate_mean"]["regressed"] and got["coverage_recall_mean"]["improved"]
    got = E.compare(card(0.105, 0.8), card(0.10, 0.8)).collect()
    assert not any(r["regressed"] or r["improved"] for r in got)


def test_cosine(one):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(one, E.cosine(v(1, 0), v(2, 0))) == 1.0 and value(one, E.cosine(v(0, 0), v(2, 0))) is None


def test_replay(spark):
    assets = spark.createDataFrame([("a", "s1", "u1"), ("b", "s2", "u2")], "id string, sha256 string, uri string")
    caps = spark.createDataFrame([("a", "old", 1, "1"), ("a", "new", 2, "0"), ("b", "bee", None, "0"), ("b", "no", 9, "0")], "asset_id string, final_caption string, version int, created_at string")
    want = spark.createDataFrame([(0, "s1", "u2"), (1, "zz", "u2"), (2, "zz", None)], "k int, sha256 string, uri string")
    got = {r["k"]: (r["matched_by"], r["final_caption"]) for r in B.replay(want, assets, caps).collect()}
    assert got == {0: ("sha256", "new"), 1: ("uri", "bee"), 2: (None, None)}
    assert B.replay(want, assets, caps, "skip").count() == 2
    with pytest.raises(Exception):
        B.replay(want, assets, caps, "fail").collect()


def test_equally_new_captions_go_by_the_smallest_asset(spark):
    assets = [(a, "s", "u") for a in "cab"]
    caps = [(a, f"of {a} {n}", 2, "1") for a in "bca" for n in (1, 0)] + [("a", "old", 1, "1")]
    want = spark.createDataFrame([(0, "s", "u")], "k int, sha256 string, uri string")
    for step in (1, -1):
        kept = spark.createDataFrame(caps[::step], "asset_id string, final_caption string, version int, created_at string").coalesce(1)
        got = B.replay(want, spark.createDataFrame(assets[::step], "id string, sha256 string, uri string"), kept).first()
        assert got["final_caption"] == "of a 0"
        assert {r["final_caption"] for r in B.latest_captions(kept).collect()} == {"of a 0", "of b 0", "of c 0"}


def test_batch_steps(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], "name string, v int, idx int")
    assert {(r["name"], r["position"], r["v"]) for r in B.last_wins(rows).collect()} == {("a", 0, 3), ("b", 1, 2)}
    out = spark.createDataFrame([(0, "/x/cat.jpg", None), (1, "/x/cat.png", None), (2, "/x/sub/../dog.jpg", "bad"), (3, "/x/dog.png", None)], "idx int, path string, error string")
    s = B.sidecar_outcomes(out)
    assert [r["error"] is None for r in s.orderBy("idx").collect()] == [True, False, False, True]
    assert tuple(B.summary(s).first())[:3] == (4, 2, 2)
    plan = B.pull_plan(spark.createDataFrame([(0, "same.jpg"), (1, "sub/same.jpg"), (2, "old.jpg")], "pos int, path string"), spark.createDataFrame([("old.jpg",)], "basename string"))
    assert [r["action"] for r in plan.orderBy("pos").collect()] == ["fetch", "collision", "skip"]
    images = spark.createDataFrame([("/x/a.jpg",), ("/x/b.jpg",)], "path string")
    assert [r["path"] for r in B.skip_captioned(images, spark.createDataFrame([("/x/a.txt",)], "path string")).collect()] == ["/x/b.jpg"]
    idx = B.image_index(spark.range(100).select((99 - F.col("id")).alias("path")).repartition(7), "path").collect()
    assert sorted((r["path"], r["image_index"]) for r in idx) == [(i, i) for i in range(100)]
    known, missing = B.wanted_assets(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",), ("z",)], "id string"))
    assert [r["id"] for r in known.collect()] == ["a"] and [r["id"] for r in missing.collect()] == ["z"]


def test_manifests(spark, tmp_path):
    lines = ['{"image": "a.jpg", "expected_tags": ["x", " "]}', "", "{bad", "[1]", '{"image": ""}', '{"image": "/b.jpg", "expected_tags": "x"}']
    p = tmp_path / "m.jsonl"
    p.write_text("\n".join(lines))
    got = {r["line"]: r for r in R.eval_dataset(spark, str(p)).collect()}
    assert got[1]["expected_tags"] == ["x"] and got[1]["has_labels"] and got[1]["image"] == f"{tmp_path}/a.jpg" and got[1]["error"] is None
    assert "line 3" in got[3]["error"] and "object" in got[4]["error"] and "image" in got[5]["error"] and "list" in got[6]["error"]
    rows = [{"abs_path": "/i/1.jpg"}, {"manifest_version": "2.1", "exported_path": "a/../b.jpg"}, {"exported_path": "../../etc"}, {"exported_path": 5, "abs_path": "/i/2.jpg"}, {"target_profile": 3, "abs_path": "/x"}, {}]
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)))
    got = R.curator_manifest(spark, str(p), "/root").orderBy("line").collect()
    assert [r["image_path"] for r in got][:2] == ["/i/1.jpg", "/root/b.jpg"] and "leaves" in got[2]["error"] and got[3]["image_path"] == "/i/2.jpg"
    assert "object" in got[4]["error"] and "no image" in got[5]["error"]
    p.write_text(json.dumps({"manifest_version": "3.0"}))
    with pytest.raises(ValueError, match="line 1"):
        R.curator_manifest(spark, str(p))


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("b.JPG", "a.png", "sub/c.webp", "n.txt"):
        (tmp_path / n).write_bytes(n.encode())
    got = R.scan_images(spark, str(tmp_path)).collect()
    assert [r["id"] for r in got] == ["a.png", "b.JPG", "sub/c.webp"] and len(got[0]["sha256"]) == 64
    assert [os.path.basename(r["path"]) for r in R.glob_images(spark, str(tmp_path)).collect()] == ["a.png"]
    (tmp_path / "v.csv").write_text("tag_id,name,category\n1,cat,0\n2,general,9\n")
    assert [tuple(r) for r in R.tagger_vocabulary(spark, str(tmp_path / "v.csv")).collect()] == [(0, "cat", 0), (1, "general", 9)]
    inferred = I.infer(spark.read.format("binaryFile").load(str(tmp_path / "a.png")), "hybrid:stub-tags+stub-prose").first()
    assert inferred["tags"] and inferred["prose"] and inferred["error"] is None
    with pytest.raises(ValueError):
        I.backend("none")


def test_exports(spark, one, tmp_path):
    text = value(one, W.xmp(F.lit("lake & sky\x01"), V.strings(["a<b"])))
    assert "lake &amp; sky<" in text and "<rdf:li>a&lt;b</rdf:li>" in text
    df = spark.createDataFrame([("n", "cap", "identity", None, "t", "p", str(tmp_path / "i.jpg"))], "name string, final_caption string, selected_category string, backend_name string, raw_tags string, raw_prose string, path string")
    df = df.withColumn("caption_variants", F.create_map(F.lit("training"), F.lit("tr")))
    r = W.csv_rows(df).first()
    assert (r["training"], r["zeroshot"]) == ("tr", "")
    assert json.loads(W.json_rows(df).first()["value"])["backend_name"] is None
    W.export(df, "", "txt")
    assert (tmp_path / "i.txt").read_text() == "cap"
    for fmt in ("json", "jsonl", "csv"):
        W.export(df.drop("path"), str(tmp_path / fmt), fmt)
        assert spark.read.text(str(tmp_path / fmt)).count() > 0
    with pytest.raises(ValueError):
        W.export(df, "", "xml")
    sent = W.write_back(df.withColumn("id", F.lit("1")), lambda i, d, k: None).collect()
    assert sent[0]["error"] is None


def test_paged_listing(spark):
    def page(number, size, after, before):  # a local function travels to the workers by value
        rows = [("a", "2024-01-01T00:00:00.000Z"), ("b", "2024-01-02T00:00:00.000Z"), ("c", "2024-01-03T00:00:00.000Z")]
        some = [{"id": i, "updated_at": u} for i, u in rows if (not after or u >= after) and (not before or u < before)]
        return {"items": some[(number - 1) * size : number * size], "next_page": number + 1 if number * size < len(some) else None}

    spark.dataSource.register(paged_listing(page, size=1, most=2))
    assert sorted(r["id"] for r in spark.read.format("paged_assets").load().collect()) == ["a", "b", "c"]
    assert [r["id"] for r in spark.read.format("paged_assets").option("since", "2024-01-03T00:00:00Z").load().collect()] == ["c"]
    q = spark.readStream.format("paged_assets").load().writeStream.format("memory").queryName("paged").start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"] for r in spark.table("paged").collect()} == {"a", "b", "c"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, "red dress, standing", "") for i in range(5)], "id int, tags string, prose string").write.parquet(str(tmp_path / "in"))
    stream = S.compose_stream(S.read_inputs(spark, str(tmp_path / "in"), "id int, tags string, prose string"))
    S.write_captions(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    done = S.progress_events(spark.createDataFrame([(0, "a", None), (1, "b", "x")], "idx int, name string, error string")).orderBy("done").collect()
    assert [(r["done"], r["total"], r["status"]) for r in done] == [(1, 2, "ok"), (2, 2, "error")]


def test_message_parts(spark, one):
    assert value(one, T.xmp_text(F.lit("a&<>"))) == "a&amp;&lt;&gt;"
    assert value(one, R.message_text(F.lit('[{"type":"text","text":"a"},{"type":"text","text":"b"}]'))) == "ab"
    assert value(one, R.message_text(F.lit('"x"'))) == "x"
    df = spark.createDataFrame([([("user", [("text", "hi", None), ("image_url", None, "data:image/png;base64,QUI=")]), ("user", None)],)], "m array<struct<role: string, content: array<struct<type: string, text: string, image_url: string>>>>")
    assert bytes(df.select(R.chat_image(F.col("m")).alias("x")).first()["x"]["data"]) == b"AB"


def test_a_grounded_verifier_names_the_first_boxs_colour(spark):
    red, blue = (200, 30, 30), (40, 70, 200)
    pixels = [red, red, blue, blue] * 2  # four wide, two high
    rows = [
        ("red hat", "a blue hat", {"hat": [(-3.0, 0.0, 2.4, 9.0)]}),        # clamped and rounded: red
        ("red hat", "a blue hat", {"hat": [(2.0, 0.0, 4.0, 2.0)]}),         # blue, as the prose says
        ("red hat", "a blue hat", {"hat": [(1.6, 0.0, 2.4, 2.0)]}),         # no area: abstains
        ("red hat", "a blue hat", {}),                                     # nothing found
        ("standing", "she is sitting", {"posture": [(0.0, 0.0, 4.0, 2.0)]}),  # postures aren't measured
    ]
    box = "array<struct<x0: double, y0: double, x1: double, y1: double>>"
    df = spark.createDataFrame([(i, *r, pixels, 4) for i, r in enumerate(rows)], f"i int, tags string, prose string, boxes map<string, {box}>, pixels array<struct<r: int, g: int, b: int>>, width int")
    got = C.reconcile(df, C.grounded(F.col("boxes"), F.col("pixels"), F.col("width"))).orderBy("i").collect()
    assert [r["prose"] for r in got] == ["a red hat", "a blue hat", "a blue hat", "a blue hat", "she is sitting"]


def test_free_answers_reconcile_and_unreadable_ones_do_not(spark):
    df = spark.createDataFrame([(1, "red hat, standing", "a blue hat, sitting"), (2, "red hat", "a blue hat"), (3, None, "a blue hat")], "id int, tags string, prose string")
    asked = C.questions(df, "id").collect()
    assert sorted((r["id"], r["kind"], r["subject"]) for r in asked) == [(1, "color", "hat"), (1, "pose", "posture"), (2, "color", "hat")]
    answers = spark.createDataFrame([(1, "color", "hat", "Green."), (1, "pose", "posture", None), (2, "color", "hat", "no idea")], "id int, kind string, subject string, answer string")
    got = C.reconcile_answered(df, "id", answers).orderBy("id").collect()
    assert [r["prose"] for r in got] == ["a green hat, sitting", "a blue hat", "a blue hat"]


def test_posture_letters_inside_other_words_stay(spark):
    df = spark.createDataFrame([("standing", "Sitting, sitting2 and x_sitting")], "tags string, prose string")
    assert C.reconcile(df).first()["prose"] == "Standing, sitting2 and x_sitting"


def test_nested_baselines_and_the_report(spark):
    card = spark.createDataFrame([(0.5, 0.2)], "contradiction_rate_mean double, over_budget_pct_training double")
    base = spark.createDataFrame([((0.1, (0.3, "n/a"), "none"),)], "aggregates struct<contradiction_rate_mean: double, over_budget_pct: struct<training: double, zeroshot: string>, clip_mean: string>")
    flat = E.flattened(base)
    assert flat.first().asDict() == {"contradiction_rate_mean": 0.1, "over_budget_pct_training": 0.3, "over_budget_pct_zeroshot": None, "clip_mean": None}
    lines = [r["line"] for r in E.comparison_report(E.compare(card, flat)).orderBy("pos").collect()]
    assert lines == ["  ✗ contradiction_rate_mean: 0.100 → 0.500 (+0.400)", "  ✓ over_budget_pct_training: 0.300 → 0.200 (-0.100)", "  verdict: REGRESSED"]
    assert [r["line"] for r in E.comparison_report(E.compare(card, flat.select("clip_mean"))).collect()] == ["  verdict: OK"]


def test_browse_pull_warnings_and_replayed_defaults(spark):
    paths = ["top.png", "a/x.JPG", "a/b/y.gif", "a/.h/z.png", "a/b/n.txt", ".hid/q.png", "a/b/c/w.webp", "a/.jpg"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    folders, here = B.browse(files)
    assert [tuple(r) for r in folders.collect()] == [("a", "a", 4, 1)] and tuple(here.first()) == ("", None, 1)
    folders, here = B.browse(files, "a/b", cap=1)
    assert [tuple(r) for r in folders.collect()] == [("c", "a/b/c", 1, 0)] and tuple(here.first()) == ("a/b", "a", 1)
    plan = B.pull_plan(spark.createDataFrame([(0, "a.mp4"), (1, "b"), (2, "c.PNG"), (3, "x/a.mp4")], "pos int, path string"), spark.createDataFrame([], "basename string"))
    assert [r["warning"] for r in plan.orderBy("pos").collect()] == ["not captionable: '.mp4' is not a supported image type", "not captionable: file has no extension", None, None]
    hits = spark.createDataFrame([("s", None, "sha256", None, {"target_category": "setting"}, 3), ("t", "u", "uri", "text", None, None), ("m", None, None, None, None, None)], "sha256 string, uri string, matched_by string, final_caption string, profile map<string,string>, version int")
    got = sorted(B.replayed_results(hits).collect(), key=lambda r: r["sha256"])
    assert [(r["final_caption"], r["selected_category"], r["backend_name"], r["caption_variants"], r["replay"]["caption_version"]) for r in got] == [("", "setting", "replay", {}, 3), ("text", "identity", "replay", {}, None)]
