"""The sample for a fit is bounded after rows that can't be used are gone; long texts are in it."""

import random

from marlstone.llm import fitting, language, quality, toxicity


def test_sample_is_full_where_many_texts_are_missing(spark):
    docs = [(i, None if i % 10 == 1 else "text %d" % i) for i in range(2000) if i % 10 != 2]
    labels = [(i, i // 10 % 2) for i in range(2000)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample, share = fitting.labelled_sample(docs, labels.union(labels), "toxic", 20, 1000)
    assert [sum(y == k for _, y, _ in sample) for k in (0, 1)] == [20, 20]
    assert len({t for t, _, _ in sample}) == 40 and 0.4 < share < 0.6
    few, _ = fitting.labelled_sample(docs, labels, "toxic", 20, 30)  # bytes bind first, rows stay whole
    assert set(few) < set(sample) and 2 <= len(few) <= 10
    assert len(fitting.labelled_sample(docs, labels, "toxic", 20, 1)[0]) == 2


def test_repeated_and_contradictory_labels(spark):
    docs = spark.createDataFrame([(i, "text %d" % (i % 3)) for i in (1, 1, 2, 4, 5, 6, 8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in (1, 2, 4, 5, 6, 8) for y in (0, 1, 1)], "doc_id long, quality int")
    sample, _ = fitting.labelled_sample(docs, labels, "quality", 99, 1 << 20)
    ones, zeros = [t for t, y, _ in sample if y], [t for t, y, _ in sample if not y]
    assert sorted(ones) == sorted(zeros) and ones
    for score in (toxicity.score_toxicity, quality.score_quality):
        both = labels.withColumnRenamed("quality", "toxic").selectExpr("doc_id", "toxic", "toxic AS quality")
        assert score(docs, both).count() == 7


def test_classifiers_learn_from_long_texts_only(spark):
    rng = random.Random(2)
    pool = ["sun", "tree", "road", "house", "river", "cloud", "field", "stone"]
    rows, labels = [], []
    for i in range(200):
        y = i % 2
        w = [rng.choice(pool) for _ in range(1500)]
        if y:
            for _ in range(30):
                w[rng.randrange(1500)] = rng.choice(["snarl", "grumble"])
        rows.append((i, " ".join(w)))
        labels.append((i, y, y))
    assert min(len(t) for _, t in rows) > 6000
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = {r["doc_id"]: r for r in score(docs, given).filter("held_out").collect()}
        ones, zeros = [[r["score"] for i, r in got.items() if i % 2 == k] for k in (1, 0)]
        assert sum(a > b for a in ones for b in zeros) >= 0.95 * len(ones) * len(zeros)


def test_language_learns_from_long_texts_only(spark):
    rng = random.Random(3)
    pools = {"xx": ["the", "and", "thing", "then"], "yy": ["der", "und", "ding", "dann"]}
    rows = [(i, " ".join(rng.choice(pools[k]) for _ in range(6000)), k) for i in range(12) for k in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.training_sample(df, 5, 50_000)
    assert set(got) == {"xx", "yy"} and all(1 <= len(v) <= 3 for v in got.values())
    assert all(len(v) == 1 for v in language.training_sample(df, 5, 1).values())
