"""Disputes are worked out once for each prose with the tags that can matter to it."""

from pyspark.sql import functions as F
from test_scale import tables

from marlstone.operators import contradiction as C
from marlstone.plans import io_queries as Q

ROWS = [
    (1, "1girl, Red_Dress, smile", "A woman in a blue dress, standing."), (2, "tree,red_dress, 1boy", "A woman in a blue dress, standing."), (3, " RED dress", "A woman in a blue dress, standing."),
    (4, "KNEELING, blacK hat,,", "She is sitting in a white hat and a red coat"), (5, "kneeling,black hat", "She is sitting in a white hat and a red coat"), (6, "black hat,kneeling", "She is sitting in a white hat and a red coat"),
    (7, "half-sitting\nup, gray  skirts, tanned", "Standing; the SKIRT is Black."), (8, None, "A red hat"), (9, "blue hat", None), (10, "blue hat", ""), (11, "", ""), (12, "red", "blue"),
    (13, "ΟΔΟΣ, red ΟΔΟΣ", "a blue οδος"), (14, "scarlet hat, blue hat", "The hat is green"), (15, "blue hat, scarlet hat", "The hat is green"), (16, "redhat, hat red coat", "a green coat"),
]


def test_telling_tags_make_the_same_disputes(spark):
    df = spark.createDataFrame(ROWS, "k int, tags string, prose string").na.fill("")
    both = df.select("k", "tags", C.disputes(F.col("tags"), F.col("prose")).alias("all"), C.telling_tags(F.col("tags")).alias("telling"), C.disputes(C.telling_tags(F.col("tags")), F.col("prose")).alias("some")).collect()
    assert [r["k"] for r in both if r["all"] != r["some"]] == []
    assert sum(len(r["all"]) for r in both) > 10 and {r["k"]: r["telling"] for r in both}[2] == "red_dress"


def test_rows_get_what_their_case_got(spark):
    df = spark.createDataFrame(ROWS, "k int, tags string, prose string")
    worked = []

    def work(cases):
        worked.append(cases.count())
        return C.reconcile(cases)

    want = {r["k"]: (r["prose"], r["prose_before"], r["changes"]) for r in C.reconcile(df).collect()}
    got = C.case_by_case(df, work)
    assert got.columns == ["k", "prose", "prose_before", "changes"]
    assert {r["k"]: (r["prose"], r["prose_before"], r["changes"]) for r in got.collect()} == want
    assert worked == [14]  # 1 and 2; 4 and 5: the others differ in order, spacing or prose


def test_the_verifier_step_gets_cases_not_images(spark, tmp_path, monkeypatch):
    seen, step = [], Q.Q.reconcile_asked
    monkeypatch.setattr(Q.Q, "reconcile_asked", lambda df, *a, **k: seen.append(df.count()) or step(df, *a, **k))
    orders = list(range(1, 2001))
    assert Q.reconcile_asked(spark, tables(tmp_path, orders=orders)).count() == 2000
    assert seen[0] < 1500
