"""The stage keeps every row without words, as its operator does."""

from marlstone.llm import near_dedup


def test_near_stage_keeps_repeated_blank_rows(spark):
    rows = [(None, ""), (None, None), (None, ""), (7, " "), (7, " "), (8, "one two three four five six seven"), (8, "one two three four five six seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dedup.near_dedup(df).filter("kept").count() == 6
    got = near_dedup.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["7", "7", "8", "None", "None", "None"]
