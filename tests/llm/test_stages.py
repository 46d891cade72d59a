"""The pipeline's stages on tables with clashing names, nulls, repeated ids, and none of any rows."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from marlstone.llm import bpe, decontam, exact_dedup, near_dedup, toxicity  # noqa: E402

LONG = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, LONG, "a", "b", 1), (1, LONG, "a", "c", 2), (2, LONG.upper(), None, None, None), (None, None, "x", "y", 3), (3, "", "x", "y", 4),
    (4, "snarl " * 9, "q", "q", 5), (5, "sun tree road house river cloud field stone hill lake", None, "r", 6), (None, LONG + " more", "s", "s", 7),
]
SCHEMA = "doc_id long, text string, TEXT string, __id string, kept int"


def stages(spark):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 2 == 0)) for i in range(20)], "doc_id long, toxic int, TOXIC int")
    bench = spark.createDataFrame([(1, "road house river", 0)], "item_id long, text string, doc_id int")
    return {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels), "exact": lambda d: exact_dedup.drop_copies(d, keep="max"),
        "near": near_dedup.drop_near_copies, "decontamination": lambda d: decontam.drop_contaminated(d, bench),
    }


@pytest.mark.parametrize("name", ["toxicity", "exact", "near", "decontamination"])
def test_stage_keeps_rows_as_they_are(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = stages(spark)[name](df)
    assert got.columns == df.columns
    rows = [tuple(r) for r in got.collect()]
    assert rows and set(rows) <= set(ROWS) and len(rows) == len(set(rows))
    ids = [r[:2] for r in rows]
    if name == "exact":
        assert sorted(map(str, ids)) == sorted(map(str, [(2, LONG.upper()), (3, ""), (4, "snarl " * 9), ROWS[6][:2], ROWS[7][:2]]))
    if name == "near":
        assert sorted(map(str, ids)) == sorted(map(str, [(1, LONG), (None, None), (3, ""), (4, "snarl " * 9), ROWS[6][:2]]))
    if name == "decontamination":
        assert set(rows) == set(ROWS) - {ROWS[6]}
    assert stages(spark)[name](df.limit(0)).count() == 0


def test_encoding_takes_the_same_table(spark):
    coder = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = bpe.encode_documents(df, *coder, with_ids=True)
    assert got.count() == len(ROWS) and got.filter("n_tokens = 0").count() == 2
    assert bpe.encode_documents(df.limit(0), *coder, with_ids=True).count() == 0
