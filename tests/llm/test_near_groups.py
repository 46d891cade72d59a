"""Candidates of a large group of near copies grow with the group, not with its square, and no link is lost."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from marlstone.llm import near_dedup  # noqa: E402
from tests.llm.test_llm import near_check, table  # noqa: E402


def near_group(n):
    """One text with ``n`` copies of which about two words in a hundred differ, beside equal copies of another text."""
    rng = random.Random(21)
    fresh = lambda k: [rng.choice("abcdefghij") + str(rng.randint(0, 9999)) for _ in range(k)]
    base, other = fresh(80), " ".join(fresh(60))
    rows = [(i, " ".join(w if rng.random() > 0.025 else fresh(1)[0] for w in base)) for i in range(n)]
    rows.insert(n // 2, (n, " ".join(base)))
    return rows + [(n + 1 + i, other) for i in range(n // 2)] + [(2 * n + i, " ".join(fresh(30))) for i in range(n // 4)]


def test_candidates_grow_with_a_group(spark, monkeypatch):
    pairs, confirmed = [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda p, sets: pairs.append(p.count()) or confirmed(p, sets))
    made = []
    for n in (150, 300):
        pairs.clear()
        rows = near_group(n)
        near_check(near_dedup.near_dedup(table(spark, rows)).collect(), rows)
        made.append(sum(pairs))
    assert made[1] < 2.8 * made[0] and made[1] < 300 * 299 / 2 / 3


def test_stage_takes_clashing_names(spark):
    words = "one two three four five six seven eight nine ten"
    rows = [(1, words, "a", 5, "z"), (2, words + " x", "b", 6, "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, id long, __id string")
    got = near_dedup.drop_near_copies(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([r for r in rows if r[0] != 2], key=str)
    assert near_dedup.drop_near_copies(df.limit(0)).count() == 0
    assert near_dedup.near_dedup(df).agg(F.sum(F.col("kept").cast("int"))).first()[0] == 2
