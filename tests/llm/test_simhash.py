"""SimHash near-dedup against brute force: fingerprints, links of planted clouds, odd rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import simhash

SCHEMA = "doc_id long, text string, lang string, node string, DOC_ID string"


def plain_fingerprint(text):
    words = bytes((text or "").encode()).lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def cloud(rng, n, centres, flips):
    out = set()
    middle = [rng.getrandbits(64) for _ in range(centres)]
    while len(out) < n:
        x = rng.choice(middle)
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out, key=lambda x: rng.random())


@pytest.mark.parametrize("centres, flips", [(1, 4), (40, 7), (300, 3), (600, 0)])
def test_forest_spans_the_links(centres, flips):
    rng = random.Random(centres)
    prints = cloud(rng, 600 if flips else centres, centres, flips)
    a, b = simhash.forest(np.array(prints, np.uint64))
    assert all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b))
    want = plain_components(prints)
    assert len(a) == len(prints) - len(set(want))  # a forest: no edge too many
    at = {p: i for i, p in enumerate(prints)}
    assert all(want[at[int(x)]] == want[at[int(y)]] for x, y in zip(a, b))


def test_nodes_hold_what_all_members_share():
    members = np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64) & np.uint64(0xFFFF0000FFFF)
    levels = simhash.hierarchy(members)
    assert len(levels[-1][0]) == 1
    for k, (mask, pattern) in enumerate(levels):
        for i, (m, p) in enumerate(zip(mask, pattern)):
            below = members[i * simhash.FAN**k : (i + 1) * simhash.FAN**k]
            assert ((below & m) == p).all()


def test_quarters_cover_each_bit_once():
    for left in (2**64 - 1, 0xFFFF, 0xF0F0F0F0F0F01, 0b10011, 0b101):
        q = simhash.quarters(left)
        assert sum(q) == left and len(q) == 4 and sum(x.bit_count() for x in q) == left.bit_count()


@pytest.mark.parametrize("group", [simhash.GROUP, 5])
def test_links_are_whole_however_groups_are_opened(spark, group):
    rng = random.Random(9)
    prints = cloud(rng, 500, 60, 6) + cloud(rng, 200, 1, 5)
    prints = list(dict.fromkeys(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    got = dict(simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "node long"), group).collect())
    want = plain_components(prints)
    least = {}
    for x, w in zip(signed, want):
        least[w] = min(least.get(w, x), x)
    assert [got.get(x, x) for x in signed] == [least[w] for w in want]


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(n)] for n in (40, 300, 900)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, "One\x0bTWO"), (7, "É é"), (8, "é é"), (None, " ".join(base[0])), (9, "x y " * 500)]
    for i in range(20, 120):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = "new" + str(rng.randint(0, 9))
        rows.append((i, " ".join(b)))
    rows += [(120, "twice the same"), (120, "twice the same"), (-7, rows[30][1])]
    df = spark.createDataFrame([(i, t, "en", "n", "c") for i, t in rows], SCHEMA).repartition(3)
    got = simhash.simhash_dedup(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    best = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted([(i, f"{p:016x}", best.get(r)) for (i, _), p, r in zip(rows, prints, roots)], key=key)
    assert sorted([tuple(r) for r in got.collect()], key=key) == want


def test_hot_fingerprints_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 10)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same words again").otherwise(F.concat(F.lit("w"), "id", F.lit(" q "), F.md5(F.col("id").cast("string")))).alias("text"))
    got = simhash.simhash_dedup(df)
    assert got.count() == 300 and got.filter("doc_id % 3 > 0 and component_id = 1").count() == 200


def test_empty_table_and_long_text(spark):
    assert simhash.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    from functools import partial

    text = ("Some words that go on, " * 400 + "w" * 500 + " end of it ") * 3
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    want = plain_fingerprint(text)
    assert {simhash.fingerprint(text.encode(), digest, size) for size in (7, 64, 1000, 1 << 20)} == {want}
