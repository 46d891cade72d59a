"""The corpus operators against brute force, on small and awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from marlstone.llm import bpe, chat, decontam, exact_dedup, fitting, language, near_dedup, quality, repeats, sharding, toxicity  # noqa: E402
from marlstone.llm.words import ALNUM, text_buffer  # noqa: E402
from marlstone.llm.words import words as find_words  # noqa: E402

AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, kept string, SHARD string"


def table(spark, rows, parts=3):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA).repartition(parts)


def awkward():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 60))
    base = [" ".join(word() for _ in range(n)) for n in (3, 30, 60, 200)]
    rows = [(0, None), (1, ""), (2, "  \n"), (None, base[1]), (4, "É É"), (5, "é é"), (6, base[3] * 40)]
    for i in range(10, 90):
        b = rng.choice(base).split()
        rows.append((i, " ".join(w.upper() if rng.random() < 0.03 else word() if rng.random() < 0.04 else w for w in b)))
    return rows + [(90, base[2]), (90, base[2]), (91, base[2]), (91, base[2].upper())]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [(1, "x")]).filter("doc_id < 0")


def norm(t):
    return (t or "").encode().translate(AZ)


# 1 chat


def test_chat_round_trip(spark):
    hard = [chat.HARD_TEXT, "a\\sb", "<\\p", "\\", "<|", "<|im_end|>\n", "", None, "x\n<|im_start|>y", "plain", "<", "\\n"]
    rows = [(c, t, r, hard[(c * 5 + t) % len(hard)]) for c in range(12) for t, r in enumerate(["user", "assistant", "sys\ntem", None, "<|im_end|>", "a\\nb"])]
    rows += [(None, 0, "user", "q"), (3, 0, "user", "tie"), (7, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.format_chat(df).collect()
    assert all(r["round_trip"] for r in out) and len(out) == 13
    for r in out:
        mine = sorted(((t if t is not None else -1, a or "", b or "") for c, t, a, b in rows if c == r["conv_id"]), key=lambda x: x)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, a, b in mine]
        cut = ["".join(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        plain = [c.replace("<\\p", "<|").replace("\\s", "\\") for c in cut]
        assert plain == [b for _, a, b in mine if a == "assistant"]
    d = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chat(df)).collect()}
    mine = sorted((t or 0, a or "", b or "") for c, t, a, b in rows if c == 5)
    assert d[5]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
    assert chat.format_chat(df.filter("turn > 99")).count() == 0


def test_loss_is_read_under_the_mask(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    texts = ["aé日" * 9, chat.HARD_TEXT, "", "x\\sy" * 5, "日"]
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    shown = chat.format_chat(df)
    got = {r["conv_id"]: r for r in chat.chat_digests(shown).collect()}
    want = texts[1] + texts[3]
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(want), hashlib.sha256(want.encode()).hexdigest())
    assert (got[2]["loss_chars"], got[2]["loss_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    # a wrong mask is seen
    wrong = shown.withColumn("loss_spans", F.expr("transform(loss_spans, s -> named_struct('start', s.start + 1, 'end', s.end + 1))"))
    assert chat.chat_digests(wrong).filter("conv_id = 1").first()["loss_sha256"] != got[1]["loss_sha256"]
    with pytest.raises(Exception, match="recovered"):
        chat.chat_digests(shown.withColumn("round_trip", F.lit(False))).collect()


def test_chat_takes_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "b", "c", 3), (1, None, None, None, None, None, None)], "conv_id long, turn long, role string, text string, formatted string, turns string, n_turns long")
    got = chat.chat_digests(chat.format_chat(df)).collect()
    assert len(got) == 1 and got[0]["n_turns"] == 2


def test_chat_escapes_only_what_conflicts(spark):
    text = "a\\b and <tag>"
    df = spark.createDataFrame([(1, 0, "user", text), (2, 0, "user", text + "<|im_end|>")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_chat(df).collect()}
    assert got[1] == f"<|im_start|>user\n{text}<|im_end|>\n" and "a\\sb" in got[2] and "<\\pim_end|>" in got[2]


# 2 exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, keep):
    rows = awkward()
    got = exact_dedup.exact_dedup(docs, keep, fan_in=2).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(rows)
    best = {k: (min if keep == "min" else max)((i for i in v if i is not None), default=None) for k, v in groups.items()}
    by_sha = {hashlib.sha256(k).hexdigest(): k for k in groups}
    kept = {}
    for r in got:
        k = by_sha[r["text_sha256"]]
        assert r["keep_id"] == best[k] and r["group_size"] == len(groups[k])
        if r["kept"]:
            assert r["doc_id"] == best[k]
            kept[k] = kept.get(k, 0) + 1
    assert kept == {k: 1 for k in groups}
    assert exact_dedup.drop_copies(docs, keep).count() == len(groups)
    assert set(exact_dedup.drop_copies(docs, keep).columns) == set(docs.columns)


def test_exact_dedup_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(nothing, "first")


# 3 near dedup


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", norm(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                up[root(a)] = root(b)
    return sets, [root(i) for i in range(len(rows))]


def near_check(got, rows):
    sets, roots = brute_components(rows)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((i if i is not None else -1, len(s), (least.get(r) if s else i) if (least.get(r) if s else i) is not None else -1) for (i, _), s, r in zip(rows, sets, roots))
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got)
    assert have == want


def test_near_dedup(docs, nothing):
    near_check(near_dedup.near_dedup(docs).collect(), awkward())
    assert near_dedup.near_dedup(nothing).count() == 0


def test_near_dedup_loses_no_link_in_mixed_buckets(spark):
    rng = random.Random(9)
    fresh = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(n)]
    rows, i = [], 0
    for n, m in ((90, 45), (40, 25), (25, 15)):  # copies at edit rates around the threshold
        base = fresh(n)
        for _ in range(m):
            e = rng.uniform(0, 0.09)
            rows.append((i, " ".join(w if rng.random() > e else fresh(1)[0] for w in base)))
            i += 1
    passage = fresh(60)
    for _ in range(40):
        rows.append((i, " ".join(fresh(rng.randint(5, 40)) + passage + fresh(rng.randint(5, 30)))))
        i += 1
    near_check(near_dedup.near_dedup(table(spark, rows)).collect(), rows)


def test_near_stage_keeps_one_of_each_group(docs):
    rows = awkward()
    sets, roots = brute_components(rows)
    left = near_dedup.drop_near_copies(docs)
    assert set(left.columns) == set(docs.columns)
    blank = sum(1 for s in sets if not s)
    assert left.count() == len({r for r, s in zip(roots, sets) if s}) + blank


# 4 sharding


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(docs, shards):
    rows = awkward()
    got = sharding.shard_documents(docs, shards).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(shards))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_sharding_follows_the_ring(spark):
    """The same placement as inserting rows one by one in arrival order."""
    rows = [(i % 700, f"t{i}") for i in range(900)]  # some ids repeat
    df = table(spark, rows)
    got = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard_documents(df, 5).collect()}
    order = df.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("c"))
    order = order.withColumn("at", F.xxhash64(F.lit("arrival"), "doc_id", "size", "c")).withColumn("place", F.pmod(F.xxhash64(F.lit("ring"), "doc_id"), F.lit(sharding.RING)))
    nodes, room = [], [180] * 5
    for s in range(5):
        r = random.Random(f"7/{s}")
        nodes += [(r.randrange(sharding.RING), s) for _ in range(sharding.VNODES)]
    nodes.sort()
    for r in sorted(order.collect(), key=lambda r: r["at"]):
        clockwise = [s for p, s in nodes if p >= r["place"]] + [s for p, s in nodes]
        s = next(s for s in clockwise if room[s])
        room[s] -= 1
        assert got[(r["doc_id"], r["c"])] == s


def test_sharding_moves_little_and_handles_hot_ids(spark, nothing):
    df = table(spark, [(i, f"t{i}") for i in range(2000)])
    a = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 8, slack=0.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 9, slack=0.25).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a) and max(list(a.values()).count(s) for s in range(8)) <= 313
    hot = table(spark, [(7, f"t{i}") for i in range(100)] + [(7, "same")] * 50 + [(i, "z") for i in range(50)])
    n = [r["count"] for r in sharding.shard_documents(hot, 8).groupBy("shard").count().collect()]
    assert sum(n) == 200 and max(n) - min(n) <= 1
    assert sharding.shard_documents(nothing, 8).count() == 0


def test_every_shard_has_its_arcs_and_movement_is_bounded(spark):
    for shards in (8, 64, 200):
        points, near = sharding.ring(shards)
        assert len(points) == shards * sharding.VNODES and {n[0] for n in near} == set(range(shards))
        assert all(sorted(n) == list(range(shards)) for n in near[:5])
    with pytest.raises(ValueError):
        sharding.shard_documents(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 1000)
    df = table(spark, [(i, f"t{i}") for i in range(4000)])
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, n).collect()} for n in (8, 9))
    moved = sum(a[i] != b[i] for i in a) / len(a)
    print("moved at slack 0:", moved)  # 1/9 must move; a modulo would move 8/9
    assert moved < 0.45


def test_sharding_numbers_a_hot_document_in_parts(spark):
    hot = table(spark, [(7, "same")] * 3000 + [(i, "z") for i in range(100)], parts=6)
    got = sharding.shard_documents(hot, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 3100 and all(sorted(v) == list(range(775)) for v in by.values())


# 5 language


def test_language(spark, nothing):
    rng = random.Random(1)
    pools = {"xx": ["the", "and", "thing", "then"], "yy": ["der", "und", "ding", "dann"]}
    rows = [(i, " ".join(rng.choice(pools[lang]) for _ in range(rng.randint(3, 40))), lang) for i in range(200) for lang in [rng.choice(["xx", "yy"])]]
    rows += [(500, None, "xx"), (501, "", None), (502, "123 !!", "yy"), (503, "the and " * 20_000, None), (504, "x" * 5000, None), (None, "und der", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in language.identify(df, path).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, t, lang in rows if lang and t and i < 500 and got[i]["lang_pred"] != lang]
    assert not wrong
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503)] == ["und", "und", "und", "xx"] and got[None]["lang_pred"] == "yy"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i if i is not None else "").encode()) % 5 == 0) for i, r in got.items())
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", F.lit(None).cast("string")), path).collect()} == {"und"}
    assert language.identify(nothing, path).count() == 0


def test_forward_sum_is_over_all_segmentations():
    names = sorted(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bab"])
    pieces = language.Pieces(names)
    p = np.random.default_rng(0).random((len(names) + 1, 2))
    words = ["abab", "b", "zab", "a" * 100]

    def every(w, k):
        if not w:
            return 1.0
        out = 0.0
        for n in range(1, min(len(w), 3) + 1):
            at = names.index(w[:n]) if w[:n] in names else len(names) if n == 1 else None
            if at is not None:
                out += p[at, k] * every(w[n:], k)
        return out

    d = language.DistinctWords([" ".join(words[:3])])
    got = language.word_scores(d.spell(), pieces, p)
    for i, w in enumerate(words[:3]):
        assert np.allclose(got[d.which[i]], [np.log(every("▁" + w, k)) for k in range(2)])
    assert len(language.DistinctWords([words[3]], 47).which) == 3  # the fit takes stretches


def test_words_of_any_length_are_summed_whole():
    names = sorted(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bab"])
    p = np.random.default_rng(0).random((len(names) + 1, 2))
    rng = random.Random(5)
    words = ["".join(rng.choice("abz") for _ in range(n)) for n in (1, 46, 47, 48, 49, 95, 96, 97, 700, 5000)]
    d = language.DistinctWords([" ".join(words)])
    got = language.word_scores(d.spell(), language.Pieces(names), p)
    for i, w in enumerate(words):
        w = "▁" + w
        last, outside = [np.ones(2)], np.zeros(2)  # sums over the segmentations of the first k characters
        for k in range(1, len(w) + 1):
            now = np.zeros(2)
            for n in range(1, min(k, 3) + 1):
                piece = w[k - n : k]
                if piece in names or n == 1:
                    now = now + last[-n] * p[names.index(piece) if piece in names else len(names)]
            last, outside = [x / now for x in [*last[-3:], now]], outside + np.log(now)
        assert np.allclose(got[d.which[i]], np.log(last[-1]) + outside, rtol=1e-9), len(w)


def test_language_scores_ignore_neighbours():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    names = sorted(["▁", "a", "b", "ab", "▁a"])
    p = np.random.default_rng(1).random((len(names) + 1, 2))
    score = lambda part: language.text_scores(language.DistinctWords(part), lambda d: language.word_scores(d.spell(), language.Pieces(names), p), 2)
    together = score(texts)
    assert all(np.array_equal(score([t])[0], together[i]) for i, t in enumerate(texts))


# 6 byte-level BPE


def test_bpe(spark, docs, nothing):
    import base64

    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "1", "é", " !", "...", "日本", "\t", "'"]
    odd = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))) for i in range(80)] + [(2000, "x" * 400), (2001, " " * 200), (2002, "<|endoftext|>" * 9)]
    rows = awkward() + odd
    df = table(spark, rows)
    want = sorted((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in rows for ids in [coder.encode_ordinary(t or "")])
    for options in ({}, {"chunk": 40, "overlap": 12}, {"chunk": 200, "overlap": 30}):
        got = bpe.encode_documents(df, path, pattern, **options).collect()
        assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want, options
    ids = bpe.encode_documents(df, path, pattern, with_ids=True).filter("doc_id = 90").first()["ids"]
    assert coder.decode(ids) == dict(awkward())[90]
    assert bpe.encode_documents(nothing, path, pattern).count() == 0


# 7 and 8 classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    bad, rude = ["%%%", "$$$", "!!!"], ["grumble", "grumbly", "snarl"]
    rows, labels = [], []
    for i in range(700):
        q, t = int(rng.random() > 0.3), int(rng.random() < 0.25)
        w = [rng.choice(["sun", "tree", "road", "house", "river", "cloud"]) for _ in range(rng.randint(10, 60))]
        w = [x if q else x + rng.choice(bad) for x in w]
        if t:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(rude))
        rows.append((i, " ".join(w)))
        labels.append((i, q, t))
    rows += [(900, None), (901, ""), (902, "sun " * 30_000), (None, "tree")]
    return table(spark, rows), spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("score,place", [(quality.score_quality, 0), (toxicity.score_toxicity, 1)])
def test_classifiers(labelled, nothing, score, place):
    docs, labels, truth = labelled
    got = {r["doc_id"]: r for r in score(docs, labels).collect()}
    assert len(got) == 704 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in truth if got[i]["held_out"]]
    assert held and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    hits = sum((got[i]["predicted"] == truth[i][place]) for i in held)
    assert hits / len(held) > 0.95
    again = {r["doc_id"]: r["score"] for r in score(docs.repartition(5), labels).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-6 for i in got)
    flat = {r["score"] for r in score(docs, labels.filter("doc_id < 0")).collect()}
    assert len(flat) == 1
    assert score(nothing, labels).count() == 0


def test_held_out_labels_are_not_learned(labelled):
    docs, labels, _ = labelled
    sample, share = fitting.labelled_sample(docs, labels, "toxic", 50, 10_000)
    assert len(sample) <= 100 and 0 < share < 1
    swapped = labels.withColumn("toxic", F.when(fitting.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fitting.labelled_sample(docs, swapped, "toxic", 50, 10_000) == (sample, share)


def test_toxic_stage(labelled):
    docs, labels, truth = labelled
    left = toxicity.drop_toxic(docs, labels)
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).filter("predicted = 1").collect()}
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {*truth, 900, 901, 902, None} - bad


# 9 decontamination


def brute_hits(rows, items):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", norm(t))
    windows = {}
    for item, t in items:
        w = cut(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, t in rows:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= who
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_decontamination(spark, docs, nothing, monkeypatch, limit):
    monkeypatch.setattr(decontam.blocks_of, "__defaults__", (limit,))
    rows = awkward()
    words = rows[6][1].split()
    items = [(1, " ".join(words[5:25])), (2, " ".join(words[8:18])), (10, words[3]), (11, "É"), (12, None), (13, "!!"), (2, " ".join(words[8:18])), (14, " ".join(["none"] * 12)), (15, "d1 d2")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = decontam.contamination(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == brute_hits(rows, items)
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not r["contaminated"] for r in got)
    assert decontam.contamination(nothing, bench).count() == 0
    assert not decontam.contamination(docs, bench.filter("item_id < 0")).filter("contaminated").count()


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_longest_matches_and_their_places(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam.blocks_of, "__defaults__", (limit,))
    rng = random.Random(12)
    fresh = lambda n: [rng.choice("pqrs") + str(rng.randint(0, 99)) for _ in range(n)]
    a, b = fresh(40), fresh(30)
    items = [("a", " ".join(a)), ("b", " ".join(b)), ("c", "tiny"), ("d", " ".join(["again"] * 12))]
    rows = [(1, fresh(7) + a[5:30] + b[:12] + fresh(3)), (2, a + a[2:11]), (3, fresh(50)), (4, ["tiny"] + b[20:]), (5, ["again"] * 11), (6, [])]
    got = set()
    df = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in rows], "doc_id long, text string")
    for r in decontam.contamination(df, spark.createDataFrame(items, "item_id string, text string")).collect():
        got |= {(r["doc_id"], m["item_id"], m["doc_word"], m["item_word"], m["n_words"]) for m in r["matches"]}
    want = set()
    for i, w in rows:
        for name, text in items:
            q = text.split()
            least = min(10, len(q))
            for x in range(len(w)):
                for y in range(len(q)):
                    n = next((k for k in range(min(len(w) - x, len(q) - y)) if w[x + k] != q[y + k]), min(len(w) - x, len(q) - y))
                    if n >= least and not (x and y and w[x - 1] == q[y - 1]):
                        want.add((i, name, x, y, n))
    assert got == want and len(want) > 8


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1000])
def test_decontamination_cuts_arrays_of_long_texts(monkeypatch, size):
    rng = random.Random(size)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 300, 4, 90)]
    queries = decontam.item_windows(["p", "q"], [" ".join(texts[1].split()[40:60]), texts[3][:7]])
    data, offsets = text_buffer(pa.array(texts))
    w = find_words(data, offsets, ALNUM)
    whole = decontam._occurrences(w.number, w.first, queries)
    monkeypatch.setattr(decontam, "SHARD_WORDS", size)
    cut = decontam._occurrences(w.number, w.first, queries)
    assert whole and whole.keys() == cut.keys()
    assert all(np.array_equal(x, y) for size in whole for x, y in zip(whole[size], cut[size]))


def test_decontamination_of_one_word_many_times(spark):
    n = 150_000
    queries = decontam.item_windows(["a", "b"], ["again " * n, "again " * 12 + "other"])
    batch = pa.record_batch([pa.array(["Again, " * n])], names=["text"])
    ((_, _, count, hit, _, items, _),) = decontam._scan(queries, 0, True, False)(batch)
    assert count[0] == hit[0] == n and items == [["a", "b"]]
    # with places: one match for each diagonal, none of them a pair of places inside another
    ((*_, matches),) = decontam._scan(decontam.item_windows(["a"], ["again " * 3000]), 0, True, True)(pa.record_batch([pa.array(["again " * 2000])], names=["text"]))
    want = {(max(0, -d), max(0, d), min(2000 - max(0, -d), 3000 - max(0, d))) for d in range(-1990, 2991)}
    assert {(m["doc_word"], m["item_word"], m["n_words"]) for m in matches[0]} == want and len(matches[0]) == len(want)


def test_matches_of_repetitive_texts(spark):
    rng = random.Random(31)
    rows = [(i, [rng.choice("ab") for _ in range(rng.randint(0, 120))]) for i in range(8)] + [(9, list("abab" * 20))]
    items = [(str(k), [rng.choice("ab") for _ in range(rng.choice([1, 4, 9, 60]))]) for k in range(5)] + [("x", list("ab" * 15)), ("x", list("ba" * 8))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")
    found = decontam.contamination(docs, bench, with_matches=True).collect()
    got = sorted((r["doc_id"], m["item_id"], m["doc_word"], m["item_word"], m["n_words"]) for r in found for m in r["matches"])
    want = []
    for i, w in rows:
        for name, q in items:
            for x in range(len(w)):
                for y in range(len(q)):
                    n = next((k for k in range(min(len(w) - x, len(q) - y)) if w[x + k] != q[y + k]), min(len(w) - x, len(q) - y))
                    if n >= min(10, len(q)) and not (x and y and w[x - 1] == q[y - 1]):
                        want.append((i, name, x, y, n))
    assert got == sorted(want) and want
    as_rows = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found)
    assert as_rows == brute_hits([(i, " ".join(w)) for i, w in rows], [(i, " ".join(w)) for i, w in items])


# 10 repeats


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_repeats(spark, docs, nothing):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(3)]
    pick = lambda: rng.choice([base[0][: rng.randint(50, 300)], base[1][rng.randint(0, 200) :], "a" * rng.randint(1, 260), "abc" * rng.randint(1, 90), base[2], "é" * 70])
    rows = [(i, "".join(pick() for _ in range(rng.randint(0, 5)))) for i in range(60)]
    for df, given in ((table(spark, rows), rows), (docs.filter("doc_id is null or doc_id < 90"), [r for r in awkward() if r[0] is None or r[0] < 90])):
        got = repeats.remove_repeats(df).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(given)
    assert repeats.remove_repeats(nothing).count() == 0


def test_repeats_in_repeated_rows(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef") for _ in range(150))
    got = sorted(r["n_removed"] for r in repeats.remove_repeats(table(spark, [(1, text), (1, text), (2, text[:99])])).collect())
    assert got == [0, 0, 150]


def common_line(n):
    """Texts whose one common line of 90 bytes stands in different surroundings, some of which repeat."""
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh") for _ in range(90))
    around = lambda: "".join(rng.choice("abcdefgh") for _ in range(80))
    rows = [(i, around() + line + around()) for i in range(n)]
    return rows + [(n + i, "#" + rows[i][1][rng.randint(20, 60) : rng.randint(170, 200)] + str(i)) for i in range(0, n, 7)]


def repeats_in_one_process(rows, levels=2):
    """The steps of remove_repeats without Spark: bytes removed by document, and the heavy anchors."""

    def ordered(batches, by):
        table_ = pa.Table.from_batches(list(batches))
        if "bytes" in by:  # binary columns have no sort here
            key = sorted(range(table_.num_rows), key=lambda i: tuple(table_.column(c)[i].as_py() for c in by))
            return table_.take(key).to_batches(max_chunksize=300)
        return table_.sort_by([(x, "ascending") for x in by]).to_batches(max_chunksize=300)

    text = dict(rows)
    given = pa.record_batch([pa.array(list(text)), pa.array(list(text.values()))], names=["doc", "text"])
    parts = ordered(repeats._segments([given]), ["again", "anchor", "mark", "doc", "span"])
    sifted = [r for b in repeats._sift(iter(parts)) for r in b.to_pylist()]
    heavy = [r["anchor"] for r in sifted if r["doc"] is None]
    assert len(heavy) == len(set(heavy))
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("span", pa.int64())]))
    none = pa.record_batch([pa.array([-1]), pa.array([-1]), pa.array(["a text of which nothing is wanted"]), pa.array([None], kind)], names=["doc", "doc_id", "text", "want"])
    piece = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("span", pa.int64()), ("bytes", pa.binary())])

    def fetched(of_heavy):
        want = {}
        for r in sifted:
            if r["anchor"] is not None and r["doc"] is not None and (r["anchor"] in heavy) == of_heavy:
                want.setdefault(r["doc"], []).append({"anchor": r["anchor"], "span": r["span"]})
        ids = sorted(want, key=lambda i: zlib.crc32(str(i).encode()))
        wanted = pa.record_batch([pa.array(ids, pa.int64()), pa.array(ids, pa.int64()), pa.array([text[i] for i in ids], pa.string()), pa.array([want[i] for i in ids], kind)], names=none.schema.names)
        return pa.Table.from_batches(list(repeats._cut([none, wanted])), piece)

    of = lambda t, flag, name: t.filter(pa.array([x == flag for x in t.column(name).to_pylist()], pa.bool_())).drop_columns([name])
    light, rest = [fetched(False)], fetched(True)
    marks = [r for r in sifted if r["anchor"] is None]
    by = ["anchor", "bytes", "doc", "span"]
    for level in range(1, levels + 2):
        last = level == levels + 1
        if not rest.num_rows:
            break
        step = repeats._windows if last else repeats._refine(level)
        told = pa.Table.from_batches(list(repeats._once(iter(ordered(step(rest.to_batches()), by)))))
        marks += of(told, True, "again").to_pylist()
        firsts = of(told, False, "again")
        size = {}
        for x, n in zip(firsts.column("anchor").to_pylist(), firsts.column("span").to_pylist()):
            size[x] = size.get(x, 0) + (n & 255)
        large = [size[x] > repeats.INDEX_BYTES for x in firsts.column("anchor").to_pylist()]
        if not last:
            light.append(firsts.filter(pa.array([not x for x in large], pa.bool_())))
        rest = firsts.filter(pa.array(large, pa.bool_()))
    gone = {i: bytearray(len(t)) for i, t in rows}
    met = ordered([b for t in light for b in t.to_batches()], ["anchor", "doc", "span"])
    marks += [r for b in repeats._index(iter(met)) for r in b.to_pylist()]
    for r in marks:
        start, length = r["span"] >> 8, r["span"] & 255
        gone[r["doc"]][start : start + length] = b"\1" * length
    return {i: sum(x) for i, x in gone.items()}, heavy


@pytest.mark.parametrize("limit, levels", [(20_000, 3), (20_000, 0), (3_000, 1), (600, 2)])
def test_repeats_index_stays_bounded(monkeypatch, limit, levels):
    rows, sizes, run = common_line(300), [], repeats.run_index
    monkeypatch.setattr(repeats, "INDEX_BYTES", limit)
    monkeypatch.setattr(repeats, "run_index", lambda text, stop: sizes.append(len(text)) or run(text, stop))
    got, heavy = repeats_in_one_process(rows, levels)
    assert heavy and max(sizes, default=0) <= limit
    assert sorted(map(str, got.items())) == sorted(str((int(r[0]), r[2])) for r in brute_repeats(rows)) and sum(got.values())


@pytest.mark.parametrize("bits", [0, 2])
def test_repeats_of_heavy_anchors_stay_right_if_hashes_collide(monkeypatch, bits):
    rows, mix = common_line(60), repeats.mix
    monkeypatch.setattr(repeats, "INDEX_BYTES", 4_000)
    given = {}

    def weak(batches, name):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(repeats, "mix", lambda x: mix(x) >> np.uint64(64 - bits) if bits else mix(x) * np.uint64(0))
            yield from list(given[name](batches))

    for name in ("_windows",):
        given[name] = getattr(repeats, name)
        monkeypatch.setattr(repeats, name, lambda b, name=name: weak(b, name))
    refine = repeats._refine
    given["_refine"] = lambda b: refine(1)(b)
    monkeypatch.setattr(repeats, "_refine", lambda level: lambda b: weak(b, "_refine"))
    got, heavy = repeats_in_one_process(rows, 1)
    assert heavy
    assert sorted(map(str, got.items())) == sorted(str((int(r[0]), r[2])) for r in brute_repeats(rows))


def test_repeats_of_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(41)
    passage = "".join(rng.choice("abcdefgh") for _ in range(700))
    rows = [(1, "".join(rng.choice("xyzw") for _ in range(5000)) + passage * 2), (2, passage[:300] + "q" * 900 + passage[200:]), (3, "short"), (4, "ab" * 2000)]
    for size in (100, 128, 999):
        monkeypatch.setattr(repeats, "BLOCK_BYTES", size)
        monkeypatch.setattr("marlstone.llm.words.CHUNK", size)
        monkeypatch.setattr(repeats, "text_groups", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))
        got, _ = repeats_in_one_process(rows)
        assert sorted(map(str, got.items())) == sorted(str((int(r[0]), r[2])) for r in brute_repeats(rows))


def test_repeats_of_a_common_line(spark):
    rows = common_line(16_000)  # the line's segments exceed one index
    got = repeats.remove_repeats(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(rows)


def runs_of(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    edge = np.cumsum([0, *map(len, texts)])
    return data, np.repeat(edge[1:], np.diff(edge)), edge


def test_run_index_is_the_transform_of_all_suffixes():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(40)] + [b"abababab", b"a"] * 3
    data, stop, edge = runs_of(texts)
    index = repeats.run_index(data, stop)
    # plain suffixes; a segment's end sorts before every byte, ends among themselves by segment
    suffixes = sorted(((list(w[k:]) + [-1], i), int(edge[i]) + k) for i, w in enumerate(texts) for k in range(len(w) + 1))
    rows = [i for (w, i), p in suffixes if len(w) == 1] + [p for (w, i), p in suffixes if len(w) > 1]
    bwt = [texts[i][-1] + 1 for i in rows[: len(texts)]] + [0 if p in set(edge.tolist()) else data[p - 1] + 1 for p in rows[len(texts) :]]
    assert index.rows == len(bwt) and np.repeat(index.symbols, np.diff(np.append(index.starts, index.rows))).tolist() == bwt
    place = {p: k for k, p in enumerate(rows) if k >= len(texts)}
    row, shared = repeats.matching_statistics(index, data, stop)
    common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    tail = lambda p: bytes(data[p : stop[p]])
    for p in range(len(data)):
        assert row[p] == place[p]
        assert shared[p] == (common(tail(p), tail(rows[place[p] - 1])) if place[p] > len(texts) else 0)


@pytest.mark.parametrize("harm", [None, "symbols", "ends", "starts"])
def test_marks_come_from_runs_and_samples(harm):
    rng = random.Random(5)
    base = [bytes(rng.choice(b"abcd") for _ in range(184)) for _ in range(6)]
    texts = [b[rng.randint(0, 60) : rng.randint(130, 184)] for b in base for _ in range(8)] + [b"ab" * 90, b"x" * 180, b"x" * 150]
    data, stop, edge = runs_of(texts)
    index = repeats.run_index(data, stop)
    assert len(index.starts) < 0.5 * index.rows
    if harm == "symbols":
        index = index._replace(symbols=np.roll(index.symbols, 1))
    if harm == "ends":
        index = index._replace(ends=np.maximum(np.roll(index.ends, 1, axis=0), 1))
    if harm == "starts":
        index = index._replace(starts=np.append(0, np.maximum(index.starts[1:] - 1, 1)))
    seen, want = set(), set()
    for a, z in zip(edge[:-1], edge[1:]):
        for s in range(a, z - 99):
            w = data[s : s + 100].tobytes()
            want |= {s} if w in seen else set()
            seen.add(w)
    try:
        got = set(repeats.repeated_starts(index, data, stop).tolist())
    except IndexError:
        got = None
    assert (got == want) == (harm is None) and want


# the pipeline


def test_pipeline_stages_decide_as_their_operators(spark, labelled, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels, truth = labelled
    rng = random.Random(8)
    extra = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 500)) for _ in range(60)) for _ in range(3)]
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").collect()]
    rows += [(2000, extra[0]), (2001, extra[0].upper()), (2002, extra[0] + " more"), (2003, extra[1] + " x"), (2004, "lone " + extra[2])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, extra[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    start = spark.read.parquet(str(tmp_path / "documents.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(start, labels).filter("predicted = 1").collect()}
    assert sum(truth.get(i, (0, 0))[1] for i in toxic) > 0.9 * len(toxic)
    left = [(i, t) for i, t in rows if i not in toxic]
    last = {}
    for i, t in sorted(left):
        last[norm(t)] = (i, t)
    left = sorted(last.values())
    sets, roots = brute_components(left)
    first = {}
    for k, r in enumerate(roots):
        first.setdefault(r if sets[k] else ("blank", k), left[k])
    left = sorted(first.values())
    dirty = {int(r[0]) for r in brute_hits(left, [(1, extra[1])]) if r[5]}
    left = [(i, t) for i, t in left if i not in dirty]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in left} and 2003 in dirty and 2004 in got
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in left)
