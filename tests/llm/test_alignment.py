"""Cross-tokenizer alignment against a plain count over all documents."""

import hashlib
import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from marlstone.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, block string, Text string"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text):
    """Ids and byte ends of both sides, or None."""
    import sentencepiece
    import tokenizers

    one = tokenizers.Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    level = alignment.byte_of_char()

    def plain(t):
        a = one.encode(" " + t, add_special_tokens=False).ids
        b = two.encode(t)
        raw_a = [bytes(level[c] for c in one.id_to_token(i)) if one.id_to_token(i) != "<|endoftext|>" else b"" for i in a]
        raw_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return a, b, raw_a, raw_b

    out = []
    for t in text:
        if not t or any(b"".join(r) != (" " + t).encode() for r in plain(t)[2:]):
            out.append(None)
            continue
        a, b, raw_a, raw_b = plain(t)
        ends = []
        for raw in (raw_a, raw_b):
            n, e = 0, []
            for x in raw:
                n += len(x)
                e.append(n)
            ends.append(e)
        out.append((a, b, *ends))
    return out


def expected(rows):
    found = tokens([t for _, t in rows])
    count = Counter()
    for f in found:
        if f:
            at = {e: x for x, e in zip(f[1], f[3])}
            count.update((x, at[e]) for x, e in zip(f[0], f[2]) if e in at)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (i, _), f in zip(rows, found):
        if not f:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, ea, eb = f
        both = sorted(set(ea) & set(eb))
        spelled, links, lo = [], [], 0
        for z in both:
            ga = [x for x, e in zip(a, ea) if lo < e <= z]
            gb = [x for x, e in zip(b, eb) if lo < e <= z]
            spelled.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.append((ga[-1], gb[-1]))
            lo = z
        sums = sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links)
        out.append((i, len(a), len(b), len(both), len(links), *sums, hashlib.sha256(";".join(spelled).encode()).hexdigest()))
    return out, count, top


def documents():
    rng = random.Random(5)
    words = "alpha Beta gamma-delta 12 345 don't été naïve Größe 東京 🙂 x=1; <|endoftext|> <s> </s> <0x41> the of and\tto \n\n in".split(" ")
    rows = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "a▁b"), (6, "\n"), (None, "no id here"), (7, "\u0000x"), (8, "tab\tand\r\nline")]
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(10, 60)]
    rows += [(60, rows[20][1]), (60, rows[20][1]), (61, " ".join(rng.choice(words) for _ in range(900))), (62, "nospacesatall" * 60)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 300, "segment": 40, "rows_a_lot": 2}])
def test_alignment_against_plain_counts(spark, sizes):
    rows = documents()
    df = spark.createDataFrame([(i, t, "r", "b", "x") for i, t in rows], SCHEMA).repartition(3)
    got, pairs = alignment.align_documents(df, A, B, **sizes)
    assert got.columns == NAMES
    want, count, top = expected(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(want, key=key)
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == top[p[1]]) for p, n in count.items()}


def test_cuts_change_nothing():
    made = alignment.Pair(A, B)
    encode_a, encode_b, *_ = made.load()
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "é", "12", ".", "'s", " ", "東", "x"]) for _ in range(80))
        parts = alignment.segments(text, 7)
        assert " ".join(parts) == text
        assert sum(encode_a(parts), []) == encode_a([text])[0]
        if text:
            assert sum(encode_b(parts), []) == encode_b([text])[0]


def test_empty_table(spark):
    got, pairs = alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.collect() == [] and pairs.collect() == []
    only_null, _ = alignment.align_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B)
    assert [tuple(r) for r in only_null.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


class _Held:
    """Stands for a broadcast pair; counts the characters that side A's tokenizer gets."""

    def __init__(self, most=1 << 18):
        self.value, self.chars = self, 0
        encode_a, *rest = alignment.Pair(A, B).load()
        self._words = alignment.Words(self._counted(encode_a), *rest, most) if hasattr(alignment, "Words") else None
        self._loaded = (self._counted(encode_a), *rest)

    def _counted(self, encode):
        def run(texts):
            self.chars += sum(map(len, texts))
            return encode(texts)

        return run

    def load(self):
        return self._loaded

    def words(self):
        return self._words


def _aligned(monkeypatch, held, rows):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "TaskContext", type("Context", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    batches = [pa.record_batch([pa.array([i], pa.int64()), pa.array([i], pa.int64()), pa.array([t])], names=["row", "doc_id", "text"]) for i, t in rows]
    out = [r for b in alignment._align(held, 400, 60)(iter(batches)) for r in b.to_pylist() if r["kind"] == alignment.DOC]
    last = {r["doc_id"]: r["groups_sha256"] for r in out if r["groups_sha256"] is not None}
    return {i: (sum(r["n_a"] for r in out if r["doc_id"] == i), sum(r["n_b"] for r in out if r["doc_id"] == i), sum(r["n_links"] for r in out if r["doc_id"] == i), last[i]) for i in last}


def test_words_are_encoded_once(monkeypatch):
    rng = random.Random(8)
    words = ["alpha", "Größe", "don't", "x=1;", "東京", "1234567", "\u0000x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(40)]
    held = _Held()
    _aligned(monkeypatch, held, rows)
    assert held.chars < 200


def test_forgotten_words_and_bad_ones_change_nothing(monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 400)}" for _ in range(60)] + ["a▁b", "", "tab\tx", "\n", "é" * 70, "　", "x​"]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.3 else f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 80)))) for i in range(80)]
    rows += [(i + 100, " ".join(rng.choice(words[:60]) for _ in range(70))) for i in range(40)]
    want, _, _ = expected(rows)
    want = {w[0]: (w[1], w[2], w[4], w[7]) for w in want}
    assert sum(w[0] > 0 for w in want.values()) > 40 and any(w[0] == 0 for w in want.values())
    for most in (8, 100, 1 << 18):
        assert _aligned(monkeypatch, _Held(most), rows) == want
