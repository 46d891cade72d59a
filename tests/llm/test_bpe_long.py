"""Byte-level BPE of megabytes without an admissible cut, and stitching that resumes after them."""

import base64
import hashlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from marlstone.llm import bpe  # noqa: E402

CODER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def by_matches(text):
    """Ids match by match, each merged on its own."""
    import regex
    import tiktoken

    with open(CODER[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    one = tiktoken.Encoding("one", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return [i for m in regex.finditer(CODER[1], text) for i in one.encode_ordinary(m.group())]


def test_long_runs_of_one_class(spark):
    word = "some words, 12 of them; it's fine.\n"
    texts = [" " * 5_000_000, "\n" * 2_000_000, "a" * 2_000_000, "7" * 500_000 + " x", "!" * 300_000, word * 3000 + " " * 300_000 + word * 3000 + "é" * 100_000 + word * 4000, " \n" * 400_000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(7)
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, *CODER).collect()}
    for i, text in enumerate(texts):
        ids = by_matches(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), i
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stitching_resumes_after_an_endless_word():
    import regex

    pattern, size, overlap = regex.compile(CODER[1]), 50, 10
    text = "ab cd ef " * 20 + "x" * 200 + " " + "gh 12 ij " * 40
    chunks = [(max(0, k - overlap), min(len(text), k + size + overlap), k) for k in range(0, len(text), size)]
    ends = [tuple(bpe.boundaries(pattern, text[a:z], a, [k, k + size], overlap, z == len(text))) for a, z, k in chunks]
    cuts = bpe.stitch(ends)
    assert any(c > 400 for c in cuts) and not any(185 < c < 380 for c in cuts)
    true = {m.end() for m in pattern.finditer(text)}
    assert set(cuts) <= true
