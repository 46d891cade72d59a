"""Tokens are kept and decoded by an operator of its own; op6's digests come from its columns."""

import hashlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from marlstone.llm import bpe, queries  # noqa: E402


def test_ids_are_decoded_and_kept(spark, tmp_path):
    import corpus_pipeline

    coder = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, "plain text, twice"), (2, None), (3, "日本 é \n\n  'll"), (None, ""), (4, "ab " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode_documents(bpe.encode_documents(df, *coder, with_ids=True, chunk=5000), *coder).collect()}
    assert decoded == {i: (t or "").encode() for i, t in rows}
    piece = bpe.encode_documents(df.filter("doc_id = 3"), *coder, with_ids=True).selectExpr("doc_id", "slice(ids, 1, 1) AS ids")
    assert "日本".encode().startswith(bytes(bpe.decode_documents(piece, *coder).first()["decoded"])[:1])
    stage = {r["doc_id"]: r["ids"] for r in corpus_pipeline.encode(spark, df, "").collect()}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op6_byte_bpe(spark, str(tmp_path)).collect()}
    assert set(got) == set(stage) == set(decoded)
    for i, r in got.items():
        assert r["n_tokens"] == len(stage[i])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, stage[i])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded[i]).hexdigest()
