"""Byte-level BPE: overlapping chunks, stitched where pre-token boundaries agree.

A text of up to CHUNK characters is one chunk. A longer one is cut into
overlapping chunks that are pre-tokenised in parallel. Chunk 0 starts at a true
boundary; chunk k is trusted from the first boundary it shares with a trusted
chunk k-1 inside their overlap, since from there both go on alike. Cuts are made
only after a character that isn't white space, where neither side's matches can
look across. If two chunks share no boundary (one endless word, say), their texts
stay one piece, and trust comes back at the next shared boundary that is sure:
the end of a non-space before white space, which no match of the pattern crosses
wherever matching began (white space only begins a match). So the result is
always that of the whole text. The pieces are then encoded in parallel and their
ids concatenated. A piece may still be one match of megabytes: it is split into
its matches here, and each is merged without the library's own splitting.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.frames import only, settle

CHUNK, OVERLAP = 32_768, 1_024
GROUP = 32  # chunks or pieces of one text in a batch
NEAREST = 64  # boundaries kept on each side of a cut
SPLIT = 1 << 16  # longer pieces are split into matches before they reach the library

_encodings: dict[str, tuple] = {}


class Vocabulary:
    """Ranks and pattern of a byte-level BPE; the file is read on the driver and sent along."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.raw = f.read()
        self.pattern = pattern
        self.key = hashlib.sha256(self.raw + pattern.encode()).hexdigest()

    def load(self):
        """(encode a text, token bytes by id, decimal strings by id, compiled pattern), once for each worker."""
        if self.key not in _encodings:
            import regex
            import tiktoken

            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in self.raw.splitlines() if line)}
            coder = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            by_id = [b""] * (max(ranks.values()) + 1)
            for t, r in ranks.items():
                by_id[r] = t
            pattern = regex.compile(self.pattern)
            one = tiktoken.Encoding("one", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

            def encode(text: str) -> list[int]:
                if len(text) <= SPLIT:
                    return coder.encode_ordinary(text)
                return [i for m in pattern.finditer(text) for i in one(m.group())]

            _encodings[self.key] = encode, by_id, [str(i) for i in range(len(by_id))], pattern
        return _encodings[self.key]


def boundaries(pattern, chunk: str, begin: int, around: list[int], overlap: int, closed: bool) -> list[list[int]]:
    """Pre-token ends of a chunk near the given cuts, after non-space only: twice the character of the text, plus 1 if sure."""
    near: list[list[int]] = [[] for _ in around]
    for match in pattern.finditer(chunk):
        end = match.end()
        for k, cut in enumerate(around):
            if abs(begin + end - cut) <= overlap and not chunk[end - 1].isspace() and (closed or end < len(chunk)):
                near[k].append(2 * (begin + end) + (end < len(chunk) and chunk[end].isspace()))
    return [sorted(sorted(ends, key=lambda e: abs(e - 2 * cut))[: 2 * NEAREST]) for ends, cut in zip(near, around)]


def _chunks(size: int, overlap: int):
    """(row, text) to (row, k, begin, chunk, last): overlapping chunks, each cut out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for at in range(0, len(text), GROUP * size):
                    begin = [max(0, b - overlap) for b in range(at, min(len(text), at + GROUP * size), size)]
                    k = [at // size + i for i in range(len(begin))]
                    end = [min(len(text), (i + 1) * size + overlap) for i in k]
                    yield pa.record_batch(
                        [pa.array([row] * len(k), pa.int64()), pa.array(k, pa.int32()), pa.array(begin, pa.int64()), pa.array([text[a:z] for a, z in zip(begin, end)], pa.string()), pa.array([z == len(text) for z in end])],
                        names=["row", "k", "begin", "chunk", "last"],
                    )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, cuts) to (row, piece, text)."""
    for batch in batches:
        for row, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text = text.as_py()
            ends = list(enumerate(zip([0, *cuts], [*cuts, len(text)])))
            for at in range(0, len(ends), GROUP):
                part = ends[at : at + GROUP]
                yield pa.record_batch([pa.array([row] * len(part), pa.int64()), pa.array([n for n, _ in part], pa.int32()), pa.array([text[a:z] for _, (a, z) in part], pa.string())], names=["row", "piece", "text"])


def _pretokenise(vocabulary, chunk_size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = vocabulary.value.load()[3]
        for batch in batches:
            row, k, begin, text, last = (batch.column(i).to_pylist() for i in range(5))
            ends = [boundaries(pattern, t, b, [i * chunk_size, (i + 1) * chunk_size], overlap, z) for i, b, t, z in zip(k, begin, text, last)]
            kind = pa.list_(pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([e[0] for e in ends], kind), pa.array([e[1] for e in ends], kind)], names=["row", "k", "left", "right"])

    return run


def stitch(ends: list[tuple[list[int], list[int]]]) -> list[int]:
    """The cuts between chunks, given each chunk's boundaries near its left and right ends."""
    cuts, trusted = [], True
    for (_, right), (left, _) in zip(ends, ends[1:]):
        shared = sorted(e for e in set(right) & set(left) if trusted or e & 1)
        trusted = bool(shared)
        if trusted:
            cuts.append(shared[len(shared) // 2] >> 1)
    return cuts


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts = [stitch([(c["left"], c["right"]) for c in chunks]) for chunks in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(cuts, pa.list_(pa.int64()))], names=["row", "cuts"])


def _decode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = vocabulary.value.load()[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(1).flatten().to_pylist() if part.column(1).null_count else part.column(1).flatten().to_numpy().tolist()
                ends = np.cumsum([n.as_py() or 0 for n in pc.list_value_length(part.column(1))]).tolist()
                decoded = [b"".join([by_id[i] for i in ids[a:z]]) for a, z in zip([0, *ends], ends)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes that each row's ids stand for; one row per row of (doc_id, ids).

    Bytes and not text: ids can end inside a character. Null ids count as none.
    Other columns are ignored.

    Returns doc_id, ids, decoded (binary).
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))
    rows = only(encoded, "doc_id", "ids")
    return rows.mapInArrow(_decode(vocabulary), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ids: list, by_id: list[bytes], decimal: list[str]) -> tuple[int, str, str]:
    text = " ".join([decimal[i] for i in ids])
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"".join([by_id[i] for i in ids])).hexdigest()


def _finish(doc_id: pa.Array, encoded: list[list[int]], vocabulary, with_ids: bool) -> pa.RecordBatch:
    _, by_id, decimal, _ = vocabulary.value.load()
    n, a, b = zip(*[_digests(ids, by_id, decimal) for ids in encoded])
    columns = [doc_id, pa.array(n, pa.int64()), pa.array(a), pa.array(b)] + ([pa.array(encoded, pa.list_(pa.int32()))] if with_ids else [])
    return pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Encode every text and decode it again; one row per document.

    Null counts as empty: no tokens, digests of no bytes. No special tokens. Rows
    that repeat a document and null doc_ids are rows like any other. Empty table:
    empty result; other columns are ignored.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by one space),
    decoded_sha256, and ids (array<int>) if ``with_ids``.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path, pattern))
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {OUT}" + (", ids array<int>" if with_ids else "")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.value.load()[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield _finish(part.column(0), [encode(t) for t in part.column(1).to_pylist()], vocabulary, with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.value.load()[0]
        for batch in batches:
            ids = [np.array(encode(t), np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["row", "piece", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, parts in enumerate(batch.column(1).to_pylist()):
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), np.int32).tolist()
                yield _finish(batch.column(0).slice(k, 1), [ids], vocabulary, with_ids)

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, schema)
    long = settle(rows.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long")
    cut = long.select("row", "text").mapInArrow(_chunks(chunk, overlap), "row long, k int, begin long, chunk string, last boolean")
    ends = cut.repartition("row", "k").mapInArrow(_pretokenise(vocabulary, chunk, overlap), "row long, k int, left array<long>, right array<long>")
    cuts = ends.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "left", "right"))).alias("chunks")).mapInArrow(_stitch, "row long, cuts array<long>")
    parts = long.join(cuts, "row").select("row", "text", "cuts").mapInArrow(_pieces, "row long, piece int, text string").repartition("row", "piece")
    parts = parts.mapInArrow(pieces, "row long, piece int, ids binary")
    parts = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    return short.unionByName(parts.join(long.select("row", "doc_id"), "row").select("doc_id", "parts").mapInArrow(joined, schema))
