"""Cross-tokenizer alignment: which tokens of two vocabularies end together, how often, and which partner is best.

1. Every text is encoded by a byte-level BPE (side A, of a space and the text) and by a
   piece model with byte fallback (side B). Tokens become byte ranges; where tokens of
   both sides end, the text is cut into groups, and the two tokens that end there are
   linked. No token goes on over a lone space, so a word between such spaces always gives
   the same: a worker encodes it once and remembers its pairs and groups. Documents are
   handled in blocks: a block lists its distinct id pairs once, and its documents name
   them by their place in that list.
2. The count matrix (B ids by A ids) is striped by B id: ROWS rows make a dense block of
   fixed size. Blocks' pairs are dealt out by stripe and lot, added into the dense block
   by np.add.at, and the lots of a stripe are added up. A row's maximum is its best count.
3. For scoring, stripes meet the same blocks' pairs again (co-partitioned by stripe and
   lot), each pair gets its count and whether it is best, and goes back to its block.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.frames import only, settle

ROWS = 64             # B ids of a stripe: with 50,257 A ids a dense block takes 26 MB
BLOCK = 2 << 20       # characters of a block of documents
SEGMENT = 1 << 18     # longer texts are encoded in segments
ENCODE = 1 << 18      # characters given to a tokenizer at once
TOGETHER = 1 << 12    # characters of words that are encoded in one text
WORDS = 1 << 18       # words that a worker remembers between blocks, and 32 times as many characters
LOTS = 2048           # blocks that a stripe's task adds up before lots are added up
CUT = re.compile(r"(?<=\S) (?=\S)")  # no token of either side goes on over a lone space: it begins the next one

_loaded: dict[str, tuple] = {}
_known: dict[str, Words] = {}


def byte_of_char() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Two tokenizers; their files are read on the driver and sent along."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, "rb") as f:
            self.a = f.read()
        with open(path_b, "rb") as f:
            self.b = f.read()
        self.key = hashlib.sha256(self.a + self.b).hexdigest()

    def load(self):
        """(encode A, encode B, bytes of A's ids, bytes of B's ids, whether texts may be cut), once for each worker."""
        if self.key not in _loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import sentencepiece
            import tokenizers

            one = tokenizers.Tokenizer.from_str(self.a.decode())
            one.encode_special_tokens = True
            two = sentencepiece.SentencePieceProcessor(model_proto=self.b)
            table = byte_of_char()
            bytes_a = [b""] * (max(one.get_vocab().values()) + 1)
            for token, i in one.get_vocab().items():
                bytes_a[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
            pieces = [two.id_to_piece(i) for i in range(two.get_piece_size())]
            bytes_b = [bytes([int(p[3:-1], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
            _loaded[self.key] = (
                lambda texts: [e.ids for e in one.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)],
                lambda texts: two.encode(texts, num_threads=1),
                bytes_a, bytes_b, cuttable,
            )
        return _loaded[self.key]

    def words(self) -> Words:
        """The words that this worker remembers, over its tasks."""
        if self.key not in _known:
            _known[self.key] = Words(*self.load())
        return _known[self.key]


def segments(text: str, size: int) -> list[str]:
    """The text cut at lone spaces, which are left out (each side begins every segment with one)."""
    out, at = [], 0
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def common_ends(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the tokens that end together, and the byte offsets where they do."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    at = np.searchsorted(end_b, end_a)
    meet = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a) if len(end_b) else np.zeros(0, np.int64)
    return meet, at[meet], end_a[meet]


def group_order(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
    """4 * id + separator for all tokens in the order in which groups are spelled: A's ids, then B's, group by group.

    Separators: 0 a comma, 1 a bar (end of A's ids), 2 a semicolon (end of a group).
    """
    out = np.empty(len(a) + len(b), np.int64)
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    place_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
    place_b = np.arange(len(b)) + (last_a + 1)[group_b]
    out[place_a], out[place_b] = 4 * a, 4 * b
    out[place_a[last_a]] += 1
    out[place_b[last_b]] += 2
    return out


class Words:
    """Words, each encoded once: numbers, and by number the tokens, the links' keys (B id * width + A id) and the groups spelled out."""

    def __init__(self, encode_a, encode_b, bytes_a: list[bytes], bytes_b: list[bytes], cuttable: bool, most: int = WORDS):
        self.encode_a, self.encode_b, self.bytes_a, self.bytes_b, self.cuttable, self.most = encode_a, encode_b, bytes_a, bytes_b, cuttable, most
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b))
        self.width = len(bytes_a)
        self.tokens = [f"{i}{s}" for i in range(max(self.width, len(bytes_b))) for s in (",", "|", ";", "")]
        self.number: dict[str, int] = {}  # -1 where the bytes don't agree
        self.spelled: list[str] = []
        self.n_a = self.n_b = self.n_links = self.keys = self.used = np.zeros(0, np.int64)
        self.chars = 0

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words; a text without any is one bad word."""
        words = [CUT.split(t) if self.cuttable else [t] for t in texts]
        new = {w for w in set().union(*words) if w not in self.number}
        if new:
            self._learn(new)
        return [np.fromiter(map(self.number.__getitem__, w), np.int32, len(w)) for w in words]

    def _groups(self, words: set[str]) -> Iterator[list[str]]:
        """Words to be encoded together; one that begins or ends in white space stands alone, as its neighbour's space would not."""
        group, size = [], 0
        for w in words:
            if not self.cuttable or not w or w[0].isspace() or w[-1].isspace():
                yield [w]
                continue
            group.append(w)
            size += len(w) + 1
            if size >= TOGETHER:
                yield group
                group, size = [], 0
        if group:
            yield group

    def _encoded(self, groups: list[list[str]]) -> Iterator[tuple]:
        """(words, their ends in bytes, ids A, ids B) of groups whose bytes agree and whose words end with tokens; others are halved."""
        while groups:
            texts, again = [" ".join(g) for g in groups], []
            for group, text, a, b in zip(groups, texts, self.encode_a(texts), self.encode_b(texts)):
                raw = (" " + text).encode()
                if text != "" and b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                    ends = np.cumsum([len(w.encode()) + 1 for w in group])
                    if all(np.isin(ends, np.cumsum(size[ids])).all() for size, ids in ((self.size_a, a), (self.size_b, b))):
                        yield group, ends, a, b
                        continue
                if len(group) > 1:
                    again += [group[: len(group) // 2], group[len(group) // 2 :]]
                else:
                    self.number[group[0]] = -1
            groups = again

    def _learn(self, new: set[str]) -> None:
        found = list(self._encoded(list(self._groups(new))))
        self.chars += sum(map(len, new))
        if not found:
            return
        words = [w for f in found for w in f[0]]
        starts = np.cumsum([0] + [f[1][-1] for f in found])
        ends = np.concatenate([f[1] + at for f, at in zip(found, starts)])
        a, b = (np.concatenate([f[k] for f in found]) for k in (2, 3))
        last_a, last_b, met = common_ends(a, b, self.size_a, self.size_b)
        order = group_order(a, b, last_a, last_b)
        n_a, n_b, n_links = (np.bincount(np.searchsorted(ends, at), minlength=len(words)) for at in (np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), met))
        cut = np.append(0, np.cumsum(n_a + n_b)).tolist()
        tokens = list(map(self.tokens.__getitem__, order.tolist()))
        self.number.update(zip(words, range(len(self.spelled), len(self.spelled) + len(words))))
        self.spelled += ["".join(tokens[p:q])[:-1] for p, q in zip(cut, cut[1:])]
        self.n_a, self.n_b, self.n_links = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, n_links)))
        self.keys = np.concatenate((self.keys, b[last_b] * self.width + a[last_a]))
        self.used = np.concatenate((self.used, np.zeros(len(words), np.int64)))

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """The places in ``keys`` of all links of words, one after the other."""
        n = self.n_links[numbers]
        first = (np.cumsum(self.n_links) - self.n_links)[numbers]
        return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def forget(self) -> None:
        """Between blocks: if there are too many, half as many of the most used words stay, and none that is long."""
        if len(self.number) <= self.most and self.chars <= 32 * self.most:
            return
        texts = {i: w for w, i in self.number.items() if i >= 0 and len(w) <= 64}
        stay = np.array([i for i in np.argsort(-self.used, kind="stable").tolist() if i in texts][: self.most // 2], np.int64)
        self.keys = self.keys[self.places(stay)]
        self.n_a, self.n_b, self.n_links, self.used = (x[stay] for x in (self.n_a, self.n_b, self.n_links, self.used // 2))
        self.spelled = [self.spelled[i] for i in stay.tolist()]
        self.number = {texts[i]: n for n, i in enumerate(stay.tolist())}
        self.chars = sum(map(len, self.number))


ALIGNED = {
    "kind": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "block": pa.int64(), "stripe": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(),
    "n_links": pa.int64(), "groups_sha256": pa.string(), "data": pa.binary(), "counts": pa.binary(),
}
DOC, PAIRS = 0, 1
SCHEMA = "kind int, row long, doc_id long, block long, stripe int, n_a long, n_b long, n_links long, groups_sha256 string, data binary, counts binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), ALIGNED.values())], names=list(ALIGNED))


def _align(pair, block_size: int, segment: int):
    """(row, doc_id, text) to documents, a row for each segment, and the pairs of each block, a row for each stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pair.value.words()
        width = known.width
        number = TaskContext.get().partitionId() << 32
        digest = None  # of the document whose segments go on

        def encoded(docs: list[tuple[int, int, str]]) -> Iterator[tuple]:
            """(row, doc_id, last segment or not, its words' numbers) of each segment; None for the numbers where the bytes don't agree."""
            parts = [(n, s) for n, (_, _, t) in enumerate(docs) for s in (segments(t, segment) if known.cuttable else [t])]
            done: list[tuple] = []
            at = 0
            while at < len(parts):
                stop, size = at, 0
                while stop < len(parts) and (stop == at or size + len(parts[stop][1]) <= ENCODE):
                    size += len(parts[stop][1])
                    stop += 1
                done += zip([n for n, _ in parts[at:stop]], known.numbers([s for _, s in parts[at:stop]]))
                at = stop
            bad = {n for n, words in done if words.min() < 0}
            for i, (n, words) in enumerate(done):
                last = i + 1 == len(done) or done[i + 1][0] != n
                if n not in bad:
                    yield *docs[n][:2], last, words
                elif last:
                    yield *docs[n][:2], True, None

        def block(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number, digest
            number += 1
            words = np.concatenate([h[3] for h in held])
            times = np.bincount(words, minlength=len(known.used))
            known.used += times
            distinct = np.flatnonzero(times)
            # a block's pairs follow from its distinct words
            own = known.places(distinct)
            keys, place = np.unique(known.keys[own], return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, place, np.repeat(times[distinct], known.n_links[distinct]))
            of_key = np.zeros(len(known.keys), np.uint16 if len(keys) <= 1 << 16 else np.uint32)
            of_key[own] = place
            place = of_key[known.places(words)]
            bounds = np.cumsum([0] + [len(h[3]) for h in held])
            tokens_a, tokens_b, links = (np.append(0, np.cumsum(n[words]))[bounds].tolist() for n in (known.n_a, known.n_b, known.n_links))
            rows = []
            for i, (row, doc_id, last, said) in enumerate(held):
                digest = digest or hashlib.sha256()
                digest.update(";".join(map(known.spelled.__getitem__, said.tolist())).encode() + (b"" if last else b";"))
                p, q = links[i : i + 2]
                rows.append((DOC, row, doc_id, number, None, tokens_a[i + 1] - tokens_a[i], tokens_b[i + 1] - tokens_b[i], q - p, digest.hexdigest() if last else None, place[p:q].tobytes(), None))
                digest = None if last else digest
            yield _batch(rows)
            stripe = keys // width // ROWS
            cut = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])) if len(keys) else np.zeros(0, np.int64)
            pairs = [
                (PAIRS, None, None, number, int(stripe[p]), None, None, None, None, keys[p:q].tobytes(), counts[p:q].tobytes())
                for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)])
            ]
            if pairs:
                yield _batch(pairs)

        held: list[tuple] = []
        size = 0
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            waiting, chars = [], 0
            for k in range(batch.num_rows):
                waiting.append((rows[k], ids[k], batch.column(2)[k].as_py() or ""))
                chars += len(waiting[-1][2])
                if chars < ENCODE and k + 1 < batch.num_rows:
                    continue
                for found in encoded(waiting):
                    if found[3] is None:
                        yield _batch([(DOC, found[0], found[1], None, None, 0, 0, 0, "", b"", None)])
                        continue
                    held.append(found)
                    size += int(known.n_a[found[3]].sum()) * 4
                    if size >= block_size:
                        yield from block(held)
                        held, size = [], 0
                waiting, chars = [], 0
                if not held:
                    known.forget()
            pa.default_memory_pool().release_unused()
        if held:
            yield from block(held)
        known.forget()

    return run


def _longs(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int64)


def _tally(width: int, final: bool):
    """From (stripe, lot, data, counts) in order of (stripe, lot): each one's sum, with row maxima marked if ``final``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, now = np.zeros((ROWS, width), np.int64), None

        def done() -> pa.RecordBatch:
            i, a = np.nonzero(dense)
            counts = dense[i, a]
            best = (counts == dense.max(axis=1)[i]) if final else np.zeros(0, bool)
            out = [[now[0]], [now[1]], [((now[0] * ROWS + i) * width + a).tobytes()], [counts.tobytes()], [best.tobytes()]]
            dense[i, a] = 0
            return pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["stripe", "lot", "data", "counts", "best"])

        for batch in batches:
            for stripe, lot, data, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if now is not None and now != (stripe, lot):
                    yield done()
                now = stripe, lot
                key = _longs(data)
                np.add.at(dense, (key // width - stripe * ROWS, key % width), _longs(counts))
        if now is not None:
            yield done()

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (stripe, lot, kind, block, data, counts, best), a stripe's sums before its blocks' pairs: the pairs' counts and whether best."""
    key = counts = best = np.zeros(0, np.int64)
    for batch in batches:
        out = []
        for kind, block, stripe, data, n, top in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0).to_pylist(), *(batch.column(i) for i in (4, 5, 6))):
            if kind == 0:
                key, counts, best = _longs(data).copy(), _longs(n).copy(), np.frombuffer(top.as_buffer(), bool).copy()
            else:
                at = np.searchsorted(key, _longs(data))
                out.append((block, stripe, counts[at].tobytes(), best[at].tobytes()))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "stripe", "counts", "best"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (block, kind, stripe, row, data, counts, best), a block's scores before its documents: (row, n_best, count_sum)."""
    now, scores, counts, best = None, [], None, None
    for batch in batches:
        out = []
        for block, kind, row, data, n, top in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), *(batch.column(i) for i in (4, 5, 6))):
            if block != now:
                now, scores, counts = block, [], None
            if kind == 0:
                scores.append((_longs(n).copy(), np.frombuffer(top.as_buffer(), bool).copy()))
                continue
            if counts is None:
                counts, best = (np.concatenate(c) for c in zip(*scores))
            place = np.frombuffer(data.as_buffer(), np.uint16 if len(counts) <= 1 << 16 else np.uint32)
            out.append((row, int(best[place].sum()), int(counts[place].sum())))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["row", "n_best", "count_sum"])


def align_documents(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK, segment: int = SEGMENT, rows_a_lot: int = LOTS) -> tuple[DataFrame, DataFrame]:
    """Two tables: (documents, pairs).

    ``path_a``: a byte-level BPE for ``tokenizers``; ``path_b``: a ``sentencepiece``
    model that begins texts with a space. Strings of special tokens are plain text.

    documents has one row per document: doc_id, n_a, n_b (tokens), n_groups, n_links,
    n_best (links whose count is the highest of their B id, ties included), count_sum
    (over links), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``). A null or empty text, or
    one whose tokens' bytes aren't a space and the text on both sides, has no tokens:
    zeros and ''. Null doc_ids and repeated rows are rows like any other. Empty table:
    empty results; other columns are ignored. A long text is encoded in segments that
    are cut at lone spaces; one endless word is encoded whole.

    pairs has one row for each linked pair of ids: a, b, n (its links), best.
    """
    spark = docs.sparkSession
    made = Pair(path_a, path_b)
    width = len(made.load()[2])
    pair = spark.sparkContext.broadcast(made)
    rows = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    leaf = settle(rows.mapInArrow(_align(pair, block, segment), SCHEMA), "aligned")
    pairs = leaf.filter(F.col("kind") == PAIRS)
    # a block has a pair in some stripe: the fullest stripe tells how many lots are needed
    fullest = pairs.groupBy("stripe").count().agg(F.max("count")).first()[0] or 0
    lots = -(-fullest // rows_a_lot) or 1
    dealt = pairs.select("stripe", F.pmod(F.xxhash64("block"), F.lit(lots)).alias("lot"), "block", "data", "counts")
    kind = "stripe int, lot long, data binary, counts binary, best binary"

    def tally(some: DataFrame, final: bool) -> DataFrame:
        return some.select("stripe", "lot", "data", "counts").repartition("stripe", "lot").sortWithinPartitions("stripe", "lot").mapInArrow(_tally(width, final), kind)

    sums = tally(dealt, lots == 1)
    if lots > 1:
        sums = tally(sums.withColumn("lot", F.lit(0).cast("long")), True)
    sums = settle(sums, "stripes")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot")
    stripes = sums.select("stripe", every, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "data", "counts", "best")
    blocks = dealt.select("stripe", "lot", F.lit(1).alias("kind"), "block", "data", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"))
    scored = stripes.union(blocks).repartition("stripe", "lot").sortWithinPartitions("stripe", "lot", "kind")
    scored = scored.mapInArrow(_score, "block long, stripe int, counts binary, best binary")

    documents = leaf.filter(F.col("kind") == DOC)
    scores = scored.select("block", F.lit(0).alias("kind"), "stripe", F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("data"), "counts", "best")
    links = documents.filter("block is not null").select("block", F.lit(1).alias("kind"), "stripe", "row", "data", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"))
    met = scores.union(links).repartition("block").sortWithinPartitions("block", "kind", "stripe").mapInArrow(_gather, "row long, n_best long, count_sum long")
    none = F.lit(0).cast("long")
    parts = documents.select("row", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", none.alias("n_best"), none.alias("count_sum"))
    zero = [none.alias(c) for c in ("n_a", "n_b", "n_links")]
    parts = parts.union(met.select("row", F.lit(None).cast("long"), *zero, F.lit(None).cast("string"), "n_best", "count_sum"))
    out = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b")], F.sum("n_links").alias("n_groups"), F.sum("n_links").alias("n_links"),
        *[F.sum(c).alias(c) for c in ("n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256"),
    ).drop("row")
    known = sums.select("data", "counts", "best").mapInArrow(_listed(width), "a int, b int, n long, best boolean")
    return out, known


def _listed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, counts, best in zip(*(batch.column(i) for i in range(3))):
                key = _longs(data)
                columns = (key % width).astype(np.int32), (key // width).astype(np.int32), _longs(counts), np.frombuffer(best.as_buffer(), bool)
                for at in range(0, len(key), 1 << 16):
                    yield pa.record_batch([pa.array(c[at : at + (1 << 16)]) for c in columns], names=["a", "b", "n", "best"])

    return run
