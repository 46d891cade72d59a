"""Benchmark decontamination by suffix arrays over the training documents.

The documents are read in shards of whole texts (some megabytes each); a longer
text has several arrays, which overlap by a window, so that none is lost. In a
task, a shard's words become ranks, and a suffix array is sorted by multi-word
prefixes: ranks of 1, 3, 9 and 18 words, each level packing ranks of the level
below, so equal order of packed numbers is word order. Suffixes end with their
document. Every test suffix of a benchmark item is then found by binary search at
these levels, as far as its first window: its occurrences are one interval of the
array. Occurrences of neighbouring test suffixes that go on alike are joined, so
each match comes out at its full length; its places in document and item are listed
if asked for, by the two ends of each match.

The test suffixes are the query set, broadcast in blocks of bounded size; a
larger benchmark takes more blocks, each a pass over the documents, after which
the block is given up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.frames import only, settle, stowed
from marlstone.llm.words import ALNUM, text_buffer, text_groups, words

WINDOW = 10
BLOCK_BYTES = 8 << 20   # benchmark text in one broadcast (some 14 times that when built)
SHARD_BYTES = 4 << 20   # text of a shard
SHARD_WORDS = 1 << 20   # starts of suffixes in one array; a longer text has several, which overlap by a window
DEPTHS = (1, 3, 9, 18)


class Places(NamedTuple):
    """Where the windows of one length stand in items: a row for each place."""

    window: np.ndarray
    row: np.ndarray      # the item's row
    place: np.ndarray    # its first word there
    before: np.ndarray   # 1 + the window one word earlier in the item, 0 without one
    after: np.ndarray    # 1 + the window one word later


class Queries(NamedTuple):
    """The windows of a block of items: distinct test prefixes by length."""

    prefixes: dict[int, np.ndarray]   # length -> (windows, length) word numbers
    sets: dict[int, np.ndarray]       # length -> the set of items that each window stands in
    members: list[np.ndarray]         # items of each set; sets that agree are one
    places: dict[int, Places]
    ids: np.ndarray                   # item ids as strings
    item: np.ndarray                  # the item of each row


def item_windows(ids: list[str], texts: list[str | None]) -> Queries:
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    w = words(data, offsets, ALNUM)
    found: dict[int, list] = {}
    names, code = np.unique(np.array([str(i) for i in ids], dtype=object).astype(str), return_inverse=True) if ids else (np.zeros(0, str), np.zeros(0, int))
    for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
        size = min(WINDOW, b - a)
        if size:
            rows = np.lib.stride_tricks.sliding_window_view(w.number[a:b], size)
            found.setdefault(int(size), []).append((rows, np.full(len(rows), k), np.arange(len(rows))))
    prefixes, sets, places = {}, {}, {}
    members = [np.array([c]) for c in range(len(names))]  # a window of a single item has that item's set
    known: dict[bytes, int] = {}
    for size, parts in found.items():
        rows, owner, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.ravel()
        prefixes[size] = distinct
        held = np.unique(which * len(names) + code[owner])
        begin = np.searchsorted(held // len(names), np.arange(len(distinct) + 1))
        held = held % len(names)
        sets[size] = held[begin[:-1]]
        for n in np.flatnonzero(np.diff(begin) > 1).tolist():
            own = held[begin[n] : begin[n + 1]]
            at = known.setdefault(own.tobytes(), len(members))
            if at == len(members):
                members.append(own)
            sets[size][n] = at
        joined = (owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
        before, after = np.zeros((2, len(which)), np.int64)
        before[1:], after[:-1] = np.where(joined, which[:-1] + 1, 0), np.where(joined, which[1:] + 1, 0)
        places[size] = Places(which, owner, place, before, after)
    return Queries(prefixes, sets, members, places, names, code)


class SuffixArray:
    """Suffixes of a shard of texts in word order, by their first DEPTHS[-1] words."""

    def __init__(self, number: np.ndarray, first: np.ndarray):
        n = len(number)
        stop = np.repeat(first[1:], np.diff(first))  # where the text of each word ends
        self.words, rank = np.unique(number, return_inverse=True)
        rank = rank.astype(np.int64) + 1  # 0 stands for the end of the text
        self.keys: list[np.ndarray] = []
        self.base: list[int] = []
        at = np.arange(n)
        for shallow, deep in zip(DEPTHS, DEPTHS[1:]):
            base = int(rank.max(initial=0)) + 1
            if base ** (deep // shallow) >= 2**63:
                raise ValueError("a shard has too many distinct suffixes")
            key = rank.copy()
            for k in range(shallow, deep, shallow):
                key *= base
                key[: n - k if n > k else 0] += np.where(at[k:] < stop[: n - k], rank[k:], 0) if n > k else 0
            order = np.argsort(key)
            ordered = key[order]
            fresh = np.ones(n, dtype=bool)
            fresh[1:] = ordered[1:] != ordered[:-1]
            self.base.append(base)
            if deep == DEPTHS[-1]:
                self.suffixes, self.sorted = order, ordered
            else:
                self.keys.append(ordered[fresh])
                rank = np.empty(n, np.int64)
                rank[order] = np.cumsum(fresh)

    def find(self, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word numbers the interval [lo, hi) of suffixes that begin with it."""
        n, size = prefixes.shape
        if not len(self.words):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        lo, hi = np.zeros((2, n), np.int64)
        live, tokens = np.arange(n), np.zeros((n, size), np.int64)
        for k in range(size):  # most windows have a word that the shard lacks
            place = np.minimum(np.searchsorted(self.words, prefixes[live, k]), len(self.words) - 1)
            known = self.words[place] == prefixes[live, k]
            live = live[known]
            tokens[live, k] = place[known] + 1
        if len(live):
            lo[live], hi[live] = self._interval(len(DEPTHS) - 1, tokens[live])
        return lo, hi

    def _interval(self, level: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if level == 0:
            one = tokens[:, 0]
            return one, np.where(one < 0, one, one + 1)
        shallow, base = DEPTHS[level - 1], self.base[level - 1]
        parts = DEPTHS[level] // shallow
        head = np.zeros(len(tokens), np.int64)
        ok = np.ones(len(tokens), bool)
        for k in range(parts):
            lo, hi = self._interval(level - 1, tokens[:, k * shallow : (k + 1) * shallow])
            ok &= lo < hi
            if (k + 1) * shallow >= tokens.shape[1]:
                break
            head = (head + lo) * base
        scale = base ** (parts - 1 - k)
        low, high = (head + lo) * scale, (head + hi) * scale
        keys = self.sorted if level == len(DEPTHS) - 1 else self.keys[level - 1]
        shift = 0 if level == len(DEPTHS) - 1 else 1  # ranks begin at 1
        a, b = np.searchsorted(keys, low) + shift, np.searchsorted(keys, high) + shift
        return np.where(ok, a, -1), np.where(ok, b, -1)


def _occurrences(number: np.ndarray, first: np.ndarray, queries: Queries) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (position, window) of every occurrence of every window in a shard, in order; at a position stands one window of a length."""
    parts: dict[int, list] = {}
    for at in range(0, max(len(number), 1), SHARD_WORDS):
        # occurrences that begin within SHARD_WORDS words; the next array finds the others
        stop = min(len(number), at + SHARD_WORDS + WINDOW - 1)
        index = SuffixArray(number[at:stop], np.clip(first - at, 0, stop - at))
        for size, rows in queries.prefixes.items():
            lo, hi = index.find(rows)
            many = np.maximum(hi - lo, 0)
            if not many.any():
                continue
            window = np.repeat(np.arange(len(rows)), many)
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            position = index.suffixes[np.repeat(lo, many) + nth]
            own = position < SHARD_WORDS
            by = np.argsort(position[own])
            parts.setdefault(size, []).append((position[own][by] + at, window[own][by]))
    return {size: tuple(np.concatenate(c) for c in zip(*p)) for size, p in parts.items()}


def _besides(key: np.ndarray, window: np.ndarray, neighbour: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(nth occurrence, row of the sorted keys window * base + neighbour) for all rows of a window with another neighbour."""
    out = []
    lo, hi = np.searchsorted(key, window * base), np.searchsorted(key, (window + 1) * base)
    a, z = np.searchsorted(key, window * base + neighbour), np.searchsorted(key, window * base + neighbour, side="right")
    # neighbour 0 is no window: nothing goes on there, so no row is left out
    a, z = np.where(neighbour > 0, a, hi), np.where(neighbour > 0, z, hi)
    for begin, end in ((lo, a), (z, hi)):
        many = end - begin
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append((np.repeat(np.arange(len(window)), many), np.repeat(begin, many) + nth))
    return tuple(np.concatenate(c) for c in zip(*out))


def longest(position: np.ndarray, window: np.ndarray, first: np.ndarray, size: int, places: Places) -> np.ndarray:
    """Rows (text, position, item's row, place, words) of the longest matches that windows of one length make up.

    A match lies on a diagonal (text, item, difference of places) and is found by its
    two ends: at a begin, document and item have different windows one word earlier,
    at an end one word later. Only ends are listed, so the work is that of the matches
    and not of all pairs of places.
    """
    text = np.searchsorted(first, position, side="right") - 1
    joined = (np.diff(position) == 1) & (np.diff(text) == 0)
    before, after = np.zeros((2, len(position)), np.int64)
    before[1:], after[:-1] = np.where(joined, window[:-1] + 1, 0), np.where(joined, window[1:] + 1, 0)
    base = int(places.window.max()) + 2
    ends = []
    for mine, theirs in ((before, places.before), (after, places.after)):
        order = np.argsort(places.window * base + theirs)
        nth, at = _besides((places.window * base + theirs)[order], window, mine, base)
        row, place = places.row[order[at]], places.place[order[at]]
        by = np.lexsort((position[nth], place - position[nth], row, text[nth]))
        ends.append((text[nth][by], position[nth][by], row[by], place[by]))
    (t, p, row, place), (_, stop, _, _) = ends
    return np.stack([t, p, row, place, stop - p + size])


def _spans(position: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered words."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, position, 1)
    np.add.at(depth, position + size, -1)
    cover = np.zeros(n + 2, bool)
    cover[1:-1] = np.cumsum(depth)[:-1] > 0
    edge = np.flatnonzero(cover[1:] != cover[:-1])
    return edge[::2], edge[1::2]


MATCH = "struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>"
MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
HITS = f"n_words long, n_hit long, spans binary, items array<string>, matches array<{MATCH}>"


def _scan(queries: Queries, place: int, with_items: bool, with_matches: bool):
    """A function of a batch that yields (first, last text of the shard, word counts, hits) for each shard."""

    def run(batch: pa.RecordBatch):
        data, offsets = text_buffer(batch.column(place))
        for i, j in text_groups(offsets, SHARD_BYTES):
            w = words(data, offsets[i : j + 1], ALNUM)
            hit, spans, items, matches = np.zeros(j - i, np.int64), [b""] * (j - i), [[] for _ in range(j - i)], [[] for _ in range(j - i)]
            found = _occurrences(w.number, w.first, queries)
            if found:
                position = np.concatenate([p for p, _ in found.values()])
                start, end = _spans(position, np.repeat(list(found), [len(p) for p, _ in found.values()]), len(w.number))
                # two documents' runs can touch: cut them at the documents' ends
                text = np.searchsorted(w.first, start, side="right") - 1
                while (over := end > w.first[text + 1]).any():
                    cut = w.first[text[over] + 1]
                    start, end = np.concatenate([start, cut]), np.concatenate([np.where(over, w.first[text + 1], end), end[over]])
                    text = np.searchsorted(w.first, start, side="right") - 1
                by = np.argsort(start)
                start, end, text = start[by], end[by], text[by]
                for t, a, z in zip(*_runs(text)):
                    mine = np.stack([start[a:z], end[a:z]], axis=1) - w.first[t]
                    spans[t], hit[t] = mine.astype(np.int64).tobytes(), int((mine[:, 1] - mine[:, 0]).sum())
            if found and with_items:
                text = np.searchsorted(w.first, position, side="right") - 1
                held = np.concatenate([queries.sets[size][v] for size, (_, v) in found.items()])
                many = len(queries.members)
                met = np.unique(text * many + held)  # distinct sets of each text
                for t, a, z in zip(*_runs(met // many)):
                    items[t] = queries.ids[np.unique(np.concatenate([queries.members[k] for k in met[a:z] % many]))].tolist()
            if with_matches:
                for size, (p, v) in found.items():
                    for t, at, row, there, n in longest(p, v, w.first, size, queries.places[size]).T.tolist():
                        matches[t].append({"item_id": str(queries.ids[queries.item[row]]), "doc_word": at - int(w.first[t]), "item_word": there, "n_words": n})
            yield i, j, np.diff(w.first), hit, spans, items, matches

    return run


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(value, begin, end) of the runs of equal values."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)]


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast query blocks one by one, and whether it is the only one; sizes are checked before a block is collected."""
    spark = benchmark.sparkSession
    rows = only(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    many = max(1, -(-2 * size // limit)) if size > limit else 1
    for k in range(many):
        part = rows if many == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        got = part.toArrow()
        yield spark.sparkContext.broadcast(item_windows(got.column(0).to_pylist(), got.column(1).to_pylist())), many == 1


def contamination(docs: DataFrame, benchmark: DataFrame, with_matches: bool = True) -> DataFrame:
    """One row per document with the words that benchmark windows cover.

    Words are [0-9a-z] and everything above ASCII, after lower-casing A-Z. A
    window is 10 consecutive words of an item, or all of a shorter item. Null and
    empty texts have no words and no hits; items without words have no windows;
    an item_id counts once even if its row repeats; a null item_id counts as "".
    Repeated documents are separate rows. Empty tables give an empty result or no
    hits. Other columns are ignored; long texts are taken whole. Repetitive texts
    (one word many times, in document and item) need no more than others: hits come
    from distinct windows, items from the distinct sets of items of these.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 (of the item_ids sorted
    as strings and comma-joined), contaminated, items, spans (binary: int64 pairs
    of word numbers [from, to): the document's longest covered runs), and matches,
    filled if ``with_matches``: the longest verbatim matches, each with item_id, first
    word in document and item, and number of words. Rows that repeat an item have
    their matches each. A passage that stands at many places of both sides, in other
    surroundings each time, has a match for each pair of places.
    """
    rows = only(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _scan(block.value, 1, True, with_matches)
            for batch in batches:
                for i, j, count, hit, spans, items, matches in find(batch):
                    yield pa.record_batch(
                        [batch.column(0)[i:j], batch.column(2)[i:j], pa.array(count, pa.int64()), pa.array(hit), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(matches, MATCHES)],
                        names=["doc_id", "row", "n_words", "n_hit", "spans", "items", "matches"],
                    )

        return rows.mapInArrow(run, f"doc_id {kind}, row long, {HITS}")

    parts = []
    for block, lone in blocks_of(benchmark):
        if lone:
            rows = rows.withColumn("row", F.lit(0).cast("long"))
            found = scan(block)
            break
        if not parts:
            rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        parts.append(settle(scan(block), "hits"))
        block.destroy()
    else:
        every = reduce(DataFrame.union, parts)
        found = every.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("parts"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"),
        ).mapInArrow(_join_spans, f"doc_id {kind}, row long, {HITS}")
    ids = F.array_sort("items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), ids.alias("items"), "spans", "matches",
    )


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, hits = [], []
        for parts in batch.column(3).to_pylist():
            every = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in parts])
            start, end = _spans(every[:, 0], every[:, 1] - every[:, 0], int(every[:, 1].max(initial=0)))
            spans.append(np.stack([start, end], axis=1).astype(np.int64).tobytes())
            hits.append(int((end - start).sum()))
        yield pa.record_batch([batch.column(1), batch.column(0), batch.column(2), pa.array(hits, pa.int64()), pa.array(spans, pa.binary()), batch.column(4), batch.column(5)], names=["doc_id", "row", "n_words", "n_hit", "spans", "items", "matches"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which any benchmark window occurs; all columns stay, whatever their names; no shuffle.

    Null and empty texts have no words and stay. Rows that repeat stay or go
    together; null doc_ids are rows like any other. Empty table: empty result; an
    empty benchmark, or one without words, removes nothing. Long texts are searched whole.
    """
    plain, place = stowed(docs)[0], docs.columns.index("text")
    for block, lone in blocks_of(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            find = _scan(block.value, place, False, False)
            for batch in batches:
                for i, j, _, hit, *_ in find(batch):
                    yield batch.slice(i, j - i).filter(pa.array(hit == 0))

        plain = plain.mapInArrow(run, plain.schema)
        if not lone:
            plain = settle(plain, "clean")
            block.destroy()
    return plain.toDF(*docs.columns)


SQL = r"""
WITH az AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, az),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, az),
bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM di),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
