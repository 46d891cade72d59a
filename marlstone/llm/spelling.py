"""Spelling variant grouping: words one error apart, by forward and backward minimal automata.

1. Words are counted with partial sums in every task.
2. A word is halved. If another is one error away, the error is in one half, so the
   other half is exact: a prefix of it (forward) or a suffix (backward, where words are
   read from the end). Words meet by exact half: each asks with its own half, and stands
   in the dictionary under each half that a word of its length, one less or one more
   would ask with.
3. A task builds minimal acyclic automata of some thousand dictionary words each, where
   every transition knows how many words come before those behind it, so a path's sum is
   the word's number. A query follows its exact half, then is completed with one error.
   What both directions would find is left to the forward one, so pairs never meet again:
   a query's answer is a count and its best partner.
4. A half that very many words have is dealt out: its dictionary in pieces and its
   queries in pieces, each pair of pieces in a place of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, takewhile
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.frames import only, settle

LEAST_LENGTH, LEAST_COUNT = 5, 3
TYPO = 97                # of (document, run) pairs one in so many loses a code point
STRETCH = 1 << 20        # bytes of a text that are split into runs at once
FLUSH = 200_000          # distinct words that a task counts before it passes them on
PIECE = 1 << 15          # dictionary words of one half, or queries, that are met in one place
CHUNK = 1 << 14          # dictionary words of one automaton (a single half may have up to PIECE)
KNOWN = 100_000          # heavy halves up to which they are broadcast

_run = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_edge = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")  # an ASCII byte that is in no run


def counted(doc_id: int | None, text: bytes, stretch: int = STRETCH) -> Iterator[tuple[str, int]]:
    """Words of a text with their occurrences, a stretch at a time; a run whose crc32 with the doc_id TYPO divides loses a code point."""
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    at = 0
    while at < len(text):
        edge = _edge.search(text, at + stretch)
        stop = edge.start() if edge else len(text)
        for word, n in Counter(_run.findall(text[at:stop].lower().decode())).items():
            h = zlib.crc32(word.encode(), base)
            if h % TYPO == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
                if len(word) < LEAST_LENGTH:
                    continue
            yield word, n
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word, n in counted(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b""):
                total[word] += n
            if len(total) >= FLUSH:
                yield out()
                total.clear()
    if total:
        yield out()


def halves(length: int) -> tuple[int, int]:
    """How long the exact prefix and the exact suffix of a query are."""
    return length // 2, length - length // 2


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to (side, half, role, spelling, n): role 0 in the dictionary, 1 a query; side 1 spells from the end."""
    names = ["side", "half", "role", "spelling", "n"]
    for batch in batches:
        rows = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            size = len(word)
            for side, spelling in ((0, word), (1, word[::-1])):
                rows.append((side, spelling[: halves(size)[side]], 1, spelling, n))
                for k in {halves(s)[side] for s in (size - 1, size, size + 1) if s >= LEAST_LENGTH}:
                    rows.append((side, spelling[:k], 0, spelling, n))
        for at in range(0, len(rows), 8192):
            columns = zip(*rows[at : at + 8192])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64()))], names=names)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with perfect-hash numbers.

    ``edges[s][c]`` is (next state, words that come before those behind c).
    """

    def __init__(self, words: list[str]):
        self.words = words
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        many: list[int] = []      # words from each state on
        known: dict[tuple, int] = {}
        # states of the latest word that can still change: (final, targets by character)
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]

        def freeze(state: tuple[list[bool], dict[str, int]]) -> int:
            key = (state[0][0], tuple(state[1].items()))
            if key not in known:
                known[key] = len(many)
                before = accumulate((many[t] for t in state[1].values()), initial=int(state[0][0]))
                self.edges.append({c: (t, n) for (c, t), n in zip(state[1].items(), before)})
                self.final.append(state[0][0])
                many.append(int(state[0][0]) + sum(many[t] for t in state[1].values()))
            return known[key]

        last = ""
        for word in words:
            shared = sum(1 for _ in takewhile(bool, map(eq, last, word)))
            while len(path) - 1 > shared:
                state = path.pop()
                path[-1][1][last[len(path) - 1]] = freeze(state)
            path.extend(([False], {}) for _ in range(len(word) - shared))
            path[-1][0][0] = True
            last = word
        while len(path) > 1:
            state = path.pop()
            path[-1][1][last[len(path) - 1]] = freeze(state)
        self.start = freeze(path[0])

    def follow(self, state: int, number: int, text: str, at: int) -> tuple[int, int] | None:
        """State and number after text[at:]."""
        edges = self.edges
        for c in text[at:] if at else text:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with word[:exact] and are one inserted, deleted or replaced character away."""
        found: set[int] = set()
        here = self.follow(self.start, 0, word[:exact], 0)
        at = exact

        def complete(state: int, number: int, begin: int) -> None:
            end = self.follow(state, number, word, begin)
            if end is not None and self.final[end[0]]:
                found.add(end[1])

        while here is not None:
            state, number = here
            now = word[at] if at < len(word) else None
            fresh = at == exact or word[at - 1] != now  # in a run of one character it doesn't matter which goes
            if now is not None and fresh:
                complete(state, number, at + 1)
            for c, (to, skip) in self.edges[state].items():
                if at == exact or word[at - 1] != c:
                    complete(to, number + skip, at)
                if now is not None and c != now:
                    complete(to, number + skip, at + 1)
            if now is None:
                break
            step = self.edges[state].get(now)
            here = (step[0], number + step[1]) if step else None
            at += 1
        return found


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (side, tile, half, role, spelling, n) in that order: (word, n_near, form_n, form) of the queries that have near words.

    Halves without tiles share an automaton: a query finds only words that begin with
    its half, and all of these stand under that half. A tile has one of its own.
    """
    book: dict[str, int] = {}       # dictionary of the halves held
    queries: list[str] = []
    now, half = None, None          # (side, tile) and half of the rows held

    def answers() -> Iterator[pa.RecordBatch]:
        words = sorted(book)
        automaton, side = Automaton(words), now[0]
        out = []
        for spelling in queries:
            exact = halves(len(spelling))[side]
            word = spelling[::-1] if side else spelling
            names = [words[i] for i in automaton.one_error(spelling, exact)]
            near = [(-book[x], x[::-1] if side else x) for x in names]
            if side:  # the forward direction finds what has the prefix
                k = halves(len(word))[0]
                near = [x for x in near if x[1][:k] != word[:k]]
            if near:
                best = min(near)
                out.append((word, len(near), -best[0], best[1]))
        for at in range(0, len(out), 8192):
            columns = zip(*out[at : at + 8192])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "form_n", "form"])

    for batch in batches:
        for side, tile, h, role, spelling, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (side, tile) != now or (h != half and (tile >= 0 or len(book) >= CHUNK)):
                if queries and book:
                    yield from answers()
                book, queries = {}, []
            now, half = (side, tile), h
            if role:
                queries.append(spelling)
            else:
                book[spelling] = n
    if queries and book:
        yield from answers()


def near_words(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """(word, n_near, form_n, form) of the words of (word, n) that have near words; form has the largest n, then comes first."""
    asked = settle(words.select("word", "n").mapInArrow(_ask, "side int, half string, role int, spelling string, n long"), "halves")
    sizes = asked.groupBy("side", "half").agg(F.sum(1 - F.col("role")).alias("d"), F.sum("role").alias("q"))
    heavy = sizes.filter((F.col("d") > piece) | (F.col("q") > piece)).select("side", "half", F.ceil(F.col("d") / piece).alias("dp"), F.ceil(F.col("q") / piece).alias("qp"))
    heavy = settle(heavy, "heavy")
    many = heavy.count()
    if many:  # each dictionary piece meets each piece of queries
        met = asked.join(F.broadcast(heavy) if many <= KNOWN else heavy, ["side", "half"], "left")
        own = lambda parts: F.pmod(F.xxhash64("spelling"), parts)
        over = lambda parts: F.sequence(F.lit(0).cast("long"), parts - 1)
        tiles = F.when(F.col("dp").isNull(), F.array(F.lit(-1).cast("long")))
        tiles = tiles.when(F.col("role") == 0, F.transform(over(F.col("qp")), lambda j: own(F.col("dp")) * F.col("qp") + j))
        tiles = tiles.otherwise(F.transform(over(F.col("dp")), lambda j: j * F.col("qp") + own(F.col("qp"))))
        asked = met.select("side", F.explode(tiles).alias("tile"), "half", "role", "spelling", "n")
    else:
        asked = asked.select("side", F.lit(-1).cast("long").alias("tile"), "half", "role", "spelling", "n")
    dealt = asked.repartition("side", "half", "tile").sortWithinPartitions("side", "tile", "half", "role", "spelling")
    found = dealt.mapInArrow(_match, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def spelling_variants(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per word with its more frequent near word and the root of that chain.

    Runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts are lower-cased (A-Z only). Where
    TYPO divides h, the crc32 of ``<doc_id>:<run>``, the run loses its code point
    h % length. Words have at least LEAST_LENGTH code points and LEAST_COUNT
    occurrences. Two are near if exactly one code point is inserted, deleted or
    replaced. A word's form is its near word of largest n (ties: first in code-point
    order) if that has twice its n or more. A null text has no words, a null doc_id
    counts as the empty string, rows that repeat a doc_id count each. Empty table:
    empty result; other columns are ignored. Texts of any length are read whole, a
    stretch at a time; ``piece`` changes how the work is dealt out only.

    Returns word, form (or null), root (the word itself without a form), n, n_near,
    form_n (or null).
    """
    counts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    words = settle(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT), "words")
    found = words.join(near_words(words, piece), "word", "left")
    formed = F.col("form_n") >= 2 * F.col("n")
    found = settle(
        found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "forms",
    )
    up = settle(found.filter("form is not null").select("word", F.col("form").alias("up")), "chains")
    while True:  # counts at least double along a chain, so it has an end; each round doubles what is followed
        above = up.select(F.col("word").alias("up"), F.col("up").alias("top"))
        hop = settle(up.join(above, "up", "left").select("word", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "chains")
        up = hop.select("word", "up")
        if hop.filter("moved").isEmpty():
            break
    return found.join(up, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")
