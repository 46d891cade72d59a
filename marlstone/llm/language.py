"""Language ID: unigram pieces of a fixed public vocabulary, all segmentations summed.

A text is a sequence of words (split at white space, lower-cased), each begun by
the vocabulary's word mark. Pieces never cross words, so the text's likelihood is
the product of its words' likelihoods, and a word's is the sum over all ways to
cut it into pieces, by the forward algorithm. Each language has its own piece
probabilities, estimated by expectation-maximisation over segmentations (the
forward and backward sums give the expected counts). A character that is no piece
is an unknown piece. Sums over long words are rescaled every STRETCH characters, so words of
any length are summed over all their segmentations; only the fit's expected counts take long
words in stretches.

Inside a task the distinct words of a few megabytes of text are scored together,
one position of all words at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.fitting import held_out
from marlstone.llm.frames import only
from marlstone.llm.words import CHUNK, U, mix, powers, text_groups

MARK = "▁"
STRETCH = 48
PER_LANGUAGE, SAMPLE_BYTES = 400, 2 << 20  # the fit takes so many texts of each language, and so many bytes of them
ROUNDS = 2
SMOOTH = 0.5
SCALE = np.e**7  # of a character, against underflow
SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_spaces = np.zeros(0x3001, bool)
_spaces[SPACE] = True


def piece_table(path: str) -> list[str]:
    """The vocabulary's lower-case pieces, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return sorted({p for p in pieces if p and p == p.lower() and len(p) <= STRETCH})


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _totals(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over code points."""
    up, _ = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + U(0x51ED27)) * up[: len(codes)], out=total[1:])
    return total


class Pieces:
    """Looks up substrings among the pieces by hash, one length at a time."""

    BITS = 22

    def __init__(self, pieces: list[str]):
        self.count = len(pieces)
        self.sizes = np.array([len(p) for p in pieces] + [1])
        codes = _codes("".join(pieces))
        length = np.array([len(p) for p in pieces])
        first = np.cumsum(length) - length
        total, (_, down) = _totals(codes), powers(len(codes) + 1)
        number = mix((total[first + length] - total[first]) * down[first])
        self.filter = np.zeros(1 << self.BITS, bool)
        self.filter[number >> U(64 - self.BITS)] = True
        self.by_length = {}
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            at = at[np.argsort(number[at])]
            self.by_length[int(n)] = number[at], at

    def edges(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of each piece in the words; ``stop``: where the word of each character ends.

        Single characters that are no piece get the piece number ``count``.
        """
        total, (_, down) = _totals(codes), powers(len(codes) + 1)
        at = np.arange(len(codes))
        out = []
        for n, (number, piece) in self.by_length.items():
            if n > len(codes):
                continue
            start = at[: len(codes) - n + 1]
            h = mix((total[n:] - total[:-n]) * down[: len(start)])
            start = np.flatnonzero(self.filter[h >> U(64 - self.BITS)] & (start + n <= stop[: len(start)]))
            h = h[start]
            place = np.minimum(np.searchsorted(number, h), len(number) - 1)
            hit = number[place] == h
            out.append((start[hit], np.full(hit.sum(), n), piece[place[hit]]))
            if n == 1:
                lone = np.ones(len(codes), bool)
                lone[start[hit]] = False
                lone = np.flatnonzero(lone)
                out.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), self.count)))
        return tuple(np.concatenate(x) for x in zip(*out))


class Spelled(NamedTuple):
    """Words as code points, one after the other."""

    codes: np.ndarray
    base: np.ndarray    # each word's first character
    length: np.ndarray
    owner: np.ndarray   # the word of each character


class DistinctWords:
    """The distinct words of some texts as code points with a mark in front; longer than ``stretch`` they are cut if that is given."""

    def __init__(self, texts: list[str], stretch: int | None = None):
        lowered = [t.lower() for t in texts]
        joined = _codes("\n".join(lowered))
        sizes = np.array([len(t) for t in lowered], dtype=np.int64)
        n = len(joined)
        blank = np.zeros(n + 2, bool)
        blank[0] = blank[-1] = True
        small = joined < len(_spaces)
        blank[1:-1][small] = _spaces[joined[small]]
        start = np.flatnonzero(blank[:-2] & ~blank[1:-1])
        end = np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
        whole = np.ones(len(start), bool)
        if stretch and len(start) and (end - start).max() >= stretch:
            many = -(-(end - start) // stretch)
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start, limit = np.repeat(start, many) + nth * stretch, np.repeat(end, many)
            end, whole = np.minimum(start + stretch, limit), nth == 0
        total, (_, down) = _totals(joined), powers(n + 1)
        number = mix((total[end] - total[start]) * down[start] + whole.astype(np.uint64) + (end - start).astype(np.uint64) * U(2))
        self.number, sample, self.which = np.unique(number, return_index=True, return_inverse=True)
        begin = np.cumsum(sizes + 1) - sizes - 1
        self.first = np.searchsorted(start, np.append(begin, n + 1))  # each text's first word
        self._at = joined, start[sample], end[sample], whole[sample].astype(np.int64)

    def spell(self, some: np.ndarray | slice = slice(None)) -> Spelled:
        joined, a, z, m = self._at
        a, z, m = a[some], z[some], m[some]
        length = z - a + m
        base = np.cumsum(length) - length
        codes = np.empty(int(length.sum()), np.uint32)
        codes[base[m > 0]] = ord(MARK)
        owner = np.repeat(np.arange(len(a)), length)
        inner = np.arange(len(codes)) - base[owner] - m[owner]
        body = inner >= 0
        codes[body] = joined[(a[owner] + inner)[body]]
        return Spelled(codes, base, length, owner)


class Plan(NamedTuple):
    """Pieces found in words, as steps between cells; a word has one more cell than characters."""

    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    size: np.ndarray
    word: np.ndarray
    begin: np.ndarray  # offset in the word


def _plan(words: Spelled, pieces: Pieces) -> Plan:
    start, size, piece = pieces.edges(words.codes, (words.base + words.length)[words.owner])
    word = words.owner[start]
    return Plan(start + word, start + size + word, piece, size, word, start - words.base[word])


def _sweep(cells: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, key: np.ndarray) -> None:
    """cells[target] += weight * cells[source] in order of ``key``; steps with one key have different targets."""
    order = np.argsort(key.astype(np.int16), kind="stable")
    source, target, weight, key = source[order], target[order], weight[order], key[order]
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, z in zip(cuts, cuts[1:]):
        cells[target[a:z]] += weight[a:z] * cells.take(source[a:z], axis=0)


def _key(step: np.ndarray, size: np.ndarray) -> np.ndarray:
    return step * (STRETCH + 2) + size


def word_scores(words: Spelled, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word under each language."""
    langs = probability.shape[1]
    if not len(words.base):
        return np.zeros((0, langs))
    plan = _plan(words, pieces)
    cells = np.zeros((len(words.codes) + len(words.base), langs))
    head = words.base + np.arange(len(words.base))
    cells[head] = 1
    scaled = probability * (SCALE ** pieces.sizes)[:, None]
    outside = words.length[:, None] * np.full(langs, -np.log(SCALE))  # what is divided out of the cells
    reach = plan.begin + plan.size
    phase = (reach - 1) // STRETCH  # a piece is no longer than STRETCH, so it begins in this phase or the one before
    order = np.argsort(phase, kind="stable")
    cuts = np.searchsorted(phase[order], np.arange(int(phase.max(initial=0)) + 2))
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        some = order[a:z] if len(cuts) > 2 else slice(None)
        _sweep(cells, plan.source[some], plan.target[some], scaled.take(plan.piece[some], axis=0), _key(reach[some] - k * STRETCH, plan.size[some]))
        longer = np.flatnonzero(words.length > (k + 1) * STRETCH)
        if len(longer):
            mine = head[longer][:, None] + np.arange(k * STRETCH + 1, (k + 1) * STRETCH + 1)
            top = cells[mine].max(axis=1)
            cells[mine] /= top[:, None]
            outside[longer] += np.log(top)
    return np.log(cells[head + words.length]) + outside


def text_scores(words: DistinctWords, score, langs: int) -> np.ndarray:
    """Log-likelihood of each text under each language; a text's sum is its own, whatever stands beside it."""
    each = score(words)[words.which]
    out = np.zeros((len(words.first) - 1, langs))
    for k, (a, z) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if a < z:
            out[k] = each[a:z].sum(axis=0)
    return out


def text_stretches(text: str, limit: int) -> Iterator[str]:
    """A text in parts of about ``limit`` characters that end before white space; a longer word stays whole."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + limit)
        while stop < len(text):
            blank = np.flatnonzero(np.isin(_codes(text[stop : stop + 4096]), SPACE))
            if len(blank):
                stop += int(blank[0])
                break
            stop = min(len(text), stop + 4096)
        yield text[at:stop]
        at = stop


class ScoreMemory:
    """Scores of words met before in this task, up to a fixed number of words."""

    LIMIT = 1_000_000

    def __init__(self, pieces: Pieces, probability: np.ndarray):
        self.pieces, self.probability = pieces, probability
        self.number, self.score = np.zeros(0, np.uint64), np.zeros((0, probability.shape[1]))

    def scores(self, words: DistinctWords) -> np.ndarray:
        place = np.searchsorted(self.number, words.number)
        known = np.zeros(len(place), bool)
        inside = place < len(self.number)
        known[inside] = self.number[place[inside]] == words.number[inside]
        out = np.empty((len(words.number), self.probability.shape[1]))
        out[known] = self.score[place[known]]
        fresh = np.flatnonzero(~known)
        out[fresh] = word_scores(words.spell(fresh), self.pieces, self.probability)
        if len(self.number) + len(fresh) <= self.LIMIT:
            self.number = np.insert(self.number, place[fresh], words.number[fresh])
            self.score = np.insert(self.score, place[fresh], out[fresh], axis=0)
        return out


_memories: dict[str, ScoreMemory] = {}


def _memory(key: str, names: list[str], probability: np.ndarray) -> ScoreMemory:
    """The worker's memory for one fitted model; it outlives a task where workers are reused."""
    if key not in _memories:
        _memories.clear()
        _memories[key] = ScoreMemory(Pieces(names), probability)
    return _memories[key]


def _expected(words: Spelled, counts: np.ndarray, pieces: Pieces, plan: Plan, probability: np.ndarray) -> np.ndarray:
    """Expected piece counts of the words, each with its count, for one language."""
    head = words.base + np.arange(len(words.base))
    scaled = (probability * SCALE**pieces.sizes)[plan.piece][:, None]
    forward, backward = np.zeros((2, len(words.codes) + len(words.base), 1))
    forward[head], backward[head + words.length] = 1, 1
    _sweep(forward, plan.source, plan.target, scaled, _key(plan.begin + plan.size, plan.size))
    _sweep(backward, plan.target, plan.source, scaled, _key(STRETCH + 1 - plan.begin, plan.size))
    share = forward[plan.source, 0] * scaled[:, 0] * backward[plan.target, 0] / forward[head + words.length, 0][plan.word]
    return np.bincount(plan.piece, weights=share * counts[plan.word], minlength=pieces.count + 1)


def fit(samples: dict[str, list[str]], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities, one column for each language in sorted order; the last row is the unknown piece."""
    out = []
    for lang in sorted(samples):
        distinct = DistinctWords(samples[lang], STRETCH - 1)
        p = np.full(pieces.count + 1, 1 / (pieces.count + 1))
        if len(distinct.number):
            words, counts = distinct.spell(), np.bincount(distinct.which)
            plan = _plan(words, pieces)
            for _ in range(rounds):
                n = _expected(words, counts, pieces, plan, p) + SMOOTH
                p = n / n.sum()
        out.append(p)
    return np.stack(out, axis=1) if out else np.zeros((pieces.count + 1, 0))


def training_sample(docs: DataFrame, per_language: int, max_bytes: int) -> dict[str, list[str]]:
    """Up to ``per_language`` whole texts of each language, the first in order of a hash of doc_id.

    No more are taken than have ``max_bytes`` bytes together (one at least, whatever its size).
    """
    rows = only(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("which", F.xxhash64("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", "which")
    ids = rows.select("key", "lang", "which", F.octet_length("text").cast("long").alias("size")).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= per_language)
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("nth")) - F.col("size")
    ids = ids.withColumn("before", before).filter(F.col("before") < max_bytes).select("key", "lang", "which", "nth")
    got = rows.select("key", "lang", "which", "text").join(F.broadcast(ids), ["key", "lang", "which"]).dropDuplicates(["lang", "nth"]).orderBy("lang", "nth").select("lang", "text").toArrow()
    out: dict[str, list[str]] = {}
    for lang, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out.setdefault(lang, []).append(text)
    return out


def identify(docs: DataFrame, vocabulary_path: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Predict the language of every whole text.

    Learns from text and non-null lang of rows that aren't held out (crc32 of
    doc_id as text, modulo 5, isn't 0), on a bounded sample (PER_LANGUAGE texts of
    each language, as many as have SAMPLE_BYTES bytes together). Null texts, texts without a letter,
    and all texts if nothing can be learned, are "und" with score 0. The score is
    the predicted language's posterior (uniform prior). Ties go to the first
    language in sorted order. Repeated rows are rows like any other; a null
    doc_id counts as empty text in the fold. Empty table: empty result; other columns
    are ignored. A text of over a megabyte is scored whole, a stretch at a time; a
    single word is scored in one piece.

    Returns doc_id, held_out, lang_pred, score.
    """
    samples = training_sample(docs, per_language, SAMPLE_BYTES)
    names = piece_table(vocabulary_path)
    probability = fit(samples, Pieces(names))
    model = docs.sparkSession.sparkContext.broadcast((names, sorted(samples), probability))
    key = uuid.uuid4().hex
    rows = only(docs, "doc_id", "text")
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, langs, probability = model.value
        memory = _memory(key, names, probability)
        for batch in batches:
            offsets = np.concatenate(([0], np.cumsum(np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(2)], dtype=np.int64))))
            for i, j in text_groups(offsets):
                texts = batch.column(2)[i:j].to_pylist()
                predicted, score = ["und"] * (j - i), np.zeros(j - i)
                if langs:
                    if j - i == 1 and offsets[j] - offsets[i] > CHUNK:  # a long text: its stretches' sums are added up
                        text = sum(text_scores(DistinctWords([part]), memory.scores, len(langs)) for part in text_stretches(texts[0] or "", CHUNK))
                    else:
                        text = text_scores(DistinctWords([t or "" for t in texts]), memory.scores, len(langs))
                    best = text.argmax(axis=1)
                    score = 1 / np.exp(text - text.max(axis=1, keepdims=True)).sum(axis=1)
                    known = [t is not None for t in texts]
                    predicted = [langs[b] if k else "und" for b, k in zip(best, known)]
                    score = np.where(known, score, 0.0)
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(predicted, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
