"""Quality classifier: a factorisation machine over hashed words and text statistics.

score = sigmoid(b + <w, x> + 1/2 sum_k [ (sum_i v_ik x_i)^2 - sum_i (v_ik x_i)^2 ]),
the sum-of-squares identity, linear in the number of features. Features are word
occurrences (hashed to BUCKETS, each with value 1/sqrt(words)) and standardised
statistics of the text's structure and size. Fitted with numpy on a bounded
sample, balanced over labels; the intercept is then set to the labels' own odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.fitting import held_out, labelled_sample
from marlstone.llm.frames import only
from marlstone.llm.words import CHUNK, NOT_SPACE, U, Words, stretches, text_buffer, text_groups, words

BUCKETS, RANK = 1 << 15, 8
PER_CLASS, SAMPLE_BYTES = 1500, 8 << 20  # the fit takes so many rows of each label, and so many bytes of them
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.02, 1e-4
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256),
    "stop": b".?!", "pause": b",;:", "shout": b"!", "symbol": b"#$%&*+=@^_~", "bar": b"|/\\", "bracket": b"()[]{}<>", "quote": b"'\"", "line": b"\n", "blank": b" \t",
}
_TABLE = np.zeros((256, len(_CLASSES)), bool)
for _k, _v in enumerate(_CLASSES.values()):
    _TABLE[list(_v), _k] = True


class Texts(NamedTuple):
    bucket: np.ndarray   # of each word
    first: np.ndarray    # each text's first word
    stats: np.ndarray    # (texts, statistics)


def _statistics(n: np.ndarray, count: np.ndarray, classes: np.ndarray, odd: np.ndarray, repeat: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """A row for each text from its sums: bytes, words, bytes of each class, words with an odd end, repeats, distinct words."""
    some = np.maximum(count, 1)
    columns = [np.log1p(n), np.log1p(count), (n - count) / some, *(classes / np.maximum(n, 1)), odd / some, repeat / some, distinct / some]
    return np.stack(columns, axis=1) if len(n) else np.zeros((0, _TABLE.shape[1] + 6))


def _sums_of(data: np.ndarray, offsets: np.ndarray, w: Words) -> tuple[np.ndarray, ...]:
    """What ``_statistics`` takes, but for distinct words."""
    body = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    classes = []
    for k in range(_TABLE.shape[1]):
        total = np.concatenate(([0], np.cumsum(_TABLE[:, k][body])))
        classes.append(total[at[1:]] - total[at[:-1]])
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    odd = np.concatenate(([0], np.cumsum(_TABLE[last][:, 7] | _TABLE[last][:, 6])))
    same = np.zeros(len(w.number) + 1, bool)
    same[1:-1] = w.number[1:] == w.number[:-1]
    same[w.first] = False  # a text's first word repeats nothing
    repeat = np.concatenate(([0], np.cumsum(same[:-1])))
    return np.diff(offsets).astype(float), np.diff(w.first).astype(float), np.array(classes), odd[w.first[1:]] - odd[w.first[:-1]], repeat[w.first[1:]] - repeat[w.first[:-1]]


def _buckets(w: Words) -> np.ndarray:
    return (w.number >> U(64 - 15)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Texts:
    w = words(data, offsets, NOT_SPACE)
    distinct = np.array([len(np.unique(w.number[a:b])) for a, b in zip(w.first[:-1], w.first[1:])], dtype=float)
    return Texts(_buckets(w), w.first, _statistics(*_sums_of(data, offsets, w), distinct))


class Model(NamedTuple):
    bias: float
    word: np.ndarray      # (BUCKETS, 1 + RANK): weight and factors
    stat: np.ndarray      # (statistics, 1 + RANK)
    centre: np.ndarray
    spread: np.ndarray


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows first[i]:first[i+1]; empty ranges are 0."""
    out = np.zeros((len(first) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def _word_sums(model: Model, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weights, factors and squared factors, summed over each text's words."""
    table = np.concatenate((model.word, model.word[:, 1:] ** 2), axis=1)
    return _sums(table.take(bucket, axis=0), first)


def _parts(model: Model, x: Texts):
    """Linear part, factor sums, and the standardised statistics."""
    return _joined(model, _word_sums(model, x.bucket, x.first), np.diff(x.first), x.stats)


def _joined(model: Model, rows: np.ndarray, count: np.ndarray, stats: np.ndarray):
    scale = 1 / np.sqrt(np.maximum(count, 1))
    z = np.clip((stats - model.centre) / model.spread, -6, 6)
    linear = rows[:, 0] * scale + z @ model.stat[:, 0]
    factors = rows[:, 1 : 1 + RANK] * scale[:, None] + z @ model.stat[:, 1:]
    squares = rows[:, 1 + RANK :] * (scale**2)[:, None] + z**2 @ model.stat[:, 1:] ** 2
    return linear, factors, squares, z, scale


def logits(model: Model, x: Texts) -> np.ndarray:
    linear, factors, squares, _, _ = _parts(model, x)
    return model.bias + linear + 0.5 * (factors**2 - squares).sum(axis=1)


def long_logit(model: Model, data: np.ndarray, begin: int, end: int, limit: int = CHUNK) -> np.ndarray:
    """``logits`` of one long text, summed over stretches of it; the distinct words' numbers are all that is kept."""
    sums: list[np.ndarray] | None = None
    rows, seen, last = 0.0, np.zeros(0, np.uint64), None
    for a, z in stretches(data, begin, end, NOT_SPACE, limit):
        offsets = np.array([a, z])
        w = words(data, offsets, NOT_SPACE)
        now = list(_sums_of(data, offsets, w))
        if len(w.number):
            now[4] = now[4] + (last is not None and w.number[0] == last)
            last = w.number[-1]
        sums = now if sums is None else [x + y for x, y in zip(sums, now)]
        rows = rows + _word_sums(model, _buckets(w), w.first)
        seen = np.union1d(seen, w.number)
    linear, factors, squares, _, _ = _joined(model, rows, sums[1], _statistics(*sums, np.array([float(len(seen))])))
    return model.bias + linear + 0.5 * (factors**2 - squares).sum(axis=1)


def _scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    one = len(offsets) == 2 and offsets[1] - offsets[0] > CHUNK
    z = long_logit(model, data, int(offsets[0]), int(offsets[1])) if one else logits(model, features(data, offsets))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _take(x: Texts, rows: np.ndarray) -> Texts:
    count = np.diff(x.first)[rows]
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(x.first[rows], count)
    return Texts(x.bucket[at], first, x.stats[rows])


def fit(x: Texts, y: np.ndarray, prior: float, seed: int = 3) -> Model:
    """Adagrad over small batches; gradients follow from the sum-of-squares identity."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = x.stats.shape[1]
    centre, spread = (x.stats.mean(axis=0), x.stats.std(axis=0) + 1e-3) if len(y) else (np.zeros(n), np.ones(n))
    word, stat = np.zeros((BUCKETS, 1 + RANK)), np.zeros((n, 1 + RANK))
    word[:, 1:], stat[:, 1:] = rng.normal(0, 0.02, (BUCKETS, RANK)), rng.normal(0, 0.02, (n, RANK))
    model = Model(0.0, word, stat, centre, spread)
    seen_word, seen_stat = np.full(word.shape, 1e-3), np.full(stat.shape, 1e-3)
    if not len(y) or y.min() == y.max():
        return model._replace(bias=_logit(prior), word=np.zeros_like(word), stat=np.zeros_like(stat))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            part = _take(x, rows)
            linear, factors, squares, z, scale = _parts(model, part)
            g = 1 / (1 + np.exp(-(linear + 0.5 * (factors**2 - squares).sum(axis=1)))) - y[rows]
            count = np.diff(part.first)
            used, which = np.unique(part.bucket, return_inverse=True)
            each = np.concatenate((np.ones((len(rows), 1)), factors), axis=1) * (g * scale)[:, None]
            grad = np.zeros((len(used), 1 + RANK))
            np.add.at(grad, which, np.repeat(each, count, axis=0))
            grad[:, 1:] -= np.bincount(which, weights=np.repeat(g * scale**2, count), minlength=len(used))[:, None] * word[used, 1:]
            grad = grad / len(rows) + DECAY * word[used]
            seen_word[used] += grad**2
            word[used] -= RATE * grad / np.sqrt(seen_word[used])
            grad = np.concatenate(((z.T @ g)[:, None], z.T @ (factors * g[:, None]) - (z**2).T @ g[:, None] * stat[:, 1:]), axis=1) / len(rows) + DECAY * stat
            seen_stat += grad**2
            stat -= RATE * grad / np.sqrt(seen_stat)
    return model._replace(bias=_logit(prior) - _logit(float(y.mean())))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample, prior = labelled_sample(docs, labels, "quality", per_class, SAMPLE_BYTES)
    data, offsets = text_buffer(pa.array([t for t, _, _ in sample], pa.string()))
    return fit(features(data, offsets), np.array([y for _, y, _ in sample], dtype=float), prior)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text; higher: label 1 likelier.

    The fit takes up to ``per_class`` rows and SAMPLE_BYTES bytes of each label
    (see ``labelled_sample``) that aren't held out; label rows that repeat count
    once, an id with both labels counts for both. With no labels, or one kind only, every score is the
    labels' share of ones. Null counts as the empty text, which has a score too.
    Repeated rows are rows like any other; a null doc_id counts as empty text in
    the fold. Empty table: empty result; other columns are ignored. A text of over a
    megabyte is scored whole, a stretch at a time; a single word of any length is one.

    Returns doc_id, held_out, score, predicted (1 if score >= threshold).
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    rows = only(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j in text_groups(offsets):
                score = _scores(model.value, data, offsets[i : j + 1])
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
