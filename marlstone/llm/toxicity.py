"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of a hashed embedding of the word and one of its
first four bytes. Filters of several widths slide over the words; each filter
keeps its maximum over the text, and a linear layer weighs the maxima. Fitted
with numpy (Adam) on a bounded sample. Thresholds are calibrated by language:
the text's language is guessed from its words alone, and its logit is shifted so
that the language's best threshold on a validation part becomes 0.5.

For scoring, embedding and filter are multiplied beforehand: a filter of width n
is a sum of n table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.fitting import held_out, labelled_sample
from marlstone.llm.frames import only, stowed
from marlstone.llm.words import ALNUM, CHUNK, LOWER, U, mix, stretches, text_buffer, text_groups, words

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
PER_CLASS, SAMPLE_BYTES = 1500, 8 << 20  # the fit takes so many rows of each label, and so many bytes of them
EPOCHS, BATCH, RATE = 8, 32, 0.01
VALIDATION = 5   # every fifth row of the sample chooses thresholds
THRESHOLD = 0.5
PAD = max(WIDTHS) - 1


class Texts(NamedTuple):
    word: np.ndarray    # bucket of each word; PAD cells of bucket 0 follow every text
    stem: np.ndarray
    first: np.ndarray   # each text's first cell; texts are never empty, as they are padded


def features(data: np.ndarray, offsets: np.ndarray) -> Texts:
    w = words(data, offsets, ALNUM)
    count = np.diff(w.first)
    stem = np.zeros(len(w.number), np.uint64)
    for k in range(4):
        at = w.start + k
        byte = LOWER[data[np.minimum(at, len(data) - 1)]] if len(data) else np.zeros(0, np.uint8)
        stem = stem * U(257) + np.where(at < w.end, byte.astype(np.uint64) + U(1), U(0))
    first = np.concatenate(([0], np.cumsum(count + PAD)))
    cell = np.arange(len(w.number)) + np.repeat(first[:-1] - w.first[:-1], count)
    out = np.zeros((2, first[-1]), np.int64)
    out[0, cell] = 1 + (w.number % U(BUCKETS - 1)).astype(np.int64)
    out[1, cell] = 1 + (mix(stem) % U(BUCKETS - 1)).astype(np.int64)
    return Texts(out[0], out[1], first)


class Model(NamedTuple):
    word: np.ndarray     # (BUCKETS, DIM); row 0 is padding and stays 0
    stem: np.ndarray
    filters: list[np.ndarray]   # for each width (width, DIM, FILTERS)
    shift: np.ndarray    # (widths * FILTERS,)
    weight: np.ndarray
    bias: float
    languages: np.ndarray  # (BUCKETS, languages) log-odds of stems
    offset: np.ndarray     # (languages,) logit of each language's threshold


def _convolve(projected: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Filter responses at each cell; projected[j] holds rows for the j-th word of a window."""
    total = projected[0].take(at, axis=0)
    for j in range(1, len(projected)):
        total[: len(at) - j] += projected[j].take(at[j:], axis=0)
    return total


def _language_sums(model: Model, x: Texts) -> np.ndarray:
    return np.add.reduceat(model.languages.take(x.stem, axis=0), x.first[:-1], axis=0)


def guess(model: Model, x: Texts) -> np.ndarray:
    """Number of each text's likeliest language, from its words only."""
    return _language_sums(model, x).argmax(axis=1)


class Scorer:
    """A model with its tables multiplied out."""

    def __init__(self, model: Model):
        self.model = model
        self.word = [[(model.word @ f).astype(np.float32) for f in filters] for filters in model.filters]
        self.stem = [[(model.stem @ f).astype(np.float32) for f in filters] for filters in model.filters]

    def logits(self, x: Texts) -> np.ndarray:
        if len(x.first) < 2:
            return np.zeros(0)
        return self._weighed(self._maxima(x, x.word == 0), guess(self.model, x))

    def _maxima(self, x: Texts, silent: np.ndarray) -> np.ndarray:
        """Each filter's maximum over each text; windows that begin in a silent cell count as 0."""
        out = []
        for word, stem in zip(self.word, self.stem):
            response = _convolve(word, x.word)
            response += _convolve(stem, x.stem)
            response[silent] = 0  # a window that begins after a text sees nothing of the next
            out.append(np.maximum.reduceat(response, x.first[:-1], axis=0))
        return np.concatenate(out, axis=1)

    def _weighed(self, maxima: np.ndarray, lang: np.ndarray) -> np.ndarray:
        m = self.model
        return np.maximum(maxima + m.shift, 0) @ m.weight + m.bias - m.offset[lang]

    def long_logit(self, data: np.ndarray, begin: int, end: int, limit: int = CHUNK) -> np.ndarray:
        """``logits`` of one long text: maxima and language sums over stretches, each of which sees PAD words of the next."""
        top, langs = None, 0.0
        cuts = [*stretches(data, begin, end, ALNUM, limit)]
        for k, (a, z) in enumerate(cuts):
            further = words(data, np.array([z, min(end, cuts[k + 1][1])]), ALNUM).end[:PAD] if k + 1 < len(cuts) else []
            stop = int(further[-1]) if len(further) else z
            # few words in the next stretch: take it whole, and go on to the one after it
            nxt = k + 1
            while len(further) < PAD and nxt + 1 < len(cuts):
                nxt += 1
                further = words(data, np.array([z, cuts[nxt][1]]), ALNUM).end[:PAD]
                stop = int(further[-1]) if len(further) else z
            x = features(data, np.array([a, stop]))
            own = len(x.word) - PAD - len(further)
            silent = np.arange(len(x.word)) >= own
            now = self._maxima(x, silent)
            top = now if top is None else np.maximum(top, now)
            langs = langs + self.model.languages.take(x.stem[:own], axis=0).sum(axis=0)
        return self._weighed(top, np.array([np.argmax(langs)]))


def _take(x: Texts, rows: np.ndarray) -> Texts:
    count = np.diff(x.first)[rows]
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(x.first[rows], count)
    return Texts(x.word[at], x.stem[at], first)


class _Adam:
    def __init__(self, value: np.ndarray):
        self.value, self.mean, self.square, self.step = value, np.zeros_like(value), np.zeros_like(value), 0

    def move(self, grad: np.ndarray, rows=slice(None)) -> None:
        self.step += 1
        self.mean[rows] = 0.9 * self.mean[rows] + 0.1 * grad
        self.square[rows] = 0.99 * self.square[rows] + 0.01 * grad**2
        rate = RATE * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        self.value[rows] -= rate * self.mean[rows] / (np.sqrt(self.square[rows]) + 1e-8)


def _evidence(bucket: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where an embedding's first dimension starts: log-odds of label 1 by texts with the bucket, shrunk if few."""
    text = np.repeat(np.arange(len(y)), np.diff(first))
    pairs = np.unique(text * BUCKETS + bucket)
    ones = np.bincount(pairs % BUCKETS, weights=y[pairs // BUCKETS], minlength=BUCKETS)
    every = np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    rate = y.mean()
    odds = np.log((ones + 4 * rate) / (every - ones + 4 * (1 - rate))) - np.log(rate / (1 - rate))
    return odds * every / (every + 4)


def _network(x: Texts, y: np.ndarray, seed: int) -> tuple:
    rng = np.random.Generator(np.random.PCG64(seed))
    word, stem = (_Adam(rng.normal(0, 0.1, (BUCKETS, DIM))) for _ in range(2))
    for table, bucket in ((word, x.word), (stem, x.stem)):
        table.value[:, 0] = _evidence(bucket, x.first, y)
    word.value[0] = stem.value[0] = 0
    filters = [_Adam(rng.normal(0, 0.4, (n, DIM, FILTERS))) for n in WIDTHS]
    for f in filters:
        f.value[:, 0] = np.abs(f.value[:, 0]) / len(f.value)
    shift, weight, bias = _Adam(np.zeros(len(WIDTHS) * FILTERS)), _Adam(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)), _Adam(np.zeros(1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            part = _take(x, rows)
            embedded = word.value[part.word] + stem.value[part.stem]
            text = np.repeat(np.arange(len(rows)), np.diff(part.first))
            tops, spots = [], []
            for f in filters:
                response = embedded @ f.value[0]
                for j in range(1, len(f.value)):
                    response[:-j] += embedded[j:] @ f.value[j]
                response[part.word == 0] = 0
                top = np.maximum.reduceat(response, part.first[:-1], axis=0)
                # the first cell that reaches the maximum
                cell, k = np.nonzero(response == top[text])
                spot = np.zeros(top.shape, np.int64)
                spot[text[cell][::-1], k[::-1]] = cell[::-1]
                tops.append(top), spots.append(spot)
            pooled = np.maximum(np.concatenate(tops, axis=1) + shift.value, 0)
            g = (1 / (1 + np.exp(-(pooled @ weight.value + bias.value[0]))) - y[rows]) / len(rows)
            back = (g[:, None] * weight.value) * (pooled > 0)
            weight.move(pooled.T @ g + 1e-4 * weight.value)
            bias.move(np.array([g.sum()]))
            shift.move(back.sum(axis=0))
            grads, cells = [], []
            for i, f in enumerate(filters):
                b, spot = back[:, i * FILTERS : (i + 1) * FILTERS], spots[i]
                grad = np.zeros_like(f.value)
                for j in range(len(f.value)):
                    near = np.minimum(spot + j, len(embedded) - 1)
                    live = b * (spot + j < part.first[1:][:, None])
                    grad[j] = np.einsum("tkd,tk->dk", embedded[near], live)
                    grads.append((live[:, :, None] * f.value[j].T[None]).reshape(-1, DIM))
                    cells.append(near.ravel())
                f.move(grad)
            grads, cells = np.concatenate(grads), np.concatenate(cells)
            for table, bucket in ((word, part.word), (stem, part.stem)):
                used, which = np.unique(bucket[cells], return_inverse=True)
                total = np.zeros((len(used), DIM))
                np.add.at(total, which, grads)
                total[used == 0] = 0
                table.move(total, used)
    return word.value, stem.value, [f.value for f in filters], shift.value, weight.value, float(bias.value[0])


def fit(x: Texts, y: np.ndarray, langs: list[str | None], prior: float, seed: int = 5) -> Model:
    names = sorted({lang for lang in langs if lang is not None}) or [""]
    code = np.array([names.index(lang) if lang in names else -1 for lang in langs], dtype=int)
    count = np.zeros((BUCKETS, len(names)))
    for k in range(len(names)):
        mine = _take(x, np.flatnonzero(code == k))
        count[:, k] = np.bincount(mine.stem, minlength=BUCKETS)
    count[0] = 0
    odds = np.log((count + 0.5) / (count.sum(axis=0) + 0.5 * BUCKETS))
    odds[0] = 0
    if not len(y) or y.min() == y.max():
        flat = [np.zeros((n, DIM, FILTERS)) for n in WIDTHS]
        return Model(np.zeros((BUCKETS, DIM)), np.zeros((BUCKETS, DIM)), flat, np.zeros(len(WIDTHS) * FILTERS), np.zeros(len(WIDTHS) * FILTERS), _logit(prior), odds, np.zeros(len(names)))
    part = np.arange(len(y)) % VALIDATION == 0
    part = part[np.argsort(np.random.Generator(np.random.PCG64(seed)).permutation(len(y)), kind="stable")]
    model = Model(*_network(_take(x, np.flatnonzero(~part)), y[~part], seed), odds, np.zeros(len(names)))
    check, truth = _take(x, np.flatnonzero(part)), y[part]
    scores, lang = Scorer(model).logits(check), guess(model, check)
    share = np.where(truth == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    return model._replace(offset=np.array([_threshold(scores[lang == k], truth[lang == k], share[lang == k]) for k in range(len(names))]))


def _threshold(scores: np.ndarray, truth: np.ndarray, share: np.ndarray) -> float:
    """The logit that gives the best F1 at the labels' own odds, drawn to 0 where few texts tell."""
    if not len(truth) or truth.min() == truth.max():
        return 0.0
    order = np.argsort(-scores)
    s, hit, weight = scores[order], truth[order] * share[order], share[order]
    f1 = 2 * np.cumsum(hit) / (np.cumsum(weight) + hit.sum())
    best = int(np.argmax(f1))
    edge = (s[best] + s[best + 1]) / 2 if best + 1 < len(s) else s[best] - 1
    return float(edge * truth.sum() / (truth.sum() + 10))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample, prior = labelled_sample(docs, labels, "toxic", per_class, SAMPLE_BYTES)
    data, offsets = text_buffer(pa.array([t for t, _, _ in sample], pa.string()))
    return fit(features(data, offsets), np.array([y for _, y, _ in sample], dtype=float), [lang for _, _, lang in sample], prior)


_scorers: dict[int, Scorer] = {}


def _scores(model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model.id not in _scorers:
        _scorers.clear()
        _scorers[model.id] = Scorer(model.value)
    scorer = _scorers[model.id]
    one = len(offsets) == 2 and offsets[1] - offsets[0] > CHUNK
    z = scorer.long_logit(data, int(offsets[0]), int(offsets[1])) if one else scorer.logits(features(data, offsets))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Shared:
    """A broadcast model with a key that workers can remember it by."""

    def __init__(self, spark, model: Model):
        import uuid

        self.id, self._sent = uuid.uuid4().hex, spark.sparkContext.broadcast(model)

    @property
    def value(self) -> Model:
        return self._sent.value


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
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
    model = _Shared(docs.sparkSession, train(docs, labels, per_class))
    rows = only(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j in text_groups(offsets):
                score = _scores(model, data, offsets[i : j + 1])
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that ``score_toxicity`` rejects; all columns stay, whatever their names; no shuffle.

    Null and empty texts have the score of the empty text. Rows that repeat stay or
    go together; a score of exactly ``threshold`` goes. Null doc_ids are rows like
    any other. Empty table: empty result. Very long texts are scored whole.
    """
    model = _Shared(docs.sparkSession, train(docs, labels, per_class))
    plain, place = stowed(docs)[0], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(place))
            for i, j in text_groups(offsets):
                yield batch.slice(i, j - i).filter(pa.array(_scores(model, data, offsets[i : j + 1]) < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
