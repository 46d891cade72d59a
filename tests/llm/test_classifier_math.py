"""The classifiers' scores against plain sums, and what the convolutions add to single words."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from marlstone.llm import quality, toxicity  # noqa: E402
from marlstone.llm.words import text_buffer  # noqa: E402

TEXTS = ["one two two three", "", "Alpha beta!! 12 $$ gamma, delta.\nNew line", "é é é", "x", "repeat " * 40]


def test_factorisation_machine_is_the_sum_over_pairs():
    x = quality.features(*text_buffer(pa.array(TEXTS)))
    rng = np.random.default_rng(4)
    n, k = x.stats.shape[1], quality.RANK
    model = quality.Model(0.3, rng.normal(0, 0.5, (quality.BUCKETS, 1 + k)), rng.normal(0, 0.5, (n, 1 + k)), rng.normal(0, 1, n), rng.uniform(0.5, 2, n))
    got = quality.logits(model, x)
    for t in range(len(TEXTS)):
        words = x.bucket[x.first[t] : x.first[t + 1]]
        z = np.clip((x.stats[t] - model.centre) / model.spread, -6, 6)
        rows = [(model.word[b], 1 / np.sqrt(len(words))) for b in words] + list(zip(model.stat, z))
        want = model.bias + sum(w[0] * v for w, v in rows)
        for i in range(len(rows)):
            for j in range(i):
                want += rows[i][1] * rows[j][1] * float(rows[i][0][1:] @ rows[j][0][1:])
        assert np.isclose(got[t], want), t


def test_scorer_is_the_plain_convolution():
    x = toxicity.features(*text_buffer(pa.array(TEXTS)))
    rng = np.random.default_rng(5)
    B, D, K = toxicity.BUCKETS, toxicity.DIM, toxicity.FILTERS
    word, stem = rng.normal(0, 1, (B, D)), rng.normal(0, 1, (B, D))
    word[0] = stem[0] = 0
    filters = [rng.normal(0, 1, (n, D, K)) for n in toxicity.WIDTHS]
    many = len(filters) * K
    model = toxicity.Model(word, stem, filters, rng.normal(0, 1, many), rng.normal(0, 1, many), 0.2, np.zeros((B, 1)), np.array([0.7]))
    got = toxicity.Scorer(model).logits(x)
    for t in range(len(TEXTS)):
        cells = range(x.first[t], x.first[t + 1])
        pooled = []
        for f in filters:
            best = np.full(K, -np.inf)
            for c in cells:
                total = np.zeros(K)
                if x.word[c]:  # windows that begin at a word; the padding's windows are 0
                    for j in range(len(f)):
                        if c + j < x.first[t + 1]:
                            total += (word[x.word[c + j]] + stem[x.stem[c + j]]) @ f[j]
                best = np.maximum(best, total)
            pooled.append(best)
        want = np.maximum(np.concatenate(pooled) + model.shift, 0) @ model.weight + model.bias - 0.7
        assert np.isclose(got[t], want, rtol=1e-4, atol=1e-3), t


@pytest.mark.parametrize("preset", [True, False])
def test_convolutions_find_what_single_words_cannot(monkeypatch, preset):
    """Toxic is the order of two words that all texts have: log-odds of words tell nothing, windows of two do."""
    if not preset:
        monkeypatch.setattr(toxicity, "_evidence", lambda bucket, first, y: 0.0)
    rng = random.Random(7)
    pool = ["sun", "tree", "road", "house", "river", "cloud"]
    texts, y = [], []
    for i in range(2400):
        w = [rng.choice(pool) for _ in range(rng.randint(6, 14))]
        k = rng.randrange(len(w))
        w[k:k] = ["you", "fool"] if i % 2 else ["fool", "you"]
        texts.append(" ".join(w)), y.append(float(i % 2))
    x, y = toxicity.features(*text_buffer(pa.array(texts))), np.array(y)
    held = np.arange(len(y)) % 8 < 1
    held = held | (np.arange(len(y)) % 8 == 3)
    model = toxicity.fit(toxicity._take(x, np.flatnonzero(~held)), y[~held], [None] * int((~held).sum()), 0.5)
    z = toxicity.Scorer(model).logits(toxicity._take(x, np.flatnonzero(held)))
    assert ((z > 0) == y[held]).mean() > 0.95
