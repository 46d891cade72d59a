"""Long texts are scored in stretches: the result is that of the whole."""

import random

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import language, quality, toxicity
from marlstone.llm.words import ALNUM, NOT_SPACE, stretches, text_buffer, words

rng = random.Random(21)
WORDS = ["alpha", "Beta!", "gamma", "d|e", "12", "twice twice", "w" * 40, "é", "ß,", "...", "\n", "x_y"]


def text(n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "  ", " ! ", "\t"]) for _ in range(n))


def buffer(*texts):
    return text_buffer(pa.array(texts))


@pytest.mark.parametrize("table", [ALNUM, NOT_SPACE])
@pytest.mark.parametrize("limit", [1, 7, 100, 10_000])
def test_stretches_cut_no_word(table, limit):
    data, offsets = buffer("before", text(300) + "z" * 9000 + " end", "after")
    a, z = int(offsets[1]), int(offsets[2])
    parts = [*stretches(data, a, z, table, limit)]
    assert parts[0][0] == a and parts[-1][1] == z and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    got = np.concatenate([words(data, np.array(p), table).number for p in parts])
    assert np.array_equal(got, words(data, offsets[1:3], table).number)


@pytest.mark.parametrize("limit", [1, 9, 64, 1000, 1 << 20])
def test_scores_of_stretches(limit):
    data, offsets = buffer(text(900))
    g = np.random.default_rng(5)
    n = quality._TABLE.shape[1] + 6
    model = quality.Model(0.3, g.normal(size=(quality.BUCKETS, 1 + quality.RANK)), g.normal(size=(n, 1 + quality.RANK)), np.zeros(n), np.ones(n))
    assert np.allclose(quality.long_logit(model, data, 0, int(offsets[1]), limit), quality.logits(model, quality.features(data, offsets)))
    t = toxicity
    tables = [g.normal(size=(t.BUCKETS, t.DIM)) for _ in range(2)]
    tables[0][0] = tables[1][0] = 0
    filters = [g.normal(size=(k, t.DIM, t.FILTERS)) for k in t.WIDTHS]
    langs = g.normal(size=(t.BUCKETS, 3))
    langs[0] = 0
    m = t.Model(*tables, filters, g.normal(size=len(t.WIDTHS) * t.FILTERS), g.normal(size=len(t.WIDTHS) * t.FILTERS), 0.1, langs, np.array([1.0, 2.0, 3.0]))
    scorer = t.Scorer(m)
    for some in (text(400), "one", "one two", " . ", "a " * 50 + ". " * 500 + "b c " * 20):
        data, offsets = buffer(some)
        assert np.allclose(scorer.long_logit(data, 0, int(offsets[1]), limit), scorer.logits(t.features(data, offsets)), atol=1e-4)


@pytest.mark.parametrize("limit", [1, 30, 500])
def test_language_of_stretches(limit):
    some = text(200) + "　" + "Σίσυφος ΟΔΟΣ " * 5
    parts = [*language.text_stretches(some, limit)]
    assert "".join(parts) == some
    pieces = language.Pieces(sorted({"a", "al", "pha", "b", "e", "g", "m", "▁", "▁a", "w", "ww", "σ", "ς"}))
    probability = np.random.default_rng(2).dirichlet(np.ones(pieces.count + 1), 2).T
    score = lambda w: language.word_scores(w.spell(), pieces, probability)
    whole = language.text_scores(language.DistinctWords([some]), score, 2)
    assert np.allclose(sum(language.text_scores(language.DistinctWords([p]), score, 2) for p in parts), whole)
