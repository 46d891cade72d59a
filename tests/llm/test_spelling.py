"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from marlstone.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, Root string"


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def expected(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n}


def documents():
    rng = random.Random(8)
    letters = "abcdeéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 12))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "ababa", "bababa"]

    def word():
        w = rng.choice(base[: rng.choice([3, 20, 66])])
        if rng.random() < 0.5:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
        return w.upper() if rng.random() < 0.1 else w

    rows = [(1, None), (2, ""), (3, "12 34 !!"), (None, "nothing nothing nothing"), (4, "z" * 3000 + " " + "z" * 3001 + " ž" + "q" * 6)]
    rows += [(i, " ".join(word() + rng.choice([" ", ", ", "1", "ž", "-"]) for _ in range(120))) for i in range(5, 60)]
    return rows + [(4, rows[4][1]), (4, rows[4][1]), (9, rows[9][1])]


@pytest.mark.parametrize("piece", [spelling.PIECE, 3])
def test_variants_against_all_pairs(spark, piece):
    rows = documents()
    df = spark.createDataFrame([(i, t, "w", "1", "r") for i, t in rows], SCHEMA).repartition(4)
    got = spelling.spelling_variants(df, piece)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = expected(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] and r[1] != r[2] for r in got)  # some chains are longer than one


def test_numbers_are_perfect():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    automaton = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = automaton.follow(automaton.start, 0, w, 0)
        assert automaton.final[state] and number == k
    assert len(automaton.edges) < len({w[:i] for w in words for i in range(len(w) + 1)})  # ends are shared
    backward = spelling.Automaton(sorted(w[::-1] for w in words))
    for w in words:
        got = {words[i] for i in automaton.one_error(w, len(w) // 2)}
        assert got == {v for v in words if near(w, v) and v[: len(w) // 2] == w[: len(w) // 2]}
        k = len(w) - len(w) // 2
        got = {backward.words[i][::-1] for i in backward.one_error(w[::-1], k)}
        assert got == {v for v in words if near(w, v) and v.endswith(w[len(w) - k :])}


def test_stretches_change_nothing():
    text = ("Größe naïve wörter and Others, ÿÿÿÿÿÿ " * 50 + "x" * 4000 + "é") * 2
    whole = Counter()
    for w, n in spelling.counted(7, text.encode()):
        whole[w] += n
    for size in (1, 10, 333):
        parts = Counter()
        for w, n in spelling.counted(7, text.encode(), size):
            parts[w] += n
        assert parts == whole


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
