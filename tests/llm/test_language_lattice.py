"""Piece lattices of language ID against a plain sum over all segmentations."""

import math

import numpy as np
import pytest

from roadtrace.llm import langid

PIECES = ["▁", "▁international", "inter", "national", "▁a", "a", "b", "ab", "bab", "abababababababab", "n", "t", "e", "r", "i", "o", "l"]


def plain(word, prob, pieces):
    """log probability by one exact pass over the whole word."""
    index, text = {p: i for i, p in enumerate(pieces)}, "▁" + word
    from fractions import Fraction

    alpha = [Fraction(1)] + [Fraction(0)] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            k = index.get(text[i:j], len(pieces) + 1 if j == i + 1 else None)
            if k is not None:
                alpha[j] += alpha[i] * Fraction(prob[k])
    x = alpha[-1]
    return math.log(x.numerator) - math.log(x.denominator)


def model():
    rng = np.random.default_rng(3)
    prob = rng.random((len(PIECES) + 2, 2))
    prob[len(PIECES)] = 0
    return {"langs": ["x", "y"], "pieces": PIECES, "prob": prob / prob.sum(axis=0), "prior": np.log([0.5, 0.5])}


@pytest.mark.parametrize("word", ["international", "ab", "ba" * 8, "ab" * 30, "ab" * 200 + "z", "a" * 23, "a" * 24, "a" * 47, "a" * 48, "zq" * 60])
def test_score_is_the_sum_over_all_segmentations_of_the_whole_run(word):
    m = model()
    logs, n = langid.Scorer(m).log_probs([word, "ab " + word])
    want = [plain(word, m["prob"][:, j], PIECES) for j in (0, 1)]
    short = [plain("ab", m["prob"][:, j], PIECES) for j in (0, 1)]
    assert n.tolist() == [1, 2]
    assert logs[0] == pytest.approx(want, rel=1e-5) and logs[1] == pytest.approx(np.add(want, short), rel=1e-5)


def test_expected_counts_are_the_gradient_of_the_score():
    m = model()
    lattice, p = langid.Lattice(PIECES), m["prob"][:, :1]
    words = ["international", "ab" * 45, "b", "z" * 30, "a" * 24]
    text = "".join(words)
    codes, ends = np.array([ord(c) for c in text], np.uint32), np.cumsum([len(w) for w in words])
    starts, weight = ends - [len(w) for w in words], np.array([1.0, 2.0, 3.0, 0.5, 1.5])
    got = lattice.expected(codes, starts, ends, p, weight)
    for k in range(len(PIECES) + 2):
        if k != len(PIECES):
            up, down = p.copy(), p.copy()
            up[k] *= 1 + 1e-5
            down[k] *= 1 - 1e-5
            slope = (lattice.score(codes, starts, ends, up) - lattice.score(codes, starts, ends, down))[:, 0] / 2e-5
            assert got[k] == pytest.approx(float((slope * weight).sum()), rel=1e-4, abs=1e-6)


def test_all_usable_pieces_are_used_and_words_are_whole():
    pieces = langid._pieces(langid.vocabulary_path())
    assert len(pieces) == 22240 and max(map(len, pieces)) == 16
    _, starts, ends, bounds = langid.letter_words(["k" * 5000 + " ab", None])
    assert (ends - starts).tolist() == [5000, 2] and bounds.tolist() == [0, 2, 2]


def test_groups_of_like_length_hold_every_word_once():
    n = np.random.default_rng(1).integers(1, 3000, 500)
    groups = list(langid.like_lengths(n, 100, 10_000))
    assert sorted(np.concatenate(groups).tolist()) == list(range(500))
    assert all(len(g) <= 100 and (len(g) == 1 or len(g) * n[g].max() <= 10_000) for g in groups)
