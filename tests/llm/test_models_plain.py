"""Chains and risks against plain versions: every labelling of a chain, and the risk written out."""

import itertools

import numpy as np
import pytest

from vegaflow.llm import main_text, toxicity
from vegaflow.llm.crf import forward_backward, viterbi


@pytest.mark.parametrize("seed", range(4))
def test_marginals_and_transitions_by_enumeration(seed):
    """Chains of several lengths side by side; every labelling is weighed."""
    rng = np.random.default_rng(seed)
    k, lengths = 3, [5, 1, 4, 2]
    scores, trans = rng.normal(scale=2, size=(len(lengths), 5, k)), rng.normal(size=(k, k))
    mask = np.arange(5) < np.array(lengths)[:, None]
    marginal, moved = forward_backward(scores, mask, trans, pairs=True)
    want_moved = np.zeros((k, k))
    for c, n in enumerate(lengths):
        weight, want = 0.0, np.zeros((n, k))
        pairs = np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            p = np.exp(sum(scores[c, t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            weight += p
            want[np.arange(n), list(path)] += p
            for a, b in itertools.pairwise(path):
                pairs[a, b] += p
        assert np.allclose(marginal[c, :n], want / weight)
        want_moved += pairs / weight
    assert np.allclose(moved, want_moved)


@pytest.mark.parametrize("seed", range(4))
def test_best_paths_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    scores, trans = rng.integers(-3, 4, (6, 2)).astype(float), rng.integers(-2, 3, (2, 2)).astype(float)
    value = lambda path: sum(scores[t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
    assert value(viterbi(scores, trans)) == max(map(value, itertools.product(range(2), repeat=6)))


def test_a_page_is_decoded_to_its_best_labelling():
    model = main_text.fit([main_text.featured(x) for x in main_text.built_pages(60)], rounds=20)
    blocks = main_text.blocks_of("<nav><li>Home<li>News</nav><article><h1>A title here</h1><p>Some text that runs on for a while, and ends.<p>And more of it follows.</article><footer><p>Imprint</footer>")
    score = np.array([sum((model.weights[model.index[x]] for x in f if x in model.index), np.zeros(2)) for f in main_text.features_of(blocks)])
    value = lambda path: sum(score[t, y] for t, y in enumerate(path)) + sum(model.transition[a, b] for a, b in itertools.pairwise(path))
    best = max(map(value, itertools.product(range(2), repeat=len(blocks))))
    assert abs(value(model.states(blocks)) - best) < 1e-9


def risk(w, b, pos, unl, prior):
    """Non-negative risk, written out: positives as positive, and unlabelled less positives as negative but never under zero."""
    z = lambda x: x @ w + b
    loss = lambda v: np.log1p(np.exp(-np.abs(v))) + np.maximum(-v, 0)
    return prior * loss(z(pos)).mean() + max(0.0, loss(-z(unl)).mean() - prior * loss(-z(pos)).mean())


def test_the_fit_lowers_the_written_out_risk():
    """On two overlapping groups the model's risk is under that of the start and of every small change of it that plain search finds, by a margin."""
    rng = np.random.default_rng(1)
    prior, d = 0.2, 6
    pos = (rng.random((300, d)) < [0.7, 0.6, 0.5, 0.1, 0.1, 0.1]).astype("f4")
    neg = (rng.random((1600, d)) < [0.1, 0.1, 0.2, 0.3, 0.4, 0.2]).astype("f4")
    unl = np.vstack([neg, (rng.random((400, d)) < [0.7, 0.6, 0.5, 0.1, 0.1, 0.1]).astype("f4")])
    w, b = toxicity.fit_nnpu(pos, unl, prior)
    found = risk(w, b, pos, unl, prior)
    assert found < 0.7 * risk(np.zeros(d), -1.0, pos, unl, prior)
    assert all(found <= risk(w + rng.normal(scale=0.3, size=d), b + rng.normal(scale=0.3), pos, unl, prior) + 0.01 for _ in range(300))
    said, clean = (1 / (1 + np.exp(-(x @ w + b))) for x in (pos, neg))
    assert (said > 0.5).mean() > 0.6 and (clean < 0.5).mean() > 0.9
