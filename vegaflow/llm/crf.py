"""Inference for linear-chain conditional random fields, over many chains at once."""

from __future__ import annotations

import numpy as np


def forward_backward(scores: np.ndarray, mask: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals (chains, steps, labels) and, if asked, expected transitions summed over all chains."""
    n, steps, k = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    emit[~mask] = 1.0
    move = np.exp(transition - transition.max())
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    a = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    ahead[:, 0] = a
    for t in range(1, steps):
        step = (a @ move) * emit[:, t]
        step /= step.sum(axis=1, keepdims=True)
        a = np.where(mask[:, t, None], step, a)
        ahead[:, t] = a
    b = np.ones((n, k))
    behind[:, -1] = b
    for t in range(steps - 2, -1, -1):
        step = (b * emit[:, t + 1]) @ move.T
        step /= step.sum(axis=1, keepdims=True)
        b = np.where(mask[:, t + 1, None], step, b)
        behind[:, t] = b
    marginal = ahead * behind
    marginal /= marginal.sum(axis=2, keepdims=True)
    if not pairs:
        return marginal, None
    both = ahead[:, :-1, :, None] * move[None, None] * (behind[:, 1:] * emit[:, 1:])[:, :, None, :]
    both /= both.sum(axis=(2, 3), keepdims=True)
    return marginal, (both * mask[:, 1:, None, None]).sum(axis=(0, 1))


def viterbi(scores: np.ndarray, transition: np.ndarray) -> list[int]:
    """The best states of one chain with (steps, labels) scores; ties go to the lower state."""
    best, back = scores[0], []
    for t in range(1, len(scores)):
        ways = best[:, None] + transition
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + scores[t]
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]
