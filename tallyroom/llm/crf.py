"""Linear-chain conditional random field in numpy: exact marginals for many
sequences at once, and training by full-batch Adagrad.

The tokens of a batch of documents form one chain with resets where a document
starts. The chain is folded into about sqrt(n) segments that advance together:
one pass multiplies the transfer matrices of each segment, a short sequential
pass chains the segments, and a last pass fills in the messages. Work and
memory are linear in the tokens.
"""

from __future__ import annotations

import numpy as np


def _messages(step: np.ndarray, reset: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Normalised forward messages. ``step`` (n, s): emission factors; where
    ``reset`` is set the previous message is replaced by ``first``."""
    n, s = step.shape
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    pad = rows * width - n
    if pad:
        step = np.concatenate([step, np.ones((pad, s))])
        reset = np.concatenate([reset, np.ones(pad, bool)])
    # One contiguous slice per step of all segments.
    step = np.ascontiguousarray(step.reshape(rows, width, s).transpose(1, 0, 2))
    reset = np.ascontiguousarray(reset.reshape(rows, width).T)
    product = np.broadcast_to(np.eye(s), (rows, s, s)).copy()
    any_reset = reset.any(axis=1)
    for t in range(width):
        moved = (product.reshape(-1, s) @ move).reshape(rows, s, s)
        if any_reset[t]:
            hit = reset[t]
            moved[hit] = product[hit].sum(axis=2, keepdims=True) * first
        product = moved * step[t][:, None, :]
        if t % 8 == 7:  # factors are at least exp(-50), so eight of them stay in range
            product /= product.sum(axis=(1, 2), keepdims=True)
    entry = np.empty((rows, s))
    current = np.full(s, 1.0 / s)
    for k in range(rows):
        entry[k] = current
        current = current @ product[k]
        current = current / current.sum()
    out = np.empty((width, rows, s))
    current = entry
    for t in range(width):
        moved = current @ move
        if any_reset[t]:
            moved[reset[t]] = first
        current = moved * step[t]
        current /= current.sum(axis=1, keepdims=True)
        out[t] = current
    return out.transpose(1, 0, 2).reshape(-1, s)[:n]


def marginals(emission: np.ndarray, starts: np.ndarray, start: np.ndarray, transition: np.ndarray):
    """Posterior (n, s) of every token; also the pairwise factors for training.

    ``starts`` (n,) marks the first token of each document; ``emission``,
    ``start`` and ``transition`` are log scores.
    """
    n, s = emission.shape
    if n == 0:
        return np.zeros((0, s)), np.zeros((0, s)), np.zeros((0, s)), np.zeros((s, s))
    factor = np.exp(np.clip(emission - emission.max(axis=1, keepdims=True), -50, 0))
    move = np.exp(transition - transition.max())
    first = np.exp(start - start.max())
    forward = _messages(factor, starts, first, move)
    # Backward: the message that reaches a token from its right, as a forward
    # run over the reversed chain of "emission times message".
    ends = np.append(starts[1:], True)
    carried = _messages(factor[::-1], ends[::-1], np.ones(s), move.T)[::-1]
    both = forward * carried / factor
    return both / both.sum(axis=1, keepdims=True), forward, carried, move


#: Tokens whose messages are held at once while training.
PART = 50_000


def parts(starts: np.ndarray, size: int = PART) -> list[tuple[int, int]]:
    """Stretches of whole sequences with about ``size`` tokens each (a longer sequence is one)."""
    begins = np.flatnonzero(starts)
    edges, last = [0], 0
    for begin, end in zip(begins, [*begins[1:], len(starts)]):
        if end - last > size and begin > last:
            edges.append(int(begin))
            last = begin
    return list(zip(edges, [*edges[1:], len(starts)]))


def train(feature: np.ndarray, offset: np.ndarray, label: np.ndarray, starts: np.ndarray, size: int, states: int,
          rounds: int = 30, rate: float = 0.5, decay: float = 1e-4):
    """Weights (size, states), start and transition scores of the maximum
    penalised likelihood. ``feature``: hashed feature numbers of all tokens,
    token i owns ``feature[offset[i]:offset[i + 1]]`` (at least one). Memory is
    that of the weights and of PART tokens, however many tokens and states."""
    n = len(label)
    weight = np.zeros((size, states))
    start, transition = np.zeros(states), np.zeros((states, states))
    grown = np.full_like(weight, 1e-8)
    grown_start, grown_move = np.full(states, 1e-8), np.full((states, states), 1e-8)
    follows = ~starts[1:]
    seen = np.zeros((states, states))
    np.add.at(seen, (label[:-1][follows], label[1:][follows]), 1.0)
    gradient = np.zeros_like(weight)
    for _ in range(rounds):
        gradient[:] = 0
        expected, begun = np.zeros((states, states)), np.zeros(states)
        for a, b in parts(starts):
            own, first = feature[offset[a] : offset[b]], starts[a:b]
            emission = np.add.reduceat(weight[own], offset[a:b] - offset[a], axis=0)
            posterior, forward, carried, move = marginals(emission, first, start, transition)
            expected += pairs(forward, carried, move, first)
            residual = -posterior
            residual[np.arange(b - a), label[a:b]] += 1.0
            begun += residual[first].sum(axis=0)
            count = np.diff(offset[a : b + 1])
            for k in range(states):
                gradient[:, k] += np.bincount(own, np.repeat(residual[:, k], count), size)
        gradient /= n
        gradient -= decay * weight
        for value, slope, history in (
            (weight, gradient, grown), (start, begun / n, grown_start), (transition, (seen - expected) / n, grown_move),
        ):
            history += slope * slope
            value += rate * slope / np.sqrt(history)
    return weight.astype(np.float32), start, transition


def pairs(forward: np.ndarray, carried: np.ndarray, move: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Expected transitions (s, s) inside the sequences: the pairwise marginals summed,
    without holding those of each token."""
    inside = ~starts[1:]
    before, after = forward[:-1][inside], carried[1:][inside]
    total = ((before @ move) * after).sum(axis=1)
    return move * ((before / total[:, None]).T @ after)
