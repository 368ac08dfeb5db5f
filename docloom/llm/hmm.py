"""A hidden Markov model over class sequences: Baum-Welch counts and the scaled forward recursion, in numpy.

Sequences are handled side by side: sorted by length, so that those that still
run at a step are a leading block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    start: np.ndarray  # (states,)
    step: np.ndarray  # (states, states), rows sum to 1
    emit: np.ndarray  # (classes, states), columns sum to 1


@dataclass
class Counts:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def zero(cls, states: int, classes: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)))

    def model(self, share: np.ndarray, weight: float = 20.0) -> Model:
        """Smoothed by ``share``, the classes' shares of all tokens, so that every class keeps a probability."""
        start, step = self.start + 1.0, self.step + 1.0
        emit = self.emit + weight * share[:, None]
        return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _layout(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order from long to short, the classes by step and then sequence, and for each step its first entry and running number."""
    length = np.array([len(s) for s in sequences])
    order = np.argsort(-length, kind="stable")
    length = length[order]
    running = np.searchsorted(-length, -np.arange(length[0]), side="left")  # of step t: sequences longer than t
    first = np.concatenate([[0], np.cumsum(running)])
    flat = np.empty(first[-1], np.int64)
    for k, n in enumerate(order):
        flat[first[: length[k]] + k] = sequences[n]
    return order, flat, first, running


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each sequence, exactly: every step is rescaled and the scales are summed."""
    out = np.zeros(len(sequences))
    some = [n for n, s in enumerate(sequences) if len(s)]
    if not some:
        return out
    order, flat, first, running = _layout([sequences[n] for n in some])
    total, alpha = np.zeros(len(order)), None
    for t, n in enumerate(running):
        seen = model.emit[flat[first[t] : first[t] + n]]
        alpha = seen * model.start if alpha is None else (alpha[:n] @ model.step) * seen
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        total[:n] += np.log(scale)
    out[np.array(some)[order]] = total
    return out


def expect(model: Model, sequences: list[np.ndarray], counts: Counts) -> float:
    """Add the expected counts of the sequences, and return their log-likelihood."""
    sequences = [s for s in sequences if len(s)]
    if not sequences:
        return 0.0
    _, flat, first, running = _layout(sequences)
    states = len(model.start)
    # each step's arrays have a row for each state, so that numpy's inner loops run over the sequences
    start, step, emit = model.start.astype(np.float32)[:, None], model.step.astype(np.float32), np.ascontiguousarray(model.emit.T, np.float32)
    back = np.ascontiguousarray(step.T)
    alphas, weights, scales = [], [], []
    now = None
    for t, n in enumerate(running):
        seen = emit.take(flat[first[t] : first[t + 1]], 1)
        now = (start if now is None else back @ now[:, :n]) * seen
        total = now.sum(0)
        now /= total
        seen /= total
        alphas.append(now), weights.append(seen), scales.append(total)
    beta, pairs = None, np.zeros((states, states))
    for t in range(len(running) - 1, -1, -1):
        weight = weights[t]
        if beta is not None:
            weight[:, : running[t + 1]] *= beta
            alphas[t][:, : running[t + 1]] *= beta
        if t:
            beta = step @ weight
            pairs += alphas[t - 1][:, : running[t]] @ weight.T
    counts.step += pairs * step
    counts.start += alphas[0].sum(1)
    alpha = np.concatenate(alphas, axis=1)
    for s in range(states):
        counts.emit[:, s] += np.bincount(flat, alpha[s], minlength=len(counts.emit))
    return float(np.log(np.concatenate(scales)).sum())


def drawn(share: np.ndarray, states: int, seed: int = 5) -> Model:
    """Sticky states whose emissions are the classes' shares, randomly tilted: where training starts."""
    draw = np.random.default_rng(seed)
    emit = share[:, None] * draw.gamma(2.0, 0.5, (len(share), states)) + 1e-12
    return Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))


def first_guess(sequences: list[np.ndarray], share: np.ndarray, states: int, rounds: int, seed: int = 5) -> Model:
    """Rounds of Baum-Welch over sequences in memory, from ``drawn`` states."""
    model = drawn(share, states, seed)
    for _ in range(rounds):
        counts = Counts.zero(states, len(share))
        expect(model, sequences, counts)
        model = counts.model(share)
    return model
