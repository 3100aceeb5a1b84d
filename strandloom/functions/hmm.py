"""Hidden Markov models over ordered observations: Viterbi, scaled forward / backward, posteriors, sampling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Model:
    """States with start and transition probabilities and discrete emissions (states x symbols)."""

    start: np.ndarray
    transition: np.ndarray
    emission: np.ndarray

    def likelihoods(self, obs: Sequence[int]) -> np.ndarray:
        return self.emission[:, np.asarray(obs, dtype=int)].T


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def viterbi(start: np.ndarray, transition: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Most likely states for observation likelihoods (length x states)."""
    n = len(like)
    if not n:
        return np.zeros(0, dtype=int)
    lt, ll = _log(transition), _log(like)
    score = _log(start) + ll[0]
    back = np.zeros((n, len(start)), dtype=int)
    for t in range(1, n):
        all_ = score[:, None] + lt
        back[t] = all_.argmax(0)
        score = all_.max(0) + ll[t]
    path = np.zeros(n, dtype=int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def forward(start: np.ndarray, transition: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and the scaling factors."""
    n = len(like)
    f, c = np.zeros((n, len(start))), np.zeros(n)
    for t in range(n):
        f[t] = (start if t == 0 else f[t - 1] @ transition) * like[t]
        c[t] = max(f[t].sum(), 1e-300)
        f[t] /= c[t]
    return f, c


def backward(transition: np.ndarray, like: np.ndarray, c: np.ndarray) -> np.ndarray:
    n = len(like)
    b = np.ones((n, transition.shape[0]))
    for t in range(n - 2, -1, -1):
        b[t] = transition @ (like[t + 1] * b[t + 1]) / c[t + 1]
    return b


def posterior(start: np.ndarray, transition: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, float]:
    """State probabilities at every place, and the log likelihood."""
    if not len(like):
        return np.zeros((0, len(start))), 0.0
    f, c = forward(start, transition, like)
    g = f * backward(transition, like, c)
    return g / g.sum(1, keepdims=True), float(np.log(c).sum())


def sample_path(model: Model, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """States and symbols drawn from the model."""
    rng = np.random.default_rng(seed)
    states, symbols = np.zeros(n, dtype=int), np.zeros(n, dtype=int)
    for t in range(n):
        p = model.start if t == 0 else model.transition[states[t - 1]]
        states[t] = rng.choice(len(p), p=p)
        symbols[t] = rng.choice(model.emission.shape[1], p=model.emission[states[t]])
    return states, symbols


def decode(obs: Column, model: Model) -> Column:
    """array<int> of Viterbi states for an array<int> of symbols; null for null."""
    start, tr, em = model.start, model.transition, model.emission

    @F.pandas_udf("array<int>")
    def run(o: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else viterbi(start, tr, em[:, np.asarray(x, dtype=int)].T).astype("int32") for x in o])

    return run(obs)


def posteriors(obs: Column, model: Model, state: int) -> Column:
    """array<double>: probability of ``state`` at every place."""
    start, tr, em = model.start, model.transition, model.emission

    @F.pandas_udf("array<double>")
    def run(o: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else posterior(start, tr, em[:, np.asarray(x, dtype=int)].T)[0][:, state] for x in o])

    return run(obs)


def log_likelihood(obs: Column, model: Model) -> Column:
    start, tr, em = model.start, model.transition, model.emission

    @F.pandas_udf("double")
    def run(o: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else posterior(start, tr, em[:, np.asarray(x, dtype=int)].T)[1] for x in o])

    return run(obs)
