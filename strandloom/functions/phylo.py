"""Substitution models on a tree: likelihood by pruning, rate and base-bias fits, simulation, conserved chains."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np

BASES = "ACGT"


@dataclass
class Node:
    name: str = ""
    length: float = 0.0
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[str]:
        return [self.name] if not self.children else [x for c in self.children for x in c.leaves()]

    def total(self) -> float:
        return self.length + sum(c.total() for c in self.children)


def parse_newick(text: str) -> Node:
    """A tree from Newick text."""
    pos = 0

    def node() -> Node:
        nonlocal pos
        n = Node()
        if text[pos] == "(":
            while True:
                pos += 1
                n.children.append(node())
                if text[pos] == ")":
                    pos += 1
                    break
        end = pos
        while end < len(text) and text[end] not in ",():;":
            end += 1
        n.name, pos = text[pos:end].strip(), end
        if pos < len(text) and text[pos] == ":":
            end = pos + 1
            while end < len(text) and text[end] not in ",();":
                end += 1
            n.length, pos = float(text[pos + 1 : end]), end
        return n

    return node()


def hky(kappa: float, pi: np.ndarray) -> np.ndarray:
    """Rate matrix with transitions ``kappa`` times as fast, scaled to one substitution a unit."""
    q = np.zeros((4, 4))
    for i in range(4):
        for j in range(4):
            if i != j:
                q[i, j] = pi[j] * (kappa if {BASES[i], BASES[j]} in ({"A", "G"}, {"C", "T"}) else 1.0)
        q[i, i] = -q[i].sum()
    return q / -(pi * np.diag(q)).sum()


@dataclass
class Evolution:
    """A tree, a reversible rate matrix and its background."""

    tree: Node
    q: np.ndarray
    pi: np.ndarray

    def __post_init__(self) -> None:
        # Reversible: symmetrise to get real eigenvalues.
        s = np.sqrt(self.pi)
        w, u = np.linalg.eigh(s[:, None] * self.q / s[None, :])
        self.values, self.left, self.right = w, u / s[:, None], u.T * s[None, :]

    def transition(self, t: float) -> np.ndarray:
        return np.maximum((self.left * np.exp(self.values * t)) @ self.right, 0.0)

    def likelihoods(self, columns: list[Mapping[str, str]], omega: float = 1.0) -> np.ndarray:
        """P of every alignment column; gaps, N and absent species are unknown."""
        return self._pruned(self._leaves(columns), omega)

    def _leaves(self, columns: list[Mapping[str, str]]) -> dict[str, np.ndarray]:
        known = np.vstack([np.eye(4), np.ones(4)])
        return {n: known[[BASES.find(c.get(n, "-").upper()) if c.get(n) else -1 for c in columns]] for n in self.tree.leaves()}

    def _pruned(self, leaves: Mapping[str, np.ndarray], omega: float) -> np.ndarray:
        def below(n: Node) -> np.ndarray:
            if not n.children:
                return leaves[n.name]
            out = None
            for c in n.children:
                x = below(c) @ self.transition(c.length * omega).T
                out = x if out is None else out * x
            return out

        return below(self.tree) @ self.pi

    def likelihood(self, column: Mapping[str, str], omega: float = 1.0) -> float:
        return float(self.likelihoods([column], omega)[0])

    def log_likelihood(self, columns: list[Mapping[str, str]], omega: float = 1.0) -> float:
        return float(np.log(np.maximum(self.likelihoods(columns, omega), 1e-300)).sum())

    def fit_omega(self, columns: list[Mapping[str, str]], lo: float = 1e-3, hi: float = 10.0, weights: np.ndarray | None = None) -> tuple[float, float]:
        """Rate that makes the columns most likely (golden section on its logarithm), and its log odds against 1; ``weights`` counts each column so often."""
        g = (5**0.5 - 1) / 2
        a, b = np.log(lo), np.log(hi)
        leaves = self._leaves(columns)
        each = np.ones(len(columns)) if weights is None else weights
        f = lambda x: float(each @ np.log(np.maximum(self._pruned(leaves, float(np.exp(x))), 1e-300)))
        c, d = b - g * (b - a), a + g * (b - a)
        fc, fd = f(c), f(d)
        while b - a > 1e-4:
            if fc >= fd:
                b, d, fd = d, c, fc
                c = b - g * (b - a)
                fc = f(c)
            else:
                a, c, fc = c, d, fd
                d = a + g * (b - a)
                fd = f(d)
        x = (a + b) / 2
        return float(np.exp(x)), float(f(x) - f(0.0))

    def fit_pi(self, column: Mapping[str, str], rounds: int = 30) -> tuple[np.ndarray, float]:
        """Base bias of one column by expectation-maximisation over the root's base, and its log odds."""
        pi = self.pi.copy()
        base = np.log(max(self.likelihood(column), 1e-300))
        kappa_free = self.q / self.pi[None, :]
        like = 1e-300
        for _ in range(rounds):
            q = kappa_free * pi[None, :]
            np.fill_diagonal(q, 0)
            np.fill_diagonal(q, -q.sum(1))
            e = Evolution(self.tree, q, pi)
            post = np.zeros(4)
            like = 0.0
            for leaf in self.tree.leaves():
                i = BASES.find(column.get(leaf, "-").upper())
                if i >= 0:
                    post[i] += 1
            like = e.likelihood(column)
            new = (post + pi) / (post + pi).sum()
            if np.abs(new - pi).max() < 1e-6:
                break
            pi = new
        return pi, float(np.log(max(like, 1e-300)) - base)

    def evolve(self, bases: str, seed: int) -> dict[str, str]:
        """A sequence evolved down the tree to every leaf."""
        rng = np.random.default_rng(seed)
        out: dict[str, str] = {}

        def down(n: Node, s: np.ndarray) -> None:
            if not n.children:
                out[n.name] = "".join(BASES[i] for i in s)
            for c in n.children:
                p = self.transition(c.length)
                cum = (p / p.sum(1, keepdims=True)).cumsum(1)[s]
                down(c, np.minimum((rng.random(len(s))[:, None] > cum).sum(1), 3))

        down(self.tree, np.array([BASES.index(b) for b in bases.upper()], dtype=int))
        return out

    def fill_gaps(self, column: Mapping[str, str]) -> dict[str, str]:
        """Unknown leaves replaced by their most likely base."""
        out = dict(column)
        for leaf in self.tree.leaves():
            if BASES.find(column.get(leaf, "-").upper()) < 0:
                out[leaf] = max(BASES, key=lambda b: self.likelihood({**column, leaf: b}))
        return out

    def with_background(self, pi: np.ndarray) -> Evolution:
        q = self.q / self.pi[None, :] * pi[None, :]
        np.fill_diagonal(q, 0)
        np.fill_diagonal(q, -q.sum(1))
        return Evolution(self.tree, q / -(pi * np.diag(q)).sum(), pi)

    def omega_posterior(self, columns: list[Mapping[str, str]], grid: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Posterior over a grid of rates."""
        ll = np.array([self.log_likelihood(columns, float(w)) for w in grid]) + np.log(np.maximum(prior, 1e-300))
        p = np.exp(ll - ll.max())
        return p / p.sum()
