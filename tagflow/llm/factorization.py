"""A second-order factorization machine with logistic loss, in numpy.

z = bias + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2), over a document's terms i. The
second part is the sum over all pairs of terms of the inner product of their factors, in time
proportional to the terms.

``start`` fits weights and vectors of all terms of a sample together, under a penalty for each that
holds back what chance gives among so many (the lasso for weights, the group lasso for vectors), by
proximal Adam. Terms that end with neither have no part in z. ``fit`` then fits the rest without it.
"""

from __future__ import annotations

import numpy as np

#: Terms whose factors are in memory at once.
BLOCK = 250_000


class FactorizationMachine:
    def __init__(self, buckets: int, factors: int = 8, seed: int = 7):
        self.bias = 0.0
        self.linear = np.zeros(buckets, dtype=np.float64)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (buckets, factors))

    @staticmethod
    def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of the rows of each document; ends: where each one's rows end."""
        total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
        return total[ends] - total[np.concatenate(([0], ends[:-1]))]

    def raw(self, terms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """z of each document, and the sums of its factors. terms: the known buckets, one document after another."""
        z, sums = np.empty(len(ends)), np.empty((len(ends), self.factors.shape[1]))
        at = 0
        while at < len(ends):  # runs of documents with about BLOCK terms, one at least
            begin = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
            some, own = terms[begin:int(ends[end - 1])], ends[at:end] - begin
            v = self.factors[some]
            sums[at:end] = self._sums(v, own)
            pairs = 0.5 * ((sums[at:end] ** 2).sum(axis=1) - self._sums((v ** 2).sum(axis=1), own))
            z[at:end] = self.bias + self._sums(self.linear[some], own) + pairs
            at = end
        return z, sums

    def scores(self, terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(terms, ends)[0], -40, 40)))

    def start(self, terms: np.ndarray, ends: np.ndarray, labels: np.ndarray, rounds: int = 100, rate: float = 0.05,
              factor_rate: float = 0.02, lasso: float = 0.5, emphasis: float = 3.0) -> np.ndarray:
        """Weights and vectors by proximal steps; the buckets that have one. Every bucket must stand in some document.

        The penalty of a bucket is the size that its gradient has by chance, if labels don't depend on its
        documents, times half of what the largest of so many chance values reaches for a weight, sqrt(2 log p), and times the
        bound of Laurent and Massart for a vector, whose chance gradient varies as the documents' sums do. Sums of
        factors are taken from their mean over the documents (the weights make up for it), so that a vector
        doesn't follow what its term does alone. A vector's penalty grows to its size over the first 12 rounds, in which
        the partners of a pair find each other. Buckets at zero are looked at again every tenth round."""
        n, (buckets, k) = len(labels), self.factors.shape
        v, w, centre = self.factors.T.copy(), self.linear, np.zeros(k)
        many = np.bincount(terms, minlength=buckets)
        order = np.argsort(terms, kind="stable").astype(np.int32)
        # the documents of each bucket, one bucket after another
        docs = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.concatenate(([0], ends))))[order]
        del order
        stop = np.cumsum(many)
        weight = np.where(labels == 1, emphasis / n, 1 / n)
        rate_1 = float((weight * labels).sum() / weight.sum())
        self.bias = float(np.log(rate_1 / (1 - rate_1)))
        chance, log_p = (weight * (rate_1 - labels)) ** 2, np.log(max(buckets, 2))

        def blocks(some: np.ndarray):
            """Runs of buckets with about BLOCK documents: places in some, the documents, and where each bucket begins."""
            total = np.cumsum(many[some])
            at = 0
            while at < len(some):
                begin = int(total[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(total, begin + BLOCK, side="right")))
                own = some[at:end]
                if own[-1] - own[0] == len(own) - 1:
                    there = docs[stop[own[0]] - many[own[0]]:stop[own[-1]]]
                else:
                    there = np.concatenate([docs[stop[b] - many[b]:stop[b]] for b in own])
                yield slice(at, end), there, total[at:end] - many[own] - begin
                at = end

        every = np.arange(buckets)
        penalty = np.empty(buckets)
        for part, there, begins in blocks(every):
            penalty[part] = lasso * np.sqrt(2 * log_p * np.add.reduceat(chance[there], begins))
        bias_state, w_state, v_state, seen = [0.0, 0.0], np.zeros((2, buckets)), [np.zeros((k, buckets)), np.zeros(buckets), np.zeros(buckets)], np.zeros(buckets)
        for step in range(1, rounds + 1):
            slower = 1 - (step - 1) / rounds
            active = np.flatnonzero((w != 0) | (v != 0).any(axis=0))
            sums, z = np.zeros((k, n)), np.full(n, self.bias)
            alone = w - 0.5 * (v ** 2).sum(axis=0)
            for part, there, _ in blocks(active):
                at = np.repeat(active[part], many[active[part]])
                z += np.bincount(there, alone[at], n)
                for f in range(k):
                    sums[f] += np.bincount(there, v[f][at], n)
            centre = sums.mean(axis=1)
            sums -= centre[:, None]
            z += 0.5 * (sums ** 2).sum(axis=0)
            wrong = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
            spread = chance * (sums ** 2).sum(axis=0)
            shares = np.linalg.eigvalsh((sums * chance) @ sums.T) / max(spread.sum(), 1e-300)
            chance_factor = np.sqrt(1 + 2 * np.sqrt(log_p * (shares ** 2).sum()) + 2 * log_p * shares.max())
            some = active if step > 15 and step % 10 and len(active) else every
            linear, factors, by_chance = np.empty(len(some)), np.empty((k, len(some))), np.empty(len(some))
            for part, there, begins in blocks(some):
                linear[part] = np.add.reduceat(wrong[there], begins)
                by_chance[part] = min(step / 12, 1) * chance_factor * np.sqrt(np.add.reduceat(spread[there], begins))
                for f in range(k):
                    factors[f, part] = np.add.reduceat((wrong * sums[f])[there], begins)
            factors += -linear * v[:, some] + 1e-3 * v[:, some]
            linear += 1e-3 * w[some]
            seen[some] += 1
            first, second = 1 - 0.9 ** seen[some], 1 - 0.999 ** seen[some]
            g = wrong.sum()
            bias_state = [0.9 * bias_state[0] + 0.1 * g, 0.999 * bias_state[1] + 0.001 * g * g]
            self.bias -= float(slower * rate * bias_state[0] / (1 - 0.9 ** step) / (np.sqrt(bias_state[1] / (1 - 0.999 ** step)) + 1e-8))
            w_state[0, some] = 0.9 * w_state[0, some] + 0.1 * linear
            w_state[1, some] = 0.999 * w_state[1, some] + 0.001 * linear ** 2
            size = slower * rate / (np.sqrt(np.maximum(w_state[1, some] / second, penalty[some] ** 2)) + 1e-12)
            moved = w[some] - size * w_state[0, some] / first
            w[some] = np.sign(moved) * np.maximum(np.abs(moved) - size * penalty[some], 0)
            v_state[0][:, some] = 0.9 * v_state[0][:, some] + 0.1 * factors
            v_state[1][some] = 0.9 * v_state[1][some] + 0.1 * (factors ** 2).mean(axis=0)
            v_state[2][some] = 0.9 * v_state[2][some] + 0.1 * by_chance  # it lags as the gradient does
            size = slower * factor_rate / (np.sqrt(v_state[1][some] / first) + 1e-12)
            moved = v[:, some] - size * v_state[0][:, some] / first
            length = np.sqrt((moved ** 2).sum(axis=0))
            v[:, some] = moved * np.maximum(0, 1 - size * v_state[2][some] / first / np.maximum(length, 1e-30))
        kept = np.flatnonzero((w != 0) | (v != 0).any(axis=0))
        # z without the centre: it goes into the weights and the bias
        self.linear, self.bias, self.factors = w - centre @ v, self.bias + 0.5 * float(centre @ centre), v.T.copy()
        return kept

    def only(self, kept: np.ndarray, seed: int = 7) -> FactorizationMachine:
        """The machine of the kept buckets; those without a vector start with a small one."""
        small = FactorizationMachine(max(len(kept), 1), self.factors.shape[1], seed)
        small.bias, small.linear[:len(kept)] = self.bias, self.linear[kept]
        has = (self.factors[kept] != 0).any(axis=1)
        small.factors[:len(kept)][has] = self.factors[kept][has]
        return small

    def fit(self, terms: np.ndarray, ends: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.05,
            linear_decay: float = 1e-3, factor_decay: float = 1e-2, emphasis: float = 3.0) -> FactorizationMachine:
        """Adam on the whole sample; a document of class 1 weighs as much as ``emphasis`` others."""
        n, (buckets, k) = len(labels), self.factors.shape
        doc = np.repeat(np.arange(n), np.diff(np.concatenate(([0], ends))))
        weight = np.where(labels == 1, emphasis / n, 1 / n)
        used = np.unique(terms)
        place = np.searchsorted(used, terms)
        state = {name: [0.0, 0.0] for name in ("bias", "linear", "factors")}

        def moved(name: str, gradient, step: int):
            m, s = state[name]
            m, s = 0.9 * m + 0.1 * gradient, 0.999 * s + 0.001 * gradient ** 2
            state[name] = [m, s]
            return rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)

        for step in range(1, rounds + 1):
            z, sums = self.raw(terms, ends)
            wrong = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
            each = wrong[doc]
            linear = np.bincount(place, weights=each, minlength=len(used))
            factors = np.empty((len(used), k))
            for f in range(k):
                factors[:, f] = np.bincount(place, weights=each * sums[doc, f], minlength=len(used)) - linear * self.factors[used, f]
            self.bias -= float(moved("bias", wrong.sum(), step))
            self.linear[used] -= moved("linear", linear + linear_decay * self.linear[used], step)
            self.factors[used] -= moved("factors", factors + factor_decay * self.factors[used], step)
        unused = np.ones(buckets, dtype=bool)
        unused[used] = False
        self.factors[unused] = 0
        return self
