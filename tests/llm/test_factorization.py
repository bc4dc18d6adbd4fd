"""The factorization machine's score against the sum over all pairs of terms."""

import numpy as np

from tagflow.llm import factorization


def test_score_is_the_sum_over_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    machine = factorization.FactorizationMachine(40, factors=5)
    machine.bias, machine.linear = 0.3, rng.normal(size=40)
    machine.factors = rng.normal(size=(40, 5))
    docs = [np.sort(rng.choice(40, size=n, replace=False)) for n in (0, 1, 2, 7, 30, 0, 12)]
    plain = [0.3 + machine.linear[d].sum() + sum(machine.factors[a] @ machine.factors[b] for n, a in enumerate(d) for b in d[n + 1:]) for d in docs]
    terms, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    for block in (factorization.BLOCK, 5):
        monkeypatch.setattr(factorization, "BLOCK", block)
        z, sums = machine.raw(terms, ends)
        assert np.allclose(z, plain) and np.allclose(sums, [machine.factors[d].sum(axis=0) for d in docs])
        assert np.allclose(machine.scores(terms, ends), 1 / (1 + np.exp(-np.array(plain))))
