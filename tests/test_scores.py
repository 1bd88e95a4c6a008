"""Scores of many spectra at once against one spectrum at a time, and lines of one price in an order's tree."""

import math

import numpy as np
import pyarrow as pa
import pytest

from ionloom.functions.elements import NUM_ELEMENTS
from ionloom.operators import scores


@pytest.fixture
def spectra(monkeypatch):
    """Precursors and lists of fragments, odd ones among them, and few pairs at a time."""
    monkeypatch.setattr(scores, "PAIRS", 40)
    r = np.random.default_rng(3)
    make = lambda high: [int(n) for n in r.integers(0, high, NUM_ELEMENTS) * (np.arange(NUM_ELEMENTS) % 5 == 2)]
    p = [make(9) for _ in range(60)] + [None, make(4), [0] * NUM_ELEMENTS, make(3)]
    f = [[make(5) for _ in range(n % 7)] + [make(2)] * (n % 3) for n in range(60)] + [[make(3)], None, [make(3)], []]
    return p, f


def table(p, f):
    kind = pa.list_(pa.int32())
    return scores._rows(pa.array(p, kind), pa.array(f, pa.list_(kind)))


@pytest.mark.parametrize("metric", ["l1", "l2", "cosine"])
def test_trees_together(spectra, metric):
    def one(a, rows):
        if a is None or rows is None or not sum(a):
            return 0.0
        nodes, total = [a, *rows], 0.0
        for u in nodes:
            best = math.inf
            for v in nodes:
                if all(i <= j for i, j in zip(u, v)) and u != v:
                    x, y = (np.array(w) / sum(a) for w in (u, v))
                    norms = np.linalg.norm(x) * np.linalg.norm(y)
                    best = min(best, {"l1": np.abs(x - y).sum(), "l2": np.linalg.norm(x - y), "cosine": 1 - x @ y / norms if norms else 1.0}[metric])
            p = best / {"l1": 2.0, "l2": math.sqrt(2), "cosine": 2.0}[metric]
            if 1e-12 < p < math.inf:
                p = min(p, 1 - 1e-12)
                total -= p * math.log(p) * sum(u) / sum(a)
        return total

    want = [one(a, rows) for a, rows in zip(*spectra)]
    assert max(want) > 0.1
    np.testing.assert_allclose(scores._tree_scores(*table(*spectra), metric), want, atol=1e-9)


def test_coverage_together(spectra):
    def one(a, rows, key, points=70):
        dims = [i for i, n in enumerate(a or []) if n > 0]
        if not rows or not dims:
            return 0.0
        x = np.array(sorted({tuple(r[i] for i in dims) for r in rows})) / np.array([a[i] for i in dims])
        at = ((2 + key) * scores.KEY_STEP + np.arange(1, points + 1)[:, None] * scores._steps(len(dims))) % 1
        return 100 * np.log1p(0.5 * np.exp(-((at[:, None] - x[None]) ** 2).sum(2) / (2 * 0.2**2)).sum(1)).mean()

    keys = np.arange(64) * 37
    want = [one(*row) for row in zip(*spectra, keys.tolist())]
    np.testing.assert_allclose(scores._coverage_scores(*table(*spectra), keys, 0.2, 0.5, 70, 2), want, atol=1e-9)
