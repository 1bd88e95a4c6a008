"""How much a spectrum's formulas tell about the precursor's."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.elements import NUM_ELEMENTS


#: Pairs of nodes, and of points and fragments, that are held against each other at once.
PAIRS = 500_000


def _formulas(a: pa.Array) -> np.ndarray:
    """(formulas, 15) counts of a list array without nulls."""
    size = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    if (size != NUM_ELEMENTS).any():
        raise ValueError(f"a formula has {NUM_ELEMENTS} counts")
    return _counts(a.flatten()).reshape(-1, NUM_ELEMENTS)


def _counts(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype(float)


def _rows(p: pa.Array, f: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(precursor of each row, row of each fragment, fragment); a row that lacks either has zeros and no fragments."""
    known = pc.and_(p.is_valid(), f.is_valid()).to_numpy(zero_copy_only=False)
    parents = np.zeros((len(p), NUM_ELEMENTS))
    if known.any():
        parents[known] = _formulas(p.filter(pa.array(known)))
    size = np.where(known, pc.fill_null(pc.list_value_length(f), 0).to_numpy(zero_copy_only=False), 0)
    return parents, np.repeat(np.arange(len(p)), size), _formulas(f.filter(pa.array(known)).flatten())


def _slices(weights: np.ndarray) -> Iterator[slice]:
    """Neighbouring items whose weights sum to PAIRS or that are one."""
    end = np.cumsum(weights)
    at = 0
    while at < len(weights):
        stop = max(at + 1, int(np.searchsorted(end, PAIRS + (end[at - 1] if at else 0), "right")))
        yield slice(at, stop)
        at = stop


def _tree_scores(parents: np.ndarray, of: np.ndarray, fragments: np.ndarray, metric: str) -> np.ndarray:
    cap = {"l1": 2.0, "l2": math.sqrt(2.0), "cosine": 2.0}[metric]
    rows = len(parents)
    atoms = parents.sum(1)
    some = np.flatnonzero(atoms > 0)
    row = np.concatenate((some, of[atoms[of] > 0]))
    order = np.argsort(row, kind="stable")
    row, nodes = row[order], np.concatenate((parents[some], fragments[atoms[of] > 0]))[order]
    nodes = nodes[:, nodes.any(0)]
    x = nodes / atoms[row][:, None]
    norm = np.sqrt((x * x).sum(1))
    size = np.bincount(row, minlength=rows)
    start = (np.cumsum(size) - size)[row]
    n = size[row]
    p = np.empty(len(row))
    for part in _slices(n):
        first = np.cumsum(n[part]) - n[part]
        a = np.repeat(np.arange(part.start, part.stop), n[part])
        b = np.arange(len(a)) + np.repeat(start[part] - first, n[part])
        above, less, d = np.ones(len(a), bool), np.zeros(len(a), bool), np.zeros(len(a))
        for e in range(nodes.shape[1]):
            u, v = nodes[a, e], nodes[b, e]
            above &= u <= v
            less |= u < v
            if metric == "cosine":
                d += x[a, e] * x[b, e]
            else:
                gap = np.abs(x[a, e] - x[b, e])
                d += gap if metric == "l1" else gap * gap
        if metric == "cosine":
            norms = norm[a] * norm[b]
            d = np.where(norms > 0, 1 - d / np.where(norms > 0, norms, 1), 1.0)
        elif metric == "l2":
            d = np.sqrt(d)
        p[part] = np.minimum.reduceat(np.where(above & less, d, np.inf), first) / cap
    some = np.isfinite(p) & (p > 1e-12)
    p = np.minimum(p[some], 1 - 1e-12)
    score = np.bincount(row[some], -p * np.log(p) * x[some].sum(1), rows)
    return np.where(np.isfinite(score), score, 0.0)


def tree_score(precursor: Column, fragments: Column, metric: str = "l2") -> Column:
    """Sum of -P ln P times node mass over the precursor and fragments, P a node's least distance to a formula that
    strictly contains it, over the metric's largest value; 0 for null and non-finite results. Pairs of nodes of all
    spectra of an Arrow batch are compared together, PAIRS at a time."""

    @F.arrow_udf("double")
    def run(p: pa.Array, f: pa.Array) -> pa.Array:
        return pa.array(_tree_scores(*_rows(p, f), metric))

    return run(precursor.cast("array<int>"), fragments.cast("array<array<int>>"))


def _steps(d: int) -> np.ndarray:
    """Steps of the d-dimensional additive sequence of lowest known discrepancy: powers of 1/g, g the root of x**(d+1) = x + 1."""
    g = 2.0
    for _ in range(200):
        g = (1 + g) ** (1 / (d + 1))
    return (1 / g) ** np.arange(1, d + 1) % 1


#: Fractions of it set the sequences of different keys apart.
KEY_STEP = 0.6180339887498949


def _coverage_scores(parents: np.ndarray, of: np.ndarray, fragments: np.ndarray, keys: np.ndarray, bandwidth: float, alpha: float, num_points: int, seed: int) -> np.ndarray:
    out = np.zeros(len(parents))
    kinds, kind = np.unique(parents > 0, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    for k, has in enumerate(kinds):
        own = kind[of] == k
        dims = np.flatnonzero(has)
        if not len(dims) or not own.any():
            continue
        # the distinct fragments of each row
        row, counts = of[own], fragments[own][:, dims]
        order = np.lexsort((*counts.T, row))
        row, counts = row[order], counts[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (counts[1:] != counts[:-1]).any(1)))
        row, x = row[new], counts[new] / parents[row[new]][:, dims]
        ids, first, size = np.unique(row, return_index=True, return_counts=True)
        if np.isnan(keys[ids]).any():
            raise ValueError("a key is null")
        base = (seed + keys[ids].astype(np.int64)) * KEY_STEP
        steps = np.arange(1, num_points + 1)[:, None] * _steps(len(dims))
        for part in _slices(size * num_points):
            lo, hi = first[part.start], first[part.stop - 1] + size[part.stop - 1]
            near = np.zeros((part.stop - part.start, num_points))
            step = max(1, PAIRS // num_points)
            for at in range(lo, hi, step):  # a row of more fragments than that is gone through in pieces
                to = min(at + step, hi)
                spectrum = np.searchsorted(first[part], np.arange(at, to), "right") - 1
                d2 = np.zeros((to - at, num_points))
                for d in range(len(dims)):
                    points = (base[part][:, None] + steps[None, :, d]) % 1
                    gap = points[spectrum] - x[at:to, d, None]
                    d2 += gap * gap
                starts = np.flatnonzero(np.concatenate(([True], spectrum[1:] != spectrum[:-1])))
                near[spectrum[starts]] += np.add.reduceat(np.exp(-d2 / (2 * bandwidth**2)), starts, axis=0)
            out[ids[part]] = 100 * np.log1p(alpha * near).mean(1)
    return out


def coverage_score(precursor: Column, fragments: Column, key: Column, bandwidth: float = 0.12, alpha: float = 1.0, num_points: int = 2048, seed: int = 0) -> Column:
    """100 times the mean over points x of log1p(alpha * sum_j exp(-|x - f_j|^2 / 2 h^2)), f_j the distinct fragments over
    the precursor in the elements that it has. No fragments: 0.

    The points x_i = frac((seed + key) * KEY_STEP + i * step), i from 1, are an additive sequence that key (a whole
    number) shifts: they follow from seed and key, not from a row's place, and any engine can write them.
    """

    @F.arrow_udf("double")
    def run(p: pa.Array, f: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array(_coverage_scores(*_rows(p, f), k.to_numpy(zero_copy_only=False), bandwidth, alpha, num_points, seed))

    return run(precursor.cast("array<int>"), fragments.cast("array<array<int>>"), key.cast("long"))
