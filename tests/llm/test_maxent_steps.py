"""The language model's inner steps against plain sums."""

import numpy as np
import pytest

from kinfold.llm import maxent


def _some(seed: int = 5):
    rng = np.random.default_rng(seed)
    names = [maxent.END, *(f"w{i}" for i in range(300))]
    vocab = maxent.Vocabulary(names, rng.integers(1, 1_000_000_000, len(names)), 10**11, len(names), np.zeros(maxent.TAIL_CLASSES))
    ids = np.where(rng.random(900) < 0.8, rng.integers(0, len(names), 900), -1 - rng.integers(0, maxent.TAIL_CLASSES, 900))
    w = maxent.initial(vocab)
    for x in w.rows:
        x += rng.normal(size=x.shape).astype(np.float32)
    return vocab, w, maxent.Batch(ids, np.array([500, 400]), vocab)


def test_raised_scores_are_those_of_plain_sums_and_stay_finite():
    _, w, b = _some()
    for level in range(len(maxent.WIDTHS)):
        at = b.at(level)
        rows = b.rows(level, at, len(w.rows[level]))
        z, total = maxent._raised(w, b, level, at, rows)
        plain = w.bias[level][b.parent[level][at]].astype(float) + sum(w.rows[level][r].astype(float) for r in rows)
        want = np.exp(plain - plain.max(axis=1, keepdims=True))
        assert z / total[:, None] == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-5)
        w.rows[level][rows[0, 0]] = 1e6
        assert all(np.isfinite(x).all() for x in maxent._raised(w, b, level, at, rows))


def test_a_step_adds_up_what_meets_in_a_row():
    _, w, b = _some()
    for level in range(len(maxent.WIDTHS)):
        t, rng = maxent.Trainer(w), np.random.default_rng(level)
        at = b.at(level)
        rows = b.rows(level, at, len(w.rows[level])) % 64
        grad = rng.normal(size=(len(at), maxent.WIDTHS[level])).astype(np.float32)
        t._step(level, rows, grad)
        sums = np.zeros_like(w.rows[level], dtype=float)
        for r in rows:
            np.add.at(sums, r, grad)
        step = maxent.RATE / np.sqrt(1 + (sums**2).mean(axis=1))
        assert t.w.rows[level] == pytest.approx(w.rows[level] - step[:, None] * sums, abs=1e-4)
        assert (t.touched[level] == np.bincount(rows.ravel(), minlength=len(sums))).all()
