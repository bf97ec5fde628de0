"""Likelihood kernels against enumeration and their own invariants."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.functions import kernels as K


def brute(fam, own, tables, joint=None):
    """Likelihood and distributions of one site by all genotype combinations."""
    n, g = own.shape
    total, post = 0.0, np.zeros((n, g))
    for x in itertools.product(range(g), repeat=n):
        p = np.prod([own[i, x[i]] for i in range(n)])
        for c in range(n):
            if fam.father[c] >= 0:
                p *= tables[c][x[c], x[fam.father[c]], x[fam.mother[c]]]
        if joint is not None:
            (f, m), = fam.couples
            p *= joint[x[f], x[m]]
        total += p
        for i in range(n):
            post[i, x[i]] += p
    return np.log10(total), post / total


NUCLEAR = K.Family([1, 2, 3, 4], [-1, -1, 0, 0], [-1, -1, 1, 1], [1, 2, 1, 2])
THREE = K.Family([0, 1, 3, 6, 2, 5, 7], [-1, -1, -1, -1, 0, 2, 3], [-1, -1, -1, -1, 1, 4, 5], [1, 2, 1, 1, 2, 2, 1])
HALF_SIBS = K.Family([0, 1, 2, 3, 4], [-1, -1, -1, 0, 0], [-1, -1, -1, 1, 2], [1, 2, 2, 1, 2])


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([NUCLEAR, THREE, HALF_SIBS]), st.sampled_from(["autosome", "X", "MT"]))
def test_peeling_is_enumeration(seed, fam, klass):
    rng = np.random.default_rng(seed)
    own = rng.random((3, len(fam.ids), 3))
    tables = {c: K.trio_table(klass, fam.sex[c]) for c in range(len(fam.ids)) if fam.father[c] >= 0}
    for i in fam.founders:
        own[:, i] *= K.founder_prior(np.full(3, 0.6), klass, fam.sex[i])
    llk, post = K.peel(fam, own, tables)
    for s in range(3):
        want, dist = brute(fam, own[s], tables)
        assert llk[s] == pytest.approx(want)
        assert post[s] == pytest.approx(dist)
    assert np.allclose(post.sum(axis=2), 1)


def test_lone_couple_prior():
    own = np.random.default_rng(1).random((2, 4, 3))
    tables = {2: K.trio_table(), 3: K.trio_table()}
    llk, post = K.peel(NUCLEAR, own, tables, K.COUPLE_PRIOR)
    want, dist = brute(NUCLEAR, own[0], tables, K.COUPLE_PRIOR)
    assert llk[0] == pytest.approx(want) and post[0] == pytest.approx(dist)


def test_ten_genotypes_without_mutation_agree_with_three():
    rng = np.random.default_rng(2)
    lk = rng.random((4, 4, 3))
    at = [K.INDEX10[0, 0], K.INDEX10[0, 2], K.INDEX10[2, 2]]
    own3, own10 = lk.copy(), np.zeros((4, 4, 10))
    own10[:, :, at] = lk
    prior = K.founder_prior(np.full(4, 0.3))
    own3[:, :2] *= prior[:, None]
    own10[:, :2] *= np.eye(10)[at].T @ prior[0]
    a, _ = K.peel(NUCLEAR, own3, {2: K.trio_table(), 3: K.trio_table()})
    b, _ = K.peel(NUCLEAR, own10, {c: K.denovo_trio_table(0.0, 2.0) for c in (2, 3)})
    assert a == pytest.approx(b)


def test_tables_sum_to_one():
    assert K.trio_table().sum(axis=0) == pytest.approx(1)
    assert K.trio_table10().sum(axis=0) == pytest.approx(1)
    assert K.mutation_matrix10(1e-3, 2.0).sum(axis=1) == pytest.approx(1)
    assert K.denovo_trio_table(1e-3, 2.0).sum(axis=0) == pytest.approx(1)


def test_loops_and_half_known_parents_are_errors():
    with pytest.raises(ValueError, match="loop"):
        K.Family([0, 1, 2, 3, 4, 5], [-1, -1, 0, 0, 2, 2], [-1, -1, 1, 1, 3, 3], [1, 2, 1, 2, 1, 1])
    with pytest.raises(ValueError, match="one known parent"):
        K.Family([0, 1], [-1, 0], [-1, -1], [1, 2])


def test_large_family_does_not_underflow():
    n = 400
    fam = K.Family(list(range(n)), [-1, -1] + [0] * (n - 2), [-1, -1] + [1] * (n - 2), [1, 2] + [1] * (n - 2))
    own = np.full((1, n, 3), 1e-5)
    llk, post = K.peel(fam, own, {c: K.trio_table() for c in range(2, n)})
    assert np.isfinite(llk).all() and np.isfinite(post).all()


@settings(max_examples=20, deadline=None)
@given(st.floats(0.01, 0.98))
def test_maximum_is_found(peak):
    f, v = K.bounded_maximum(lambda x: -((x - peak) ** 2), 5)
    assert abs(f - peak).max() < 2e-4 and (v <= 0).all()


def test_tails():
    assert K.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert K.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert K.chi2_tail(0.5, 4) == pytest.approx(0.9735009788, abs=1e-9)
    assert K.normal_quantile(np.array([0.5, 0.975])) == pytest.approx([0, 1.959963985], abs=1e-8)


def test_tails_of_t_and_f():
    from math import gamma, pi

    for df, t in ((1, 1.0), (3, 2.5), (10, 0.3), (40, 4.0)):
        x = np.linspace(0, t, 200_001)
        pdf = gamma((df + 1) / 2) / ((df * pi) ** 0.5 * gamma(df / 2)) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert K.t_tail(t, df) == pytest.approx(1 - 2 * np.trapezoid(pdf, x), abs=1e-8) and K.t_tail(-t, df) == K.t_tail(t, df)
    for a, b, f in ((4, 12, 3.0), (2, 5, 0.4), (30, 7, 1.8)):
        x = np.linspace(0, f, 400_001)[1:]
        pdf = gamma((a + b) / 2) / (gamma(a / 2) * gamma(b / 2)) * (a / b) ** (a / 2) * x ** (a / 2 - 1) * (1 + a * x / b) ** (-(a + b) / 2)
        assert K.f_tail(f, a, b) == pytest.approx(1 - np.trapezoid(pdf, x), abs=1e-5)
    assert K.f_tail(0, 3, 4) == 1 and K.t_tail(0.0, 5) == pytest.approx(1)


@pytest.mark.parametrize("klass", ["autosome", "X", "Y", "MT"])
def test_frequency_from_expected_counts(klass):
    """The same maximum as a grid and golden sections, clear data, doubtful data and data with two maxima, in few evaluations."""
    from kinfold.jobs.calling import Model, Options
    from kinfold.sources.fixtures import PEDIGREE12, PEDIGREE_EXT

    rng = np.random.default_rng(7)
    for people in (PEDIGREE12, PEDIGREE_EXT):
        model = Model(list(people), klass, Options())
        kinds = rng.integers(0, 3, (200, model.n))
        clear = 10.0 ** -(rng.integers(40, 200, (200, model.n, 3)) / 10 * (np.arange(3) != kinds[:, :, None]))
        lk = np.concatenate([clear, rng.random((100, model.n, 3)), np.tile([1.0, 1e-9, 1.0], (5, model.n, 1)), np.ones((2, model.n, 3))])
        calls = np.zeros(len(lk))

        def evaluate(f, rows):
            calls[rows] += 1
            return model.expected(lk[rows], f)

        f, v = K.frequency_maximum(evaluate, lambda x, rows: model.llk(lk[rows], x)[0], len(lk))
        want_f, want = K.bounded_maximum(lambda x: model.llk(lk, x)[0], len(lk))
        assert (v > want - 2e-5).mean() > 0.99 and (v > want - 0.02).all()  # a little off the top, or the lower of two tops
        sharp = np.abs(want - model.llk(lk, np.clip(want_f + 2e-3, K.LOW, K.HIGH))[0]) > 1e-4
        assert np.abs(f - want_f)[sharp & (np.abs(v - want) < 1e-6)].max(initial=0) < 3e-4
        assert np.median(calls[:200]) < 8


def test_normal_quantile():
    from statistics import NormalDist

    p = np.concatenate([np.linspace(0.001, 0.999, 999), 10.0 ** -np.arange(3, 300, 7), 1 - 10.0 ** -np.arange(3, 16), [0.075, 0.925]])
    assert np.allclose(K.normal_quantile(p), [NormalDist().inv_cdf(x) for x in p], rtol=1e-13, atol=1e-15)
    assert np.isnan(K.normal_quantile(np.array([0.0, 1.0, -1.0, np.nan]))).all()
