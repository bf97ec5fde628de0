"""Calls at a fixed frequency for any nuclear pedigree, against the kernels."""

import numpy as np
import pytest

from kinfold.functions import kernels as K
from kinfold.jobs import fixed
from kinfold.jobs.calling import Model, Options, _likelihoods
from kinfold.sources import fixtures as X

OTHER = [("A", 0, -1, -1, 1), ("A", 1, -1, -1, 2), *[("A", p, 0, 1, 1) for p in (2, 3, 4, 5, 6)], ("B", 7, -1, -1, 1), ("B", 8, -1, -1, 2), ("B", 9, 7, 8, 2), ("C", 10, -1, -1, 1)]


def test_families_of_other_sizes(spark, sf):
    obs = X.observations(spark, sf).where("chrom = '1'")
    got = {(r.site, r.sample_id): r for r in fixed.family_calls(obs, X.pedigree(spark, OTHER)).collect()}
    model = Model(OTHER, "autosome", Options(), always_optimise=True)
    sites = {}
    for r in obs.collect():
        sites.setdefault((r.site, r.ref_base, r.alt_base), {})[r.sample_id] = r.pl
    assert len(got) == len(sites) * len(OTHER)
    for (site, ref, alt), have in sites.items():
        pl = np.array([[have.get(p, [0] * 10) for p in range(11)]])
        _, post = model.llk(_likelihoods(pl, np.array([ref]), np.array([alt])), np.array([fixed.FREQ]), marginals=True)
        for p in range(11):
            assert got[site, p].dosage == pytest.approx(post[0, p, 1] + 2 * post[0, p, 2], abs=2e-6)
            assert abs(got[site, p].gq - K.genotype_quality(np.round(post[0, p].max(), 9))) <= 1


def test_only_nuclear_families(spark):
    with pytest.raises(ValueError, match="not nuclear"):
        fixed.units(list(X.PEDIGREE_EXT))
    assert fixed.units(list(X.PEDIGREE12[:5])) == [("F1", (0, 1, 2, 3)), ("F2", (4,))]


def test_wide_frequencies_are_the_best_of_the_grid(spark, sf):
    """Families summed by Spark against all persons in one model."""
    from kinfold.jobs import calling
    from kinfold.jobs.registry import GRID

    obs = X.gl_obs(spark, sf).where("chrom = '1'")
    model = Model(list(X.PEDIGREE12), "autosome", Options(), always_optimise=True)
    sites = {}
    for r in obs.collect():
        sites.setdefault(r.pos, (r.ref_base, {}))[1][r.sample_id] = r.pl
    got = {r.pos: r for r in calling.wide_cohort_frequencies(obs, list(X.PEDIGREE12), GRID).collect()}
    assert set(got) == set(sites)
    for pos, (ref, have) in sites.items():
        pl = np.array([[have.get(p, [0] * 10) for p in range(12)]])
        lk = _likelihoods(pl, np.array([ref]), np.array([(3, 4, 1, 2)[ref - 1]]))
        llk = np.array([model.llk(lk, np.array([f]))[0][0] for f in GRID])
        assert got[pos].llk == pytest.approx(llk.max(), abs=1e-5) and llk.max() - llk[GRID.index(got[pos].ref_freq)] < 1e-6


def test_inverse_normal_of_mid_ranks(spark, sf):
    from statistics import NormalDist

    from kinfold.operators import markers as M

    rows = X.traits(spark, sf).collect()
    by = {}
    for r in rows:
        if r.value is not None:
            by.setdefault(r.trait, []).append(r.value)
    for r in M.inverse_normal(X.traits(spark, sf)).collect():
        if r.value is None:
            assert r.z is None
            continue
        v = by[r.trait]
        rank = sum(x < r.value for x in v) + (sum(x == r.value for x in v) - 1) / 2
        assert r.z == pytest.approx(NormalDist().inv_cdf((rank + 0.5) / len(v)), abs=1e-9)
