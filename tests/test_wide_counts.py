"""Likelihoods of families as polynomials of the frequency, and rounds of a wide cohort's search without Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.lineage import written
from kinfold.jobs import calling, wide
from kinfold.sources import fixtures as X

FAMILIES = {
    "couple": [("f", 0, -1, -1, 1), ("f", 1, -1, -1, 2), ("f", 2, 0, 1, 2), ("f", 3, 0, 1, 1)],
    "generations": [r for r in X.PEDIGREE_EXT if r[0] == "G"],
    "two parts and a lone woman": [("f", 0, -1, -1, 1), ("f", 1, -1, -1, 2), ("f", 2, 0, 1, 2), ("f", 3, -1, -1, 2), ("f", 4, -1, -1, 1), ("f", 5, -1, -1, 2), ("f", 6, 4, 5, 1)],
}


@pytest.mark.parametrize("klass", ["autosome", "X", "Y", "MT"])
@pytest.mark.parametrize("name", FAMILIES)
def test_polynomials_are_the_peeled_likelihoods(name, klass):
    people, rng = FAMILIES[name], np.random.default_rng(3)
    model = calling.Model(people, klass, calling.Options(), always_optimise=True)
    lk = 10.0 ** -rng.uniform(0, 25, (50, len(people), 3))
    scale, c = model.allele_counts(lk)
    k = len(c) - 1
    assert k == model.copies.sum() and (c >= 0).all()
    for f in (1e-4, 0.03, 0.5, 0.9999):
        terms = c * np.array([[f**j * (1 - f) ** (k - j)] for j in range(k + 1)])
        want, share = model.expected(lk, np.full(50, f))
        assert scale + np.log10(terms.sum(axis=0)) == pytest.approx(want, abs=1e-9)
        if k:
            assert np.arange(k + 1) @ terms / terms.sum(axis=0) / k == pytest.approx(share, abs=1e-9)


def _asked(spark, sf):
    rows = written(wide.family_rows(X.gl_obs(spark, sf), X.pedigree(spark)))
    site = written(wide.sites(rows, 12, calling.Options()))
    return rows, site, site.select("chrom", "pos", "ref_base", F.explode(F.array(F.lit(1), F.lit(4))).alias("config"), F.array(F.lit(0.2), F.lit(0.9999)).alias("x"))


@pytest.mark.parametrize("most", [32, 2])
def test_rounds_answer_as_the_kernels_do(spark, sf, monkeypatch, most):
    """At most 2 alleles: couples are computed at each point, and their sums meet those of the polynomials."""
    monkeypatch.setattr(wide, "MOST_ALLELES", most)
    rows, site, asked = _asked(spark, sf)
    got = wide.Cohort(rows, site, (1, 4), calling.Options()).answered(asked, 2)
    assert ("MapInPandas" in got._jdf.queryExecution().executedPlan().toString()) == (most == 2)
    got = {r[:2] + (r.config,): r for r in got.collect()}
    want = wide.answers(rows, asked, 2, calling.Options()).collect()
    assert len(got) == len(want) > 0
    for w in want:
        g = got[w[:2] + (w.config,)]
        assert g.ref_base > 0
        for c in ("l0", "l1", "e0", "e1"):
            assert g[c] == (None if w[c] is None else pytest.approx(w[c], abs=1e-9))
