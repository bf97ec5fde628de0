"""Records are refined from slices of Arrow batches: nothing beyond a slice is unpacked, and results don't depend on the slices."""

from dataclasses import replace

import pytest

from kinfold.jobs import calling as C
from kinfold.sources import fixtures as X


def test_slices_give_the_same_records(spark, sf):
    names, people, o = [str(i) for i in range(12)], list(X.PEDIGREE12), C.Options()
    vcf = X.vcf_rows(spark, sf).limit(90).persist()
    once = C.refine_vcf(vcf, names, people, o)
    assert "MapInArrow" in once._jdf.queryExecution().executedPlan().toString()
    want = {(r.chrom, r.pos): r for r in once.collect()}
    got = {(r.chrom, r.pos): r for r in C.refine_vcf(vcf, names, people, replace(o, batch=7)).collect()}
    assert set(got) == set(want) and len(want) > 50
    for k, w in want.items():
        g = got[k]
        assert (g.id, g.ref, g.alt, g.gt, g.gq, g.ac, g.dp, g.tag, g.likelihoods) == (w.id, w.ref, w.alt, w.gt, w.gq, w.ac, w.dp, w.tag, w.likelihoods)
        assert g.ref_freq == pytest.approx(w.ref_freq, abs=1e-9) and g.qual == pytest.approx(w.qual, abs=1e-6)
    vcf.unpersist()
