"""Cohorts wider than a row against calls with everybody in one."""

import pytest
from pyspark.sql import functions as F

from kinfold.jobs import calling, wide
from kinfold.sources import fixtures as X


def test_same_as_call_variants(spark, sf):
    """The twelve persons, all six configurations, and autosomes, X, Y and MT."""
    obs = X.gl_obs(spark, sf)
    o = calling.Options(cutoff=0.5, all_sites=True)
    want = {(r.chrom, r.pos): r for r in calling.call_variants(obs, list(X.PEDIGREE12), o).collect()}
    sites, persons = wide.call_wide_cohort(obs, X.pedigree(spark), o)
    got = {(r.chrom, r.pos): r for r in sites.collect()}
    assert set(got) == set(want) and len({k[0] for k in got}) == 6
    genotypes = {}
    for r in persons.collect():
        genotypes.setdefault((r.chrom, r.pos), {})[r.pid] = r
    for k, w in want.items():
        g = got[k]
        assert (g.ref_base, g.a1, g.a2, g.config, g.n_samples, g.depth) == (w.ref_base, w.a1, w.a2, w.config, w.n_samples, w.depth)
        assert g.ref_freq == pytest.approx(w.ref_freq, abs=2e-4) and g.posterior == pytest.approx(w.posterior, abs=1e-3)
        assert g.map_quality == pytest.approx(w.map_quality)
        for pid, p in genotypes[k].items():
            assert p.dosage == pytest.approx(w.dosage[pid], abs=2e-3)
        if len(genotypes[k]) == 12:
            assert g.ab == pytest.approx(w.ab, abs=1e-3)


def test_only_variant_sites(spark, sf):
    obs = X.gl_obs(spark, sf)
    o = calling.Options(cutoff=0.9, min_depth=120)
    sites, _ = wide.call_wide_cohort(obs, X.pedigree(spark), o)
    want = calling.call_variants(obs, list(X.PEDIGREE12), o)
    assert {(r.chrom, r.pos) for r in sites.collect()} == {(r.chrom, r.pos) for r in want.collect()}


def test_doubtful_data_and_the_grid(spark):
    """Likelihoods that tell next to nothing, and ones with two maxima, end on a greatest point all the same."""
    pl = [[0, 40, 40, 40, 40, 40, 40, 0, 40, 40], [3, 0, 2, 4, 1, 5, 2, 0, 3, 1], [0] * 10]
    rows = [("1", 10 * s, p, 1 + s % 4, 5, 40, pl[(s + p * (s > 4)) % 3]) for s in range(1, 9) for p in range(12)]
    obs = spark.createDataFrame(rows, "chrom string, pos int, sample_id int, ref_base int, depth int, map_qual int, pl array<int>").withColumn("pl", F.col("pl").cast("array<smallint>"))
    o = calling.Options(all_sites=True)
    want = {r.pos: r for r in calling.call_variants(obs, list(X.PEDIGREE12), o).collect()}
    got = wide.call_wide_cohort(obs, X.pedigree(spark), o)[0].collect()
    assert {r.pos for r in got} == set(want)
    for r in got:
        assert r.posterior == pytest.approx(want[r.pos].posterior, abs=1e-3)


def test_no_row_is_wider_than_a_family(spark, sf):
    rows = wide.family_rows(X.gl_obs(spark, sf), X.pedigree(spark))
    assert rows.agg(F.max(F.size("pl"))).first()[0] == 40
    assert rows.groupBy("chrom", "pos", "famid").count().where("count > 1").isEmpty()


def test_joins_move_the_brackets_alone(spark, sf):
    from kinfold.functions.lineage import bucketed

    rows = bucketed(wide.family_rows(X.gl_obs(spark, sf), X.pedigree(spark)), *wide.KEYS)
    asked = wide.sites(rows, 12, calling.Options()).select("chrom", "pos", "ref_base", F.lit(1).alias("config"), F.array(F.lit(0.5)).alias("x"))
    from kinfold.functions.lineage import written

    plan = wide.answers(rows, written(asked), 1, calling.Options())._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("ShuffledHashJoin") :]
    left = above[: above.index("Bucketed: true")] if "Bucketed: true" in above else above
    assert "Bucketed: true" in above and "Exchange" not in left.split("FileScan")[0]


def test_empty_and_one_family(spark, sf):
    obs = X.gl_obs(spark, sf)
    sites, persons = wide.call_wide_cohort(obs.limit(0), X.pedigree(spark))
    assert (sites.count(), persons.count()) == (0, 0)
    with pytest.raises(ValueError, match="one family"):
        wide.call_wide_cohort(obs, X.pedigree(spark, X.PEDIGREE12[:4]))
