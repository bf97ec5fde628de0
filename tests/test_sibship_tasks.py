"""Sibships are gathered in tasks of a bounded number of rows."""

from kinfold.jobs import registry
from kinfold.operators import markers as M


def test_tasks_grow_in_number_with_the_children(spark, sf, monkeypatch):
    ped, geno = registry.big_pedigree(spark, sf), registry.big_genotypes(spark, sf)
    x = registry.big_x_genotypes(spark, sf)
    want = [sorted(map(tuple, d.collect())) for d in (M.sibship_errors(geno, ped), M.mendel_errors_x_sibships(x, ped))]
    assert want[0]
    children = geno.join(ped.where("fatid >= 0"), ["famid", "pid"]).count()
    monkeypatch.setattr(M, "CHILDREN_A_TASK", 40)
    for d, rows in zip((M.sibship_errors(geno, ped), M.mendel_errors_x_sibships(x, ped)), want, strict=True):
        assert sorted(map(tuple, d.collect())) == rows
    assert M.sibship_errors(geno, ped).rdd.getNumPartitions() >= children // 40


def test_no_sets_are_gathered_before_the_shuffle(spark, sf):
    ped, geno = registry.big_pedigree(spark, sf), registry.big_genotypes(spark, sf)
    plan = M.sibship_errors(geno, ped)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan[plan.index("Exchange") :]
