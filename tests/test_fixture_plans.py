"""What the derived tables cost: nothing of a site is computed for each row of lineitem, and both engines still agree."""

import duckdb

from kinfold.sources import binary as B
from kinfold.sources import fixtures as X


def test_filters_on_records_stay_above_the_sums(spark, sf):
    plan = B.plink_markers(X.vcf_rows(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "length" in plan and "length" not in plan.rsplit("Aggregate", 1)[1]


def test_likelihoods_as_in_sql(spark, sf):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    names = ["site", "sample_id", "depth", "map_qual", "a1", "a2", "pl"]
    want = con.execute(f"{X.WITH_OBS} select {', '.join(names)} from obs").fetchall()
    got = [tuple(r) for r in X.observations(spark, sf).select(*names).collect()]
    assert sorted(got) == sorted((*r[:-1], list(r[-1])) for r in want)
