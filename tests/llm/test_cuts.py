"""Tables that cut a lineage belong to the run that wrote them."""

import os

from kinfold.llm import pipeline, queries
from kinfold.llm.common import cut, cuts, shared_folder


def tables(spark):
    at = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_a_run_deletes_its_own_tables_alone(spark):
    before = tables(spark)
    outside = cut(spark.range(5).toDF("x"))
    own = tables(spark) - before
    with cuts(spark):
        inside = cut(spark.range(7).toDF("x"))
        with cuts(spark):
            cut(spark.range(9).toDF("x"))
        assert len(tables(spark) - before) == 2 and inside.count() == 7
        late = cut(spark.range(3).toDF("x"))
        assert late.count() == 3
    assert tables(spark) - before == own and outside.count() == 5


def test_lazy_results_survive_a_pipeline(spark, sf):
    lazy = queries.op9_secrets(spark, sf)
    done = pipeline.run(spark, sf, [s for s in pipeline.STAGES if s[0] == "line_dedup"])
    assert lazy.count() == 200 and 0 < done.count() <= 200
