"""The order of shingles comes from all texts, whatever their hashes and however they lie in partitions."""

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import simhash


def test_every_text_is_counted(spark):
    rows = [f"w{i % 37} a b c d e{i % 5} f g" for i in range(60)] + ["", None, "a few"]
    want = np.zeros(simhash.SLOTS, dtype=np.int64)
    for text in rows:
        for h in simhash.shingle_hashes(text):
            want[h & (simhash.SLOTS - 1)] += 1
    texts = spark.createDataFrame([(t,) for t in rows], "text string").select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), "text")
    for n in (1, 7):  # counts of one stay counts of one in every partition
        got = simhash.common_slots(texts.repartition(n))
        assert (got == np.unique(want, return_inverse=True)[1]).all()
    assert (simhash.common_slots(texts.limit(0)) == 0).all()
