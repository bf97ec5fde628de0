"""Prefix sums and merged ranges over keys that many tasks share."""

import itertools
import random

from pyspark.sql import functions as F

from kinfold.operators import markers as M
from kinfold.operators import ranges as R
from kinfold.operators import reads
from kinfold.operators.scans import prefix_sums


def test_prefix_sums_across_tasks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), i, rng.randrange(-3, 9) if i % 7 else None) for i in range(5_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for n in (1, 3, 16):
        got = {(r.k, r.i): r.s for r in prefix_sums(df, ["k"], ["i"], {"s": "v"}, n).collect()}
        want = {}
        for k in ("a", "b", "c", None):
            own = sorted((i, v or 0) for x, i, v in rows if x == k)
            want |= {(k, i): s for (i, _), s in zip(own, itertools.accumulate(v for _, v in own))}
        assert got == want
    assert prefix_sums(df.limit(0), ["k"], ["i"], {"s": "v"}).count() == 0


def test_one_section_in_many_tasks(spark):
    steps = spark.range(20_000).select(F.lit("s").alias("sample_id"), F.lit("1").alias("chrom"), F.col("id").alias("rec_no"), F.lit(3).alias("offset"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be one task's
    try:
        tasks = steps.repartitionByRange("sample_id", "chrom", "rec_no").select(F.spark_partition_id().alias("t")).distinct().count()
        got = reads.decode_positions(steps)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.where("pos <> 3 * (rec_no + 1)").count() == 0 and got.count() == 20_000
    assert tasks > 1


def test_marker_order_of_one_chromosome(spark):
    m = spark.range(3_000).select(F.lit("7").alias("chrom"), (F.col("id") % 50).cast("int").alias("pos"), F.col("id").alias("marker")).unionByName(spark.sql("select '9' as chrom, 1 as pos, 1L as marker"))
    got = {(r.chrom, r.marker): (r.ord, r.next_chrom) for r in M.ordered_markers(m).collect()}
    order = sorted(range(3_000), key=lambda i: (i % 50, i))
    assert got == {("7", i): (k + 1, "9") for k, i in enumerate(order)} | {("9", 1): (1, None)}


def merged(rows):
    out = {}
    for c, b, e in sorted(rows):
        if b >= e:
            continue
        own = out.setdefault(c, [])
        if own and b <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([b, e])
    return sorted((c, b, e) for c, own in out.items() for b, e in own)


def test_merged_ranges(spark):
    """Ranges over many slices, within one, touching, nested, empty, and slices without a start."""
    for seed in range(6):
        rng = random.Random(seed)
        rows = [(rng.choice("12"), b := rng.randrange(-50, 2_000), b + rng.choice([0, 1, 3, 10, 10, 40, 300 if seed % 2 else 5])) for _ in range(rng.choice([1, 40, 400]))]
        df = spark.createDataFrame(rows, "chrom string, beg int, end int")
        for width in (16, 64, 1 << 20):
            assert sorted(tuple(r) for r in R.merge_ranges(df, width).collect()) == merged(rows)
    assert R.merge_ranges(df.limit(0)).count() == 0


def test_no_task_holds_a_chromosome(spark):
    """Windows over ranges are parted by slice; those by chromosome alone see one row for each slice."""
    df = spark.range(1_000_000).selectExpr("'1' as chrom", "cast(id * 100 as int) as beg", "cast(id * 100 + 50 as int) as end")
    got = R.merge_ranges(df)
    assert got.count() == 1_000_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_slice" in line or "max(top" in line for line in windows)
