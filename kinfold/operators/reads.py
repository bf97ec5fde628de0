"""Observations of samples brought together by site, their statistics, filters and counters.

The alignment is the one big shuffle of a run, by (chrom, pos): a key has at most as many rows as there are samples, so
no chromosome makes a partition hot. Chromosome and site-list filters belong before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.scalars import let
from kinfold.operators.scans import prefix_sums


def align_sites(obs: DataFrame, persons: list[int]) -> DataFrame:
    """chrom, pos, ref_base, pl array<array<smallint>>, depths array<int>, map_quals array<int>, in the order of persons;
    a person without a record has likelihood 1 everywhere, depth 0 and quality 0. The first sample in that order that
    has the site gives its reference base. Of repeated records of a sample the one with the greatest depth counts.

    Records carry their person's place, met by a hash join; with one empty record for each place added, sorting by place
    leaves one for everybody, so that the work is n log n in the samples of a site."""
    places = obs.sparkSession.createDataFrame([(p, i) for i, p in enumerate(persons)], f"sample_id {obs.schema['sample_id'].dataType.simpleString()}, _ord int")
    none = F.array_repeat(F.lit(0).cast("smallint"), 10)
    record = F.struct(F.col("_ord").alias("ord"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("map_qual", F.lit(0)).cast("int").alias("map_qual"), F.col("ref_base").cast("int").alias("ref_base"), F.coalesce(F.col("pl").cast("array<smallint>"), none).alias("pl"))
    empty = lambda i: F.struct(i.alias("ord"), F.lit(-1).alias("depth"), F.lit(0).alias("map_qual"), F.lit(None).cast("int").alias("ref_base"), none.alias("pl"))
    grouped = obs.join(F.broadcast(places), "sample_id").groupBy("chrom", "pos").agg(F.collect_list(record).alias("s"))
    full = F.sort_array(F.concat("s", F.transform(F.sequence(F.lit(0), F.lit(len(persons) - 1)), empty)))
    last = let(full, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["ord"] != x["ord"], F.lit(True))))
    rows = grouped.select("chrom", "pos", last.alias("s"))
    first = F.get(F.filter("s", lambda x: x["ref_base"].isNotNull()), F.lit(0))["ref_base"]
    return rows.select(
        "chrom", "pos", first.alias("ref_base"), F.transform("s", lambda x: x["pl"]).alias("pl"),
        F.transform("s", lambda x: F.greatest(x["depth"], F.lit(0))).alias("depths"), F.transform("s", lambda x: x["map_qual"]).alias("map_quals"),
    ).where("ref_base is not null")


def site_read_stats(obs: DataFrame, n_persons: int) -> DataFrame:
    """chrom, pos, ref_base, total_depth, ns (persons with reads), ps (their percentage), mq (mean quality of those), avg_depth;
    0 where nobody has reads."""
    has = F.col("depth") > 0
    g = obs.groupBy("chrom", "pos").agg(F.min(F.struct("sample_id", "ref_base"))["ref_base"].alias("ref_base"), F.sum("depth").alias("total_depth"), F.count(F.when(has, 1)).alias("ns"), F.sum(F.when(has, F.col("map_qual").cast("long")).otherwise(0)).alias("sum_mq"))
    safe = lambda x: F.when(F.col("ns") > 0, x / F.col("ns")).otherwise(F.lit(0.0))
    return g.select("chrom", "pos", F.col("ref_base").cast("int").alias("ref_base"), "total_depth", "ns", (F.col("ns") * 100.0 / n_persons).alias("ps"), safe(F.col("sum_mq")).alias("mq"), safe(F.col("total_depth")).alias("avg_depth"))


def drop_reason(ref: Column, depth: Column, ps: Column, mq: Column, o) -> Column:
    """The first test that a site fails, null if none: reference base, least and greatest depth, share of persons with
    reads, mapping quality."""
    out = F.when(~F.coalesce(ref.between(1, 4), F.lit(False)), F.lit("ref_base")).when(depth < o.min_depth, F.lit("min_depth"))
    if o.max_depth > 0:
        out = out.when(depth > o.max_depth, F.lit("max_depth"))
    return out.when(ps < o.min_percent_with_data, F.lit("coverage")).when(mq < o.min_map_quality, F.lit("map_quality"))


def site_filters(aligned: DataFrame, n_persons: int, o) -> DataFrame:
    """Aligned sites with n_samples, total_depth, map_quality and drop_reason."""
    total = F.aggregate("depths", F.lit(0).cast("long"), lambda a, d: a + d)
    ns = F.size(F.filter("depths", lambda d: d > 0))
    mq = F.aggregate(F.zip_with("depths", "map_quals", lambda d, q: F.when(d > 0, q).otherwise(0)), F.lit(0).cast("long"), lambda a, q: a + q)
    rows = aligned.select("*", total.alias("total_depth"), ns.alias("n_samples"), F.when(ns > 0, mq / ns).otherwise(F.lit(0.0)).alias("map_quality"))
    return rows.withColumn("drop_reason", drop_reason(F.col("ref_base"), F.col("total_depth"), F.col("n_samples") * 100.0 / n_persons, F.col("map_quality"), o))


def mono_llk(obs: DataFrame) -> DataFrame:
    """chrom, pos, mono_pl: the sum of the phred values of ref/ref, an integer; -mono_pl / 10 is the log10 likelihood of a
    monomorphic site. Grouped with partial sums before the shuffle."""
    same = ((F.col("ref_base") - 1) * (10 - F.col("ref_base")) / 2).cast("int")
    return obs.where("ref_base between 1 and 4").groupBy("chrom", "pos").agg(F.sum(F.get("pl", same).cast("long")).alias("mono_pl"))


def run_summary(sites: DataFrame) -> DataFrame:
    """Counters by chromosome of sites with ref_base, alt_base, drop_reason, and the total as chrom null."""
    kept = F.col("drop_reason").isNull()
    change = F.when(F.col("alt_base") == F.element_at(F.array(*[F.lit(x) for x in (3, 4, 1, 2)]), F.greatest(F.least("ref_base", F.lit(4)), F.lit(1))), "ts").otherwise("tv")
    count = lambda c: F.count(F.when(c, 1))
    return sites.rollup("chrom").agg(
        count(F.col("ref_base").between(1, 4)).alias("n_ref"), count(kept & (F.col("fpct") == 0)).alias("n_hom_ref"), count(kept & (F.col("fpct") > 0) & (change == "ts")).alias("n_ts"), count(kept & (F.col("fpct") > 0) & (change == "tv")).alias("n_tv"),
        *[count(F.col("drop_reason") == r).alias(f"drop_{r}") for r in ("ref_base", "min_depth", "max_depth", "coverage", "map_quality")], count(kept).alias("n_kept"),
    )


def family_grid_llk(obs: DataFrame, people: DataFrame, grid: list[float]) -> DataFrame:
    """chrom, pos, a log10 likelihood for each reference frequency of the grid, all persons taken as unrelated, for the
    alleles ref and its transition. A person's term is a row of the grid; sums are partial before the shuffle, so that
    cohorts of any width never meet in one row."""
    ref = F.col("ref_base")
    ts = F.element_at(F.array(*[F.lit(x) for x in (3, 4, 1, 2)]), ref)
    index = lambda a, b: ((F.least(a, b) - 1) * (10 - F.least(a, b)) / 2).cast("int") + F.greatest(a, b) - F.least(a, b)
    lk = [F.pow(F.lit(10.0), -F.get("pl", index(a, b)).cast("double") / 10) for a, b in ((ref, ref), (ref, ts), (ts, ts))]
    term = lambda f: F.log10(f * f * lk[0] + 2 * f * (1 - f) * lk[1] + (1 - f) * (1 - f) * lk[2])
    rows = obs.where("ref_base between 1 and 4").join(people.select(F.col("pid").alias("sample_id")), "sample_id", "left_semi")
    return rows.groupBy("chrom", "pos").agg(*[F.sum(term(f)).alias(f"l{i}") for i, f in enumerate(grid)])


def grid_mle(llk: DataFrame, grid: list[float]) -> DataFrame:
    """chrom, pos, ref_freq (the grid's best point, the least of equals), llk."""
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"l{i}"), 9).alias("l"), F.lit(-f).alias("f")) for i, f in enumerate(grid)]))
    return llk.select("chrom", "pos", (-best["f"]).alias("ref_freq"), F.round(best["l"], 6).alias("llk"))


def until_first_end(obs: DataFrame) -> DataFrame:
    """Of each chromosome the positions up to where the first sample ends, and the first position after it: what tools keep
    that stop a chromosome with the first file that runs out."""
    ends = obs.groupBy("chrom", "sample_id").agg(F.max("pos").alias("last")).groupBy("chrom").agg(F.min("last").alias("end"))
    later = obs.join(ends, "chrom").where("pos > end").groupBy("chrom").agg(F.min("pos").alias("next"))
    limits = ends.join(later, "chrom", "left").select("chrom", F.coalesce("next", "end").alias("_until"))
    return obs.join(limits, "chrom").where(F.col("pos") <= F.col("_until")).drop("_until")


def decode_positions(steps: DataFrame) -> DataFrame:
    """Adds pos, the running sum of offset over a sample's records of a chromosome, in order of rec_no. A section may be split over
    many tasks."""
    return prefix_sums(steps, ["sample_id", "chrom"], ["rec_no"], {"pos": "offset"})


def best_config(scores: DataFrame, n: int = 7) -> DataFrame:
    """Adds config (the first of the greatest of l0..), posterior (1 / sum of 10^(l - max)) and qual of log10 scores."""
    from kinfold.functions.scalars import site_quality

    ls = [F.col(f"l{i}") for i in range(n)]
    top = F.greatest(*ls)
    config = F.array_position(F.array(*ls), top).cast("int") - 1
    post = 1 / sum((F.pow(F.lit(10.0), x - top) for x in ls), F.lit(0.0))
    return scores.withColumns({"config": config, "posterior": post}).withColumn("qual", site_quality(F.col("posterior")))
