"""Ranges and site sets on chromosomes: merging, membership, regions, order.

Ranges are half-open [beg, end). Membership in many ranges is an equi-join on (chrom, bin): a merged range is listed
once for every bin it touches, a position has one bin, so that no pair of far ends meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.scalars import OPEN_END, chrom_order, strip_chr


def merge_ranges(ranges: DataFrame, slice_width: int = 1 << 20) -> DataFrame:
    """chrom, beg, end of the union of ranges that overlap or touch.

    A prefix maximum of ends in two levels: within slices of positions, which hold a range for each beginning at most, and
    over the slices of a chromosome, one row each. A range that begins behind all ends before it starts a run; the run
    ends where the maximum before the next start lies, in its slice or in a later one. No task holds more than a slice, or a
    row for each slice."""
    rows = ranges.where("beg < end").groupBy("chrom", "beg").agg(F.max("end").alias("end")).withColumn("_slice", F.floor(F.col("beg") / slice_width))
    slices = rows.groupBy("chrom", "_slice").agg(F.max("end").alias("top"))
    chrom = Window.partitionBy("chrom").orderBy("_slice")
    slices = slices.select("chrom", "_slice", F.max("top").over(chrom.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"), F.max("top").over(Window.partitionBy("chrom")).alias("_last"))
    within = Window.partitionBy("chrom", "_slice").orderBy("beg")
    reach = rows.withColumn("_reach", F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))).join(slices, ["chrom", "_slice"])
    starts = reach.withColumn("_before", F.greatest("_reach", "_carry")).where("_before is null or beg > _before").select("chrom", "_slice", "beg", "_before", "_last")
    later = starts.groupBy("chrom", "_slice").agg(F.min_by("_before", "beg").alias("_first")).select("chrom", "_slice", F.lead("_first").over(chrom).alias("_later"))
    ended = starts.withColumn("_next", F.lead("_before").over(within)).join(later, ["chrom", "_slice"])
    return ended.select("chrom", "beg", F.coalesce("_next", "_later", "_last").alias("end"))


def union_ranges(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("chrom", "beg", "end")
    for x in lists[1:]:
        out = out.unionByName(x.select("chrom", "beg", "end"))
    return merge_ranges(out)


def _binned(ranges: DataFrame, width: int) -> DataFrame:
    bins = F.sequence(F.floor(F.col("beg") / width), F.floor((F.col("end") - 1) / width))
    return ranges.select("*", F.explode(bins).alias("_bin"))


def sites_in_ranges(sites: DataFrame, ranges: DataFrame, width: int = 256) -> DataFrame:
    """The sites (chrom, pos, ...) that lie in a range, once each. width: bins of about a range's length."""
    merged = _binned(merge_ranges(ranges).withColumnsRenamed({"chrom": "_c", "beg": "_b", "end": "_e"}).select(F.col("_c"), F.col("_b").alias("beg"), F.col("_e").alias("end")), width)
    keyed = sites.withColumn("_k", F.floor(F.col("pos") / width))
    on = (keyed["chrom"] == merged["_c"]) & (keyed["_k"] == merged["_bin"]) & (keyed["pos"] >= merged["beg"]) & (keyed["pos"] < merged["end"])
    return keyed.join(merged, on, "left_semi").drop("_k")


def region_query(rows: DataFrame, regions: DataFrame, width: int = 256) -> DataFrame:
    """Rows whose 1-based pos lies in a region (ord, chrom, beg, end), both ends included; a row is returned for each
    region that it lies in, with its ord."""
    r = _binned(regions.select("ord", F.col("chrom").alias("_c"), "beg", (F.col("end") + 1).alias("end")), width)
    keyed = rows.withColumn("_k", F.floor(F.col("pos") / width))
    on = (keyed["chrom"] == r["_c"]) & (keyed["_k"] == r["_bin"]) & (keyed["pos"] >= r["beg"]) & (keyed["pos"] < r["end"])
    return keyed.join(r, on).drop("_k", "_bin", "_c", "beg", "end")


def sites_in_set(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    return sites.join(wanted.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")


def site_count(sites: DataFrame) -> DataFrame:
    """chrom, n: distinct positions. Grouped twice, so that no task sees a whole chromosome."""
    return sites.select("chrom", "pos").distinct().groupBy("chrom").agg(F.count("*").alias("n"))


def parse_ranges(text: Column) -> Column:
    """Array of (chrom, beg, end) of "1:100-200,X:150,1:100-": one position has beg = end, an open end is OPEN_END;
    a bare chromosome is whole."""

    def one(x: Column) -> Column:
        chrom = strip_chr(F.regexp_extract(x, "^([^:]*)", 1))
        beg = F.regexp_extract(x, ":([0-9]+)", 1).try_cast("int")
        end = F.regexp_extract(x, "-([0-9]+)$", 1).try_cast("int")
        dash = x.rlike(":[0-9]+-")
        return F.struct(chrom.alias("chrom"), F.coalesce(beg, F.lit(0)).alias("beg"), F.coalesce(end, F.when(dash | beg.isNull(), F.lit(OPEN_END)).otherwise(beg)).alias("end"))

    return F.transform(F.filter(F.split(F.regexp_replace(text, " ", ""), ","), lambda x: x != ""), one)


def genome_sorted(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in chromosome and position order: partitions by range, each one sorted."""
    keyed = rows.withColumn("_o", chrom_order(F.col("chrom")))
    out = keyed.repartitionByRange(partitions, "_o", "chrom", "pos") if partitions else keyed.repartitionByRange("_o", "chrom", "pos")
    return out.sortWithinPartitions("_o", "chrom", "pos").drop("_o")


def nth_range(ranges: DataFrame, n: int) -> DataFrame:
    """The n-th merged range (from 0) in genome order, none if there are fewer: of the least n + 1 alone, a bounded number."""
    first = merge_ranges(ranges).withColumn("_o", chrom_order(F.col("chrom"))).orderBy("_o", "chrom", "beg").limit(n + 1)
    place = F.row_number().over(Window.orderBy("_o", "chrom", "beg"))
    return first.withColumn("_n", place).where(F.col("_n") == n + 1).select("chrom", "beg", "end")


def gene_ranges(genes: DataFrame, wanted: DataFrame) -> DataFrame:
    """chrom, beg, end of the wanted genes (name) in a table of name, chrom, beg, end."""
    return genes.join(wanted.select("name").distinct(), "name", "left_semi").select(strip_chr(F.col("chrom")).alias("chrom"), "beg", "end").distinct()


def unknown_sites(sites: DataFrame, known: DataFrame) -> DataFrame:
    """Sites that are in no list."""
    return sites.select("chrom", "pos").distinct().join(known.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_anti")
