"""Operators on VCF rows: chrom, pos, id, ref, alt, qual, filter, info, format, samples array<string>.

Sample columns stay in one array, so that counts over samples are array expressions and nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import scalars as S


def info_value(tag: str) -> Column:
    """The value of an INFO tag; '' for a flag, null if it is absent."""
    return F.try_element_at(S.info_map(F.col("info")), F.lit(tag))


def sample_values(tag: str) -> Column:
    """The values of a FORMAT tag, one for each sample, null where it is missing."""
    at = S.format_index(F.col("format"), tag)
    return F.transform("samples", lambda s: S.sample_field(s, at))


def allele_counts(vcf: DataFrame) -> DataFrame:
    """Adds ac, an, af (0 without genotypes), mac, n_missing out of the genotypes."""
    gts = F.transform(sample_values("GT"), lambda g: S.gt_dosage(F.coalesce(g, F.lit("."))))
    seen = F.filter(gts, lambda d: d >= 0)
    ac = F.aggregate(seen, F.lit(0), lambda a, d: a + d)
    rows = vcf.select("*", ac.alias("ac"), (F.size(seen) * 2).alias("an"), (F.size("samples") - F.size(seen)).alias("n_missing"))
    return rows.select("*", F.when(F.col("an") > 0, F.col("ac") / F.col("an")).otherwise(F.lit(0.0)).alias("af"), F.least(F.col("ac"), F.col("an") - F.col("ac")).alias("mac"))


def filter_biallelic(vcf: DataFrame) -> DataFrame:
    return vcf.where(~F.col("alt").contains(",") & (F.col("ref") != F.col("alt")))


def is_indel() -> Column:
    return (F.length("ref") > 1) | (F.length("alt") > 1)


def filter_site_quality(vcf: DataFrame, least: int) -> DataFrame:
    return vcf.where(F.col("qual").cast("int") >= least)


def filter_site_depth(vcf: DataFrame, least: int = 0, most: int = 0, from_info: bool = True) -> DataFrame:
    """Depth of INFO, or the sum of the samples' DP; a limit of 0 is off; no tag: the site goes."""
    if least <= 0 and most <= 0:
        return vcf
    depth = info_value("DP").try_cast("int") if from_info else F.aggregate(sample_values("DP"), F.lit(0), lambda a, d: a + F.coalesce(d.try_cast("int"), F.lit(0)))
    keep = depth.isNotNull()
    if least > 0:
        keep &= depth >= least
    if most > 0:
        keep &= depth <= most
    return vcf.where(keep)


def filter_site_freq(vcf: DataFrame, least: float, most: float, from_info: bool = True) -> DataFrame:
    if from_info:
        return vcf.where(info_value("AF").try_cast("double").between(least, most))
    return allele_counts(vcf).where(F.col("af").between(least, most)).select(*vcf.columns)


def filter_site_mac(vcf: DataFrame, least: int) -> DataFrame:
    return allele_counts(vcf).where(F.col("mac") >= least).select(*vcf.columns)


def filter_variant_sites(vcf: DataFrame) -> DataFrame:
    return allele_counts(vcf).where("ac > 0").select(*vcf.columns)


def filter_annotation(vcf: DataFrame, pattern: str) -> DataFrame:
    """INFO's ANNO has a match of the pattern anywhere; without the tag the site goes."""
    return vcf.where(info_value("ANNO").rlike(pattern))


def select_samples(vcf: DataFrame, names: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The rows with the wanted sample columns, in the header's order, and their names."""
    wanted = [n for n in names if (include is None or n in set(include)) and n not in set(exclude or ())]
    places = [names.index(n) for n in wanted]
    return vcf.withColumn("samples", F.transform(F.array(*[F.lit(p) for p in places]).cast("array<int>"), lambda i: F.get("samples", i))), wanted


def rename_samples(names: DataFrame, renamed: DataFrame) -> DataFrame:
    """ord, name: names (ord, name) after a map (line, old, new); the last line of a key wins; others keep their name."""
    w = Window.partitionBy("old").orderBy(F.desc("line"))
    last = renamed.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("old").alias("name"), "new")
    return names.join(last, "name", "left").select("ord", F.coalesce("new", "name").alias("name"))


def likelihood_triples(format_: Column, samples: Column, places: list[int]) -> Column:
    """For each place the three phred values of PL, or of GL times -10; null where a sample has neither or is -1."""
    pl, gl = S.format_index(format_, "PL"), S.format_index(format_, "GL")

    def one(i: int) -> Column:
        none = F.lit(None).cast("array<double>")
        if i < 0:
            return none
        s = F.get(samples, F.lit(i))
        p = F.transform(F.split(S.sample_field(s, pl), ","), lambda x: F.least(x.try_cast("double"), F.lit(255.0)))
        g = F.transform(F.split(S.sample_field(s, gl), ","), lambda x: F.least((x.try_cast("double") * -10).cast("int").cast("double"), F.lit(255.0)))
        ok = lambda x: F.when((F.size(x) == 3) & ~F.exists(x, lambda v: v.isNull()), x)
        return F.coalesce(ok(p), ok(g), none)

    return F.array(*[one(i) for i in places])


def to_lines(vcf: DataFrame) -> DataFrame:
    """value: one line for each row."""
    qual = F.when(F.col("qual").isNull(), F.lit(".")).otherwise(F.format_string("%.2f", "qual"))
    return vcf.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", qual, "filter", "info", "format", F.array_join("samples", "\t")).alias("value"))


def dosages(vcf: DataFrame) -> DataFrame:
    """chrom, pos, sample (place), dosage of every sample, -9 if missing: the long form."""
    return vcf.select("chrom", "pos", F.posexplode(sample_values("GT")).alias("sample", "gt")).select("chrom", "pos", "sample", S.gt_dosage(F.coalesce("gt", F.lit("."))).alias("dosage"))
