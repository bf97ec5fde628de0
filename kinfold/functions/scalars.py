"""Column expressions of genetics: bases, genotypes, likelihood scales, chromosomes, VCF fields, map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base codes 1..4 and the ten unordered genotypes in their order.
BASES = "ACGT"
GENOTYPES = tuple((a, b) for a in range(1, 5) for b in range(a, 5))
GENOTYPE_LABELS = tuple(BASES[a - 1] + BASES[b - 1] for a, b in GENOTYPES)
#: A posterior above this counts as certain: quality 100.
CERTAIN = 0.9999999999
OPEN_END = 2**29


def genotype_index(b1: Column, b2: Column) -> Column:
    """0..9 of an unordered pair of base codes; null unless both are 1..4."""
    lo, hi = F.least(b1, b2), F.greatest(b1, b2)
    index = ((lo - 1) * (10 - lo) / 2).cast("int") + (hi - lo)
    return F.when((lo >= 1) & (hi <= 4), index.cast("int"))


def base_code(label: Column) -> Column:
    """A, C, G, T in either case to 1..4, anything else to 0."""
    return F.when(F.length(label) == 1, F.call_function("instr", F.lit(BASES), F.upper(label))).otherwise(F.lit(0)).cast("int")


def base_label(code: Column) -> Column:
    """1..4 to A, C, G, T, anything else to N."""
    return F.when(code.between(1, 4), F.element_at(F.array(*[F.lit(b) for b in BASES]), F.greatest(F.least(code.cast("int"), F.lit(4)), F.lit(1)))).otherwise(F.lit("N"))


def _partner(code: Column, to: tuple[int, int, int, int]) -> Column:
    return F.when(code.between(1, 4), F.element_at(F.array(*[F.lit(x) for x in to]), F.greatest(F.least(code.cast("int"), F.lit(4)), F.lit(1))))


# The partner of A, C, G, T under each kind of change.
TRANSITION, TRANSVERSION1, TRANSVERSION2 = (3, 4, 1, 2), (2, 1, 2, 1), (4, 3, 4, 3)


def transition(code: Column) -> Column:
    return _partner(code, TRANSITION)


def transversion1(code: Column) -> Column:
    return _partner(code, TRANSVERSION1)


def transversion2(code: Column) -> Column:
    return _partner(code, TRANSVERSION2)


def is_transition(ref: Column, alt: Column) -> Column:
    return alt == transition(ref)


def phred_to_likelihood(pl: Column) -> Column:
    """10^(-x/10), x at most 255."""
    return F.pow(F.lit(10.0), -F.least(pl, F.lit(255)) / 10)


def gl_to_pl(gl: Column) -> Column:
    """A log10 likelihood as a phred value, cut to an integer."""
    return (gl * -10).cast("int")


def genotype_quality(post: Column) -> Column:
    """Phred of 1 - posterior, rounded; 100 if certain."""
    return F.when(post > CERTAIN, F.lit(100)).otherwise(F.floor(-10 * F.log10(1 - post) + 0.5).cast("int"))


def site_quality(post: Column) -> Column:
    return F.when(post > CERTAIN, F.lit(100.0)).otherwise(-10 * F.log10(1 - post))


def dosage(p_het: Column, p_alt: Column) -> Column:
    return p_het + 2 * p_alt


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_chr(chrom: Column) -> Column:
    """Without a leading chr in any case; a bare "chr" stays."""
    return F.regexp_replace(chrom, "^[cC][hH][rR](.)", "$1")


def chrom_order(chrom: Column) -> Column:
    """Numbers by value, X 23, Y 24, MT 25, "6_abc" 106, others 1000 and the code of their first letter, empty -1."""
    c = strip_chr(chrom)
    number = F.regexp_extract(c, "^([0-9]+)", 1)
    return (
        F.when(c == "", F.lit(-1))
        .when(F.upper(c) == "X", F.lit(23))
        .when(F.upper(c) == "Y", F.lit(24))
        .when(F.upper(c).isin("M", "MT"), F.lit(25))
        .when(c.rlike("^[0-9]+$"), number.try_cast("int"))
        .when(c.rlike("^[0-9]+_"), number.try_cast("int") + 100)
        .otherwise(F.ascii(c) + 1000)
    )


def chrom_class(chrom: Column, x: str = "X", y: str = "Y", mt: str = "MT") -> Column:
    """autosome, X, Y or MT; the labels are parameters."""
    return F.when(chrom == x, F.lit("X")).when(chrom == y, F.lit("Y")).when(chrom == mt, F.lit("MT")).otherwise(F.lit("autosome"))


def hwe_priors(f: Column, klass: Column, sex: Column) -> Column:
    """Founder priors of (ref/ref, ref/alt, alt/alt) at reference frequency f: haploid for MT, Y and the male X."""
    haploid = klass.isin("MT", "Y") | ((klass == "X") & (sex == 1))
    return F.when(haploid, F.array(f, F.lit(0.0), 1 - f)).otherwise(F.array(f * f, 2 * f * (1 - f), (1 - f) * (1 - f)))


def genotype_label(best: Column, klass: Column, sex: Column, a1_is_ref: Column) -> Column:
    """0/0, 0/1, 1/1 if the first allele is the reference, else 1/1, 1/2, 2/2; one digit where haploid; "." for a female Y."""
    low = F.when(a1_is_ref, F.lit(0)).otherwise(F.lit(1))
    first = low + (best == 2).cast("int")
    second = low + (best >= 1).cast("int")
    haploid = klass.isin("MT", "Y") | ((klass == "X") & (sex == 1))
    return F.when((klass == "Y") & (sex == 2), F.lit(".")).when(haploid, second.cast("string")).otherwise(F.concat_ws("/", first, second))


def info_map(info: Column) -> Column:
    """"k=v;flag" as a map; a flag has the value ''; the last of repeated keys wins; a value with another = is left out."""
    parts = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda p: (p != "") & (p != ".") & (F.size(F.split(p, "=")) <= 2))
    pairs = F.transform(parts, lambda p: F.struct(F.get(F.split(p, "="), F.lit(0)).alias("k"), F.coalesce(F.get(F.split(p, "="), F.lit(1)), F.lit("")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    value = lambda k: F.element_at(F.transform(F.filter(pairs, lambda x: x["k"] == k), lambda x: x["v"]), -1)
    return F.map_from_arrays(keys, F.transform(keys, value))


def format_index(format_: Column, tag: str) -> Column:
    """The 0-based place of a tag in FORMAT, -1 if absent; exact match."""
    return F.array_position(F.split(format_, ":"), tag).cast("int") - 1


def sample_field(sample: Column, index: Column) -> Column:
    """A field of a sample column; null if it is beyond the end, empty, or the index is negative."""
    got = F.when(index >= 0, F.get(F.split(sample, ":"), index))
    return F.when(got != "", got)


def gt_dosage(gt: Column) -> Column:
    """The sum of the digits of a genotype, -9 if it is missing or no genotype."""
    two = gt.rlike("^[0-9][/|][0-9]$")
    return F.when(two, F.substring(gt, 1, 1).try_cast("int") + F.substring(gt, 3, 1).try_cast("int")).when(gt.rlike("^[0-9]$"), gt.try_cast("int")).otherwise(F.lit(-9))


def gt_allele(gt: Column, which: int) -> Column:
    """The first or second allele; null if missing (a haploid genotype has no second)."""
    return F.regexp_extract(gt, r"^([0-9]+)" if which == 1 else r"^[0-9.]+[/|]([0-9]+)", 1).try_cast("int")


def is_phased(gt: Column) -> Column:
    return gt.contains("|")


def is_haploid(gt: Column) -> Column:
    return ~gt.rlike("[/|]")


def is_missing_gt(gt: Column) -> Column:
    return F.coalesce(gt.contains("."), F.lit(True))


def haldane(distance: Column) -> Column:
    """Morgans to a recombination fraction."""
    return 0.5 * (1 - F.exp(-2 * distance))


def haldane_distance(fraction: Column) -> Column:
    return -0.5 * F.log(1 - 2 * fraction)


def kosambi(distance: Column) -> Column:
    return 0.5 * (F.exp(4 * distance) - 1) / (F.exp(4 * distance) + 1)


def kosambi_distance(fraction: Column) -> Column:
    return 0.25 * F.log((1 + 2 * fraction) / (1 - 2 * fraction))


def ibs(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Alleles shared by state, 0 to 2."""
    two = ((a1 == b1) & (a2 == b2)) | ((a1 == b2) & (a2 == b1))
    return F.when(two, F.lit(2)).when((a1 == b1) | (a1 == b2) | (a2 == b1) | (a2 == b2), F.lit(1)).otherwise(F.lit(0))
