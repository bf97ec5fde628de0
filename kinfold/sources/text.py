"""Readers and writers of text formats: VCF, pedigrees, site lists, ranges, maps, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.scalars import chrom_class, genotype_label
from kinfold.jobs.options import Options
from kinfold.operators import vcf as V
from kinfold.operators.ranges import genome_sorted, parse_ranges

WHITE = r"\s+"
#: The code of a missing trait.
MISSING = -99.999


def read_vcf(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, list[str]]:
    """Rows (chrom, pos, id, ref, alt, qual, filter, info, format, samples) and the sample names. Compressed files are
    read too; a .gz file can't be split, so it is dealt out anew by the first wide step or, better, kept as Parquet."""
    lines = spark.read.text(paths)
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError("no #CHROM line")
    names = head.value.split("\t")[9:]
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return rows.select(at(0).alias("chrom"), at(1).try_cast("int").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(5).try_cast("double").alias("qual"), at(6).alias("filter"), at(7).alias("info"), at(8).alias("format"), F.slice(f, 10, max(1, len(names))).alias("samples")), names


def write_vcf(vcf: DataFrame, names: list[str], path: str, meta: tuple[str, ...] = ("##fileformat=VCFv4.1",), compression: str = "none") -> None:
    """Part files in genome order; the header is a file of its own that sorts first, so that one concatenation gives a VCF."""
    fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
    header = vcf.sparkSession.createDataFrame([("\n".join([*meta, "\t".join(fixed + names)]),)], "value string")
    header.coalesce(1).write.mode("overwrite").option("compression", compression).text(f"{path}/0-header")
    V.to_lines(genome_sorted(vcf)).write.mode("overwrite").option("compression", compression).text(f"{path}/1-records")


def _letter(c: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), F.col(c))


def _lone_couple(people: list[tuple]) -> bool:
    """One nuclear family: its frequency is not estimated."""
    return len({p[0] for p in people}) == 1 and sum(p[2] < 0 for p in people) == 2 and len(people) > 2


def _reads_info() -> Column:
    share = 100.0 * F.col("n_samples") / F.size("dp")
    return F.format_string("NS=%d;PS=%.1f;DP=%d;MQ=%.1f", F.col("n_samples"), share, F.col("depth"), F.col("map_quality"))


def _alt() -> tuple[Column, Column]:
    """Whether the first called allele is the reference, and ALT: both called alleles where it is not."""
    is_ref = F.col("a1") == F.col("ref_base")
    return is_ref, F.when(is_ref, _letter("a2")).otherwise(F.concat_ws(",", _letter("a1"), _letter("a2")))


def _record(alt: Column, info: Column, format_: str, samples: Column) -> Column:
    """A VCF line of a called site; positions become 1-based."""
    return F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), _letter("ref_base"), alt, F.floor(F.col("qual") + 0.5).cast("string"), F.lit("."), info, F.lit(format_), F.array_join(samples, "\t"))


def call_lines(calls: DataFrame, people: list[tuple], o: Options = Options()) -> DataFrame:
    """chrom, pos, value: VCF lines of calls from likelihoods, samples in the order of the persons' ids. AF is the reference
    allele's frequency (not of a lone couple), AB the allele balance (on autosomes); a site without a variant has ALT "."
    and the best candidate as BA. Labels have one digit where a person is haploid, "." for a female Y. gl_off leaves PL out."""
    is_ref, alt = _alt()
    mono = F.col("config") == 0
    klass = chrom_class(F.col("chrom"), o.chrom_x, o.chrom_y, o.chrom_mt)
    freq = F.lit("") if _lone_couple(people) else F.concat(F.format_string(";AF=%.4f", "ref_freq"), F.when(klass == "autosome", F.format_string(";AB=%.3f", "ab")).otherwise(F.lit("")))
    info = F.concat(_reads_info(), freq, F.when(mono, F.concat(F.lit(";BA="), _letter("a2"))).otherwise(F.lit("")))
    sexes = F.array(*[F.lit(p[4]) for p in sorted(people, key=lambda p: p[1])])

    def sample(x: Column, i: Column) -> Column:
        label = genotype_label(x["gt"], klass, F.get(sexes, i), is_ref)
        parts = [label, x["gq"], x["dp"], F.format_string("%.2f", x["dosage"])]
        return F.concat_ws(":", *parts, *([] if o.gl_off else [F.concat_ws(",", x["pl3"].cast("array<string>"))]))

    samples = F.transform(F.arrays_zip("gt", "gq", "dp", "dosage", "pl3"), sample)
    return calls.select("chrom", "pos", _record(F.when(mono, F.lit(".")).otherwise(alt), info, "GT:GQ:DP:DS" + ("" if o.gl_off else ":PL"), samples).alias("value"))


def read_pedigree(spark: SparkSession, ped: str, dat: list[tuple[str, str]] = ()) -> DataFrame:
    """famid, pid, fatid, motid, sex and, by the declared columns (letter, name), traits (T, C), affections (A), twins (Z);
    S skips a column, M takes two. Rows after a line "end" don't count; 0 is an unknown parent or sex. Ids stay text."""
    f = F.split(F.trim("value"), WHITE)
    at = lambda i: F.get(f, F.lit(i))
    lines = F.split(F.regexp_replace("value", r"(?is)(^|\n)\s*end\s*(\n.*|$)", "\n"), "\n")  # files are small: whole ones
    rows = spark.read.text(ped, wholetext=True).select(F.explode(lines).alias("value")).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    sex = F.lower(at(4))
    parent = lambda i: F.when(at(i) != "0", at(i))
    cols = [at(0).alias("famid"), at(1).alias("pid"), parent(2).alias("fatid"), parent(3).alias("motid"), F.when(sex.isin("1", "m"), 1).when(sex.isin("2", "f"), 2).otherwise(0).alias("sex")]
    i = 5
    for letter, name in dat:
        if letter in "TC":
            v = at(i).try_cast("double")
            cols.append(F.when(v != MISSING, v).alias(name))
        elif letter == "A":
            v = F.lower(at(i))
            cols.append(F.when(v.isin("2", "a", "d", "y"), 2).when(v.isin("1", "u", "n"), 1).alias(name))
        elif letter == "Z":
            z = F.lower(at(i))
            cols.append(F.when(z == "mz", 1).when(z == "dz", 2).otherwise(at(i).try_cast("int")).alias("zygosity"))
        elif letter == "$":
            cols.append(at(i).alias(name))
        elif letter == "M":
            pair = F.split(at(i), "/")
            two = F.size(pair) == 2
            cols.append(F.array(F.get(pair, F.lit(0)), F.when(two, F.get(pair, F.lit(1)))).alias(name))
        elif letter == "E":
            break
        i += 1
    return rows.select(*cols)


def read_dat(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The declared columns (letter, name); a small file. S5 gives five columns to skip, UTC counts as T."""
    out = []
    for r in spark.read.text(path).collect():
        parts = r.value.split()
        if not parts:
            continue
        kind, name = parts[0].upper(), parts[-1]
        if kind == "E" or kind == "END":
            break
        if kind.startswith("S"):
            out += [("S", name)] * int(kind[1:] or 1)
        elif kind != "V":
            out.append(("T" if kind == "UTC" else kind[0], name))
    return out


def pedigree_lines(ped: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """value: tab-separated lines by the declared columns (letter, name): Z the column zygosity (0, MZ, DZ, then numbers), M
    a pair of alleles as a/b (0 for an unknown one), T and C with three decimals, A as it is, $ as text; x for a missing
    value, "." for a missing text. pedigree_end() closes the file."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))

    def field(letter: str, name: str) -> Column:
        if letter == "Z":
            z = F.coalesce(F.col("zygosity"), F.lit(0))
            return F.when(z == 1, F.lit("MZ")).when(z == 2, F.lit("DZ")).otherwise(z.cast("string"))
        if letter == "M":
            return F.concat_ws("/", *[F.coalesce(F.get(F.col(name), F.lit(i)).cast("string"), F.lit("0")) for i in (0, 1)])
        if letter == "A":
            return F.coalesce(F.col(name).cast("string"), F.lit("x"))
        if letter == "$":
            return F.when(F.coalesce(name, F.lit("")) == "", F.lit(".")).otherwise(F.col(name))
        return F.when(F.col(name).isNull(), F.lit("x")).otherwise(F.format_string("%.3f", F.col(name)))

    written = [field(letter, name) for letter, name in columns if letter not in "SE"]
    return ped.select(F.concat_ws("\t", "famid", F.col("pid").cast("string"), none("fatid"), none("motid"), F.col("sex").cast("string"), *written).alias("value"))


def write_pedigree(ped: DataFrame, columns: list[tuple[str, str]], path: str) -> None:
    """The persons' lines, the closing line "end" and the declarations, in folders whose concatenation in order gives the
    pedigree file (0, 1) and the data file (2)."""
    spark = ped.sparkSession
    declared = [c for c in columns if c[0] not in "SE"]
    pedigree_lines(ped, declared).write.mode("overwrite").text(f"{path}/0-persons")
    spark.createDataFrame([("end",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/1-end")
    spark.createDataFrame([(dat_lines(declared).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/2-dat")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """key, file of a two-column list; shorter lines are skipped."""
    f = F.split(F.trim("value"), WHITE)
    return spark.read.text(path).where(F.size(f) >= 2).select(F.get(f, F.lit(0)).alias("key"), F.get(f, F.lit(1)).alias("file"))


def bind_files(ped: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """famid, pid, file (null: no data) of persons by the number of their file; several may share one, 0 is none."""
    k = F.when(F.col(key) != 0, F.col(key).cast("long").cast("string"))
    return ped.select("famid", "pid", k.alias("key")).join(index, "key", "left").select("famid", "pid", "file")


def read_sites(spark: SparkSession, path: str, kind: str = "plain") -> DataFrame:
    """chrom, pos of a list: plain (columns 1, 2), bim (1, 4), rod (1, 3, one added) or bed (1; every position of [2, 3))."""
    f = F.split(F.trim("value"), WHITE)
    at = lambda i: F.get(f, F.lit(i - 1))
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    n = lambda i: at(i).try_cast("int")
    if kind == "bed":
        return rows.where(n(2) < n(3)).select(at(1).alias("chrom"), F.explode(F.sequence(n(2), n(3) - 1)).alias("pos"))
    pos = {"plain": n(2), "bim": n(4), "rod": n(3) + 1}[kind]
    return rows.select(at(1).alias("chrom"), pos.alias("pos")).where("pos is not null")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """chrom, beg, end of lines "chr beg end", "chr pos" or one range text."""
    f = F.split(F.trim("value"), WHITE)
    at = lambda i: F.get(f, F.lit(i))
    n = lambda i: at(i).try_cast("int")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    text = rows.where(F.size(f) == 1).select(F.explode(parse_ranges(at(0))).alias("r")).select("r.*")
    table = rows.where(F.size(f) > 1).select(at(0).alias("chrom"), n(1).alias("beg"), F.coalesce(n(2), n(1) + 1).alias("end"))
    return table.unionByName(text)


def read_marker_map(spark: SparkSession, path: str) -> DataFrame:
    """chrom (X: 999), marker, pos in Morgans, and pos_f, pos_m where two further columns give them."""
    f = F.split(F.trim("value"), WHITE)
    at = lambda i: F.get(f, F.lit(i))
    chrom = F.when(F.upper(at(0)) == "X", F.lit(999)).otherwise(at(0).try_cast("int"))
    cm = lambda i: at(i).try_cast("double") * 0.01
    return spark.read.text(path).select(chrom.alias("chrom"), at(1).alias("marker"), cm(2).alias("pos"), cm(3).alias("pos_f"), cm(4).alias("pos_m")).where("chrom is not null and pos is not null")


def marker_map_lines(markers: DataFrame) -> DataFrame:
    c = F.when(F.col("chrom") == 999, F.lit("X")).otherwise(F.col("chrom").cast("string"))
    return markers.select(F.concat_ws("\t", c, "marker", F.format_string("%.4f", F.col("pos") * 100)).alias("value"))


def read_allele_freqs(spark: SparkSession, path: str) -> DataFrame:
    """marker, allele, freq of "M name", "F f1 f2 ..", "A label freq" lines, scaled to sum 1; a small file."""
    rows, marker, count = [], None, 0
    for r in spark.read.text(path).collect():
        p = r.value.split()
        if not p:
            continue
        if p[0].upper() == "M":
            marker, count = p[1], 0
        elif p[0].upper() == "F":
            for x in p[1:]:
                count += 1
                rows.append((marker, str(count), float(x)))
        elif p[0].upper() == "A":
            rows.append((marker, p[1], float(p[2])))
    from kinfold.operators.markers import scale_frequencies

    return scale_frequencies(spark.createDataFrame(rows, "marker string, allele string, freq double"))


def allele_freq_lines(freq: DataFrame) -> DataFrame:
    """value: one text for each marker, "M name" and an "A label freq" line for each allele."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("allele", "freq"))), lambda x: F.format_string("A %s %.5f", x["allele"].cast("string"), x["freq"]))
    return freq.groupBy("marker").agg(each.alias("a")).select(F.concat_ws("\n", F.concat(F.lit("M "), F.col("marker").cast("string")), "a").alias("value"))


def read_ibd(spark: SparkSession, path: str, ped: DataFrame, markers: DataFrame) -> DataFrame:
    """famid, pid1, pid2, marker, p0, p1, p2; lines with unknown persons or markers are skipped."""
    f = F.split(F.trim("value"), WHITE)
    at = lambda i: F.get(f, F.lit(i))
    rows = spark.read.text(path).select(at(0).alias("famid"), at(1).try_cast("int").alias("pid1"), at(2).try_cast("int").alias("pid2"), at(3).alias("marker"), *[at(4 + i).try_cast("double").alias(f"p{i}") for i in range(3)])
    for c in ("pid1", "pid2"):
        rows = rows.join(ped.select("famid", F.col("pid").alias(c)).distinct(), ["famid", c], "left_semi")
    return rows.join(markers.select("marker").distinct(), "marker", "left_semi")


def read_basepair_map(spark: SparkSession, path: str) -> DataFrame:
    """chrom (X: 999), marker, bp of three-column lines."""
    f = F.split(F.trim("value"), WHITE)
    at = lambda i: F.get(f, F.lit(i))
    chrom = F.when(F.upper(at(0)) == "X", F.lit(999)).otherwise(at(0).try_cast("int"))
    return spark.read.text(path).select(chrom.alias("chrom"), at(1).alias("marker"), at(2).try_cast("long").alias("bp")).where("chrom is not null and bp is not null")


def dat_lines(columns: list[tuple[str, str]]) -> str:
    return "".join(f"{letter} {name}\n" for letter, name in columns) + "E END-OF-DATA\n"


def denovo_lines(calls: DataFrame, people: list[tuple], o: Options = Options()) -> DataFrame:
    """chrom, pos, value: VCF lines of de novo calls, samples in the order of the persons' ids; genotypes as letters, DQ in
    INFO, all ten phred values unless gl_off. At a site without another variant ALT is the first allele again."""
    alt = F.when(F.col("config") == 0, _letter("a1")).otherwise(_alt()[1])
    freq = F.lit("") if _lone_couple(people) else F.format_string(";AF=%.4f", "ref_freq")
    info = F.concat(_reads_info(), freq, F.format_string(";DQ=%.3f", "dq"))

    def sample(x: Column) -> Column:
        return F.concat_ws(":", x["gt"], x["gq"], x["dp"], *([] if o.gl_off else [F.concat_ws(",", x["pl"].cast("array<string>"))]))

    samples = F.transform(F.arrays_zip("gt", "gq", "dp", "pl"), sample)
    return calls.select("chrom", "pos", _record(alt, info, "GT:GQ:DP" + ("" if o.gl_off else ":PL"), samples).alias("value"))


def refined_lines(refined: DataFrame, sample_names: list[str], people: list[tuple], o: Options = Options()) -> DataFrame:
    """chrom, pos, value: VCF lines of refined records, for the pedigree's persons that have a sample, in the samples' order.
    AF is the alternative allele's frequency, AC its count and DP the depth over these samples; FILTER, the samples' DP and
    their PL or GL stay as they were; ./. where GQ is 0."""
    by_id = sorted(people, key=lambda p: p[1])
    at = {str(p[1]): (i, p[4]) for i, p in enumerate(by_id)}
    picked = F.array(*[F.struct(F.lit(at[n][0]).alias("i"), F.lit(at[n][1]).alias("sex")) for n in sample_names if n in at])
    klass = chrom_class(F.col("chrom"), o.chrom_x, o.chrom_y, o.chrom_mt)

    def sample(x: Column) -> Column:
        of = lambda c: F.get(F.col(c), x["i"])
        label = genotype_label(of("gt"), klass, x["sex"], F.lit(True))
        return F.concat_ws(":", F.when((of("gq") > 0) | (label == "."), label).otherwise(F.lit("./.")), of("gq"), F.coalesce(of("dp"), F.lit(".")), F.coalesce(of("likelihoods"), F.lit(".")))

    depth = F.aggregate(picked, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.get(F.col("dp"), x["i"]).try_cast("long"), F.lit(0).cast("long")))
    qual = F.when(F.col("qual").isNull() | F.isnan("qual"), F.lit(".")).otherwise(F.format_string("%.2f", "qual"))
    info = F.concat(F.format_string("AF=%.2f;AC=%d;DP=%d", 1 - F.col("ref_freq"), F.col("ac"), depth))
    return refined.select("chrom", "pos", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", qual, F.coalesce("filter", F.lit(".")), info, F.concat(F.lit("GT:GQ:DP:"), F.col("tag")), F.array_join(F.transform(picked, sample), "\t")).alias("value"))


def copy_vcf(vcf: DataFrame, names: list[str], path: str, include: list[str] | None = None, exclude: list[str] | None = None, compression: str = "none") -> list[str]:
    """The records with the selected samples alone, written again; their names."""
    rows, kept = V.select_samples(vcf, names, include, exclude)
    write_vcf(rows, kept, path, compression=compression)
    return kept
