"""Codecs of binary formats: likelihood files, one for each sample, and PLINK genotypes."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.lineage import written
from kinfold.functions.scalars import gt_dosage, let
from kinfold.operators.scans import prefix_sums
from kinfold.operators.vcf import sample_values
from kinfold.sources import plink

OBS = "chrom string, pos int, sample_id string, ref_base int, depth int, map_qual int, min_llk int, pl array<int>, contig_length int"
# 4-bit base codes to 1..4.
NIBBLE = {1: 1, 2: 2, 4: 3, 8: 4}


def decode_glf(data: bytes) -> Iterator[tuple]:
    """(chrom, pos, ref_base, depth, map_qual, min_llk, pl, contig_length) of the site records of one file. Positions are
    stored as steps; insertion records move the position and are dropped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data[:4] != b"GLF\3":
        raise ValueError("no likelihood file of version 3")
    (n,) = struct.unpack_from("<i", data, 4)
    at = 8 + n
    while at < len(data):
        (n,) = struct.unpack_from("<i", data, at)
        label = data[at + 4 : at + 4 + n].rstrip(b"\0").decode()
        (length,) = struct.unpack_from("<I", data, at + 4 + n)
        at += 8 + n
        pos = 0
        while at < len(data):
            kind, ref = data[at] >> 4, NIBBLE.get(data[at] & 15, 0)
            at += 1
            if kind == 0:
                break
            offset, depth_llk = struct.unpack_from("<II", data, at)
            map_qual = data[at + 8]
            pos += offset
            at += 9
            depth, min_llk = depth_llk & 0xFFFFFF, depth_llk >> 24
            if kind == 1:
                yield label, pos, ref, depth, map_qual, min_llk, list(data[at : at + 10]), length
                at += 10
            else:
                n1, n2 = struct.unpack_from("<hh", data, at + 3)
                at += 7 + abs(n1) + abs(n2)


def read_glf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each site record; sample_id is the file's name. A file is one task, which can't be split: keep the result
    as Parquet, partitioned by chromosome, for all further runs."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["chrom", "pos", "ref_base", "depth", "map_qual", "min_llk", "pl", "contig_length"]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for r in decode_glf(bytes(content)):
                    rows.append(r)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=columns).assign(sample_id=path.rsplit("/", 1)[-1])
                        rows = []
                yield pd.DataFrame(rows, columns=columns).assign(sample_id=path.rsplit("/", 1)[-1])

    return files.mapInPandas(run, OBS)


def incompatible_contigs(obs: DataFrame) -> DataFrame:
    """Chromosomes whose length differs between samples."""
    return obs.groupBy("chrom").agg(F.countDistinct("contig_length").alias("lengths")).where("lengths > 1")


def bed_code(dosage: Column) -> Column:
    """Two bits of a dosage: 0, 1, 2 and missing."""
    return F.when(dosage == 0, 0).when(dosage == 1, 2).when(dosage == 2, 3).otherwise(1)


def pack_bed(codes: Column) -> Column:
    """The bytes, in hexadecimal, of an array of two-bit codes: four in a byte, the first in the low bits."""

    def packed(c: Column) -> Column:
        at = lambda i: F.coalesce(F.get(c, i), F.lit(0))
        byte = lambda b: at(b * 4) + at(b * 4 + 1) * 4 + at(b * 4 + 2) * 16 + at(b * 4 + 3) * 64
        n = F.ceil(F.size(c) / 4).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: F.lpad(F.hex(byte(b)), 2, "0")), "")

    return let(codes, packed)


def plink_markers(vcf: DataFrame) -> DataFrame:
    """chrom, name, cm, pos, ref, alt, bed of records with single-base alleles on known chromosomes: a .bim row and its
    genotypes. Haploid alternative alleles count as homozygous."""
    c = F.col("chrom")
    number = F.when(F.upper(c) == "X", 23).when(F.upper(c) == "Y", 24).when(F.upper(c).isin("M", "MT"), 25).otherwise(c.try_cast("int"))
    rows = vcf.where((F.length("ref") == 1) & (F.length("alt") == 1)).withColumn("_c", number).where("_c is not null")
    name = F.when(F.col("id") == ".", F.concat_ws(":", "chrom", "pos")).otherwise(F.col("id"))

    def code(g: Column) -> Column:
        d = gt_dosage(F.coalesce(g, F.lit(".")))
        haploid = g.rlike("^[0-9]$")
        return bed_code(F.when(haploid & (d > 0), F.lit(2)).otherwise(d))

    return rows.select(F.col("_c").alias("chrom"), name.alias("name"), F.lit(0).alias("cm"), "pos", "ref", "alt", pack_bed(F.transform(sample_values("GT"), code)).alias("bed"))


def in_order(rows: DataFrame) -> DataFrame:
    """Adds ord, the place of a row from 0, by partition and place in it. rows must read the same each time, as files do; only
    one count for each partition reaches the driver."""
    placed = rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    n = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(n):
        before[part], total = total, total + n[part]
    if not before:
        return placed.select(*rows.columns, F.lit(0).cast("long").alias("ord"))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part"))
    return placed.select(*rows.columns, (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + offset).cast("long").alias("ord"))


def write_plink(vcf: DataFrame, names: list[str], prefix: str) -> None:
    """prefix.bed, prefix.bim and prefix.fam, markers in genome order, on a folder that all machines mount.

    A marker's place and where its line stands are prefix sums over ranges of markers; rows of a .bed file have one width, so
    every task writes its own bytes of both files. Only two sums reach the driver, and the names that came from it."""
    step = max(1, (len(names) + 3) // 4)
    line = F.concat(F.concat_ws("\t", F.col("chrom").cast("string"), "name", F.lit("0"), F.col("pos").cast("string"), "ref", "alt"), F.lit("\n"))
    # written first, as ranges are found in one pass over the rows and dealt out in another
    rows = written(plink_markers(vcf)).withColumn("line", line.cast("binary")).withColumns({"_all": F.lit(0), "_one": F.lit(1), "_len": F.octet_length("line")})
    placed = written(prefix_sums(rows, ["_all"], ["chrom", "pos", "name", "ref", "alt", "bed"], {"n": "_one", "end": "_len"}))
    n, size = placed.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("end"), F.lit(0))).first()
    head = vcf.sparkSession.createDataFrame([(0, b"\x6c\x1b\1")], "at long, data binary")
    data = placed.select((3 + (F.col("n") - 1) * step).alias("at"), F.unhex("bed").alias("data"))
    plink.write_bytes(head.unionByName(data), f"{prefix}.bed", 3 + n * step)
    plink.write_bytes(placed.select((F.col("end") - F.col("_len")).alias("at"), F.col("line").alias("data")), f"{prefix}.bim", size)
    fam = "".join("\t".join((n, n, "0", "0", "0", "-9")) + "\n" for n in names).encode()
    plink.write_bytes(vcf.sparkSession.createDataFrame([(0, fam)], "at long, data binary"), f"{prefix}.fam", len(fam))


def decode_bed(data: bytes, n_people: int, n_markers: int) -> np.ndarray:
    """Dosages [people, markers], -9 missing, of the bytes of a .bed file in either order."""
    if data[:2] != b"\x6c\x1b":
        raise ValueError("no .bed file")
    by_marker = data[2] == 1
    rows, width = (n_markers, n_people) if by_marker else (n_people, n_markers)
    step = (width + 3) // 4
    raw = np.frombuffer(data, dtype=np.uint8, count=rows * step, offset=3).reshape(rows, step)
    codes = (raw[:, :, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
    out = np.array([0, -9, 1, 2])[codes.reshape(rows, step * 4)[:, :width]]
    return out.T if by_marker else out


def read_plink(spark: SparkSession, prefix: str, people: list[str] | None = None, markers: list[str] | None = None, block: int | None = None, chromosomes: list[str] | None = None) -> DataFrame:
    """iid, marker, person, place, dosage in long form: .bim and .fam as text (of repeated names the first counts). people,
    markers: only these, and then iid_ord and marker_ord, their places in the lists; chromosomes: only markers on these.

    The .bed file, of any size, is read by byte ranges of whole rows (block: rows of a task); of markers and chromosomes asked
    for only their rows' bytes are."""
    f = F.split(F.trim("value"), r"\s+")
    numbered = lambda suffix: in_order(spark.read.text(f"{prefix}.{suffix}").where("trim(value) <> ''").select(F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(0)).alias("group"))).select(F.col("ord").cast("int").alias("place"), "name", "group")
    bim, fam = numbered("bim"), numbered("fam")
    n_markers, n_people = bim.count(), fam.count()
    first = lambda df: df.groupBy("name").agg(F.min("place").alias("place"))
    chosen = lambda df, names, ord_: df if names is None else df.join(spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], f"name string, {ord_} int"), "name")
    what = first(bim)
    if chromosomes is not None:
        what = what.join(bim.where(F.col("group").isin(*chromosomes)).select("place"), "place", "left_semi")
    who, what = chosen(first(fam), people, "iid_ord"), chosen(what, markers, "marker_ord")
    places = None
    if markers is not None:  # no more of them than were asked for
        places = plink.runs_of([r.place for r in what.select("place").collect()])
    elif chromosomes is not None:  # one stretch for each, which in a sorted file holds nothing else
        ends = bim.where(F.col("group").isin(*chromosomes)).groupBy("group").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).collect()
        places = plink.merged_runs([(r.lo, r.hi + 1) for r in ends])
    rows = plink.bed_rows(spark, f"{prefix}.bed", n_people, n_markers, places, task_rows=block)
    out = rows.join(who.withColumnsRenamed({"name": "iid", "place": "person"}), "person").join(what.withColumnRenamed("name", "marker"), "place")
    return out.select("iid", "marker", "person", "place", "dosage", *(["iid_ord"] if people is not None else []), *(["marker_ord"] if markers is not None else []))


def pack_matrix(dosages: DataFrame, n_people: int) -> DataFrame:
    """marker, bed of a long table (marker, person, dosage): the genotypes of a marker in order of the persons' places,
    those without a row missing. One missing code for each place is added and sorted before the person's own."""
    given = F.collect_list(F.struct(F.col("person").cast("int").alias("person"), F.lit(1).alias("own"), bed_code(F.col("dosage")).alias("c")))
    missing = F.transform(F.sequence(F.lit(0), F.lit(n_people - 1)), lambda i: F.struct(i.alias("person"), F.lit(0).alias("own"), F.lit(1).alias("c")))
    rows = dosages.groupBy("marker").agg(F.sort_array(F.concat(given, missing)).alias("s"))
    last = F.filter("s", lambda x, i: F.coalesce(F.get(F.col("s"), i + 1)["person"] != x["person"], F.lit(True)))
    return rows.select("marker", pack_bed(F.transform(last, lambda x: x["c"])).alias("bed"))


GL_TABLE = "chrom string, pos int, sample_id int, ref_base int, depth int, map_qual smallint, pl array<smallint>"


def read_gl_table(spark: SparkSession, path: str) -> DataFrame:
    """The columnar form of the likelihoods, with a fixed schema: the usual input at scale. Keep it partitioned by chrom and
    sorted by pos, so that a chromosome or a region is read alone."""
    return spark.read.schema(GL_TABLE).parquet(path)
