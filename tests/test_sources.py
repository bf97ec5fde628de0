"""Readers and writers on handmade files, and operators on handmade rows."""

import gzip
import struct

from pyspark.sql import functions as F

from kinfold.operators import markers as M
from kinfold.operators import pedigrees as P
from kinfold.operators import ranges as R
from kinfold.operators import vcf as V
from kinfold.sources import binary as B
from kinfold.sources import fixtures as X
from kinfold.sources import text as T


def glf(records, label=b"1\0", length=500):
    out = b"GLF\3" + struct.pack("<i", 0) + struct.pack("<i", len(label)) + label + struct.pack("<I", length)
    for kind, ref, offset, depth, mq, pl in records:
        out += bytes([kind << 4 | ref]) + struct.pack("<II", offset, depth) + bytes([mq])
        out += bytes(pl) if kind == 1 else bytes(3) + struct.pack("<hh", 2, -1) + b"AC" + b"G"
    return out + b"\0"


def test_likelihood_files(spark, tmp_path):
    data = glf([(1, 1, 10, 7, 30, range(10)), (2, 0, 3, 1, 1, ()), (1, 15, 5, 9, 20, [0] * 10)])
    (tmp_path / "a.glf").write_bytes(data)
    (tmp_path / "b.glf").write_bytes(gzip.compress(glf([(1, 8, 18, 3, 40, [5] * 10)], length=400)))
    obs = B.read_glf(spark, str(tmp_path))
    got = sorted((r.sample_id, r.pos, r.ref_base, r.depth, r.map_qual, r.pl[1]) for r in obs.collect())
    assert got == [("a.glf", 10, 1, 7, 30, 1), ("a.glf", 18, 0, 9, 20, 0), ("b.glf", 18, 4, 3, 40, 5)]
    assert [r.chrom for r in B.incompatible_contigs(obs).collect()] == ["1"]


def test_vcf_round_trip(spark, sf, tmp_path):
    vcf, names = X.vcf_rows(spark, sf), [f"s{i}" for i in range(12)]
    T.write_vcf(vcf, names, str(tmp_path / "v"))
    text = "".join(p.read_text() for d in ("0-header", "1-records") for p in sorted((tmp_path / "v" / d).glob("part-*")))
    (tmp_path / "all.vcf").write_text(text)
    back, got = T.read_vcf(spark, str(tmp_path / "all.vcf"))
    assert got == names
    assert sorted(map(tuple, back.select("chrom", "pos", "info", "samples").collect())) == sorted(map(tuple, vcf.select("chrom", "pos", "info", "samples").collect()))
    order = [r.split("\t")[0] for r in text.splitlines() if not r.startswith("#")]
    assert list(dict.fromkeys(order)) == ["1", "2", "3", "X", "Y", "MT"]


def test_missing_fields_and_regions(spark):
    rows = [("1", p, ".", "A", "G", None, ".", "DP=1;F;K=a=b;DP=2", "GT:GD:GQ:PL:X", ["./.", "0/0:1:2:3", "0|1:::9"]) for p in (10, 20, 30, 40)] + [("X", p, ".", "A", "G", None, ".", ".", "GT", ["1", ".", "0/1"]) for p in (800, 900)]
    v = spark.createDataFrame(rows, "chrom string, pos int, id string, ref string, alt string, qual double, filter string, info string, format string, samples array<string>")
    first = v.where("pos = 10").select(V.sample_values("GD").alias("gd"), V.sample_values("X").alias("x"), V.info_value("DP").alias("dp"), V.info_value("F").alias("f"), V.info_value("K").alias("k"), V.info_value("Z").alias("z")).first()
    assert first.gd == [None, "1", None] and first.x == [None] * 3 and (first.dp, first.f, first.k, first.z) == ("2", "", None, None)
    c = V.allele_counts(v).where("pos = 900").first()
    assert (c.ac, c.an, c.n_missing) == (2, 4, 1)
    regions = spark.createDataFrame([(0, "1", 30, 50), (1, "X", 800, 900)], "ord int, chrom string, beg int, end int")
    assert sorted((r.ord, r.pos) for r in R.region_query(v, regions).collect()) == [(0, 30), (0, 40), (1, 800), (1, 900)]


def test_ranges(spark, tmp_path):
    (tmp_path / "r").write_text("1 100 200\n3 100 300\n1 50 150\nX 30 100\n1:7\n2:5-9\n")
    r = T.read_ranges(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, R.merge_ranges(r).collect())) == [("1", 50, 200), ("2", 5, 9), ("3", 100, 300), ("X", 30, 100)]
    x = spark.createDataFrame([("X", 2, 4), ("X", 1, 3), ("1", 1, 3), ("1", 4, 6), ("1", 5, 10)], "chrom string, beg int, end int")
    assert sorted(map(tuple, R.union_ranges(x, x).collect())) == [("1", 1, 3), ("1", 4, 10), ("X", 1, 4)]
    assert sorted(map(tuple, R.merge_ranges(x, slice_width=2).collect())) == [("1", 1, 3), ("1", 4, 10), ("X", 1, 4)]
    assert tuple(R.nth_range(x, 1).first()) == ("1", 4, 10) and R.nth_range(x, 3).count() == 0
    assert R.merge_ranges(x.limit(0)).count() == 0


def test_site_lists(spark, tmp_path):
    (tmp_path / "p").write_text("1 5\n2\t7\n")
    (tmp_path / "b").write_text("1 5 8\n")
    (tmp_path / "m").write_text("1 rs1 0 5 A G\n")
    (tmp_path / "rod").write_text("1 x 4\n")
    read = lambda f, k: sorted(map(tuple, T.read_sites(spark, str(tmp_path / f), k).collect()))
    assert read("p", "plain") == [("1", 5), ("2", 7)] and read("b", "bed") == [("1", 5), ("1", 6), ("1", 7)]
    assert read("m", "bim") == [("1", 5)] and read("rod", "rod") == [("1", 5)]


def test_pedigree_files(spark, tmp_path):
    (tmp_path / "d").write_text("T weight\nS2 skipped\nA sick\nZ twin\n")
    (tmp_path / "p").write_text("f 1 0 0 1 70.5 x x 2 0\nf 2 0 0 F -99.999 x x u 0\nf 3 1 2 x 12 x x x mz\nend\nf 4 0 0 1 1 1 1 1 1\n")
    ped = T.read_pedigree(spark, str(tmp_path / "p"), T.read_dat(spark, str(tmp_path / "d")))
    got = sorted(map(tuple, ped.collect()))
    assert got == [("f", "1", None, None, 1, 70.5, 2, 0), ("f", "2", None, None, 2, None, 1, 0), ("f", "3", "1", "2", 0, 12.0, None, 1)]
    assert sorted(r.value for r in T.pedigree_lines(ped, [("T", "weight")]).collect())[1] == "f\t2\t0\t0\t2\tx"
    columns = T.read_dat(spark, str(tmp_path / "d"))
    more = ped.withColumns({"m": F.array(F.lit("1"), F.lit(None).cast("string")), "note": F.lit("")})
    T.write_pedigree(more, [*columns, ("M", "m"), ("$", "note")], str(tmp_path / "w"))
    text = "".join(p.read_text() for d in ("0-persons", "1-end") for p in sorted((tmp_path / "w" / d).glob("part-*")))
    assert sorted(text.splitlines()) == ["end", "f\t1\t0\t0\t1\t70.500\t2\t0\t1/0\t.", "f\t2\t0\t0\t2\tx\t1\t0\t1/0\t.", "f\t3\t1\t2\t0\t12.000\tx\tMZ\t1/0\t."] and text.splitlines()[-1] == "end"
    (tmp_path / "w.ped").write_text(text)
    (tmp_path / "w.dat").write_text("".join(p.read_text() for p in sorted((tmp_path / "w" / "2-dat").glob("part-*"))))
    back = T.read_pedigree(spark, str(tmp_path / "w.ped"), T.read_dat(spark, str(tmp_path / "w.dat")))
    assert sorted(map(tuple, back.select(*ped.columns).collect())) == got


def test_maps_frequencies_ibd(spark, tmp_path):
    (tmp_path / "m").write_text("1 a 10 12 8\nX b 5\nbad\n")
    m = T.read_marker_map(spark, str(tmp_path / "m"))
    assert sorted((r.chrom, r.marker, round(r.pos, 4)) for r in m.collect()) == [(1, "a", 0.1), (999, "b", 0.05)]
    assert sorted(r.value for r in T.marker_map_lines(m).collect()) == ["1\ta\t10.0000", "X\tb\t5.0000"]
    (tmp_path / "f").write_text("M a\nF 0.2 0.2\nM b\nA x 1\nA y 3\n")
    f = T.read_allele_freqs(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, f.collect())) == [("a", "1", 0.5), ("a", "2", 0.5), ("b", "x", 0.25), ("b", "y", 0.75)]
    assert sorted(r.value for r in T.allele_freq_lines(f).collect())[1] == "M b\nA x 0.25000\nA y 0.75000"
    (tmp_path / "i").write_text("F1 2 3 a 0 1 0\nF1 2 99 a 0 1 0\nF1 2 3 zz 0 1 0\nF1 2 3 a 1 0 0\n")
    t = T.read_ibd(spark, str(tmp_path / "i"), X.pedigree(spark), m)
    assert t.count() == 2 and P.ibd_conflicts(t).count() == 1
    wanted = spark.createDataFrame([("F1", 0, 1, "a"), ("F1", 0, 2, "a"), ("F1", 2, 2, "a")], "famid string, pid1 int, pid2 int, marker string")
    assert sorted((r.pid2, r.p0, r.p1, r.p2) for r in P.ibd_lookup(wanted, t.limit(0), X.pedigree(spark)).collect() if r.pid1 == 0) == [(1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)]


def test_plink(spark, tmp_path):
    want = [[0, 2, 2], [2, -9, 1], [-9, 1, 1], [2, 2, -9], [2, 2, -9], [2, 2, 0]]
    code = {0: 0, 1: 2, 2: 3, -9: 1}
    body = b"".join(bytes(sum(code[want[p][m]] << 2 * (p % 4) for p in range(b, min(6, b + 4))) for b in (0, 4)) for m in range(3))
    (tmp_path / "t.bed").write_bytes(b"\x6c\x1b\1" + body)
    (tmp_path / "t.bim").write_text("".join(f"1 snp{m} 0 {m + 1} G A\n" for m in range(3)))
    (tmp_path / "t.fam").write_text("".join(f"f p{i} 0 0 1 -9\n" for i in range(6)))
    rows = B.read_plink(spark, str(tmp_path / "t"))
    assert {(r.person, r.place): r.dosage for r in rows.collect()} == {(p, m): want[p][m] for p in range(6) for m in range(3)}
    part = B.read_plink(spark, str(tmp_path / "t"), people=["p1", "p9"], markers=["snp2", "snp0"])
    assert sorted((r.iid, r.marker, r.dosage, r.iid_ord, r.marker_ord) for r in part.collect()) == [("p1", "snp0", 2, 0, 1), ("p1", "snp2", 1, 0, 0)]
    blocks = B.read_plink(spark, str(tmp_path / "t"), block=1)
    assert {(r.person, r.place): r.dosage for r in blocks.collect()} == {(p, m): want[p][m] for p in range(6) for m in range(3)}
    packed = spark.createDataFrame([([code[want[p][m]] for p in range(6)],) for m in range(3)], "c array<int>").select(B.pack_bed(F.col("c")).alias("h"))
    assert bytes.fromhex("".join(r.h for r in packed.collect())) == body
    by_person = B.decode_bed(b"\x6c\x1b\0" + bytes(sum(code[want[p][m]] << 2 * m for m in range(3)) for p in range(6)), 6, 3)
    assert by_person.tolist() == want
    (tmp_path / "t.bed").write_bytes(b"\x6c\x1b\0" + bytes(sum(code[want[p][m]] << 2 * m for m in range(3)) for p in range(6)))
    for block in (4, 100):
        assert {(r.person, r.place): r.dosage for r in B.read_plink(spark, str(tmp_path / "t"), block=block).collect()} == {(p, m): want[p][m] for p in range(6) for m in range(3)}


def test_plink_files_are_written_in_order(spark, sf, tmp_path):
    vcf = X.vcf_rows(spark, sf).repartition(5)
    B.write_plink(vcf, [f"s{i}" for i in range(12)], str(tmp_path / "w"))
    bim, body = (tmp_path / "w.bim").read_text().splitlines(), (tmp_path / "w.bed").read_bytes()
    want = {(str(r.chrom), r["name"], str(r.pos)): bytes.fromhex(r.bed) for r in B.plink_markers(vcf).collect()}
    places = [(int(x.split("\t")[0]), int(x.split("\t")[3])) for x in bim]
    assert places == sorted(places) and len(bim) == len(want)
    assert body == b"\x6c\x1b\1" + b"".join(want[x.split("\t")[0], x.split("\t")[1], x.split("\t")[3]] for x in bim)
    wide = spark.createDataFrame([(1, p, p % 3) for p in range(0, 4000, 2)], "marker long, person int, dosage int")
    assert bytes.fromhex(B.pack_matrix(wide, 4000).first().bed) == bytes(sum((1 if p % 2 else (0, 2, 3)[p % 3]) << 2 * (p % 4) for p in range(b, b + 4)) for b in range(0, 4000, 4))

def test_pedigree_rules(spark):
    k = {(r.pid1, r.pid2): r.phi for r in P.kinship(X.pedigree(spark, X.PEDIGREE_EXT)).where("famid = 'G'").collect()}
    assert (k[0, 0], k[0, 1], k[0, 2], k[4, 5], k[0, 4], k[0, 7], k[2, 7]) == (0.5, 0, 0.25, 0.25, 0.125, 0.0625, 0.125)
    kx = {(r.pid1, r.pid2): r.phi for r in P.kinship(X.pedigree(spark, X.PEDIGREE_EXT), x_linked=True).where("famid = 'G'").collect()}
    assert (kx[0, 0], kx[0, 2], kx[2, 4], kx[3, 4]) == (1.0, 0.5, 0.5, 0.0)
    data = spark.createDataFrame([("F1", 3)], "famid string, pid int")
    assert sorted((r.famid, r.pid) for r in P.trim(X.pedigree(spark), data).collect()) == [("F1", 3)]


def test_elimination(spark):
    geno = spark.createDataFrame([(1, "F1", 0, 1, 1), (1, "F1", 2, 1, 2), (1, "F1", 3, 1, 3), (2, "F1", 0, 1, 1), (2, "F1", 1, 1, 1), (2, "F1", 2, 2, 2)], "marker long, famid string, pid int, a1 int, a2 int")
    got = {(r.marker, r.pid): r.possible for r in M.eliminate_genotypes(geno, X.pedigree(spark)).collect()}
    assert got[1, 1] == "2/3" and got[2, 2] == ""


def test_empty_tables(spark, sf):
    from kinfold.jobs import calling as C

    none = X.gl_obs(spark, sf).limit(0)
    assert C.call_variants(none, list(X.PEDIGREE12)).count() == 0 and C.call_denovo(none, list(X.PEDIGREE12)).count() == 0
    assert M.mendel_errors(X.genotypes(spark, sf).limit(0), X.pedigree(spark)).count() == 0
