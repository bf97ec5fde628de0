"""Calls: recovery of the planted genotypes, invariances, refinement, streams, the fixed-frequency operator."""

import numpy as np
import pytest

from kinfold.jobs import calling as C
from kinfold.jobs import fixed
from kinfold.sources import fixtures as X

PEOPLE = list(X.PEDIGREE12)


def test_calls_recover_most_genotypes(spark, sf):
    truth = {(r.chrom, r.pos): {} for r in X.observations(spark, sf).select("chrom", "pos").distinct().collect()}
    for r in X.observations(spark, sf).collect():
        truth[r.chrom, r.pos][r.sample_id] = (r.a1, r.a2)
    right = total = 0
    for r in C.call_variants(X.gl_obs(spark, sf), PEOPLE).where("chrom in ('1', '2', '3')").collect():
        labels = {0: (r.a1, r.a1), 1: (r.a1, r.a2), 2: (r.a2, r.a2)}
        for p, pair in truth[r.chrom, r.pos].items():
            total += 1
            right += sorted(labels[r.gt[p]]) == sorted(pair)
    assert total > 500 and right / total > 0.9


def test_order_of_families_and_ids_does_not_matter(spark, sf):
    obs = X.gl_obs(spark, sf).where("pos < 600")
    a = {(r.chrom, r.pos): (r.config, round(r.ref_freq, 3), r.gt) for r in C.call_variants(obs, PEOPLE).collect()}
    b = {(r.chrom, r.pos): (r.config, round(r.ref_freq, 3), r.gt) for r in C.call_variants(obs, PEOPLE[::-1]).collect()}
    assert a == b and a


def test_no_mutation_no_score(spark, sf):
    obs = X.gl_obs(spark, sf).where("pos < 900")
    o = C.Options(denovo=True, rate_denovo=0.0, min_llr_denovo=0.0)
    assert all(abs(r.dq) < 1e-9 for r in C.call_denovo(obs, PEOPLE, o).collect())
    with pytest.raises(ValueError):
        C.call_denovo(obs, PEOPLE, C.Options(min_llr_denovo=-1))


def test_quick_call_only_skips_what_would_not_be_called_unrelated(spark, sf):
    obs = X.gl_obs(spark, sf)
    full = {(r.chrom, r.pos) for r in C.call_variants(obs, PEOPLE).collect()}
    quick = {(r.chrom, r.pos) for r in C.call_variants(obs, PEOPLE, C.Options(quick_call=True)).collect()}
    assert quick <= full and len(quick) > 0.9 * len(full)


def test_all_sites_and_forced_sites(spark, sf):
    obs = X.gl_obs(spark, sf)
    n = obs.select("chrom", "pos").distinct().count()
    assert C.call_variants(obs, PEOPLE, C.Options(all_sites=True)).count() == n
    forced = X.site_list(spark, sf)
    want = obs.select("chrom", "pos").distinct().join(forced.distinct(), ["chrom", "pos"], "left_semi").count()
    assert C.call_variants(obs, PEOPLE, forced=forced).count() == want


def test_fixed_frequency_operator_is_the_kernel(spark, sf):
    obs = X.observations(spark, sf).where("chrom in ('1', '2', '3')")
    want = {(r.site, r.sample_id): (r.best, r.dosage) for r in fixed.family_calls(obs, X.pedigree(spark)).collect()}
    model = C.Model(PEOPLE, "autosome", C.Options())
    sites = {}
    for r in obs.collect():
        sites.setdefault(r.site, [r.ref_base, r.alt_base, np.zeros((12, 10))])[2][r.sample_id] = r.pl
    for site, (ref, alt, pl) in sites.items():
        lk = C._likelihoods(pl[None].astype(int), np.array([ref]), np.array([alt]))
        _, post = model.llk(lk, np.array([fixed.FREQ]), marginals=True)
        for p in range(12):
            assert want[site, p][1] == pytest.approx(post[0, p, 1] + 2 * post[0, p, 2], abs=2e-6)


def test_refined_records_and_stream(spark, sf, tmp_path):
    from kinfold.streaming.refine import refine_folder

    names = [str(i) for i in range(12)]
    vcf = X.vcf_rows(spark, sf)
    batch = C.refine_vcf(vcf, names, PEOPLE)
    assert batch.count() == vcf.where("alt not like '%,%' and ref <> alt").count()
    vcf.repartition(3).write.parquet(str(tmp_path / "in"))
    refine_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), names, PEOPLE).awaitTermination()
    key = lambda df: sorted((r.chrom, r.pos, round(r.ref_freq, 6), r.gt) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)
    with pytest.raises(ValueError, match="no sample"):
        C.refine_vcf(vcf, ["a", "b"], PEOPLE)


def test_record_without_likelihoods(spark):
    v = spark.createDataFrame([("1", 5, ".", "A", "G", 1.0, "PASS", ".", "GT:PL", ["./.", "."])], "chrom string, pos int, id string, ref string, alt string, qual double, filter string, info string, format string, samples array<string>")
    r = C.refine_vcf(v, ["0", "1"], PEOPLE).first()
    assert r.qual is None or r.qual != r.qual
    assert set(r.gq) == {0}


def test_haploid_rules():
    people = [("F", 0, -1, -1, 1), ("F", 1, -1, -1, 2), ("F", 2, 0, 1, 1)]
    assert C.prior_scale(people, "X") == pytest.approx(1 + 1 / 2 + 1 / 3)
    model = C.Model(people, "X", C.Options(), always_optimise=True)
    lk = np.ones((1, 3, 3))
    lk[0, 0] = [1e-9, 1, 1e-9]  # a father can't be heterozygous there
    _, post = model.llk(lk, np.array([0.5]), marginals=True)
    assert post[0, 0, 1] == 0 and post[0, 2, 1] == 0


def test_lines_of_calls(spark):
    """Labels, PS, BA, DP and PL of handmade calls, by class of chromosome and sex."""
    from kinfold.sources import text as T

    people = [("F", 0, -1, -1, 1), ("F", 1, -1, -1, 2), ("U", 2, -1, -1, 2)]
    row = lambda chrom, ref, a1, a2, config: (chrom, 9, ref, a1, a2, config, 1.0, 99.6, 0.75, 0.5, 2, 20, 31.25, [2, 1, 0], [50, 9, 7], [2.0, 1.0, 0.0], [12, 8, 0], [[90, 30, 0], [20, 0, 25], [0, 0, 0]])
    calls = spark.createDataFrame([row("1", 1, 1, 3, 1), row("X", 1, 1, 3, 1), row("Y", 1, 1, 3, 1), row("1", 2, 1, 3, 4), row("1", 1, 1, 3, 0)], C.CALLS)
    got = [r.value.split("\t") for r in T.call_lines(calls, people).collect()]
    samples = lambda x: [s.split(":")[0] for s in x[9:]]
    assert got[0][:9] == ["1", "10", ".", "A", "G", "100", ".", "NS=2;PS=66.7;DP=20;MQ=31.3;AF=0.7500;AB=0.500", "GT:GQ:DP:DS:PL"]
    assert got[0][9:] == ["1/1:50:12:2.00:90,30,0", "0/1:9:8:1.00:20,0,25", "0/0:7:0:0.00:0,0,0"]
    assert samples(got[1]) == ["1", "0/1", "0/0"] and got[1][7].endswith("AF=0.7500")
    assert samples(got[2]) == ["1", ".", "."]
    assert got[3][3:5] == ["C", "A,G"] and samples(got[3]) == ["2/2", "1/2", "1/1"]
    assert got[4][4] == "." and got[4][7].endswith(";BA=G")
    no_pl = T.call_lines(calls, people, C.Options(gl_off=True)).first().value.split("\t")
    assert no_pl[8] == "GT:GQ:DP:DS" and no_pl[9] == "1/1:50:12:2.00"
    couple = T.call_lines(calls, [("F", 0, -1, -1, 1), ("F", 1, -1, -1, 2), ("F", 2, 0, 1, 2)]).first().value.split("\t")
    assert couple[7] == "NS=2;PS=66.7;DP=20;MQ=31.3"


def test_de_novo_lines(spark):
    """Letters, ten phred values, and NS, PS, DP, MQ, AF, DQ."""
    from kinfold.sources import text as T

    people = [("F", 0, -1, -1, 1), ("F", 1, -1, -1, 2), ("F", 2, 0, 1, 1), ("U", 3, -1, -1, 2)]
    pl = [[30, 0, 40, 50, 60, 70, 80, 90, 100, 110], [0] * 10, [255] * 9 + [0], [7] * 10]
    row = lambda a1, config: ("1", 4, 2, a1, 4, config, 1.0, 61.5, 0.5, 1.25, 3, 30, 59.0, ["C/T", "C/C", "C/C", "C/C"], [100, 9, 8, 3], [10, 12, 8, 0], pl)
    got = [r.value.split("\t") for r in T.denovo_lines(spark.createDataFrame([row(2, 1), row(1, 4), row(2, 0)], C.DENOVO_CALLS), people).collect()]
    assert got[0][:9] == ["1", "5", ".", "C", "T", "62", ".", "NS=3;PS=75.0;DP=30;MQ=59.0;AF=0.5000;DQ=1.250", "GT:GQ:DP:PL"]
    assert got[0][9] == "C/T:100:10:30,0,40,50,60,70,80,90,100,110" and got[0][12] == "C/C:3:0:7,7,7,7,7,7,7,7,7,7"
    assert got[1][4] == "A,T" and got[2][4] == "C"


def test_refined_lines_keep_what_was_there(spark):
    from kinfold.sources import text as T

    v = spark.createDataFrame([("1", 5, "rs1", "A", "G", 1.0, "LOW", ".", "GT:DP:PL", ["0/1:7:30,0,40", "0/0:.:0,20,90", "x"]), ("Y", 6, ".", "A", "G", 1.0, ".", ".", "GT:GL", ["1:-9,-9,0", "0:0,-3,-9", "."])], "chrom string, pos int, id string, ref string, alt string, qual double, filter string, info string, format string, samples array<string>")
    people = [("F", 3, -1, -1, 1), ("F", 4, -1, -1, 2), ("G", 9, -1, -1, 2)]
    names = ["4", "3", "other"]
    got = {r.chrom: r.value.split("\t") for r in T.refined_lines(C.refine_vcf(v, names, people), names, people).collect()}
    one = got["1"]
    assert one[2] == "rs1" and one[6] == "LOW" and one[8] == "GT:GQ:DP:PL" and len(one) == 11
    assert one[7].split(";")[2] == "DP=7" and [x.split(":")[2:] for x in one[9:]] == [["7", "30,0,40"], [".", "0,20,90"]]
    assert got["Y"][8] == "GT:GQ:DP:GL" and got["Y"][9].split(":")[0] == "."


def test_de_novo_options(spark, sf):
    obs = X.gl_obs(spark, sf)
    o = C.Options(denovo=True, rate_denovo=1.5e-7)
    key = lambda df: {(r.chrom, r.pos) for r in df.select("chrom", "pos").collect()}
    all_ = key(C.call_denovo(obs, PEOPLE, o))
    some = C.replace(o, chromosomes=("1",))
    assert key(C.call_denovo(obs, PEOPLE, some)) == {k for k in all_ if k[0] == "1"} != all_
    forced = X.site_list(spark, sf)
    listed = {(r.chrom, r.pos) for r in forced.collect()}
    assert {k for k in all_ if k in listed} <= key(C.call_denovo(obs, PEOPLE, o, forced=forced)) <= listed
    assert all_ <= key(C.call_denovo(obs, PEOPLE, C.replace(o, all_sites=True)))
    assert key(C.call_denovo(obs, PEOPLE, C.replace(o, quick_call=True))) <= all_


def test_many_samples_align_in_order(spark):
    from kinfold.operators import reads

    n = 2_000
    rows = [("1", 5, p, 1 if p % 2 else 2, p % 7, p % 50, [p % 200] * 10) for p in range(1, n, 3)] + [("1", 5, 4, 1, 90, 3, [9] * 10)]
    obs = spark.createDataFrame(rows, "chrom string, pos int, sample_id int, ref_base int, depth int, map_qual int, pl array<smallint>")
    r = reads.align_sites(obs, list(range(n))).first()
    assert len(r.pl) == len(r.depths) == n and r.ref_base == 1
    assert r.depths[4] == 90 and r.pl[4] == [9] * 10 and r.pl[7] == [7] * 10 and r.pl[8] == [0] * 10 and r.depths[8] == 0 and r.map_quals[49] == 49


def test_frequency_precision_is_a_parameter(spark, sf):
    obs = X.gl_obs(spark, sf).where("pos < 900")
    of = lambda prec: {(r.chrom, r.pos): r.ref_freq for r in C.call_variants(obs, PEOPLE, C.Options(prec=prec)).collect()}
    rough, fine, finer = of(1e-2), of(1e-7), of(1e-8)
    assert all(abs(fine[k] - finer[k]) < 1e-5 for k in fine) and any(abs(rough[k] - finer[k]) > 1e-5 for k in fine if k in rough)
