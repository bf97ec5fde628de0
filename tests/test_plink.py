"""The .bed data source: byte ranges, filters that reach it, files above 2 GB, and the writer in place."""

import os

import numpy as np
import pytest

from kinfold.sources import binary as B
from kinfold.sources import plink


def files(folder, dosages, by_marker=True):
    """A data set of dosages [markers, people]; the first half of the markers lies on chromosome 1."""
    markers, people = dosages.shape
    code = np.vectorize({0: 0, 1: 2, 2: 3, -9: 1}.get)(dosages if by_marker else dosages.T)
    pad = np.zeros((code.shape[0], -code.shape[1] % 4), int)
    four = np.concatenate([code, pad], axis=1).reshape(code.shape[0], -1, 4)
    body = (four << np.array([0, 2, 4, 6])).sum(axis=2).astype(np.uint8).tobytes()
    (folder / "t.bed").write_bytes(plink.MAGIC + bytes([by_marker]) + body)
    (folder / "t.bim").write_text("".join(f"{1 + (m >= markers // 2)} snp{m} 0 {m + 1} G A\n" for m in range(markers)))
    (folder / "t.fam").write_text("".join(f"f p{i} 0 0 1 -9\n" for i in range(people)))
    return str(folder / "t")


@pytest.mark.parametrize("by_marker", [True, False])
def test_ranges_and_filters(spark, tmp_path, by_marker):
    want = np.random.default_rng(1).choice([0, 1, 2, -9], (37, 13))
    prefix = files(tmp_path, want, by_marker)
    cells = lambda df: {(r.place, r.person): r.dosage for r in df.collect()}
    every = {(m, p): want[m, p] for m in range(37) for p in range(13)}
    for rows in (1, 5, None):
        assert cells(plink.bed_rows(spark, f"{prefix}.bed", 13, 37, task_rows=rows)) == every
        for places, persons in (([(9, 10)], None), ([(1, 3), (30, 99)], None), ([(6, 9)], [(0, 4)]), (None, [(12, 13)]), ([], None), ([(99, 100)], None)):
            keep = lambda n, runs: runs is None or any(a <= n < b for a, b in runs)
            df = plink.bed_rows(spark, f"{prefix}.bed", 13, 37, places, persons, rows)
            assert cells(df) == {k: v for k, v in every.items() if keep(k[0], places) and keep(k[1], persons)}
            assert cells(df.where("place = 7 or person = 12")) == {k: v for k, v in cells(df).items() if k[0] == 7 or k[1] == 12}
    got = B.read_plink(spark, prefix, chromosomes=["2"])
    assert {(r.marker, r.iid): r.dosage for r in got.collect()} == {(f"snp{m}", f"p{p}"): want[m, p] for m in range(18, 37) for p in range(13)}


def test_only_the_bytes_asked_for(tmp_path):
    prefix = files(tmp_path, np.zeros((1000, 8), int))
    reader = plink.BedReader({"path": f"{prefix}.bed", "people": "8", "markers": "1000", "task_rows": "10", "places": "[[3, 5], [500, 525]]", "persons": "[[0, 2]]"})
    assert [(p.lo, p.hi, p.across) for p in reader.partitions()] == [(a, b, [(0, 2)]) for a, b in ((3, 5), (500, 510), (510, 520), (520, 525))]


def test_more_than_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: its last marker is read at once, and the whole would be many tasks."""
    people, markers = 40_000, 300_000
    with open(tmp_path / "big.bed", "wb") as f:
        f.write(plink.MAGIC + b"\1")
        f.truncate(3 + markers * people // 4)
        f.seek(3 + (markers - 1) * people // 4)
        f.write(bytes([0b11100100]) * (people // 4))
    assert os.path.getsize(tmp_path / "big.bed") > 2 << 30
    df = plink.bed_rows(spark, str(tmp_path / "big.bed"), people, markers)
    assert df.rdd.getNumPartitions() > 500
    last = plink.bed_rows(spark, str(tmp_path / "big.bed"), people, markers, [(markers - 1, markers)]).groupBy("dosage").count()
    assert {r.dosage: r["count"] for r in last.collect()} == dict.fromkeys((0, -9, 1, 2), people // 4)


def test_broken_files(spark, tmp_path):
    prefix = files(tmp_path, np.zeros((5, 5), int))
    with pytest.raises(Exception, match="bytes, not the"):
        plink.bed_rows(spark, f"{prefix}.bed", 5, 6).count()
    (tmp_path / "t.bed").write_bytes(b"no file at all")
    with pytest.raises(Exception, match="no .bed file"):
        plink.bed_rows(spark, f"{prefix}.bed", 5, 5).count()


def test_written_in_place(spark, tmp_path):
    data = bytes(np.random.default_rng(2).integers(0, 256, 9_973, dtype=np.uint8))
    rows = spark.createDataFrame([(at, data[at : at + 10]) for at in range(0, len(data), 10)], "at long, data binary").repartition(7)
    plink.write_bytes(rows, str(tmp_path / "a"), len(data))
    assert (tmp_path / "a").read_bytes() == data
    with pytest.raises(Exception, match="were written"):
        plink.write_bytes(rows.where("at > 0"), str(tmp_path / "b"), len(data))
    plink.write_bytes(rows.limit(0), str(tmp_path / "c"), 0)
    assert (tmp_path / "c").read_bytes() == b"" and sorted(p.name for p in tmp_path.iterdir()) == ["a", "c"]


def test_empty_data_set_round_trip(spark, sf, tmp_path):
    from kinfold.sources import fixtures as X

    B.write_plink(X.vcf_rows(spark, sf).limit(0), ["a", "b"], str(tmp_path / "e"))
    assert (tmp_path / "e.bed").read_bytes() == plink.MAGIC + b"\1"
    assert B.read_plink(spark, str(tmp_path / "e")).count() == 0
