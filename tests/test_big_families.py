"""Kinship, connected parts and trimming by joins against plain recursion, in families with parts, loops and twins."""

import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from kinfold.operators import pedigrees as P
from kinfold.sources import fixtures as X

SCHEMA = "famid string, pid int, fatid int, motid int, sex int"


def random_family(seed, n=40, famid="R"):
    """Persons of several parts and varying depth; parents may be related."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        men, women = [r[1] for r in rows if r[4] == 1], [r[1] for r in rows if r[4] == 2]
        founder = not men or not women or rng.random() < 0.35
        # ids don't follow birth
        rows.append((famid, (i * 17) % n, -1 if founder else rng.choice(men), -1 if founder else rng.choice(women), 1 + rng.randrange(2)))
    rng.shuffle(rows)
    return rows


def brute_kinship(rows, x_linked):
    who = {r[1]: r for r in rows}

    @cache
    def depth(p):
        return 0 if who[p][2] < 0 else 1 + max(depth(who[p][2]), depth(who[p][3]))

    @cache
    def phi(a, b):
        if (depth(a), a) < (depth(b), b):
            a, b = b, a
        _, _, f, m, sex = who[a]
        male = x_linked and sex == 1
        if a == b:
            return 1.0 if male else 0.5 + (0.5 * phi(f, m) if f >= 0 else 0)
        if f < 0:
            return 0.0
        return phi(m, b) if male else (phi(f, b) + phi(m, b)) / 2

    return {(a, b): phi(a, b) for a in who for b in who if a <= b}


@pytest.mark.parametrize("x_linked", [False, True])
def test_kinship_of_related_parents(spark, x_linked):
    rows = random_family(4) + random_family(5, 25, "S")
    got = P.kinship(spark.createDataFrame(rows, SCHEMA), x_linked).collect()
    want = {(f, *k): v for f in "RS" for k, v in brute_kinship([r for r in rows if r[0] == f], x_linked).items()}
    assert {(r.famid, r.pid1, r.pid2): r.phi for r in got} == pytest.approx(want)
    inbred = {f: any(r[2] >= 0 and not (x_linked and r[4] == 1) and want[f, min(r[2:4]), max(r[2:4])] > 0 for r in rows if r[0] == f) for f in "RS"}
    assert {r.famid: r.inbred for r in got} == inbred and any(inbred.values())


def test_kinship_of_twins(spark):
    rows = [(*r, 0) for r in X.PEDIGREE12[:4]]
    rows[2], rows[3] = (*rows[2][:5], 3), (*rows[3][:4], 2, 3)
    rows += [("F1", 20, -1, -1, 1, 0), ("F1", 21, 20, 3, 1, 0), ("F1", 22, 20, 2, 2, 0)]
    phi = {(r.pid1, r.pid2): r.phi for r in P.kinship(spark.createDataFrame(rows, SCHEMA + ", zygosity int")).collect()}
    assert (phi[2, 3], phi[3, 3], phi[2, 21], phi[3, 22], phi[0, 3], phi[21, 22]) == (0.5, 0.5, 0.25, 0.25, 0.25, 0.25)


def test_kinship_of_one_very_large_family(spark):
    """20,000 persons under one id: couples with children, whose pairs alone are in the table."""
    n = 5_000
    ped = spark.range(n).selectExpr("'F' as famid", "explode(array(struct(cast(4 * id as int) as pid, -1 as fatid, -1 as motid, 1 as sex), struct(cast(4 * id + 1 as int) as pid, -1 as fatid, -1 as motid, 2 as sex), struct(cast(4 * id + 2 as int) as pid, cast(4 * id as int) as fatid, cast(4 * id + 1 as int) as motid, 1 as sex), struct(cast(4 * id + 3 as int) as pid, cast(4 * id as int) as fatid, cast(4 * id + 1 as int) as motid, 2 as sex))) as x").select("famid", "x.*")
    got = P.kinship_pairs(ped).groupBy("phi").count().collect()
    assert {r.phi: r["count"] for r in got} == {0.5: 4 * n, 0.25: 5 * n}


def test_an_own_ancestor(spark):
    with pytest.raises(ValueError, match="ancestor of itself"):
        P.kinship(spark.createDataFrame([("F", 0, 1, 2, 1), ("F", 1, 0, 2, 1), ("F", 2, -1, -1, 2)], SCHEMA))


@pytest.mark.parametrize("seed", range(3))
def test_parts(spark, seed):
    rng = random.Random(seed)
    # long chains, whose labels take several rounds, and persons of another family under the same ids
    chain = [("C", i, -1 if i == 0 else i - 1, -1 if i == 0 else 100 + i, 1) for i in range(30)] + [("C", 100 + i, -1, -1, 2) for i in range(30)]
    rows = random_family(seed) + [("S", *r[1:]) for r in random_family(seed + 9, 15)] + chain + [("A", 1, 77, 78, 1)]
    rng.shuffle(rows)
    root = {(r[0], r[1]): (r[0], r[1]) for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for f, p, a, b, _ in rows:
        for q in (a, b):
            if (f, q) in root:
                lo, hi = sorted((find((f, p)), find((f, q))))
                root[hi] = lo
    got = {(r.famid, r.pid): r.grp for r in P.connected_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {x: find(x)[1] for x in root}


def brute_trim(rows, data):
    people = {r[1]: (r[2], r[3]) if r[2] >= 0 else None for r in rows}
    if not data & set(people):
        return {}
    while True:
        children = {}
        for p, parents in people.items():
            for q in parents or ():
                children.setdefault(q, set()).add(p)
        leaf = next((p for p in people if p not in data and p not in children), None)
        if leaf is not None:
            del people[leaf]
            continue
        child = next((c for c, ps in people.items() if ps and all(q in people and people[q] is None and q not in data and children[q] == {c} for q in ps)), None)
        if child is None:
            return people
        for q in people[child]:
            del people[q]
        people[child] = None


@pytest.mark.parametrize("seed", range(3))
def test_trimming(spark, seed):
    rng = random.Random(seed)
    rows = random_family(seed) + random_family(seed + 20, 30, "S") + [("N", 1, -1, -1, 1)]
    data = {f: {r[1] for r in rows if r[0] == f and rng.random() < 0.15} for f in "RSN"}
    data["N"] = set()
    have = spark.createDataFrame([(f, p) for f, ps in data.items() for p in ps], "famid string, pid int")
    got = {(r.famid, r.pid): (r.fatid, r.motid) if r.fatid is not None else None for r in P.trim(spark.createDataFrame(rows, SCHEMA), have).collect()}
    assert got == {(f, p): x for f in "RSN" for p, x in brute_trim([r for r in rows if r[0] == f], data[f]).items()}
