"""Genotype sets and X-linked sibships against plain enumeration."""

import itertools

import numpy as np
import pytest

from kinfold.operators import markers as M
from kinfold.sources import fixtures as X


def prune(people, genotypes, x_linked):
    """Sets of genotypes of each person (pid, fatid, motid, sex), pruned with Python sets."""
    alleles = sorted({a for g in genotypes.values() for a in g} | {0})
    every = {(a, b) for a in alleles for b in alleles if a <= b}
    own = {}
    for p, _, _, sex in people:
        own[p] = {tuple(sorted(genotypes[p]))} if p in genotypes else set(every)
        if x_linked and sex == 1:
            own[p] = {g for g in own[p] if g[0] == g[1]}
    couples, sexes = {}, {p[0]: p[3] for p in people}
    for p, f, m, _ in people:
        if f is not None:
            couples.setdefault((f, m), []).append(p)
    changed = True
    while changed:
        changed = False
        for (f, m), children in couples.items():
            keep = {q: set() for q in (f, m, *children)}
            for x, y in itertools.product(own[f], own[m]):
                can = lambda c: {(b, b) for b in y} if x_linked and sexes[c] == 1 else {(min(a, b), max(a, b)) for a in x for b in y}  # noqa: E731, B023
                left = [own[c] & can(c) for c in children]
                if all(left):
                    keep[f].add(x)
                    keep[m].add(y)
                    for c, some in zip(children, left, strict=True):
                        keep[c] |= some
            for q, some in keep.items():
                if some != own[q]:
                    own[q], changed = some, True
    return own


@pytest.mark.parametrize("x_linked", [False, True])
@pytest.mark.parametrize("n_alleles", [3, 12])
def test_elimination_as_with_sets(spark, x_linked, n_alleles):
    """Few alleles, and so many that a set takes more than one word."""
    rng = np.random.default_rng(n_alleles)
    rows = []
    for marker in range(25):
        for famid, pid, _, _, sex in X.PEDIGREE_EXT:
            if rng.random() < 0.7:
                a, b = rng.integers(1, n_alleles + 1, 2).tolist()
                rows.append((marker, famid, pid, a, a if x_linked and sex == 1 and rng.random() < 0.9 else b))
    geno = spark.createDataFrame(rows, "marker long, famid string, pid int, a1 int, a2 int")
    got = {(r.marker, r.famid, r.pid): r.possible for r in M.eliminate_genotypes(geno, X.pedigree(spark, X.PEDIGREE_EXT), x_linked).collect()}
    by = {}
    for marker, famid, pid, a, b in rows:
        by.setdefault((marker, famid), {})[pid] = (a, b)
    want = {}
    for (marker, famid), g in by.items():
        people = [(p, f if f >= 0 else None, m if m >= 0 else None, s) for fam, p, f, m, s in X.PEDIGREE_EXT if fam == famid]
        for q, left in prune(people, g, x_linked).items():
            want[marker, famid, q] = ",".join(f"{a}/{b}" for a, b in sorted(left))
    assert got == want
    assert any(v == "" for v in want.values()) and any(v for v in want.values())


def test_what_is_left_is_what_families_can_have(spark):
    """In a family without loops pruning leaves just the genotypes of consistent families: all of them are enumerated."""
    people = [("F", 0, -1, -1, 1), ("F", 1, -1, -1, 2), ("F", 2, 0, 1, 2), ("F", 3, -1, -1, 1), ("F", 4, 3, 2, 1)]
    typed = {0: (1, 2), 4: (2, 3)}
    geno = spark.createDataFrame([(1, "F", p, *g) for p, g in typed.items()], "marker long, famid string, pid int, a1 int, a2 int")
    got = {r.pid: r.possible for r in M.eliminate_genotypes(geno, X.pedigree(spark, people)).collect()}
    every = [(a, b) for a in (0, 1, 2, 3) for b in (0, 1, 2, 3) if a <= b]
    can = lambda c, f, m: any(tuple(sorted((a, b))) == c for a in f for b in m)
    left = {p: set() for p in range(5)}
    for g in itertools.product(*[[typed[p]] if p in typed else every for p in range(5)]):
        if can(g[2], g[0], g[1]) and can(g[4], g[3], g[2]):
            for p in range(5):
                left[p].add(g[p])
    assert got == {p: ",".join(f"{a}/{b}" for a, b in sorted(x)) for p, x in left.items()}


def test_x_linked_sibships(spark):
    ped = [("S", 0, -1, -1, 1), ("S", 1, -1, -1, 2), *[("S", p, 0, 1, 1 + p % 2) for p in range(2, 8)]]  # even: sons, odd: daughters
    cases = {
        1: {2: (1, 1), 4: (2, 2), 6: (3, 3)},  # three alleles of sons
        2: {3: (1, 2), 5: (1, 3), 7: (1, 2)},  # the father has 1, the mother 2 and 3
        3: {3: (1, 2), 5: (1, 3), 7: (2, 3)},  # no allele of all sisters
        4: {3: (1, 1), 5: (1, 2), 2: (3, 3)},  # the mother has 1, 2 and 3
        5: {0: (1, 1), 3: (1, 2), 5: (1, 3), 2: (4, 4)},
        6: {1: (2, 3), 3: (1, 2), 5: (1, 3), 2: (3, 3)},
        7: {0: (1, 2), 3: (3, 4)},  # a father with two alleles tells nothing
        8: {1: (1, 2), 2: (3, 3)},  # reported for the son alone
        9: {3: (1, 2), 5: (1, 2)},
        10: {1: (2, 3), 3: (2, 4), 5: (3, 5)},  # each sister fits her mother, no father has 4 and 5
    }
    geno = spark.createDataFrame([(m, "S", p, *g) for m, x in cases.items() for p, g in x.items()], "marker long, famid string, pid int, a1 int, a2 int")
    pedigree = X.pedigree(spark, ped)
    assert {r.marker for r in M.mendel_errors_x_sibships(geno, pedigree).collect()} == {1, 3, 4, 5, 10}
    assert {(r.marker, r.pid, r.problem) for r in M.mendel_errors_x(geno, pedigree).collect()} == {(7, 0, "het_male"), (8, 2, "son")}
    assert M.mendel_errors_x_sibships(geno.limit(0), pedigree).count() == 0


def test_spearman_by_differences_of_ranks(spark):
    """z_d and p_d from mid-ranks worked out in plain Python."""
    import math

    rng = np.random.default_rng(8)
    rows = [(int(a), int(a * 0.3 + rng.integers(0, 9))) for a in rng.integers(0, 12, 80)]
    ranks = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    x, y = ranks([a for a, _ in rows]), ranks([b for _, b in rows])
    ties = lambda v: sum(v.count(u) ** 3 - v.count(u) for u in set(v))
    n, d2 = len(rows), sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    en, tx, ty = n**3 - n, ties(x), ties(y)
    z = (d2 - (en / 6 - (tx + ty) / 12)) / math.sqrt((n - 1) * n**2 * (n + 1) ** 2 / 36 * (1 - tx / en) * (1 - ty / en))
    got = M.spearman(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()
    assert (got.z_d, got.p_d) == pytest.approx((z, math.erfc(abs(z) / math.sqrt(2))))
    assert M.spearman(spark.createDataFrame([(1, 2), (1, 3)], "x int, y int"), "x", "y").first().p_d is None
