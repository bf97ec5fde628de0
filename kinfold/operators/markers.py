"""Marker genotypes in long form (marker, famid, pid, a1, a2; 0 or null: missing): frequencies, checks, sharing, phase.

Pedigrees are small beside genotypes and are broadcast up to a counted number of persons; the one shuffle is by marker and
family, with the missing genotypes dropped before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.kernels import chi2_tail, normal_quantile, t_tail
from kinfold.functions.lineage import written
from kinfold.functions.scalars import ibs, let
from kinfold.operators.pedigrees import with_nulls
from kinfold.operators.scans import prefix_sums

#: Persons of a pedigree that may be broadcast: 40 bytes each.
MAX_PERSONS = 500_000
#: Rows of children that a task gathers into sibships.
CHILDREN_A_TASK = 250_000


def small(ped: DataFrame) -> DataFrame:
    return F.broadcast(ped) if ped.limit(MAX_PERSONS + 1).count() <= MAX_PERSONS else ped


def typed(geno: DataFrame) -> DataFrame:
    return geno.where("a1 > 0 and a2 > 0")


def allele_counts(geno: DataFrame, ped: DataFrame, founders_only: bool = False, x_label: str = "X") -> DataFrame:
    """marker, allele, n; on X a male's allele counts once. geno may have a chrom."""
    p = small(with_nulls(ped).select("famid", "pid", "fatid", "sex"))
    j = typed(geno).join(p, ["famid", "pid"])
    if founders_only:
        j = j.where("fatid is null")
    once = (F.col("chrom") == x_label) & (F.col("sex") == 1) if "chrom" in geno.columns else F.lit(False)
    alleles = F.when(once, F.array("a1")).otherwise(F.array("a1", "a2"))
    return j.select("marker", F.explode(alleles).alias("allele")).groupBy("marker", "allele").agg(F.count("*").alias("n"))


def allele_frequencies(geno: DataFrame, ped: DataFrame, estimator: str = "founders", existing: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """marker, allele, freq by estimator founders, all or equal. An allele seen but in no founder counts once, and where no
    founder is typed all persons count. A marker (of the table markers) at which nobody is typed has alleles 1 and 2 with
    0.99999 and 0.00001; given frequencies (marker, allele, freq) win for their markers."""
    seen = allele_counts(geno, ped)
    if estimator == "equal":
        counts = seen.withColumn("n", F.lit(1))
    elif estimator == "founders":
        f = allele_counts(geno, ped, founders_only=True).withColumnRenamed("n", "nf")
        typed_founders = F.sum("nf").over(Window.partitionBy("marker")).isNotNull()
        counts = seen.join(f, ["marker", "allele"], "left").select("marker", "allele", F.when(typed_founders, F.coalesce("nf", F.lit(1))).otherwise(F.col("n")).alias("n"))
    else:
        counts = seen
    total = counts.groupBy("marker").agg(F.sum("n").alias("t"))
    out = counts.join(total, "marker").select("marker", "allele", (F.col("n") / F.col("t")).alias("freq"))
    if markers is not None:
        untyped = markers.select("marker").distinct().join(seen.select("marker").distinct(), "marker", "left_anti")
        two = F.explode(F.array(*[F.struct(F.lit(a).cast(seen.schema["allele"].dataType).alias("allele"), F.lit(x).alias("freq")) for a, x in ((1, 0.99999), (2, 0.00001))]))
        out = out.unionByName(untyped.select("marker", two.alias("x")).select("marker", "x.*"))
    if existing is not None:
        out = out.join(existing.select("marker").distinct(), "marker", "left_anti").unionByName(existing.select("marker", "allele", "freq"))
    return out


def scale_frequencies(freq: DataFrame) -> DataFrame:
    """marker, allele, freq scaled to sum 1 in each marker."""
    return freq.withColumn("freq", F.col("freq") / F.sum("freq").over(Window.partitionBy("marker")))


def lump_alleles(counts: DataFrame, threshold: float) -> DataFrame:
    """marker, allele, code: alleles renumbered by falling count (equal counts by name); those with at most
    int(total * threshold) share the last number and the name OTHER."""
    w = Window.partitionBy("marker")
    rows = counts.withColumn("rare", F.col("n") <= F.floor(F.sum("n").over(w) * threshold))
    rank = F.row_number().over(w.orderBy("rare", F.desc("n"), "allele"))
    common = F.count(F.when(~F.col("rare"), 1)).over(w)
    return rows.select("marker", "allele", F.when(F.col("rare"), common + 1).otherwise(rank).cast("int").alias("code"), F.when(F.col("rare"), F.lit("OTHER")).otherwise(F.col("allele").cast("string")).alias("label"))


def _with_parents(geno: DataFrame, ped: DataFrame) -> DataFrame:
    """Each child's genotype beside its parents', null where untyped."""
    g = typed(geno).select("marker", "famid", "pid", "a1", "a2")
    child = g.join(small(with_nulls(ped).where("fatid is not null")), ["famid", "pid"])
    parent = lambda who, a: g.select("marker", "famid", F.col("pid").alias(who), F.col("a1").alias(f"{a}1"), F.col("a2").alias(f"{a}2"))
    return child.join(parent("fatid", "f"), ["marker", "famid", "fatid"], "left").join(parent("motid", "m"), ["marker", "famid", "motid"], "left")


def mendel_errors(geno: DataFrame, ped: DataFrame) -> DataFrame:
    """marker, famid, pid of children whose genotype their typed parents can't have passed, on autosomes."""
    j = _with_parents(geno, ped)
    has = lambda allele, p: F.col(f"{p}1").isNull() | (F.col(allele) == F.col(f"{p}1")) | (F.col(allele) == F.col(f"{p}2"))
    fits = (has("a1", "f") & has("a2", "m")) | (has("a2", "f") & has("a1", "m"))
    return j.where(~fits).select("marker", "famid", "pid")


def without_het_males(geno: DataFrame, ped: DataFrame) -> DataFrame:
    """X-linked genotypes less those of males with two alleles, which are reported by themselves and tell nothing of others."""
    males = small(with_nulls(ped).where("sex = 1").select("famid", "pid", F.lit(True).alias("_male")))
    g = typed(geno).join(males, ["famid", "pid"], "left")
    return g.where(F.col("_male").isNull() | (F.col("a1") == F.col("a2"))).drop("_male")


def _fits_x(j: DataFrame) -> Column:
    """Whether a child's X-linked genotype can come from its typed parents. A father's alleles are equal."""
    in_m = lambda a: F.col("m1").isNull() | (F.col(a) == F.col("m1")) | (F.col(a) == F.col("m2"))
    of_f = lambda a: F.col("f1").isNull() | (F.col(a) == F.col("f1"))
    return F.when(F.col("sex") == 1, in_m("a1")).when(F.col("sex") == 2, (of_f("a1") & in_m("a2")) | (of_f("a2") & in_m("a1"))).otherwise(F.lit(True))


def mendel_errors_x(geno: DataFrame, ped: DataFrame) -> DataFrame:
    """marker, famid, pid, problem: heterozygous males, whose genotypes are then left out, sons against their mother, daughters
    against both parents."""
    p = small(with_nulls(ped).select("famid", "pid", "sex"))
    het = typed(geno).join(p, ["famid", "pid"]).where("sex = 1 and a1 <> a2").select("marker", "famid", "pid", F.lit("het_male").alias("problem"))
    j = _with_parents(without_het_males(geno, ped), ped)
    child = j.where(~_fits_x(j)).select("marker", "famid", "pid", F.when(F.col("sex") == 1, "son").otherwise("daughter").alias("problem"))
    return het.unionByName(child)


def _spread(children: DataFrame) -> DataFrame:
    """The rows, a family's at a marker together, in as many partitions as hold CHILDREN_A_TASK each. They are written once before,
    where they are counted; sibships are then gathered behind this shuffle alone, not in the few tasks that read a small table of markers."""
    rows = written(children)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // CHILDREN_A_TASK))
    return rows.repartition(n, "marker", "famid")


def mendel_errors_x_sibships(geno: DataFrame, ped: DataFrame) -> DataFrame:
    """marker, famid, fatid, motid of sibships that no parents can have, though each child fits its typed parents.

    Constraints are folded: the father's allele is his own or one that all sisters share; given it, each sister's other allele and each
    brother's allele are the mother's, who has two, her own if she is typed. Sibships with no such father's allele are errors. Only
    distinct genotypes are folded, so that a row holds as many as there are kinds."""
    j = _with_parents(without_het_males(geno, ped), ped)
    kinds = j.where(_fits_x(j) & F.col("sex").isin(1, 2)).select("marker", "famid", "fatid", "motid", "sex", F.least("a1", "a2").alias("lo"), F.greatest("a1", "a2").alias("hi"), "f1", "m1", "m2")
    kind = F.struct("lo", "hi")
    s = _spread(kinds).groupBy("marker", "famid", "fatid", "motid").agg(F.max("f1").alias("f"), F.max("m1").alias("m1"), F.max("m2").alias("m2"), F.collect_set(F.when(F.col("sex") == 1, F.col("lo"))).alias("sons"), F.collect_set(F.when(F.col("sex") == 2, kind)).alias("sisters"))
    alleles = F.transform("sisters", lambda k: F.array(k["lo"], k["hi"]))
    shared = F.aggregate(alleles, F.get(alleles, F.lit(0)), F.array_intersect)
    fathers = F.when(F.size("sisters") == 0, F.array(F.lit(0))).when(F.col("f").isNotNull(), F.array("f")).otherwise(shared)
    of_mother = lambda x: F.array_distinct(F.concat("sons", F.transform("sisters", lambda k: F.when(k["lo"] == x, k["hi"]).otherwise(k["lo"]))))
    fits = lambda x: F.when(F.col("m1").isNotNull(), F.size(F.array_except(of_mother(x), F.array("m1", "m2"))) == 0).otherwise(F.size(of_mother(x)) <= 2)
    return s.where(~F.exists(fathers, fits)).select("marker", "famid", "fatid", "motid")


def sibship_errors(geno: DataFrame, ped: DataFrame) -> DataFrame:
    """marker, famid, fatid, motid of sibships with more than four genotypes, with alleles and homozygous kinds together
    over four, or with four alleles of which one stands in over two genotypes."""
    c = typed(geno).join(small(with_nulls(ped).where("fatid is not null")), ["famid", "pid"])
    keys = ["marker", "famid", "fatid", "motid"]
    # one state a sibship: its distinct genotypes, no more than it has typed children
    c = _spread(c.select(*keys, F.least("a1", "a2").alias("lo"), F.greatest("a1", "a2").alias("hi")))
    s = c.groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi")).alias("kinds"))
    alleles = F.array_distinct(F.flatten(F.transform("kinds", lambda k: F.array(k["lo"], k["hi"]))))
    most = lambda a: F.array_max(F.transform(a, lambda x: F.size(F.filter("kinds", lambda k: (k["lo"] == x) | (k["hi"] == x)))))
    hom = F.size(F.filter("kinds", lambda k: k["lo"] == k["hi"]))
    wrong = lambda a: (F.size("kinds") > 4) | (F.size(a) + hom > 4) | ((F.size(a) == 4) & (most(a) > 2))
    return s.where(let(alleles, wrong)).select(*keys)


def sib_sharing(geno: DataFrame, ped: DataFrame) -> DataFrame:
    """marker, famid, pid1, pid2, ibs: alleles shared by state of full sibs."""
    c = typed(geno).join(small(with_nulls(ped).where("fatid is not null")), ["famid", "pid"]).select("marker", "famid", "fatid", "motid", "pid", "a1", "a2")
    one = c.withColumnsRenamed({"pid": "pid1", "a1": "x1", "a2": "x2"})
    two = c.withColumnsRenamed({"pid": "pid2", "a1": "y1", "a2": "y2"})
    j = one.join(two, ["marker", "famid", "fatid", "motid"]).where("pid1 < pid2")
    return j.select("marker", "famid", "pid1", "pid2", ibs(F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2")).alias("ibs"))


def sib_ibd(geno: DataFrame, ped: DataFrame) -> DataFrame:
    """marker, famid, pid1, pid2, p0, p1, p2 of full sibs: the share of the equally likely ways to pass the four parental
    alleles that explain both genotypes; (1/4, 1/2, 1/4) if a sib or a parent is untyped or nothing explains them."""
    p = with_nulls(ped).where("fatid is not null")
    sib = small(p.select("famid", "fatid", "motid", F.col("pid").alias("pid1")).join(p.select("famid", "fatid", "motid", F.col("pid").alias("pid2")), ["famid", "fatid", "motid"]).where("pid1 < pid2"))
    g = typed(geno).select("marker", "famid", "pid", "a1", "a2")
    markers = g.select("marker", "famid").distinct()
    j = markers.join(sib, "famid")
    for who, a in (("pid1", "x"), ("pid2", "y"), ("fatid", "f"), ("motid", "m")):
        j = j.join(g.select("marker", "famid", F.col("pid").alias(who), F.col("a1").alias(f"{a}1"), F.col("a2").alias(f"{a}2")), ["marker", "famid", who], "left")
    fits = lambda s, i, k: ((F.col(f"{s}1") == F.col(f"f{i}")) & (F.col(f"{s}2") == F.col(f"m{k}"))) | ((F.col(f"{s}2") == F.col(f"f{i}")) & (F.col(f"{s}1") == F.col(f"m{k}")))
    ways: dict[int, list[Column]] = {0: [], 1: [], 2: []}
    for i in (1, 2):
        for k in (1, 2):
            for i2 in (1, 2):
                for k2 in (1, 2):
                    ways[(i == i2) + (k == k2)].append(F.coalesce((fits("x", i, k) & fits("y", i2, k2)).cast("int"), F.lit(0)))
    n = [sum(ways[z], F.lit(0)) for z in range(3)]
    total = n[0] + n[1] + n[2]
    known = F.coalesce((total > 0), F.lit(False))
    default = (0.25, 0.5, 0.25)
    return j.select("marker", "famid", "pid1", "pid2", *[F.when(known, n[z] / total).otherwise(F.lit(default[z])).alias(f"p{z}") for z in range(3)])


def phase_trios(geno: DataFrame, ped: DataFrame) -> DataFrame:
    """marker, famid, pid, paternal, maternal of children whose alleles' origin is unique; null where it is not."""
    j = _with_parents(geno, ped)
    has = lambda a, p: F.col(f"{p}1").isNull() | (F.col(a) == F.col(f"{p}1")) | (F.col(a) == F.col(f"{p}2"))
    one, two = has("a1", "f") & has("a2", "m"), has("a2", "f") & has("a1", "m")
    hom = F.col("a1") == F.col("a2")
    paternal = F.when(hom & one, F.col("a1")).when(one & ~two, F.col("a1")).when(two & ~one, F.col("a2"))
    maternal = F.when(hom & one, F.col("a1")).when(one & ~two, F.col("a2")).when(two & ~one, F.col("a1"))
    return j.select("marker", "famid", "pid", paternal.alias("paternal"), maternal.alias("maternal"))


class Elimination:
    """Genotype sets as bit masks, and their pruning over many markers of families of one shape and count of alleles.

    Genotype (i, j), i <= j, of alleles numbered 0..n-1 is a bit; a set is one or more 64-bit words."""

    #: Elements of the largest temporary array.
    CELLS = 1 << 22

    def __init__(self, n_alleles: int, x_linked: bool):
        self.pairs = [(i, j) for i in range(n_alleles) for j in range(i, n_alleles)]
        self.at = {p: k for k, p in enumerate(self.pairs)}
        self.words, self.x = -(-len(self.pairs) // 64), x_linked
        self.bit = np.stack([self.mask([k]) for k in range(len(self.pairs))])
        self.every, self.same = self.mask(range(len(self.pairs))), self.mask([k for k, (i, j) in enumerate(self.pairs) if i == j])
        pair = lambda a, b: self.at[min(a, b), max(a, b)]
        n = len(self.pairs)
        self.child, self.son = np.zeros((n, n, self.words), np.uint64), np.zeros((n, n, self.words), np.uint64)
        for f, x in enumerate(self.pairs):
            for m, y in enumerate(self.pairs):
                self.child[f, m] = self.mask({pair(a, b) for a in x for b in y})
                self.son[f, m] = self.mask({pair(b, b) for b in y})

    def mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for k in bits:
            out[k // 64] |= np.uint64(1 << k % 64)
        return out

    def start(self, g: np.ndarray, sex: list[int]) -> np.ndarray:
        """[S, n, words] of genotypes g [S, n, 2] (-1: untyped)."""
        lo, hi = g.min(axis=2), g.max(axis=2)
        index = np.full(len(self.pairs), 0)
        table = np.full((max(p[1] for p in self.pairs) + 1,) * 2, 0)
        for k, (i, j) in enumerate(self.pairs):
            table[i, j] = k
        index = table[np.maximum(lo, 0), np.maximum(hi, 0)]
        out = np.where((lo >= 0)[:, :, None], self.bit[index], self.every)
        if self.x:
            males = np.array([s == 1 for s in sex])
            out[:, males] &= self.same  # a typed male with two alleles has none left
        return out

    def prune(self, own: np.ndarray, couples: dict[tuple[int, int], list[int]], sex: list[int]) -> np.ndarray:
        """Sets that no nuclear family narrows further; all that a family's conflict reaches become empty."""
        step = max(1, self.CELLS // (len(self.pairs) ** 2 * self.words))
        out = own.copy()
        for lo in range(0, len(own), step):
            part = out[lo : lo + step]
            changed = np.arange(len(part))
            while len(changed):
                now = part[changed]
                for (f, m), children in couples.items():
                    self.family(now, f, m, children, sex)
                moved = (now != part[changed]).any(axis=(1, 2))
                part[changed] = now
                changed = changed[moved]
        return out

    def family(self, own: np.ndarray, f: int, m: int, children: list[int], sex: list[int]) -> None:
        """Narrow a couple and its children in place."""
        has = lambda p: ((own[:, p, None, :] & self.bit[None]) != 0).any(axis=2)  # noqa: E731  [S, G]
        fits = has(f)[:, :, None] & has(m)[:, None, :]
        can = [self.son if self.x and sex[c] == 1 else self.child for c in children]
        left = [own[:, c, None, None, :] & t[None] for c, t in zip(children, can, strict=True)]
        for some in left:
            fits &= (some != 0).any(axis=3)
        own[:, f] = np.bitwise_or.reduce(np.where(fits.any(axis=2)[:, :, None], self.bit[None], np.uint64(0)), axis=1)
        own[:, m] = np.bitwise_or.reduce(np.where(fits.any(axis=1)[:, :, None], self.bit[None], np.uint64(0)), axis=1)
        for c, some in zip(children, left, strict=True):
            own[:, c] = np.bitwise_or.reduce(np.where(fits[:, :, :, None], some, np.uint64(0)), axis=(1, 2))

    def listed(self, mask: np.ndarray) -> list[tuple[int, int]]:
        return [p for k, p in enumerate(self.pairs) if int(mask[k // 64]) >> (k % 64) & 1]


def eliminate_genotypes(geno: DataFrame, ped: DataFrame, x_linked: bool = False) -> DataFrame:
    """marker, famid, pid, possible (genotypes "a/b" that no nuclear family rules out, sorted), pruned family by family until
    nothing changes; an empty list tells of an inconsistency. Untyped persons start with all pairs of the marker's alleles
    in the family and one further allele, 0. X-linked, males have equal alleles (a typed one with two has none left), sons come
    from their mother alone. One row holds a family at a marker; families of equal shape are pruned together."""
    g = typed(geno).select("marker", "famid", "pid", F.array("a1", "a2").alias("g"))
    per = g.groupBy("marker", "famid").agg(F.map_from_entries(F.collect_list(F.struct("pid", "g"))).alias("m"))
    person = F.struct("pid", F.coalesce("fatid", F.lit(-1)).alias("fatid"), F.coalesce("motid", F.lit(-1)).alias("motid"), F.coalesce("sex", F.lit(0)).alias("sex"))
    family = with_nulls(ped).groupBy("famid").agg(F.sort_array(F.collect_list(person)).alias("people"))
    place = lambda c: F.transform(c, lambda q: (F.array_position("people.pid", q) - 1).cast("int"))
    family = family.select("famid", F.col("people.pid").alias("pids"), place("people.fatid").alias("father"), place("people.motid").alias("mother"), F.col("people.sex").alias("sex"))
    alleles = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.flatten(F.map_values("m")))))
    rows = per.join(small(family), "famid").withColumn("alleles", alleles)
    number = F.transform("pids", lambda p: F.transform(F.coalesce(F.try_element_at("m", p), F.array(F.lit(-1), F.lit(-1))), lambda a: (F.array_position("alleles", a) - 1).cast("int")))
    rows = rows.select("marker", "famid", "pids", "father", "mother", "sex", "alleles", F.flatten(number).alias("g"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Elimination] = {}
        for pdf in batches:
            shape = [(tuple(f), tuple(m), tuple(x), len(a)) for f, m, x, a in zip(pdf["father"], pdf["mother"], pdf["sex"], pdf["alleles"], strict=True)]
            for (father, mother, sex, n), part in pdf.groupby(pd.Series(shape, index=pdf.index)):
                if n not in made:
                    made[n] = Elimination(n, x_linked)
                e, couples = made[n], {}
                for c, (f, m) in enumerate(zip(father, mother, strict=True)):
                    if f >= 0 and m >= 0:
                        couples.setdefault((f, m), []).append(c)
                own = e.start(np.stack(part["g"].to_numpy()).reshape(len(part), len(father), 2), list(sex))
                left = e.prune(own, couples, list(sex))
                out = []
                for marker, famid, pids, names, masks in zip(part["marker"], part["famid"], part["pids"], part["alleles"], left, strict=True):
                    out += [(marker, famid, q, ",".join(f"{names[i]}/{names[j]}" for i, j in e.listed(mask))) for q, mask in zip(pids, masks, strict=True)]
                yield pd.DataFrame(out, columns=["marker", "famid", "pid", "possible"])

    return rows.mapInPandas(run, "marker long, famid string, pid int, possible string")


#: Slices of a trait's values that are ranked by themselves.
SLICES = 64


def mid_ranks(values: DataFrame) -> DataFrame:
    """trait, value, rank (mean 0-based rank of equal values), n, for each distinct value. Counts come first; the distinct
    values of a trait are dealt into slices at approximate quantiles, ranked within a slice, and raised by what the
    slices below hold, so that no task has a whole trait. Where the quantiles lie does not change a rank."""
    counts = values.where("value is not null").groupBy("trait", "value").agg(F.count("*").alias("k"))
    cuts = counts.groupBy("trait").agg(F.percentile_approx(F.col("value").cast("double"), [i / SLICES for i in range(1, SLICES)], 1_000).alias("cuts"))
    sliced = counts.join(cuts, "trait").select("trait", "value", "k", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("slice"))
    below = Window.partitionBy("trait").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = sliced.groupBy("trait", "slice").agg(F.sum("k").alias("s")).select("trait", "slice", F.coalesce(F.sum("s").over(below), F.lit(0)).alias("base"), F.sum("s").over(Window.partitionBy("trait")).alias("n"))
    within = Window.partitionBy("trait", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.select("*", F.coalesce(F.sum("k").over(within), F.lit(0)).alias("own")).join(whole, ["trait", "slice"])
    return ranked.select("trait", "value", "k", (F.col("base") + F.col("own") + (F.col("k") - 1) / 2).alias("rank"), "n")


def inverse_normal(values: DataFrame) -> DataFrame:
    """Adds z, the normal quantile of (mid-rank + 1/2) / n in the trait; null values keep null."""

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return pd.Series(normal_quantile(p.to_numpy()))

    r = mid_ranks(values)
    z = r.select("trait", "value", quantile((F.col("rank") + 0.5) / F.col("n")).alias("z"))
    return values.join(z, ["trait", "value"], "left")


def dichotomize(values: DataFrame, founders: DataFrame) -> DataFrame:
    """Adds status: non-founders with a value get 2 above the trait's mean over non-founders, else 1; others 0."""
    v = values.join(founders.select("famid", "pid", F.lit(True).alias("founder")), ["famid", "pid"], "left")
    counts = F.col("founder").isNull() & F.col("value").isNotNull()
    mean = v.where(counts).groupBy("trait").agg(F.avg("value").alias("mean"))
    return v.join(mean, "trait", "left").select("famid", "pid", "trait", "value", F.when(~counts, 0).when(F.col("value") > F.col("mean"), 2).otherwise(1).alias("status"))


def contingency(rows: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, o (observed), e (expected), r and c (the sums of its row and column), n, of the cells with any count."""
    o = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("o"))
    r, c = o.groupBy("x").agg(F.sum("o").alias("r")), o.groupBy("y").agg(F.sum("o").alias("c"))
    n = o.agg(F.sum("o").alias("n"))
    return o.join(r, "x").join(c, "y").crossJoin(F.broadcast(n)).select("x", "y", "o", (F.col("r") * F.col("c") / F.col("n")).alias("e"), "r", "c", "n")


def chi_square(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: chi2, df, p, neg_log10_p (99.999 at most), cramer_v, contingency_c. x and y are categories. Cells without a
    count add what they are expected to hold, so that n * (sum of o * o / (r * c) - 1) needs the others alone."""
    t = contingency(rows, x, y)
    s = t.agg((F.max("n") * (F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))) - 1)).alias("chi2"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"), F.max("n").alias("n"))
    s = s.select("chi2", ((F.col("nx") - 1) * (F.col("ny") - 1)).alias("df"), "n", F.least(F.col("nx"), F.col("ny")).alias("least"))

    @F.pandas_udf("double")
    def tail(chi2: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(a, int(b)) for a, b in zip(chi2, df, strict=True)])

    s = s.withColumn("p", tail("chi2", "df"))
    return s.select("chi2", "df", "p", F.least(-F.log10(F.greatest("p", F.lit(1e-300))), F.lit(99.999)).alias("neg_log10_p"), F.sqrt(F.col("chi2") / (F.col("n") * F.greatest(F.col("least") - 1, F.lit(1)))).alias("cramer_v"), F.sqrt(F.col("chi2") / (F.col("chi2") + F.col("n"))).alias("contingency_c"))


def entropies(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: h, hx, hy, hy_x, hx_y and the uncertainty coefficients uy_x, ux_y, uxy, in natural logarithms."""
    o = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("o"))
    h = lambda df: df.crossJoin(df.agg(F.sum("o").alias("n"))).agg(F.sum(-F.col("o") / F.col("n") * F.log(F.col("o") / F.col("n"))).alias("h"))
    all_ = h(o).crossJoin(h(o.groupBy("x").agg(F.sum("o").alias("o"))).withColumnRenamed("h", "hx")).crossJoin(h(o.groupBy("y").agg(F.sum("o").alias("o"))).withColumnRenamed("h", "hy"))
    hy_x, hx_y = F.col("h") - F.col("hx"), F.col("h") - F.col("hy")
    return all_.select("h", "hx", "hy", hy_x.alias("hy_x"), hx_y.alias("hx_y"), ((F.col("hy") - hy_x) / F.col("hy")).alias("uy_x"), ((F.col("hx") - hx_y) / F.col("hx")).alias("ux_y"), (2 * (F.col("hx") + F.col("hy") - F.col("h")) / (F.col("hx") + F.col("hy"))).alias("uxy"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, d2 (sum of squared differences of mid-ranks), r (with ties corrected; null where all are tied), z (r * sqrt(n - 1)),
    p (two-sided, by Student's t with n - 2 degrees of freedom), z_d (how many standard deviations d2 lies above what independent
    ranks with these ties give) and p_d (two-sided, normal)."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cells = both.groupBy("x", "y").agg(F.count("*").alias("k"))
    rank = lambda c: mid_ranks(both.select(F.lit(0).alias("trait"), F.col(c).alias("value"))).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}"), F.col("k").alias(f"k{c}"))
    j = cells.join(rank("x"), "x").join(rank("y"), "y")
    s = j.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.pow(F.col("rx") - F.col("ry"), F.lit(2))).alias("d2"))
    ties = lambda c: rank(c).agg(F.sum(F.pow(F.col(f"k{c}"), F.lit(3)) - F.col(f"k{c}")).alias(f"t{c}"))
    s = s.crossJoin(ties("x")).crossJoin(ties("y"))
    en = F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")
    r = F.try_divide(en / 6 - F.col("d2") - F.col("tx") / 12 - F.col("ty") / 12, F.sqrt((en / 6 - F.col("tx") / 6) * (en / 6 - F.col("ty") / 6)))

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_tail(a * ((m - 2) / max(1 - a * a, 1e-300)) ** 0.5, m - 2) if a == a and m > 2 else float("nan") for a, m in zip(r.astype(float), n, strict=True)])

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(abs(x) / math.sqrt(2)) for x in z])

    n = F.col("n").cast("double")
    spread = (n - 1) / 36 * F.pow(n * (n + 1), F.lit(2)) * (1 - F.col("tx") / en) * (1 - F.col("ty") / en)
    z_d = F.try_divide(F.col("d2") - (en / 6 - (F.col("tx") + F.col("ty")) / 12), F.sqrt(spread))
    s = s.select("n", "d2", r.alias("r"), F.when(r.isNotNull(), z_d).alias("z_d"))
    some = lambda c: F.when(F.col("r").isNotNull(), c)
    return s.select("n", "d2", "r", (F.col("r") * F.sqrt(F.col("n") - 1)).alias("z"), some(p("r", "n")).alias("p"), "z_d", some(two_sided("z_d")).alias("p_d"))


def ordered_markers(markers: DataFrame) -> DataFrame:
    """chrom, marker, ord: map order within a chromosome (by pos, then name), and next_chrom, the next larger one. A chromosome may
    be split over many tasks."""
    placed = prefix_sums(markers.select("chrom", "pos", "marker", F.lit(1).alias("_one")), ["chrom"], ["pos", "marker"], {"ord": "_one"})
    chroms = markers.select("chrom").distinct().withColumn("next_chrom", F.lead("chrom").over(Window.orderBy("chrom")))
    return placed.select("chrom", "marker", F.col("ord").cast("int").alias("ord")).join(F.broadcast(chroms), "chrom")


def twin_check(geno: DataFrame, twins: DataFrame) -> DataFrame:
    """marker, famid, twins, agree, a1, a2: whether the typed twins of each group (famid, twins array) have one genotype, and that
    genotype, which fills in for an untyped twin; null where they differ."""
    to = small(twins.select("famid", F.array_join(F.col("twins").cast("array<string>"), "$").alias("twins"), F.explode("twins").alias("pid")))
    g = typed(geno).join(to, ["famid", "pid"]).select("marker", "famid", "twins", F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2"))
    one = g.groupBy("marker", "famid", "twins").agg(F.countDistinct("a1", "a2").alias("n"), F.min("a1").alias("a1"), F.min("a2").alias("a2"))
    agree = F.col("n") == 1
    return one.select("marker", "famid", "twins", agree.alias("agree"), F.when(agree, F.col("a1")).alias("a1"), F.when(agree, F.col("a2")).alias("a2"))
