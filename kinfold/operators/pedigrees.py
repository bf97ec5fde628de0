"""Pedigrees: parents, families, pairs, kinship, checks.

Rows are famid, pid, fatid, motid, sex; a founder's parents are null (or below 0). What follows relations through a family
does so by joins in rounds, whose tables are written, so that a family may have any number of persons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.lineage import written


def with_nulls(ped: DataFrame) -> DataFrame:
    """Parents below 0 as null."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return ped.select("famid", "pid", known("fatid"), known("motid"), "sex")


def check_parents(ped: DataFrame) -> DataFrame:
    """famid, pid, problem: one known parent, a parent that is not in the family, parents of equal or swapped sex, a
    person listed twice."""
    p = with_nulls(ped)
    sexes = lambda c: p.select("famid", F.col("pid").alias(c), F.col("sex").alias(f"{c}_sex")).dropDuplicates(["famid", c])
    j = p.join(sexes("fatid"), ["famid", "fatid"], "left").join(sexes("motid"), ["famid", "motid"], "left")
    one = F.col("fatid").isNull() != F.col("motid").isNull()
    absent = (F.col("fatid").isNotNull() & F.col("fatid_sex").isNull()) | (F.col("motid").isNotNull() & F.col("motid_sex").isNull())
    what = F.when(one, "one_parent").when(absent, "absent_parent").when((F.col("fatid_sex") == 2) & (F.col("motid_sex") == 1), "swapped_parents").when((F.col("fatid_sex") == 2) | (F.col("motid_sex") == 1), "parent_sex")
    twice = p.groupBy("famid", "pid").agg(F.count("*").alias("n")).where("n > 1").select("famid", "pid", F.lit("duplicate").alias("problem"))
    return j.select("famid", "pid", what.alias("problem")).where("problem is not null").unionByName(twice)


def fix_swapped(ped: DataFrame) -> DataFrame:
    """Father and mother exchanged where their sexes say so."""
    p = with_nulls(ped)
    sexes = lambda c: p.select("famid", F.col("pid").alias(c), F.col("sex").alias(f"{c}_sex")).dropDuplicates(["famid", c])
    j = p.join(sexes("fatid"), ["famid", "fatid"], "left").join(sexes("motid"), ["famid", "motid"], "left")
    swap = F.coalesce((F.col("fatid_sex") == 2) & (F.col("motid_sex") == 1), F.lit(False))
    return j.select("famid", "pid", F.when(swap, F.col("motid")).otherwise(F.col("fatid")).alias("fatid"), F.when(swap, F.col("fatid")).otherwise(F.col("motid")).alias("motid"), "sex")


def family_table(ped: DataFrame) -> DataFrame:
    """famid, n, n_founders, generations (1: founders alone, 2: all children have founders for parents, else 3), is_nuclear."""
    p = with_nulls(ped)
    founders = p.where("fatid is null").select("famid", "pid")
    far = p.where("fatid is not null").select("famid", F.explode(F.array("fatid", "motid")).alias("pid")).join(founders, ["famid", "pid"], "left_anti").groupBy("famid").agg(F.count("*").alias("far"))
    g = p.groupBy("famid").agg(F.count("*").cast("int").alias("n"), F.count(F.when(F.col("fatid").isNull(), 1)).cast("int").alias("n_founders"))
    generations = F.when(F.col("n") == F.col("n_founders"), 1).when(F.col("far").isNull(), 2).otherwise(3)
    return g.join(far, "famid", "left").select("famid", "n", "n_founders", generations.alias("generations"), ((generations == 2) & (F.col("n_founders") == 2)).alias("is_nuclear"))


def sibships(ped: DataFrame) -> DataFrame:
    return with_nulls(ped).where("fatid is not null").groupBy("famid", "fatid", "motid").agg(F.sort_array(F.collect_list("pid")).alias("sibs"))


def ordered(ped: DataFrame) -> DataFrame:
    """famid, pid, ord: founders first within the family, then by id."""
    w = Window.partitionBy("famid").orderBy(F.col("fatid").isNotNull(), "pid")
    return with_nulls(ped).select("famid", "pid", F.row_number().over(w).alias("ord"))


def pairs(ped: DataFrame) -> DataFrame:
    """famid, pid1, pid2 of every pair within a family, a person with itself too."""
    a, b = ped.select("famid", F.col("pid").alias("pid1")), ped.select("famid", F.col("pid").alias("pid2"))
    return a.join(b, "famid").where("pid1 <= pid2")


def ancestors(ped: DataFrame, max_depth: int = 64) -> DataFrame:
    """famid, pid, ancestor, by joins that double the reach until nothing is new."""
    p = with_nulls(ped).where("fatid is not null")
    known = p.select("famid", "pid", F.explode(F.array("fatid", "motid")).alias("ancestor")).distinct()
    n, reach = known.count(), 1
    while reach < max_depth:
        further = known.alias("a").join(known.alias("b"), (F.col("a.famid") == F.col("b.famid")) & (F.col("a.ancestor") == F.col("b.pid"))).select("a.famid", "a.pid", "b.ancestor")
        known = known.unionByName(further).distinct()
        m, reach = known.count(), reach * 2
        if m == n:
            break
        n = m
    return known


def generations(ped: DataFrame) -> list[DataFrame]:
    """The persons (famid, pid, fatid, motid, sex and what else ped has) of each generation: founders, and then those whose
    parents both stand in earlier ones. A person with a parent that is not listed counts as a founder."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    p = ped.withColumns({"fatid": known("fatid"), "motid": known("motid")})
    listed = lambda c: p.select("famid", F.col("pid").alias(c), F.lit(True).alias(f"_{c}")).distinct()
    p = p.join(listed("fatid"), ["famid", "fatid"], "left").join(listed("motid"), ["famid", "motid"], "left").withColumn("_child", F.col("_fatid") & F.col("_motid"))
    p = written(p.select("famid", "pid", *[F.when(F.col("_child"), F.col(c)).alias(c) for c in ("fatid", "motid")], *[c for c in ped.columns if c not in ("famid", "pid", "fatid", "motid")]))
    out, rest = [p.where("fatid is null")], p.where("fatid is not null")
    placed = out[0].select("famid", "pid")
    while not rest.isEmpty():
        here = lambda c: placed.select("famid", F.col("pid").alias(c))  # noqa: B023, E731
        ready = written(rest.join(here("fatid"), ["famid", "fatid"], "left_semi").join(here("motid"), ["famid", "motid"], "left_semi"))
        if ready.isEmpty():
            raise ValueError("a person is an ancestor of itself")
        out.append(ready)
        placed = placed.unionByName(ready.select("famid", "pid"))
        rest = written(rest.join(ready.select("famid", "pid"), ["famid", "pid"], "left_anti"))
    return out


def _one_of_twins(ped: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The pedigree with monozygotic twins (equal odd zygosity of full sibs) as the least of them, parents too, and (famid, pid, least)."""
    if "zygosity" not in ped.columns:
        return ped, None
    z = with_nulls(ped).join(ped.select("famid", "pid", "zygosity"), ["famid", "pid"]).where("zygosity % 2 = 1 and fatid is not null")
    w = Window.partitionBy("famid", "fatid", "motid", "zygosity")
    to = written(z.select("famid", "pid", F.min("pid").over(w).alias("least")).where("pid <> least"))
    name = lambda c: to.select("famid", F.col("pid").alias(c), F.col("least").alias(f"_{c}"))
    p = ped.join(to.select("famid", "pid"), ["famid", "pid"], "left_anti")
    for c in ("fatid", "motid"):
        p = p.join(name(c), ["famid", c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return p, to


def kinship_pairs(ped: DataFrame, x_linked: bool = False) -> DataFrame:
    """famid, pid1, pid2, phi of the pairs pid1 <= pid2 whose phi is not zero.

    Built from generation to generation by joins: a person's row is half of each parent's (X-linked, a male's is his mother's), with
    persons of earlier generations first and then, by the others' rows just made, with those of the same one. Only pairs that
    are related stand in a table, and no task holds a family. An optional column zygosity marks monozygotic twins by equal
    odd numbers among full sibs: they have one row."""
    ped, twins = _one_of_twins(ped)
    levels = generations(ped)
    male = F.lit(x_linked) & (F.col("sex") == 1)
    keys = ["famid", "a", "b"]
    known = written(levels[0].select("famid", F.col("pid").alias("a"), F.col("pid").alias("b"), F.when(male, 1.0).otherwise(0.5).alias("phi")))
    for level in levels[1:]:
        from_mother = F.struct(F.col("motid").alias("p"), F.when(male, 1.0).otherwise(0.5).alias("w"))
        edges = level.select("famid", F.col("pid").alias("c"), F.explode(F.when(male, F.array(from_mother)).otherwise(F.array(from_mother, F.struct(F.col("fatid").alias("p"), F.lit(0.5).alias("w"))))).alias("e")).select("famid", "c", "e.p", "e.w")
        row = edges.join(known.select("famid", F.col("a").alias("p"), "b", "phi"), ["famid", "p"])
        older = written(row.groupBy("famid", F.col("c").alias("a"), "b").agg(F.sum(F.col("w") * F.col("phi")).alias("phi")))
        # with the others of this generation: half of what those have with this one's parents
        peers = edges.join(older.select("famid", F.col("a").alias("other"), F.col("b").alias("p"), "phi"), ["famid", "p"]).where("c <> other")
        peers = peers.groupBy("famid", F.col("c").alias("a"), F.col("other").alias("b")).agg(F.sum(F.col("w") * F.col("phi")).alias("phi"))
        # a parent's phi with the other one is in the table of the generations before
        both = level.join(known.select("famid", F.col("a").alias("fatid"), F.col("b").alias("motid"), "phi"), ["famid", "fatid", "motid"], "left")
        own = both.select("famid", F.col("pid").alias("a"), F.col("pid").alias("b"), F.when(male, 1.0).otherwise(0.5 + 0.5 * F.coalesce("phi", F.lit(0.0))).alias("phi"))
        turned = older.select("famid", F.col("b").alias("a"), F.col("a").alias("b"), "phi")
        known = known.unionByName(written(older.unionByName(turned).unionByName(peers).unionByName(own).select(*keys, "phi")))
    if twins is not None and not twins.isEmpty():  # twins stand for themselves and for each other
        every = twins.select("famid", F.col("least").alias("of"), "pid").unionByName(known.where("a = b").select("famid", F.col("a").alias("of"), F.col("a").alias("pid")))
        name = lambda c, to: every.select("famid", F.col("of").alias(c), F.col("pid").alias(to))
        known = known.join(name("a", "x"), ["famid", "a"]).join(name("b", "y"), ["famid", "b"]).select("famid", F.col("x").alias("a"), F.col("y").alias("b"), "phi")
    return known.where("a <= b").select("famid", F.col("a").alias("pid1"), F.col("b").alias("pid2"), "phi")


def inbred_families(ped: DataFrame, related: DataFrame, x_linked: bool = False) -> DataFrame:
    """famid of the families with a person whose parents are related; X-linked, a woman."""
    p = with_nulls(ped).where("fatid is not null" + (" and sex <> 1" if x_linked else ""))
    pair = p.select("famid", F.least("fatid", "motid").alias("pid1"), F.greatest("fatid", "motid").alias("pid2"))
    return pair.join(related.where("phi > 0").select("famid", "pid1", "pid2"), ["famid", "pid1", "pid2"], "left_semi").select("famid").distinct()


def kinship(ped: DataFrame, x_linked: bool = False) -> DataFrame:
    """famid, pid1, pid2, phi of every pair pid1 <= pid2, and whether somebody of the family is inbred. See kinship_pairs(), which
    leaves out the pairs that are not related."""
    related = written(kinship_pairs(ped, x_linked))
    inbred = inbred_families(ped, related, x_linked).withColumn("inbred", F.lit(True))
    every = pairs(ped.select("famid", "pid")).join(related, ["famid", "pid1", "pid2"], "left").join(inbred, "famid", "left")
    return every.select("famid", "pid1", "pid2", F.coalesce("phi", F.lit(0.0)).alias("phi"), F.coalesce("inbred", F.lit(False)).alias("inbred"))


def connected_groups(ped: DataFrame) -> DataFrame:
    """famid, pid, grp: the least person of the part of the family that parents and children connect.

    Labels are contracted in rounds: every label takes the least of its neighbours', chains of labels are shortened by doubling, and
    links between labels that have become one go, so that fewer links are left each time; no task holds a family."""
    p = with_nulls(ped).distinct()
    listed = p.select("famid", "pid").distinct()
    links = p.select("famid", F.col("pid").alias("a"), F.explode(F.array("fatid", "motid")).alias("b")).where("b is not null")
    links = written(links.join(listed.withColumnRenamed("pid", "b"), ["famid", "b"], "left_semi").select("famid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = written(listed.withColumn("grp", F.col("pid")))
    while not links.isEmpty():
        to = written(links.groupBy("famid", F.col("b").alias("was")).agg(F.min("a").alias("now")))
        while True:  # a label's label is less than it, so that doubling ends in as many steps as a chain's length has digits
            jump = to.select("famid", F.col("was").alias("now"), F.col("now").alias("_far"))
            shorter = written(to.join(jump, ["famid", "now"], "left").select("famid", "was", F.coalesce("_far", "now").alias("now"), F.col("_far").isNotNull().alias("moved")))
            to = shorter.select("famid", "was", "now")
            if shorter.where("moved").isEmpty():
                break
        name = lambda c: to.select("famid", F.col("was").alias(c), F.col("now").alias(f"_{c}"))  # noqa: B023, E731
        labels = written(labels.join(name("grp"), ["famid", "grp"], "left").select("famid", "pid", F.coalesce("_grp", "grp").alias("grp")))
        ends = links.join(name("a"), ["famid", "a"], "left").join(name("b"), ["famid", "b"], "left").select("famid", F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        links = written(ends.select("famid", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
    return labels


def trim(ped: DataFrame, has_data: DataFrame) -> DataFrame:
    """The persons that stay when families without data go, and then, again and again, childless persons without data
    and founder couples without data of one child only, which becomes a founder. Leaves are stripped in rounds of joins; the
    order in which persons go does not change what stays."""
    data = has_data.select("famid", "pid", F.lit(True).alias("data")).distinct()
    rows = with_nulls(ped).join(data, ["famid", "pid"], "left").withColumn("data", F.coalesce("data", F.lit(False)))
    state = written(rows.join(rows.where("data").select("famid").distinct(), "famid", "left_semi").select("famid", "pid", "fatid", "motid", "sex", "data"))
    while True:
        kids = state.select("famid", F.col("pid").alias("kid"), F.explode(F.array("fatid", "motid")).alias("pid")).where("pid is not null")
        kids = kids.groupBy("famid", "pid").agg(F.countDistinct("kid").alias("n"), F.min("kid").alias("kid"))
        p = written(state.join(kids, ["famid", "pid"], "left"))
        leaves = p.where("not data and n is null")
        if not leaves.isEmpty():
            state = written(p.where("data or n is not null").drop("n", "kid"))
            continue
        # a couple of founders without data whose one child is the same
        ready = p.where("fatid is null and not data and n = 1").select("famid", "pid", "kid")
        both = ready.select("famid", F.col("pid").alias("fatid"), F.col("kid").alias("pid")).join(ready.select("famid", F.col("pid").alias("motid"), F.col("kid").alias("pid")), ["famid", "pid"])
        freed = written(p.join(both.select("famid", "pid", "fatid", "motid"), ["famid", "pid", "fatid", "motid"], "left_semi").select("famid", "pid", "fatid", "motid"))
        if freed.isEmpty():
            return p.select("famid", "pid", "fatid", "motid", "sex")
        gone = freed.select("famid", F.explode(F.array("fatid", "motid")).alias("pid")).distinct()
        left = p.join(gone, ["famid", "pid"], "left_anti").join(freed.select("famid", "pid", F.lit(True).alias("_free")), ["famid", "pid"], "left")
        state = written(left.select("famid", "pid", *[F.when(F.col("_free").isNull(), F.col(c)).alias(c) for c in ("fatid", "motid")], "sex", "data"))


def twin_groups(ped: DataFrame) -> DataFrame:
    """famid, twins: monozygotic twins (full sibs with one odd zygosity), and whether their sexes agree. ped has zygosity."""
    z = ped.where("zygosity % 2 = 1 and fatid >= 0").groupBy("famid", "fatid", "motid", "zygosity")
    return z.agg(F.sort_array(F.collect_list("pid")).alias("twins"), (F.countDistinct("sex") == 1).alias("same_sex")).where(F.size("twins") > 1).select("famid", "twins", "same_sex")


def merge_twins(ped: DataFrame) -> DataFrame:
    """One person for each group of twins, ids joined by $, affected (2) if any is; children point to it. Ids as text."""
    t = twin_groups(ped).withColumn("merged", F.array_join(F.col("twins").cast("array<string>"), "$"))
    to = t.select("famid", "merged", F.explode("twins").alias("pid"))
    name = lambda c: to.select("famid", F.col("pid").alias(c), F.col("merged").alias(f"{c}_new"))
    j = ped
    for c in ("pid", "fatid", "motid"):
        j = j.join(name(c), ["famid", c], "left")
    new = lambda c: F.coalesce(F.col(f"{c}_new"), F.col(c).cast("string"))
    return j.groupBy("famid", new("pid").alias("pid"), new("fatid").alias("fatid"), new("motid").alias("motid"), "sex").agg(F.max("affected").alias("affected"))


def ibd_prior(ped: DataFrame) -> DataFrame:
    """famid, pid1, pid2 and p0, p1, p2 where the relation alone decides: a person with itself, two founders, parent and child."""
    p = with_nulls(ped)
    one = p.select("famid", F.col("pid").alias("pid1"), F.col("fatid").alias("f1"), F.col("motid").alias("m1"))
    two = p.select("famid", F.col("pid").alias("pid2"), F.col("fatid").alias("f2"), F.col("motid").alias("m2"))
    j = pairs(ped).join(one, ["famid", "pid1"]).join(two, ["famid", "pid2"])
    is_parent = lambda child_f, child_m, who: F.coalesce((F.col(child_f) == F.col(who)) | (F.col(child_m) == F.col(who)), F.lit(False))
    triple = lambda a, b, c: F.array(F.lit(a), F.lit(b), F.lit(c))
    p3 = F.when(F.col("pid1") == F.col("pid2"), triple(0.0, 0.0, 1.0)).when(F.col("f1").isNull() & F.col("f2").isNull(), triple(1.0, 0.0, 0.0)).when(is_parent("f1", "m1", "pid2") | is_parent("f2", "m2", "pid1"), triple(0.0, 1.0, 0.0))
    return j.select("famid", "pid1", "pid2", *[F.get(p3, F.lit(i)).alias(f"p{i}") for i in range(3)])


def ibd_lookup(wanted: DataFrame, table: DataFrame, ped: DataFrame) -> DataFrame:
    """Adds p0, p1, p2 to wanted pairs (famid, pid1, pid2, marker): the table's value, else the relation's, else null."""
    keys = ["famid", "pid1", "pid2"]
    base = ibd_prior(ped).withColumnsRenamed({f"p{i}": f"d{i}" for i in range(3)})
    j = wanted.join(table, [*keys, "marker"], "left").join(base, keys, "left")
    return j.select(*keys, "marker", *[F.coalesce(f"p{i}", f"d{i}").alias(f"p{i}") for i in range(3)])


def ibd_conflicts(table: DataFrame) -> DataFrame:
    """Pairs and markers of a table that are listed with more than one value."""
    return table.groupBy("famid", "pid1", "pid2", "marker").agg(F.countDistinct(F.struct("p0", "p1", "p2")).alias("n")).where("n > 1")



def extract_family(people: DataFrame, famid: str) -> DataFrame:
    return people.where(F.col("famid") == famid)


def have_data(people: DataFrame, geno: DataFrame | None = None, columns: list[str] = ()) -> DataFrame:
    """Persons with a genotype, or a value in one of the trait and affection columns (an affection of 0 is none)."""
    some = F.lit(False)
    for c in columns:
        some |= F.coalesce(F.col(c).cast("double") != 0, F.lit(False)) if dict(people.dtypes)[c] == "int" else F.col(c).isNotNull()
    if geno is None:
        return people.where(some)
    typed = geno.where("a1 > 0 and a2 > 0").select("famid", "pid", F.lit(True).alias("_typed")).distinct()
    return people.join(typed, ["famid", "pid"], "left").where(F.coalesce("_typed", F.lit(False)) | some).drop("_typed")


def blank_phenotypes(people: DataFrame, columns: list[str], blank: Column) -> DataFrame:
    """All persons stay; where blank holds, the columns become null."""
    return people.withColumns({c: F.when(~F.coalesce(blank, F.lit(False)), F.col(c)) for c in columns})


def extract_on_affection(people: DataFrame, affection: str, status: int, columns: list[str]) -> DataFrame:
    """Persons of another status keep their ids only."""
    return blank_phenotypes(people, columns, F.coalesce(F.col(affection) != status, F.lit(True)))


def match_samples(names: DataFrame, ped: DataFrame) -> DataFrame:
    """name, state: both, vcf_only (not written) or pedigree_only (kept with likelihood 1)."""
    a = names.select("name", F.lit(True).alias("in_vcf")).distinct()
    b = ped.select(F.col("pid").cast("string").alias("name"), F.lit(True).alias("in_ped")).distinct()
    state = F.when(F.col("in_vcf") & F.col("in_ped"), "both").when(F.col("in_vcf"), "vcf_only").otherwise("pedigree_only")
    return a.join(b, "name", "full").select("name", state.alias("state"))
