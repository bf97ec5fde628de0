"""Posteriors of nuclear families and unrelated persons at a fixed reference frequency, in DataFrame expressions alone.

The same formulas as the kernels', over arrays of a family's genotypes, so that SQL can hold them against an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.kernels import trio_table
from kinfold.functions.scalars import dosage, genotype_quality, let
from kinfold.sources import fixtures as X

FREQ = 0.7
_PRIOR = (FREQ * FREQ, 2 * FREQ * (1 - FREQ), (1 - FREQ) * (1 - FREQ))
_TRIO = trio_table().tolist()


def _lk(obs: DataFrame) -> DataFrame:
    """site, chrom, pos, sample_id and k, the likelihoods of ref/ref, ref/alt, alt/alt; on autosomes only."""
    index = lambda a, b: ((F.least(a, b) - 1) * (10 - F.least(a, b)) / 2).cast("int") + F.greatest(a, b) - F.least(a, b)
    r, a = F.col("ref_base"), F.col("alt_base")
    k = [F.pow(F.lit(10.0), -F.get("pl", index(x, y)).cast("double") / 10) for x, y in ((r, r), (r, a), (a, a))]
    return obs.where("chrom not in ('X', 'Y', 'MT')").select("site", "chrom", "pos", "sample_id", F.array(*k).alias("k"))


def units(people: list[tuple]) -> list[tuple[str, tuple[int, ...]]]:
    """(famid, ids) of the nuclear families among (famid, pid, fatid, motid, sex) rows: father, mother and their children; and of
    the persons alone. Like every pedigree of calls in rows it lives on the driver; wider ones are for jobs.wide."""
    couples: dict[tuple, list[int]] = {}
    for famid, pid, father, mother, _ in people:
        if father is not None and father >= 0:
            couples.setdefault((famid, father, mother), []).append(pid)
    parents = {(f, p) for f, a, b in couples for p in (a, b)}
    listed = {(p[0], p[1]) for p in people}
    children = {(f, c) for (f, _, _), cs in couples.items() for c in cs}
    if parents & children or len(parents) < 2 * len(couples) or not parents <= listed:
        raise ValueError("a family is not nuclear")
    alone = [(f, (p,)) for f, p in sorted(listed - parents - children)]
    return [(f, (a, b, *sorted(cs))) for (f, a, b), cs in sorted(couples.items())] + alone


def _times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _weights(k: Column) -> Column:
    """For each person of a family, out of an array of their likelihoods, the weights of the three genotypes. What depends on
    both parents is an array of nine, the father's genotype changing slowest."""
    cells = F.sequence(F.lit(0), F.lit(8))
    given = [F.array(*[F.lit(float(_TRIO[g][f][m])) for f in range(3) for m in range(3)]) for g in range(3)]
    prior = F.array(*[F.lit(p) for p in _PRIOR])
    own = lambda i: _times(F.get(k, F.lit(i)), prior)
    of_child = lambda own: F.transform(cells, lambda c: sum((F.get(given[g], c) * F.get(own, F.lit(g)) for g in range(3)), F.lit(0.0)))

    def family(pair: Column) -> Column:
        children = F.slice(k, 3, F.size(k) - 2)

        def with_children(terms: Column) -> Column:
            def parents(both: Column) -> Column:
                at = lambda c: F.get(both, F.lit(c))
                return F.array(F.array(*[at(3 * g) + at(3 * g + 1) + at(3 * g + 2) for g in range(3)]), F.array(*[at(g) + at(g + 3) + at(g + 6) for g in range(3)]))

            def child(own: Column, i: Column) -> Column:
                others = F.aggregate(F.filter(terms, lambda t, j: j != i), pair, _times)
                return let(others, lambda w: F.array(*[F.get(own, F.lit(g)) * _total(_times(w, given[g])) for g in range(3)]))

            return F.concat(let(F.aggregate(terms, pair, _times), parents), F.transform(children, child))

        return let(F.transform(children, of_child), with_children)

    pair = let(F.array(own(0), own(1)), lambda x: F.transform(cells, lambda c: F.get(F.get(x, F.lit(0)), F.floor(c / 3).cast("int")) * F.get(F.get(x, F.lit(1)), c % 3)))
    return F.when(F.size(k) == 1, F.array(own(0))).otherwise(let(pair, family))


def family_calls(obs: DataFrame, pedigree: DataFrame) -> DataFrame:
    """site, sample_id, best genotype, gq, dosage of everybody in a pedigree of nuclear families and persons alone, from one
    grouping by site. A row holds one family at one site, so that the expressions have the size of a family, not of the cohort."""
    by_id = F.map_from_entries(F.collect_list(F.struct("sample_id", "k")))
    rows = _lk(obs).groupBy("site").agg(by_id.alias("m"))
    one = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    fams = F.explode(F.array(*[F.struct(F.lit(famid).alias("famid"), F.array(*[F.lit(p) for p in ids]).alias("ids")) for famid, ids in units([tuple(r) for r in pedigree.select("famid", "pid", "fatid", "motid", "sex").collect()])]))
    rows = rows.select("site", "m", fams.alias("x")).select("site", "x.famid", "x.ids", F.transform("x.ids", lambda p: F.coalesce(F.try_element_at("m", p), one)).alias("k"))
    rows = rows.select("site", "famid", F.explode(F.arrays_zip("ids", _weights(F.col("k")).alias("w"))).alias("x")).select("site", "famid", F.col("x.ids").alias("sample_id"), F.col("x.w").alias("w"))
    w = [F.get("w", F.lit(g)) for g in range(3)]
    rows = rows.select("site", "famid", "sample_id", *[(w[g] / (w[0] + w[1] + w[2])).alias(f"p{g}") for g in range(3)])
    p: list[Column] = [F.col(f"p{g}") for g in range(3)]
    best = F.when((p[0] >= p[1]) & (p[0] >= p[2]), F.lit(0)).when(p[1] >= p[2], F.lit(1)).otherwise(F.lit(2))
    return rows.select("site", "famid", "sample_id", best.alias("best"), genotype_quality(F.round(F.greatest(*p), 9)).alias("gq"), F.round(dosage(p[1], p[2]), 6).alias("dosage"))


def sql() -> str:
    idx = "pl[((least({0}, {1}) - 1) * (10 - least({0}, {1})) // 2 + greatest({0}, {1}) - least({0}, {1})) + 1]"
    lk = ", ".join(f"pow(10.0::double, -{idx.format(a, b)} / 10.0::double)" for a, b in (("ref_base", "ref_base"), ("ref_base", "alt_base"), ("alt_base", "alt_base")))
    trio = "[" + ", ".join("[" + ", ".join("[" + ", ".join(f"{v}::double" for v in r) + "]" for r in t) + "]" for t in _TRIO) + "]"
    prior = "[" + ", ".join(f"{p}::double" for p in _PRIOR) + "]"
    return X.WITH_OBS + f""", lk as (select site, sample_id as p, [{lk}] as k from obs where chrom not in ('X', 'Y', 'MT')),
 full_ as (select s.site, pid as p, famid, fatid, motid, coalesce(k, [1.0::double, 1.0, 1.0]) as k from (select distinct site from lk) s cross join ped left join lk on lk.site = s.site and lk.p = pid),
 c as (select {trio} as t, {prior} as pr), g3 as (select * from (values (1), (2), (3)) v(g)),
 fm as (select site, famid, f.g as gf, m.g as gm, pr[f.g] * kf[f.g] * pr[m.g] * km[m.g] as w from (select a.site, a.famid, a.k as kf, b.k as km from full_ a join full_ b on a.site = b.site and a.famid = b.famid where a.p in (0, 4) and b.p in (1, 5)), g3 f, g3 m, c),
 ch as (select site, famid, p, gf.g as gf, gm.g as gm, t[1][gf.g][gm.g] * k[1] + t[2][gf.g][gm.g] * k[2] + t[3][gf.g][gm.g] * k[3] as w from full_, g3 gf, g3 gm, c where fatid >= 0),
 chs as (select site, famid, gf, gm, product(w) as w from ch group by all),
 parents as (select fm.site, fm.famid, gf, gm, fm.w * chs.w as w from fm join chs using (site, famid, gf, gm)),
 pf as (select site, case famid when 'F1' then 0 else 4 end as p, gf as g, sum(w) as w from parents group by all), pm as (select site, case famid when 'F1' then 1 else 5 end as p, gm as g, sum(w) as w from parents group by all),
 pc as (select me.site, me.p, g, sum(fm.w * sib.w * t[g][fm.gf][fm.gm] * me.k[g]) as w from full_ me join fm using (site, famid) join ch sib on sib.site = me.site and sib.famid = me.famid and sib.p <> me.p and sib.gf = fm.gf and sib.gm = fm.gm, g3, c where me.fatid >= 0 group by me.site, me.p, g),
 pu as (select site, p, g, pr[g] * k[g] as w from full_, g3, c where p >= 8),
 al as (select * from pf union all select * from pm union all select * from pc union all select * from pu),
 n as (select site, p, max(case when g = 1 then w end) as w0, max(case when g = 2 then w end) as w1, max(case when g = 3 then w end) as w2 from al group by site, p),
 q as (select site, p, w0 / (w0 + w1 + w2) as p0, w1 / (w0 + w1 + w2) as p1, w2 / (w0 + w1 + w2) as p2 from n)
 select site, famid, p as sample_id, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as best, case when round(greatest(p0, p1, p2), 9) > 0.9999999999 then 100 else cast(floor(-10 * log10(1 - round(greatest(p0, p1, p2), 9)) + 0.5) as int) end as gq, round(p1 + 2 * p2, 6) as dosage from q join ped on p = pid"""
