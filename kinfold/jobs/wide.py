"""Calling of cohorts that are too wide for one row: nothing is wider than a family at a site.

Observations become rows of one family at one site, bucketed by site once. Frequencies are searched in rounds: a table of
brackets, one row for each site and configuration of alleles, asks for points; families answer with their log10
likelihood and expected founder alleles, whose sums move the brackets. A family's likelihood is a polynomial of the frequency,
whose coefficients are computed once, so that a round is a join and a sum of plain expressions. The rounds end when all
brackets are narrower than `prec`; sites in doubt start once more from the best point of a grid. The frequency found is then
joined back for one up-down pass per family. The pedigree is a table too; families of equal shape are computed together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import kernels as K
from kinfold.functions.lineage import bucketed, written
from kinfold.functions.scalars import TRANSITION, TRANSVERSION1, TRANSVERSION2, let, site_quality
from kinfold.jobs.calling import CONFIGS, Model, _likelihoods, allele_balance
from kinfold.jobs.options import Options
from kinfold.operators import reads
from kinfold.operators.markers import small
from kinfold.operators.pedigrees import with_nulls

KEYS = ("chrom", "pos")
ENDS = (K.LOW, 0.5, K.HIGH)
GRID = tuple(np.linspace(K.LOW, K.HIGH, 17).tolist())
#: Rounds of the search from the ends and of the one from a grid's best point, which needs 10 to halve a cell down to 1e-4.
SECANTS, HALVINGS = 8, 14
#: Founder alleles of a family whose likelihood is kept as a polynomial: its terms stay within a double's range from LOW to HIGH.
MOST_ALLELES = 32


def families(ped: DataFrame) -> DataFrame:
    """famid, pids (founders first, then by id), shape: father's and mother's place and the sex of each, as text."""
    person = F.struct(F.col("fatid").isNotNull().alias("child"), "pid", "fatid", "motid", F.coalesce("sex", F.lit(0)).alias("sex"))
    f = with_nulls(ped).groupBy("famid").agg(F.sort_array(F.collect_list(person)).alias("m")).withColumn("pids", F.col("m.pid"))
    place = lambda c: F.coalesce(F.array_position("pids", c) - 1, F.lit(-1)).cast("string")
    one = F.transform("m", lambda p: F.concat_ws(",", place(p["fatid"]), place(p["motid"]), p["sex"].cast("string")))
    return f.select("famid", "pids", F.array_join(one, ";").alias("shape"))


def family_rows(obs: DataFrame, ped: DataFrame) -> DataFrame:
    """A row for each site and family with an observation there: pl (ten of each member, zeros without one), depths, the least
    person with a reference base, and sums for the site: depth, persons with reads, their mapping quality, phred of A/A, C/C, G/G, T/T.
    Of repeated records of a person the one with the greatest depth counts."""
    none = F.array_repeat(F.lit(0).cast("smallint"), 10)
    record = F.struct(F.col("sample_id").alias("pid"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("map_qual", F.lit(0)).cast("int").alias("map_qual"), F.col("ref_base").cast("int").alias("ref_base"), F.coalesce(F.col("pl").cast("array<smallint>"), none).alias("pl"))
    who = small(ped.select("famid", F.col("pid").alias("sample_id")))
    rows = obs.select("sample_id", *KEYS, record.alias("r")).join(who, "sample_id").groupBy(*KEYS, "famid").agg(F.sort_array(F.collect_list("r")).alias("s"))
    rows = rows.withColumn("s", F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1)["pid"] != x["pid"], F.lit(True))))
    rows = rows.join(small(families(ped)), "famid")
    by_id = F.map_from_entries(F.transform("s", lambda x: F.struct(x["pid"], x)))
    full = let(by_id, lambda m: F.transform("pids", lambda p: F.try_element_at(m, p)))
    rows = rows.withColumn("full", full)
    total = lambda c: F.aggregate(F.transform("s", c), F.lit(0).cast("long"), lambda a, x: a + x)
    has = lambda x: x["depth"] > 0
    same = lambda i: total(lambda x: x["pl"][i])
    first = F.get(F.filter("s", lambda x: x["ref_base"].isNotNull()), F.lit(0))
    return rows.select(
        *KEYS, "famid", "pids", "shape", F.flatten(F.transform("full", lambda x: F.coalesce(x["pl"], none))).alias("pl"), F.transform("full", lambda x: F.coalesce(F.greatest(x["depth"], F.lit(0)), F.lit(0))).alias("depths"),
        F.struct(first["pid"].alias("pid"), first["ref_base"].alias("ref_base")).alias("first"), total(lambda x: F.greatest(x["depth"], F.lit(0))).alias("depth"), total(lambda x: has(x).cast("int")).alias("ns"),
        total(lambda x: F.when(has(x), x["map_qual"]).otherwise(0)).alias("mq"), F.array(*map(same, (0, 4, 7, 9))).alias("same"),
    )


def sites(rows: DataFrame, n_persons: int, o: Options) -> DataFrame:
    """chrom, pos, ref_base, mono (log10 likelihood of a monomorphic site), n_samples, depth, map_quality of the sites that pass
    the filters."""
    g = rows.groupBy(*KEYS).agg(F.min(F.when(F.col("first.ref_base").isNotNull(), F.col("first")))["ref_base"].alias("ref_base"), F.sum("depth").alias("depth"), F.sum("ns").alias("n_samples"), F.sum("mq").alias("mq"), *[F.sum(F.col("same")[i]).alias(f"same{i}") for i in range(4)])
    quality = F.when(F.col("n_samples") > 0, F.col("mq") / F.col("n_samples")).otherwise(F.lit(0.0))
    g = g.withColumn("map_quality", quality).where("ref_base is not null")
    kept = g.where(reads.drop_reason(F.col("ref_base"), F.col("depth"), F.col("n_samples") * 100.0 / n_persons, F.col("map_quality"), o).isNull())
    return kept.select(*KEYS, "ref_base", (-F.get(F.array(*[f"same{i}" for i in range(4)]), F.col("ref_base") - 1) / 10).alias("mono"), "n_samples", "depth", "map_quality")


class Shapes:
    """Models of family shapes and classes of chromosomes, made once in each worker."""

    def __init__(self, o: Options):
        self.o, self.made = o, {}
        self.classes = {o.chrom_x: "X", o.chrom_y: "Y", o.chrom_mt: "MT"}

    def groups(self, pdf: pd.DataFrame) -> Iterator[tuple[Model, np.ndarray]]:
        """Each model and the places of its rows."""
        for (shape, klass), at in pdf.groupby([pdf["shape"], pdf["chrom"].map(lambda c: self.classes.get(c, "autosome"))]).indices.items():
            if (shape, klass) not in self.made:
                people = [("f", i, *map(int, p.split(","))) for i, p in enumerate(shape.split(";"))]
                self.made[shape, klass] = Model(people, klass, self.o, always_optimise=True)
            yield self.made[shape, klass], at


def _pl(column: pd.Series, n: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).astype(np.int64).reshape(len(column), n, 10)


def _alleles(ref: np.ndarray, config: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bases = np.stack([ref, np.array(TRANSITION)[ref - 1], np.array(TRANSVERSION1)[ref - 1], np.array(TRANSVERSION2)[ref - 1]], axis=1)
    pair, at = np.array(CONFIGS)[config - 1], np.arange(len(ref))
    return bases[at, pair[:, 0]], bases[at, pair[:, 1]]


def answers(rows: DataFrame, asked: DataFrame, points: int, o: Options) -> DataFrame:
    """chrom, pos, config and for each asked point l<i> (log10 likelihood), e<i> (expected reference share). asked: chrom, pos, ref_base,
    config, x (array of points). Family rows stay where their bucket is; what is asked comes to them."""
    return _shares(_sums(rows, asked, points, o), points)


def _sums(rows: DataFrame, asked: DataFrame, points: int, o: Options) -> DataFrame:
    """What answers() divides: n, the founders' alleles, and for each point l<i> and the expected reference alleles e<i>."""
    by_site = asked.groupBy(*KEYS).agg(F.first("ref_base").alias("ref_base"), F.collect_list(F.struct("config", "x")).alias("q"))
    j = rows.select(*KEYS, "shape", "pl").join(by_site.hint("shuffle_hash"), list(KEYS)).select(*KEYS, "shape", "pl", "ref_base", F.col("q.config").alias("configs"), F.flatten("q.x").alias("x"))
    names = [f"{c}{i}" for c in "le" for i in range(points)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes(o)
        for pdf in batches:
            for model, at in shapes.groups(pdf):
                part = pdf.iloc[at]
                of = np.repeat(np.arange(len(part)), [len(c) for c in part["configs"]])
                config, x = np.concatenate(part["configs"].to_numpy()).astype(int), np.concatenate(part["x"].to_numpy()).reshape(-1, points)
                a1, a2 = _alleles(part["ref_base"].to_numpy().astype(int)[of], config)
                lk = _likelihoods(_pl(part["pl"], model.n)[of], a1, a2)
                got = [model.expected(lk, x[:, i]) for i in range(points)]
                n = model.copies.sum()
                yield pd.DataFrame({"chrom": part["chrom"].to_numpy()[of], "pos": part["pos"].to_numpy()[of], "config": config, "n": n} | dict(zip(names, [v for v, _ in got] + [e * n for _, e in got], strict=True)))

    kind = "chrom string, pos int, config int, n double, " + ", ".join(f"{x} double" for x in names)
    return j.mapInPandas(run, kind).groupBy(*KEYS, "config").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])


def _shares(s: DataFrame, points: int, *others: str) -> DataFrame:
    # without founder alleles of this class the frequency has no say
    share = lambda i: F.when(F.col("n") > 0, F.col(f"e{i}") / F.col("n"))
    return s.select(*KEYS, "config", *others, *[f"l{i}" for i in range(points)], *[share(i).alias(f"e{i}") for i in range(points)])


def _counted(rows: DataFrame, which: DataFrame, configs: tuple[int, ...], degree: int, o: Options) -> DataFrame:
    """chrom, pos, config, n, scale, c0 to c<degree>: each family's likelihood as a polynomial of the frequency (kernels.allele_counts())."""
    j = rows.select(*KEYS, "shape", "pl").join(which.select(*KEYS, "ref_base").hint("shuffle_hash"), list(KEYS))
    names = [f"c{i}" for i in range(degree + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(o)
        for batch in batches:
            pdf = batch.select(["chrom", "pos", "shape", "ref_base"]).to_pandas()
            lists = batch.column("pl")
            begin, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for model, at in shapes.groups(pdf):
                pl = flat[begin[at][:, None] + np.arange(model.n * 10)].astype(np.int64).reshape(len(at), model.n, 10)
                part, ref = pdf.iloc[at], pdf["ref_base"].to_numpy()[at].astype(int)
                for config in configs:
                    scale, c = model.allele_counts(_likelihoods(pl, *_alleles(ref, np.full(len(at), config))))
                    c = np.concatenate([c, np.zeros((degree + 1 - len(c), len(at)))])
                    out = {"chrom": part["chrom"], "pos": part["pos"], "config": np.full(len(at), config, dtype=np.int32), "n": np.full(len(at), model.copies.sum()), "scale": scale}
                    yield pa.RecordBatch.from_pydict(out | dict(zip(names, c, strict=True)))

    return j.mapInArrow(run, "chrom string, pos int, config int, n double, scale double, " + ", ".join(f"{x} double" for x in names))


class Cohort:
    """The families' likelihoods of some sites and configurations, ready to be asked at frequencies: polynomials of their founders'
    alleles, made once; families with more than MOST_ALLELES of these are computed at each point by answers()."""

    def __init__(self, rows: DataFrame, which: DataFrame, configs: tuple[int, ...], o: Options):
        alleles = 2 * F.size(F.filter(F.split("shape", ";"), lambda x: x.startswith("-1,-1,")))
        few, many = alleles <= MOST_ALLELES, alleles > MOST_ALLELES
        r = rows.select("shape").distinct().agg(F.max(F.when(few, alleles)).alias("degree"), F.count(F.when(many, 1)).alias("many")).first()
        self.o, self.degree = o, r.degree or 0
        self.counted = bucketed(_counted(rows.where(few), which, configs, self.degree, o), *KEYS, "config")
        self.rest = rows.where(many) if r.many else None

    def answered(self, what: DataFrame, points: int) -> DataFrame:
        """what (chrom, pos, config, x (array of points) and others) and, without x, for each point l<i> and e<i> as answers() has them."""
        keys, own = [*KEYS, "config"], [c for c in what.columns if c not in (*KEYS, "config", "x")]
        j = self.counted.join(what.select(*keys, *own, *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(points)]).hint("shuffle_hash"), keys)
        j = j.withColumns({f"t{i}": F.col(f"x{i}") / (1 - F.col(f"x{i}")) for i in range(points)})
        sums = lambda i, weight: reduce(lambda a, k: a * F.col(f"t{i}") + F.col(f"c{k}") * weight(k), range(self.degree - 1, -1, -1), F.col(f"c{self.degree}") * weight(self.degree))
        j = j.withColumns({f"s{i}": sums(i, lambda k: F.lit(1.0)) for i in range(points)} | {f"d{i}": sums(i, lambda k: F.lit(float(k))) for i in range(points)})
        some = lambda i: F.col(f"s{i}") > 0
        l = {f"l{i}": F.when(some(i), F.log10(f"s{i}") + F.col("n") * F.log10(1 - F.col(f"x{i}")) + F.col("scale")).otherwise(F.lit(float("-inf"))) for i in range(points)}
        e = {f"e{i}": F.when(some(i), F.col(f"d{i}") / F.col(f"s{i}")).otherwise(F.lit(0.0)) for i in range(points)}
        total = [F.sum("n").alias("n"), *[F.sum(c).alias(k) for k, c in (l | e).items()]]
        if self.rest is None:
            return _shares(j.groupBy(*keys).agg(*[F.first(c).alias(c) for c in own], *total), points, *own)
        s = j.groupBy(*keys).agg(*total).unionByName(_sums(self.rest, what, points, self.o))
        return what.drop("x").join(_shares(s.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", *l, *e)]), points), keys)


def _bracket(r: DataFrame, points: tuple[float, ...], low: Column) -> DataFrame:
    """Brackets from the points `low` and the next one of r's answers."""
    x, over, v = F.array(*map(F.lit, points)), F.array(*[F.coalesce(F.col(f"e{i}") - p, F.lit(0.0)) for i, p in enumerate(points)]), F.array(*[f"l{i}" for i in range(len(points))])
    r = r.withColumns({"_x": x, "_r": over, "_v": v}).withColumn("_i", low)
    at = lambda c, k: F.get(c, F.col("_i") + k)
    return r.select(*KEYS, "ref_base", "config", at("_x", 0).alias("lo"), at("_x", 1).alias("hi"), at("_r", 0).alias("r_lo"), at("_r", 1).alias("r_hi"), at("_v", 0).alias("v_lo"), at("_v", 1).alias("v_hi"), F.lit(False).alias("halve"))


_BRACKET = ("lo", "hi", "r_lo", "r_hi", "v_lo", "v_hi", "halve")


def _narrowed(state: DataFrame, cohort: Cohort, o: Options, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Brackets that `rounds` steps bring below prec, and those that are still wider."""
    done, beside = None, o.prec / 2
    span = F.col("hi") - F.col("lo")
    state = written(state)
    for _ in range(rounds):
        closed, open_ = state.where(span <= o.prec), state.where(span > o.prec)
        done = closed if done is None else done.unionByName(closed)
        if open_.isEmpty():
            return done, open_
        secant = F.when((F.col("r_lo") > 0) & (F.col("r_hi") < 0), F.col("lo") + span * F.col("r_lo") / (F.col("r_lo") - F.col("r_hi"))).otherwise(F.col("lo") + span / 2)
        x = F.when(F.col("halve"), F.col("lo") + span / 2).otherwise(F.greatest(F.least(secant, F.col("hi") - beside), F.col("lo") + beside))
        got = cohort.answered(open_.withColumn("next", x).withColumn("x", F.array("next")), 1)
        over = F.coalesce(F.col("e0") - F.col("next"), F.lit(0.0))
        right = over >= 0
        new = {"lo": F.when(right, F.col("next")).otherwise(F.col("lo")), "hi": F.when(right, F.col("hi")).otherwise(F.col("next")), "r_lo": F.when(right, over).otherwise(F.col("r_lo")), "r_hi": F.when(right, F.col("r_hi")).otherwise(over), "v_lo": F.when(right, F.col("l0")).otherwise(F.col("v_lo")), "v_hi": F.when(right, F.col("v_hi")).otherwise(F.col("l0"))}
        slow = (F.when(right, F.col("hi") - F.col("next")).otherwise(F.col("next") - F.col("lo")) > span / 2) & ~F.col("halve")
        state = written(got.select(*KEYS, "ref_base", "config", *[c.alias(k) for k, c in new.items()], slow.alias("halve")))
    return done.unionByName(state.where(span <= o.prec)), state.where(span > o.prec)


def best_frequencies(cohort: Cohort, wanted: DataFrame, o: Options) -> DataFrame:
    """chrom, pos, config, f, llk at the greatest likelihood of each wanted (chrom, pos, ref_base, config)."""
    ask = lambda what, points: written(cohort.answered(what.withColumn("x", F.array(*map(F.lit, points))), len(points)))
    first = ask(wanted, ENDS)
    up = [F.coalesce(F.col(f"e{i}") - p, F.lit(0.0)) >= 0 for i, p in enumerate(ENDS)]
    inner, odd = up[0] & ~up[2], (~up[0] & (up[1] | up[2])) | (up[0] & ~up[1] & up[2])
    edge = first.where(~inner & ~odd).select(*KEYS, "ref_base", "config", F.when(up[2], K.HIGH).otherwise(K.LOW).alias("f"), F.when(up[2], F.col("l2")).otherwise(F.col("l0")).alias("llk"), F.greatest("l0", "l1", "l2").alias("top"))
    done, wide = _narrowed(_bracket(first.where(inner), ENDS, F.when(up[1], 1).otherwise(0)), cohort, o, SECANTS)
    ends = first.select(*KEYS, "config", F.greatest("l0", "l1", "l2").alias("top"))
    settled = lambda d: d.select(*KEYS, "ref_base", "config", F.when(F.col("v_lo") >= F.col("v_hi"), F.col("lo")).otherwise(F.col("hi")).alias("f"), F.greatest("v_lo", "v_hi").alias("llk"))
    found = written(edge.unionByName(settled(done).join(ends, [*KEYS, "config"])))
    sure = F.col("llk") >= F.col("top") - 1e-9
    doubt = first.where(odd).select(*KEYS, "ref_base", "config").unionByName(wide.select(*KEYS, "ref_base", "config")).unionByName(found.where(~sure).select(*KEYS, "ref_base", "config"))
    out = found.where(sure).select(*KEYS, "config", "f", "llk")
    if doubt.isEmpty():
        return out
    grid = ask(doubt, GRID)
    values = F.array(*[f"l{i}" for i in range(len(GRID))])
    top = (F.array_position(values, F.array_max(values)) - 1).cast("int")
    grid = grid.withColumn("_top", top).withColumn("_up", F.get(F.array(*[F.coalesce(F.col(f"e{i}") - p, F.lit(0.0)) >= 0 for i, p in enumerate(GRID)]), F.col("_top")))
    last = len(GRID) - 1
    at_end = (F.col("_up") & (F.col("_top") == last)) | (~F.col("_up") & (F.col("_top") == 0))
    ended = grid.where(at_end).select(*KEYS, "config", F.when(F.col("_up"), K.HIGH).otherwise(K.LOW).alias("f"), F.array_max(values).alias("llk"))
    done, _ = _narrowed(_bracket(grid.where(~at_end), GRID, F.when(F.col("_up"), F.col("_top")).otherwise(F.col("_top") - 1)), cohort, o, HALVINGS)
    return out.unionByName(ended).unionByName(settled(done).select(*KEYS, "config", "f", "llk"))


def prior_scales(ped: DataFrame) -> tuple[dict[str, float], int, int]:
    """The sum of 1/i up to the founder chromosomes of each class, the persons and the families."""
    p = with_nulls(ped)
    r = p.agg(F.count(F.when(F.col("fatid").isNull(), 1)).alias("all"), F.count(F.when(F.col("fatid").isNull() & (F.col("sex") == 1), 1)).alias("m"), F.count(F.when(F.col("fatid").isNull() & (F.col("sex") == 2), 1)).alias("f"), F.count("*").alias("n"), F.countDistinct("famid").alias("fams")).first()
    n = {"autosome": 2 * r["all"], "X": 2 * r.f + r.m, "Y": r.m, "MT": r["all"]}
    return {k: float(sum(1 / i for i in range(1, c + 1))) for k, c in n.items()}, r.n, r.fams


def call_wide_cohort(obs: DataFrame, ped: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(sites, genotypes) as call_variants() finds them: a row for each called site, and one for each of its persons whose
    family has an observation there (chrom, pos, famid, pid, gt, gq, dosage). ped: a table of famid, pid, fatid, motid, sex.
    Options quick_call and compat don't apply. A cohort of one family has no other to share sums with: call_variants()."""
    scale, n_persons, n_families = prior_scales(ped)
    if n_families < 2:
        raise ValueError("a cohort of one family fits a row: call_variants()")
    if o.chromosomes:
        obs = obs.where(F.col("chrom").isin(*o.chromosomes))
    rows = bucketed(family_rows(obs, ped), *KEYS)
    site = written(sites(rows, n_persons, o))
    classes = F.when(F.col("chrom") == o.chrom_x, "X").when(F.col("chrom") == o.chrom_y, "Y").when(F.col("chrom") == o.chrom_mt, "MT").otherwise("autosome")
    prior = F.element_at(F.create_map(*[F.lit(v) for k, s in scale.items() for v in (k, o.theta * s)]), classes)
    p_ts = o.poly_tstv / (1 + o.poly_tstv)
    weight = (p_ts, (1 - p_ts) / 2, (1 - p_ts) / 2, 0.001, 0.001, 0.001)

    def scored(configs: tuple[int, ...], which: DataFrame) -> DataFrame:
        wanted = which.select(*KEYS, "ref_base", F.explode(F.array(*map(F.lit, configs))).alias("config"))
        got = best_frequencies(Cohort(rows, which, configs, o), wanted, o)
        return got.groupBy(*KEYS).agg(*[F.max(F.when(F.col("config") == c, F.col(x))).alias(f"{x}{c}") for c in configs for x in ("f", "llk")])

    def posterior(scores: list[Column]) -> tuple[Column, Column]:
        top = F.greatest(*scores)
        return (F.array_position(F.array(*scores), top) - 1).cast("int"), 1 / sum((F.pow(F.lit(10.0), s - top) for s in scores), F.lit(0.0))

    score = lambda c: F.log10(F.col("prior") * weight[c - 1]) + F.col(f"llk{c}")
    mono = F.log10(1 - F.col("prior")) + F.col("mono")
    table = written(site.withColumn("prior", prior).join(scored((1, 2, 3), site), list(KEYS)))
    doubt = table.where(posterior([mono, *map(score, (1, 2, 3))])[1] < 0.99)
    table = table.join(scored((4, 5, 6), doubt), list(KEYS), "left")
    scores = [mono, *map(score, (1, 2, 3)), *[F.coalesce(score(c), F.lit(float("-inf"))) for c in (4, 5, 6)]]
    config, post = posterior(scores)
    table = table.select("*", config.alias("config"), post.alias("posterior"), F.array_position(F.array(*scores[1:4]), F.greatest(*scores[1:4])).cast("int").alias("likeliest"))
    bases = [F.col("ref_base"), *[F.element_at(F.array(*map(F.lit, t)), F.col("ref_base")) for t in (TRANSITION, TRANSVERSION1, TRANSVERSION2)]]
    base = lambda i: F.get(F.array(*bases), i)
    pairs = [F.array(*[F.lit(p[k]) for p in CONFIGS]) for k in (0, 1)]
    first, second = (F.get(p, F.col("config") - 1) for p in pairs)
    f = F.get(F.array(F.lit(1 - o.theta), *[F.coalesce(f"f{c}", F.lit(1.0)) for c in range(1, 7)]), F.col("config"))
    a2 = F.when(F.col("config") == 0, F.col("likeliest")).otherwise(second).cast("int")
    called = table.select(*KEYS, "ref_base", F.coalesce(base(F.when(F.col("config") > 0, first)), F.col("ref_base")).cast("int").alias("a1"), base(a2).cast("int").alias("a2"), "config", "posterior", site_quality(F.col("posterior")).alias("qual"), f.alias("ref_freq"), "n_samples", "depth", "map_quality")
    if not o.all_sites:
        called = called.where((F.col("config") > 0) & (F.col("posterior") >= o.cutoff))
    called = written(called)
    post = written(_posteriors(rows, called, o))
    balance = post.groupBy(*KEYS).agg(((0.05 + F.sum("het_ref")) / (0.1 + F.sum("het_all"))).alias("ab"))
    persons = post.select(*KEYS, "famid", F.explode(F.arrays_zip("pids", "gt", "gq", "dosage")).alias("p"))
    return called.join(balance, list(KEYS)), persons.select(*KEYS, "famid", F.col("p.pids").alias("pid"), "p.gt", "p.gq", "p.dosage")


def _posteriors(rows: DataFrame, called: DataFrame, o: Options) -> DataFrame:
    """One up-down pass of every family at each called site, with its part of the allele balance."""
    j = rows.select(*KEYS, "famid", "pids", "shape", "pl", "depths").join(called.select(*KEYS, "a1", "a2", "ref_freq").hint("shuffle_hash"), list(KEYS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes(o)
        for pdf in batches:
            for model, at in shapes.groups(pdf):
                part = pdf.iloc[at]
                a1, a2 = part["a1"].to_numpy().astype(int), part["a2"].to_numpy().astype(int)
                pl, depth = _pl(part["pl"], model.n), np.stack(part["depths"].to_numpy()).astype(float)
                lk = _likelihoods(pl, a1, a2)
                _, post = model.llk(lk, part["ref_freq"].to_numpy(), marginals=True)
                share, weight = balance_parts(post, -10 * np.log10(lk), depth)
                out = part[["chrom", "pos", "famid", "pids"]].copy()
                yield out.assign(gt=list(post.argmax(axis=2).astype(np.int32)), gq=list(K.genotype_quality(post.max(axis=2)).astype(np.int32)), dosage=list(post[:, :, 1] + 2 * post[:, :, 2]), het_ref=share, het_all=weight)

    return j.mapInPandas(run, "chrom string, pos int, famid string, pids array<int>, gt array<int>, gq array<int>, dosage array<double>, het_ref double, het_all double")


def balance_parts(post: np.ndarray, pl3: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A family's part of the sums that allele_balance() divides."""
    weight = (post[:, :, 1] * ((depth > 0) & (post[:, :, 1] > 1e-5)) * depth).sum(axis=1)
    return allele_balance(post, pl3, depth) * (0.1 + weight) - 0.05, weight


def wide_llk(obs: DataFrame, ped: DataFrame, points: tuple[float, ...], o: Options = Options()) -> DataFrame:
    """chrom, pos, config (1: ref and transition) and the cohort's log10 likelihood at each point: one round of the search."""
    rows = family_rows(obs, ped)
    site = sites(rows, 1, o).select(*KEYS, "ref_base", F.lit(1).alias("config"))
    got = answers(rows, site.withColumn("x", F.array(*map(F.lit, points))), len(points), o)
    return got.select(*KEYS, "config", *[f"l{i}" for i in range(len(points))], *[f"e{i}" for i in range(len(points))])
