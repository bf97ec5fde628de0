"""Calling of variants and genotypes in families, from likelihood observations or from VCF rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import kernels as K
from kinfold.functions.scalars import TRANSITION, TRANSVERSION1, TRANSVERSION2, format_index, sample_field
from kinfold.jobs.options import Options
from kinfold.operators import reads


def families(people: list[tuple]) -> list[K.Family]:
    """Families of (famid, pid, fatid, motid, sex) rows, founders first within each, in order of the family's id. The
    pedigree is small: it lives on the driver and travels with the task."""
    out = []
    for famid in sorted({p[0] for p in people}):
        rows = sorted((p for p in people if p[0] == famid), key=lambda p: (p[2] >= 0, p[1]))
        place = {p[1]: i for i, p in enumerate(rows)}
        if len(place) < len(rows):
            raise ValueError(f"family {famid} has a person twice")
        out.append(K.Family([p[1] for p in rows], [place.get(p[2], -1) for p in rows], [place.get(p[3], -1) for p in rows], [p[4] for p in rows]))
    return out


def prior_scale(people: list[tuple], klass: str) -> float:
    """Sum of 1/i up to the number of founder chromosomes; n has its last term too."""
    founders = [p for p in people if p[2] < 0]
    males, females = sum(p[4] == 1 for p in founders), sum(p[4] == 2 for p in founders)
    n = {"autosome": 2 * len(founders), "X": 2 * females + males, "Y": males, "MT": len(founders)}[klass]
    return sum(1 / i for i in range(1, n + 1))


class Model:
    """Likelihoods of a pedigree over batches of sites of one class of chromosome."""

    def __init__(self, people: list[tuple], klass: str, options: Options, always_optimise: bool = False):
        self.fams, self.klass, self.o = families(people), klass, options
        self.n = len(people)
        self.place = {pid: i for i, pid in enumerate(sorted(p[1] for p in people))}
        self.index = [np.array([self.place[i] for i in f.ids]) for f in self.fams]
        self.lone = len(self.fams) == 1 and self.fams[0].nuclear and not always_optimise
        self.tables = [{c: K.trio_table(klass, f.sex[c]) for c in range(len(f.ids)) if f.father[c] >= 0} for f in self.fams]
        self.prior = options.theta * prior_scale(people, klass)
        founders = [(self.place[f.ids[i]], K.founder_copies(klass, f.sex[i])) for f in self.fams for i in f.founders]
        self.copies = np.zeros(self.n)
        self.copies[[i for i, _ in founders]] = [c for _, c in founders]

    def _own(self, fam: K.Family, own: np.ndarray) -> np.ndarray:
        if self.klass == "Y":
            for i, sex in enumerate(fam.sex):
                if sex == 2:
                    own[:, i] = 1.0 if fam.father[i] < 0 else 1 / 3  # her data count nothing
        return own

    def allele_counts(self, lk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likelihood of a pedigree of one family as a polynomial of the reference frequency."""
        (fam,), (at,), (tables,) = self.fams, self.index, self.tables
        return K.allele_counts(fam, self._own(fam, lk[:, at].copy()), tables, self.klass)

    def llk(self, lk: np.ndarray, f: np.ndarray, marginals: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """log10 likelihood [S] and posteriors [S, N, 3] of likelihoods [S, N, 3] at reference frequencies f."""
        total, post = np.zeros(len(lk)), np.zeros_like(lk) if marginals else None
        for fam, at, tables in zip(self.fams, self.index, self.tables, strict=True):
            own = self._own(fam, lk[:, at].copy())
            if not self.lone:
                for i in fam.founders:
                    own[:, i] *= K.founder_prior(f, self.klass, fam.sex[i])
            got, dist = K.peel(fam, own, tables, K.COUPLE_PRIOR if self.lone else None, marginals)
            total += got
            if marginals:
                post[:, at] = dist
        return total, post

    def maximum(self, lk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(f, log10 likelihood) at the best frequency; a lone couple needs none."""
        if self.lone:
            return np.full(len(lk), 0.5), self.llk(lk, np.full(len(lk), 0.5))[0]
        return K.frequency_maximum(lambda f, rows: self.expected(lk[rows], f), lambda f, rows: self.llk(lk[rows], f)[0], len(lk), width=self.o.prec)

    def expected(self, lk: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 likelihood and the expected reference share among the founders' alleles (f itself where they have none)."""
        got, post = self.llk(lk, f, marginals=True)
        if not self.copies.any():
            return got, f
        return got, (post[:, :, 0] + post[:, :, 1] / 2) @ self.copies / self.copies.sum()


def _likelihoods(pl: np.ndarray, a1: np.ndarray, a2: np.ndarray) -> np.ndarray:
    """[S, N, 3] of the genotypes of base codes a1, a2 (1..4) out of pl [S, N, 10]."""
    lo, hi = np.minimum(a1, a2), np.maximum(a1, a2)
    index = lambda x, y: ((x - 1) * (10 - x)) // 2 + (y - x)
    pick = np.stack([index(a1, a1), index(lo, hi), index(a2, a2)], axis=1)
    return np.power(10.0, -np.take_along_axis(pl, np.broadcast_to(pick[:, None, :], (*pl.shape[:2], 3)), axis=2) / 10)


CONFIGS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def score_sites(pl: np.ndarray, ref: np.ndarray, model: Model, o: Options) -> dict[str, np.ndarray]:
    """Scores of the monomorphic and six polymorphic configurations; the last three only where the first four leave
    doubt. Returns config, posterior, a1, a2, f, llk."""
    s = len(ref)
    bases = np.stack([ref, np.array(TRANSITION)[ref - 1], np.array(TRANSVERSION1)[ref - 1], np.array(TRANSVERSION2)[ref - 1]], axis=1)
    same = ((ref - 1) * (10 - ref)) // 2
    mono = -np.take_along_axis(pl, np.broadcast_to(same[:, None, None], (s, pl.shape[1], 1)), axis=2)[:, :, 0].sum(axis=1) / 10
    p_ts = o.poly_tstv / (1 + o.poly_tstv)
    weight = [p_ts, (1 - p_ts) / 2, (1 - p_ts) / 2, 0.001, 0.001, 0.001]
    scores, f, llk = np.full((s, 7), -np.inf), np.full((s, 7), 1.0), np.full((s, 7), -np.inf)
    scores[:, 0], llk[:, 0] = np.log10(1 - model.prior) + mono, mono

    def fill(rows: np.ndarray, configs: range) -> None:
        for c in configs:
            i, j = CONFIGS[c - 1]
            f[rows, c], llk[rows, c] = model.maximum(_likelihoods(pl[rows], bases[rows, i], bases[rows, j]))
            scores[rows, c] = np.log10(model.prior * weight[c - 1]) + llk[rows, c]

    fill(np.arange(s), range(1, 4))
    _, post = K.config_posterior(scores[:, :4])
    doubt = np.flatnonzero(post < 0.99)
    if len(doubt):
        fill(doubt, range(4, 7))
    best, post = K.config_posterior(scores)
    pairs = np.array([(0, 1), *CONFIGS])
    alt = np.where(best == 0, 1 + scores[:, 1:4].argmax(axis=1), pairs[best, 1])
    at = np.arange(s)
    return {"config": best, "posterior": post, "a1": bases[at, pairs[best, 0]], "a2": bases[at, alt], "f": f[at, best], "llk": llk[at, best]}


def allele_balance(post: np.ndarray, pl: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Share of reference reads in heterozygotes, from the three phred values [S, N, 3] of the called alleles."""
    ll = -pl
    scale = np.maximum(np.maximum(ll[:, :, 2] + ll[:, :, 0] - 2 * ll[:, :, 1] + 6 * depth, 4), np.abs(ll[:, :, 2] - ll[:, :, 0]))
    n_ref = np.trunc(0.5 * depth * (1 + (ll[:, :, 2] - ll[:, :, 0]) / scale))
    het = post[:, :, 1] * ((depth > 0) & (post[:, :, 1] > 1e-5))
    return (0.05 + (het * n_ref).sum(axis=1)) / (0.1 + (het * depth).sum(axis=1))


#: Arrays are in the order of the persons' ids; dp and pl3 are each person's depth and phred values of the called alleles.
CALLS = "chrom string, pos int, ref_base int, a1 int, a2 int, config int, posterior double, qual double, ref_freq double, ab double, n_samples int, depth long, map_quality double, gt array<int>, gq array<int>, dosage array<double>, dp array<int>, pl3 array<array<int>>"


def _sites(obs: DataFrame, order: list[int], o: Options, forced: DataFrame | None) -> DataFrame:
    """Aligned sites that pass the filters, likelihoods in one flat array; chromosomes and the forced list (chrom, pos) are
    picked before the one big shuffle."""
    if forced is not None:
        obs = obs.join(forced.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    if o.chromosomes:
        obs = obs.where(F.col("chrom").isin(*o.chromosomes))
    if o.compat:
        obs = reads.until_first_end(obs)
    sites = reads.site_filters(reads.align_sites(obs, order), len(order), o).where("drop_reason is null")
    return sites.withColumn("pl", F.flatten("pl"))


def _flat(pl: pd.Series) -> np.ndarray:
    """Likelihoods [S, N, 10]."""
    return np.stack(pl.tolist()).astype(np.int64).reshape(len(pl), -1, 10)


def call_variants(obs: DataFrame, people: list[tuple], o: Options = Options(), forced: DataFrame | None = None) -> DataFrame:
    """Calls of aligned sites. obs: chrom, pos, sample_id, ref_base, depth, map_qual, pl. Without all_sites or a forced
    list (chrom, pos) only variant sites whose posterior reaches the cutoff are returned."""
    everything = o.all_sites or forced is not None
    sites = _sites(obs, sorted(p[1] for p in people), o, forced)
    names = {o.chrom_x: "X", o.chrom_y: "Y", o.chrom_mt: "MT"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, tuple[Model, Model]] = {}
        for pdf in batches:
            for klass, group in pdf.groupby(pdf["chrom"].map(lambda c: names.get(c, "autosome"))):
                if klass not in models:
                    alone = [(f"u{p[1]}", p[1], -1, -1, p[4]) for p in people]
                    models[klass] = Model(people, klass, o), Model(alone, klass, o)
                for lo in range(0, len(group), o.batch):
                    part = group.iloc[lo : lo + o.batch]
                    got = _call(part, *models[klass], o, everything)
                    if len(got):
                        yield got

    return sites.mapInPandas(run, CALLS)


def _call(part: pd.DataFrame, model: Model, alone: Model, o: Options, everything: bool) -> pd.DataFrame:
    pl = _flat(part["pl"])
    ref = part["ref_base"].to_numpy().astype(np.int64)
    if o.quick_call and not everything:  # first as if all were unrelated
        quick = score_sites(pl, ref, alone, o)
        keep = (quick["config"] > 0) & (quick["posterior"] >= o.cutoff)
        part, pl, ref = part[keep], pl[keep], ref[keep]
        if not len(part):
            return pd.DataFrame()
    r = score_sites(pl, ref, model, o)
    if not everything:
        keep = (r["config"] > 0) & (r["posterior"] >= o.cutoff)
        part, pl, ref, r = part[keep], pl[keep], ref[keep], {k: v[keep] for k, v in r.items()}
        if not len(part):
            return pd.DataFrame()
    f = np.where(r["config"] == 0, 1 - o.theta, r["f"])
    _, post = model.llk(_likelihoods(pl, r["a1"], r["a2"]), f, marginals=True)
    best = post.argmax(axis=2)
    top = post.max(axis=2)
    index = lambda x, y: ((x - 1) * (10 - x)) // 2 + (y - x)
    lo, hi = np.minimum(r["a1"], r["a2"]), np.maximum(r["a1"], r["a2"])
    pick = np.stack([index(r["a1"], r["a1"]), index(lo, hi), index(r["a2"], r["a2"])], axis=1)
    pl3 = np.take_along_axis(pl, np.broadcast_to(pick[:, None, :], (*pl.shape[:2], 3)), axis=2)
    depth = np.stack(list(part["depths"])).astype(float)
    qual = np.where(r["posterior"] > 0.9999999999, 100.0, -10 * np.log10(np.maximum(1 - r["posterior"], 1e-11)))
    return pd.DataFrame({
        "chrom": part["chrom"].array, "pos": part["pos"].array, "ref_base": ref, "a1": r["a1"], "a2": r["a2"], "config": r["config"], "posterior": r["posterior"], "qual": qual, "ref_freq": f,
        "ab": allele_balance(post, pl3, depth), "n_samples": part["n_samples"].array, "depth": part["total_depth"].array, "map_quality": part["map_quality"].array,
        "gt": list(best), "gq": list(K.genotype_quality(top)), "dosage": list(post[:, :, 1] + 2 * post[:, :, 2]),
        "dp": list(depth.astype(np.int32)), "pl3": [x.tolist() for x in pl3],
    })


class DenovoModel:
    """Ten-genotype likelihoods with and without mutation in the transmissions."""

    def __init__(self, people: list[tuple], o: Options):
        self.fams = families(people)
        self.place = {pid: i for i, pid in enumerate(sorted(p[1] for p in people))}
        self.index = [np.array([self.place[i] for i in f.ids]) for f in self.fams]
        self.lone = len(self.fams) == 1 and self.fams[0].nuclear
        self.mutated = K.denovo_trio_table(o.rate_denovo, o.tstv_denovo)
        self.plain = K.trio_table10()
        self.prior = o.theta * prior_scale(people, "autosome")

    def llk(self, lk: np.ndarray, a1: int, a2: int, f: np.ndarray, mutation: bool, marginals: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """lk: [S, N, 10] of sites that share the alleles a1, a2 (1..4)."""
        lo, hi = sorted((a1 - 1, a2 - 1))
        at3 = [K.INDEX10[a1 - 1, a1 - 1], K.INDEX10[lo, hi], K.INDEX10[a2 - 1, a2 - 1]]
        prior = np.zeros((len(lk), 10))
        joint = None
        fixed = self.lone and bool((f < 1).any())
        if fixed:
            joint = np.zeros((10, 10))
            joint[np.ix_(at3, at3)] = K.COUPLE_PRIOR
        else:
            prior[:, at3] = K.founder_prior(f)
        table = self.mutated if mutation else self.plain
        total, post = np.zeros(len(lk)), np.zeros_like(lk) if marginals else None
        for fam, at in zip(self.fams, self.index, strict=True):
            own = lk[:, at].copy()
            if not fixed:
                own[:, fam.founders] *= prior[:, None, :]
            got, dist = K.peel(fam, own, {c: table for c in range(len(fam.ids)) if fam.father[c] >= 0}, joint, marginals)
            total += got
            if marginals:
                post[:, at] = dist
        return total, post


    def expected(self, lk: np.ndarray, a1: int, a2: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 likelihood with mutation and the expected share of a1 among the founders' alleles."""
        lo, hi = sorted((a1 - 1, a2 - 1))
        got, post = self.llk(lk, a1, a2, f, True, marginals=True)
        founders = np.concatenate([at[fam.founders] for fam, at in zip(self.fams, self.index, strict=True)])
        share = post[:, founders, K.INDEX10[a1 - 1, a1 - 1]] + post[:, founders, K.INDEX10[lo, hi]] / 2
        return got, share.mean(axis=1)


DENOVO_CALLS = "chrom string, pos int, ref_base int, a1 int, a2 int, config int, posterior double, qual double, ref_freq double, dq double, n_samples int, depth long, map_quality double, gt array<string>, gq array<int>, dp array<int>, pl array<array<int>>"


def call_denovo(obs: DataFrame, people: list[tuple], o: Options = Options(denovo=True), forced: DataFrame | None = None) -> DataFrame:
    """Sites whose likelihood with mutation exceeds that without by min_llr_denovo (log10), with genotypes of all ten
    kinds; every configuration is scored under mutation. With all_sites or a forced list (chrom, pos) the posterior's
    cutoff and the quick look as if all were unrelated don't apply."""
    if o.min_llr_denovo < 0:
        raise ValueError("min_llr_denovo is negative")
    sites = _sites(obs, sorted(p[1] for p in people), o, forced)
    everything = o.all_sites or forced is not None
    alone = [(f"u{p[1]}", p[1], -1, -1, p[4]) for p in people]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, unrelated = DenovoModel(people, o), Model(alone, "autosome", o)
        for pdf in batches:
            for ref, group in pdf.groupby("ref_base"):
                for lo in range(0, len(group), o.batch):
                    part = group.iloc[lo : lo + o.batch]
                    if o.quick_call and not everything:
                        quick = score_sites(_flat(part["pl"]), part["ref_base"].to_numpy().astype(np.int64), unrelated, o)
                        part = part[(quick["config"] > 0) & (quick["posterior"] >= o.cutoff)]
                    got = _denovo(part, int(ref), model, o, everything) if len(part) else part
                    if len(got):
                        yield got

    return sites.mapInPandas(run, DENOVO_CALLS)


def _denovo(part: pd.DataFrame, ref: int, model: DenovoModel, o: Options, everything: bool = False) -> pd.DataFrame:
    pl = _flat(part["pl"])
    lk = np.power(10.0, -pl / 10)
    s = len(part)
    bases = [ref, TRANSITION[ref - 1], TRANSVERSION1[ref - 1], TRANSVERSION2[ref - 1]]
    p_ts = o.poly_tstv / (1 + o.poly_tstv)
    weight = [p_ts, (1 - p_ts) / 2, (1 - p_ts) / 2, 0.001, 0.001, 0.001]
    one = np.ones(s)
    scores, f, llk = np.full((s, 7), -np.inf), np.ones((s, 7)), np.full((s, 7), -np.inf)
    llk[:, 0] = model.llk(lk, ref, bases[1], one, True)[0]
    scores[:, 0] = np.log10(1 - model.prior) + llk[:, 0]

    def fill(rows: np.ndarray, c: int) -> None:
        x, y = (bases[i] for i in CONFIGS[c - 1])
        if model.lone:
            f[rows, c], llk[rows, c] = 0.5, model.llk(lk[rows], x, y, np.full(len(rows), 0.5), True)[0]
        else:
            f[rows, c], llk[rows, c] = K.frequency_maximum(lambda q, k: model.expected(lk[rows[k]], x, y, q), lambda q, k: model.llk(lk[rows[k]], x, y, q, True)[0], len(rows), width=o.prec)
        scores[rows, c] = np.log10(model.prior * weight[c - 1]) + llk[rows, c]

    for c in (1, 2, 3):
        fill(np.arange(s), c)
    doubt = np.flatnonzero(K.config_posterior(scores[:, :4])[1] < 0.99)
    if len(doubt):
        for c in (4, 5, 6):
            fill(doubt, c)
    best, posterior = K.config_posterior(scores)
    out = []
    for c in range(7):
        rows = np.flatnonzero((best == c) & (everything | (posterior >= o.cutoff)))
        if not len(rows):
            continue
        x, y = (ref, bases[1]) if c == 0 else (bases[i] for i in CONFIGS[c - 1])
        q = f[rows, c]
        with_, post = model.llk(lk[rows], x, y, q, True, marginals=True)
        dq = with_ - model.llk(lk[rows], x, y, q, False)[0]
        top, labels = post.max(axis=2), np.array(["ACGT"[a] + "/" + "ACGT"[b] for a, b in K.GENOTYPES10])
        p = posterior[rows]
        out.append(pd.DataFrame({
            "chrom": part["chrom"].to_numpy()[rows], "pos": part["pos"].to_numpy()[rows], "ref_base": ref, "a1": x, "a2": y, "config": c, "posterior": p,
            "qual": np.where(p > 0.9999999999, 100.0, -10 * np.log10(np.maximum(1 - p, 1e-11))), "ref_freq": q, "dq": dq, "n_samples": part["n_samples"].to_numpy()[rows], "depth": part["total_depth"].to_numpy()[rows], "map_quality": part["map_quality"].to_numpy()[rows],
            "gt": list(labels[post.argmax(axis=2)]), "gq": list(K.genotype_quality(top)), "dp": [np.asarray(d, dtype=np.int32) for d in part["depths"].to_numpy()[rows]], "pl": [x.tolist() for x in pl[rows]],
        })[dq >= o.min_llr_denovo])
    return pd.concat(out) if out else pd.DataFrame()


def wide_cohort_frequencies(obs: DataFrame, people: list[tuple], grid: list[float], o: Options = Options()) -> DataFrame:
    """chrom, pos, ref_freq, llk for the alleles ref and its transition, for cohorts too wide for one row: a row holds one
    family at one site, gives its log10 likelihood at every frequency of the grid, and sums over families are partial
    before the shuffle. Finer grids around the best point refine it. Autosomes only."""
    fams = {p[0]: [q for q in people if q[0] == p[0]] for p in people}
    who = obs.sparkSession.createDataFrame([(p[0], p[1]) for p in people], "famid string, sample_id int")
    rows = obs.where("ref_base between 1 and 4").join(who, "sample_id")
    per = rows.groupBy("chrom", "pos", "famid").agg(F.first("ref_base").alias("ref_base"), F.collect_list(F.struct("sample_id", "pl")).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = {}
        for pdf in batches:
            for famid, group in pdf.groupby("famid"):
                if famid not in built:
                    m = Model(fams[famid], "autosome", o, always_optimise=True)
                    built[famid] = m
                m = built[famid]
                pl = np.zeros((len(group), m.n, 10), dtype=np.int64)
                for i, s in enumerate(group["s"]):
                    for x in s:
                        pl[i, m.place[x["sample_id"]]] = x["pl"]
                ref = group["ref_base"].to_numpy().astype(np.int64)
                lk = _likelihoods(pl, ref, np.array(TRANSITION)[ref - 1])
                out = np.stack([m.llk(lk, np.full(len(lk), f))[0] for f in grid], axis=1)
                yield pd.DataFrame({"chrom": group["chrom"].array, "pos": group["pos"].array, **{f"l{i}": out[:, i] for i in range(len(grid))}})

    llk = per.mapInPandas(run, "chrom string, pos int, " + ", ".join(f"l{i} double" for i in range(len(grid))))
    return reads.grid_mle(llk.groupBy("chrom", "pos").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(len(grid))]), grid)


UNRELATED = "chrom string, pos int, a1 int, a2 int, ref_freq double, gt array<string>, gq array<int>"
GENOTYPES_TEXT = ["ACGT"[a] + "/" + "ACGT"[b] for a, b in K.GENOTYPES10]


def call_unrelated(obs: DataFrame, persons: list[int], o: Options = Options(), freq: float | None = None) -> DataFrame:
    """Genotypes of unrelated persons at a frequency that maximises the product of their likelihoods (or the one given), for
    the reference and its transition: the best of all ten (in letters), of equal ones the first; quality is -10 log10 of
    what the others hold of the sum of likelihood times prior, at most 100."""
    sites = reads.align_sites(obs, persons).withColumn("pl", F.flatten("pl"))
    people = [(f"u{p}", p, -1, -1, 0) for p in persons]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(people, "autosome", o)
        for pdf in batches:
            pdf = pdf[pdf["ref_base"].between(1, 4)]
            for lo in range(0, len(pdf), o.batch):
                part = pdf.iloc[lo : lo + o.batch]
                ref = part["ref_base"].to_numpy().astype(np.int64)
                alt = np.array(TRANSITION)[ref - 1]
                pl = _flat(part["pl"])
                f = model.maximum(_likelihoods(pl, ref, alt))[0] if freq is None else np.full(len(ref), freq)
                # the frequency's prior over all ten genotypes: zero for those with another base
                index = lambda x, y: ((x - 1) * (10 - x)) // 2 + (y - x)
                prior = np.zeros((len(ref), 10))
                at = np.arange(len(ref))
                prior[at, index(ref, ref)], prior[at, index(alt, alt)] = f * f, (1 - f) * (1 - f)
                prior[at, index(np.minimum(ref, alt), np.maximum(ref, alt))] = 2 * f * (1 - f)
                post = np.power(10.0, -pl / 10) * prior[:, None, :]
                best, total = post.argmax(axis=2), post.sum(axis=2)
                gq = K.genotype_quality(np.round(post.max(axis=2) / np.where(total > 0, total, 1), 12))
                yield pd.DataFrame({"chrom": part["chrom"].array, "pos": part["pos"].array, "a1": ref, "a2": alt, "ref_freq": f, "gt": list(np.array(GENOTYPES_TEXT)[best]), "gq": list(gq)})

    return sites.mapInPandas(run, UNRELATED)


def site_prior_indel(ref: Column, alt: Column, o: Options) -> Column:
    """The prior of a record: that of indels if either allele is longer than a base."""
    return F.when((F.length(ref) > 1) | (F.length(alt) > 1), F.lit(o.indel_theta)).otherwise(F.lit(o.theta))


#: Arrays are in the order of the persons' ids; dp and likelihoods are null for a person without a sample.
REFINED = "chrom string, pos int, id string, ref string, alt string, qual double, filter string, ref_freq double, gt array<int>, gq array<int>, ac int, dp array<string>, tag string, likelihoods array<string>"


def refine_vcf(vcf: DataFrame, sample_names: list[str], people: list[tuple], o: Options = Options()) -> DataFrame:
    """Biallelic records scored anew with the pedigree: quality, frequency and genotypes. vcf: chrom, pos, id, ref, alt,
    format, samples. Persons of the pedigree without a sample keep likelihood 1; other samples are not used; a record
    without any likelihood gets a null quality. Row by row: it runs on a stream of records too."""
    from kinfold.operators.vcf import likelihood_triples

    names = {str(p[1]) for p in people}
    if not names & set(sample_names):
        raise ValueError("no sample of the VCF is in the pedigree")
    order = [str(x) for x in sorted(p[1] for p in people)]
    at = [sample_names.index(x) if x in sample_names else -1 for x in order]
    rows = vcf.where(~F.col("alt").contains(",") & (F.col("ref") != F.col("alt")))
    field = lambda tag: F.array(*[sample_field(F.get("samples", F.lit(i)), format_index(F.col("format"), tag)) if i >= 0 else F.lit(None).cast("string") for i in at])
    has_pl = format_index(F.col("format"), "PL") >= 0
    rows = rows.select("chrom", "pos", "id", "ref", "alt", "filter", likelihood_triples(F.col("format"), F.col("samples"), at).alias("pl3"), field("DP").alias("dp"), F.when(has_pl, F.lit("PL")).otherwise(F.lit("GL")).alias("tag"), F.when(has_pl, field("PL")).otherwise(field("GL")).alias("likelihoods"))
    # one flat array a record: three numbers of each person, nulls without likelihoods
    none = F.array(*[F.lit(None).cast("double")] * 3)
    rows = rows.withColumn("pl3", F.flatten(F.transform("pl3", lambda x: F.coalesce(x, none))))
    here = np.array([i >= 0 for i in at])
    classes = {o.chrom_x: "X", o.chrom_y: "Y", o.chrom_mt: "MT"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[tuple, Model] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, o.batch):  # no more than this is unpacked at once
                part = batch.slice(lo, o.batch)
                kind = pd.DataFrame({"klass": [classes.get(c, "autosome") for c in part["chrom"].to_pylist()], "indel": pc.or_kleene(*[pc.greater(pc.utf8_length(part[c]), 1) for c in ("ref", "alt")]).to_pylist()})
                for key, places in kind.groupby(["klass", "indel"]).indices.items():
                    if key not in models:
                        own = replace(o, theta=o.indel_theta) if key[1] and not o.compat else o
                        models[key] = Model(people, key[0], own, always_optimise=True)
                        if o.compat:  # one prior for all chromosomes
                            models[key].prior = o.theta * prior_scale(people, "autosome")
                    yield _refine(part.take(pa.array(places)), models[key], bool(key[1]), o, here)

    return rows.mapInArrow(run, REFINED)


def _refine(part: pa.RecordBatch, model: Model, indel: bool, o: Options, here: np.ndarray) -> pa.RecordBatch:
    pl = part["pl3"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1, 3)
    seen = ~np.isnan(pl).all(axis=(1, 2))
    pl = np.nan_to_num(pl)
    lk = np.power(10.0, -np.minimum(pl, 255) / 10)
    f, llk = model.maximum(lk)
    mono = np.log10(1 - model.prior) - pl[:, :, 0].sum(axis=1) / 10
    kinds = ("AG", "CT") if o.compat else ("AG", "GA", "CT", "TC")
    ts = [(a + b).upper() in kinds for a, b in zip(part["ref"].to_pylist(), part["alt"].to_pylist(), strict=True)]
    p_ts = 2 / 3 if o.compat else o.poly_tstv / (1 + o.poly_tstv)
    share = np.ones(part.num_rows) if indel else np.where(ts, p_ts, (1 - p_ts) / 2)
    # compat: the prior of a polymorphism is lost from the score of a substitution
    poly = np.log10(share if o.compat and not indel else model.prior * share) + llk
    _, p = K.config_posterior(np.stack([mono, poly], axis=1))
    p_poly = np.where(poly >= mono, p, 1 - p)
    qual = np.where(poly - mono > 1, 10 * (poly - mono), np.where(p_poly > 0.9999999999, 100.0, -10 * np.log10(np.maximum(1 - p_poly, 1e-11))))
    _, post = model.llk(lk, f, marginals=True)
    best, gq = post.argmax(axis=2), K.genotype_quality(post.max(axis=2))
    gq[~seen] = 0
    lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.astype(np.int32).ravel())
    new = {"qual": pa.array(np.where(seen, qual, np.nan), from_pandas=True), "ref_freq": pa.array(f), "gt": lists(best), "gq": lists(gq), "ac": pa.array(best[:, here].sum(axis=1).astype(np.int32))}
    names = [x.split()[0] for x in REFINED.split(", ")]
    return pa.RecordBatch.from_arrays([new[x] if x in new else part[x] for x in names], names=names)
