"""Likelihood kernels over a batch of S sites, in NumPy alone.

A family is a tree of persons and couples. Sum-product messages run over it twice, towards one person and back, and give
the family's likelihood and every person's genotype distribution at once. Messages are scaled at each step and the
logarithms of the scales kept, so that large families don't underflow. Genotypes are 3 (ref/ref, ref/alt, alt/alt) or,
where mutations are scored, the 10 unordered pairs of bases.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

GENOTYPES10 = [(a, b) for a in range(4) for b in range(a, 4)]
INDEX10 = {p: i for i, p in enumerate(GENOTYPES10)}
#: Joint prior of a lone couple's genotypes, father by mother.
COUPLE_PRIOR = np.array([[0.0, 0.24, 0.04], [0.24, 0.16, 0.08], [0.04, 0.08, 0.12]])
LOW, HIGH = 1e-4, 0.9999


def trio_table(klass: str = "autosome", sex: int = 0) -> np.ndarray:
    """P(child | father, mother) as [child, father, mother] over three genotypes."""
    t = np.zeros((3, 3, 3))
    passes = lambda g: np.array([1 - g / 2, g / 2])  # noqa: E731  probability to pass ref, alt
    for f in range(3):
        for m in range(3):
            if klass == "Y":
                if sex == 1:
                    t[f, f, m] = 1.0
                else:
                    t[:, f, m] = 1.0  # a daughter has no genotype there; her data must count nothing
                continue
            if klass == "MT":
                t[m, f, m] = float(m != 1)
                continue
            if klass == "X" and sex == 1:
                a = passes(m)
                t[0, f, m], t[2, f, m] = a[0], a[1]
                continue
            a, b = passes(f), passes(m)
            if klass == "X" and f == 1:
                continue  # no father is heterozygous on X
            t[0, f, m], t[1, f, m], t[2, f, m] = a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[1] * b[1]
    return t


def trio_table10() -> np.ndarray:
    """[child, father, mother] over ten genotypes: each of the four pairs of drawn alleles adds a quarter."""
    t = np.zeros((10, 10, 10))
    for i, f in enumerate(GENOTYPES10):
        for j, m in enumerate(GENOTYPES10):
            for a in f:
                for b in m:
                    t[INDEX10[min(a, b), max(a, b)], i, j] += 0.25
    return t


def mutation_matrix(mu: float, tstv: float) -> np.ndarray:
    """[from, to] over bases: stay, or a transition, or one of two transversions."""
    m = np.full((4, 4), mu * 0.5 / (1 + tstv))
    for a in range(4):
        m[a, a], m[a, a ^ 2] = 1 - mu, mu * tstv / (1 + tstv)
    return m


def mutation_matrix10(mu: float, tstv: float) -> np.ndarray:
    """[from, to] over genotypes: both alleles change by themselves; the two orders of a heterozygote are added."""
    m, out = mutation_matrix(mu, tstv), np.zeros((10, 10))
    for i, (a, b) in enumerate(GENOTYPES10):
        for j, (x, y) in enumerate(GENOTYPES10):
            out[i, j] = m[a, x] * m[b, y] + (m[a, y] * m[b, x] if x != y else 0.0)
    return out


def denovo_trio_table(mu: float, tstv: float) -> np.ndarray:
    return np.einsum("gfm,gc->cfm", trio_table10(), mutation_matrix10(mu, tstv))


def founder_prior(f: np.ndarray, klass: str = "autosome", sex: int = 0) -> np.ndarray:
    """[S, 3] at reference frequencies f [S]; haploid for MT, Y and the male X; a female Y counts nothing."""
    z = np.zeros_like(f)
    if klass == "Y" and sex == 2:
        return np.stack([z + 1, z, z], axis=1)
    if klass in ("MT", "Y") or (klass == "X" and sex == 1):
        return np.stack([f, z, 1 - f], axis=1)
    return np.stack([f * f, 2 * f * (1 - f), (1 - f) ** 2], axis=1)


@dataclass
class Family:
    """Members of one family: ids, the places of father and mother (-1: founder) and sex (1, 2, 0)."""

    ids: list[int]
    father: list[int]
    mother: list[int]
    sex: list[int]
    couples: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    order: list[tuple[str, int, tuple[int, int]]] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)

    def __post_init__(self):
        for c, (f, m) in enumerate(zip(self.father, self.mother, strict=True)):
            if (f < 0) != (m < 0):
                raise ValueError(f"person {self.ids[c]} has one known parent")
            if f >= 0:
                self.couples.setdefault((f, m), []).append(c)
        self.peel_order()

    @property
    def founders(self) -> list[int]:
        return [i for i, f in enumerate(self.father) if f < 0]

    @property
    def nuclear(self) -> bool:
        return len(self.couples) == 1 and len(self.founders) == 2

    @property
    def unrelated(self) -> bool:
        return not self.couples

    def peel_order(self) -> None:
        """Messages from the leaves towards a root of every connected part: ("up" from person to couple, "down" from
        couple to person). A part with as many links as nodes has a loop, which is an error."""
        around: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(self.ids))}
        for couple, children in self.couples.items():
            for p in (*couple, *children):
                if couple in around[p]:
                    raise ValueError(f"person {self.ids[p]} is a parent and a child of one couple")
                around[p].append(couple)
        seen: set[int] = set()
        done: set[tuple[int, int]] = set()
        for root in range(len(self.ids)):
            if root in seen:
                continue
            self.roots.append(root)
            seen.add(root)
            steps, todo = [], [(root, None)]
            while todo:
                p, via = todo.pop()
                for couple in around[p]:
                    if couple == via:
                        continue
                    if couple in done:
                        raise ValueError(f"the pedigree has a loop at person {self.ids[p]}")
                    done.add(couple)
                    steps.append(("down", p, couple))
                    for q in (*couple, *self.couples[couple]):
                        if q != p:
                            if q in seen:
                                raise ValueError(f"the pedigree has a loop at person {self.ids[q]}")
                            seen.add(q)
                            steps.append(("up", q, couple))
                            todo.append((q, couple))
            self.order += reversed(steps)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = x.reshape(len(x), -1).max(axis=1)
    safe = np.where(top > 0, top, 1.0)
    with np.errstate(divide="ignore"):
        return x / safe.reshape((-1,) + (1,) * (x.ndim - 1)), np.log10(np.where(top > 0, top, 0.0))


def peel(fam: Family, own: np.ndarray, tables: dict[int, np.ndarray], joint: np.ndarray | None = None, marginals: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(log10 likelihood [S], distributions [S, n, G]).

    own: [S, n, G], the likelihood of each person's data, for founders times the prior. tables: for each child its
    [child, father, mother]. joint: for a lone couple the joint prior [G, G] of its genotypes, own then without prior."""
    s, n, g = own.shape
    messages: dict[tuple, np.ndarray] = {}
    total = np.zeros(s)

    def from_person(p: int, couple: tuple[int, int]) -> np.ndarray:
        out = own[:, p]
        for other in fam.couples:
            if other != couple and ("c", other, p) in messages:
                out = out * messages["c", other, p]
        return out

    def children_terms(couple: tuple[int, int], but: int) -> np.ndarray | float:
        out: np.ndarray | float = 1.0
        for c in fam.couples[couple]:
            if c != but:
                out = out * np.einsum("cfm,sc->sfm", tables[c], messages["p", c, couple])
        return out

    def to_person(couple: tuple[int, int], p: int) -> np.ndarray:
        f, m = couple
        terms = children_terms(couple, p) * (1.0 if joint is None else joint)
        if p == f:
            return np.einsum("sfm,sm->sf", np.broadcast_to(terms, (s, g, g)), messages["p", m, couple])
        if p == m:
            return np.einsum("sfm,sf->sm", np.broadcast_to(terms, (s, g, g)), messages["p", f, couple])
        both = terms * messages["p", f, couple][:, :, None] * messages["p", m, couple][:, None, :]
        return np.einsum("cfm,sfm->sc", tables[p], both)

    for kind, p, couple in fam.order:
        if kind == "up":
            messages["p", p, couple], scale = _scaled(from_person(p, couple))
        else:
            messages["c", couple, p], scale = _scaled(to_person(couple, p))
        total += scale

    def belief(p: int) -> np.ndarray:
        out = own[:, p]
        for couple in fam.couples:
            if ("c", couple, p) in messages:
                out = out * messages["c", couple, p]
        return out

    with np.errstate(divide="ignore"):
        for root in fam.roots:
            total += np.log10(belief(root).sum(axis=1))
    if not marginals:
        return total, None
    for kind, p, couple in reversed(fam.order):  # and back: each message once the other way
        if kind == "up":
            messages["c", couple, p], _ = _scaled(to_person(couple, p))
        else:
            messages["p", p, couple], _ = _scaled(from_person(p, couple))
    out = np.stack([belief(p) for p in range(n)], axis=1)
    sums = out.sum(axis=2, keepdims=True)
    return total, np.where(sums > 0, out / np.where(sums > 0, sums, 1), 0.0)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials [.., degree, S]."""
    if a.shape[-2] < b.shape[-2]:
        a, b = b, a
    n = a.shape[-2]
    out = np.zeros((*np.broadcast_shapes(a.shape[:-2], b.shape[:-2]), n + b.shape[-2] - 1, a.shape[-1]))
    for j in range(b.shape[-2]):
        out[..., j : j + n, :] += a * b[..., j : j + 1, :]
    return out


def allele_counts(fam: Family, own: np.ndarray, tables: dict[int, np.ndarray], klass: str) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of a scale [S], c [k + 1, S]): at the frequency f the family's likelihood is the scale times the sum over j of
    c[j] f^j (1 - f)^(k - j), where j counts the reference alleles among the founders' k. own: [S, n, 3], without a prior.

    Messages run towards the root as in peel(); each is a polynomial with terms above zero only, so that nothing cancels."""
    s = len(own)
    data = np.ascontiguousarray(np.moveaxis(own, 0, 2))[:, :, None, :]  # [n, 3, 1, S]
    persons = list(data)
    for i in fam.founders:
        k = founder_copies(klass, fam.sex[i])
        persons[i] = np.zeros((3, k + 1, s))
        for g, j in ((0, k), (1, 1), (2, 0)) if k == 2 else ((0, k), (2, 0)) if k else ((0, 0),):
            persons[i][g, j] = data[i, g, 0] * (2 if g == 1 else 1)
    messages: dict[tuple, np.ndarray] = {}
    total = np.zeros(s)

    def of_person(p: int, but: tuple[int, int] | None) -> np.ndarray:
        out = persons[p]
        for couple in fam.couples:
            if couple != but and ("c", couple, p) in messages:
                out = _times(out, messages["c", couple, p])
        return out

    def to_person(couple: tuple[int, int], p: int) -> np.ndarray:
        f, m = couple
        both = np.ones((3, 3, 1, s))
        for c in fam.couples[couple]:
            if c != p:
                both = _times(both, np.tensordot(tables[c], messages["p", c, couple], axes=(0, 0)))
        if p != f:
            both = _times(both, messages["p", f, couple][:, None])
        if p != m:
            both = _times(both, messages["p", m, couple][None])
        return both.sum(axis=1) if p == f else both.sum(axis=0) if p == m else np.tensordot(tables[p], both, axes=2)

    def scaled(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=tuple(range(x.ndim - 1)))
        with np.errstate(divide="ignore"):
            total[:] += np.log10(top)
        return x / np.where(top > 0, top, 1.0)

    for kind, p, couple in fam.order:
        if kind == "up":
            messages["p", p, couple] = scaled(of_person(p, couple))
        else:
            messages["c", couple, p] = scaled(to_person(couple, p))
    c = np.ones((1, s))
    for root in fam.roots:
        c = scaled(_times(c, of_person(root, None).sum(axis=0)))
    return total, c


def bounded_maximum(value, s: int, steps: int = 60, grid: int = 17, width: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(f, value(f)) maximising value: [S] -> [S] over [LOW, HIGH], each site by itself: the best point of a grid, then
    golden sections around it for all sites at once, until all are within the width."""
    points = np.linspace(LOW, HIGH, grid)
    values = np.stack([value(np.full(s, p)) for p in points])
    best = values.argmax(axis=0)
    a, b = points[np.maximum(best - 1, 0)], points[np.minimum(best + 1, grid - 1)]
    r = (5**0.5 - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    vc, vd = value(c), value(d)
    while steps and (b - a).max(initial=0.0) > width:
        left = vc >= vd
        a, b = np.where(left, a, c), np.where(left, d, b)
        new = np.where(left, b - r * (b - a), a + r * (b - a))
        c, d = np.where(left, new, d), np.where(left, c, new)
        v = value(new)
        vc, vd = np.where(left, v, vd), np.where(left, vc, v)
        steps -= 1
    f, v = np.where(vc >= vd, c, d), np.maximum(vc, vd)
    at_grid = values.max(axis=0) > v
    return np.where(at_grid, points[best], f), np.where(at_grid, values.max(axis=0), v)


def founder_copies(klass: str, sex: int) -> int:
    """Alleles that a founder brings in on a class of chromosome."""
    if klass == "Y" and sex == 2:
        return 0
    return 1 if klass in ("MT", "Y") or (klass == "X" and sex == 1) else 2


def frequency_maximum(evaluate, value_of, s: int, width: float = 1e-4, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(f, log10 likelihood) maximising over [LOW, HIGH], each site by itself, from expected counts.

    evaluate(f [R], rows [R]) gives the log10 likelihood and the reference share among the founders' alleles as expected at f;
    value_of(f, rows) the likelihood alone.
    What the share lies above f has the sign of the likelihood's slope, and is a straight line in f where data leave
    no doubt: the secant between points of both signs then meets its root at once, and a point beside it on the other side
    proves it. A step that does not halve the bracket is followed by one that does. Sites in doubt, whose bracket is wider than
    `width` after all steps, or whose signs or ends tell of two maxima, go through bounded_maximum()."""
    rows = np.arange(s)
    ends = np.stack([np.full(s, x) for x in (LOW, 0.5, HIGH)])
    seen = [evaluate(x, rows) for x in ends]
    value, over = np.stack([v for v, _ in seen]), np.stack([e for _, e in seen]) - ends
    up = over >= 0
    lower = np.where(up[1], 1, 0)  # the bracket's lower end among the three
    lo, hi = ends[lower, rows], ends[lower + 1, rows]
    at_lo, at_hi, v_lo, v_hi = over[lower, rows], over[lower + 1, rows], value[lower, rows], value[lower + 1, rows]
    todo, halve = np.flatnonzero(up[0] & ~up[2]), np.zeros(s, dtype=bool)
    beside = width / 2
    while len(todo) and steps:
        steps -= 1
        span = hi[todo] - lo[todo]
        x = np.clip(lo[todo] + span * at_lo[todo] / (at_lo[todo] - at_hi[todo]), lo[todo] + beside, hi[todo] - beside)
        x = np.where(halve[todo], lo[todo] + span / 2, x)
        v, e = evaluate(x, todo)
        right = e >= x  # the root is to the right of x
        for here, bound, at, values in ((right, lo, at_lo, v_lo), (~right, hi, at_hi, v_hi)):
            k = todo[here]
            bound[k], at[k], values[k] = x[here], (e - x)[here], v[here]
        now = hi[todo] - lo[todo]
        halve[todo] = (now > span / 2) & ~halve[todo]
        todo = todo[now > width]
    edge = np.where(up[0] & up[2], 2, 0)
    inner = up[0] & ~up[2]
    f = np.where(inner, np.where(v_lo >= v_hi, lo, hi), ends[edge, rows])
    best = np.where(inner, np.maximum(v_lo, v_hi), value[edge, rows])
    doubt = (~up[0] & (up[1] | up[2])) | (up[0] & ~up[1] & up[2]) | (best < value.max(axis=0) - 1e-9)
    doubt[todo] = True
    if doubt.any():
        k = np.flatnonzero(doubt)
        f[k], best[k] = bounded_maximum(lambda x: value_of(x, k), len(k), width=width)
    return f, best


def config_posterior(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best config, its posterior) of log10 scores [S, K]; ties keep the first."""
    best = scores.argmax(axis=1)
    top = scores.max(axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return best, 1 / np.power(10.0, scores - top).sum(axis=1)


def genotype_quality(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0.9999999999, 100, np.floor(-10 * np.log10(np.maximum(1 - p, 1e-11)) + 0.5)).astype(int)


# The published rational approximations (AS 241) of the normal quantile, numerator and denominator from the constant on, for
# probabilities near a half, in the tails and in the far tails.
_QUANTILE = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The value that a standard normal variable stays below with probability p; nan outside of (0, 1)."""
    p = np.asarray(p, dtype=float)
    ratio = lambda k, x: np.polynomial.polynomial.polyval(x, _QUANTILE[k][0]) / np.polynomial.polynomial.polyval(x, _QUANTILE[k][1])
    q = p - 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        near = q * ratio(0, 0.180625 - q * q)
        tail = np.sign(q) * np.where(r <= 5, ratio(1, r - 1.6), ratio(2, r - 5))
        return np.where((p > 0) & (p < 1), np.where(np.abs(q) <= 0.425, near, tail), np.nan)


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees > x): the regularised upper incomplete gamma function."""
    from math import exp, lgamma, log

    if x <= 0 or df <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = a * log(z) - z - lgamma(a)
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * exp(front))
    # continued fraction, from its tail
    f = 0.0
    for k in range(300, 0, -1):
        f = k * (k - a) / (z + 2 * k + 1 - a - f)
    return exp(front) / (z + 1 - a - f)


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction from the tail."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    f = 0.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        f = even / (1 + odd / (1 + f))
    first = -(a + b) * x / (a + 1)
    return exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / (a * (1 + first / (1 + f)))


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t with df degrees of freedom."""
    return beta_tail(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f) for Fisher's F with df1 and df2 degrees of freedom."""
    return 1.0 if f <= 0 else beta_tail(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)
