"""Choice model: how much a walker minds sun against shade, from picked and rejected routes."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.functions.exposure import chosen_logit
from penumbra.session import cut


def log_likelihood(pairs: DataFrame, alpha: float, tau: float = 1.0) -> DataFrame:
    """Summed log-probability of the picks; ``pairs`` has ``sun_gap`` and ``shade_gap`` (picked less rejected, metres)."""
    z = chosen_logit(F.col("sun_gap"), F.col("shade_gap"), alpha, tau)
    return pairs.agg(F.sum(-F.log1p(F.exp(-z))).alias("log_likelihood"), F.count("*").alias("n"))


def fit_alpha(pairs: DataFrame, user: str, prior_log: float = 0.0, prior_sd: float = 0.5, rounds: int = 12) -> DataFrame:
    """Most probable weight of sun for every user, by Newton steps on its logarithm; each step is one aggregation."""
    fit = cut(pairs.select(user).distinct().withColumn("log_alpha", F.lit(prior_log)))
    for _ in range(rounds):
        a = F.exp("log_alpha")
        joined = pairs.join(fit, user).withColumn("z", -(F.col("sun_gap") / 100.0 * a + F.col("shade_gap") / 100.0)).withColumn(
            "dz", -F.col("sun_gap") / 100.0 * a
        )
        miss = 1 / (1 + F.exp("z"))
        step = joined.groupBy(user, "log_alpha").agg(
            F.sum(miss * F.col("dz")).alias("g"), F.sum(miss * (1 - miss) * F.col("dz") * F.col("dz")).alias("h")
        )
        pull = (F.col("log_alpha") - prior_log) / prior_sd**2
        moved = (F.col("g") - pull) / (F.col("h") + 1 / prior_sd**2)
        fit = cut(step.select(user, (F.col("log_alpha") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), moved))).alias("log_alpha")))
    return fit.withColumn("alpha", F.exp("log_alpha"))


class Hyper(NamedTuple):
    """The spread of the weight of sun among people, Gamma(shape, rate), the share of tree shade that feels sunny, and the choice's noise."""

    shape: float
    rate: float
    rho: float
    tau: float


class HierarchicalFit(NamedTuple):
    """The most probable parameters, the standard errors of their free forms (logarithms, and the logit of ``rho``) by Laplace's method, and the
    log-posterior."""

    at: Hyper
    errors: tuple[float, float, float, float]
    log_posterior: float


#: Limits of the weight of sun for the quadrature; the hyperpriors' parameters; the parameters' limits; fixed values.
WEIGHTS, TAU_PRIOR, LIMITS = (0.02, 6.0), (12.5, 50.0), {"shape": (0.3, 40.0), "rate": (0.2, 40.0), "tau": (0.05, 5.0)}


#: Nodes whose sums lie in one row.
_NODES = 16


def quadrature(nodes: int) -> list[tuple[float, float]]:
    """Gauss-Legendre points of the weight of sun and the logarithms of their weights."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    low, high = WEIGHTS
    return [(float((high - low) / 2 * a + (high + low) / 2), math.log((high - low) / 2 * b)) for a, b in zip(x, w, strict=True)]


def marginals(rows: DataFrame, user: str, points: list[Hyper], nodes: int = 160) -> DataFrame:
    """``(user), point, log_m, weight``: of every person and point the log-likelihood of their choices with the weight of sun integrated out, and its
    mean given them.

    ``rows`` has the user, ``sun_gap, tree_gap, shade_gap`` (hundreds of metres, first less second) and ``picked`` (1 where the first was). Choices are added
    up by person, point and node before anything is integrated, so a person with many choices is a few sums a task.
    """
    held = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p.rho).alias("rho"), F.lit(p.tau).alias("tau")) for i, p in enumerate(points)))
    grid = quadrature(nodes)
    blocks = [grid[k : k + _NODES] for k in range(0, nodes, _NODES)]
    dealt = F.array(*(F.struct(F.lit(j).alias("j"), F.array(*(F.lit(x) for x, _ in b)).alias("xs")) for j, b in enumerate(blocks)))
    spread = rows.select(user, "sun_gap", "tree_gap", "shade_gap", "picked", F.explode(held).alias("p")).select("*", F.explode(dealt).alias("q"))
    sun = (F.col("sun_gap") + F.col("p.rho") * F.col("tree_gap")) / F.col("p.tau")
    rest = (F.col("shade_gap") + (1 - F.col("p.rho")) * F.col("tree_gap")) / F.col("p.tau")
    side = F.when(F.col("picked") == 1, 1.0).otherwise(-1.0)
    flat = spread.select(user, "p.i", "q.j", "q.xs", (side * sun).alias("_sun"), (side * rest).alias("_rest"))
    miss = [F.get("xs", F.lit(k)) * F.col("_sun") + F.col("_rest") for k in range(min(_NODES, nodes))]
    # A row of sums a person, point and block of nodes: few short rows, and no node or point travels with them.
    lp = [F.sum(-(F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))))).alias(f"_{k}") for k, m in enumerate(miss)]
    added = flat.groupBy(user, "i", "j").agg(*lp)
    at = lambda values: F.get(F.array(*(F.lit(v) for v in values)), F.col("i"))
    added = added.withColumns({"_a": at([p.shape for p in points]), "_b": at([p.rate for p in points]), "_c": at([p.shape * math.log(p.rate) - math.lgamma(p.shape) for p in points])})
    known = F.get(F.array(*(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in b)) for b in blocks)), F.col("j"))
    value = lambda l, q: l + F.col("_c") + (F.col("_a") - 1) * F.log(q["x"]) - F.col("_b") * q["x"] + q["w"]  # noqa: E731, E741
    ts = F.zip_with(F.slice(F.array(*(f"_{k}" for k in range(len(lp)))), 1, F.size("_q")), "_q", lambda l, q: F.struct(value(l, q).alias("v"), q["x"].alias("x")))  # noqa: E741
    listed = added.withColumn("_q", known).select(user, "i", ts.alias("ts"))
    each = listed.groupBy(user, "i").agg(F.flatten(F.collect_list("ts")).alias("ts")).withColumn("top", F.array_max(F.col("ts.v")))
    total = lambda f: F.aggregate("ts", F.lit(0.0), lambda s, t: s + F.exp(t["v"] - F.col("top")) * f(t))
    both = each.select(user, F.col("i").alias("point"), "top", total(lambda _: F.lit(1.0)).alias("m"), total(lambda t: t["x"]).alias("mx"))
    return both.select(user, "point", (F.col("top") + F.log("m")).alias("log_m"), (F.col("mx") / F.col("m")).alias("weight"))


def _free(p: Hyper) -> np.ndarray:
    return np.array([math.log(p.shape), math.log(p.rate), math.log(p.rho / (1 - p.rho)), math.log(p.tau)])


def _bound(x: np.ndarray) -> Hyper:
    return Hyper(math.exp(x[0]), math.exp(x[1]), 1 / (1 + math.exp(-x[2])), math.exp(x[3]))


def log_posterior(rows: DataFrame, user: str, points: list[Hyper], nodes: int = 160) -> list[float]:
    """Of every point the log-likelihood of all choices with the hyperpriors; minus infinity beyond the limits. All points take one aggregation."""
    sums = {r["point"]: r["s"] for r in marginals(rows, user, points, nodes).groupBy("point").agg(F.sum("log_m").alias("s")).collect()}  # a row a point
    out = []
    for i, p in enumerate(points):
        inside = all(low <= getattr(p, k) <= high for k, (low, high) in LIMITS.items())
        h1, h2 = (math.log(p.shape) + math.log(p.rate)) / 2, (math.log(p.shape) - math.log(p.rate)) / 2
        k, rate = TAU_PRIOR
        prior = -(h1 * h1 + h2 * h2) / 2 - math.log(2 * math.pi) + k * math.log(rate) - math.lgamma(k) + (k - 1) * math.log(p.tau) - rate * p.tau
        out.append(sums.get(i, 0.0) + prior if inside else -math.inf)
    return out


def fit_hierarchical(rows: DataFrame, user: str, start: Hyper = Hyper(2.0, 1.7, 0.5, 0.5), nodes: int = 160, rounds: int = 100, tolerance: float = 1e-6) -> HierarchicalFit:  # noqa: B008
    """The most probable parameters by a simplex search whose every step is one aggregation over the table: the points that a step may need are
    tried at once. The errors come from the curvature there. Null gaps and picks take no part."""
    names = ["sun_gap", "tree_gap", "shade_gap", "picked"]
    clean = cut(rows.select(user, *names).where(" and ".join(f"{c} is not null" for c in names)))
    value = lambda xs: [-v for v in log_posterior(clean, user, [_bound(x) for x in xs], nodes)]
    simplex = [_free(start), *(_free(start) + d for d in np.diag([0.3, 0.3, 0.2, 0.2]))]
    at = value(simplex)
    for _ in range(rounds):
        order = np.argsort(at, kind="stable")
        simplex, at = [simplex[i] for i in order], [at[i] for i in order]
        if at[-1] - at[0] < tolerance:
            break
        centre, worst = np.mean(simplex[:-1], axis=0), simplex[-1]
        tried = [centre + f * (centre - worst) for f in (1.0, 2.0, 0.5, -0.5)]
        reflected, expanded, outer, inner = value(tried)
        pick = 1 if expanded < reflected < at[0] else 0 if reflected < at[-2] else 2 if outer < min(reflected, at[-1]) else 3
        chosen = (reflected, expanded, outer, inner)[pick]
        if chosen < at[-1]:
            simplex[-1], at[-1] = tried[pick], chosen
        else:
            simplex = [simplex[0], *((x + simplex[0]) / 2 for x in simplex[1:])]
            at = [at[0], *value(simplex[1:])]
    best, n, step = simplex[int(np.argmin(at))], 4, 0.05
    unit = np.eye(n) * step
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    found = value([best, *(best + a * unit[i] + b * unit[j] for i, j in pairs for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1)))])
    curve = np.zeros((n, n))
    for k, (i, j) in enumerate(pairs):
        pp, pm, mp, mm = found[1 + 4 * k : 5 + 4 * k]
        curve[i, j] = curve[j, i] = (pp - pm - mp + mm) / (4 * step * step)
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(curve)), 0))
    return HierarchicalFit(_bound(best), tuple(float(e) for e in errors), -found[0])
