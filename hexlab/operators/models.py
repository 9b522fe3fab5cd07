"""Cross-sectional regressions from one pass of cross products, spatial likelihoods, and the forecasts' forest.

Row-level work stays on the executors: lags, cross products, residuals. The driver sees the matrix of cross
products (a few dozen numbers squared), determinants for some values of rho, and coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import logdet
from .spatial import global_moran, spatial_lag

RESULT = "model string, status string, aic double, bic double, pseudo_r2 double, moran_p double, rho double, lambda double, log_lik double, log_det_error double, n long"


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Sums of products of all pairs of columns, in one aggregate; and the number of rows."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = df.agg(F.count("*").alias("n"), *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        g[i, j] = g[j, i] = r[f"p{i}_{j}"] or 0.0
    return g, r["n"]


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    sse: float
    n: int

    @property
    def log_lik(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi) + math.log(max(self.sse, 1e-300) / self.n) + 1)

    def criteria(self, extra: int = 1, log_det: float = 0.0) -> tuple[float, float, float]:
        """AIC, BIC, log-likelihood; ``extra`` parameters besides the coefficients."""
        ll, k = self.log_lik + log_det, len(self.beta) + extra
        return -2 * ll + 2 * k, -2 * ll + math.log(self.n) * k, ll


def least_squares(g: np.ndarray, index: dict[str, int], y: dict[str, float], x: list[dict[str, float]], names: list[str], n: int) -> Fit:
    """Regression of one linear combination of columns on others, from the cross products alone."""
    def dot(a: dict[str, float], b: dict[str, float]) -> float:
        return sum(u * v * g[index[p], index[q]] for p, u in a.items() for q, v in b.items())

    xx = np.array([[dot(a, b) for b in x] for a in x])
    xy = np.array([dot(a, y) for a in x])
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    m = xx / np.outer(scale, scale)
    beta = np.linalg.lstsq(m, xy / scale, rcond=1e-12)[0] / scale
    sse = dot(y, y) - 2 * beta @ xy + beta @ xx @ beta
    return Fit(names, beta, float(max(sse, 0.0)), n)


def curvature(knots: Sequence[float], low: float, high: float) -> np.ndarray:
    """Integrals over [low, high] of products of second derivatives of u², u³ and the cubes that begin at the knots."""
    cuts = sorted({low, high, *(k for k in knots if low < k < high)})
    at, weight = np.polynomial.legendre.leggauss(2)  # exact for the squares of straight pieces
    u = np.concatenate([(a + b) / 2 + (b - a) / 2 * at for a, b in zip(cuts, cuts[1:], strict=False)] or [np.zeros(0)])
    w = np.concatenate([(b - a) / 2 * weight for a, b in zip(cuts, cuts[1:], strict=False)] or [np.zeros(0)])
    d = np.array([np.full(len(u), 2.0), 6 * u, *(6 * np.maximum(u - k, 0) for k in knots)])
    return (d * w) @ d.T


@dataclass
class Additive:
    """An additive fit: its coefficients, effective number of coefficients, and the smoothing of each covariate."""

    fit: Fit
    freedom: float
    smoothing: list[float]


def additive(g: np.ndarray, index: dict[str, int], y: str, base: list[str], smooths: list[tuple[list[str], np.ndarray]], n: int, rounds: int = 6) -> Additive:
    """Penalised regression of y on ``base`` (free) and groups of terms, each with its own curvature penalty, from the
    cross products alone; the smoothing of every group by generalised cross-validation, one group after the other."""
    names = [*base, *(t for terms, _ in smooths for t in terms)]
    at = [index[v] for v in names]
    xx, xy, yy = g[np.ix_(at, at)], g[at, index[y]], g[index[y], index[y]]
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    m, v, blocks, first = xx / np.outer(scale, scale), xy / scale, [], len(base)
    for terms, s in smooths:
        own = slice(first, first + len(terms))
        first += len(terms)
        s = s / np.outer(scale[own], scale[own])
        top = np.trace(s)
        blocks.append((own, s / top if top > 0 else np.eye(len(terms))))

    def solve(logs: Sequence[float]) -> tuple[float, np.ndarray, float, float]:
        a = m.copy()
        for (own, s), k in zip(blocks, logs, strict=True):
            a[own, own] += 10.0**k * s
        inverse = np.linalg.pinv(a, rcond=1e-13, hermitian=True)
        beta = inverse @ v
        freedom, sse = float(np.trace(inverse @ m)), float(max(yy - 2 * beta @ v + beta @ m @ beta, 0.0))
        return n * sse / max(n - freedom, 1e-9) ** 2, beta, freedom, sse

    logs = [0.0] * len(blocks)
    for step in [1.0] * (rounds - 2) + [0.25] * 2 if blocks else []:
        before = list(logs)
        for i in range(len(blocks)):
            tried = np.arange(-8.0, 8.5, 1.0) if step == 1.0 else logs[i] + step * np.arange(-4, 5)
            logs[i] = float(min(tried, key=lambda k, i=i: (solve([*logs[:i], k, *logs[i + 1 :]])[0], -k)))
        if step == 1.0 and logs == before:
            continue
    _, beta, freedom, sse = solve(logs)
    return Additive(Fit(names, beta / scale, sse, n), freedom, [10.0**k for k in logs])


def maximise(f: Callable[[float], float], low: float = -0.999, high: float = 0.999, points: int = 61) -> float:
    """The rho of the largest value: a grid over atanh(rho), then a golden section around its best point."""
    grid = np.linspace(math.atanh(low), math.atanh(high), points)
    i = int(np.argmax([f(math.tanh(v)) for v in grid]))
    a, b = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    while b - a > 1e-9:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if f(math.tanh(c)) > f(math.tanh(d)) else (c, b)
    return math.tanh((a + b) / 2)


def likeliest(fits: dict[str, Callable[[float], Fit]], det: logdet.Determinant, half: float = 0.1, rounds: int = 8) -> dict[str, tuple[float, float, float]]:
    """(rho, ln |I - rho W|, its error) of the largest likelihood of each model.

    Searched first on the interpolated determinant, then on narrow pieces of it around what was found, which move along
    until the best point lies inside its piece; the determinant there is then computed itself.
    """
    best = {name: maximise(lambda r, fit=fit: fit(r).log_lik + det(r)) for name, fit in fits.items()}
    moved = set(fits)
    for _ in range(rounds):
        det.refine([best[name] for name in moved], half)
        for name in list(moved):
            t, fit = math.atanh(best[name]), fits[name]
            low, high = max(t - half, -det.high), min(t + half, det.high)
            best[name] = maximise(lambda r, fit=fit: fit(r).log_lik + det(r), math.tanh(low), math.tanh(high), 9)
            if abs(math.atanh(best[name]) - t) < 0.9 * half or abs(math.atanh(best[name])) > det.high - half:
                moved.discard(name)
        if not moved:
            break
    at = list(best.values())
    values, errors = det.compute(at)
    return {name: (r, v, e + abs(v - det(r))) for name, r, v, e in zip(best, at, values, errors, strict=True)}


def compare_models(df: DataFrame, edges: DataFrame, y: str, covariates: Sequence[str], key: str = "hex_id", place: tuple[str, str] | None = None, det: logdet.Determinant | None = None, knots: int = 8) -> DataFrame:
    """OLS, lagged covariates, spatial lag, spatial error, both Durbin models and an additive model: one row each.

    All seven come from one matrix of cross products of y, X, their lags and the lags of the lags. ``place`` names the
    columns of the cells' integer coordinates (q and r, if ``df`` has them); with them the determinants of the spatial
    likelihoods are exact. ``log_det_error`` bounds what is left; rho and lambda lie between -0.999 and 0.999.
    """
    spark = df.sparkSession
    if not covariates:
        return spark.createDataFrame([("all", "aucune_covariable", *[None] * 8, 0)], RESULT)
    rows = df.select(key, F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]).dropna()
    rows = cut(rows)
    n = rows.count()
    if n < len(covariates) + 5:
        return spark.createDataFrame([("all", "train_insuffisant", *[None] * 8, n)], RESULT)
    e = edges.join(rows.select(F.col(key).alias("dst")), "dst", "left_semi").join(rows.select(F.col(key).alias("src")), "src", "left_semi")
    total = e.groupBy("src").agg(F.sum("w").alias("_w"))
    e = cut(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("_w")).alias("w")))
    x = [f"x{i}" for i in range(len(covariates))]
    one = spatial_lag(rows, e, ["y", *x], key, prefix="w_")
    two = spatial_lag(one, e, [f"w_{c}" for c in x], key, prefix="w_")
    # a constant's lag is 1 where there is a neighbour
    linked = e.select(F.col("src").alias(key)).distinct().withColumn("w_c", F.lit(1.0))
    all_ = cut(two.join(linked, key, "left").withColumn("w_c", F.coalesce("w_c", F.lit(0.0))).withColumn("c", F.lit(1.0)))
    # additive model: cubic pieces at inner quantiles
    quantiles = all_.approxQuantile(x, [(k + 1) / (knots + 1) for k in range(knots)], 0.001)
    span = all_.agg(*[f(c).alias(p + c) for c in x for p, f in (("m", F.avg), ("s", F.stddev_samp), ("l", F.min), ("h", F.max))]).first()
    smooths: list[tuple[list[str], np.ndarray]] = []
    for c, qs in zip(x, quantiles, strict=True):
        mean, sd = span["m" + c], span["s" + c] or 1.0
        unit, low, high = (F.col(c) - mean) / sd, (span["l" + c] - mean) / sd, (span["h" + c] - mean) / sd
        inner = [k for k in sorted({(q - mean) / sd for q in qs}) if low < k < high]
        terms = {f"{c}_2": unit * unit, f"{c}_3": unit * unit * unit} if inner else {}  # two values make a line
        for k, q in enumerate(inner):
            terms[f"{c}_k{k}"] = F.when(unit > q, (unit - q) * (unit - q) * (unit - q)).otherwise(0.0)
        all_ = all_.withColumns(terms)
        if terms:
            smooths.append((list(terms), curvature(inner, low, high)))
    all_ = cut(all_)
    wx, wwx = [f"w_{c}" for c in x], [f"w_w_{c}" for c in x]
    splines = [t for terms, _ in smooths for t in terms]
    columns = ["c", "w_c", "y", "w_y", *x, *wx, *wwx, *splines]
    g, n = cross_products(all_, columns)
    index = {c: i for i, c in enumerate(columns)}
    if place is None and {"q", "r"} <= set(df.columns):
        place = ("q", "r")
    if det is None:
        det = logdet.determinant(e, df.select(key, *(place or ())).join(rows.select(key), key, "left_semi"), key, place)
    lag_of = {"y": "w_y", "c": "w_c"} | dict(zip(x, wx, strict=True)) | dict(zip(wx, wwx, strict=True))

    def plain(names: list[str]) -> Fit:
        return least_squares(g, index, {"y": 1.0}, [{v: 1.0} for v in names], names, n)

    def lag(names: list[str], rho: float) -> Fit:
        return least_squares(g, index, {"y": 1.0, "w_y": -rho}, [{v: 1.0} for v in names], names, n)

    def error(names: list[str], lam: float) -> Fit:
        return least_squares(g, index, {"y": 1.0, "w_y": -lam}, [{v: 1.0, lag_of[v]: -lam} for v in names], names, n)

    base, durbin = ["c", *x], ["c", *x, *wx]
    found: list[tuple[str, Fit, float | None, float | None, float]] = [("OLS", plain(base), None, None, 0.0), ("SLX", plain(durbin), None, None, 0.0)]
    spatial = {"SAR": (base, lag), "SEM": (base, error), "SDM": (durbin, lag), "SDEM": (durbin, error)}
    best = likeliest({name: (lambda r, names=names, kind=kind: kind(names, r)) for name, (names, kind) in spatial.items()}, det)
    for name, (names, kind) in spatial.items():
        r, value, _ = best[name]
        found.append((name, kind(names, r), r if kind is lag else None, r if kind is error else None, value))
    gam = additive(g, index, "y", ["c", *x], smooths, n)
    found.append(("GAM", gam.fit, None, None, 0.0))
    # residuals of all models at once, on the executors
    residual = {}
    for name, f, rho, lam, _ in found:
        fit = sum((float(b) * (F.col(v) - (lam * F.col(lag_of[v]) if lam is not None else 0.0)) for v, b in zip(f.names, f.beta, strict=True)), F.lit(0.0))
        shift = rho if rho is not None else lam if lam is not None else 0.0
        residual[f"e_{name}"] = F.col("y") - shift * F.col("w_y") - fit
    res = cut(all_.select(key, "y", *[v.alias(k) for k, v in residual.items()]))
    fits = res.agg(*[F.corr(F.col("y") - F.col(k), F.col("y")).alias(k) for k in residual]).first()
    out = []
    for name, f, rho, lam, d in found:
        extra = 1 + (rho is not None or lam is not None)
        if name == "GAM":
            extra = 1 + gam.freedom - len(f.beta)
        aic, bic, ll = f.criteria(extra, d)
        m = global_moran(res, e, f"e_{name}", key).first()
        p = 1 - NormalDist().cdf(m["z"]) if m and m["z"] is not None else None
        r2 = fits[f"e_{name}"]
        out.append((name, "ok", float(aic), float(bic), None if r2 is None else float(r2) ** 2, p, rho, lam, float(ll), best[name][2] if name in best else None, int(n)))
    return spark.createDataFrame(out, RESULT)


def forest_predict(train: DataFrame, test: DataFrame, predictors: Sequence[str], label: str = "state_t1", trees: int = 300, seed: int = 1, categorical: Sequence[str] = ()) -> DataFrame | None:
    """``test`` with ``predicted`` of a random forest on complete cases; None with under ten of them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = cut(train.dropna(subset=[*predictors, label]).withColumn("_label", F.col(label).cast("double")))
    if rows.limit(10).count() < 10:
        return None
    steps = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in categorical]
    inputs = [f"_i_{c}" if c in categorical else c for c in predictors]
    steps += [VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="skip"), RandomForestClassifier(featuresCol="_features", labelCol="_label", predictionCol="_p", numTrees=trees, seed=seed)]
    model = Pipeline(stages=steps).fit(rows)
    return model.transform(test).withColumn("predicted", F.col("_p").cast("int")).select(*test.columns, "predicted")
