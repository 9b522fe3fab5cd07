"""Association of covariates with an ordinal target, collinearity, ranking."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import strength_label
from ..sources.scratch import cut


def average_ranks(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Rank among all rows, ties averaged; null stays null.

    Distinct values are counted and sorted by ranges; the few range totals give each range its offset, and
    a running sum within the range the rest, so no window spans the table.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranges = cut(counts.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
    offset = ranges.groupBy("_p").agg(F.sum("_n").alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offset = offset.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranges.join(F.broadcast(offset), "_p").select("_v", (F.col("_o") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, df[column] == ranks["_v"], "left").drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, rho over the rows complete in both."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    r = average_ranks(average_ranks(rows, "_a", "_ra"), "_b", "_rb")
    return r.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: h (corrected for ties), df, p."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).alias("_v0"), F.col(group).alias("_g"))
    ranked = average_ranks(rows, "_v0", "_r")
    sums = ranked.groupBy("_g").agg(F.sum("_r").alias("s"), F.count("*").alias("m")).agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.sum("m").cast("double").alias("n"), F.count("*").alias("k"))
    ties = rows.groupBy("_v0").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    t = sums.crossJoin(ties)  # one row each
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    return t.select(h.alias("h"), (F.col("k") - 1).alias("df"))


def chi2_tail(x: float | None, df: int) -> float | None:
    """P(χ² > x), by the series or the continued fraction of the incomplete gamma function."""
    if x is None or df < 1:
        return None
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = y + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, df, v; null if a side has fewer than two levels. 2 x 2 tables have Yates' correction."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").cast("double").alias("o"))
    ra = n.groupBy("_a").agg(F.sum("o").alias("ra"))
    cb = n.groupBy("_b").agg(F.sum("o").alias("cb"))
    all_ = n.agg(F.sum("o").alias("n")).crossJoin(ra.agg(F.count("*").alias("ka"))).crossJoin(cb.agg(F.count("*").alias("kb")))
    grid = ra.crossJoin(F.broadcast(cb)).crossJoin(F.broadcast(all_)).join(n, ["_a", "_b"], "left")  # levels are few
    e = F.col("ra") * F.col("cb") / F.col("n")
    off = F.abs(F.coalesce("o", F.lit(0.0)) - e)
    off = F.when((F.col("ka") == 2) & (F.col("kb") == 2), off - F.least(F.lit(0.5), off)).otherwise(off)
    t = grid.groupBy("n", "ka", "kb").agg(F.sum(off * off / e).alias("chi2"))
    ok = (F.col("ka") > 1) & (F.col("kb") > 1)
    v = F.sqrt(F.col("chi2") / (F.col("n") * (F.least("ka", "kb") - 1)))
    return t.select(F.when(ok, F.col("chi2")).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), F.when(ok, v).alias("v"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlations of the complete cases: one pass, a small matrix on the driver."""
    rows = df.dropna(subset=list(columns))
    r = rows.agg(*[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j], F.count("*").alias("n")).first()
    out = np.eye(len(columns))
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            out[i, j] = out[j, i] = np.nan if r[f"{i}_{j}"] is None else r[f"{i}_{j}"]
    return out


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(covariate, vif): diagonal of the inverse correlation matrix; null with too few complete cases, infinity
    where a covariate follows from the others."""
    n = df.dropna(subset=list(columns)).count()
    out: list[tuple[str, float | None]] = [(c, None) for c in columns]
    if n >= len(columns) + 2:
        m = correlation_matrix(df, columns)
        if not np.isnan(m).any():
            for i, c in enumerate(columns):
                rest = np.delete(np.arange(len(columns)), i)
                r2 = float(m[i, rest] @ np.linalg.pinv(m[np.ix_(rest, rest)]) @ m[rest, i]) if len(rest) else 0.0
                out[i] = (c, float("inf") if r2 >= 1 - 1e-12 else round(1 / (1 - r2), 2))
    return df.sparkSession.createDataFrame(out, "covariate string, vif double")


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) of each pair, over the rows complete in the pair."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            row = spearman(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round("rho", 3).alias("rho"))
            out = row if out is None else out.unionAll(row)
    return out


def associate(df: DataFrame, covariate: str, target_rank: str, value_type: str) -> tuple:
    """(test, strength, p, direction) of one covariate with the target; nulls with fewer than three complete rows."""
    if value_type in ("continuous", "ordinal"):
        s = spearman(df, covariate, target_rank).first()
        if s["n"] < 3 or s["rho"] is None:
            return "spearman", None, None, None
        k = kruskal_wallis(df, covariate, target_rank).first()
        return "spearman", abs(s["rho"]), chi2_tail(k["h"], k["df"]), "+" if s["rho"] >= 0 else "-"
    c = cramers_v(df, covariate, target_rank).first()
    return "cramers_v", c["v"] if c else None, chi2_tail(c["chi2"], c["df"]) if c else None, None


def rank_covariates(df: DataFrame, covariates: dict[str, str], target_rank: str) -> DataFrame:
    """Report (covariate, test, strength, label, p, direction, vif), strongest first; covariates: name to type."""
    rows = [(c, *associate(df, c, target_rank, kind)) for c, kind in covariates.items()]
    spark = df.sparkSession
    t = spark.createDataFrame(rows, "covariate string, test string, strength double, p double, direction string")
    numeric = [c for c, kind in covariates.items() if kind != "categorical"]
    if numeric:
        t = t.join(F.broadcast(vif(df, numeric)), "covariate", "left")  # a row a covariate
    return t.select("covariate", "test", F.round("strength", 3).alias("strength"), strength_label(F.col("strength")).alias("label"), "p", "direction", *(["vif"] if numeric else [])).orderBy(F.desc("strength"), "covariate")
