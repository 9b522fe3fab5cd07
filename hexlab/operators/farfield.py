"""Sums over all pairs of points weighted by a power of their distance, without a row for each pair.

Space is a quadtree. Every square carries moments of the values in it up to the second order; a leaf meets the points
of the squares around it one by one, and from each level above it the moments of those squares that are ``reach``
squares away or more but whose parents were not. So a leaf meets some 3 (2 reach + 1)² squares a level, whatever the
number of points. The third moment bounds what the expansion leaves out, and is returned with every sum.

Leaves are split where they hold more than some dozens of points on average. They go to tasks by square blocks, with the points
of a rim of ``reach`` leaves and the squares that the leaves of the block meet; pairs are worked out in parts of bounded size.
The points of a block go to one task: no more than a task can hold may lie in one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Moments of a value about the centre of its square, by powers of dx and dy.
POWERS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))


#: Points of a leaf, on average, from which it is split.
CROWD = 64
#: Leaves on a side of a block are two to this power.
BITS = 3
#: Pairs that are worked out at once.
PAIRS = 1 << 20


def _inverse(square: np.ndarray, p: int) -> np.ndarray:
    """Distances to the power -p, from their squares."""
    k = 1 / square
    out = np.sqrt(k) if p % 2 else np.ones_like(k)
    for _ in range(p // 2):
        out *= k
    return out


def _meet(x: np.ndarray, y: np.ndarray, powers: Sequence[int], v: np.ndarray) -> list[np.ndarray]:
    """Exact sums of v over points y, for each power; points in the same place do not count."""
    sums = [np.zeros((len(x), v.shape[1])) for _ in powers]
    for b in range(0, len(y), PAIRS):
        step = max(1, PAIRS // min(PAIRS, len(y) - b))
        for a in range(0, len(x), step):
            square = (x[a : a + step, None, 0] - y[None, b : b + PAIRS, 0]) ** 2 + (x[a : a + step, None, 1] - y[None, b : b + PAIRS, 1]) ** 2
            square[square == 0] = np.inf
            for s, p in zip(sums, powers, strict=True):
                s[a : a + step] += _inverse(square, p) @ v[b : b + PAIRS]
    return sums


def _meet_squares(x: np.ndarray, centre: np.ndarray, radius: np.ndarray, m: np.ndarray, powers: Sequence[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums from moments m (squares, 7, values), and bounds on their errors."""
    step = max(1, PAIRS // max(1, len(centre)))
    parts = [_meet_few_squares(x[a : a + step], centre, radius, m, powers) for a in range(0, len(x), step)]
    return tuple([np.concatenate([part[side][j] for part in parts]) for j in range(len(powers))] for side in (0, 1))


def _meet_few_squares(x: np.ndarray, centre: np.ndarray, radius: np.ndarray, m: np.ndarray, powers: Sequence[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    r = x[:, None, :] - centre[None, :, :]
    square = (r**2).sum(axis=2)
    one = [(r[:, :, 0] / square), (r[:, :, 1] / square)]
    beyond = np.square(np.sqrt(square) - radius[None, :])
    sums, errors = [], []
    for p in powers:
        k = _inverse(square, p)
        part = k @ m[:, 0] + p * ((k * one[0]) @ m[:, 1] + (k * one[1]) @ m[:, 2])
        part += p * (p + 2) / 2 * ((k * one[0] ** 2) @ m[:, 3] + 2 * (k * one[0] * one[1]) @ m[:, 4] + (k * one[1] ** 2) @ m[:, 5])
        part -= p / 2 * ((k / square) @ (m[:, 3] + m[:, 5]))
        sums.append(part)
        # the third derivative of d**-p in any direction is at most p (p + 1) (p + 2) d**-(p + 3)
        errors.append(p * (p + 1) * (p + 2) / 6 * _inverse(beyond, p + 3) @ m[:, 6])
    return sums, errors


def distance_sums(points: DataFrame, values: Sequence[str], powers: Sequence[int], leaf: float, reach: int = 2, key: str = "hex_id") -> DataFrame:
    """(key, and for each value v and power p: v_p, the sum of v / d**p over all other points, and v_p_error).

    ``points`` has (key, x, y, values), keys unique. ``leaf`` is the side of the smallest squares, halved until
    they hold some dozens of points each. ``reach`` of one more divides the bound by about the square of the distance in squares.
    """
    k = len(values)
    low = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
    x0, y0 = float(low[0] or 0.0), float(low[1] or 0.0)
    wide = max(float(low[2] or 0.0) - x0, float(low[3] or 0.0) - y0)
    in_leaf = [F.floor((F.col(c) - o) / leaf) for c, o in (("x", x0), ("y", y0))]
    held = low[4] / max(1, points.select(*[c.alias(n) for c, n in zip(in_leaf, ("cx", "cy"), strict=True)]).distinct().count())
    leaf /= 2 ** max(0, math.ceil(math.log(max(held, 1) / CROWD, 4)))
    depth = max(0, math.ceil(math.log2(max(wide, leaf) / leaf))) + (1 if wide > 0 else 0)
    own = cut(
        points.select(
            F.col(key).alias("id"), F.col("x").cast("double"), F.col("y").cast("double"), F.array(*[F.col(v).cast("double") for v in values]).alias("v"),
            F.floor((F.col("x") - x0) / leaf).cast("long").alias("cx"), F.floor((F.col("y") - y0) / leaf).cast("long").alias("cy"),
        )
    )
    # moments of the squares of every level that has squares out of reach
    levels = [lv for lv in range(depth) if 2**(depth - lv) > reach + 1]
    up = own.withColumn("lv", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    up = up.withColumns({c: F.expr(f"shiftright({c}, lv)") for c in ("cx", "cy")})
    side = F.expr(f"cast({leaf!r} as double) * shiftleft(1L, lv)")
    up = up.withColumns({"mx": F.lit(x0) + (F.col("cx") + 0.5) * side, "my": F.lit(y0) + (F.col("cy") + 0.5) * side})
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    moments = [F.sum(F.col("v")[j] * F.pow(dx, F.lit(a)) * F.pow(dy, F.lit(b))) for a, b in POWERS for j in range(k)]
    moments += [F.sum(F.abs(F.col("v")[j]) * F.pow(F.hypot(dx, dy), F.lit(3))) for j in range(k)]
    squares = up.groupBy("lv", "cx", "cy", "mx", "my").agg(F.max(F.hypot(dx, dy)).alias("radius"), F.array(*moments).alias("a"))
    # what the leaves of a block may meet on a level lies within 2 reach + 1 squares of theirs
    own = own.withColumns({"bx": F.shiftright("cx", BITS), "by": F.shiftright("cy", BITS)})
    blocks = own.select("bx", "by").distinct()
    over = F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))
    to = lambda c: F.explode(F.expr(f"sequence(shiftright({c} - {2 * reach + 1}, greatest(0, {BITS} - lv)), shiftright({c} + {2 * reach + 1}, greatest(0, {BITS} - lv)))"))
    far = squares.withColumn("gx", to("cx")).withColumn("gy", to("cy"))
    met = blocks.withColumn("lv", over).withColumns({f"g{c}": F.expr(f"shiftright(b{c}, greatest(0, lv - {BITS}))") for c in "xy"})
    far = far.join(met, ["lv", "gx", "gy"]).select("bx", "by", "lv", "cx", "cy", F.lit(None).cast("long").alias("id"), F.col("mx").alias("x"), F.col("my").alias("y"), "radius", "a")
    rim = lambda c: F.explode(F.sequence(F.shiftright(F.col(c) - reach, BITS), F.shiftright(F.col(c) + reach, BITS)))
    near = own.withColumn("bx", rim("cx")).withColumn("by", rim("cy")).select("bx", "by", F.lit(-1).alias("lv"), "cx", "cy", F.col("id").cast("long"), "x", "y", F.lit(0.0).alias("radius"), F.col("v").alias("a"))
    rows = near.join(blocks, ["bx", "by"], "left_semi").unionAll(far)
    names = [f"{v}_{p}{e}" for p in powers for v in values for e in ("", "_error")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = rows["bx"].iloc[0], rows["by"].iloc[0]
        points, above = rows[rows["lv"] < 0], rows[rows["lv"] >= 0]
        xy, at, v = points[["x", "y"]].to_numpy(), points[["cx", "cy"]].to_numpy(), np.stack(points["a"].to_list())
        mine = np.flatnonzero((at >> BITS == block).all(axis=1))
        out = {"id": points["id"].to_numpy()[mine].astype(np.int64)} | {n: np.zeros(len(mine)) for n in names}
        if len(above):
            m = np.stack(above["a"].to_list()).reshape(len(above), len(POWERS) + 1, k)
            lv, places, centre, radius = above["lv"].to_numpy()[:, None], above[["cx", "cy"]].to_numpy(), above[["x", "y"]].to_numpy(), above["radius"].to_numpy()
        for leaf in np.unique(at[mine], axis=0):
            here = np.flatnonzero((at[mine] == leaf).all(axis=1))
            x = xy[mine[here]]
            beside = (np.abs(at - leaf) <= reach).all(axis=1)
            sums = _meet(x, xy[beside], powers, v[beside])
            errors = [np.zeros_like(s) for s in sums]
            if len(above):
                own = leaf[None] >> lv
                far = (np.abs(own - places) > reach).any(axis=1) & (np.abs((own >> 1) - (places >> 1)) <= reach).all(axis=1)
                if far.any():
                    more, errors = _meet_squares(x, centre[far], radius[far], m[far], powers)
                    sums = [s + t for s, t in zip(sums, more, strict=True)]
            for p, s, e in zip(powers, sums, errors, strict=True):
                for j, v_ in enumerate(values):
                    out[f"{v_}_{p}"][here], out[f"{v_}_{p}_error"][here] = s[:, j], e[:, j]
        return pd.DataFrame(out)

    schema = "id long, " + ", ".join(f"{n} double" for n in names)
    found = rows.groupBy("bx", "by").applyInPandas(run, schema)
    return found.withColumnRenamed("id", key)


def moran_by_distance(values: DataFrame, power: int = 1, leaf: float = 8.0, reach: int = 2, column: str = "value", key: str = "hex_id") -> DataFrame:
    """One row: n, moran_i, error, expected, variance, z, p_value under weights 1 / d**power over all pairs, rows adding up to 1.

    ``values`` has (key, x, y, column). The moments of the weights come from sums of the same kind, so no pair is ever a
    row. ``error`` bounds the difference of moran_i from the sum over pairs; p_value is that of a normal z (one-sided).
    """
    rows = cut(values.where(F.col(column).isNotNull()).select(key, "x", "y", F.col(column).cast("double").alias("v")))
    m = rows.agg(F.count("*"), F.avg("v")).first()
    if m[0] < 4:
        return values.sparkSession.createDataFrame([(m[0], *[None] * 6)], "n long, moran_i double, error double, expected double, variance double, z double, p_value double")
    z = rows.select(key, "x", "y", (F.col("v") - m[1]).alias("z"), F.lit(1.0).alias("one"))
    first = cut(z.join(distance_sums(z, ["one", "z"], [power, 2 * power], leaf, reach, key), key))
    r, square = F.col(f"one_{power}"), F.col(f"one_{2 * power}")
    inverse = first.where(r > 0).withColumn("inv", 1 / r)
    second = distance_sums(inverse.select(key, "x", "y", "inv"), ["inv"], [power, 2 * power], leaf, reach, key)
    t = inverse.join(second, key)
    lag = F.col(f"z_{power}") / r
    off = (F.col(f"z_{power}_error") + F.abs(lag) * F.col(f"one_{power}_error")) / F.greatest(r - F.col(f"one_{power}_error"), r / 2)
    s = t.agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("z") * lag).alias("c"), F.sum(F.abs("z") * off).alias("e"), F.sum(F.col("z") * F.col("z")).alias("m2"), F.sum(F.pow("z", F.lit(4))).alias("m4"),
        F.sum(square / (r * r) + F.col(f"inv_{2 * power}") / r).alias("s1"), F.sum(F.pow(1 + F.col(f"inv_{power}"), F.lit(2))).alias("s2"),
    ).first()
    n, s0 = s["n"], s["n"]
    if not s["m2"]:
        return values.sparkSession.createDataFrame([(int(n), *[None] * 6)], "n long, moran_i double, error double, expected double, variance double, z double, p_value double")
    i, ex, b2 = n / s0 * s["c"] / s["m2"], -1 / (n - 1), n * s["m4"] / s["m2"] ** 2
    top = n * ((n * n - 3 * n + 3) * s["s1"] - n * s["s2"] + 3 * s0 * s0) - b2 * ((n * n - n) * s["s1"] - 2 * n * s["s2"] + 6 * s0 * s0)
    var = top / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - ex * ex
    score = (i - ex) / math.sqrt(var)
    return values.sparkSession.createDataFrame([(int(n), i, s["e"] / s["m2"], ex, var, score, 1 - NormalDist().cdf(score))], "n long, moran_i double, error double, expected double, variance double, z double, p_value double")
