"""Pointy-top hexagons of a fixed flat-to-flat width: assignment, grids, neighbours, weights.

A hex is its axial coordinates (q, r); its id packs both, its geometry follows from them and is never stored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT3 = math.sqrt(3.0)
#: Steps to the six neighbours.
STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))


def hex_id(q: Column, r: Column) -> Column:
    return q.cast("long") * (1 << 32) + (r.cast("long") + (1 << 31))


def hex_area(width: float) -> float:
    return width * width * ROOT3 / 2


def center_x(q: Column, r: Column, width: float, x0: float = 0.0) -> Column:
    return F.lit(x0) + F.lit(width) * (q + r / 2)


def center_y(r: Column, width: float, y0: float = 0.0) -> Column:
    return F.lit(y0) + F.lit(width * ROOT3 / 2) * r


def assign_hex(df: DataFrame, width: float, x: str = "x", y: str = "y", x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Adds (q, r) of the hex that holds each point: closed form, no join. A point on a border goes to the smaller r, then q."""
    px, py, r = F.col(x), F.col(y), F.col("_r")
    left = lambda r: F.ceil((px - x0) / width - r / 2 - 0.5).cast("int")
    far = lambda q, r: F.pow(px - center_x(q, r, width, x0), F.lit(2)) + F.pow(py - center_y(r, width, y0), F.lit(2))
    # the nearest of the row of centres below and of that above
    df = df.withColumn("_r", F.floor((py - y0) / (width * ROOT3 / 2)).cast("int")).withColumns({"_q0": left(r), "_q1": left(r + 1)})
    df = df.withColumn("_up", far(F.col("_q1"), r + 1) < far(F.col("_q0"), r))
    return df.withColumns({"q": F.when(F.col("_up"), F.col("_q1")).otherwise(F.col("_q0")), "r": F.when(F.col("_up"), r + 1).otherwise(r)}).drop("_r", "_q0", "_q1", "_up")


def candidates(df: DataFrame, width: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """One row for each hex whose box may meet the box (xmin, ymin, xmax, ymax) of a row; adds (q, r)."""
    h, reach = width * ROOT3 / 2, width / ROOT3
    rows = F.sequence(F.ceil((F.col("ymin") - y0 - reach) / h).cast("int"), F.floor((F.col("ymax") - y0 + reach) / h).cast("int"))
    out = df.withColumn("r", F.explode(rows))
    left = F.ceil((F.col("xmin") - x0 - width / 2) / width - F.col("r") / 2).cast("int")
    right = F.floor((F.col("xmax") - x0 + width / 2) / width - F.col("r") / 2).cast("int")
    return out.withColumn("q", F.explode(F.when(left <= right, F.sequence(left, right))))


def neighbours(cells: DataFrame, key: str = "hex_id", weights: bool = True) -> DataFrame:
    """Edges (src, dst, w) between hexes that share a side, rows of w adding up to 1; lone hexes have none."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in STEPS])).alias("s")
    near = cells.select(F.col(key).alias("src"), "q", "r", step).select("src", (F.col("q") + F.col("s.dq")).alias("q"), (F.col("r") + F.col("s.dr")).alias("r"))
    edges = near.join(cells.select(F.col(key).alias("dst"), "q", "r"), ["q", "r"]).select("src", "dst")
    return row_standardised(edges.withColumn("w", F.lit(1.0))) if weights else edges


def row_standardised(edges: DataFrame) -> DataFrame:
    total = edges.groupBy("src").agg(F.sum("w").alias("_w"))
    return edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("_w")).alias("w"))


def inverse_distance(points: DataFrame, max_dist: float, power: int = 1, key: str = "hex_id") -> DataFrame:
    """Edges (src, dst, w) of points within ``max_dist``, w = 1 / d**power, rows adding up to 1."""
    return inverse_distances(points, max_dist, [power], key).withColumnRenamed(f"w_{power}", "w")


def inverse_distances(points: DataFrame, max_dist: float, powers: Sequence[int], key: str = "hex_id") -> DataFrame:
    """Edges (src, dst, w_p for each power p) of points within ``max_dist``, w_p = 1 / d**p, rows of each adding up to 1.

    Points are dealt to square cells of side ``max_dist``; each meets its own and the eight around. Pairs are met twice,
    for the totals of their rows and again for the weights, so that no shuffle, sort or join ever holds an edge: points
    are all that moves.
    """
    cell = lambda c: F.floor(F.col(c) / max_dist).cast("long")
    near = F.sequence(F.lit(-1), F.lit(1))
    a = points.select(F.col(key).alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("gx"), cell("y").alias("gy"))
    b = points.select(F.col(key).alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("gx"), cell("y").alias("gy"))
    b = b.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumns({"gx": F.col("gx") + F.col("dx"), "gy": F.col("gy") + F.col("dy")}).drop("dx", "dy")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    square = dx * dx + dy * dy
    weight = {p: 1 / F.pow(F.sqrt(square), F.lit(p)) for p in powers}
    meet = lambda a: a.join(b, ["gx", "gy"]).where((F.col("src") != F.col("dst")) & (square <= max_dist * max_dist) & (square > 0))
    totals = meet(a).groupBy("src").agg(*[F.sum(w).alias(f"_t{p}") for p, w in weight.items()])
    return meet(a.join(totals, "src")).select("src", "dst", *[(w / F.col(f"_t{p}")).alias(f"w_{p}") for p, w in weight.items()])
