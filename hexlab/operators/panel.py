"""The hex x year panel: history, nearest focus, transitions, gaps, sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def complete_panel(cells: DataFrame, years: DataFrame, observed: DataFrame, key: str = "hex_id", severity: str = "severity") -> DataFrame:
    """Every hex in every year (years: a short list), absence where nothing was observed."""
    grid = cells.select(key).withColumn("year", F.explode(F.lit(sorted(r["year"] for r in years.distinct().collect()))))
    return grid.join(observed.select(key, "year", severity), [key, "year"], "left").withColumn(severity, F.coalesce(severity, F.lit(0)))


def history(panel: DataFrame, window: int, key: str = "hex_id", severity: str = "severity", out: str = "history") -> DataFrame:
    """Sum of severities over the calendar years t - window … t - 1; 0 if there are none."""
    back = Window.partitionBy(key).orderBy("year").rangeBetween(-window, -1)
    return panel.withColumn(out, F.coalesce(F.sum(severity).over(back), F.lit(0)))


def nearest_active(points: DataFrame, panel: DataFrame, active: int, start: float, key: str = "hex_id", severity: str = "severity", out: str = "distance") -> DataFrame:
    """Distance from each hex to the nearest one with severity ``active`` or more in the year before; 0 for an
    active hex, null if that year has no active one or is not in the panel.

    Two quadtrees, one of the hexes and one of the active hexes by year, are walked down together. A square of
    hexes keeps the squares of active ones that may hold the nearest: those that are not farther at best than another
    one is at worst. Each level is two equi-joins with the children of both sides and a minimum by square, so
    neither a far focus nor a crowd of them meets all hexes. ``start`` is the side of the smallest squares.
    """
    rows = panel.select(key, "year").join(points.select(key, "x", "y"), key)
    foci = panel.where(F.col(severity) >= active).select(key, (F.col("year") + 1).alias("year")).join(points.select(key, F.col("x").alias("fx"), F.col("y").alias("fy")), key).drop(key)
    low = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    wide = 0.0 if low[0] is None else max(low[2] - low[0], low[3] - low[1])
    depth = max(0, math.ceil(math.log2(max(wide, start) / start)) + 1)
    square = lambda c, least: F.floor((F.col(c) - F.lit(float(least or 0))) / F.lit(float(start))).cast("long")
    foci = cut(foci.distinct().withColumns({"gx": square("fx", low[0]), "gy": square("fy", low[1])}))
    some = foci.select("year").distinct()
    rows = cut(rows.join(F.broadcast(some), "year").withColumns({"qx": square("x", low[0]), "qy": square("y", low[1])}))  # a row a year
    up = lambda c, n: F.shiftright(c, n).alias(c)
    hexes, spots = cut(rows.select("year", "qx", "qy").distinct()), cut(foci.select("year", "gx", "gy").distinct())
    pairs = some.select("year", *[F.lit(0).cast("long").alias(c) for c in ("qx", "qy", "gx", "gy")])
    for left in range(depth - 1, -1, -1):
        for tree, (x, y) in ((hexes, ("qx", "qy")), (spots, ("gx", "gy"))):
            child = tree.select("year", up(x, left), up(y, left)).distinct()
            child = child.select("year", F.shiftright(x, 1).alias("_x"), F.shiftright(y, 1).alias("_y"), x, y)
            pairs = pairs.withColumnsRenamed({x: "_x", y: "_y"}).join(child, ["year", "_x", "_y"]).drop("_x", "_y")
        dx, dy = F.abs(F.col("qx") - F.col("gx")), F.abs(F.col("qy") - F.col("gy"))
        least = F.greatest(dx - 1, F.lit(0)) * F.greatest(dx - 1, F.lit(0)) + F.greatest(dy - 1, F.lit(0)) * F.greatest(dy - 1, F.lit(0))
        most = (dx + 1) * (dx + 1) + (dy + 1) * (dy + 1)
        bar = F.min(most).over(Window.partitionBy("year", "qx", "qy"))  # the squares that one square has kept
        pairs = cut(pairs.withColumns({"_least": least, "_bar": bar}).where("_least <= _bar").drop("_least", "_bar"))
    met = rows.join(pairs, ["year", "qx", "qy"]).join(foci, ["year", "gx", "gy"])
    best = met.groupBy(key, "year").agg(F.min(F.hypot(F.col("x") - F.col("fx"), F.col("y") - F.col("fy"))).alias(out))
    return panel.select(key, "year").join(best, [key, "year"], "left")


def with_covariates(panel: DataFrame, static: Sequence[DataFrame] = (), yearly: Sequence[DataFrame] = (), key: str = "hex_id") -> DataFrame:
    """Static covariates by hex, yearly ones by hex and year."""
    for s in static:
        panel = panel.join(s, key, "left")
    for y in yearly:
        panel = panel.join(y, [key, "year"], "left")
    return panel


def next_years(panel: DataFrame) -> DataFrame:
    """(year, next_year) over the years that the panel has: one row a year."""
    years = panel.select("year").distinct()
    return years.withColumn("next_year", F.lead("year").over(Window.orderBy("year"))).where("next_year is not null")


def transitions(panel: DataFrame, key: str = "hex_id", state: str = "state", keep: Sequence[str] = ()) -> DataFrame:
    """(key, year_t, state_t, state_t1, …): each hex with its state in the next year that the panel has."""
    follow = F.broadcast(next_years(panel))
    now = panel.join(follow, "year")
    then = panel.select(key, F.col("year").alias("next_year"), F.col(state).alias("state_t1"))
    joined = now.join(then, [key, "next_year"]).where("state_t1 is not null")
    return joined.select(key, F.col("year").alias("year_t"), F.col(state).alias("state_t"), "state_t1", *keep)


def densify(panel: DataFrame, cells: DataFrame, key: str = "hex_id", severity: str = "severity") -> DataFrame:
    """Every hex in every calendar year: a year without any row takes the last map before it (the first map if
    there is none); in a year with rows, hexes without one are 0."""
    seen = panel.select("year").distinct()
    span = seen.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    order = Window.orderBy("year")  # one row a calendar year
    source = span.join(seen.withColumn("seen", F.col("year")), "year", "left")
    source = source.select("year", F.coalesce(F.last("seen", ignorenulls=True).over(order), F.first("seen", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).alias("source_year"))
    grid = cells.select(key).crossJoin(F.broadcast(source))  # calendar years are few
    had = panel.select(key, F.col("year").alias("source_year"), severity)
    return grid.join(had, [key, "source_year"], "left").select(key, "year", "source_year", F.coalesce(severity, F.lit(0)).alias(severity))


def sequences(dense: DataFrame, channels: Sequence[Column], length: int, key: str = "hex_id", target: str = "severity") -> DataFrame:
    """(key, target_year, sequence, target): the channels of the ``length`` years before each target year."""
    back = Window.partitionBy(key).orderBy("year").rowsBetween(-length, -1)
    rows = dense.withColumn("_s", F.collect_list(F.array(*[c.cast("double") for c in channels])).over(back))
    return rows.where(F.size("_s") == length).select(key, F.col("year").alias("target_year"), F.flatten("_s").alias("sequence"), F.col(target).alias("target"))


def wide(panel: DataFrame, years: Sequence[int], key: str = "hex_id", severity: str = "severity") -> DataFrame:
    """One column a year, 0 where there is no row."""
    return panel.groupBy(key).pivot("year", list(years)).agg(F.first(severity)).na.fill(0)


def winter_minimum(daily: DataFrame, before: Sequence[int] = (12,), months: Sequence[int] = (1, 2), key: str = "cell_id") -> DataFrame:
    """(key, season, minimum): the least value of the season that ends in the year ``season``; the months of
    ``before`` belong to the season of the year after."""
    month = F.month("date")
    rows = daily.where(month.isin(*before, *months))
    season = F.year("date") + F.when(month.isin(*before), 1).otherwise(0)
    return rows.groupBy(key, season.alias("season")).agg(F.min("value").alias("minimum"))
