"""Exact area that polygons cover together, overlaps counted once, by square tiles that are split where they are crowded.

Sides of polygons are dealt to the tiles that they pass through; to the tiles to their right, as far as the polygon goes,
they are upright sides on the left border, of which those of one polygon and stretch become one row. A tile that a single
polygon fills needs nothing more. A tile with more than ``LIMIT`` rows is split into four, so a place where many
polygons lie on each other ends as filled tiles and a thin rim. In the other tiles the ends and crossings of sides cut
the height into slabs; inside a slab the covered length is linear, so its value at half height gives the area.

Where the first tiles are crowded, tiles two levels down that one polygon fills are told by the polygons alone, and only the
sides in other tiles are shuffled: the rims, however many polygons lie on each other.

A zone is dealt to tiles in the same way, once for all groups; tiles that it does not reach are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import cut, spread

#: Rows of a tile that is not split any more.
LIMIT = 48
#: Times that a tile is split at most; what is crowded then is worked out as it is, with the same result.
LEVELS = 16
#: Stretches that add up to this share of a tile's height are all of it.
WHOLE = 1 - 1e-13
TILE, ENDS = ["_g", "i", "j"], ["x0", "y0", "x1", "y1"]


def _sides(polys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sides from their lower to their upper end; ``s`` is what the cover changes by from left to right."""
    rows = spread(polys).select(F.struct(F.lit(0).alias("_0"), *keys).alias("_g"), F.xxhash64("poly").alias("pid"), G.bbox(F.col("poly"))["xmax"].alias("xmax"), F.explode("poly").alias("part"))
    left = (G.signed_area(F.col("part.ring")) >= 0) != F.col("part.hole")
    rows = rows.select("_g", "pid", "xmax", F.explode(G.edges(F.when(left, F.col("part.ring")).otherwise(F.reverse("part.ring")))).alias("e")).where("e.ay <> e.by")
    up = F.col("e.by") > F.col("e.ay")
    end = lambda a, b: F.when(up, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}"))
    return rows.select("_g", "pid", "xmax", F.when(up, -1).otherwise(1).cast("long").alias("s"), end("ax", "bx").alias("x0"), end("ay", "by").alias("y0"), end("bx", "ax").alias("x1"), end("by", "ay").alias("y1"))


def _x(y: Column, of: str = "") -> Column:
    """Where a side is at the height y."""
    c = lambda k: F.col(of + k)
    return F.when(y == c("y0"), c("x0")).when(y == c("y1"), c("x1")).otherwise(c("x0") + (y - c("y0")) / (c("y1") - c("y0")) * (c("x1") - c("x0")))


def _dealt(rows: DataFrame, side: float, split: bool) -> DataFrame:
    """Rows of tiles of a side; with ``split`` the rows are those of tiles of twice the side and go to their quarters."""
    return _merged(_spread_out(rows, side, split))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*TILE, "pid", "xmax", *ENDS).agg(F.sum("s").alias("s")).where("s <> 0")


def _spread_out(rows: DataFrame, side: float, split: bool) -> DataFrame:
    """``_dealt`` before equal sides of a polygon become one row: nothing is shuffled."""
    between = lambda low, high: F.explode(F.when(low <= high, F.sequence(low, high)))
    first, last = (lambda v: F.floor(v / side)), (lambda v: F.ceil(v / side) - 1)
    rows = rows.withColumnsRenamed({"i": "_i", "j": "_j"}).withColumn("j", between(first(F.col("y0")), last(F.col("y1"))))
    rows = rows.withColumns({"_a": F.greatest("y0", F.col("j") * side), "_b": F.least("y1", (F.col("j") + 1) * side)})
    rows = rows.select("*", _x(F.col("_a")).alias("_u"), _x(F.col("_b")).alias("_v"))
    low, high = first(F.least("_u", "_v")), last(F.col("xmax"))
    if split:
        low, high = F.greatest(low, 2 * F.col("_i")), F.least(high, 2 * F.col("_i") + 1)
    rows = rows.withColumn("i", between(low, high))
    border = F.col("i") * side
    passed = F.greatest("_u", "_v") <= border
    x = lambda c: F.when(passed, border).otherwise(F.col(c))
    return rows.select(*TILE, "pid", F.least("xmax", border + side).alias("xmax"), x("_u").alias("x0"), F.col("_a").alias("y0"), x("_v").alias("x1"), F.col("_b").alias("y1"), "s")


def _inner(polys: DataFrame, keys: Sequence[str], side: float) -> DataFrame:
    """Tiles that lie within a polygon of one ring (and its holes), told by the polygon alone. In a row of tiles that the ring
    passes from below to above, no side crosses what lies right of all its left borders and left of all its right ones,
    and that is inside. Only tiles leave the task, each once."""
    rows = spread(polys).where(F.size(F.filter("poly", lambda r: ~r["hole"])) == 1)
    y = F.flatten(F.transform(F.filter("poly", lambda r: ~r["hole"]), lambda r: F.transform(r["ring"], lambda p: p["y"])))
    one = lambda a, b, c, e, right: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), e.alias("y1"), right.alias("right"))

    def borders(r: Column) -> Column:
        left = (G.signed_area(r["ring"]) >= 0) != r["hole"]
        up = lambda e: e["by"] > e["ay"]
        low = lambda e: F.when(up(e), one(e["ax"], e["ay"], e["bx"], e["by"], left)).otherwise(one(e["bx"], e["by"], e["ax"], e["ay"], ~left))
        return F.transform(F.filter(G.edges(r["ring"]), lambda e: e["ay"] != e["by"]), low)

    rows = rows.select(F.struct(F.lit(0).alias("_0"), *keys).alias("_g"), F.flatten(F.transform("poly", borders)).alias("_e"), F.array_min(y).alias("_low"), F.array_max(y).alias("_high"))
    first, last = F.ceil(F.col("_low") / side), F.floor(F.col("_high") / side) - 1
    rows = rows.withColumn("j", F.explode(F.when(first <= last, F.sequence(first, last))))
    a, b = F.col("j") * side, (F.col("j") + 1) * side
    met = F.filter("_e", lambda e: (e["y0"] < b) & (e["y1"] > a))
    at = lambda e, y: e["x0"] + (y - e["y0"]) / (e["y1"] - e["y0"]) * (e["x1"] - e["x0"])
    ends = lambda e: (at(e, F.greatest(e["y0"], a)), at(e, F.least(e["y1"], b)))
    low = F.array_max(F.transform(F.filter("_m", lambda e: ~e["right"]), lambda e: F.greatest(*ends(e))))
    high = F.array_min(F.transform(F.filter("_m", lambda e: e["right"]), lambda e: F.least(*ends(e))))
    rows = rows.select("_g", "j", met.alias("_m")).select("_g", "j", F.ceil(low / side).alias("_i"), (F.floor(high / side) - 1).alias("_k"))
    return rows.select("_g", F.explode(F.when(F.col("_i") <= F.col("_k"), F.sequence("_i", "_k"))).alias("i"), "j").distinct()


def _crowds(polys: DataFrame, keys: Sequence[str], side: float) -> tuple[DataFrame, float, list[DataFrame]] | None:
    """Rows to go on with and the side of their tiles, and areas that are known, where tiles of the first side are crowded:
    those are taken two levels down at once, and what lies in tiles that a polygon fills is dropped before anything
    is shuffled, so that rims are all that is. None where no tile is crowded."""
    sides = _sides(polys, keys).withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    rows = _spread_out(sides, side, False)
    crowded = cut(rows.groupBy(*TILE).count().where(F.col("count") > LIMIT).select(*TILE))
    if crowded.isEmpty():
        return None
    small = side / 4
    above = [F.shiftright(c, 2).alias(c) for c in ("i", "j")]
    full = cut(_inner(polys, keys, small).withColumns({"_i": F.col("i"), "_j": F.col("j")}).select("_g", *above, "_i", "_j").join(crowded, TILE, "left_semi"))
    open_ = cut(crowded.join(full.groupBy(*TILE).count().where("count = 16").select(*TILE), TILE, "left_anti"))
    full = full.select("_g", F.col("_i").alias("i"), F.col("_j").alias("j"))
    light = cut(_merged(rows.join(crowded, TILE, "left_anti")))
    rim = _spread_out(_spread_out(rows.join(open_, TILE, "left_semi"), side / 2, True), small, True).join(full, TILE, "left_anti")
    known = [full.select("_g", F.lit(small * small).alias("area")), _covered(light, side).select("_g", "area")]
    return cut(_merged(rim)), small, known




def _filled(rows: DataFrame, side: float) -> DataFrame:
    """Tiles that one polygon fills: all that it has there are stretches of the left border, as high as the tile."""
    upright = (F.col("x0") == F.col("i") * side) & (F.col("x1") == F.col("x0")) & (F.col("s") > 0) & (F.col("xmax") >= (F.col("i") + 1) * side)
    by = rows.groupBy(*TILE, "pid").agg(F.min(upright).alias("_all"), F.sum(F.col("y1") - F.col("y0")).alias("_h"))
    return by.where(F.col("_all") & (F.col("_h") >= WHOLE * side)).select(*TILE).distinct()


def _covered(rows: DataFrame, side: float, both: bool = False) -> DataFrame:
    """(_g, i, j, area) of slabs of tiles; with ``both`` of what lies in the zone, whose rows change ``t``, as well."""
    left, right = F.col("i") * side, (F.col("i") + 1) * side
    ends = rows.select(*TILE, F.explode(F.array("y0", "y1")).alias("y"))
    meets = lambda border: (F.col("x0") - border) * (F.col("x1") - border) < 0
    at = lambda border: F.col("y0") + (border - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    borders = rows.select(*TILE, F.explode(F.array(F.when(meets(left), at(left)), F.when(meets(right), at(right)))).alias("y")).where("y is not null")
    inner = rows.where(F.greatest("x0", "x1") > left).select(*TILE, *ENDS)
    a, b = inner.select(*TILE, *[F.col(c).alias(f"a{c}") for c in ENDS]), inner.select(*TILE, *[F.col(c).alias(f"b{c}") for c in ENDS])
    pairs = a.join(b, TILE).where(F.struct(*[f"a{c}" for c in ENDS]) < F.struct(*[f"b{c}" for c in ENDS]))
    pairs = pairs.withColumns({"_a": F.greatest("ay0", "by0"), "_b": F.least("ay1", "by1")}).where("_a < _b")
    pairs = pairs.select(*TILE, "_a", "_b", (_x(F.col("_a"), "a") - _x(F.col("_a"), "b")).alias("_d"), (_x(F.col("_b"), "a") - _x(F.col("_b"), "b")).alias("_e")).where("_d * _e < 0")
    crossings = pairs.select(*TILE, (F.col("_a") + F.col("_d") / (F.col("_d") - F.col("_e")) * (F.col("_b") - F.col("_a"))).alias("y"))
    heights = ends.unionAll(borders).unionAll(crossings).distinct()
    slabs = heights.select(*TILE, F.col("y").alias("_a"), F.lead("y").over(Window.partitionBy(*TILE).orderBy("y")).alias("_b")).where("_b is not null")
    mid = F.col("_a") + (F.col("_b") - F.col("_a")) / 2
    covers = ["s", "t"] if both else ["s"]
    met = slabs.join(rows.select(*TILE, *ENDS, *covers), TILE).where((F.col("y0") <= F.col("_a")) & (F.col("y1") >= F.col("_b")))
    met = met.select(*TILE, "_a", "_b", F.greatest(left, F.least(right, _x(mid))).alias("x"), *covers).groupBy(*TILE, "_a", "_b", "x").agg(*[F.sum(c).alias(c) for c in covers])
    along = Window.partitionBy(*TILE, "_a", "_b").orderBy("x")
    width = F.coalesce(F.lead("x").over(along), right) - F.col("x")
    met = met.select(*TILE, "_a", "_b", width.alias("_w"), F.least(*[F.sum(c).over(along) for c in covers], *([] if both else [F.lit(1)])).alias("_n")).where("_n > 0")
    return met.select(*TILE, (F.col("_w") * (F.col("_b") - F.col("_a"))).alias("area"))


def _with_zone(rows: DataFrame, zone: DataFrame) -> DataFrame:
    """The rows of tiles and those that the zone has in them."""
    of = rows.select(*TILE).distinct().join(zone.select("i", "j", *ENDS, F.col("s").alias("t")), ["i", "j"])
    return rows.select(*TILE, *ENDS, "s", F.lit(0).cast("long").alias("t")).unionByName(of.select(*TILE, *ENDS, F.lit(0).cast("long").alias("s"), "t"))


def exact_union_area(polys: DataFrame, side: float, keys: Sequence[str] = (), out: str = "area", zone: DataFrame | None = None) -> DataFrame:
    """Area (keys…, ``out``) that the polygons (poly) of each group cover (inside the zone: rows with poly, which may
    overlap), exact but for the rounding of doubles.

    ``side`` is that of the first tiles, about the size of a polygon or more: it changes the work, not the result. A group
    is told by its keys, nulls included. Groups without any area, and null or empty polygons, have no row; holes are left
    out, and repeated polygons count once. Polygons are taken to be valid: rings do not cross themselves and
    holes lie inside.
    """
    first = lambda df, by: cut(_dealt(_sides(df, by).withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")}), side, False))
    none = F.lit(0).cast("long")
    crowds = _crowds(polys, keys, side) if zone is None else None
    if crowds is None:
        rows, done = first(polys, keys), []
    else:
        rows, side, done = crowds
    if zone is not None:
        edge = first(zone, ())
        rows = rows.join(edge.select("i", "j").distinct(), ["i", "j"], "left_semi")
    for level in range(LEVELS + 1):
        filled = _filled(rows, side)
        if zone is None:
            filled = cut(filled)
            done.append(filled.select("_g", F.lit(side * side).alias("area")))
        else:  # a tile with many sides of the zone is split, filled or not
            sides = cut(edge.groupBy("i", "j").agg(F.count("*").alias("_z")))
            filled = cut(filled.join(sides.where(F.lit(level == LEVELS) | (F.col("_z") <= LIMIT)), ["i", "j"], "left_semi").select(*TILE))
            plain = edge.join(filled.select("i", "j").distinct(), ["i", "j"], "left_semi")
            done.append(filled.join(_covered(plain, side).groupBy("i", "j").agg(F.sum("area").alias("area")), ["i", "j"]).select("_g", "area"))
        rest = rows.join(filled, TILE, "left_anti")
        counts = rest.groupBy(*TILE).count()
        if zone is not None:
            counts = counts.join(sides, ["i", "j"], "left").withColumn("count", F.col("count") + F.coalesce("_z", none))
        crowded = cut(counts.where((F.col("count") > LIMIT) & F.lit(level < LEVELS)).select(*TILE))
        light = rest.join(crowded, TILE, "left_anti")
        done.append((_covered(light, side) if zone is None else _covered(_with_zone(light, edge), side, True)).select("_g", "area"))
        if crowded.isEmpty():
            break
        side /= 2
        rows = cut(_dealt(rest.join(crowded, TILE, "left_semi"), side, True))
        if zone is not None:
            edge = cut(_dealt(edge.join(crowded.select("i", "j").distinct(), ["i", "j"], "left_semi"), side, True))
            rows = rows.join(edge.select("i", "j").distinct(), ["i", "j"], "left_semi")
    every = done[0]
    for more in done[1:]:
        every = every.unionAll(more)
    return every.groupBy("_g").agg(F.sum("area").alias(out)).select(*[F.col("_g")[k].alias(k) for k in keys], out)
