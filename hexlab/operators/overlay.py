"""Overlays of polygons with hexes, raster cells and zones; all are equi-joins on hex coordinates.

Polygons are tables with ``poly`` (see ``functions.geometry``) and its box xmin, ymin, xmax, ymax. A zone of any
shape is a table of signed convex terms by hex (``zone_terms``); a polygon meets only the terms of its own hexes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import spread
from . import grid

#: Areas under this share of a cell's are touch, not overlap.
EPSILON = 1e-13
#: Sums under this share of the sum of their sizes are rounding.
ROUNDING = 1e-11
BOX = ("xmin", "ymin", "xmax", "ymax")


def with_box(df: DataFrame, poly: str = "poly") -> DataFrame:
    return df.withColumns(G.bbox(F.col(poly)))


def hex_edges(width: float, x0: float = 0.0, y0: float = 0.0):
    return G.edges(G.hexagon(grid.center_x(F.col("q"), F.col("r"), width, x0), grid.center_y(F.col("r"), width, y0), width))


def hex_pieces(polys: DataFrame, width: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """One row for each (polygon, hex) that overlap, with q, r and ``piece_area``."""
    near = grid.candidates(spread(polys), width, x0, y0)
    # exploding the list of the one area, if it is enough, keeps Catalyst from computing it twice
    area = F.array(G.clip_area_in_box(F.col("poly"), hex_edges(width, x0, y0), *[F.col(c) for c in BOX]))
    return near.withColumn("piece_area", F.explode(F.filter(area, lambda a: a > EPSILON * grid.hex_area(width))))


def raster_pieces(cells: DataFrame, side: float, width: float) -> DataFrame:
    """Raster cells (x, y: centres) cut by hexes: rows with q, r and ``fraction``, the share of the cell inside."""
    h = side / 2
    box = {"xmin": F.col("x") - h, "ymin": F.col("y") - h, "xmax": F.col("x") + h, "ymax": F.col("y") + h}
    rows = cells.withColumns(box)
    rows = rows.withColumn("poly", G.polygon(G.rectangle(*[F.col(c) for c in box])))
    return hex_pieces(rows, width).withColumn("fraction", F.col("piece_area") / (side * side)).drop("poly", *box)


def resample(cells: DataFrame, points: DataFrame, side: float, value: str, key: str, bilinear: bool = False) -> DataFrame:
    """Value of a regular grid (i, j: column and row of cells of ``side``, centres at i * side, j * side) at points
    (key, x, y): of the nearest cell, or weighted from the four around; null where a cell is missing."""
    at = lambda c: F.col(c) / side
    v = cells.select("i", "j", F.col(value).alias("_v"))
    if not bilinear:
        rows = points.withColumns({"i": F.floor(at("x") + 0.5), "j": F.floor(at("y") + 0.5)})
        return rows.join(v, ["i", "j"], "left").select(key, F.col("_v").alias(value))
    fx, fy = at("x") - F.floor(at("x")), at("y") - F.floor(at("y"))
    corners = [F.struct((F.floor(at("x")) + a).alias("i"), (F.floor(at("y")) + b).alias("j"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("w")) for a in (0, 1) for b in (0, 1)]
    rows = points.select(key, F.explode(F.filter(F.array(*corners), lambda c: c["w"] > 0)).alias("c")).select(key, "c.*")
    got = rows.join(v, ["i", "j"], "left").groupBy(key).agg(F.sum(F.col("w") * F.col("_v")).alias(value), F.count_if(F.col("_v").isNull()).alias("_m"))
    return got.select(key, F.when(F.col("_m") == 0, F.col(value)).alias(value))


#: Where the reference point of a hex lies, in widths from its centre: off any round number, so that no zone's border
#: passes through it.
REFERENCE = (0.0731659302, 0.0419370517)


def zone_edges(zone: DataFrame) -> DataFrame:
    """Sides (ax, ay, bx, by) of all rings of a zone (poly), with the zone to their left."""
    rows = zone.select(F.explode("poly").alias("part"))
    left = (G.signed_area(F.col("part.ring")) >= 0) != F.col("part.hole")
    ring = F.when(left, F.col("part.ring")).otherwise(F.reverse("part.ring"))
    return rows.select(F.explode(G.edges(ring)).alias("e")).select("e.*").where("ax <> bx or ay <> by")


def _edge_hexes(edges: DataFrame, width: float) -> DataFrame:
    """A row for each side and hex (q, r) that it passes through."""
    h, reach = width * grid.ROOT3 / 2, width / grid.ROOT3
    rows = edges.withColumn("r", F.explode(F.sequence(F.ceil((F.least("ay", "by") - reach) / h).cast("int"), F.floor((F.greatest("ay", "by") + reach) / h).cast("int"))))
    rise = F.col("by") - F.col("ay")
    share = lambda y, end: F.when(rise == 0, end).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y - F.col("ay")) / rise)))
    at = lambda y, end: F.col("ax") + share(y, end) * (F.col("bx") - F.col("ax"))
    rows = rows.withColumns({"_u": at(F.col("r") * h - reach, 0.0), "_v": at(F.col("r") * h + reach, 1.0)})
    left = F.ceil((F.least("_u", "_v") - width / 2) / width - F.col("r") / 2).cast("int")
    right = F.floor((F.greatest("_u", "_v") + width / 2) / width - F.col("r") / 2).cast("int")
    rows = rows.withColumn("q", F.explode(F.when(left <= right, F.sequence(left, right)))).drop("_u", "_v")
    cx, cy = grid.center_x(F.col("q"), F.col("r"), width), grid.center_y(F.col("r"), width)
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for ux, uy in ((1.0, 0.0), (0.5, grid.ROOT3 / 2), (-0.5, grid.ROOT3 / 2)):  # the part of the side between two sides of the hex
        s, d = ux * (F.col("ax") - cx) + uy * (F.col("ay") - cy), ux * (F.col("bx") - F.col("ax")) + uy * (F.col("by") - F.col("ay"))
        one, two = (-width / 2 - s) / F.nullif(d, F.lit(0.0)), (width / 2 - s) / F.nullif(d, F.lit(0.0))
        low.append(F.when(d == 0, F.when(F.abs(s) < width / 2, 0.0).otherwise(2.0)).otherwise(F.least(one, two)))
        high.append(F.when(d == 0, 1.0).otherwise(F.greatest(one, two)))
    return rows.where(F.greatest(*low) < F.least(*high))


def zone_terms(zone: DataFrame, width: float) -> DataFrame:
    """Terms (q, r, weight, cell) of a zone: within a hex, the zone is the sum of weight times the part of the hex
    inside the convex cell (``edges``; none: the whole hex).

    Whether a place lies in the zone follows from whether the hex's reference point does, and from the sides of the zone
    that the way from there crosses, all of them in the hex. So one term says how often the zone holds the
    reference point, and each side in the hex adds the region behind it. A zone of V sides makes V terms, each
    in the few hexes that the side passes through, and one for each hex inside.
    """
    h, (ox, oy) = width * grid.ROOT3 / 2, (REFERENCE[0] * width, REFERENCE[1] * width)
    edges = zone_edges(zone)
    # hexes of a row whose reference point lies left of a side: those up to _c
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = (lambda y: F.ceil((y - oy) / h)), (lambda y: F.ceil((y - oy) / h) - 1)
    rows = edges.withColumn("r", F.explode(F.when(first(low) <= last(high), F.sequence(first(low).cast("int"), last(high).cast("int")))))
    x = F.col("ax") + (F.col("r") * h + oy - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    rows = rows.select("r", (F.ceil((x - ox) / width - F.col("r") / 2) - 1).cast("int").alias("_c"), F.when(F.col("by") > F.col("ay"), 1).otherwise(-1).alias("_s"))
    rows = rows.groupBy("r", "_c").agg(F.sum("_s").alias("_s"))
    along = Window.partitionBy("r").orderBy(F.desc("_c"))  # the crossings of one row of hexes
    rows = rows.select("r", "_c", F.sum("_s").over(along).alias("weight"), F.lead("_c").over(along).alias("_b")).where("weight <> 0 and _b is not null")
    inner = rows.select(F.explode(F.sequence(F.col("_b") + 1, F.col("_c"))).alias("q"), "r", F.col("weight").cast("double").alias("weight"), F.expr("cast(array() as array<struct<ax:double,ay:double,bx:double,by:double>>)").alias("cell"))
    near = _edge_hexes(edges, width)
    px, py = grid.center_x(F.col("q"), F.col("r"), width) + ox, grid.center_y(F.col("r"), width) + oy
    near = near.withColumns({"_px": px, "_py": py})
    left = (F.col("bx") - F.col("ax")) * (F.col("_py") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("_px") - F.col("ax"))
    side = lambda a, b: F.struct(*[F.col(c).cast("double").alias(k) for c, k in zip((*a, *b), ("ax", "ay", "bx", "by"), strict=True)])
    a, b, p = ("ax", "ay"), ("bx", "by"), ("_px", "_py")
    behind = F.when(left > 0, F.array(side(p, a), side(b, p), side(b, a))).otherwise(F.array(side(p, b), side(a, p), side(a, b)))
    border = near.where(left != 0).select("q", "r", F.when(left > 0, -1.0).otherwise(1.0).alias("weight"), behind.alias("cell"))
    return inner.unionByName(border)


def _zone_area(rows: DataFrame, width: float, weight: Column, cell: Column, keys: Sequence[str], out: str) -> DataFrame:
    """Sum of the weighted areas of polygons (poly, box) in their hexes (q, r) and cells, where it is not rounding."""
    sides = F.concat(hex_edges(width), cell)
    area = weight * G.clip_area_in_box(F.col("poly"), sides, *[F.col(c) for c in BOX])
    sums = rows.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias(out), F.sum(F.abs("_a")).alias("_t"))
    return sums.where(F.col(out) > ROUNDING * F.col("_t")).drop("_t")


def clip_to_zone(polys: DataFrame, zone: DataFrame, width: float, keys: Sequence[str], out: str = "area") -> DataFrame:
    """Area of each polygon (told by ``keys``) inside the zone; polygons outside have no row."""
    met = grid.candidates(spread(polys), width).join(zone_terms(zone, width), ["q", "r"])
    return _zone_area(met, width, F.col("weight"), F.col("cell"), keys, out)


def clip_to_both(polys: DataFrame, zone: DataFrame, other: DataFrame, width: float, keys: Sequence[str], out: str = "area") -> DataFrame:
    """Area of each polygon inside the zone and inside the other one."""
    met = grid.candidates(spread(polys), width).join(zone_terms(zone, width), ["q", "r"])
    met = met.join(zone_terms(other, width).withColumnsRenamed({"weight": "_w2", "cell": "_c2"}), ["q", "r"])
    return _zone_area(met, width, F.col("weight") * F.col("_w2"), F.concat("cell", "_c2"), keys, out)


def difference_area(polys: DataFrame, zone: DataFrame, hole: DataFrame, width: float, keys: Sequence[str], out: str = "area") -> DataFrame:
    """Area of each polygon inside the zone less what lies in the hole as well; polygons outside the zone have no row."""
    inside = clip_to_zone(polys, zone, width, keys, "_in")
    both = clip_to_both(polys, zone, hole, width, keys, "_both")
    return inside.join(both, list(keys), "left").select(*keys, (F.col("_in") - F.coalesce("_both", F.lit(0.0))).alias(out))


def intersecting(polys: DataFrame, zone: DataFrame, width: float, keys: Sequence[str]) -> DataFrame:
    """Whole polygons that overlap the zone; a shared border alone is no overlap."""
    return polys.join(clip_to_zone(polys, zone, width, keys).select(*keys), list(keys), "left_semi")


def hex_grid(zone: DataFrame, width: float) -> DataFrame:
    """Hexes (hex_id, q, r, cx, cy, hex_area) that overlap the zone."""
    at = grid.center_x(F.col("q"), F.col("r"), width), grid.center_y(F.col("r"), width)
    rows = with_box(zone_terms(zone, width).withColumn("poly", G.polygon(G.hexagon(*at, width))))
    cells = _zone_area(rows, width, F.col("weight"), F.col("cell"), ["q", "r"], "_in").where(F.col("_in") > EPSILON * grid.hex_area(width))
    return cells.select(grid.hex_id(F.col("q"), F.col("r")).alias("hex_id"), "q", "r", at[0].alias("cx"), at[1].alias("cy"), F.lit(grid.hex_area(width)).alias("hex_area"))


def lattice_runs(polys: DataFrame, side: float, keys: Sequence[str] = ()) -> DataFrame:
    """Runs (keys…, j, i0, i1) of lattice cells of a row j whose centre lies in a polygon; runs may overlap."""
    low, high = F.ceil(F.col("ymin") / side - 0.5).cast("long"), F.floor(F.col("ymax") / side - 0.5).cast("long")
    rows = spread(polys).withColumn("j", F.explode(F.when(low <= high, F.sequence(low, high)))).withColumn("_y", (F.col("j") + 0.5) * side)
    crossing = lambda e: (e["ay"] > F.col("_y")) != (e["by"] > F.col("_y"))
    at = lambda e: e["ax"] + (F.col("_y") - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])
    xs = F.array_sort(F.flatten(F.transform("poly", lambda r: F.transform(F.filter(G.edges(r["ring"]), crossing), at))))
    cell = lambda x: F.ceil(x / side - 0.5)
    pairs = lambda x: F.transform(F.filter(F.sequence(F.lit(1), F.size(x) - 1), lambda k: k % 2 == 1), lambda k: F.struct(cell(F.get(x, k - 1)).alias("i0"), (cell(F.get(x, k)) - 1).alias("i1")))
    rows = rows.select(*keys, "j", xs.alias("_x")).where(F.size("_x") > 1)
    return rows.select(*keys, "j", F.explode(pairs(F.col("_x"))).alias("_r")).select(*keys, "j", "_r.i0", "_r.i1").where("i0 <= i1")


def zone_runs(zone: DataFrame, side: float) -> DataFrame:
    """Runs (j, i0, i1) of the lattice cells whose centre lies in a zone, without overlaps: each side of the zone
    goes to the rows that it crosses."""
    first, last = F.ceil(F.least("ay", "by") / side - 0.5), F.ceil(F.greatest("ay", "by") / side - 0.5) - 1
    rows = zone_edges(zone).withColumn("j", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))))
    x = F.col("ax") + ((F.col("j") + 0.5) * side - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    rows = rows.groupBy("j", F.ceil(x / side - 0.5).alias("i0")).agg(F.sum(F.when(F.col("by") > F.col("ay"), -1).otherwise(1)).alias("_s"))
    along = Window.partitionBy("j").orderBy("i0")  # the crossings of one row of the lattice
    rows = rows.select("j", "i0", (F.lead("i0").over(along) - 1).alias("i1"), F.sum("_s").over(along).alias("_s"))
    return rows.where("_s <> 0 and i1 is not null").drop("_s")


def union_area(polys: DataFrame, side: float, keys: Sequence[str], out: str = "area", zone: DataFrame | None = None) -> DataFrame:
    """Area that the polygons of each group cover (inside the zone), overlaps counted once, by lattice cells. Rows
    are runs of cells, not cells: a run adds what lies beyond the runs before it."""
    runs = lattice_runs(polys, side, keys)
    if zone is not None:
        z = zone_runs(zone, side).withColumnsRenamed({"i0": "_z0", "i1": "_z1"})
        runs = runs.join(z, "j").where("i0 <= _z1 and _z0 <= i1").select(*keys, "j", F.greatest("i0", "_z0").alias("i0"), F.least("i1", "_z1").alias("i1"))
    before = Window.partitionBy(*keys, "j").orderBy("i0", "i1").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("i1") - F.greatest(F.col("i0") - 1, F.max("i1").over(before))
    runs = runs.select(*keys, F.greatest(new, F.lit(0)).alias("_n"))
    return runs.groupBy(*keys).agg((F.sum("_n") * side * side).alias(out))
