"""Polygon geometry in column expressions: area, clipping to convex cells, point tests, projection.

A ring is an array of structs (x, y), not closed; a polygon an array of structs (ring, hole). Clipping follows
Sutherland and Hodgman: the ring is cut by one edge of the convex cell after the other. Areas of the clipped
rings are right for concave rings as well, for the bridges that clipping leaves have no area.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
POLYGON = f"array<struct<ring:{RING},hole:boolean>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Ring of an axis-aligned rectangle, counter-clockwise."""
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax))


def polygon(ring: Column, *holes: Column) -> Column:
    parts = [(ring, False), *((h, True) for h in holes)]
    return F.array(*[F.struct(r.alias("ring"), F.lit(h).alias("hole")) for r, h in parts])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def turned(ring: Column) -> Column:
    """The ring from its second vertex on, the first one last; ``ring`` is a column or a bound value."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive if counter-clockwise."""
    cross = lambda r: F.zip_with(r, turned(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return let(ring, lambda r: F.aggregate(cross(r), F.lit(0.0), lambda s, v: s + v)) / 2


def area(poly: Column) -> Column:
    """Area of a polygon: its rings less its holes."""
    return F.aggregate(poly, F.lit(0.0), lambda s, r: s + F.abs(signed_area(r["ring"])) * F.when(r["hole"], -1).otherwise(1))


def centroid(ring: Column) -> Column:
    """Centroid of a ring, taken about its first vertex; null without area."""
    o = F.element_at(ring, 1)
    pairs = F.zip_with(
        ring, turned(ring), lambda a, b: F.struct(((a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])).alias("c"), (a["x"] + b["x"] - 2 * o["x"]).alias("x"), (a["y"] + b["y"] - 2 * o["y"]).alias("y"))
    )
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, v: s + f(v))
    a = F.nullif(total(lambda v: v["c"]), F.lit(0.0)) * 3
    return F.struct((o["x"] + total(lambda v: v["c"] * v["x"]) / a).alias("x"), (o["y"] + total(lambda v: v["c"] * v["y"]) / a).alias("y"))


def bbox(poly: Column) -> dict[str, Column]:
    x = F.flatten(F.transform(poly, lambda r: F.transform(r["ring"], lambda p: p["x"])))
    y = F.flatten(F.transform(poly, lambda r: F.transform(r["ring"], lambda p: p["y"])))
    return {"xmin": F.array_min(x), "ymin": F.array_min(y), "xmax": F.array_max(x), "ymax": F.array_max(y)}


def edges(ring: Column) -> Column:
    return let(ring, lambda g: F.zip_with(g, turned(g), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))))


def clip(ring: Column, cell: Column) -> Column:
    """The part of a ring inside a convex counter-clockwise cell, given as ``edges``."""

    def by_edge(acc: Column, e: Column) -> Column:
        side = lambda p: (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) - (e["by"] - e["ay"]) * (p["x"] - e["ax"])
        marked = F.transform(acc, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side(p).alias("s")))

        def step(p: Column, n: Column) -> Column:
            t = p["s"] / (p["s"] - n["s"])
            cut = point(p["x"] + t * (n["x"] - p["x"]), p["y"] + t * (n["y"] - p["y"]))
            end = point(n["x"], n["y"])
            return (
                F.when((p["s"] >= 0) & (n["s"] >= 0), F.array(end))
                .when(p["s"] >= 0, F.array(cut))
                .when(n["s"] >= 0, F.array(cut, end))
                .otherwise(F.slice(F.array(end), 1, 0))
            )

        return let(marked, lambda m: F.flatten(F.zip_with(m, turned(m), step)))

    return F.aggregate(cell, ring.cast(RING), by_edge)


def clip_area(poly: Column, cell: Column) -> Column:
    """Area of a polygon inside a convex cell."""
    one = lambda r, c: F.abs(signed_area(clip(r["ring"], c))) * F.when(r["hole"], -1).otherwise(1)
    return let(cell, lambda c: F.aggregate(poly, F.lit(0.0), lambda s, r: s + one(r, c)))


def clip_area_in_box(poly: Column, cell: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """``clip_area`` of a polygon with a known box: sides of the cell that the box does not cross are left out, so a
    polygon whose box lies inside is not clipped at all, and one whose box lies outside of a side has no area."""
    x, y, w, h = (xmin + xmax) / 2, (ymin + ymax) / 2, (xmax - xmin) / 2, (ymax - ymin) / 2

    def placed(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        middle = dx * (y - e["ay"]) - dy * (x - e["ax"])
        return F.struct(*[e[k].alias(k) for k in ("ax", "ay", "bx", "by")], middle.alias("middle"), (F.abs(dx) * h + F.abs(dy) * w).alias("reach"))

    def clipped(sides: Column) -> Column:
        outside = F.exists(sides, lambda e: e["middle"] <= -e["reach"])
        return F.when(outside, F.lit(0.0)).otherwise(clip_area(poly, F.filter(sides, lambda e: e["middle"] < e["reach"])))

    return let(F.transform(cell, placed), clipped)


def hexagon(cx: Column, cy: Column, width: float) -> Column:
    """Vertices of a pointy-top hexagon, counter-clockwise."""
    reach = width / math.sqrt(3)
    return F.array(*[point(cx + reach * math.cos(math.radians(30 + 60 * k)), cy + reach * math.sin(math.radians(30 + 60 * k))) for k in range(6)])


def contains(poly: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon, by the parity of crossings; holes count as crossings too."""

    def crossings(ring: Column) -> Column:
        return F.size(F.filter(edges(ring), lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + (y - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"]))))

    return F.aggregate(poly, F.lit(0), lambda s, r: s + crossings(r["ring"])) % 2 == 1


# The ellipsoid GRS 80 and the conformal conic projection EPSG:32198 (degrees).
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLELS, ORIGIN = (60.0, 46.0), (44.0, -68.5)


def conformal_conic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of the origin, of degrees (Lambert conformal conic with two standard parallels)."""
    ecc = math.sqrt(2 * FLATTENING - FLATTENING**2)
    m = lambda a: math.cos(a) / math.sqrt(1 - (ecc * math.sin(a)) ** 2)
    t = lambda a: math.tan(math.pi / 4 - a / 2) / ((1 - ecc * math.sin(a)) / (1 + ecc * math.sin(a))) ** (ecc / 2)
    a1, a2, a0 = (math.radians(v) for v in (*PARALLELS, ORIGIN[0]))
    n = (math.log(m(a1)) - math.log(m(a2))) / (math.log(t(a1)) - math.log(t(a2)))
    f = m(a1) / (n * t(a1) ** n)
    rho0 = AXIS * f * t(a0) ** n
    a = F.radians(lat)
    s = ecc * F.sin(a)
    rho = AXIS * f * F.pow(F.tan(math.pi / 4 - a / 2) / F.pow((1 - s) / (1 + s), F.lit(ecc / 2)), F.lit(n))
    theta = n * (F.radians(lon) - math.radians(ORIGIN[1]))
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def project(poly: Column) -> Column:
    """A polygon in degrees as one in metres."""

    def moved(p: Column) -> Column:
        x, y = conformal_conic(p["x"], p["y"])
        return point(x, y)

    return F.transform(poly, lambda r: F.struct(F.transform(r["ring"], moved).alias("ring"), r["hole"].alias("hole")))
