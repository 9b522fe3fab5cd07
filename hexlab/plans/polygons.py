"""Queries over polygons, zones, raster cells and sources."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as L
from ..operators import extent, grid, hexagg, overlay, panel, union
from ..sources import io
from ..sources.scratch import cut, folder
from . import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}
WIDTH = 5000.0
X1, Y1 = 100003.0, 60013.0
LEVELS = ("Léger", "Modéré", "Grave")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = X.sql(sql)
        return f

    return put


def patches(spark, d):
    p = X.patch(spark, d).withColumn("level", L.normalize_intensity(F.col("level_raw")))
    return p.withColumn("poly", G.polygon(G.rectangle(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))))


def ring(*corners):
    return G.polygon(F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in corners]))


def zone(spark, d, shape="rectangle"):
    """A fixed study zone in the plane of the sites: the rectangle, the L-shape in it, or the river across it."""
    corners = {"rectangle": ((0, 0), (X1, 0), (X1, Y1), (0, Y1)), "ell": ((0, 0), (X1, 0), (X1, 30000), (40000, 30000), (40000, Y1), (0, Y1)), "river": ((20000, -1000), (35000, -1000), (35000, 70000), (20000, 70000))}
    return spark.range(1).select(ring(*corners[shape]).alias("poly"))


def hull(spark, d):
    """The box of all sites as a zone."""
    box = X.site(spark, d).agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("e"))  # one row
    return box.select(G.polygon(G.rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("e"))).alias("poly"))


def over(x0, y0, x1, y1):
    return f"greatest(0, least(xmax, {x1}) - greatest(xmin, {x0})) * greatest(0, least(ymax, {y1}) - greatest(ymin, {y0}))"


RECT, ELL = over(0, 0, X1, Y1), f"({over(0, 0, X1, 30000)} + {over(0, 30000, 40000, Y1)})"


@query("select patch_id, (xmax-xmin)*(ymax-ymin) as area, round((xmin+xmax)/2, 4) as cx, round((ymin+ymax)/2, 4) as cy, xmin, ymax from fx2_patch")
def p13_area_centroid(spark, d):
    p = patches(spark, d).withColumn("c", G.centroid(F.element_at("poly", 1)["ring"]))
    box = G.bbox(F.col("poly"))
    return p.select("patch_id", F.round(G.area(F.col("poly")), 4).alias("area"), F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"), box["xmin"].alias("xmin"), box["ymax"].alias("ymax"))


def _conic_sql() -> str:
    e = "sqrt(2/298.257222101 - pow(1/298.257222101, 2))"
    m = lambda a: f"(cos({a}) / sqrt(1 - pow({e} * sin({a}), 2)))"
    t = lambda a: f"(tan(pi()/4 - {a}/2) / pow((1 - {e}*sin({a})) / (1 + {e}*sin({a})), {e}/2))"
    a1, a2, a0 = "radians(60)", "radians(46)", "radians(44)"
    n = f"((ln({m(a1)}) - ln({m(a2)})) / (ln({t(a1)}) - ln({t(a2)})))"
    return f""", g as (select site_id, -79 + x / 10000 as lon, 45 + y / 10000 as lat from fx1_site),
 k as (select *, {n} as n, {m(a1)} / ({n} * pow({t(a1)}, {n})) as f, {t(a0)} as t0, {t('radians(lat)')} as t from g)
 select site_id, round(6378137.0 * f * pow(t, n) * sin(n * radians(lon + 68.5)), 3) as east, round(6378137.0 * f * (pow(t0, n) - pow(t, n) * cos(n * radians(lon + 68.5))), 3) as north from k"""


@query(_conic_sql())
def p12_projection(spark, d):
    east, north = G.conformal_conic(-79 + F.col("x") / 10000, 45 + F.col("y") / 10000)
    return X.site(spark, d).select("site_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


def _grid_sql(w: float) -> str:
    """Hexes and a rectangle overlap if their shadows do on the axes of their sides."""
    s = math.sqrt(3)
    sat = " and ".join(f"abs((cx - (a + c) / 2) * ({u}) + (cy - (b + e) / 2) * ({v})) < {h} + (c - a) / 2 * {abs(u)} + (e - b) / 2 * {abs(v)} - 1e-6" for u, v, h in ((1, 0, w / 2), (0, 1, w / s), (0.5, s / 2, w / 2), (-0.5, s / 2, w / 2)))
    return f"""select cast(q as int) as q, cast(r as int) as r, round(cast({w * w * s / 2} as double), 3) as hex_area from (select q, r, {w} * (q + r/2.0) as cx, {w * s / 2} * r as cy from
 (select unnest(generate_series(-30, 60)) as q), (select unnest(generate_series(-30, 60)) as r)), (select min(x) as a, min(y) as b, max(x) as c, max(y) as e from fx1_site) where {sat}"""


@query(_grid_sql(WIDTH))
def j1_hex_grid(spark, d):
    return overlay.hex_grid(hull(spark, d), WIDTH).select("q", "r", F.round("hex_area", 3).alias("hex_area"))


def pieces_sql(source: str, keys: str, w: float = WIDTH) -> str:
    """Areas of boxes in hexes: what both share at a height is linear between the heights at which a side of one
    meets a side or corner of the other, so the trapezoids between these are exact."""
    s = math.sqrt(3)
    h, reach = w * s / 2, w / s
    half = lambda y: f"least({w / 2}, greatest(0, ({reach} - abs({y} - cy)) * {s}))"
    shared = lambda y: f"greatest(0, least(xmax, cx + {half(y)}) - greatest(xmin, cx - {half(y)}))"
    heights = ", ".join(["ymin", "ymax", "cy", *(f"cy {way} {at}" for way in "+-" for at in (reach, reach / 2, f"({reach} - abs(xmin - cx) / {s})", f"({reach} - abs(xmax - cx) / {s})"))])
    return f"""hx as (select *, {w} * (q + r / 2.0) as cx, {h} * r as cy from (select *, unnest(generate_series(cast(ceil((xmin - {w / 2}) / {w} - r / 2.0) as int), cast(floor((xmax + {w / 2}) / {w} - r / 2.0) as int))) as q
  from (select *, unnest(generate_series(cast(ceil((ymin - {reach}) / {h}) as int), cast(floor((ymax + {reach}) / {h}) as int))) as r from {source}))),
 hy as (select *, list_sort(list_transform([{heights}], lambda y: greatest(ymin, least(ymax, cast(y as double))))) as ys from hx),
 pieces as (select {keys}, cast(q as int) as q, cast(r as int) as r, list_sum(list_transform(generate_series(1, 10), lambda i: (ys[i + 1] - ys[i]) * ({shared("ys[i + 1]")} + {shared("ys[i]")}) / 2)) as area from hy)"""


@query(", " + pieces_sql("fx2_patch", "patch_id") + " select patch_id, q, r, round(area, 1) as area from pieces where round(area, 1) > 0")
def j3_hex_overlay(spark, d):
    pieces = overlay.hex_pieces(patches(spark, d), WIDTH)
    return pieces.select("patch_id", "q", "r", F.round("piece_area", 1).alias("area")).where("area > 0")


SQUARES = ", squares as (select distinct cell_id, x - 1000 as xmin, y - 1000 as ymin, x + 1000 as xmax, y + 1000 as ymax from fx3_cell_daily), "


@query(SQUARES + pieces_sql("squares", "cell_id") + " select cell_id, q, r, round(area / 4000000, 6) as fraction from pieces where round(area / 4000000, 6) > 0")
def j4_raster_overlay(spark, d):
    cells = X.cell_daily(spark, d).select("cell_id", "x", "y").distinct()
    return overlay.raster_pieces(cells, 2000.0, WIDTH).select("cell_id", "q", "r", F.round("fraction", 6).alias("fraction")).where("fraction > 0")


@query(""", c as (select floor(x/5000) as i, floor(y/5000) as j, avg(value) as v from fx1_site group by 1, 2), w as (select site_id, x/5000 as u, y/5000 as v from fx1_site)
 select w.site_id, (select round(c.v, 4) from c where c.i = floor(w.u + 0.5) and c.j = floor(w.v + 0.5)) as nearest,
 (select case when count(c.v) = count(*) then round(sum(c.v * k.wt), 4) end from (select floor(w.u) + a as i, floor(w.v) + b as j, (case when a = 1 then w.u - floor(w.u) else 1 - w.u + floor(w.u) end) * (case when b = 1 then w.v - floor(w.v) else 1 - w.v + floor(w.v) end) as wt
  from (select unnest([0, 1]) as a), (select unnest([0, 1]) as b)) k left join c on c.i = k.i and c.j = k.j where k.wt > 0) as bilinear from w""")
def j4_resample(spark, d):
    s = X.site(spark, d)
    cells = s.groupBy(F.floor(F.col("x") / 5000).alias("i"), F.floor(F.col("y") / 5000).alias("j")).agg(F.avg("value").alias("v"))
    a = overlay.resample(cells, s.select("site_id", "x", "y"), 5000.0, "v", "site_id")
    b = overlay.resample(cells, s.select("site_id", "x", "y"), 5000.0, "v", "site_id", bilinear=True)
    return a.withColumnRenamed("v", "nearest").join(b.withColumnRenamed("v", "bilinear"), "site_id").select("site_id", F.round("nearest", 4).alias("nearest"), F.round("bilinear", 4).alias("bilinear"))


@query(f"select patch_id from fx2_patch where {ELL} > 0")
def j5_s15_intersects(spark, d):
    return overlay.intersecting(patches(spark, d), zone(spark, d, "ell"), 10000.0, ["patch_id"]).select("patch_id")


@query(f"select patch_id, round({RECT}, 2) as area, round({ELL}, 2) as area_ell from fx2_patch where {RECT} > 0")
def j6_clip_to_zone(spark, d):
    p = patches(spark, d)
    a = overlay.clip_to_zone(p, zone(spark, d), 10000.0, ["patch_id"])
    b = overlay.clip_to_zone(p, zone(spark, d, "ell"), 10000.0, ["patch_id"], "area_ell")
    return a.join(b, "patch_id", "left").select("patch_id", F.round("area", 2).alias("area"), F.round(F.coalesce("area_ell", F.lit(0.0)), 2).alias("area_ell"))


@query(f"select patch_id, round({RECT} - {over(20000, 0, 35000, Y1)}, 2) as area from fx2_patch where {RECT} > 0")
def j7_difference(spark, d):
    out = overlay.difference_area(patches(spark, d), zone(spark, d), zone(spark, d, "river"), 10000.0, ["patch_id"])
    return out.select("patch_id", F.round(F.greatest("area", F.lit(0.0)), 2).alias("area"))


CELLS = """, k as (select p.year, i, j from fx2_patch p, lateral (select unnest(generate_series(cast(ceil(p.xmin/500 - 0.5) as bigint), cast(floor(p.xmax/500 - 0.5) as bigint))) as i) a,
 lateral (select unnest(generate_series(cast(ceil(p.ymin/500 - 0.5) as bigint), cast(floor(p.ymax/500 - 0.5) as bigint))) as j) b
 where (i + 0.5) * 500 >= p.xmin and (i + 0.5) * 500 < p.xmax and (j + 0.5) * 500 >= p.ymin and (j + 0.5) * 500 < p.ymax)"""


@query(CELLS + " select year, round(count(distinct (i, j)) * cast(250000 as double), 2) as area from k group by year")
def j8_union_area(spark, d):
    return overlay.union_area(patches(spark, d), 500.0, ["year"]).select("year", F.round("area", 2).alias("area"))


def rectangles_sql(scale: str = "1.0", of: str = "fx2_patch") -> str:
    """Area that rectangles of a year cover: strips between neighbouring left and right sides, heights by running maxima."""
    return f""", p as ({of}), x as (select distinct year, part, unnest([xmin, xmax]) as a from p), strip as (select year, part, a, lead(a) over (partition by year, part order by a) as b from x),
 met as (select s.year, a, b, ymin, ymax, max(ymax) over (partition by s.year, s.part, a order by ymin, ymax rows between unbounded preceding and 1 preceding) as top from strip s join p on p.year = s.year and p.part = s.part and xmin <= a and xmax >= b)
 select year, round(sum((b - a) * greatest(0, ymax - greatest(ymin, coalesce(top, ymin)))) * {scale} / 1e6, 3) as km2 from met group by year"""


PATCHES = "select year, 0 as part, xmin, ymin, xmax, ymax from fx2_patch"


def inside_sql(*boxes: tuple[float, float, float, float]) -> str:
    """The parts of the patches in boxes."""
    parts = [f"select year, {k} as part, greatest(xmin, {a}) as xmin, greatest(ymin, {b}) as ymin, least(xmax, {c}) as xmax, least(ymax, {e}) as ymax from fx2_patch" for k, (a, b, c, e) in enumerate(boxes)]
    return f"select * from ({' union all '.join(parts)}) where xmin < xmax and ymin < ymax"


@query(rectangles_sql(of=PATCHES))
def j8_exact_union(spark, d):
    return union.exact_union_area(patches(spark, d), 4000.0, ["year"]).select("year", F.round(F.col("area") / 1e6, 3).alias("km2"))


@query(rectangles_sql("(1 + 0.3 * 0.2)", PATCHES))
def j8_exact_union_slanted(spark, d):
    """The patches under a linear map, which multiplies areas by its determinant."""
    moved = lambda p: G.point(p["x"] + 0.3 * p["y"], p["y"] - 0.2 * p["x"])
    slanted = patches(spark, d).withColumn("poly", F.transform("poly", lambda r: F.struct(F.transform(r["ring"], moved).alias("ring"), r["hole"].alias("hole"))))
    return union.exact_union_area(slanted, 4000.0, ["year"]).select("year", F.round(F.col("area") / 1e6, 3).alias("km2"))


@query(rectangles_sql(of=inside_sql((0, 0, X1, 30000), (0, 30000, 40000, Y1))))
def a14_exact_touched(spark, d):
    """Area touched each year inside the L-shaped zone."""
    return union.exact_union_area(patches(spark, d), 4000.0, ["year"], "a", zone(spark, d, "ell")).select("year", F.round(F.col("a") / 1e6, 3).alias("km2"))


@query(CELLS + f""", v as (select year, trim(level_raw) as level, {RECT} as a from fx2_patch where {RECT} > 0)
 select v.year, round(sum(case when level = 'Leger' then a else 0 end) / 10000, 2) as leger, round(sum(case when level = 'Modéré' then a else 0 end) / 10000, 2) as modere, round(sum(case when level = 'Grave' then a else 0 end) / 10000, 2) as grave,
 any_value(t.n) * cast(25 as double) as touched_ha, round(any_value(t.n) * 250000.0 / {X1 * Y1} * 100, 2) as touched_pct, count(*) as polygons
 from v join (select year, count(distinct (i, j)) as n from k where (i + 0.5) * 500 between 0 and {X1} and (j + 0.5) * 500 between 0 and {Y1} group by year) t on t.year = v.year group by v.year""")
def a13_a16_yearly_report(spark, d):
    r = extent.yearly_report(patches(spark, d), zone(spark, d), LEVELS, X1 * Y1, 10000.0, 500.0)
    return r.select("year", F.round("Léger", 2).alias("leger"), F.round("Modéré", 2).alias("modere"), F.round("Grave", 2).alias("grave"), "touched_ha", "touched_pct", "polygons")


HEX_ID = "cast(q as bigint) * 4294967296 + cast(r as bigint) + 2147483648"


def hexes_sql(a: float, b: float, c: float, e: float, w: float = WIDTH) -> str:
    """Hexes that overlap the box (a, b, c, e), by their shadows on the axes of their sides."""
    s = math.sqrt(3)
    sat = " and ".join(f"abs((cx - {(a + c) / 2}) * ({u}) + (cy - {(b + e) / 2}) * ({v})) < {h + (c - a) / 2 * abs(u) + (e - b) / 2 * abs(v) - 1e-6}" for u, v, h in ((1, 0, w / 2), (0, 1, w / s), (0.5, s / 2, w / 2), (-0.5, s / 2, w / 2)))
    return f"hexes as (select {HEX_ID} as hex_id, q, r from (select q, r, {w} * (q + r/2.0) as cx, {w * s / 2} * r as cy from (select unnest(generate_series(-30, 60)) as q), (select unnest(generate_series(-30, 60)) as r)) where {sat})"


@query(", " + pieces_sql("fx2_patch", "year, ia") + ", " + hexes_sql(0, 0, X1, Y1) + f""", sums as (select {HEX_ID} as hex_id, year, ia, sum(area) as a from pieces where area > 1e-5 group by all),
 best as (select hex_id, year, arg_max(ia, struct_pack(a := a, ia := -ia)) as ia, sum(a) / {grid.hex_area(WIDTH)} as cov from sums group by hex_id, year)
 select h.hex_id, y.year, case when coalesce(cov, 0) >= 0.25 then case ia when 1 then 'Léger' when 2 then 'Modéré' else 'Grave' end end as level, round(coalesce(cov, 0), 6) as coverage, case when coalesce(cov, 0) >= 0.25 then ia else 0 end as severity
 from hexes h cross join (select distinct year from fx2_patch) y left join best b on b.hex_id = h.hex_id and b.year = y.year""")
def a4_a6_severity_per_hex(spark, d):
    """Severity of every hex of the zone in every year, by area; hexes that are hardly covered have none."""
    g = overlay.hex_grid(zone(spark, d), WIDTH)
    p = patches(spark, d)
    years = p.select("year").distinct()
    pieces = overlay.hex_pieces(p, WIDTH).withColumn("hex_id", grid.hex_id(F.col("q"), F.col("r")))
    cells = g.select("hex_id").crossJoin(F.broadcast(years))  # a row a year
    out = hexagg.aggregate_to_hex(cells, pieces, "level", "ordinal", "level", grid.hex_area(WIDTH), ["hex_id", "year"], rank=L.severity_rank(F.col("level")), add_coverage=True)
    return out.select("hex_id", "year", "level", F.round("level_cov", 6).alias("coverage"), L.severity_rank(F.col("level")).alias("severity"))


@query()
def a5_a11_raster_covariates(spark, d):
    """Winter minimum per hex and season: raster cells by season, cut by hexes, weighted median."""
    daily = X.cell_daily(spark, d)
    cells = daily.select("cell_id", "x", "y").distinct()
    pieces = cut(overlay.raster_pieces(cells, 2000.0, WIDTH).select("cell_id", "q", "r", "piece_area", "fraction"))
    rows = pieces.join(panel.winter_minimum(daily), "cell_id").withColumn("hex_id", grid.hex_id(F.col("q"), F.col("r")))
    return hexagg.weighted_median(rows, ["hex_id", "season"], "minimum", "fraction", "tmin", "cell_id").select("hex_id", "season", F.round("tmin", 4).alias("tmin"))


def median_sql(name: str, source: str, keys: str, value: str, weight: str) -> str:
    """Interpolated weighted medians of (keys, value, weight) rows of a source."""
    return f"""{name}_c as (select {keys}, {value} as x, sum({weight}) over (partition by {keys} order by {value}, {weight} rows unbounded preceding) - {weight}/2 as c, sum({weight}) over (partition by {keys})/2 as half, {weight} as w from {source} where {value} is not null),
 {name}_l as (select *, lag(x) over (partition by {keys} order by x, c) as px, lag(c) over (partition by {keys} order by x, c) as pc from {name}_c),
 {name} as (select {keys}, case when any_value(half) <= min(c) then min(x) else coalesce(max(case when pc < half and c >= half then px + (x-px)*(half-pc)/(c-pc) end), max(x)) end as v, sum(w) as area from {name}_l group by {keys})"""


@query(", one as (select * from fx2_patch where year = 1996), " + pieces_sql("one", "patch_id, ia") + SQUARES + pieces_sql("squares", "cell_id").replace("hx", "kx").replace("hy", "ky").replace("pieces", "tiles") + ", " + hexes_sql(0, 0, X1, Y1)
 + f""", sums as (select {HEX_ID} as hex_id, ia, sum(area) as a from pieces where area > 1e-5 group by all),
 lev as (select hex_id, arg_max(ia, struct_pack(a := a, ia := -ia)) as ia, sum(a) as a from sums group by hex_id),
 wide as (select {HEX_ID} as hex_id, cast(patch_id % 97 as double) as x, area from pieces where area > 1e-5), """ + median_sql("wid", "wide", "hex_id", "x", "area") + f""",
 cold as (select cell_id, year(date) + case when month(date) = 12 then 1 else 0 end as season, round(min(value), 1) as x from fx3_cell_daily where month(date) in (12, 1, 2) group by 1, 2),
 tmin as (select {HEX_ID} as hex_id, x, area from tiles join cold using (cell_id) where season = 1997 and area > 1e-5), """ + median_sql("tm", "tmin", "hex_id", "x", "area") + f"""
 select h.hex_id, case when lev.a / {grid.hex_area(WIDTH)} >= 0.25 then lev.ia end as severity, case when wid.area / {grid.hex_area(WIDTH)} >= 0.25 then round(wid.v, 4) end as width, case when tm.area / {grid.hex_area(WIDTH)} >= 0.25 then round(tm.v, 4) end as tmin
 from hexes h left join lev on lev.hex_id = h.hex_id left join wid on wid.hex_id = h.hex_id left join tm on tm.hex_id = h.hex_id""")
def a5_covariates(spark, d):
    """Three covariates of two types brought onto the grid from a list: two of polygons, one of a raster band."""
    p = patches(spark, d).where("year = 1996").withColumns({"rank": L.severity_rank(F.col("level")), "key97": (F.col("patch_id") % 97).cast("double")})
    daily = X.cell_daily(spark, d)
    cold = panel.winter_minimum(daily).withColumns({"band": F.col("season"), "value": F.round("minimum", 1)}).select("cell_id", "band", "value")
    raster = daily.select("cell_id", "x", "y").distinct().join(cold, "cell_id")
    items = {
        "severity": hexagg.Covariate(p, "rank", "ordinal"),
        "width": hexagg.Covariate(p, "key97", "continuous"),
        "tmin": hexagg.Covariate(raster, "value", "continuous", side=2000.0, band=1997),
    }
    out, kinds = hexagg.aggregate_covariates(overlay.hex_grid(zone(spark, d), WIDTH), items, WIDTH)
    assert kinds == {"severity": "ordinal", "width": "continuous", "tmin": "continuous"}
    return out.select("hex_id", "severity", F.round("width", 4).alias("width"), F.round("tmin", 4).alias("tmin"))


AGE = "case cl_age when '10' then 10.0 when '3050' then 30.0 when '120' then 120.0 when 'JIN' then 30.0 when 'VIR' then 90.0 when '7090' then 70.0 end"


@query(f""", a as (select hex_id, geocode, piece_area as w, {AGE} as x from fx5_stand where {AGE} is not null),
 c as (select *, sum(w) over (partition by hex_id order by x, geocode rows unbounded preceding) - w/2 as c, sum(w) over (partition by hex_id)/2 as half from a),
 l as (select *, lag(x) over (partition by hex_id order by x, geocode) as px, lag(c) over (partition by hex_id order by x, geocode) as pc from c),
 m as (select hex_id, any_value(half) as half, min(c) as c0, max(c) as c1, min(x) as x0, max(x) as x1, max(case when pc < half and c >= half then px + (x-px)*(half-pc)/(c-pc) end) as b, sum(w) as area from l group by hex_id)
 select h.hex_id, case when area / 40000.0 >= 0.25 then round(case when half <= c0 then x0 when half >= c1 then x1 else b end, 6) end as age from (select distinct hex_id from fx5_stand) h left join m on m.hex_id = h.hex_id""")
def a10_age(spark, d):
    s = X.stand(spark, d).withColumn("age", L.parse_age_class(F.col("cl_age")))
    cells = s.select("hex_id").distinct()
    out = hexagg.aggregate_to_hex(cells, s.where("age is not null"), "age", "continuous", "age", 40000.0, tie="geocode")
    return out.select("hex_id", F.round("age", 6).alias("age"))


# ---- sources


@query("select site_id, region from fx1_site where region in ('NATION_0', 'NATION_1')")
def s1_s2_region_scan(spark, d):
    return io.region_scan(X.site(spark, d), "region", ["NATION_0", "NATION_1"], required=True).select("site_id", "region")


@query("select patch_id, year, level_raw from fx2_patch where xmin <= 60000 and xmax >= 20000 and ymin <= 40000 and ymax >= 10000")
def s3_box_scan(spark, d):
    return io.box_scan(X.patch(spark, d), 20000, 10000, 60000, 40000, ["patch_id", "year", "level_raw", "no_such_column"])


@query("select distinct region, category from fx1_site")
def s4_u1_u2_stacked(spark, d):
    s = X.site(spark, d).select("region", "category")
    return io.stacked([s, s.where("category = 'BUILDING'"), s])


@query("select site_id, x, y from fx1_site where category = 'MACHINERY'")
def s5_named_feature(spark, d):
    s = X.site(spark, d).select("site_id", "x", "y", "category")
    return io.named_feature([s.where("site_id % 2 = 0"), s, s.where("site_id % 3 = 0")], "category", "MACHINERY").select("site_id", "x", "y")


@query("select category as parameter, cast(site_id % 7 + 1995 as int) as year, 'f' || site_id as name from fx1_site where category = 'FURNITURE' and site_id % 7 + 1995 in (1996, 1998)")
def s6_s14_csv_index(spark, d):
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    s = X.site(spark, d).select(F.col("category").alias("parameter"), (F.col("site_id") % 7 + 1995).cast("int").alias("year"), F.concat(F.lit("f"), F.col("site_id").cast("string")).alias("name"))
    io.write_report(s, path)
    return io.csv_index(spark, path, "parameter string, year int, name string", ("parameter", "FURNITURE"), ("year", [1996, 1998]))


@query("""select y.year, count(v.cell_id) as days from (select unnest([1994, 1995, 1996, 2030]) as year) y left join (select cell_id, year(date) as year from fx3_cell_daily where month(date) in (1, 2)) v on v.year = y.year group by y.year""")
def s7_months(spark, d):
    return io.months_of(X.cell_daily(spark, d), [1, 2], [1994, 1995, 1996, 2030]).groupBy("year").agg(F.count("cell_id").alias("days"))


@query("select cell_id, cast(date as varchar) as date from fx3_cell_daily where cell_id % 3 = 1")
def s8_band(spark, d):
    return io.band(X.cell_daily(spark, d).withColumn("band", F.col("cell_id") % 3), 1).select("cell_id", F.col("date").cast("string").alias("date"))


@query(f"select patch_id from fx2_patch where {ELL} > 0 and patch_id % 3 <> 0")
def s9_manifest(spark, d):
    p = patches(spark, d)
    return io.manifest(p, zone(spark, d, "ell"), p.where("patch_id % 3 = 0"), 10000.0, "patch_id").select("patch_id")


@query("""select tile, name from (select tile, name, row_number() over (partition by tile order by case when lower(name) like '%\\_c.gpkg' escape '\\' then 0 else 1 end, pos) as n from
 (select cast(site_id % 50 as int) as tile, site_id as pos, case when site_id % 7 = 0 then 'f' || site_id || '_C.gpkg' else 'f' || site_id || '.gpkg' end as name from fx1_site)) where n = 1""")
def s10_preferred(spark, d):
    s = X.site(spark, d).select((F.col("site_id") % 50).cast("int").alias("tile"), F.col("site_id").alias("position"), F.concat(F.lit("f"), F.col("site_id").cast("string"), F.when(F.col("site_id") % 7 == 0, "_C.gpkg").otherwise(".gpkg")).alias("name"))
    return io.preferred(s).select("tile", "name")


@query("select distinct cast(y as int) as year from (select year as y from fx2_patch union all select year - 1 from fx2_patch) order by 1")
def s11_years_needed(spark, d):
    return io.years_needed(X.patch(spark, d).select("year"))


@query("select cell, year, severity from fx4_panel")
def s12_s13_panel_cache(spark, d):
    path = f"{folder(spark)}/panel-{uuid.uuid4().hex}"
    io.write_panel(X.panel(spark, d).select("cell", "year", "severity"), path, ["A"], 10000.0, {"history": ["g1", "g2"], "noise": ["g2"]})
    return io.read_panel(spark, path, ["A"], 10000.0).select("cell", "year", "severity")


@query("select patch_id from fx2_patch, (select min(x) as a, min(y) as b, max(x) as c, max(y) as e from fx1_site) z where xmax > a and xmin < c and ymax > b and ymin < e")
def s16_zone_from_data(spark, d):
    return overlay.intersecting(patches(spark, d), hull(spark, d), 10000.0, ["patch_id"]).select("patch_id")
