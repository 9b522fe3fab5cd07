"""Hand-made cases and invariants."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlab.functions import geometry as G
from hexlab.functions import labels as L
from hexlab.operators import assoc, cluster, evaluate, farfield, grid, hexagg, logdet, models, overlay, panel, spatial, union
from hexlab.sources import io


def one(df):
    return tuple(df.first())


def test_labels(spark):
    rows = spark.createDataFrame([("Leger",), (" MODÉRÉ ",), ("Grave",), ("2",), ("other",), (None,)], "v string")
    got = rows.select(L.label_to_int(F.col("v")), L.normalize_intensity(F.col("v")), L.severity_rank(L.normalize_intensity(F.col("v")))).collect()
    assert [tuple(r) for r in got] == [(1, "Léger", 1), (None, "Modéré", 2), (3, "Grave", 3), (2, "2", 0), (None, "other", 0), (0, None, 0)]
    ages = spark.createDataFrame([("10",), ("120120",), ("JIN",), ("VIR",), ("",), (None,), ("XX",), ("5070",)], "v string").select(L.parse_age_class(F.col("v"))).collect()
    assert [r[0] for r in ages] == [10, 120, 30, 90, None, None, None, 50]
    bins = spark.createDataFrame([(0.1,), (0.3,), (0.5,), (0.51,), (None,)], "v double").select(L.strength_label(F.col("v"))).collect()
    assert [r[0] for r in bins] == ["négligeable", "faible", "modérée", "forte", None]


@pytest.mark.parametrize(("rows", "want"), [([(5.0, 1.0)], 5.0), ([(1.0, 1.0), (3.0, 1.0)], 2.0), ([(1.0, 9.0), (3.0, 1.0)], 1.0), ([(2.0, 1.0), (2.0, 5.0)], 2.0), ([(1.0, 1.0), (2.0, 1.0), (4.0, 2.0)], 1 + 2 * (2 - 1.5) / 1.5 + 1), ([(1.0, 0.0), (None, 3.0), (7.0, 2.0)], 7.0)])
def test_weighted_median(spark, rows, want):
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, x double, w double")
    got = hexagg.weighted_median(df, ["k"], "x", "w", "m").first()["m"]
    values = sorted((x, w) for x, w in rows if x is not None and w > 0)
    cum = np.cumsum([w for _, w in values]) - np.array([w for _, w in values]) / 2
    expected = float(np.interp(sum(w for _, w in values) / 2, cum, [x for x, _ in values])) if len(values) > 1 else values[0][0]
    assert got == pytest.approx(expected)


def test_weighted_mode_ties(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (1, "a", 1.0), (2, None, 9.0), (2, "c", 1.0), (3, "c", 0.0)], "k int, c string, w double")
    got = {r["k"]: r["m"] for r in hexagg.weighted_mode(df, ["k"], "c", F.col("w"), "m").collect()}
    assert got == {1: "a", 2: "c"}
    first_b = hexagg.weighted_mode(df, ["k"], "c", F.col("w"), "m", F.when(F.col("c") == "b", 0).otherwise(1))
    assert {r["k"]: r["m"] for r in first_b.collect()}[1] == "b"


def test_weighted_mode_of_sums_that_change(spark):
    """Sums worked out twice may differ in their last digits (the order of a shuffle is not fixed): no group may be lost."""
    noise = F.udf(lambda: 1 + random.random() * 1e-9, "double").asNondeterministic()
    df = spark.range(40).select((F.col("id") % 4).alias("k"), F.when(F.col("id") < 24, "a").otherwise("b").alias("c")).withColumn("w", noise())
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r["k"]: r["m"] for r in hexagg.weighted_mode(df, ["k"], "c", F.col("w"), "m").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {k: "a" for k in range(4)}


@pytest.mark.parametrize("width", [5000.0, 10000.0, 3.0])
def test_points_on_borders_of_hexes(spark, width):
    """Points as far from one centre as from another go to the smaller r, then to the smaller q."""
    points = [(i, width / 2 * a, float(b)) for i, (a, b) in enumerate((a, b) for a in range(-7, 8) for b in range(-9000, 9001, 611))]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {r["id"]: (r["r"], r["q"]) for r in grid.assign_hex(df, width).collect()}
    for i, x, y in points:
        r0 = round(y / (width * grid.ROOT3 / 2))
        near = [(r, q) for r in range(r0 - 2, r0 + 3) for q in range(round(x / width - r / 2) - 2, round(x / width - r / 2) + 3)]
        assert got[i] == min(near, key=lambda c: ((x - width * (c[1] + c[0] / 2.0)) ** 2 + (y - width * math.sqrt(3.0) / 2 * c[0]) ** 2, *c))


def test_clip_of_a_concave_ring(spark):
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    square = G.edges(G.rectangle(F.lit(1), F.lit(0), F.lit(3), F.lit(2)))
    hole = G.rectangle(F.lit(1.5), F.lit(0), F.lit(2.5), F.lit(0.5))
    row = spark.range(1).select(G.clip_area(G.polygon(ring), square), G.clip_area(G.polygon(ring, hole), square), G.area(G.polygon(ring, hole)), G.clip_area(G.polygon(ring), G.edges(G.rectangle(F.lit(9), F.lit(9), F.lit(10), F.lit(10)))))
    # between x = 1 and 3 the ring lies under its notch from (0, 4) over (2, 1) to (4, 4), cut at height 2
    xs = np.linspace(1, 3, 200001)
    under = np.minimum(2, 1 + 1.5 * np.abs(xs - 2))
    want = float(((under[1:] + under[:-1]) / 2 * np.diff(xs)).sum())
    assert one(row) == pytest.approx((want, want - 0.5, 10 - 0.5, 0.0), abs=1e-6)


def test_grid_and_overlay(spark):
    zone = spark.range(1).select(G.polygon(G.rectangle(F.lit(0), F.lit(0), F.lit(10), F.lit(8)), G.rectangle(F.lit(2), F.lit(2), F.lit(4), F.lit(4))).alias("poly"))
    pieces = overlay.hex_pieces(overlay.with_box(zone), 1.5)
    assert pieces.agg(F.sum("piece_area")).first()[0] == pytest.approx(76)
    g = overlay.hex_grid(zone, 0.5)
    assert g.count() == g.select("hex_id").distinct().count()
    box = overlay.with_box(spark.range(1).select(F.col("id"), G.polygon(G.rectangle(F.lit(1), F.lit(1), F.lit(5), F.lit(5))).alias("poly")))
    assert overlay.clip_to_zone(box, zone, 2.0, ["id"]).first()["area"] == pytest.approx(12)
    assert overlay.union_area(overlay.with_box(zone).withColumn("k", F.lit(1)), 0.5, ["k"]).first()["area"] == pytest.approx(76)


def inside(ring, x0, y0, x1, y1):
    """Area of a ring in a box, by cutting it at the four sides."""
    for k, at, way in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, n in zip(ring, ring[1:] + ring[:1], strict=True):
            if way * (p[k] - at) >= 0:
                out.append(p)
            if (p[k] - at) * (n[k] - at) < 0:
                s = (at - p[k]) / (n[k] - p[k])
                out.append((p[0] + s * (n[0] - p[0]), p[1] + s * (n[1] - p[1])))
        ring = out
    return sum(p[0] * n[1] - n[0] * p[1] for p, n in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def star(n, seed, reach, rough):
    rng = np.random.default_rng(seed)
    at = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = reach * (1 + rough * np.cumsum(rng.normal(0, 1, n) / math.sqrt(n)) * np.sin(at / 2)) * (1 + 0.3 * np.sin(5 * at))
    return list(zip((r * np.cos(at) + 1.0).tolist(), (r * np.sin(at) - 2.0).tolist(), strict=True))


def zone_of(spark, ring, *holes):
    """As a table; the outer ring runs the other way round than the holes or the same way, as given."""
    rows = [([{"ring": [{"x": x, "y": y} for x, y in r], "hole": h} for r, h in ((ring, False), *((q, True) for q in holes))],)]
    return spark.createDataFrame(rows, f"poly {G.POLYGON}")


@pytest.mark.parametrize("turn", [False, True])
def test_zones_of_any_shape(spark, turn):
    coast, lake = star(90, 1, 40.0, 0.2), [(-3.0, -9.0), (9.0, -6.0), (5.0, 7.0), (2.0, -1.0), (-6.0, 6.0)]
    zone = zone_of(spark, coast[::-1] if turn else coast, lake[::-1])
    rng = np.random.default_rng(2)
    boxes = [(i, *lo, *(lo + size)) for i in range(300) for lo, size in [(rng.uniform(-60, 50, 2), rng.uniform(0.2, 30, 2))]]
    boxes = [(i, *map(float, b)) for i, *b in boxes]
    rows = spark.createDataFrame(boxes, "id long, xmin double, ymin double, xmax double, ymax double")
    polys = rows.withColumn("poly", G.polygon(G.rectangle(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])))
    want = {i: inside(coast, *b) - inside(lake, *b) for i, *b in boxes}
    for width in (3.0, 17.0):
        got = {r["id"]: r["area"] for r in overlay.clip_to_zone(polys, zone, width, ["id"]).collect()}
        assert set(got) == {i for i, a in want.items() if a > 1e-9} and all(got[i] == pytest.approx(want[i], abs=1e-7) for i in got)
    other = zone_of(spark, [(-10.0, -50.0), (20.0, -50.0), (20.0, 50.0), (-10.0, 50.0)])
    both = {r["id"]: r["area"] for r in overlay.clip_to_both(polys, zone, other, 9.0, ["id"]).collect()}
    for i, x0, y0, x1, y1 in boxes:
        cut_ = (max(x0, -10.0), max(y0, -50.0), min(x1, 20.0), min(y1, 50.0))
        a = inside(coast, *cut_) - inside(lake, *cut_) if cut_[0] < cut_[2] and cut_[1] < cut_[3] else 0.0
        assert both.get(i, 0.0) == pytest.approx(a, abs=1e-7)
    grid_ = overlay.hex_grid(zone, 5.0)
    whole = overlay.hex_pieces(overlay.with_box(zone), 5.0).groupBy("q", "r").agg(F.sum("piece_area").alias("a")).where("a > 1e-9")
    assert {tuple(r) for r in grid_.select("q", "r").collect()} == {tuple(r) for r in whole.select("q", "r").collect()}
    # lattice: runs against every cell
    cells = spark.range(-60, 60).select(F.col("id").alias("i")).crossJoin(spark.range(-60, 60).select(F.col("id").alias("j")))
    at = (F.col("i") + 0.5) * 1.5, (F.col("j") + 0.5) * 1.5
    on = cells.crossJoin(zone).where(G.contains(F.col("poly"), *at)).select("i", "j")
    some = polys.where("id < 12").select(F.lit(1).alias("k"), "poly", "xmin", "ymin", "xmax", "ymax")
    hit = cells.join(some, (at[0] >= F.col("xmin")) & (at[0] < F.col("xmax")) & (at[1] >= F.col("ymin")) & (at[1] < F.col("ymax"))).select("i", "j").distinct()
    assert overlay.union_area(some, 1.5, ["k"]).first()["area"] == pytest.approx(hit.count() * 2.25)
    assert overlay.union_area(some, 1.5, ["k"], "area", zone).first()["area"] == pytest.approx(hit.join(on, ["i", "j"]).count() * 2.25)
    assert overlay.zone_runs(zone, 1.5).agg(F.sum(F.col("i1") - F.col("i0") + 1)).first()[0] == on.count()


def test_a_zone_of_many_sides(spark):
    """50,000 sides: terms follow the sides and the hexes, not their product."""
    coast = star(50_000, 3, 100_000.0, 0.05)
    zone = zone_of(spark, coast).cache()
    step = 20_000.0
    boxes = spark.range(-8, 8).select(F.col("id").alias("i")).crossJoin(spark.range(-8, 8).select(F.col("id").alias("j")))
    boxes = boxes.select((F.col("i") * 100 + F.col("j")).alias("id"), *[F.expr(e).cast("double").alias(c) for c, e in zip(("xmin", "ymin", "xmax", "ymax"), (f"i * {step}", f"j * {step}", f"(i + 1) * {step}", f"(j + 1) * {step}"), strict=True)])
    polys = boxes.withColumn("poly", G.polygon(G.rectangle(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])))
    assert overlay.zone_terms(zone, 10_000.0).count() < 60_000
    got = overlay.clip_to_zone(polys, zone, 10_000.0, ["id"]).agg(F.sum("area")).first()[0]
    want = sum(p[0] * n[1] - n[0] * p[1] for p, n in zip(coast, coast[1:] + coast[:1], strict=True)) / 2
    assert got == pytest.approx(want, rel=1e-9)


def test_neighbour_weights_add_up(spark):
    cells = spark.createDataFrame([(q * 10 + r, q, r) for q in range(4) for r in range(4)] + [(999, 50, 50)], "hex_id long, q int, r int")
    e = grid.neighbours(cells)
    assert {round(r[1], 9) for r in e.groupBy("src").agg(F.sum("w")).collect()} == {1.0} and e.where("src = 999").count() == 0
    assert e.groupBy("src").count().agg(F.max("count")).first()[0] == 6


def test_inverse_distances_move_no_edges(spark):
    """Points meet last of all: no shuffle, sort or join holds an edge."""
    df = spark.range(90).select(F.col("id").alias("hex_id"), (F.col("id") * 37 % 11).cast("double").alias("x"), (F.col("id") * 53 % 13).cast("double").alias("y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = grid.inverse_distance(df, 3.0, 2)
        plan = e._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "gx" in next(line for line in plan if "Join" in line or "Exchange" in line)
    xy = np.array([(k * 37 % 11, k * 53 % 13) for k in range(90)], dtype=float)
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    w = np.where((d > 0) & (d <= 3), 1 / np.maximum(d, 1) ** 2, 0)
    w /= w.sum(axis=1, keepdims=True)
    got = {(r["src"], r["dst"]): r["w"] for r in e.collect()}
    assert got == pytest.approx({(int(i), int(j)): w[i, j] for i, j in zip(*np.nonzero(w), strict=True)})


def test_gaps_in_years(spark):
    p = spark.createDataFrame([(1, 2000, 2), (2, 2000, 1), (1, 2003, 3)], "hex_id int, year int, severity int")
    got = {(r["hex_id"], r["year"]): r["severity"] for r in panel.densify(p, p.select("hex_id").distinct()).collect()}
    assert got == {(1, 2000): 2, (2, 2000): 1, (1, 2001): 2, (2, 2001): 1, (1, 2002): 2, (2, 2002): 1, (1, 2003): 3, (2, 2003): 0}
    t = panel.transitions(p.withColumnRenamed("severity", "state")).collect()
    assert [tuple(r) for r in t] == [(1, 2000, 2, 3)]


def _median(rows):
    rows = sorted((x, w) for x, w in rows if x is not None and w is not None and w > 0)
    half, c, last = sum(w for _, w in rows) / 2, 0.0, None
    for x, w in rows:
        at = c + w / 2
        if at >= half:
            return x if last is None else last[0] + (x - last[0]) * (half - last[1]) / (at - last[1])
        last, c = (x, at), c + w
    return rows[-1][0]


def test_weighted_median_of_a_hot_hex(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(rng.integers(0, 400)) if k % 3 else 17.0, float(rng.integers(0, 9))) for k in range(6000)]
    rows += [(f"h{k % 90}", float(rng.normal()), float(rng.exponential())) for k in range(900)]
    rows += [("even", v, 1.0) for v in (1.0, 2.0, 3.0, 4.0)] + [("one", 5.0, 2.0), ("ends", 1.0, 1.0), ("ends", 9.0, 8.0), ("gone", None, 1.0), ("gone", 1.0, 0.0), (None, 3.0, 1.0), (None, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double").repartition(7)
    got = {r["k"]: r["m"] for r in hexagg.weighted_median(df, ["k"], "x", "w", "m").collect()}
    groups = {}
    for k, x, w in rows:
        groups.setdefault(k, []).append((x, w))
    groups.pop("gone")
    assert set(got) == set(groups)
    for k in got:
        assert got[k] == pytest.approx(_median(groups[k])), k


def test_nearest_active_far_and_crowded(spark):
    n = 64
    cells = [(q * n + r, float(q), float(r)) for q in range(n) for r in range(n)]
    points = spark.createDataFrame(cells, "hex_id int, x double, y double")
    # year 1: a crowd in one corner; year 2: one focus; year 3: none
    rows = [(i, 1, 3 if x + y > 2 * n - 14 else 0) for i, x, y in cells] + [(i, 2, 3 if i == 5 else 0) for i, *_ in cells] + [(i, 3, 0) for i, *_ in cells] + [(i, 4, 0) for i, *_ in cells]
    got = {(r["hex_id"], r["year"]): r["distance"] for r in panel.nearest_active(points, spark.createDataFrame(rows, "hex_id int, year int, severity int"), 3, 1.0).collect()}
    xy = np.array([c[1:] for c in cells])
    for year in (1, 2, 3):
        at = xy[[i for i, y, s in rows if y == year and s >= 3]]
        for i in range(0, n * n, 61):
            want = np.hypot(*(at - xy[i]).T).min() if len(at) else None
            assert got[i, year + 1] == (None if want is None else pytest.approx(want))
    assert got[0, 1] is None


def test_nearest_active_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    at = rng.uniform(0, 500, (80, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "hex_id int, x double, y double")
    severity = rng.integers(0, 4, (80, 3)) * (rng.random((80, 3)) < 0.1)
    rows = [(i, 2000 + t, int(severity[i, t])) for i in range(80) for t in range(3)]
    got = {(r["hex_id"], r["year"]): r["distance"] for r in panel.nearest_active(points, spark.createDataFrame(rows, "hex_id int, year int, severity int"), 2, 5.0).collect()}
    for i in range(80):
        assert got[i, 2000] is None
        for t in (1, 2):
            on = np.flatnonzero(severity[:, t - 1] >= 2)
            want = min(math.hypot(*(at[i] - at[j])) for j in on) if len(on) else None
            assert got[i, 2000 + t] == (pytest.approx(want) if want is not None else None)


def test_perfect_and_empty_scores(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(9)] + [(None, 1)], "o int, p int")
    assert one(evaluate.scores(df, "o", "p")) == (1.0, 1.0, 0.0, 9)
    assert one(evaluate.pontius(df, "o", "p", 3)) == (1.0, None, 1.0) or one(evaluate.pontius(df, "o", "p", 3))[0] == 1.0
    assert one(evaluate.scores(df.where("o > 5"), "o", "p")) == (None, None, None, 0)
    assert {r["f1"] for r in evaluate.class_metrics(df, "o", "p", 4).collect()} == {1.0, None}


def test_memberships_add_up_and_objective_falls(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in (0, 3, 6)])
    rows = spark.createDataFrame([(i, v.tolist(), v.tolist()) for i, v in enumerate(x)], "id int, x array<double>, xl array<double>")
    last = None
    for n in (1, 2, 4, 8):
        c = cluster.fuzzy_cmeans(rows, [(2.0, 0.5)], 3, max_iter=n)
        u = cluster.memberships(rows, [(2.0, 0.5)], c).collect()
        assert all(sum(r["u"]) == pytest.approx(1) for r in u)
        value = sum(r["u"][k] ** 2 * 1.5 * float(((np.array(r["x"]) - c[0][k]) ** 2).sum()) for r in u for k in range(3))
        assert last is None or value <= last + 1e-9
        last = value
    u = cluster.memberships(rows, [(2.0, 0.5)], c)
    assert cluster.fuzzy_silhouette(u, 3, 2).first()["silhouette"] > 0.8 and cluster.explained_inertia(u, c, 2).first()["explained"] > 0.8


def test_fuzzy_settings_run_until_they_settle(spark):
    rng = np.random.default_rng(9)
    data = [(i, v, v) for i, v in enumerate((rng.normal(size=(60, 2)) + np.repeat([[0, 0], [2, 1], [1, 3]], 20, axis=0)).tolist())]
    rows = spark.createDataFrame(data, "id int, x array<double>, xl array<double>").coalesce(1)
    settings = [(1.2, 0.0), (2.0, 0.5)]
    with pytest.raises(RuntimeError):
        cluster.fuzzy_cmeans(rows, settings, 3, max_iter=2, settle=True)
    c = cluster.fuzzy_cmeans(rows, settings, 3, tol=1e-4, max_iter=500, settle=True)
    here = cluster.memberships(rows, settings, c)
    more = cluster.memberships(rows, settings, cluster.update_centers(here, 3))
    a, b = ({(r["setting"], r["id"]): np.array(r["u"]) for r in u.collect()} for u in (here, more))
    assert max(float(np.abs(a[i] - b[i]).max()) for i in a) <= 1e-4


def lattice(spark, n=8):
    rng = np.random.default_rng(5)
    cells = [(q * n + r, q, r) for q in range(n) for r in range(n)]
    df = spark.createDataFrame([(i, q, r, float(rng.normal() + 0.5 * q), float(rng.normal())) for i, q, r in cells], "hex_id int, q int, r int, y double, a double")
    return df, grid.neighbours(df)


def test_spatial_likelihoods(spark):
    df, e = lattice(spark)
    n = df.count()
    w = np.zeros((n, n))
    for r in e.collect():
        w[r["src"], r["dst"]] = r["w"]
    got = {r["model"]: r for r in models.compare_models(df, e, "y", ["a"]).collect()}
    assert set(got) == {"OLS", "SLX", "SAR", "SEM", "SDM", "SDEM", "GAM"}
    rows = df.orderBy("hex_id").collect()
    y, x = np.array([r["y"] for r in rows]), np.column_stack([np.ones(n), [r["a"] for r in rows]])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    sse = float(((y - x @ beta) ** 2).sum())
    ll = -n / 2 * (math.log(2 * math.pi * sse / n) + 1)
    assert got["OLS"]["log_lik"] == pytest.approx(ll) and got["OLS"]["aic"] == pytest.approx(-2 * ll + 6)
    assert got["SAR"]["log_lik"] >= ll - 1e-6 and got["SEM"]["log_lik"] >= ll - 1e-6 and got["SAR"]["rho"] > 0.2
    # every spatial model against a dense search
    wx = np.column_stack([x, w @ x[:, 1]])

    def profile(r, x, error):
        t, v = y - r * w @ y, x - r * w @ x if error else x
        rest = t - v @ np.linalg.lstsq(v, t, rcond=None)[0]
        return np.linalg.slogdet(np.eye(n) - r * w)[1] - n / 2 * (math.log(2 * math.pi * float(rest @ rest) / n) + 1)

    for name, design, error in (("SAR", x, False), ("SEM", x, True), ("SDM", wx, False), ("SDEM", wx, True)):
        best = max(np.tanh(np.linspace(-3.8, 3.8, 20001)), key=lambda r, design=design, error=error: profile(r, design, error))
        r = got[name]["lambda" if error else "rho"]
        assert r == pytest.approx(best, abs=2e-4) and got[name]["log_det_error"] < 1e-8
        assert got[name]["log_lik"] == pytest.approx(profile(r, design, error)) and got[name]["log_lik"] >= profile(best, design, error) - 1e-9


def test_additive_model(spark):
    """Against penalised least squares on the whole design; each covariate finds its own smoothness."""
    rng = np.random.default_rng(4)
    n = 400
    cells = [(k, k % 20, k // 20) for k in range(n)]
    a, b, two = rng.uniform(-2, 2, n), rng.uniform(0, 5, n), rng.integers(0, 2, n).astype(float)
    truth = np.sin(2.5 * a) + 0.4 * b
    y = truth + rng.normal(0, 0.3, n)
    df = spark.createDataFrame([(*c, float(p), float(q), float(t), float(v)) for c, p, q, t, v in zip(cells, a, b, two, y, strict=True)], "hex_id int, q int, r int, a double, b double, two double, y double")
    got = {r["model"]: r for r in models.compare_models(df, grid.neighbours(df), "y", ["a", "b", "two"]).collect()}
    assert got["GAM"]["aic"] < got["OLS"]["aic"] - 200 and got["GAM"]["pseudo_r2"] > 0.85 > got["OLS"]["pseudo_r2"] + 0.2
    # the same penalties in numpy
    knots = np.linspace(-1.4, 1.4, 8)
    design, smooths, names = [np.ones(n), a, b], [], ["c", "a", "b"]
    for v, c in ((a, "a"), (b, "b")):
        u = (v - v.mean()) / v.std(ddof=1)
        cols = [u**2, u**3, *(np.maximum(u - k, 0) ** 3 for k in knots)]
        smooths.append(([f"{c}{k}" for k in range(len(cols))], models.curvature(knots.tolist(), u.min(), u.max())))
        design += cols
        names += smooths[-1][0]
        grid_ = np.linspace(u.min(), u.max(), 20001)
        second = np.array([np.full_like(grid_, 2.0), 6 * grid_, *(6 * np.maximum(grid_ - k, 0) for k in knots)])
        assert np.allclose(smooths[-1][1], np.trapezoid(second[:, None] * second[None], grid_), rtol=1e-4)
    x = np.column_stack([*design, y])
    index = {v: k for k, v in enumerate([*names, "y"])}
    fit = models.additive(x.T @ x, index, "y", ["c", "a", "b"], smooths, n)
    assert fit.smoothing[0] < fit.smoothing[1] / 100 and 6 < fit.freedom < 16
    m = np.zeros((len(names), len(names)))
    at, scale = 3, np.sqrt((x**2).sum(axis=0))
    for (terms, s), k in zip(smooths, fit.smoothing, strict=True):
        own = slice(at, at + len(terms))
        m[own, own] = k * s / np.trace(s / np.outer(scale[own], scale[own]))
        at += len(terms)
    d = x[:, :-1]
    beta = np.linalg.solve(d.T @ d + m, d.T @ y)
    assert np.allclose(d @ fit.fit.beta, d @ beta, atol=1e-3) and np.abs(d @ beta - truth).mean() < 0.1
    assert fit.fit.sse == pytest.approx(float(((y - d @ beta) ** 2).sum()), rel=1e-3)


def test_silhouettes_by_distance(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (n, 3)) for c, n in ((0, 60), (3, 700), (6, 40))])
    own = np.repeat([0, 1, 2], [60, 700, 40])
    u = np.full((len(x), 3), 0.15) + rng.uniform(0, 0.05, (len(x), 1)) * np.array([1, -1, 0])
    u[np.arange(len(x)), own] = 0.7
    df = spark.createDataFrame([(0, k, p.tolist(), q.tolist()) for k, (p, q) in enumerate(zip(x, u, strict=True))], "setting int, id int, x array<double>, u array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    means = np.stack([np.where(own == c, d[:, own == c].sum(axis=1) / (sum(own == c) - 1), d[:, own == c].mean(axis=1)) for c in range(3)], axis=1)
    a = means[np.arange(len(x)), own]
    means[np.arange(len(x)), own] = np.inf
    b = means.min(axis=1)
    lead = u.max(axis=1) - np.sort(u, axis=1)[:, 1]
    want = float(lead @ ((b - a) / np.maximum(a, b)) / lead.sum())
    exact = cluster.silhouette_by_distance(df, 1000).first()
    assert exact["silhouette"] == pytest.approx(want) and exact["error"] == 0
    some = cluster.silhouette_by_distance(df, 50).first()
    assert 0 < some["error"] < 0.2 and abs(some["silhouette"] - want) <= some["error"]


def test_silhouettes_by_distance_of_all_pairs(spark, monkeypatch):
    """More rows than the sample had, in several blocks: exact, error 0; a cluster of one row, and copies of a row."""
    monkeypatch.setattr(cluster, "BLOCK", 300)
    rng = np.random.default_rng(4)
    x, own = np.concatenate([rng.normal(c, 1.0, (n, 3)) for c, n in ((0, 900), (3, 700), (9, 1))]), np.repeat([0, 1, 2], [900, 700, 1])
    x[5:9] = x[4]
    u = np.full((len(x), 3), 0.1) + rng.uniform(0, 0.05, (len(x), 1)) * np.array([1, -1, 0])
    u[np.arange(len(x)), own] = 0.8
    df = spark.createDataFrame([(s, k, p.tolist(), q.tolist()) for s in (0, 1) for k, (p, q) in enumerate(zip(x, u, strict=True)) if s == 0 or k < 40], "setting int, id int, x array<double>, u array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    means = np.stack([d[:, own == c].sum(axis=1) / np.maximum(sum(own == c) - (own == c), 1) for c in range(3)], axis=1)
    at = np.arange(len(x))
    a = means[at, own]
    means[at, own] = np.inf
    b, lead = means.min(axis=1), u.max(axis=1) - np.sort(u, axis=1)[:, 1]
    want = float(lead @ np.where(own == 2, 0, (b - a) / np.maximum(a, b)) / lead.sum())
    got = {r["setting"]: r for r in cluster.silhouette_by_distance(df).collect()}
    assert got[0]["silhouette"] == pytest.approx(want, rel=1e-9) and got[0]["error"] == 0
    assert got[1]["silhouette"] == 0  # one cluster only


def test_quality_of_a_sweep(spark, monkeypatch):
    """The same as from rows of memberships, without a table of rows, settings and features."""
    monkeypatch.setattr(cluster, "CHUNK", 16)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.6, (30, 4)) for c in (0, 2, 5)])
    rows = spark.createDataFrame([(i, v.tolist(), (v + rng.normal(size=4) / 5).tolist(), i % 9, i // 9) for i, v in enumerate(x)], "id long, x array<double>, xl array<double>, q int, r int").cache()
    e = grid.neighbours(rows.select("id", "q", "r"), "id")
    settings = [(1.1, 0.0), (2.0, 0.0), (1.6, 0.7)]
    written = []
    monkeypatch.setattr(cluster, "cut", lambda df, real=cluster.cut: written.append(df.columns) or real(df))
    centers = cluster.fuzzy_cmeans(rows, settings, 3, tol=1e-6, max_iter=500, settle=True)
    got = {r["setting"]: r[1:] for r in cluster.sweep_quality(rows, e, settings, centers).collect()}
    assert not any("setting" in c and "x" in c for c in written)
    u = cluster.memberships(rows, settings, centers).cache()
    for part, j in ((cluster.explained_inertia(u, centers, 4), 0), (cluster.fuzzy_silhouette(u, 3, 4), 1), (cluster.spatial_inconsistency(u, e, 3), 2)):
        assert {k: v[j] for k, v in got.items()} == pytest.approx({r[0]: r[1] for r in part.collect()}, rel=1e-9)


def test_spatial_blocks_against_plain_k_means(spark):
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.normal(c, 1.0, (60, 2)) for c in ((0, 0), (9, 1), (2, 8), (11, 10))])
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "hex_id int, x double, y double")
    got = {r["hex_id"]: r["block"] for r in cluster.spatial_blocks(df, 4, 1, 10).collect()}
    label = np.array([got[k] for k in range(len(xy))])
    inertia = lambda of: sum(((xy[of == c] - xy[of == c].mean(axis=0)) ** 2).sum() for c in set(of.tolist()))
    best = np.inf
    for _ in range(10):
        c = xy[rng.choice(len(xy), 4, replace=False)]
        for _ in range(60):
            of = ((xy[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([xy[of == k].mean(axis=0) if (of == k).any() else c[k] for k in range(4)])
        best = min(best, inertia(of))
    assert len(set(label.tolist())) == 4 and inertia(label) <= 1.001 * best
    same = df.where("hex_id < 3").withColumns({"x": F.lit(1.0), "y": F.lit(2.0)})
    assert {r["block"] for r in cluster.spatial_blocks(same, 4, 1, 2).collect()} == {0}


def test_fuzzy_clusters_against_a_plain_loop(spark):
    """The whole loop, to where it settles, from the same rows."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.7, (40, 2)) for c in (0, 3, 6)])
    lag = x + rng.normal(0, 0.2, x.shape)
    rows = spark.createDataFrame([(k, p.tolist(), q.tolist()) for k, (p, q) in enumerate(zip(x, lag, strict=True))], "id int, x array<double>, xl array<double>")
    first = [r["id"] for r in rows.orderBy(F.xxhash64(F.lit(456), F.col("id")), "id").limit(3).collect()]
    for m, alpha in ((2.0, 0.0), (1.6, 0.6)):
        got = cluster.fuzzy_cmeans(rows, [(m, alpha)], 3, tol=1e-7, max_iter=300, settle=True)[0]
        c = x[first]
        for _ in range(400):
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2) + alpha * ((lag[:, None] - c[None]) ** 2).sum(axis=2)
            w = np.maximum(d, 1e-300) ** (-1 / (m - 1))
            u = (w / w.sum(axis=1, keepdims=True)) ** m
            c = (u.T @ (x + alpha * lag)) / (1 + alpha) / u.sum(axis=0)[:, None]
        assert np.allclose(np.sort(got, axis=0), np.sort(c, axis=0), atol=1e-4)


def test_log_determinants(spark):
    cells = spark.range(30 * 37).select((F.col("id") % 30).cast("int").alias("q"), F.floor(F.col("id") / 30).cast("int").alias("r")).where("(q * 7 + r * 3) % 11 <> 0")
    cells = cells.withColumn("hex_id", grid.hex_id(F.col("q"), F.col("r")))
    near = grid.neighbours(cells)
    ids = {r["hex_id"]: k for k, r in enumerate(cells.collect())}
    rhos = [-0.99, -0.3, 0.0, 0.7, 0.99]

    def dense(edges):
        w = np.zeros((len(ids),) * 2)
        for r in edges.collect():
            w[ids[r["src"]], ids[r["dst"]]] = r["w"]
        return [np.linalg.slogdet(np.eye(len(ids)) - r * w)[1] for r in rhos]

    exact = dense(near)
    det = logdet.determinant(near, cells, "hex_id", ("q", "r"))
    assert np.allclose(det.compute(rhos)[0], exact, atol=1e-9)
    assert max(abs(det(r) - v) for r, v in zip(rhos, exact, strict=True)) < 0.01
    det.refine([0.7])
    assert det(0.7) == pytest.approx(exact[3], abs=1e-9)
    # weights that do not run both ways, from afar, with a cell that has no neighbour
    jump = spark.createDataFrame([(a, b, 0.5) for a, b in zip(sorted(ids)[:40], sorted(ids)[500:540], strict=True)], "src long, dst long, w double")
    c, e, levels = logdet.lattice(jump, cells.select(F.col("hex_id").alias("id"), "q", "r"), 2)
    assert np.allclose(logdet.dissected(c, e, levels, rhos, 2), dense(jump), atol=1e-9)
    assert logdet.largest_front(c, levels, 2) >= 16
    with pytest.raises(ValueError, match="both ways"):
        logdet.lanczos(jump, cells.select(F.col("hex_id").alias("id")))
    # quadrature holds what it says
    values, errors = logdet.determinant(near, cells, "hex_id", ("q", "r"), front=10).compute(rhos)
    assert all(abs(v - x) <= 1.5 * d + 1e-9 for v, x, d in zip(values, exact, errors, strict=True)) and max(errors[1:4]) < 0.5
    assert det.compute([0.5])[0] and logdet.lattice(near.where("false"), cells.select(F.col("hex_id").alias("id"), "q", "r"))[2] == 1


def test_moran_over_all_pairs_without_pairs(spark):
    rng = np.random.default_rng(2)
    cells = [(q * 64 + r, q + r / 2, r * math.sqrt(3) / 2) for q in range(40) for r in range(40)]
    z = np.cumsum(rng.normal(size=len(cells))) / 10 + rng.normal(size=len(cells))
    df = spark.createDataFrame([(i, x, y, float(v)) for (i, x, y), v in zip(cells, z, strict=True)] + [(-1, 3.0, 3.0, None)], "hex_id long, x double, y double, value double")
    xy = np.array([c[1:] for c in cells])
    d = np.hypot(*(xy[:, None, :] - xy[None, :, :]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    for power, reach in ((1, 2), (2, 2), (2, 3)):
        w = d ** -float(power)
        sums = {r["hex_id"]: r for r in farfield.distance_sums(df.where("value is not null"), ["value"], [power], 4.0, reach).collect()}
        got, bound = (np.array([sums[c[0]][f"value_{power}{e}"] for c in cells]) for e in ("", "_error"))
        assert (np.abs(got - w @ z) <= bound + 1e-9).all() and np.abs(got - w @ z).max() < 0.02 * np.abs(w @ z).max() and bound.max() > 0
        w /= w.sum(axis=1, keepdims=True)
        c = z - z.mean()
        exact = len(z) / w.sum() * (c @ w @ c) / (c @ c)
        r = farfield.moran_by_distance(df, power, 4.0, reach).first()
        assert r["n"] == len(z) and abs(r["moran_i"] - exact) <= r["error"] and abs(r["moran_i"] - exact) < 1e-3 * abs(exact)
        n, s0, s1, s2 = len(z), w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(axis=0) + w.sum(axis=1)) ** 2).sum()
        b2 = n * (c**4).sum() / (c @ c) ** 2
        var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - 1 / (n - 1) ** 2
        assert r["variance"] == pytest.approx(var, rel=0.02)
    one = farfield.moran_by_distance(df.where("hex_id < 2"), 1).first()
    assert one["n"] < 4 and one["moran_i"] is None


def test_sums_over_a_crowded_leaf(spark):
    """Pairs are worked out in parts, and a leaf that holds too many points is split."""
    rng = np.random.default_rng(6)
    x, v = rng.uniform(0, 100, (3000, 2)), rng.normal(size=(3000, 1))
    x[7] = x[8]
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    square[square == 0] = np.inf
    tracemalloc.start()
    sums = farfield._meet(x, x, [1, 2], v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(sums[0], square**-0.5 @ v) and np.allclose(sums[1], (1 / square) @ v) and peak < 64e6
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), (c,)) in enumerate(zip(x, v, strict=True))], "hex_id long, x double, y double, value double")
    got = {r["hex_id"]: r for r in farfield.distance_sums(df, ["value"], [1], 100.0).collect()}
    found, bound = (np.array([got[i][f"value_1{e}"] for i in range(len(x))]) for e in ("", "_error"))
    assert bound.max() > 0 and (np.abs(found - sums[0][:, 0]) <= bound + 1e-9).all()


def test_local_moran_moments(spark):
    df, e = lattice(spark, 5)
    rows = df.orderBy("hex_id").collect()
    y = np.array([r["y"] for r in rows])
    n, z = len(y), y - y.mean()
    got = {r["hex_id"]: r for r in spatial.local_moran(df, e, "y").collect()}
    rng = np.random.default_rng(1)
    i = 12
    near = [(r["dst"], r["w"]) for r in e.where(f"src = {i}").collect()]
    others = np.delete(z, i)
    draws = np.array([z[i] / (z @ z / n) * sum(wt * v for (_, wt), v in zip(near, rng.choice(others, len(near), replace=False), strict=True)) for _ in range(20000)])
    assert got[i]["expected"] == pytest.approx(draws.mean(), abs=0.03) and got[i]["variance"] == pytest.approx(draws.var(), rel=0.06)
    assert got[i]["ii"] == pytest.approx(z[i] / (z @ z / n) * sum(wt * z[j] for j, wt in near))


def test_permutation_test(spark):
    df, e = lattice(spark, 6)
    p = spatial.moran_permutations(df, e, "y", sims=99, batch=40).first()
    noise = spatial.moran_permutations(df, e, "a", sims=99, batch=40).first()
    assert p["moran_i"] == pytest.approx(spatial.global_moran(df, e, "y").first()["moran_i"]) and p["p_value"] <= 0.05 < noise["p_value"] + 0.05 and p["sims"] == 99


def test_noise_ranks_last(spark):
    rng = np.random.default_rng(4)
    rows = [(int(s), float(s + rng.normal()), float(rng.normal()), "ab"[int(s > 1)]) for s in rng.integers(0, 4, 300)]
    df = spark.createDataFrame(rows, "s int, good double, noise double, kind string")
    t = assoc.rank_covariates(df, {"noise": "continuous", "good": "continuous", "kind": "categorical"}, "s").collect()
    assert t[-1]["covariate"] == "noise" and t[-1]["label"] == "négligeable" and t[-1]["p"] > 0.01
    assert next(r for r in t if r["covariate"] == "good")["p"] < 1e-6
    assert assoc.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and assoc.chi2_tail(30.0, 10) == pytest.approx(0.000857, rel=1e-2)
    assert assoc.associate(df.limit(2), "good", "s", "continuous") == ("spearman", None, None, None)


def test_yates_and_missing_levels(spark):
    df = spark.createDataFrame([(a, b) for a, b, n in (("x", "u", 10), ("x", "v", 5), ("y", "u", 3), ("y", "v", 12)) for _ in range(n)], "a string, b string")
    e = 15 * 13 / 30
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in ((10, e), (5, 15 - e), (3, e), (12, 15 - e)))
    assert assoc.cramers_v(df, "a", "b").first()["chi2"] == pytest.approx(want)
    assert assoc.cramers_v(df.where("a = 'x'"), "a", "b").first()["v"] is None


def test_vif_of_dependent_columns(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(2 * a + 1), float(b)) for a, b in rng.normal(0, 1, (40, 2))], "a double, b double, c double")
    got = {r["covariate"]: r["vif"] for r in assoc.vif(df, ["a", "b", "c"]).collect()}
    assert got["a"] == got["b"] == float("inf") and got["c"] < 1.5
    assert {r["vif"] for r in assoc.vif(df.limit(3), ["a", "b", "c"]).collect()} == {None}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "region string, v int")
    with pytest.raises(io.EmptyZone):
        io.region_scan(df, "region", ["O'Brien"], required=True)
    p = spark.createDataFrame([(1, 2000, 1), (1, 2001, 2)], "hex_id int, year int, severity int")
    io.write_panel(p, str(tmp_path / "p"), ["B", "A"], 5000.0, {"x": [], "y": ["g1"]})
    with pytest.warns(UserWarning, match="built for"):
        io.read_panel(spark, str(tmp_path / "p"), ["A"], 5000.0)
    assert io.read_panel(spark, str(tmp_path / "p"), ["A", "B"], 5000.0).count() == 2
    assert io.covariates_of(spark, str(tmp_path / "p"), "g2") == ["x"] and io.covariates_of(spark, str(tmp_path / "p"), "g1") == ["x", "y"]


def test_projection_of_the_origin(spark):
    row = spark.range(1).select(*G.conformal_conic(F.lit(-68.5), F.lit(44.0)), *G.conformal_conic(F.lit(-71.2), F.lit(46.8)))
    x0, y0, x1, y1 = one(row)
    assert abs(x0) < 1e-6 and abs(y0) < 1e-6 and x1 == pytest.approx(-206000, abs=1500) and y1 == pytest.approx(315000, abs=3000)


def test_panel_versions(spark, tmp_path):
    path = str(tmp_path / "panel")
    assert io.cached_panel(spark, path, ["a"], 5.0) is None
    one = spark.createDataFrame([(k, y, y % 3) for k in range(6) for y in (2000, 2001, 2002)], "hex_id int, year int, severity int")
    io.write_panel(one, path, ["a"], 5.0, {"c": ["group1"], "d": []})
    seen = lambda: {(r["hex_id"], r["year"]): r["severity"] for r in io.read_panel(spark, path, ["a"], 5.0).collect()}
    before = seen()
    assert len(before) == 18
    # a write that fails half-way leaves the old panel
    broken = one.withColumn("severity", F.when(F.col("hex_id") == 5, F.raise_error(F.lit("half-way")).cast("int")).otherwise(9))
    with pytest.raises(Exception, match="half-way"):
        io.write_panel(broken, path, ["a"], 5.0, {"c": ["group1"]})
    assert seen() == before and io.covariates_of(spark, path, "group2") == ["d"]
    # one year refreshed, by a reader that still holds the version before
    held = io.read_panel(spark, path, ["a"], 5.0)
    io.write_panel(one.withColumn("severity", F.lit(7)), path, ["a"], 5.0, {"c": []}, years=[2001])
    now = seen()
    assert all(v == (7 if y == 2001 else before[k, y]) for (k, y), v in now.items()) and len(now) == 18
    assert held.where("severity = 7").count() == 0
    with pytest.raises(ValueError, match="all of it"):
        io.write_panel(one, path, ["b"], 5.0, {}, years=[2001])
    for _ in range(3):  # old folders go, those that are still used stay
        io.write_panel(one.withColumn("severity", F.lit(8)), path, ["a"], 5.0, {"c": []}, years=[2002])
    assert {v for (_, y), v in seen().items() if y == 2002} == {8} and {v for (_, y), v in seen().items() if y == 2001} == {7} and len(seen()) == 18
    assert len(io._versions(spark, path)) <= 4
    with pytest.warns(UserWarning, match="built for"):
        io.read_panel(spark, path, ["a"], 6.0)


def test_box_scans_skip_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    n = 40_000
    place = lambda m: (F.xxhash64("id", F.lit(m)) % 10_000).cast("double")
    df = spark.range(n).select("id", place(1).alias("xmin"), place(2).alias("ymin")).withColumns({"xmax": F.col("xmin") + 20, "ymax": F.col("ymin") + 20})
    df = df.unionByName(spark.createDataFrame([(-1, None, None, None, None)], df.schema))
    box = (100.0, 200.0, 600.0, 700.0)

    def groups(path):
        met = total = 0
        for file in glob.glob(f"{path}/*.parquet"):
            meta = pq.ParquetFile(file).metadata
            at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                s = {c: meta.row_group(g).column(i).statistics for c, i in at.items()}
                total += 1
                met += not all(v.has_min_max for v in s.values()) or bool(s["xmin"].min <= box[2] and s["xmax"].max >= box[0] and s["ymin"].min <= box[3] and s["ymax"].max >= box[1])
        return met, total

    io.write_by_place(df, str(tmp_path / "placed"), 16, 256 << 10)
    df.repartition(16).write.parquet(str(tmp_path / "plain"))
    (met, total), plain = groups(tmp_path / "placed"), groups(tmp_path / "plain")
    assert total >= 16 and met <= 0.25 * total and plain[0] == plain[1]
    scan = lambda path: sorted(r["id"] for r in io.box_scan(spark.read.parquet(str(tmp_path / path)), *box, keep=["id"]).collect())
    assert scan("placed") == scan("plain") and scan("placed")
    assert spark.read.parquet(str(tmp_path / "placed")).count() == n + 1
    io.write_by_place(df.where("false"), str(tmp_path / "none"), 2)


def _common(rings):
    """The part that convex counter-clockwise rings have in common."""
    out = rings[0]
    for cell in rings[1:]:
        for (ax, ay), (bx, by) in zip(cell, cell[1:] + cell[:1], strict=True):
            side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
            new = []
            for p, n in zip(out, out[1:] + out[:1], strict=True):
                s, t = side(p), side(n)
                if s >= 0:
                    new.append(p)
                if (s >= 0) != (t >= 0):
                    new.append((p[0] + s / (s - t) * (n[0] - p[0]), p[1] + s / (s - t) * (n[1] - p[1])))
            out = new
    return out


def _shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2 if ring else 0.0


def _polys(spark, rows):
    """(k, poly) of rows (k, rings…): the first ring and its holes."""
    made = [(k, None if rings is None else [{"ring": [{"x": float(x), "y": float(y)} for x, y in r], "hole": n > 0} for n, r in enumerate(rings)]) for k, rings in rows]
    return spark.createDataFrame(made, f"k string, poly {G.POLYGON}")


@pytest.mark.parametrize("side", [0.7, 3.0, 50.0])
def test_exact_union_of_slanted_polygons(spark, side):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in ("a", None):  # a null key is a group as well
        rings = []
        for _ in range(7):
            (x, y), turn, reach, n = rng.uniform(-4, 4, 2), rng.uniform(0, 7), rng.uniform(1, 4), int(rng.integers(3, 7))
            rings.append([(x + reach * math.cos(turn + 2 * math.pi * i / n), y + reach * math.sin(turn + 2 * math.pi * i / n)) for i in range(n)])
        subsets = [[r for i, r in enumerate(rings) if m >> i & 1] for m in range(1, 1 << len(rings))]
        want[k] = sum((-1) ** (len(s) + 1) * _shoelace(_common(s)) for s in subsets)
        rows += [(k, [r if i % 2 else r[::-1]]) for i, r in enumerate(rings)] + [(k, [rings[0]])]
    got = {r["k"]: r["area"] for r in union.exact_union_area(_polys(spark, rows), side, ["k"]).collect()}
    assert got == pytest.approx(want, rel=1e-11)
    # inside a zone of two slanted squares that overlap: what the union loses when the zone is taken out of the sum
    zone = [[(-3, -4), (2, -5), (3, 0), (-2, 1)], [(0, -2), (4, -1), (3, 3), (-1, 2)]]
    whole = [[r for i, r in enumerate(zone) if m >> i & 1] for m in range(1, 4)]
    rings = {k: [r[0] if _shoelace(r[0]) > 0 else r[0][::-1] for q, r in rows if q == k][:-1] for k in want}
    inside = {}
    for k, own in rings.items():
        subsets = [[r for i, r in enumerate(own) if m >> i & 1] for m in range(1, 1 << len(own))]
        inside[k] = sum((-1) ** (len(s) + len(w)) * _shoelace(_common(s + w)) for s in subsets for w in whole)
    got = {r["k"]: r["area"] for r in union.exact_union_area(_polys(spark, rows), side, ["k"], zone=_polys(spark, [("z", [r]) for r in zone])).collect()}
    assert got == pytest.approx(inside, rel=1e-11)


def test_exact_union_of_odd_polygons(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    notched = [(0, 0), (9, 0), (9, 9), (5, 9), (5, 2), (4, 2), (4, 9), (0, 9)]
    rows = [("hole", [box(0, 0, 8, 8), box(2, 2, 6, 6)]), ("hole", [box(3, 3, 4, 9)]), ("notch", [notched]), ("touch", [box(0, 0, 4, 4)]), ("touch", [box(4, 0, 8, 4)]), ("touch", [box(0, 4, 4, 8)]), ("line", [box(1, 1, 5, 1)]), ("none", None), ("none", []), ("cross", [box(-5, -1, 5, 1)]), ("cross", [box(-1, -5, 1, 5)])]
    got = lambda side: {r["k"]: r["area"] for r in union.exact_union_area(_polys(spark, rows), side, ["k"]).collect()}
    want = {"hole": 48 + 3 + 1, "notch": 81 - 7, "touch": 48, "cross": 36}
    assert got(4.0) == pytest.approx(want) and got(1.3) == pytest.approx(want)
    assert union.exact_union_area(_polys(spark, []), 1.0, ["k"]).collect() == []
    assert union.exact_union_area(_polys(spark, rows[-2:]), 2.0).collect() == [(pytest.approx(36),)]


def test_exact_union_of_a_crowd(spark, monkeypatch):
    """Thousands of polygons on one place: tiles are split until one polygon fills them or few are left."""
    n, most = 4000, []
    covered = union._covered
    monkeypatch.setattr(union, "_covered", lambda rows, *a: most.append(rows.groupBy(*union.TILE).count().agg(F.max("count")).first()[0]) or covered(rows, *a))
    x, h = (F.col("id") * 37 % 1009) / 1009, 10 + (F.col("id") * 91 % 977) / 977
    ring = F.array(G.point(x, F.lit(0.0)), G.point(x + 10, F.lit(0.0)), G.point(x + 10, h), G.point(x, h))
    polys = spark.range(n).select(G.polygon(ring).alias("poly"))
    got = union.exact_union_area(polys, 16.0).first()["area"]
    i = np.arange(n)
    left, top = i * 37 % 1009 / 1009, 10 + i * 91 % 977 / 977
    cuts = np.unique(np.concatenate((left, left + 10)))
    order = np.argsort(-top)
    total, open_ = 0.0, np.ones(len(cuts) - 1, dtype=bool)
    for k in order:  # the highest first
        at = open_ & (cuts[:-1] >= left[k]) & (cuts[1:] <= left[k] + 10)
        total += top[k] * (cuts[1:] - cuts[:-1])[at].sum()
        open_ &= ~at
    assert got == pytest.approx(total, rel=1e-10) and max(m or 0 for m in most) <= union.LIMIT


def test_exact_union_shuffles_rims_only(spark):
    """Tiles that a polygon fills are dropped before the first shuffle; they do lie in the polygon, notches and holes or not."""
    x, y = F.col("id") * 37 % 101 / 10, F.col("id") * 91 % 97 / 10
    ring = F.array(G.point(x, y), G.point(x + 9, y + 1), G.point(x + 8, y + 10), G.point(x - 1, y + 9))
    polys = spark.range(600).select(G.polygon(ring).alias("poly"))
    sides = union._sides(polys, []).withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    rims, all_ = union._crowds(polys, [], 4.0)[0].count(), union._dealt(sides, 4.0, False).count()
    assert 2 * rims < all_, (rims, all_)
    notch = [(0, 0), (9, 0), (9, 9), (5, 9), (5, 3.5), (4, 3.5), (4, 9), (0, 9)]
    roofs = [(0, 0), (9, 0), (9, 9), (7, 9), (7, 4.5), (2, 4.5), (2, 6.5), (0, 6.5)]
    rows = [("notch", [notch]), ("roofs", [roofs[::-1]]), ("hole", [[(-1, -1), (9, 0), (8, 9), (0, 8)], [(3, 3), (3, 5), (5, 5), (5, 3)]])]
    inner = union._inner(_polys(spark, rows), ["k"], 1.0).select("_g.k", "i", "j").collect()
    assert {r["k"] for r in inner} == {"notch", "roofs", "hole"}
    tiles = _polys(spark, [(f"{r['k']} {r['i']} {r['j']}", [[(r["i"], r["j"]), (r["i"] + 1, r["j"]), (r["i"] + 1, r["j"] + 1), (r["i"], r["j"] + 1)]]) for r in inner]).withColumn("of", F.substring_index("k", " ", 1))
    met = tiles.join(_polys(spark, rows).select(F.col("k").alias("of"), F.col("poly").alias("whole")), "of")
    areas = [r[0] for r in met.select(G.clip_area(F.col("whole"), G.edges(F.col("poly")[0]["ring"]))).collect()]
    assert len(areas) == len(inner) and areas == pytest.approx([1.0] * len(areas))


def test_exact_union_in_a_zone_of_many_sides(spark, monkeypatch):
    """A square with a hole that covers a zone of many sides has the zone less the hole; the zone's tiles are split."""
    n = 600
    ring = [((6 + 0.4 * (i % 2)) * math.cos(2 * math.pi * i / n), (6 + 0.4 * (i % 2)) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    square = [[(-9, -9), (9, -9), (9, 9), (-9, 9)], [(-1, -1), (1, -1), (1, 1), (-1, 1)]]
    polys = _polys(spark, [("a", square), ("a", square), ("far", [[(20, 20), (21, 20), (21, 21)]])])
    most = []
    covered = union._covered
    monkeypatch.setattr(union, "_covered", lambda rows, *a: most.append(rows.groupBy(*union.TILE).count().agg(F.max("count")).first()[0]) or covered(rows, *a))
    got = union.exact_union_area(polys, 16.0, ["k"], zone=_polys(spark, [("z", [ring])])).collect()
    assert [r["k"] for r in got] == ["a"] and got[0]["area"] == pytest.approx(_shoelace(ring) - 4, rel=1e-11)
    assert max(m or 0 for m in most) <= union.LIMIT
