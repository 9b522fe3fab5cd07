"""Queries over clusters, regressions, forests and composite reports."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import cluster, evaluate, grid, logdet, models, panel, report, spatial
from ..sources import io
from ..sources.scratch import cut, folder
from . import basic
from . import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Components of the given vectors: all of them.
DIMS = 64


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = X.sql(sql)
        return f

    return put


def features(spark, d, lag=False):
    rows = X.feat(spark, d)
    if not lag:
        return rows.select("id", "x", F.col("x").alias("xl"), "q", "r", "label")
    e = grid.neighbours(rows.select("id", "q", "r"), "id")
    return cluster.lagged_features(rows, e, DIMS).select("id", "x", "xl", "q", "r", "label")


def start(rows):
    """Centres to step from: the means of the labels 0 to 3."""
    got = rows.where("label < 4").groupBy("label").agg(*[F.avg(F.get("x", F.lit(j))).alias(f"c{j}") for j in range(DIMS)]).orderBy("label").collect()
    return np.array([[r[f"c{j}"] for j in range(DIMS)] for r in got])


CENTRES = ", c as (select label, " + ", ".join(f"avg(x[{j + 1}]) as c{j}" for j in range(DIMS)) + " from fx7_feat where label < 4 group by label)"
DIST = "(" + " + ".join(f"pow(f.x[{j + 1}] - c.c{j}, 2)" for j in range(DIMS)) + ")"


@query(CENTRES + f""", k as (select f.id, c.label, {DIST} as d from fx7_feat f cross join c)
 select id, label + 1 as cluster, round((1 / d) / sum(1 / d) over (partition by id), 6) as u from k""")
def c1_membership_step(spark, d):
    rows = features(spark, d)
    u = cluster.memberships(rows, [(2.0, 0.0)], [start(rows)])
    return u.select("id", F.posexplode("u").alias("p", "v")).select("id", (F.col("p") + 1).alias("cluster"), F.round("v", 6).alias("u"))


LAGGED = ", e as (select a.id as src, b.id as dst, count(*) over (partition by a.id) as n from fx7_feat a join fx7_feat b on abs(b.q-a.q) + abs(b.r-a.r) + abs((b.q-a.q)+(b.r-a.r)) = 2), l as (select f.id, " + ", ".join(f"coalesce(sum(b.x[{j + 1}] / e.n), any_value(f.x[{j + 1}])) as l{j}" for j in range(DIMS)) + " from fx7_feat f left join e on e.src = f.id left join fx7_feat b on b.id = e.dst group by f.id)"
LDIST = "(" + " + ".join(f"pow(l.l{j} - c.c{j}, 2)" for j in range(DIMS)) + ")"


@query(CENTRES + LAGGED + f""", k as (select f.id, c.label, pow({DIST} + 0.6 * {LDIST}, -1 / 0.6) as d from fx7_feat f join l on l.id = f.id cross join c), u as (select id, label, d / sum(d) over (partition by id) as u from k)
 select u.label + 1 as cluster, round(sum(pow(u, 1.6) * (f.x[1] + 0.6 * l.l0) / 1.6) / sum(pow(u, 1.6)), 6) as c1, round(sum(pow(u, 1.6) * (f.x[2] + 0.6 * l.l1) / 1.6) / sum(pow(u, 1.6)), 6) as c2 from u join fx7_feat f on f.id = u.id join l on l.id = u.id group by u.label""")
def c2_spatial_step(spark, d):
    rows = cut(features(spark, d, lag=True))
    c = cluster.update_centers(cluster.memberships(rows, [(1.6, 0.6)], [start(rows)]), 4)[0]
    out = [(i + 1, round(float(v[0]), 6), round(float(v[1]), 6)) for i, v in enumerate(c)]
    return spark.createDataFrame(out, "cluster int, c1 double, c2 double")


def fitted(spark, d, settings, tol):
    rows = cut(features(spark, d, lag=True))
    centers = cluster.fuzzy_cmeans(rows, settings, 4, tol=tol, max_iter=5000, settle=True)
    return rows, centers, cluster.memberships(rows, settings, centers)


@query()
def c2_spatial_fcm(spark, d):
    _, _, u = fitted(spark, d, [(1.6, 0.6)], 1e-4)
    return u.select("id", cluster.hard_class(F.col("u")).alias("cluster"), *[F.round(F.get("u", F.lit(i)), 4).alias(f"groupe_{i + 1}") for i in range(4)])


@query()
def c3_c4_sweep_quality(spark, d):
    settings = [(round(1.1 + 0.1 * i, 1), 0.0) for i in range(20)] + [(1.6, round(0.05 * i, 2)) for i in range(41)]
    rows = cut(features(spark, d, lag=True))
    centers = cluster.fuzzy_cmeans(rows, settings, 4, tol=0.001, max_iter=5000, settle=True)
    e = grid.neighbours(rows.select("id", "q", "r"), "id")
    names = spark.createDataFrame([(i, m, a) for i, (m, a) in enumerate(settings)], "setting int, m double, alpha double")
    q = cluster.sweep_quality(rows, e, settings, centers)
    return names.join(q, "setting").select("m", "alpha", *[F.round(c, 4).alias(c) for c in ("explained", "silhouette", "inconsistency")])


@query(CENTRES + f""", k as (select f.id, c.label, {DIST} as d from fx7_feat f cross join c), u as (select id, label, d, (1 / d) / sum(1 / d) over (partition by id) as u from k),
 m as (select {", ".join(f"avg(x[{j + 1}]) as m{j}" for j in range(DIMS))} from fx7_feat)
 select round(1 - (select sum(u * d) from u) / (select sum({" + ".join(f"pow(x[{j + 1}] - m{j}, 2)" for j in range(DIMS))}) from fx7_feat, m), 6) as explained""")
def c4_explained_inertia(spark, d):
    rows = features(spark, d)
    c = start(rows)
    return cluster.explained_inertia(cluster.memberships(rows, [(2.0, 0.0)], [c]), [c], DIMS).select(F.round("explained", 6).alias("explained"))


@query(CENTRES + f""", k as (select f.id, c.label, {DIST} as d from fx7_feat f cross join c), u as (select id, label, (1 / d) / sum(1 / d) over (partition by id) as u from k),
 h as (select id, arg_max(label, u) as c, max(u) - list_sort(list(u), 'desc')[2] as lead from u group by id),
 p as (select a.id, ha.c as own, hb.c as other, ha.lead, list_distance(a.x, b.x) as d from fx7_feat a join h ha on ha.id = a.id cross join fx7_feat b join h hb on hb.id = b.id where a.id <> b.id),
 v as (select id, own, lead, other, avg(d) as d, avg(d * d) as d2 from p group by all),
 s as (select id, lead, max(case when other = own then d end) as a, min(case when other <> own then d end) as b, max(case when other = own then d2 end) as a2, min(case when other <> own then d2 end) as b2 from v group by id, lead)
 select round(sum(lead * coalesce((b2 - a2) / greatest(a2, b2), 0)) / sum(lead), 5) as squared, round(sum(lead * coalesce((b - a) / greatest(a, b), 0)) / sum(lead), 5) as distances, 0.0::double as error from s""")
def c4_fuzzy_silhouette(spark, d):
    """Of memberships in the means of four labels: with squared distances from moments, and with distances."""
    rows = features(spark, d)
    u = cut(cluster.memberships(rows, [(2.0, 0.0)], [start(rows)]))
    both = cluster.fuzzy_silhouette(u, 4, DIMS).withColumnRenamed("silhouette", "squared").join(cluster.silhouette_by_distance(u), "setting")
    return both.select(F.round("squared", 5).alias("squared"), F.round("silhouette", 5).alias("distances"), F.round("error", 5).alias("error"))


@query(CENTRES + f""", k as (select f.id, c.label, {DIST} as d from fx7_feat f cross join c), u as (select id, label, (1 / d) / sum(1 / d) over (partition by id) as u from k)
 select id, case when max(u) < 0.45 then 'undecided' else cast(arg_max(label, u) + 1 as varchar) end as cluster from u group by id""")
def c5_t2_hard_class(spark, d):
    rows = features(spark, d)
    return cluster.memberships(rows, [(2.0, 0.0)], [start(rows)]).select("id", cluster.hard_class(F.col("u")).alias("cluster"))


@query(CENTRES + f""", k as (select f.id, f.x, f.label as own, c.label, {DIST} as d from fx7_feat f cross join c), u as (select id, x, own, label, (1 / d) / sum(1 / d) over (partition by id) as u from k)
 select own as label, label + 1 as cluster, round(sum(case when u > 0.2 then u else 0 end * x[1]) / nullif(sum(case when u > 0.2 then u else 0 end), 0), 6) as mean from u group by own, label""")
def a17_group_profile(spark, d):
    rows = features(spark, d)
    u = cluster.memberships(rows, [(2.0, 0.0)], [start(rows)]).join(rows.select("id", "label"), "id").withColumn("v", F.get("x", F.lit(0)))
    return cluster.group_profile(u, "v", F.col("u"), 4, ["label"], 0.2).select("label", "cluster", F.round("mean", 6).alias("mean"))


@query("select id, k as dim, round(x[k + 1], 6) as value from fx7_feat, (select unnest(generate_series(0, 63)) as k)")
def u4_long_form(spark, d):
    rows = X.feat(spark, d).select("id", *[F.get("x", F.lit(j)).alias(f"x{j}") for j in range(DIMS)])
    long = rows.unpivot(["id"], [f"x{j}" for j in range(DIMS)], "dim", "value")
    return long.select("id", F.regexp_replace("dim", "x", "").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def cells_of(p):
    return p.select("cell", "q", "r").distinct().select(F.col("cell").alias("hex_id"), "q", "r", grid.center_x(F.col("q"), F.col("r"), 1.0).alias("x"), grid.center_y(F.col("r"), 1.0).alias("y"))


@query()
def c6_spatial_blocks(spark, d):
    return cluster.spatial_blocks(cells_of(X.panel(spark, d)), 4, 1, 10)


def year_rows(spark, d, year=2000):
    return cut(basic.covariates(spark, d).where(f"year = {year}").select("cell", "q", "r", "severity", "history", "pressure", "noise"))


@query(""", c as (select p.cell, p.severity as y, coalesce((select sum(b.severity) from fx4_panel b where b.cell = p.cell and b.year between p.year-5 and p.year-1), 0) as x from fx4_panel p where p.year = 2000),
 s as (select count(*) * 1.0 as n, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) as sse, regr_slope(y, x) as slope, regr_intercept(y, x) as icept, regr_r2(y, x) as r2 from c)
 select round(slope, 6) as slope, round(icept, 6) as intercept, round(r2, 6) as r2, round(n * (ln(2*pi()) + ln(sse/n) + 1) + 6, 4) as aic, round(n * (ln(2*pi()) + ln(sse/n) + 1) + 3*ln(n), 4) as bic from s""")
def m4_ols(spark, d):
    rows = year_rows(spark, d).select(F.lit(1.0).alias("c"), F.col("history").cast("double").alias("x"), F.col("severity").cast("double").alias("y"))
    g, n = models.cross_products(rows, ["c", "x", "y"])
    f = models.least_squares(g, {"c": 0, "x": 1, "y": 2}, {"y": 1.0}, [{"c": 1.0}, {"x": 1.0}], ["c", "x"], n)
    aic, bic, _ = f.criteria()
    total = g[2, 2] - g[0, 2] ** 2 / n
    out = [(round(float(f.beta[1]), 6), round(float(f.beta[0]), 6), round(float(1 - f.sse / total), 6), round(aic, 4), round(bic, 4))]
    return spark.createDataFrame(out, "slope double, intercept double, r2 double, aic double, bic double")


@query()
def m5_m11_compare_models(spark, d):
    rows = year_rows(spark, d)
    t = models.compare_models(rows, basic.edges(rows), "severity", ["history", "noise"], "cell")
    return t.select("model", "status", *[F.round(c, 4).alias(c) for c in ("aic", "bic", "pseudo_r2", "moran_p", "rho", "lambda", "log_lik", "log_det_error")], "n")


PROFILE = tuple(k / 10 for k in range(-8, 9))


@query(""", c as (select p.cell, p.severity * 1.0 as y, coalesce((select sum(b.severity) from fx4_panel b where b.cell = p.cell and b.year between p.year-5 and p.year-1), 0) * 1.0 as x from fx4_panel p where p.year = 2000),
 e0 as (select n.src, n.dst from fx4_nb n join c a on a.cell = n.src join c b on b.cell = n.dst),
 e as (select src, dst, 1.0::double / count(*) over (partition by src) as w from e0),
 powers as (with recursive pw(i, j, k, v) as (select src, dst, 1, w from e union all
   select p.i, e.dst, p.k + 1, sum(p.v * e.w) from pw p join e on e.src = p.j where p.k < 120 group by p.i, e.dst, p.k + 1) select * from pw),
 traces as (select k, sum(v) filter (i = j) as t from powers group by k),
 r as (select unnest(range(-8, 9)) / 10.0::double as rho),
 d as (select rho, -sum(pow(rho, k) * coalesce(t, 0) / k) as log_det from r cross join traces group by rho),
 l as (select c.cell, c.y, c.x, coalesce(sum(e.w * b.y), 0) as wy, coalesce(sum(e.w * b.x), 0) as wx, coalesce(sum(e.w), 0) as wc from c left join e on e.src = c.cell left join c b on b.cell = e.dst group by c.cell, c.y, c.x),
 s as (select rho, count(*) as n, regr_syy(y - rho*wy, x) - pow(regr_sxy(y - rho*wy, x), 2) / regr_sxx(y - rho*wy, x) as lag,
   regr_syy(y - rho*wy, x - rho*wx) - pow(regr_sxy(y - rho*wy, x - rho*wx), 2) / regr_sxx(y - rho*wy, x - rho*wx) as err from r cross join l group by rho)
 select kind as model, cast(round(rho, 1) as double) as rho, round(log_det, 5) + 0.0 as log_det, round(log_det - n/2.0 * (ln(2*pi()) + ln(case kind when 'SAR' then lag else err end / n) + 1), 4) as log_lik
 from s join d using (rho) cross join (select unnest(['SAR', 'SEM']) as kind) k""")
def m6_m7_likelihood_profile(spark, d):
    """Log-likelihoods of the lag and the error model of one covariate over a grid of rho."""
    rows = year_rows(spark, d)
    e = cut(basic.edges(rows))
    det = logdet.determinant(e, rows, "cell", ("q", "r"))
    values, _ = det.compute(PROFILE)
    lags = spatial.spatial_lag(rows.select("cell", F.col("severity").cast("double").alias("y"), F.col("history").cast("double").alias("x")), e, ["y", "x"], "cell", prefix="w")
    linked = e.select(F.col("src").alias("cell")).distinct().withColumn("wc", F.lit(1.0))
    lags = lags.join(linked, "cell", "left").select(F.lit(1.0).alias("c"), F.coalesce("wc", F.lit(0.0)).alias("wc"), "y", "wy", "x", "wx")
    columns = ["c", "wc", "y", "wy", "x", "wx"]
    g, n = models.cross_products(lags, columns)
    index = {c: i for i, c in enumerate(columns)}
    out = []
    for rho, log_det in zip(PROFILE, values, strict=True):
        for model, right in (("SAR", [{"c": 1.0}, {"x": 1.0}]), ("SEM", [{"c": 1.0, "wc": -rho}, {"x": 1.0, "wx": -rho}])):
            f = models.least_squares(g, index, {"y": 1.0, "wy": -rho}, right, ["c", "x"], n)
            out.append((model, rho, round(log_det, 5) + 0.0, round(f.log_lik + log_det, 4)))
    return spark.createDataFrame(out, "model string, rho double, log_det double, log_lik double")


def pairs(spark, d):
    p = basic.covariates(spark, d)
    return panel.transitions(p, "cell", "severity", ["history", "pressure", "noise"]).withColumn("block", F.col("cell") % 4)


@query()
def m2_random_forest(spark, d):
    p = evaluate.split_years(pairs(spark, d), (1995, 1998), (1999, 2000))
    out = models.forest_predict(p.where("split = 'train'"), p.where("split = 'test'"), ["state_t", "pressure", "history"])
    return out.select("cell", "year_t", "state_t1", "predicted")


def full_pairs(spark, d):
    """Pairs with all covariates, and the block of a fold."""
    return cut(pairs(spark, d)), ["history", "pressure", "noise"]


@query()
def m3_m18_m19_evaluation(spark, d):
    p, names = full_pairs(spark, d)
    return report.evaluate_models(p, (1995, 1998), (1999, 2000), 4, report.registry(names, 4))["summary"]


def markov_tables(spark, d):
    return report.evaluate_models(X.pairs(spark, d), (1995, 1998), (1999, 2000), 4, {"Markov": report.registry([], 4)["Markov"]})


@query(basic.CV + " select 'Markov' as model, block, round(kappa, 3) as kappa from kb")
def m18_per_block(spark, d):
    return markov_tables(spark, d)["per_block"]


STATES = basic.RULE + ", m as (select s, (select count(*) from pr where state_t1 = s) as o, (select count(*) from pr where predicted = s) as p, (select count(*) from pr where state_t1 = s and predicted = s) as d, (select count(*) * 1.0 from pr) as n from st)"


@query(STATES + " select 'Markov' as model, s as state, round(d * 1.0 / nullif(p, 0), 3) as precision, round(d * 1.0 / nullif(o, 0), 3) as recall, case when d > 0 then round(2.0 * d / (p + o), 3) end as f1, o as support from m")
def m18_a25_classes(spark, d):
    return markov_tables(spark, d)["classes"]


@query(STATES + """, t as (select sum(d) / max(n) as p, sum(o * p) / max(n) / max(n) as k, sum(least(o, p)) / max(n) as m from m)
 select 'Markov' as model, round((p-k)/nullif(1-k, 0), 3) as kappa, round((p-k)/nullif(m-k, 0), 3) as k_location, round((m-k)/nullif(1-k, 0), 3) as k_quantity from t""")
def m18_m19_a25_pontius(spark, d):
    return markov_tables(spark, d)["pontius"]


@query(basic.RULE + """ select 'Markov' as model, a.s as observed, b.s as predicted, count(pr.hex_id) as n, coalesce(round(100.0 * count(pr.hex_id) / nullif(sum(count(pr.hex_id)) over (partition by a.s), 0), 1), 0) as pct
 from (select unnest([0,1,2,3]) as s) a cross join (select unnest([0,1,2,3]) as s) b left join pr on pr.state_t1 = a.s and pr.predicted = b.s group by a.s, b.s""")
def m18_a25_confusion(spark, d):
    return markov_tables(spark, d)["confusion"]


@query()
def a25_m22_quick_comparison(spark, d):
    p, names = full_pairs(spark, d)
    return report.quick_comparison(p, (1995, 1998), (1999, 2000), report.registry(names, 4))


@query(""", c as (select p.cell, p.severity as y, coalesce((select sum(b.severity) from fx4_panel b where b.cell = p.cell and b.year between p.year-5 and p.year-1), 0) * 1.0 as u, ((p.cell*7919+p.year*104729)%1009) * 1.0 as v from fx4_panel p where p.year = 2000),
 s as (select count(*) * 1.0 as n, covar_pop(y, u) as yu, covar_pop(y, v) as yv, covar_pop(u, v) as uv, var_pop(u) as uu, var_pop(v) as vv, var_pop(y) as yy from c),
 r as (select n, n * (yy - (yu * (yu*vv - yv*uv) + yv * (yv*uu - yu*uv)) / (uu*vv - uv*uv)) as sse, yy from s)
 select 'OLS' as model, 'ok' as status, round(n * (ln(2*pi()) + ln(sse/n) + 1) + 8, 4) as aic, round(n * (ln(2*pi()) + ln(sse/n) + 1) + 4*ln(n), 4) as bic, round(1 - sse / (n * yy), 4) as pseudo_r2, round(-n/2 * (ln(2*pi()) + ln(sse/n) + 1), 4) as log_lik, cast(n as bigint) as n from r""")
def m22_m11_cross_section(spark, d):
    """The regressions of one year, from a panel that is cached where it is not yet; the OLS row has a closed form."""
    path = f"{folder(spark)}/panel-{uuid.uuid4().hex}"
    regions = ["all"]
    for _ in range(2):  # built, then from the cache
        p, groups = report.panel_for_models(spark, path, regions, 10000.0, lambda: build_and_cache(spark, d, path, regions))
    t = report.cross_section(p, basic.edges(p.where("year = 2000")), 2000, sorted(c for c, g in groups.items() if "group2" in g), key="cell")
    return t.where("model = 'OLS'").select("model", "status", *[F.round(c, 4).alias(c) for c in ("aic", "bic", "pseudo_r2", "log_lik")], "n")


def build_and_cache(spark, d, path, regions):
    groups = {"history": ["group1", "group2"], "noise": ["group1", "group2"], "pressure": ["group1"]}
    io.write_panel(basic.covariates(spark, d).select("cell", "year", "q", "r", "severity", *groups), path, regions, 10000.0, groups)
    return io.cached_panel(spark, path, regions, 10000.0)


@query(""", p as (select c.cell, y.year, coalesce(p.severity, 0) as severity from fx4_cells c cross join (select distinct year from fx4_panel) y left join fx4_panel p on p.cell = c.cell and p.year = y.year)
 select p.cell as hex_id, p.year, p.severity, cast(coalesce((select sum(b.severity) from p b where b.cell = p.cell and b.year between p.year-5 and p.year-1), 0) as bigint) as history,
 round(coalesce((select avg(case when b.severity > 0 then 1.0 else 0.0 end) from fx4_nb e join p b on b.cell = e.dst and b.year = p.year where e.src = p.cell), 0), 3) as pressure,
 (select round(min(sqrt(pow((u.q + u.r/2.0) - (v.q + v.r/2.0), 2) + pow(sqrt(3.0)/2*(u.r - v.r), 2))), 3) from p b join fx4_cells v on v.cell = b.cell join fx4_cells u on u.cell = p.cell where b.year = p.year - 1 and b.severity >= 1) as distance from p""")
def m21_build_panel(spark, d):
    p = X.panel(spark, d).withColumnRenamed("cell", "hex_id")
    cells = cells_of(p.withColumnRenamed("hex_id", "cell"))
    e = grid.neighbours(cells)
    items = {
        "history": lambda full: panel.history(full, 5),
        "pressure": lambda full: spatial.pressure(full, e, state="severity"),
        "distance": lambda full: panel.nearest_active(cells, full, 1, 1.5).withColumn("distance", F.round("distance", 3)),
    }
    return report.build_panel(cells, p, items)


@query(basic.CV + """, ru2 as (select s as state_t, coalesce((select tr.state_t1 from tr where tr.state_t = s group by tr.state_t1 order by count(*) desc, tr.state_t1 limit 1), 0) as predicted from st),
 p2 as (select te.*, ru2.predicted from te join ru2 on te.state_t = ru2.state_t)
 select 'spatial' as kind, cast(block as varchar) as fold, round(kappa, 3) as kappa from kb union all
 select 'temporal', 'all', round(1 - sum(pow(predicted - state_t1, 2)) / nullif(sum(state_t1*state_t1) + sum(predicted*predicted) - 2.0 * sum(state_t1) * sum(predicted) / count(*), 0), 3) from p2""")
def u5_kappa_long(spark, d):
    train, test = basic.split(spark, d)
    cv = evaluate.scores(evaluate.markov_block_cv(train, 4), "state_t1", "predicted", ["block"])
    last = evaluate.scores(evaluate.markov_predict(train, test, 4), "state_t1", "predicted")
    return cv.select(F.lit("spatial").alias("kind"), F.col("block").cast("string").alias("fold"), "kappa").unionAll(last.select(F.lit("temporal"), F.lit("all"), "kappa"))
