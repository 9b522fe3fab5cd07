"""Queries over points, hexes and the panel, each with the SQL that gives the same rows another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import assoc, evaluate, farfield, grid, hexagg, panel, spatial
from ..sources.scratch import cut
from . import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}
WIDTH = 5000.0


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = X.sql(sql) if "fx" in sql else sql
        return f

    return put


def edges(p):
    """Equal weights between side neighbours, over the cells that the panel has."""
    return grid.neighbours(p.select("cell", "q", "r").distinct(), "cell")


# ---- labels and codes


@query("""select patch_id, case ia when 1 then 'Léger' when 2 then 'Modéré' when 3 then 'Grave' end as level,
 case trim(level_raw) when 'Leger' then 'Léger' else trim(level_raw) end as canon,
 case level_raw when 'Leger' then 1 when 'Grave' then 3 else null end as as_int,
 list_position(['Léger','Modéré','Grave'], case trim(level_raw) when 'Leger' then 'Léger' else trim(level_raw) end) as sev from fx2_patch""")
def p1_p2_p3_p5_labels(spark, d):
    p = X.patch(spark, d)
    canon = L.normalize_intensity(F.col("level_raw"))
    return p.select("patch_id", L.code_to_label(F.col("ia")).alias("level"), canon.alias("canon"), L.label_to_int(F.col("level_raw")).alias("as_int"), L.severity_rank(canon).alias("sev"))


@query("""select geocode, cl_age, case cl_age when '10' then 10.0 when '3050' then 30.0 when '120' then 120.0 when 'JIN' then 30.0
 when 'VIR' then 90.0 when '7090' then 70.0 end::double as age from fx5_stand""")
def p4_age_class(spark, d):
    return X.stand(spark, d).select("geocode", "cl_age", L.parse_age_class(F.col("cl_age")).alias("age"))


@query("""select hex_id, year_t, case when state_t = state_t1 then 'Correct' when state_t > state_t1 then 'Surestimation' else 'Sous-estimation' end as error,
 abs(state_t - state_t1) as size, case when state_t > state_t1 then '+' else '' end || cast(state_t - state_t1 as varchar) as gap from fx6_pairs""")
def p10_error_class(spark, d):
    gap = F.col("state_t") - F.col("state_t1")
    return X.pairs(spark, d).select("hex_id", "year_t", L.error_class(F.col("state_t1"), F.col("state_t")).alias("error"), F.abs(gap).alias("size"), L.gap_label(gap).alias("gap"))


@query("""select g as gap, case when g > 0 then '+' else '' end || cast(g as varchar) as label from
 (select unnest(generate_series(-m, m)) as g from (select cast(max(abs(state_t - state_t1)) as int) as m from fx6_pairs))""")
def p11_gap_domain(spark, d):
    return evaluate.gap_domain(X.pairs(spark, d), "state_t1", "state_t").select(F.col("gap").cast("long").alias("gap"), "label")


@query("""select cell, year, round((severity - avg(severity) over (partition by year)) / nullif(stddev_samp(severity) over (partition by year), 0), 6) as z,
 round(severity / 3.0, 6) as scaled, round((severity - avg(severity) over ()) / (stddev_samp(severity) over () + 1e-6), 6) as channel from fx4_panel""")
def p15_p16_standardise(spark, d):
    p = spatial.scale_channel(spatial.z_scores(X.panel(spark, d), "severity", ["year"]), "severity")
    return p.select("cell", "year", F.round("z", 6).alias("z"), F.round(F.col("severity") / 3.0, 6).alias("scaled"), F.round("scaled", 6).alias("channel"))


@query("""select site_id, lower(regexp_replace(lower(region), '[^a-z0-9]+', '_', 'g')) as slug, regexp_replace('z_' || site_id, '[^0-9]+', '', 'g') as digits,
 case when abs(value)/10000 <= 0.1 then 'négligeable' when abs(value)/10000 <= 0.3 then 'faible' when abs(value)/10000 <= 0.5 then 'modérée' else 'forte' end as strength
 from fx1_site""")
def p9_p19_text_rules(spark, d):
    return X.site(spark, d).select(
        "site_id", L.slug(F.col("region")).alias("slug"), L.digits(F.concat(F.lit("z_"), F.col("site_id").cast("string"))).alias("digits"), L.strength_label(F.abs("value") / 10000).alias("strength")
    )


@query("""select site_id, round(case when value = 0 then 0 else round(value * pow(10, 2 - floor(log10(abs(value))))) / pow(10, 2 - floor(log10(abs(value)))) end, 6) as sig,
 round(value, 1) as rounded from fx1_site""")
def p18_rounding(spark, d):
    return X.site(spark, d).select("site_id", F.round(L.significant(F.col("value")), 6).alias("sig"), F.round("value", 1).alias("rounded"))


@query("select distinct coalesce(type_couv, 'none') as cover from fx5_stand order by 1")
def p17_levels(spark, d):
    return X.stand(spark, d).select(F.coalesce("type_couv", F.lit("none")).alias("cover")).distinct().orderBy("cover")


@query("select cell, year, severity from fx4_panel where year = 1996")
def p6_year_filter(spark, d):
    return X.panel(spark, d).where("year = 1996").select("cell", "year", "severity")


@query("select geocode, type_couv from fx5_stand where type_couv is not null and cl_age is not null")
def p7_complete_cases(spark, d):
    return X.stand(spark, d).dropna(subset=["type_couv", "cl_age"]).select("geocode", "type_couv")


@query("""select hex_id, case when least(1, sum(piece_area)/20000.0) >= 0.25 then count(*) end as kept from fx5_stand group by hex_id""")
def p14_coverage_gate(spark, d):
    g = X.stand(spark, d).groupBy("hex_id").agg(F.least(F.lit(1.0), F.sum("piece_area") / 20000.0).alias("cov"), F.count("*").alias("n"))
    return g.select("hex_id", L.covered(F.col("n"), F.col("cov")).alias("kept"))


# ---- hexes


@query(f"""select site_id, arg_min(q, d) as q, arg_min(r, d) as r from (
 select site_id, q, r, pow(x - {WIDTH}*(q + r/2.0), 2) + pow(y - {WIDTH}*sqrt(3.0)/2*r, 2) as d
 from (select s.site_id, s.x, s.y, cast(round(s.y/({WIDTH}*sqrt(3.0)/2)) as int) + dr as r,
  cast(round(s.x/{WIDTH} - (round(s.y/({WIDTH}*sqrt(3.0)/2)) + dr)/2.0) as int) + dq as q
  from fx1_site s, (select unnest([-2,-1,0,1,2]) as dr), (select unnest([-2,-1,0,1,2]) as dq))) group by site_id""")
def j2_point_to_hex(spark, d):
    return grid.assign_hex(X.site(spark, d), WIDTH).select("site_id", "q", "r")


@query("select src, dst, round(1.0 / count(*) over (partition by src), 6) as w from fx4_nb")
def j9_contiguity(spark, d):
    return edges(X.panel(spark, d)).select("src", "dst", F.round("w", 6).alias("w"))


@query("""select src, dst, round(w / sum(w) over (partition by src), 6) as w, round(w * w / sum(w * w) over (partition by src), 6) as w2
 from (select a.site_id as src, b.site_id as dst, 1 / sqrt(pow(a.x-b.x,2) + pow(a.y-b.y,2)) as w from fx1_site a join fx1_site b
  on a.site_id <> b.site_id and pow(a.x-b.x,2) + pow(a.y-b.y,2) <= 4000000.0)""")
def j10_inverse_distance(spark, d):
    e = grid.inverse_distances(X.site(spark, d), 2000.0, (1, 2), "site_id")
    return e.select("src", "dst", F.round("w_1", 6).alias("w"), F.round("w_2", 6).alias("w2"))


@query(f"""select c.cell, coalesce(n, 0) as n, coalesce(v, -1.0) as value from (select cast(i as int) * 100 + cast(j as int) as cell, i, j from
 (select unnest(generate_series(0, 9)) as i), (select unnest(generate_series(0, 5)) as j)) c left join
 (select floor(x/10000)*100 + floor(y/10000) as cell, count(*) as n, round(max(value), 2) as v from fx1_site where category = 'BUILDING' group by 1) s on c.cell = s.cell""")
def j19_lattice_fill(spark, d):
    cells = spark.range(10).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    cells = cells.select((F.col("i") * 100 + F.col("j")).cast("int").alias("cell"))
    s = X.site(spark, d).where("category = 'BUILDING'")
    s = s.groupBy((F.floor(F.col("x") / 10000) * 100 + F.floor(F.col("y") / 10000)).cast("int").alias("cell")).agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("v"))
    return cells.join(s, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(-1.0)).alias("value"))


# ---- weighted aggregation


@query("""select hex_id, round(case when half <= c0 then x0 when half >= c1 then x1 else b end, 6) as median from (
 select hex_id, any_value(half) as half, min(c) as c0, max(c) as c1, min(x) as x0, max(x) as x1,
  max(case when pc < half and c >= half then px + (x-px)*(half-pc)/(c-pc) end) as b from (
  select *, lag(x) over w as px, lag(c) over w as pc from (
   select hex_id, cast(geocode % 50 as double) as x, geocode, sum(piece_area) over (partition by hex_id order by geocode % 50, geocode rows unbounded preceding) - piece_area/2 as c,
    sum(piece_area) over (partition by hex_id)/2 as half from fx5_stand) window w as (partition by hex_id order by x, geocode)) group by hex_id)""")
def a1_weighted_median(spark, d):
    s = X.stand(spark, d).withColumn("v", (F.col("geocode") % 50).cast("double"))
    return hexagg.weighted_median(s, ["hex_id"], "v", "piece_area", "median", "geocode").select("hex_id", F.round("median", 6).alias("median"))


@query("""select hex_id, type_couv from (select hex_id, type_couv, row_number() over (partition by hex_id order by sum(piece_area) desc, type_couv) as rn
 from fx5_stand where type_couv is not null group by hex_id, type_couv) where rn = 1""")
def a2_weighted_mode(spark, d):
    return hexagg.weighted_mode(X.stand(spark, d), ["hex_id"], "type_couv", F.col("piece_area"), "type_couv")


@query("select hex_id, round(sum(piece_area)/50000.0, 6) as coverage from fx5_stand group by hex_id")
def a3_coverage(spark, d):
    return hexagg.coverage(X.stand(spark, d), ["hex_id"], "piece_area", 50000.0).select("hex_id", F.round("coverage", 6).alias("coverage"))


@query("""with_ as (select 1), h as (select geocode, least(1, sum(st_ess_pc)/100.0) as f from fx5_essence where essence in ('SB','EN') group by geocode)
 select s.hex_id, round(sum(piece_area * coalesce(f, 0)) / sum(piece_area), 6) as prop_hote from fx5_stand s left join h on s.geocode = h.geocode
 where type_couv in ('R','M') group by s.hex_id""".replace("with_ as (select 1), ", ", "))
def j16_a9_host_share(spark, d):
    host = X.essence(spark, d).where(F.col("essence").isin("SB", "EN")).groupBy("geocode").agg(F.sum("st_ess_pc").alias("pc"))
    s = X.stand(spark, d).join(host, "geocode", "left").withColumn("f", F.least(F.lit(1.0), F.coalesce("pc", F.lit(0)) / 100.0))
    out = hexagg.ratio_of_sums(s, ["hex_id"], F.col("f"), F.col("piece_area"), F.col("type_couv").isin("R", "M"), "prop_hote")
    return out.select("hex_id", F.round("prop_hote", 6).alias("prop_hote"))


@query("select e.geocode, e.essence, e.st_ess_pc from fx5_essence e where exists (select 1 from fx5_stand s where s.geocode = e.geocode and s.type_couv = 'R')")
def j14_semi_join(spark, d):
    keep = X.stand(spark, d).where("type_couv = 'R'").select("geocode")
    return X.essence(spark, d).join(keep, "geocode", "left_semi").select("geocode", "essence", "st_ess_pc")


# ---- panel


@query("""select p.cell, p.year, cast(coalesce(sum(b.severity), 0) as bigint) as history from fx4_panel p left join fx4_panel b
 on p.cell = b.cell and b.year between p.year - 5 and p.year - 1 group by p.cell, p.year""")
def w1_history(spark, d):
    return panel.history(X.panel(spark, d), 5, "cell").select("cell", "year", "history")


@query("""select p.cell, p.year, round(min(sqrt(pow(10000.0*((p.q + p.r/2.0) - (b.q + b.r/2.0)), 2) + pow(10000.0*sqrt(3.0)/2*(p.r - b.r), 2))), 3) as distance
 from fx4_panel p left join fx4_panel b on b.year = p.year - 1 and b.severity >= 3 group by p.cell, p.year""")
def j11_nearest_focus(spark, d):
    p = X.panel(spark, d)
    at = p.select("cell", "q", "r").distinct().select("cell", grid.center_x(F.col("q"), F.col("r"), 10000.0).alias("x"), grid.center_y(F.col("r"), 10000.0).alias("y"))
    return panel.nearest_active(at, p, 3, 10000.0, "cell").select("cell", "year", F.round("distance", 3).alias("distance"))


@query("""select c.cell, y.year, coalesce(p.severity, 0) as severity, case coalesce(p.severity, 0) when 0 then 'Aucun' when 1 then 'Léger' when 2 then 'Modéré' else 'Grave' end as target
 from fx4_cells c cross join (select distinct year from fx4_panel) y left join fx4_panel p on p.cell = c.cell and p.year = y.year""")
def a7_complete_panel(spark, d):
    p = X.panel(spark, d)
    full = panel.complete_panel(p.select("cell").distinct(), p.select("year"), p, "cell")
    return full.select("cell", "year", "severity", L.severity_label(F.col("severity")).alias("target"))


@query("""select cell, """ + ", ".join(f"cast(coalesce(max(case when year = {y} then severity end), 0) as int) as y{y}" for y in range(1995, 2002)) + " from fx4_panel group by cell")
def a8_a12_wide(spark, d):
    w = panel.wide(X.panel(spark, d), range(1995, 2002), "cell")
    return w.select("cell", *[F.col(str(y)).alias(f"y{y}") for y in range(1995, 2002)])


@query(""", g as (select * from fx4_panel where year <> 1998), y as (select year, lead(year) over (order by year) as ny from (select distinct year from g))
 select a.cell, a.year as year_t, a.severity as state_t, b.severity as state_t1 from g a join y on a.year = y.year join g b on b.cell = a.cell and b.year = y.ny""")
def w2_j15_transitions(spark, d):
    return panel.transitions(X.panel(spark, d).where("year <> 1998"), "cell", "severity")


@query(""", g as (select * from fx4_panel where year <> 1998), y as (select unnest(generate_series((select min(year) from g), (select max(year) from g))) as year),
 s as (select y.year, coalesce((select max(year) from g where g.year <= y.year), (select min(year) from g)) as sy from y)
 select c.cell, cast(s.year as int) as year, coalesce(g.severity, 0) as severity from s cross join (select distinct cell from g) c left join g on g.cell = c.cell and g.year = s.sy""")
def w3_densify(spark, d):
    g = X.panel(spark, d).where("year <> 1998")
    return panel.densify(g, g.select("cell").distinct(), "cell").select("cell", "year", "severity")


@query(""", s as (select c.cell, y.year, coalesce(p.severity, 0) as severity from fx4_cells c cross join (select distinct year from fx4_panel) y left join fx4_panel p on p.cell = c.cell and p.year = y.year)
 select t.cell, t.year as target_year, a.severity || ',' || b.severity || ',' || c.severity as seq, t.severity as target from s t
 join s a on a.cell = t.cell and a.year = t.year - 3 join s b on b.cell = t.cell and b.year = t.year - 2 join s c on c.cell = t.cell and c.year = t.year - 1""")
def w4_sequences(spark, d):
    p = X.panel(spark, d)
    dense = panel.densify(p, p.select("cell").distinct(), "cell")
    s = panel.sequences(dense, [F.col("severity")], 3, "cell")
    return s.select("cell", "target_year", F.array_join(F.transform("sequence", lambda v: v.cast("int")), ",").alias("seq"), "target")


@query("""select cell_id, season, round(min(value), 3) as minimum from (select cell_id, cast(year(date) + case when month(date) = 12 then 1 else 0 end as int) as season, value
 from fx3_cell_daily where month(date) in (12, 1, 2)) group by 1, 2""")
def s7_a11_winter_minimum(spark, d):
    return panel.winter_minimum(X.cell_daily(spark, d)).select("cell_id", "season", F.round("minimum", 3).alias("minimum"))


@query("""select hex_id, severity from (select cast(q * 1000 + r as bigint) as hex_id, ia as severity, row_number() over (partition by q, r order by count(*) desc, ia) as n from
 (select floor(xmin/8000) as q, floor(ymin/8000) as r, ia from fx2_patch) group by q, r, ia) where n = 1""")
def a27_majority(spark, d):
    cells = X.patch(spark, d).select((F.floor(F.col("xmin") / 8000) * 1000 + F.floor(F.col("ymin") / 8000)).alias("hex_id"), F.col("ia").alias("state"))
    return hexagg.weighted_mode(cells, ["hex_id"], "state", F.lit(1.0), "severity").select("hex_id", "severity")


@query("""select cell, 'both' as kind from (select cell from fx4_panel where year = 1996 and severity >= 2 intersect select cell from fx4_panel where year = 1997 and severity >= 2)
 union all select cell, 'first' from (select cell from fx4_panel where year = 1996 and severity >= 2 except select cell from fx4_panel where year = 1997 and severity >= 2)""")
def u3_set_operations(spark, d):
    p = X.panel(spark, d).where("severity >= 2")
    a, b = p.where("year = 1996").select("cell"), p.where("year = 1997").select("cell")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionAll(a.exceptAll(b).withColumn("kind", F.lit("first")))


@query("""select p.cell, p.year, p.severity, p.q as static_q, cast(coalesce((select sum(b.severity) from fx4_panel b where b.cell = p.cell and b.year between p.year - 3 and p.year - 1), 0) as bigint) as history from fx4_panel p""")
def j12_j17_t3_covariates(spark, d):
    p = X.panel(spark, d)
    static = p.groupBy("cell").agg(F.first("q").alias("static_q"))
    yearly = panel.history(p, 3, "cell").select("cell", "year", "history")
    return panel.with_covariates(p.select("cell", "year", "severity"), [static], [yearly], "cell").orderBy("year", "cell")


@query("""select f.block, count(*) as pairs, count(*) filter (state_t1 > 0) as infested from fx6_pairs p join (select distinct hex_id, block from fx6_pairs) f on f.hex_id = p.hex_id group by f.block""")
def j18_fold_lookup(spark, d):
    p = X.pairs(spark, d)
    folds = p.select("hex_id", "block").distinct()
    return p.drop("block").join(folds, "hex_id").groupBy("block").agg(F.count("*").alias("pairs"), F.count_if(F.col("state_t1") > 0).alias("infested"))


@query("""select region, n, total from (select region, count(*) as n, round(sum(value), 2) as total from fx1_site group by region) order by total desc, region limit 5""")
def t1_t4_ranking_head(spark, d):
    return X.site(spark, d).groupBy("region").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).orderBy(F.desc("total"), "region").limit(5)


# ---- forecasts and scores

PAIRS = ", tr as (select * from fx6_pairs where year_t between 1995 and 1998), te as (select * from fx6_pairs where year_t between 1999 and 2000), st as (select unnest([0,1,2,3]) as s)"


def split(spark, d):
    p = evaluate.split_years(X.pairs(spark, d), (1995, 1998), (1999, 2000))
    return p.where("split = 'train'").drop("split"), p.where("split = 'test'").drop("split")


@query("select hex_id, year_t, case when year_t <= 1996 then 'train' when year_t = 1998 then 'valid' when year_t >= 1999 then 'test' end as split from fx6_pairs")
def w7_split(spark, d):
    return evaluate.split_years(X.pairs(spark, d), (1995, 1996), (1999, 2000), (1998, 1998)).select("hex_id", "year_t", "split")


@query(PAIRS + """ select a.s as state_t, b.s as state_t1, count(tr.hex_id) as n, round((count(tr.hex_id) + 1e-9) / (sum(count(tr.hex_id) + 1e-9) over (partition by a.s)), 6) as p
 from st a cross join st b left join tr on tr.state_t = a.s and tr.state_t1 = b.s group by a.s, b.s""")
def a19_transition_matrix(spark, d):
    train, _ = split(spark, d)
    m = evaluate.transition_matrix(evaluate.transition_counts(train, 4))
    return m.select("state_t", "state_t1", "n", F.round("p", 6).alias("p"))


RULE = PAIRS + ", ru as (select s as state_t, coalesce((select tr.state_t1 from tr where tr.state_t = s group by tr.state_t1 order by count(*) desc, tr.state_t1 limit 1), 0) as predicted from st), pr as (select te.*, ru.predicted from te join ru on te.state_t = ru.state_t)"


@query(RULE + " select hex_id, year_t, state_t1, predicted from pr")
def m1_t2_markov(spark, d):
    train, test = split(spark, d)
    return evaluate.markov_predict(train, test, 4).select("hex_id", "year_t", "state_t1", "predicted")


@query("""select a.s as observed, b.s as predicted, count(f.hex_id) as n, coalesce(round(100.0 * count(f.hex_id) / nullif(sum(count(f.hex_id)) over (partition by a.s), 0), 1), 0) as pct
 from (select unnest([0,1,2,3]) as s) a cross join (select unnest([0,1,2,3]) as s) b left join fx6_pairs f on f.state_t1 = a.s and f.state_t = b.s group by a.s, b.s""")
def a20_u6_confusion(spark, d):
    return evaluate.confusion(X.pairs(spark, d), "state_t1", "state_t", 4)


KAPPA = "1 - (select sum(pow(o.s-p.s, 2) * (select count(*) from {t} where {o} = o.s and {p} = p.s)) from st o, st p) / (select sum(pow(o.s-p.s, 2) * (select count(*) from {t} where {o} = o.s) * (select count(*) from {t} where {p} = p.s)) from st o, st p) * (select count(*) from {t})"


@query(PAIRS + f""" select round(avg(case when state_t = state_t1 then 1.0 else 0.0 end), 3) as accuracy, round({KAPPA.format(t='fx6_pairs', o='state_t1', p='state_t')}, 3) as kappa,
 round(sqrt(avg(pow(state_t - state_t1, 2))), 3) as rmse, count(*) as n from fx6_pairs""")
def a21_a24_scores(spark, d):
    return evaluate.scores(X.pairs(spark, d), "state_t1", "state_t")


@query(RULE + f""" select round(avg(case when predicted = state_t1 then 1.0 else 0.0 end), 3) as accuracy, round({KAPPA.format(t='pr', o='state_t1', p='predicted')}, 3) as kappa,
 round(sqrt(avg(pow(predicted - state_t1, 2))), 3) as rmse, count(*) as n from pr""")
def m17_temporal_holdout(spark, d):
    train, test = split(spark, d)
    return evaluate.scores(evaluate.markov_predict(train, test, 4), "state_t1", "predicted")


@query("""select s as state, round(tp * 1.0 / nullif(np, 0), 3) as precision, round(tp * 1.0 / nullif(no, 0), 3) as recall, round(2.0 * tp / nullif(np + no, 0) * case when tp = 0 then null else 1 end, 3) as f1, no as support from (
 select s, (select count(*) from fx6_pairs where state_t1 = s and state_t = s) as tp, (select count(*) from fx6_pairs where state_t = s) as np, (select count(*) from fx6_pairs where state_t1 = s) as no
 from (select unnest([0,1,2,3]) as s))""")
def a22_class_metrics(spark, d):
    return evaluate.class_metrics(X.pairs(spark, d), "state_t1", "state_t", 4)


@query(""", m as (select s, (select count(*) from fx6_pairs where state_t1 = s) / (select count(*) * 1.0 from fx6_pairs) as r, (select count(*) from fx6_pairs where state_t = s) / (select count(*) * 1.0 from fx6_pairs) as c,
  (select count(*) from fx6_pairs where state_t = s and state_t1 = s) / (select count(*) * 1.0 from fx6_pairs) as d from (select unnest([0,1,2,3]) as s)), t as (select sum(d) as p, sum(r*c) as k, sum(least(r,c)) as m from m)
 select round((p-k)/(1-k), 3) as kappa, round((p-k)/(m-k), 3) as k_location, round((m-k)/(1-k), 3) as k_quantity from t""")
def a23_pontius(spark, d):
    return evaluate.pontius(X.pairs(spark, d), "state_t1", "state_t", 4)


CV = PAIRS + """, k as (select distinct block from tr), ru as (select block, s as state_t, coalesce((select tr.state_t1 from tr where tr.state_t = s and tr.block <> k.block group by tr.state_t1 order by count(*) desc, tr.state_t1 limit 1), 0) as predicted from k, st),
 pr as (select tr.*, ru.predicted from tr join ru on tr.state_t = ru.state_t and tr.block = ru.block),
 kb as (select block, 1 - sum(pow(predicted - state_t1, 2)) / nullif(sum(state_t1*state_t1) + sum(predicted*predicted) - 2.0 * sum(state_t1) * sum(predicted) / count(*), 0) as kappa from pr group by block)"""


@query(CV + " select block, round(kappa, 3) as kappa from kb")
def m16_block_cv(spark, d):
    train, _ = split(spark, d)
    return evaluate.scores(evaluate.markov_block_cv(train, 4), "state_t1", "predicted", ["block"]).select("block", "kappa")


@query(CV + " select round(avg(round(kappa, 3)), 3) as mean, round(stddev_samp(round(kappa, 3)), 3) as sd from kb")
def a26_fold_summary(spark, d):
    train, _ = split(spark, d)
    return evaluate.fold_summary(evaluate.scores(evaluate.markov_block_cv(train, 4), "state_t1", "predicted", ["block"]))


@query("select year, count(*) filter (severity > 0) as infested from fx4_panel group by year order by 2 desc, 1 limit 1")
def a18_worst_year(spark, d):
    return evaluate.worst_year(X.panel(spark, d), "severity")


@query(RULE + """ select hex_id, year_t, state_t1 as observed, predicted, case when predicted = state_t1 then 'Correct' when predicted > state_t1 then 'Surestimation' else 'Sous-estimation' end as error,
 abs(predicted - state_t1) as size, case when predicted > state_t1 then '+' else '' end || cast(predicted - state_t1 as varchar) as gap from pr
 where year_t = (select year_t from pr group by year_t order by count(*) filter (state_t1 > 0) desc, year_t limit 1)""")
def m20_territory(spark, d):
    train, test = split(spark, d)
    return evaluate.territory(evaluate.markov_predict(train, test, 4))


@query(""", c as (select s as state, (select count(*) from fx4_panel where severity = s) as n from (select unnest([0,1,2,3]) as s)), w as (select state, n, (select sum(n) from c) / (4.0 * greatest(n, 1)) as w from c)
 select state, n, round(w / (select avg(w) from w), 6) as weight from w""")
def a28_class_weights(spark, d):
    return evaluate.class_weights(X.panel(spark, d), "severity", 4).select("state", "n", F.round("weight", 6).alias("weight"))


FLAG = 10000.0


@query(f""", hx as (select site_id, arg_min(q, d) as q, arg_min(r, d) as r from (select site_id, q, r, pow(x - {FLAG}*(q + r/2.0), 2) + pow(y - {FLAG}*sqrt(3.0)/2*r, 2) as d
  from (select s.site_id, s.x, s.y, cast(round(s.y/({FLAG}*sqrt(3.0)/2)) as int) + dr as r, cast(round(s.x/{FLAG} - (round(s.y/({FLAG}*sqrt(3.0)/2)) + dr)/2.0) as int) + dq as q
   from fx1_site s, (select unnest([-2,-1,0,1,2]) as dr), (select unnest([-2,-1,0,1,2]) as dq))) group by site_id),
 sums as (select hx.q, hx.r, p.year, p.ia, sum(p.xmax - p.xmin) as w from fx2_patch p join orders o on o.o_orderkey = p.patch_id join hx on hx.site_id = o.o_custkey group by all),
 top as (select q, r, year, arg_max(ia, struct_pack(w := w, ia := -ia)) as ia from sums group by q, r, year),
 cells as (select distinct q, r from hx), years as (select distinct year from fx2_patch),
 p as (select c.q, c.r, y.year, case when (c.q * 13 + c.r * 7 + y.year) % 5 = 0 then 0 else coalesce(ia, 0) end as s from cells c cross join years y left join top t on t.q = c.q and t.r = c.r and t.year = y.year),
 e as (select p.q, p.r, p.year, round(coalesce(avg(case when b.s > 0 then 1.0 else 0.0 end), 0), 3) as pressure from p left join p b on b.year = p.year and abs(b.q-p.q) + abs(b.r-p.r) + abs((b.q-p.q)+(b.r-p.r)) = 2 group by p.q, p.r, p.year),
 pairs as (select a.q, a.r, a.year as year_t, a.s as state_t, b.s as state_t1, pressure from p a join p b on b.q = a.q and b.r = a.r and b.year = a.year + 1 join e on e.q = a.q and e.r = a.r and e.year = a.year),
 st as (select unnest([0,1,2,3]) as s), rule as (select s, coalesce((select state_t1 from pairs where state_t = s and year_t between 1995 and 1998 group by state_t1 order by count(*) desc, state_t1 limit 1), 0) as predicted from st),
 te as (select case when pressure >= 0.75 then 1 else 0 end as surrounded, state_t1 as o, predicted as p from pairs join rule on rule.s = state_t where year_t between 1999 and 2000)
 select surrounded, round(avg(case when o = p then 1.0 else 0.0 end), 3) as accuracy, round(1 - sum(pow(o-p, 2)) / nullif(sum(o*o) + sum(p*p) - 2.0 * sum(o) * sum(p) / count(*), 0), 3) as kappa, round(sqrt(avg(pow(o-p, 2))), 3) as rmse, count(*) as n from te group by surrounded""")
def flagship_forecast(spark, d):
    """Points to hexes, severity of every hex and year by weighted mode, complete panel, neighbour pressure, transitions,
    Markov forecast, and its scores by whether the hex was surrounded."""
    where = grid.assign_hex(X.site(spark, d), FLAG).select("site_id", "q", "r")
    owner = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("patch_id"), F.col("o_custkey").alias("site_id"))
    p = X.patch(spark, d).join(owner, "patch_id").join(where, "site_id").withColumn("hex_id", grid.hex_id(F.col("q"), F.col("r")))
    observed = hexagg.weighted_mode(p, ["hex_id", "year"], "ia", F.col("xmax") - F.col("xmin"), "severity")
    cells = where.select("q", "r").distinct().withColumn("hex_id", grid.hex_id(F.col("q"), F.col("r")))
    full = panel.complete_panel(cells, p.select("year"), observed).join(cells, "hex_id")
    gap = (F.col("q") * 13 + F.col("r") * 7 + F.col("year")) % 5 == 0  # quiet years, so that there is something to forecast
    full = cut(full.withColumn("severity", F.when(gap, 0).otherwise(F.col("severity"))))
    full = spatial.pressure(full, grid.neighbours(cells), state="severity")
    pairs = evaluate.split_years(panel.transitions(full, "hex_id", "severity", ["pressure"]), (1995, 1998), (1999, 2000))
    test = pairs.where("split = 'test'").withColumn("surrounded", (F.col("pressure") >= 0.75).cast("int"))
    got = evaluate.markov_predict(pairs.where("split = 'train'"), test, 4)
    return evaluate.scores(got, "state_t1", "predicted", ["surrounded"])


# ---- spatial statistics


@query("select p.cell, p.year, round(coalesce((select avg(b.severity) from fx4_edges e join fx4_panel b on b.cell = e.dst and b.year = e.year where e.src = p.cell and e.year = p.year), 0), 6) as lag from fx4_panel p where p.year = 1996")
def l1_spatial_lag(spark, d):
    p = X.panel(spark, d).where("year = 1996")
    return spatial.spatial_lag(p, edges(p), ["severity"], "cell").select("cell", "year", F.round("lag_severity", 6).alias("lag"))


@query("select p.cell, p.year, round(coalesce((select avg(case when b.severity > 0 then 1.0 else 0.0 end) from fx4_edges e join fx4_panel b on b.cell = e.dst and b.year = e.year where e.src = p.cell and e.year = p.year), 0), 3) as pressure from fx4_panel p")
def l2_pressure(spark, d):
    p = X.panel(spark, d)
    return spatial.pressure(p, edges(p), "cell", "severity").select("cell", "year", "pressure")


MORAN = """, e as (select src, dst, 1.0 / count(*) over (partition by src) as w from fx4_edges where year = 1996),
 x as (select cell, severity from fx4_panel where year = 1996 and cell in (select src from e)), zz as (select cell, severity - (select avg(severity) from x) as z from x),
 s as (select (select sum(w) from e) as s0, (select sum(pow(a.w + coalesce(b.w, 0), 2)) / 2 from e a left join e b on a.src = b.dst and a.dst = b.src) as s1,
  (select sum(pow(o + i, 2)) from (select src, sum(w) as o from e group by src) u join (select dst, sum(w) as i from e group by dst) v on u.src = v.dst) as s2,
  (select count(*) * 1.0 from zz) as n, (select sum(z*z) from zz) as m2, (select sum(pow(z, 4)) from zz) as m4, (select sum(w * a.z * b.z) from e join zz a on a.cell = e.src join zz b on b.cell = e.dst) as c)"""


@query(MORAN + """ select cast(n as bigint) as n, round(n/s0*c/m2, 6) as moran_i, round(-1/(n-1), 6) as expected,
 round((n*((n*n-3*n+3)*s1-n*s2+3*s0*s0) - n*m4/(m2*m2)*((n*n-n)*s1-2*n*s2+6*s0*s0))/((n-1)*(n-2)*(n-3)*s0*s0) - 1/((n-1)*(n-1)), 8) as variance,
 round((n/s0*c/m2 + 1/(n-1)) / sqrt((n*((n*n-3*n+3)*s1-n*s2+3*s0*s0) - n*m4/(m2*m2)*((n*n-n)*s1-2*n*s2+6*s0*s0))/((n-1)*(n-2)*(n-3)*s0*s0) - 1/((n-1)*(n-1))), 4) as z from s""")
def l3_l8_global_moran(spark, d):
    p = X.panel(spark, d).where("year = 1996")
    m = spatial.global_moran(p, edges(p), "severity", "cell")
    return m.select("n", F.round("moran_i", 6).alias("moran_i"), F.round("expected", 6).alias("expected"), F.round("variance", 8).alias("variance"), F.round("z", 4).alias("z"))


DISTANT = """, g as (select a.cell as src, b.cell as dst, 1 / sqrt(pow((a.q + a.r/2.0) - (b.q + b.r/2.0), 2) + pow(sqrt(3.0)/2*(a.r - b.r), 2)) as w from fx4_panel a join fx4_panel b on a.year = 1996 and b.year = 1996 and a.cell <> b.cell),
 f as (select 1 as p, src, dst, w / sum(w) over (partition by src) as w from g union all select 2, src, dst, w * w / sum(w * w) over (partition by src) from g),
 y as (select cell, severity - (select avg(severity) from fx4_panel where year = 1996) as z from fx4_panel where year = 1996),
 i as (select f.p, (select count(*) from y) * sum(w * a.z * b.z) / sum(w) / (select sum(z * z) from y) as i from f join y a on a.cell = f.src join y b on b.cell = f.dst group by f.p)"""


def weighted(spark, d):
    """The panel of a year, and its four weight tables over all pairs (the cells of 10 km are some 60 at every size)."""
    p = X.panel(spark, d).where("year = 1996")
    at = p.select("cell", "q", "r", grid.center_x(F.col("q"), F.col("r"), 1.0).alias("x"), grid.center_y(F.col("r"), 1.0).alias("y"))
    return p, spatial.weight_tables(at, "cell")


@query(MORAN + DISTANT + """ select unnest(['rook', 'queen']) as weights, round(n/s0*c/m2, 6) as moran_i from s union all
 select case p when 1 then 'inverse_distance' else 'inverse_distance2' end, round(i, 6) from i""")
def l5_compare_weights(spark, d):
    p, tables = weighted(spark, d)
    return spatial.compare_weights(p, tables, "severity", "cell").select("weights", F.round("moran_i", 6).alias("moran_i"))


@query(""", v as (select site_id, x, y, value, value - avg(value) over () as z from fx1_site),
 d as (select a.site_id as i, b.site_id as j, a.z as zi, b.z as zj, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d from v a join v b on a.site_id <> b.site_id),
 k as (select i, j, zi, zj, p, pow(d, -p) as w from d cross join (select unnest([1, 2]) as p) where d > 0),
 w as (select i, j, p, zi, zj, w / sum(w) over (partition by i, p) as w from k),
 c as (select p, sum(w * zi * zj) as c, sum(w) as s0 from w group by p),
 s1 as (select a.p, sum(pow(a.w + b.w, 2)) / 2 as s1 from w a join w b on a.i = b.j and a.j = b.i and a.p = b.p group by a.p),
 o as (select i, p, sum(w) as o from w group by i, p), n_ as (select j, p, sum(w) as n from w group by j, p), s2 as (select o.p, sum(pow(o + n, 2)) as s2 from o join n_ on o.i = n_.j and o.p = n_.p group by o.p),
 m as (select count(*) * 1.0::double as n, sum(z*z) as m2, sum(pow(z, 4)) as m4 from v),
 t as (select c.p, n, n / s0 * c / m2 as i, -1 / (n - 1) as ex, n * m4 / (m2 * m2) as b2, s0, s1, s2 from c join s1 on s1.p = c.p join s2 on s2.p = c.p cross join m),
 r as (select p, n, i, ex, (n * ((n*n - 3*n + 3)*s1 - n*s2 + 3*s0*s0) - b2 * ((n*n - n)*s1 - 2*n*s2 + 6*s0*s0)) / ((n-1)*(n-2)*(n-3)*s0*s0) - ex*ex as var from t)
 select 'inverse_distance' || case p when 2 then '2' else '' end as weights, cast(n as bigint) as n, round(i, 4) + 0.0 as moran_i, round((i - ex) / sqrt(var), 2) as z from r""")
def l5_all_pairs_by_far_field(spark, d):
    """Weights 1 / d and 1 / d² over all pairs of the sites, without a row for each pair."""
    out = None
    for power in (1, 2):
        row = farfield.moran_by_distance(X.site(spark, d), power, 4000.0, 3, key="site_id")
        row = row.select(F.lit(f"inverse_distance{power if power > 1 else ''}").alias("weights"), "n", (F.round("moran_i", 4) + 0.0).alias("moran_i"), F.round("z", 2).alias("z"))
        out = row if out is None else out.unionAll(row)
    return out


@query()
def l5_l4_compare_weights_with_p(spark, d):
    """The same with p from 999 relabellings under each table."""
    p, tables = weighted(spark, d)
    return spatial.compare_weights(p, tables, "severity", "cell", sims=999).select("weights", "moran_i", "p_value")


@query()
def l4_permutation_test(spark, d):
    p = X.panel(spark, d).where("year = 1996")
    return spatial.moran_permutations(p, edges(p), "severity", "cell", sims=999)


@query(MORAN + """ select round(n/s0*c/m2, 6) as moran_i, round(-1/(n-1), 6) as expected,
 round((n*((n*n-3*n+3)*s1-n*s2+3*s0*s0) - n*m4/(m2*m2)*((n*n-n)*s1-2*n*s2+6*s0*s0))/((n-1)*(n-2)*(n-3)*s0*s0) - 1/((n-1)*(n-1)), 8) as variance, true as mean_fits, true as variance_fits, cast(999 as bigint) as sims from s""")
def l4_permuted_moments(spark, d):
    """999 relabellings against the moments that they must have: their mean within four standard errors, their variance
    within a quarter."""
    p = X.panel(spark, d).where("year = 1996")
    e = edges(p)
    i = spatial.permuted_moran(p, e, "severity", "cell")
    got = i.groupBy().agg(F.max(F.when(F.col("sim") == 0, F.col("i"))).alias("real"), F.avg(F.when(F.col("sim") > 0, F.col("i"))).alias("mean"), F.var_samp(F.when(F.col("sim") > 0, F.col("i"))).alias("var"), F.count_if(F.col("sim") > 0).alias("sims"))
    t = got.crossJoin(spatial.global_moran(p, e, "severity", "cell").select("expected", "variance"))  # one row each
    fits = F.abs(F.col("mean") - F.col("expected")) <= 4 * F.sqrt(F.col("variance") / F.col("sims")), F.col("var") / F.col("variance")
    return t.select(F.round("real", 6).alias("moran_i"), F.round("expected", 6).alias("expected"), F.round("variance", 8).alias("variance"), fits[0].alias("mean_fits"), fits[1].between(0.8, 1.25).alias("variance_fits"), "sims")


LISA = """, e as (select a.src, a.dst, p.year, 1.0 / count(*) over (partition by a.src, p.year) as wy, n.k from fx4_nb a join (select src, count(*) as k from fx4_nb group by src) n on n.src = a.src join fx4_panel p on p.cell = a.dst),
 m as (select cell, year, severity as x, severity - avg(severity) over (partition by year) as z, var_pop(severity) over (partition by year) as m2, count(*) over (partition by year) * 1.0 as n from fx4_panel),
 g as (select m.*, coalesce(sum(b.z / e.k), 0) as lz, coalesce(sum(b.x * 1.0 / e.k), 0) as lag, coalesce(sum(1.0 / e.k), 0) as w1, coalesce(sum(1.0 / e.k / e.k), 0) as w2
  from m left join e on e.src = m.cell and e.year = m.year left join m b on b.cell = e.dst and b.year = m.year group by all),
 i as (select cell, year, x, lag, z/m2*lz as ii, -z*z*w1/((n-1)*m2) as ex, pow(z/m2, 2)*(n/(n-2))*(w2-w1*w1/(n-1))*(m2-z*z/(n-1)) as var from g)"""


@query(LISA + " select cell, year, round(lag, 6) as lag, round(ii, 6) as ii, round(ex, 6) as expected, round(var, 6) as variance from i")
def l6_local_moran(spark, d):
    p = X.panel(spark, d)
    t = spatial.local_moran(p, edges(p), "severity", "cell", ["year"])
    return t.select("cell", "year", *[F.round(c, 6).alias(c) for c in ("lag", "ii", "expected", "variance")])


@query(LISA + """ select cell, year, case when var > 0 and abs(ii - ex)/sqrt(case when var > 0 then var end) > 1.959963984540054 then case when x > avg(x) over (partition by year) then 'H' else 'L' end || case when lag > avg(lag) over (partition by year) then 'H' else 'L' end else 'Non sign.' end as lisa from i""")
def l7_lisa(spark, d):
    p = X.panel(spark, d)
    return spatial.lisa_types(p, edges(p), "severity", "cell", ["year"]).select("cell", "year", "lisa")


@query(""", p as (select cell, severity, severity * 1.0 as x from fx4_panel where year = 1996),
 k as (select a, b, exp(-(a*a+b*b)/2.0) as w from (select unnest([-1,0,1]) as a), (select unnest([-1,0,1]) as b))
 select p.cell, round(sum(o.x * k.w) / (select sum(w) from k), 6) as smooth from p cross join k join p o on o.cell = p.cell - 100*k.a - k.b and (o.cell // 100) = (p.cell // 100) - k.a group by p.cell""")
def l9_gaussian(spark, d):
    p = X.panel(spark, d).where("year = 1996").select("cell", F.col("q").alias("i"), F.col("r").alias("j"), F.col("severity").cast("double").alias("v"))
    return spatial.gaussian_focal(p, "v", 1.0, 1).select("cell", F.round("smooth", 6).alias("smooth"))


@query("""select cell, year, round(z, 6) as z, round(coalesce(lag, 0), 6) as lag_z from (select *, (select avg(b.z) from fx4_nb e join (select cell, year, (severity - avg(severity) over (partition by year)) / stddev_samp(severity) over (partition by year) as z from fx4_panel) b on b.cell = e.dst where e.src = p.cell and b.year = p.year)
 * (select count(*) from fx4_nb e join fx4_panel b on b.cell = e.dst and b.year = p.year where e.src = p.cell) / nullif((select count(*) from fx4_nb e where e.src = p.cell), 0) as lag
 from (select cell, year, (severity - avg(severity) over (partition by year)) / stddev_samp(severity) over (partition by year) as z from fx4_panel) p)""")
def w8_z_and_lag(spark, d):
    p = X.panel(spark, d)
    z = spatial.z_scores(p, "severity", ["year"])
    return spatial.spatial_lag(z, edges(p), ["z"], "cell", ["year"]).select("cell", "year", F.round("z", 6).alias("z"), F.round("lag_z", 6).alias("lag_z"))


# ---- association

RANKS = ", v as (select severity, (cell*7919+year*104729)%1009 as noise, year as y from fx4_panel), k as (select *, rank() over (order by noise) + (count(*) over (partition by noise) - 1) / 2.0 as rn, rank() over (order by severity) + (count(*) over (partition by severity) - 1) / 2.0 as rs from v)"


def covariates(spark, d):
    p = X.panel(spark, d)
    h = panel.history(p, 5, "cell")
    h = spatial.pressure(h, edges(p), "cell", "severity")
    return h.withColumn("noise", (F.col("cell") * 7919 + F.col("year") * 104729) % 1009)


@query(RANKS + " select noise, severity, rn as rank_noise, rs as rank_severity from k")
def w5_average_ranks(spark, d):
    v = covariates(spark, d).select("noise", "severity")
    r = assoc.average_ranks(assoc.average_ranks(v, "noise", "rank_noise"), "severity", "rank_severity")
    return r.select("noise", "severity", "rank_noise", "rank_severity")


@query(RANKS + """, s as (select sum(g) as q, sum(n) * 1.0 as n from (select pow(sum(rn), 2) / count(*) as g, count(*) as n from k group by severity)), t as (select sum(pow(c, 3) - c) as ties from (select count(*) as c from k group by noise))
 select (select count(*) from k) as n, round((select corr(rn, rs) from k), 6) as rho, round((12/(n*(n+1))*q - 3*(n+1)) / (1 - ties/(pow(n, 3)-n)), 6) as h from s, t""")
def m12_spearman_kruskal(spark, d):
    v = covariates(spark, d)
    s = assoc.spearman(v, "noise", "severity").crossJoin(assoc.kruskal_wallis(v, "noise", "severity"))
    return s.select("n", F.round("rho", 6).alias("rho"), F.round("h", 6).alias("h"))


@query(""", o as (select region, category, count(*) * 1.0 as o from fx1_site group by 1, 2), g as (select a.region, b.category, a.r, b.c, t.n, coalesce(o.o, 0) as o from (select region, sum(o) as r from o group by 1) a cross join (select category, sum(o) as c from o group by 1) b cross join (select sum(o) as n from o) t left join o on o.region = a.region and o.category = b.category)
 select round(sum(pow(o - r*c/n, 2) / (r*c/n)), 6) as chi2, (count(distinct region) - 1) * (count(distinct category) - 1) as df, round(sqrt(sum(pow(o - r*c/n, 2) / (r*c/n)) / (max(n) * (least(count(distinct region), count(distinct category)) - 1))), 6) as v from g""")
def a29_cramers_v(spark, d):
    c = assoc.cramers_v(X.site(spark, d), "region", "category")
    return c.select(F.round("chi2", 6).alias("chi2"), "df", F.round("v", 6).alias("v"))


@query(""", c as (select p.cell, p.year, p.severity, (p.cell*7919+p.year*104729)%1009 as noise, coalesce((select sum(b.severity) from fx4_panel b where b.cell = p.cell and b.year between p.year-5 and p.year-1), 0) as history from fx4_panel p)
 select unnest(['history', 'noise']) as covariate, round(1/(1 - pow(corr(history, noise), 2)), 2) as vif from c""")
def m14_vif(spark, d):
    return assoc.vif(covariates(spark, d), ["history", "noise"])


@query(""", c as (select p.cell, p.year, p.severity, (p.cell*7919+p.year*104729)%1009 as noise, coalesce((select sum(b.severity) from fx4_panel b where b.cell = p.cell and b.year between p.year-5 and p.year-1), 0) as history,
  round(coalesce((select avg(case when b.severity > 0 then 1.0 else 0.0 end) from fx4_edges e join fx4_panel b on b.cell = e.dst and b.year = e.year where e.src = p.cell and e.year = p.year), 0), 3) as pressure from fx4_panel p),
 k as (select """ + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in ("history", "pressure", "noise")) + """ from c)
 select 'history' as a, 'pressure' as b, round(corr(history, pressure), 3) as rho from k union all select 'history', 'noise', round(corr(history, noise), 3) from k union all select 'pressure', 'noise', round(corr(pressure, noise), 3) from k""")
def m13_spearman_matrix(spark, d):
    return assoc.spearman_matrix(covariates(spark, d), ["history", "pressure", "noise"])


@query(""", c as (select p.cell, p.severity, cast(p.cell % 3 as varchar) as zone, ((p.cell*7919+p.year*104729)%1009) * 1.0 as noise, coalesce((select sum(b.severity) from fx4_panel b where b.cell = p.cell and b.year between p.year-5 and p.year-1), 0) * 1.0 as history,
  round(coalesce((select avg(case when b.severity > 0 then 1.0 else 0.0 end) from fx4_edges e join fx4_panel b on b.cell = e.dst and b.year = e.year where e.src = p.cell and e.year = p.year), 0), 3) as pressure from fx4_panel p),
 k as (select """ + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in ("history", "pressure", "noise", "severity")) + """ from c),
 o as (select zone, severity, count(*) * 1.0 as o from c group by 1, 2),
 g as (select a.zone, b.severity, r, q, (select count(*) from c) * 1.0 as n, coalesce(o.o, 0) as o from (select zone, sum(o) as r from o group by 1) a cross join (select severity, sum(o) as q from o group by 1) b left join o on o.zone = a.zone and o.severity = b.severity),
 v as (select sqrt(sum(pow(o - r*q/n, 2) / (r*q/n)) / (max(n) * (least(count(distinct zone), count(distinct severity)) - 1))) as v from g),
 m as (select corr(history, pressure) as a, corr(history, noise) as b, corr(pressure, noise) as d from c),
 t as (select *, 1 + 2*a*b*d - a*a - b*b - d*d as det from m),
 l as (select 'history' as covariate, 'spearman' as test, corr(history, severity) as s, (select round((1 - d*d) / det, 2) from t) as vif from k union all
  select 'pressure', 'spearman', corr(pressure, severity), (select round((1 - b*b) / det, 2) from t) from k union all
  select 'noise', 'spearman', corr(noise, severity), (select round((1 - a*a) / det, 2) from t) from k union all select 'zone', 'cramers_v', v, null from v)
 select covariate, test, round(abs(s), 3) as strength, case when round(abs(s), 3) <= 0.1 then 'négligeable' when round(abs(s), 3) <= 0.3 then 'faible' when round(abs(s), 3) <= 0.5 then 'modérée' else 'forte' end as label,
  case when test = 'spearman' then case when s >= 0 then '+' else '-' end end as direction, vif from l""")
def m15_ranking(spark, d):
    """The ranking of ``m15_rank_covariates`` without its p."""
    return m15_rank_covariates(spark, d).drop("p")


@query()
def m15_rank_covariates(spark, d):
    v = covariates(spark, d).withColumn("zone", (F.col("cell") % 3).cast("string"))
    return assoc.rank_covariates(v, {"history": "continuous", "pressure": "continuous", "noise": "continuous", "zone": "categorical"}, "severity")
