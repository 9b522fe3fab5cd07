"""Views over the driver tables that give the operators their inputs, in Spark; and the same as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("customer", "nation", "orders", "lineitem", "part", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: points with region, category and value."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(  # nations: a fixed short list
        F.col("c_custkey").alias("site_id"),
        ((F.col("c_custkey") * 7919) % 100003).cast("double").alias("x"),
        ((F.col("c_custkey") * 104729) % 60013).cast("double").alias("y"),
        F.col("n_name").alias("region"),
        F.col("c_mktsegment").alias("category"),
        F.col("c_acctbal").alias("value"),
    )


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: rectangles per year with raw severity labels."""
    o, s = table(spark, sf_dir, "orders"), site(spark, sf_dir)
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    rank = F.when(price < 150000, 1).when(price < 350000, 2).otherwise(3)
    w, h = 200 + (key * 31) % 1800, 200 + (key * 17) % 1500
    return o.join(s, o.o_custkey == s.site_id).select(
        key.alias("patch_id"),
        F.year("o_orderdate").alias("year"),
        F.element_at(F.array(F.lit("Leger"), F.lit(" Modéré"), F.lit("Grave")), rank).alias("level_raw"),
        rank.alias("ia"),
        (F.col("x") - w).alias("xmin"),
        (F.col("y") - h).alias("ymin"),
        (F.col("x") + w).alias("xmax"),
        (F.col("y") + h).alias("ymax"),
    )


def cell_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: daily values of cells."""
    k = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        k.alias("cell_id"),
        ((k * 7919) % 100003).cast("double").alias("x"),
        ((k * 104729) % 60013).cast("double").alias("y"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.round(F.col("l_extendedprice") / 1000 - 40, 3).alias("value"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: cell x year panel of severity; (q, r) are axial coordinates."""
    s, p = site(spark, sf_dir), patch(spark, sf_dir)
    p = p.withColumn("x", (F.col("xmin") + F.col("xmax")) / 2).withColumn("y", (F.col("ymin") + F.col("ymax")) / 2)
    h = p.join(s.select("x", "y"), ["x", "y"]).select(
        (F.floor(F.col("x") / 10000).cast("int") * 100 + F.floor(F.col("y") / 10000).cast("int")).alias("cell"),
        "year",
        "ia",
        (F.col("xmax") - F.col("xmin")).alias("w"),
    )
    a = h.groupBy("cell", "year", "ia").agg(F.sum("w").alias("w"))
    top = Window.partitionBy("cell", "year").orderBy(F.desc("w"), "ia")
    m = a.withColumn("rn", F.row_number().over(top)).where("rn = 1")
    return m.select(
        "cell",
        "year",
        F.when((F.col("cell") * 13 + F.col("year") * 7) % 5 == 0, 0).otherwise(F.col("ia")).alias("severity"),
        F.floor(F.col("cell") / 100).cast("int").alias("q"),
        (F.col("cell") % 100).alias("r"),
    )


def stand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: stands with age codes and cover."""
    s = F.col("p_size")
    codes = F.array(*[F.lit(c) for c in ("10", "3050", "120", "JIN", "VIR", "", "7090", "XX")])
    cover = F.array(F.lit(None).cast("string"), F.lit("R"), F.lit("M"), F.lit("X"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("geocode"),
        F.get(codes, s % 8).alias("cl_age"),
        F.get(cover, s % 4).alias("type_couv"),
        (F.col("p_partkey") % 97).alias("hex_id"),
        F.col("p_retailprice").alias("piece_area"),
    )


def essence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: species shares of stands."""
    names = F.array(*[F.lit(c) for c in ("SB", "EN", "BP", "PT")])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("geocode"), F.get(names, F.col("l_linenumber") % 4).alias("essence"), F.col("l_quantity").alias("st_ess_pc")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: transition pairs with a fold id."""
    p = panel(spark, sf_dir)
    b = p.select("cell", (F.col("year") - 1).alias("year"), F.col("severity").alias("state_t1"))
    return p.join(b, ["cell", "year"]).select(
        F.col("cell").alias("hex_id"), F.col("year").alias("year_t"), F.col("severity").alias("state_t"), "state_t1", (F.col("cell") % 4).alias("block")
    )


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX7: feature vectors on a lattice."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
        "label",
        ((F.col("vec_id") * 37) % 23).cast("int").alias("q"),
        F.floor(F.col("vec_id") / 23).cast("int").alias("r"),
    )


#: The same views for DuckDB, as common table expressions in the order in which they build on each other.
CTE = """
fx1_site as (
  select c_custkey as site_id, cast((c_custkey*7919) % 100003 as double) as x, cast((c_custkey*104729) % 60013 as double) as y,
         n_name as region, c_mktsegment as category, c_acctbal as value
  from customer join nation on c_nationkey = n_nationkey),
fx2_patch as (
  select o.o_orderkey as patch_id, cast(year(o.o_orderdate) as int) as year,
         case when o.o_totalprice<150000 then 'Leger' when o.o_totalprice<350000 then ' Modéré' else 'Grave' end as level_raw,
         case when o.o_totalprice<150000 then 1 when o.o_totalprice<350000 then 2 else 3 end as ia,
         s.x-(200+(o.o_orderkey*31)%1800) as xmin, s.y-(200+(o.o_orderkey*17)%1500) as ymin,
         s.x+(200+(o.o_orderkey*31)%1800) as xmax, s.y+(200+(o.o_orderkey*17)%1500) as ymax
  from orders o join fx1_site s on o.o_custkey = s.site_id),
fx3_cell_daily as (
  select l.l_suppkey as cell_id, cast((l.l_suppkey*7919) % 100003 as double) as x, cast((l.l_suppkey*104729) % 60013 as double) as y,
         cast(l.l_shipdate as date) as date, round(l.l_extendedprice/1000-40,3) as value
  from lineitem l),
fx4_h as (
  select s.site_id, p.year, p.ia, p.xmax-p.xmin as w, cast(floor(s.x/10000) as int) as gx, cast(floor(s.y/10000) as int) as gy
  from fx2_patch p join fx1_site s on s.x=(p.xmin+p.xmax)/2 and s.y=(p.ymin+p.ymax)/2),
fx4_a as (select gx*100+gy as cell, year, ia, sum(w) as w from fx4_h group by 1,2,3),
fx4_m as (select cell, year, ia, row_number() over (partition by cell, year order by w desc, ia) as rn from fx4_a),
fx4_panel as (
  select cell, year, case when (cell*13+year*7)%5=0 then 0 else ia end as severity, cell // 100 as q, cell % 100 as r
  from fx4_m where rn = 1),
fx4_edges as (
  select a.cell as src, b.cell as dst, a.year from fx4_panel a join fx4_panel b on a.year = b.year
  and ((b.q-a.q = 1 and b.r = a.r) or (b.q-a.q = -1 and b.r = a.r) or (b.q = a.q and b.r-a.r = 1) or (b.q = a.q and b.r-a.r = -1)
       or (b.q-a.q = 1 and b.r-a.r = -1) or (b.q-a.q = -1 and b.r-a.r = 1))),
fx4_cells as (select distinct cell, q, r from fx4_panel),
fx4_nb as (
  select a.cell as src, b.cell as dst from fx4_cells a join fx4_cells b
  on (abs(b.q-a.q) + abs(b.r-a.r) + abs((b.q-a.q)+(b.r-a.r))) = 2),
fx5_stand as (
  select p_partkey as geocode,
         case p_size%8 when 0 then '10' when 1 then '3050' when 2 then '120' when 3 then 'JIN' when 4 then 'VIR'
                       when 5 then '' when 6 then '7090' else 'XX' end as cl_age,
         case when p_size%4=0 then null when p_size%4=1 then 'R' when p_size%4=2 then 'M' else 'X' end as type_couv,
         p_partkey%97 as hex_id, p_retailprice as piece_area
  from part),
fx5_essence as (
  select l_partkey as geocode, case l_linenumber%4 when 0 then 'SB' when 1 then 'EN' when 2 then 'BP' else 'PT' end as essence,
         l_quantity as st_ess_pc
  from lineitem),
fx6_pairs as (
  select a.cell as hex_id, a.year as year_t, a.severity as state_t, b.severity as state_t1, a.cell%4 as block
  from fx4_panel a join fx4_panel b on a.cell=b.cell and b.year=a.year+1),
fx7_feat as (
  select vec_id as id, list_transform(embedding, lambda v: cast(v as double)) as x, label,
         cast((vec_id*37)%23 as int) as q, cast(floor(vec_id/23) as int) as r from embeddings)
"""


def sql(body: str) -> str:
    """``body`` over the views; further common table expressions may lead it, after a comma."""
    return f"with {CTE.strip()}\n{body.strip()}"
