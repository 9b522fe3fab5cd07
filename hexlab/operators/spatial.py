"""Spatial lag, autocorrelation, hot and cold spots. Edges are (src, dst, w); values are (key, value)."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import grid


def spatial_lag(values: DataFrame, edges: DataFrame, columns: Sequence[str], key: str = "hex_id", by: Sequence[str] = (), prefix: str = "lag_") -> DataFrame:
    """``values`` with Σ w_ij x_j of each column; a hex without neighbours has 0."""
    there = values.select(*by, F.col(key).alias("dst"), *columns)
    sums = edges.join(there, "dst").groupBy(*by, F.col("src").alias(key)).agg(*[F.sum(F.col("w") * F.col(c)).alias(prefix + c) for c in columns])
    joined = values.join(sums, [*by, key], "left")
    return joined.withColumns({prefix + c: F.coalesce(prefix + c, F.lit(0.0)) for c in columns})


def pressure(panel: DataFrame, edges: DataFrame, key: str = "hex_id", state: str = "state") -> DataFrame:
    """``panel`` with the share of a hex's neighbours in a state over 0 in the same year; no neighbour: 0."""
    there = panel.select("year", F.col(key).alias("dst"), (F.col(state) > 0).cast("double").alias("on"))
    share = edges.select("src", "dst").join(there, "dst").groupBy("year", F.col("src").alias(key)).agg(F.avg("on").alias("pressure"))
    return panel.join(share, ["year", key], "left").withColumn("pressure", F.round(F.coalesce("pressure", F.lit(0.0)), 3))


def z_scores(values: DataFrame, column: str, by: Sequence[str] = (), out: str = "z") -> DataFrame:
    """(x - mean) / sample deviation within ``by``; null if the deviation is 0."""
    m = values.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    joined = values.join(F.broadcast(m), list(by)) if by else values.crossJoin(F.broadcast(m))  # a row a year, or one
    return joined.withColumn(out, (F.col(column) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def scale_channel(values: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """(x - mean) / (sample deviation + 1e-6), nulls to 0."""
    m = values.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    joined = values.crossJoin(F.broadcast(m))  # one row
    return joined.withColumn(out, F.coalesce((F.col(column) - F.col("_m")) / (F.col("_s") + 1e-6), F.lit(0.0))).drop("_m", "_s")


def _centred(values: DataFrame, column: str, edges: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Hexes that have neighbours with a value, with z = x less the mean over them."""
    there = values.select(*by, F.col(key).alias("dst"))
    linked = edges.join(there, "dst").select(*by, F.col("src").alias(key)).distinct()
    rows = values.where(F.col(column).isNotNull()).join(linked, [*by, key], "left_semi")
    m = rows.groupBy(*by).agg(F.avg(column).alias("_m"))
    rows = rows.join(F.broadcast(m), list(by)) if by else rows.crossJoin(F.broadcast(m))
    return rows.select(*by, key, (F.col(column) - F.col("_m")).alias("z"))


def _moran_inputs(values: DataFrame, edges: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Centred values and the edges between them, written once: several passes read them."""
    values, edges = cut(values.select(key, column)), cut(edges.select("src", "dst", "w"))
    z = cut(_centred(values, column, edges, key, ()))
    return z, cut(edges.join(z.select(F.col(key).alias("src")), "src", "left_semi").join(z.select(F.col(key).alias("dst")), "dst", "left_semi").select("src", "dst", "w"))


def weight_sums(edges: DataFrame) -> DataFrame:
    """One row: s0, s1, s2 of a weight table."""
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    s1 = both.groupBy("src", "dst").agg(F.sum("w").alias("w")).agg((F.sum(F.col("w") * F.col("w")) / 2).alias("s1"))
    s2 = both.groupBy("src").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * F.col("w")).alias("s2"))
    return edges.agg(F.sum("w").alias("s0")).crossJoin(s1).crossJoin(s2)  # one row each


def global_moran(values: DataFrame, edges: DataFrame, column: str = "value", key: str = "hex_id") -> DataFrame:
    """One row: n, moran_i, expected, variance (randomisation), z."""
    z, e = _moran_inputs(values, edges, column, key)
    cross = e.join(z.select(F.col(key).alias("src"), F.col("z").alias("a")), "src").join(z.select(F.col(key).alias("dst"), F.col("z").alias("b")), "dst").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("c"))
    m = z.agg(F.count("*").cast("double").alias("n"), F.sum(F.col("z") * F.col("z")).alias("m2"), F.sum(F.pow("z", F.lit(4))).alias("m4"))
    t = m.crossJoin(cross).crossJoin(weight_sums(e))
    n, s0, s1, s2 = F.col("n"), F.col("s0"), F.col("s1"), F.col("s2")
    i = n / s0 * F.col("c") / F.nullif("m2", F.lit(0.0))
    ex = -1 / (n - 1)
    b2 = n * F.col("m4") / F.nullif(F.col("m2") * F.col("m2"), F.lit(0.0))
    top = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    var = top / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - ex * ex
    return t.select(n.cast("long").alias("n"), i.alias("moran_i"), ex.alias("expected"), var.alias("variance"), ((i - ex) / F.sqrt(var)).alias("z"))


def _rank_within(rows: DataFrame, group: str, order: Sequence[str], out: str) -> DataFrame:
    """Rank of each row within its group; a group may span many tasks: ranges of (group, order), each with an offset."""
    ranges = cut(rows.repartitionByRange(group, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(group, "_p").agg(F.count("*").alias("_n"))  # a row for each group and range
    offset = sizes.select(group, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(group, "_p").orderBy(*order)
    return ranges.join(offset, [group, "_p"]).withColumn(out, F.col("_o") + F.row_number().over(inside)).drop("_p", "_o")


#: Relabelled rows that one pass of a permutation test ranks at once.
PERMUTED_ROWS = 50_000_000


def permuted_moran(values: DataFrame, edges: DataFrame, column: str = "value", key: str = "hex_id", sims: int = 999, seed: int = 1, batch: int | None = None) -> DataFrame:
    """(sim, i): Moran's I of random relabellings by hashed orders; sim 0 is the real one.

    Hexes are ranked once; each simulation gives the values to them in the order of a hash. A batch of
    simulations is ranked by one sort; it holds ``batch`` simulations, or as many as ``PERMUTED_ROWS`` allow.
    """
    z, e = _moran_inputs(values, edges, column, key)
    spark = values.sparkSession
    m2 = z.agg(F.sum(F.col("z") * F.col("z")).alias("m2"), F.count("*").alias("n")).crossJoin(e.agg(F.sum("w").alias("s0")))
    batch = batch or max(1, min(sims + 1, PERMUTED_ROWS // max(1, z.count())))
    own = F.xxhash64(F.lit(0), key)
    one = z.select(F.lit(0).alias("sim"), key, "z", own.alias("_h"))
    places = cut(_rank_within(one, "sim", ["_h", key], "k").select(key, "k"))
    parts = []
    for first in range(0, sims + 1, batch):
        sim = spark.range(first, min(first + batch, sims + 1)).select(F.col("id").cast("int").alias("sim"))
        rows = z.crossJoin(F.broadcast(sim))
        # simulation 0 keeps the values where they are
        rows = rows.select("sim", key, "z", F.when(F.col("sim") == 0, own).otherwise(F.xxhash64(F.lit(seed), "sim", key)).alias("_h"))
        v = _rank_within(rows, "sim", ["_h", key], "k").select("sim", "z", "k").join(places, "k").select("sim", key, "z")
        c = e.join(v.select(F.col(key).alias("src"), "sim", F.col("z").alias("a")), "src").join(v.select(F.col(key).alias("dst"), "sim", F.col("z").alias("b")), ["dst", "sim"])
        parts.append(cut(c.groupBy("sim").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("c"))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.crossJoin(F.broadcast(m2)).select("sim", (F.col("n") / F.col("s0") * F.col("c") / F.col("m2")).alias("i"))


def moran_permutations(values: DataFrame, edges: DataFrame, column: str = "value", key: str = "hex_id", sims: int = 999, seed: int = 1, batch: int | None = None) -> DataFrame:
    """(moran_i, p_value, sims): share of random relabellings with an I as large (``permuted_moran``)."""
    i = permuted_moran(values, edges, column, key, sims, seed, batch)
    real = i.where("sim = 0").select(F.col("i").alias("moran_i"))
    return i.crossJoin(F.broadcast(real)).groupBy("moran_i").agg(
        ((F.count_if((F.col("sim") > 0) & (F.col("i") >= F.col("moran_i") - 1e-12)) + 1) / F.lit(sims + 1)).alias("p_value"), (F.count("*") - 1).alias("sims")
    )


def weight_tables(cells: DataFrame, key: str = "hex_id", max_dist: float = float("inf")) -> dict[str, DataFrame]:
    """The four tables to compare for hexes (key, q, r, x, y): rook and queen contiguity (the same on hexes), 1 / d and
    1 / d². All pairs weigh in unless ``max_dist`` says up to where; on more than some thousands of hexes, give it, or take
    ``farfield.moran_by_distance``, which makes no row of a pair."""
    near = grid.neighbours(cells.select(key, "q", "r"), key)
    if max_dist == float("inf"):
        box = cells.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
        max_dist = 1.0 + sum(v or 0.0 for v in box)
    far = {f"inverse_distance{p if p > 1 else ''}": grid.inverse_distance(cells, max_dist, p, key) for p in (1, 2)}
    return {"rook": near, "queen": near, **far}


def compare_weights(values: DataFrame, tables: dict[str, DataFrame], column: str = "value", key: str = "hex_id", sims: int = 0) -> DataFrame:
    """Moran's I under each weight table, with a permutation p if ``sims``; a table with two names is worked out once."""
    out, rows = None, {}
    for name, edges in tables.items():
        if id(edges) not in rows:
            row = global_moran(values, edges, column, key)
            if sims:
                row = row.crossJoin(moran_permutations(values, edges, column, key, sims).select("p_value"))
            rows[id(edges)] = cut(row)
        row = rows[id(edges)].withColumn("weights", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal, by a rational approximation of erf (error under 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def local_moran(values: DataFrame, edges: DataFrame, column: str = "value", key: str = "hex_id", by: Sequence[str] = ()) -> DataFrame:
    """(by…, key, x, lag, ii, expected, variance, z, p) of each hex, with the conditional moments; ``by``: one map each."""
    m = values.where(F.col(column).isNotNull()).groupBy(*by).agg(F.avg(column).alias("_m"), F.var_pop(column).alias("m2"), F.count("*").cast("double").alias("n"))
    rows = values.where(F.col(column).isNotNull())
    rows = rows.join(F.broadcast(m), list(by)) if by else rows.crossJoin(F.broadcast(m))
    rows = rows.select(*by, key, F.col(column).alias("x"), (F.col(column) - F.col("_m")).alias("zz"), "m2", "n")
    there = rows.select(*by, F.col(key).alias("dst"), F.col("zz").alias("zj"), F.col("x").alias("xj"))
    sums = edges.join(there, "dst").groupBy(*by, F.col("src").alias(key)).agg(
        F.sum(F.col("w") * F.col("zj")).alias("lz"), F.sum(F.col("w") * F.col("xj")).alias("lag"), F.sum("w").alias("w1"), F.sum(F.col("w") * F.col("w")).alias("w2")
    )
    t = rows.join(sums, [*by, key], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lz", "lag", "w1", "w2")})
    z, m2, n, w1, w2 = (F.col(c) for c in ("zz", "m2", "n", "w1", "w2"))
    m2 = F.nullif(m2, F.lit(0.0))
    ex = -(z * z) * w1 / ((n - 1) * m2)
    var = (z / m2) * (z / m2) * (n / (n - 2)) * (w2 - w1 * w1 / (n - 1)) * (m2 - z * z / (n - 1))
    t = t.withColumns({"ii": z / m2 * F.col("lz"), "expected": ex, "variance": var})
    t = t.withColumn("z", (F.col("ii") - F.col("expected")) / F.when(F.col("variance") > 0, F.sqrt("variance")))
    return t.select(*by, key, "x", "lag", "ii", "expected", "variance", "z", normal_tail(F.col("z")).alias("p"))


def lisa_types(values: DataFrame, edges: DataFrame, column: str = "value", key: str = "hex_id", by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """``local_moran`` with ``lisa``: HH, HL, LL, LH by the means of x and its lag, or "Non sign."."""
    t = local_moran(values, edges, column, key, by)
    m = t.groupBy(*by).agg(F.avg("x").alias("_mx"), F.avg("lag").alias("_ml"))
    t = t.join(F.broadcast(m), list(by)) if by else t.crossJoin(F.broadcast(m))
    bar = NormalDist().inv_cdf(1 - alpha / 2)
    high = lambda c, mean: F.when(F.col(c) > F.col(mean), "H").otherwise("L")
    lisa = F.when(F.abs("z") > bar, F.concat(high("x", "_mx"), high("lag", "_ml"))).otherwise("Non sign.")
    return t.withColumn("lisa", lisa).drop("_mx", "_ml")


def gaussian_focal(lattice: DataFrame, value: str, sigma: float, reach: int, out: str = "smooth") -> DataFrame:
    """Focal sum on a lattice (i, j) with a normalised Gaussian kernel; null cells are skipped and stay null."""
    import math

    steps = range(-reach, reach + 1)
    k = {(a, b): math.exp(-(a * a + b * b) / (2 * sigma * sigma)) for a in steps for b in steps}
    total = sum(k.values())
    kernel = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w / total).alias("w")) for (a, b), w in k.items()])).alias("k")
    spread = lattice.where(F.col(value).isNotNull()).select("i", "j", F.col(value).alias("_v"), kernel)
    sums = spread.groupBy((F.col("i") + F.col("k.a")).alias("i"), (F.col("j") + F.col("k.b")).alias("j")).agg(F.sum(F.col("_v") * F.col("k.w")).alias("_s"))
    return lattice.join(sums, ["i", "j"], "left").withColumn(out, F.when(F.col(value).isNotNull(), F.col("_s"))).drop("_s")
