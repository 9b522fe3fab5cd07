"""Weighted aggregation of pieces (hex, value, weight) onto hexes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import covered
from ..sources.scratch import cut
from . import grid, overlay


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str, tie: str | None = None) -> DataFrame:
    """Interpolated weighted median of each group: rows without value or positive weight are left out; rows are
    sorted by value (then ``tie``, else the weight), and the value is read off where the centred running weight passes half.

    Two phases, so that a group of any size is shared out. Rows of one value become one (its weight, and those of its
    first and last row, which is all that interpolation asks of them), combined before the shuffle. Values are
    dealt to ranges; sums by group and range tell in which range the running weight passes half, and only that range of each
    group is put in order.
    """
    keys = list(keys)
    w, order = F.col(weight).cast("double"), F.struct(F.col(tie or weight), F.col(weight).cast("double"))
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*keys, F.col(value).cast("double").alias("_x"), w.alias("_w"), order.alias("_t"))
    values = rows.groupBy(*keys, "_x").agg(F.sum("_w").alias("_w"), F.min_by("_w", "_t").alias("_first"), F.max_by("_w", "_t").alias("_last"))
    ranges = cut(cut(values).repartitionByRange(*keys, "_x").withColumn("_p", F.spark_partition_id()))
    # a row for each group and range that it reaches into
    sums = ranges.groupBy(*keys, "_p").agg(F.sum("_w").alias("_sum"), F.max(F.struct("_x", "_last")).alias("_end"))
    by = Window.partitionBy(*keys).orderBy("_p")
    sums = sums.withColumns({"_to": F.sum("_sum").over(by), "_half": F.sum("_sum").over(Window.partitionBy(*keys)) / 2})
    sums = sums.withColumn("_c", F.col("_to") - F.col("_end._last") / 2)
    sums = sums.withColumns({"_px": F.lag("_end._x").over(by), "_pc": F.lag("_c").over(by), "_top": F.max("_end._x").over(Window.partitionBy(*keys))})
    at = sums.groupBy(*keys).agg(
        F.first("_top").alias("_top"),  # the same in all rows of a group
        F.min(F.when(F.col("_c") >= F.col("_half"), F.struct("_p", "_half", (F.col("_to") - F.col("_sum")).alias("_from"), "_px", "_pc"))).alias("_at"),
    )
    own = [f"_k{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]  # a null key is a group
    at = cut(at.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "_top", "_at.*"))
    inside = ranges.join(at.withColumnRenamed("_p", "_in"), [*same, F.col("_p") == F.col("_in")])
    run = Window.partitionBy(*keys).orderBy("_x")
    inside = inside.withColumn("_to", F.col("_from") + F.sum("_w").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumns({"_c0": F.col("_to") - F.col("_w") + F.col("_first") / 2, "_c1": F.col("_to") - F.col("_last") / 2})
    inside = inside.withColumns({"_px": F.coalesce(F.lag("_x").over(run), "_px"), "_pc": F.coalesce(F.lag("_c1").over(run), "_pc")})
    between = F.col("_px") + (F.col("_x") - F.col("_px")) * (F.col("_half") - F.col("_pc")) / (F.col("_c0") - F.col("_pc"))
    read = F.when((F.col("_c0") < F.col("_half")) | F.col("_px").isNull(), F.col("_x")).otherwise(between)
    found = inside.where(F.col("_c1") >= F.col("_half")).groupBy(*keys).agg(F.min_by(read, "_x").alias("_m"))
    return at.join(found, same, "left").select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.coalesce("_m", "_top").alias(out))


def weighted_mode(df: DataFrame, keys: Sequence[str], category: str, weight: Column, out: str, rank: Column | None = None) -> DataFrame:
    """Category of the largest total weight; ties go to the first by ``rank`` (else by name)."""
    rank = F.col(category) if rank is None else rank
    rows = df.where(F.col(category).isNotNull() & (weight > 0)).select(*keys, F.col(category).alias(out), weight.alias("_w"), rank.alias("_k"))
    sums = rows.groupBy(*keys, out, "_k").agg(F.sum("_w").alias("_w"))
    # one pass: sums that were worked out twice may differ in their last digits, so they are never joined on
    return sums.groupBy(*keys).agg(F.min_by(out, F.struct(-F.col("_w"), "_k")).alias(out))


def coverage(df: DataFrame, keys: Sequence[str], area: str, hex_area: float, out: str = "coverage") -> DataFrame:
    """Share of the hex that pieces cover; pieces without a value count, overlaps may pass 1."""
    return df.groupBy(*keys).agg((F.sum(area) / hex_area).alias(out))


def aggregate_to_hex(cells: DataFrame, pieces: DataFrame, value: str, value_type: str, out: str, hex_area: float, keys: Sequence[str] = ("hex_id",), weight: str = "piece_area", min_coverage: float = 0.25, rank: Column | None = None, add_coverage: bool = False, tie: str | None = None) -> DataFrame:
    """Median (continuous; ``tie`` orders equal values) or mode (categorical, ordinal) of the pieces of each hex; null where
    too little of the hex is covered, or nothing is. ``cells`` has one row for each key."""
    if value_type == "continuous":
        found = weighted_median(pieces, keys, value, weight, out, tie)
    elif value_type in ("categorical", "ordinal"):
        found = weighted_mode(pieces, keys, value, F.col(weight), out, rank)
    else:
        raise ValueError(f"value_type is continuous, categorical or ordinal, not {value_type}")
    cov = coverage(pieces, keys, weight, hex_area, f"{out}_cov")
    joined = cells.join(cov, list(keys), "left").join(found, list(keys), "left")
    joined = joined.withColumn(out, covered(F.col(out), F.col(f"{out}_cov"), min_coverage))
    joined = joined.withColumn(f"{out}_cov", F.coalesce(f"{out}_cov", F.lit(0.0)))
    return joined if add_coverage else joined.drop(f"{out}_cov")


@dataclass(frozen=True)
class Covariate:
    """A source to bring onto the grid: polygons (poly and box), or with ``side`` raster cells (x, y, maybe band)."""

    source: DataFrame
    field: str
    value_type: str
    side: float | None = None
    band: int = 1


def aggregate_covariates(cells: DataFrame, items: dict[str, Covariate], width: float, min_coverage: float = 0.25) -> tuple[DataFrame, dict[str, str]]:
    """The hexes (hex_id, …) with a column for each covariate, and the type of each by name."""
    for name, c in items.items():
        rows = c.source.where(F.col("band") == c.band) if c.side and "band" in c.source.columns else c.source
        pieces = overlay.raster_pieces(rows, c.side, width) if c.side else overlay.hex_pieces(rows, width)
        pieces = pieces.select(grid.hex_id(F.col("q"), F.col("r")).alias("hex_id"), c.field, "piece_area")
        cells = aggregate_to_hex(cells, pieces, c.field, c.value_type, name, grid.hex_area(width), ["hex_id"], min_coverage=min_coverage)
    return cells, {name: c.value_type for name, c in items.items()}


def ratio_of_sums(pieces: DataFrame, keys: Sequence[str], value: Column, weight: Column, only: Column, out: str) -> DataFrame:
    """Weighted share over the pieces that ``only`` keeps."""
    return pieces.where(only).groupBy(*keys).agg((F.sum(weight * value) / F.sum(weight)).alias(out))
