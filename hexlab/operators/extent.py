"""Yearly extent of the phenomenon inside a zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import overlay


def area_by_level(clipped: DataFrame, levels: Sequence[str], year: str = "year", level: str = "level") -> DataFrame:
    """Hectares by year, one column a level, 0 where there is none."""
    return clipped.groupBy(year).pivot(level, list(levels)).agg(F.sum(F.col("area") / 10000)).na.fill(0.0)


def yearly_report(polys: DataFrame, zone: DataFrame, levels: Sequence[str], zone_area: float, width: float, side: float, key: str = "patch_id", year: str = "year", level: str = "level") -> DataFrame:
    """By year: hectares of each level, touched hectares with overlaps counted once, their share of the zone in
    per cent, and the number of polygons; what lies outside the zone is cut off."""
    clipped = cut(overlay.clip_to_zone(polys, zone, width, [key]).join(polys.select(key, year, level), key))
    severity = area_by_level(clipped, levels, year, level)
    touched = overlay.union_area(polys, side, [year], "touched", zone)
    touched = touched.select(year, (F.col("touched") / 10000).alias("touched_ha"), F.round(F.col("touched") / zone_area * 100, 2).alias("touched_pct"))
    count = clipped.groupBy(year).agg(F.count("*").alias("polygons"))
    return severity.join(touched, year, "left").join(count, year, "left").orderBy(year)

