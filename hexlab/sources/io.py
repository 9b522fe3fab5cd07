"""Reading, listing and writing of tables; Catalyst pushes the filters into the Parquet scans."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import overlay


class EmptyZone(ValueError):
    """No feature lies in the regions asked for."""


def region_scan(df: DataFrame, field: str, regions: Sequence[str], required: bool = False) -> DataFrame:
    """Features of the named regions; ``required``: an error if there is none."""
    out = df.where(F.col(field).isin(list(regions)))
    if required and out.isEmpty():
        raise EmptyZone(f"no feature with {field} in {list(regions)}")
    return out


def flat(poly):
    """Rings without a third coordinate."""
    return F.transform(poly, lambda r: F.struct(F.transform(r["ring"], lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"), r["hole"].alias("hole")))


def box_scan(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, keep: Sequence[str] | None = None) -> DataFrame:
    """Features whose box meets the given one (row groups are skipped by their statistics, most of them in a table of
    ``write_by_place``), and of the columns asked for those that there are."""
    out = df.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))
    return out.select(*[c for c in keep if c in df.columns]) if keep else out


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables, exact copies once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates()


def named_feature(parts: Sequence[DataFrame], field: str, name: str) -> DataFrame:
    return stacked([p.where(F.col(field) == name) for p in parts])


def csv_index(spark: SparkSession, path: str, schema: str, parameter: tuple[str, str], years: tuple[str, Sequence[int]]) -> DataFrame:
    """Rows of a CSV index for one parameter and a set of years."""
    return spark.read.csv(path, header=True, schema=schema).where((F.col(parameter[0]) == parameter[1]) & F.col(years[0]).isin(list(years[1])))


def months_of(daily: DataFrame, months: Sequence[int], years: Sequence[int] | None = None, key: str = "cell_id") -> DataFrame:
    """The days of some months; with ``years``, each year asked for has at least one row, of nulls if it has no day."""
    rows = daily.where(F.month("date").isin(list(months)))
    if years is None:
        return rows
    asked = daily.sparkSession.createDataFrame([(int(y),) for y in years], "year int")
    return F.broadcast(asked).join(rows.withColumn("year", F.year("date")), "year", "left")  # a row a year


def band(df: DataFrame, number: int, column: str = "band") -> DataFrame:
    return df.where(F.col(column) == number)


def manifest(index: DataFrame, zone: DataFrame, present: DataFrame, width: float, key: str = "tile", force: bool = False) -> DataFrame:
    """Tiles of the index that overlap the zone and are not there yet."""
    wanted = overlay.intersecting(index, zone, width, [key])
    return wanted if force else wanted.join(present.select(key), key, "left_anti")


def preferred(listing: DataFrame, key: str = "tile", name: str = "name", order: str = "position", suffix: str = "_c.gpkg") -> DataFrame:
    """Of each tile's entries the compiled one (by its suffix, in any case), else the first."""
    by = Window.partitionBy(key).orderBy(F.lower(name).endswith(suffix).desc(), order)
    return listing.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def years_needed(years: DataFrame, column: str = "year") -> DataFrame:
    """The years and those before them, sorted."""
    return years.select(F.explode(F.array(F.col(column), F.col(column) - 1)).alias(column)).distinct().orderBy(column)


def write_by_place(df: DataFrame, path: str, files: int, group_bytes: int = 32 << 20) -> None:
    """Features with a box, written so that ``box_scan`` skips most of them: dealt to ``files`` and sorted along a
    Z-order curve of their boxes' centres, so each file and row group covers a small region and its statistics say so.

    A feature without a box comes first; one row of extremes is all that the driver sees.
    """
    e = df.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()

    def step(low: str, high: str, least: float | None, most: float | None) -> Column:
        """The centre as one of 2**16 steps over the extent."""
        unit = ((F.col(low) + F.col(high)) / 2 - F.lit(float(least or 0))) / F.lit((float(most or 0) - float(least or 0)) or 1.0)
        return F.floor(unit * 65535).cast("long")

    def spread(v: Column) -> Column:
        """A zero bit after each bit."""
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    at = spread(step("xmin", "xmax", e[0], e[2])).bitwiseOR(F.shiftleft(spread(step("ymin", "ymax", e[1], e[3])), 1))
    rows = df.withColumn("_z", at).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")
    rows.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions of a panel whose writing ended, the oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("v"))
    return [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/meta/_SUCCESS"))]


def _meta(spark: SparkSession, path: str):
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/{found[-1]}/meta").first() if found else None


def write_panel(panel: DataFrame, path: str, regions: Sequence[str], cellsize: float, groups: dict[str, Sequence[str]], years: Sequence[int] | None = None, keep: int = 2) -> None:
    """A new version of the panel: its rows by year, then one row that says what it was built from and where each year
    lies. That row is written last and makes the version valid, so readers see the old panel or the new one, and a write
    that fails leaves the old one in place.

    With ``years``, only those are taken from ``panel``, and the others stay those of the version before (of the same
    regions and cell size). Folders that none of the last ``keep`` versions refers to are deleted.
    """
    spark = panel.sparkSession
    found, before = _versions(spark, path), _meta(spark, path)
    version = f"v{1 + int(found[-1][1:9]) if found else 0:08d}-{uuid.uuid4().hex[:8]}"
    parts: dict[int, str] = {}
    if years is not None:
        if before is not None and (sorted(regions) != before["regions"] or float(cellsize) != before["cellsize"]):
            raise ValueError(f"the panel was built for {before['regions']} with cells of {before['cellsize']}: write all of it")
        parts = {y: v for y, v in (before["parts"] if before is not None else {}).items() if y not in set(years)}
        panel = panel.where(F.col("year").isin(list(years)))
    panel.write.partitionBy("year").parquet(f"{path}/{version}/panel")
    written = spark.read.schema(panel.schema).parquet(f"{path}/{version}/panel").select("year").distinct().collect()
    parts |= {r["year"]: version for r in written}
    rows = [(sorted(regions), float(cellsize), sorted(parts), {k: list(v) for k, v in groups.items()}, parts)]
    meta = spark.createDataFrame(rows, "regions array<string>, cellsize double, years array<int>, groups map<string,array<string>>, parts map<int,string>")
    meta.withColumn("built_at", F.current_timestamp()).coalesce(1).write.parquet(f"{path}/{version}/meta")
    last = _versions(spark, path)[-keep:]
    used = {v for name in last for v in spark.read.parquet(f"{path}/{name}/meta").first()["parts"].values()} | set(last)
    for name in _versions(spark, path):
        if name not in used:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_panel(spark: SparkSession, path: str, regions: Sequence[str], cellsize: float) -> DataFrame:
    """The last valid version of the panel; a warning if it was built for other regions or another cell size."""
    meta = _meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no panel in {path}")
    if sorted(regions) != meta["regions"] or float(cellsize) != meta["cellsize"]:
        warnings.warn(f"the panel was built for {meta['regions']} with cells of {meta['cellsize']}", stacklevel=2)
    out = None
    for version in sorted(set(meta["parts"].values())) or [_versions(spark, path)[-1]]:
        years = [y for y, v in meta["parts"].items() if v == version]
        part = spark.read.parquet(f"{path}/{version}/panel").where(F.col("year").isin(years))  # folders of other years are pruned
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def cached_panel(spark: SparkSession, path: str, regions: Sequence[str], cellsize: float) -> tuple[DataFrame, dict[str, list[str]]] | None:
    """The panel and the groups of its covariates, or None where nothing has been cached."""
    meta = _meta(spark, path)
    return None if meta is None else (read_panel(spark, path, regions, cellsize), {k: list(v) for k, v in meta["groups"].items()})


def covariates_of(spark: SparkSession, path: str, group: str) -> list[str]:
    """Covariates of a model group; a covariate without a group belongs to both."""
    return sorted(c for c, g in _meta(spark, path)["groups"].items() if not g or group in g)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
