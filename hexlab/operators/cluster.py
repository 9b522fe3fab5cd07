"""Fuzzy c-means, with spatial lag or without, over many settings in one pass; quality; spatial blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def _memberships(x: Column, lagged: Column, centers: Column, m: Column, alpha: Column) -> Column:
    """Shares of a row in each centre; a row on a centre belongs to it alone."""
    d = F.transform(centers, lambda v: _squared(x, v) + alpha * _squared(lagged, v))

    def shares(d: Column) -> Column:
        on = F.exists(d, lambda v: v <= 0)
        raw = F.transform(d, lambda v: F.when(on, (v <= 0).cast("double")).otherwise(F.pow(v, -1 / (m - 1))))
        return F.element_at(F.transform(F.array(raw), lambda r: F.transform(r, lambda v: v / F.aggregate(r, F.lit(0.0), lambda s, w: s + w))), 1)

    return F.element_at(F.transform(F.array(d), shares), 1)


def lagged_features(rows: DataFrame, edges: DataFrame, dims: int, key: str = "id") -> DataFrame:
    """``rows`` (key, x) with ``xl``, the spatial lag of every component; without neighbours the row itself."""
    there = rows.select(F.col(key).alias("dst"), *[F.get("x", F.lit(j)).alias(f"x{j}") for j in range(dims)])
    sums = edges.join(there, "dst").groupBy(F.col("src").alias(key)).agg(*[F.sum(F.col("w") * F.col(f"x{j}")).alias(f"x{j}") for j in range(dims)])
    return rows.join(sums.select(key, F.array(*[f"x{j}" for j in range(dims)]).alias("xl")), key, "left").withColumn("xl", F.coalesce("xl", "x"))


def _settings(rows: DataFrame, settings: Sequence[tuple[float, float]], centers: Sequence[np.ndarray], name: str = "centers") -> DataFrame:
    data = [(i, float(m), float(a), c.tolist()) for i, ((m, a), c) in enumerate(zip(settings, centers, strict=True))]
    return rows.sparkSession.createDataFrame(data, f"setting int, m double, alpha double, {name} array<array<double>>")


def memberships(rows: DataFrame, settings: Sequence[tuple[float, float]], centers: Sequence[np.ndarray], key: str = "id") -> DataFrame:
    """(setting, key, x, u) for rows (key, x, xl)."""
    s = F.broadcast(_settings(rows, settings, centers))  # a row a setting
    return rows.crossJoin(s).select("setting", key, "x", "xl", "m", "alpha", _memberships(F.col("x"), F.col("xl"), F.col("centers"), F.col("m"), F.col("alpha")).alias("u"))


def _center_means(k: int) -> list[Column]:
    """The new centres as vectors: means of the rows, lag and all, weighted by powers of their memberships."""
    value = array_to_vector(F.zip_with("x", "xl", lambda x, l: (x + F.col("alpha") * l) / (1 + F.col("alpha"))))
    return [Summarizer.mean(value, F.pow(F.get("u", F.lit(i)), F.col("m"))).alias(f"c{i}") for i in range(k)]


def _centers_of(row, k: int) -> np.ndarray:
    return np.array([row[f"c{i}"].toArray() for i in range(k)])


def update_centers(u: DataFrame, k: int) -> list[np.ndarray]:
    """New centres of every setting: one grouped aggregate, k vectors a setting."""
    got = u.groupBy("setting").agg(*_center_means(k)).orderBy("setting").collect()  # a row a setting
    return [_centers_of(r, k) for r in got]


def fuzzy_cmeans(rows: DataFrame, settings: Sequence[tuple[float, float]], k: int, tol: float = 1e-4, max_iter: int = 100, seed: int = 456, key: str = "id", settle: bool = False) -> list[np.ndarray]:
    """Centres for each (m, alpha): starts from the k rows of smallest hash; a setting leaves the passes once no
    membership of it changes by more than ``tol``. With ``settle`` it is an error if one has not after ``max_iter``
    rounds. rows: (key, x, xl)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = cut(rows.select(key, F.col("x").cast("array<double>"), F.col("xl").cast("array<double>")).repartition(cores))
    first = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k).collect()
    centers = [np.array([r["x"] for r in first], dtype=float) for _ in settings]
    before: list[np.ndarray | None] = [None for _ in settings]
    live = list(range(len(settings)))
    for _ in range(max_iter):
        part = rows.select("x", "xl").mapInArrow(_round([(i, *settings[i], centers[i], before[i]) for i in live], tol), "setting int, sums array<double>, moved double")
        sums: dict[int, np.ndarray] = {}
        moved = dict.fromkeys(live, -1.0)
        for r in part.collect():  # a row a setting and task: k centres, twice, and k weights
            sums[r["setting"]] = sums.get(r["setting"], 0.0) + np.array(r["sums"])
            moved[r["setting"]] = max(moved[r["setting"]], r["moved"])
        for i, got in sums.items():
            own, lag = got[k:].reshape(2, k, -1)
            alpha = settings[i][1]
            before[i], centers[i] = centers[i], (own + alpha * lag) / (1 + alpha) / got[:k, None]
            if 0 <= moved[i] <= tol:
                live.remove(i)
        if not live or not sums:
            break
    if settle and live:
        raise RuntimeError(f"settings {[settings[i] for i in live]} did not settle in {max_iter} rounds")
    return centers


#: Rows that a task holds against the centres of all settings at once.
CHUNK = 2048


def _chunks(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[np.ndarray]]:
    """Columns of batches as arrays of at most ``CHUNK`` rows; columns of lists have two dimensions."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            cols = [part.column(n) for n in names]
            yield [c.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in cols]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, taken about the middle of the centres."""
    o = c.mean(axis=0)
    x, c = x - o, c - o
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None], 0.0)


def _shares(x: np.ndarray, xl: np.ndarray, centers: np.ndarray, m: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Memberships (row, setting, centre) as ``_memberships`` has them; centers: (setting, centre, component)."""
    n, flat = len(x), centers.reshape(-1, centers.shape[2])
    d = _squares(x, flat).reshape(n, *centers.shape[:2])
    if alpha.any():
        d = d + alpha[None, :, None] * _squares(xl, flat).reshape(d.shape)
    least = d.min(axis=2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        raw = np.where(least <= 0, d <= 0, (d / least) ** (-1 / (m - 1))[None, :, None])
    return raw / raw.sum(axis=2, keepdims=True)


def _round(live: list[tuple], tol: float):
    """A task's part of a round: for each setting sums of weights and of weighted rows and lags, and the largest change of a
    membership (-1 where there is nothing to compare with). Past ``tol`` it need not be known, so it is not looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, m, alpha = np.stack([s[3] for s in live]), np.array([s[1] for s in live], dtype=float), np.array([s[2] for s in live], dtype=float)
        known = np.array([s[4] is not None for s in live])
        old = np.stack([s[3] if s[4] is None else s[4] for s in live])
        count, k, dims = centers.shape
        total, moved = None, np.where(known, 0.0, -1.0)
        for x, xl in _chunks(batches, "x", "xl"):
            u = _shares(x, xl, centers, m, alpha)
            look = np.flatnonzero(known & (moved <= tol))
            if len(look):
                v = _shares(x, xl, old[look], m[look], alpha[look])
                moved[look] = np.maximum(moved[look], np.abs(u[:, look] - v).max(axis=(0, 2)))
            w = (u ** m[None, :, None]).reshape(len(x), -1)
            lag = w.T @ xl if alpha.any() else np.zeros((count * k, dims))
            part = np.concatenate([w.sum(axis=0).reshape(count, k), (w.T @ x).reshape(count, -1), lag.reshape(count, -1)], axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"setting": pa.array([s[0] for s in live], pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64())), "moved": pa.array(moved, pa.float64())})

    return run


def hard_class(u: Column, least: float = 0.45) -> Column:
    """1-based class of the largest membership (the first on ties), "undecided" under ``least``."""
    top = F.array_max(u)
    return F.when(top < least, "undecided").otherwise(F.array_position(u, top).cast("string"))


def group_profile(long: DataFrame, value: str, u: Column, k: int, by: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """(by…, cluster, mean): means weighted by membership; memberships up to the threshold count as 0."""
    w = lambda i: F.when(F.get(u, F.lit(i)) > threshold, F.get(u, F.lit(i))).otherwise(0.0)
    got = long.groupBy(*by).agg(*[(F.sum(w(i) * F.col(value)) / F.nullif(F.sum(w(i)), F.lit(0.0))).alias(f"g{i + 1}") for i in range(k)])
    return got.select(*by, F.explode(F.array(*[F.struct(F.lit(i + 1).alias("cluster"), F.col(f"g{i + 1}").alias("mean")) for i in range(k)])).alias("g")).select(*by, "g.cluster", "g.mean")


def explained_inertia(u: DataFrame, centers: Sequence[np.ndarray], dims: int) -> DataFrame:
    """(setting, explained): one less the share of the inertia that is left within the clusters."""
    mean = u.groupBy("setting").agg(F.array(*[F.avg(F.get("x", F.lit(j))) for j in range(dims)]).alias("mean"))
    c = _settings(u, [(2.0, 0.0)] * len(centers), centers).select("setting", "centers")
    rows = u.join(F.broadcast(mean), "setting").join(F.broadcast(c), "setting")  # a row a setting
    within = F.aggregate(F.zip_with("u", "centers", lambda s, v: s * _squared(F.col("x"), v)), F.lit(0.0), lambda s, v: s + v)
    return rows.groupBy("setting").agg((1 - F.sum(within) / F.sum(_squared(F.col("x"), F.col("mean")))).alias("explained"))


def fuzzy_silhouette(u: DataFrame, k: int, dims: int) -> DataFrame:
    """(setting, silhouette): squared-distance silhouettes weighted by the lead of the first membership; mean
    distances to a cluster come from its moments, so the work is rows times clusters."""
    top = F.array_max("u")
    second = F.element_at(F.sort_array("u", asc=False), 2)
    rows = u.select("setting", "x", F.array_position("u", top).cast("int").alias("c"), (top - second).alias("lead"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("norm"))
    moments = rows.groupBy("setting", "c").agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("x", F.lit(j))) for j in range(dims)]).alias("mean"), F.avg("norm").alias("sq"))
    all_ = moments.groupBy("setting").agg(F.collect_list(F.struct("c", "n", "mean", "sq")).alias("cs"))  # k structs
    rows = rows.join(F.broadcast(all_), "setting")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    far = F.transform("cs", lambda s: F.struct(s["c"].alias("c"), s["n"].alias("n"), (F.col("norm") - 2 * dot(F.col("x"), s["mean"]) + s["sq"]).alias("d")))
    rows = rows.withColumn("far", far)
    own = F.element_at(F.filter("far", lambda s: s["c"] == F.col("c")), 1)
    rows = rows.withColumns({"a": own["d"] * own["n"] / F.nullif(own["n"] - 1, F.lit(0)), "b": F.array_min(F.transform(F.filter("far", lambda s: s["c"] != F.col("c")), lambda s: s["d"]))})
    s = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy("setting").agg((F.sum(F.col("lead") * s) / F.nullif(F.sum("lead"), F.lit(0.0))).alias("silhouette"))


def silhouette_by_distance(u: DataFrame, sample: int | None = None, seed: int = 1, key: str = "id") -> DataFrame:
    """(setting, silhouette, error): the same with mean distances instead of mean squared ones, exact (error 0) unless
    ``sample`` is given: every row meets every other one (``_silhouette_of_all``).

    With ``sample`` each row is held against at most ``sample`` rows of every cluster, those of the smallest hashes (all rows of a smaller
    cluster, and then the figure is exact): their number bounds what is shipped, and the spread of the distances to them
    bounds the error (two standard errors of both means, with the correction for a finite cluster). u: (setting, key, x, u).
    """
    top = F.array_max("u")
    second = F.element_at(F.sort_array("u", asc=False), 2)
    rows = u.select("setting", F.col(key).alias("id"), F.col("x").cast("array<double>").alias("x"), (F.array_position("u", top) - 1).cast("int").alias("c"), (top - second).alias("lead"))
    sizes = {(r["setting"], r["c"]): r["n"] for r in rows.groupBy("setting", "c").agg(F.count("*").alias("n")).collect()}  # clusters of settings
    if sample is None:
        return _silhouette_of_all(rows, sizes)
    shares = rows.sparkSession.createDataFrame([(s, c, min(1.0, 4.0 * sample / n)) for (s, c), n in sizes.items()], "setting int, c int, share double")
    order = F.xxhash64(F.lit(seed), "id")
    # a share of some four samples first, so that no task ranks a whole cluster
    few = rows.join(F.broadcast(shares), ["setting", "c"]).where(F.pmod(order, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("setting", "c").orderBy(order, "id"))).where(F.col("n") <= sample)
    held: dict[int, dict[int, tuple[np.ndarray, np.ndarray, int]]] = {}
    grouped: dict[tuple[int, int], list] = {}
    for r in few.select("setting", "c", "id", "x").collect():
        grouped.setdefault((r["setting"], r["c"]), []).append((r["id"], r["x"]))
    for (s, c), found in grouped.items():
        held.setdefault(s, {})[c] = (np.array([i for i, _ in found]), np.array([x for _, x in found]), sizes[s, c])
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, part in batch.groupby("setting"):
                x, own = np.stack(part["x"].to_list()), part["c"].to_numpy()
                means, errors = np.full((2, len(part), max(shared.value[s]) + 1), np.inf)
                alone = np.zeros(len(part), dtype=bool)
                for c, (ids, y, n) in shared.value[s].items():
                    d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1)[None], 0))
                    self_ = (part["id"].to_numpy()[:, None] == ids[None]) & (own == c)[:, None]
                    d[self_] = 0.0
                    k, of = len(ids) - self_.sum(axis=1), n - (own == c)
                    alone |= (own == c) & (of == 0)
                    means[:, c] = d.sum(axis=1) / np.maximum(k, 1)
                    spread = np.maximum((d**2).sum(axis=1) / np.maximum(k, 1) - means[:, c] ** 2, 0) * k / np.maximum(k - 1, 1)
                    errors[:, c] = 2 * np.sqrt(spread / np.maximum(k, 1) * np.maximum(1 - k / np.maximum(of, 1), 0))
                at = np.arange(len(part))
                a, ea = means[at, own], errors[at, own]
                means[at, own] = np.inf
                nearest = means.argmin(axis=1)
                b, eb = means[at, nearest], errors[at, nearest]
                top = np.maximum(a, b)
                fine = np.isfinite(b) & (top > 0) & ~alone
                with np.errstate(invalid="ignore", divide="ignore"):
                    value, error = np.where(fine, (b - a) / top, 0.0), np.where(fine, np.minimum((ea + eb) / top, 2.0), 0.0)
                lead = part["lead"].to_numpy()
                out.append((s, float(lead @ value), float(lead @ error), float(lead.sum())))
            yield pd.DataFrame(out, columns=["setting", "s", "e", "w"])

    sums = rows.mapInPandas(run, "setting int, s double, e double, w double").groupBy("setting").agg(*[F.sum(c).alias(c) for c in "sew"])
    w = F.nullif(F.col("w"), F.lit(0.0))
    return sums.select("setting", (F.col("s") / w).alias("silhouette"), (F.col("e") / w).alias("error"))


#: Rows of a block that one task holds against all rows.
BLOCK = 4096


def _silhouette_of_all(rows: DataFrame, sizes: dict[tuple[int, int], int]) -> DataFrame:
    """``silhouette_by_distance`` over all pairs. Rows are dealt to blocks, and each block goes to a task that all rows
    of its setting stream past: what a task holds does not grow with the table; the work does with its square."""
    counts: dict[int, int] = {}
    for (s, _), n in sizes.items():
        counts[s] = counts.get(s, 0) + n
    blocks = max(1, math.ceil(max(counts.values(), default=0) / BLOCK))
    k = 1 + max((c for _, c in sizes), default=0)
    columns = ["id", "x", "c", "lead"]
    mine = rows.select("setting", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("side"), *columns)
    all_ = rows.select("setting", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("side"), *columns)
    dealt = mine.unionAll(all_).repartition(max(1, len(counts) * blocks), "setting", "b").sortWithinPartitions("setting", "b", "side")

    def ended(setting: int, held: list[np.ndarray], sums: np.ndarray | None) -> pa.RecordBatch:
        c, lead = np.concatenate(held[2]), np.concatenate(held[3])
        at = np.arange(len(c))
        of = np.array([sizes.get((setting, j), 0) for j in range(k)])[None] - (np.arange(k)[None] == c[:, None])
        with np.errstate(invalid="ignore", divide="ignore"):
            means = np.where(of > 0, sums / of, np.inf)
            a = means[at, c]
            means[at, c] = np.inf
            b = means.min(axis=1)
            top = np.maximum(a, b)
            value = np.where(np.isfinite(top) & (top > 0), (b - a) / top, 0.0)
        return pa.RecordBatch.from_pydict({"setting": pa.array([setting], pa.int32()), "s": [float(lead @ value)], "w": [float(lead.sum())]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, x, sums = None, None, None, None
        for setting, block, side, ids, rows_, c, lead in _chunks(batches, "setting", "b", "side", *columns):
            starts = np.flatnonzero(np.r_[True, (np.diff(setting) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)])
            for a, b in zip(starts, [*starts[1:], len(setting)], strict=True):
                if at != (setting[a], block[a]):
                    if sums is not None:
                        yield ended(int(at[0]), held, sums)
                    at, held, sums = (setting[a], block[a]), [[], [], [], []], None
                if side[a] == 0:
                    for into, column in zip(held, (ids, rows_, c, lead), strict=True):
                        into.append(column[a:b])
                    continue
                if not held[0]:  # a block without rows of its own
                    continue
                if sums is None:
                    x, own = np.concatenate(held[1]), np.concatenate(held[0])
                    sums = np.zeros((len(x), k))
                d = np.sqrt(_squares(x, rows_[a:b]))
                _, i, j = np.intersect1d(own, ids[a:b], return_indices=True)
                d[i, j] = 0.0
                sums += d @ (c[a:b, None] == np.arange(k)[None]).astype(float)
        if sums is not None:
            yield ended(int(at[0]), held, sums)

    found = dealt.mapInArrow(run, "setting int, s double, w double").groupBy("setting").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    return found.select("setting", (F.col("s") / F.nullif(F.col("w"), F.lit(0.0))).alias("silhouette"), F.lit(0.0).alias("error"))


def spatial_inconsistency(u: DataFrame, edges: DataFrame, k: int, key: str = "id") -> DataFrame:
    """(setting, inconsistency): Σ w |u_i - u_j|² over edges, over what random places would give on average,
    which is known in closed form: Σ w times the mean squared distance of two different rows."""
    a = u.select("setting", F.col(key).alias("src"), F.col("u").alias("ua"))
    b = u.select("setting", F.col(key).alias("dst"), F.col("u").alias("ub"))
    found = edges.join(a, "src").join(b, ["setting", "dst"]).groupBy("setting").agg(F.sum(F.col("w") * _squared(F.col("ua"), F.col("ub"))).alias("s"), F.sum("w").alias("w"))
    part = [F.var_pop(F.get("u", F.lit(i))) for i in range(k)]
    mean = u.groupBy("setting").agg((2 * sum(part[1:], part[0]) * F.count("*") / F.nullif(F.count("*") - 1, F.lit(0))).alias("e"))
    return found.join(F.broadcast(mean), "setting").select("setting", (F.col("s") / F.nullif(F.col("w") * F.col("e"), F.lit(0.0))).alias("inconsistency"))


def sweep_quality(rows: DataFrame, edges: DataFrame, settings: Sequence[tuple[float, float]], centers: Sequence[np.ndarray], key: str = "id") -> DataFrame:
    """(setting, explained, silhouette, inconsistency) as ``explained_inertia``, ``fuzzy_silhouette`` and
    ``spatial_inconsistency`` have them, for many settings without a row for each row and setting: tasks work out the
    memberships of all settings and sum. rows: (key, x, xl)."""
    rows = cut(rows.select(key, F.col("x").cast("array<double>"), F.col("xl").cast("array<double>")).repartition(rows.sparkSession.sparkContext.defaultParallelism))
    c, m, alpha = np.stack(centers), np.array([s[0] for s in settings], dtype=float), np.array([s[1] for s in settings], dtype=float)
    count, k, dims = c.shape

    def added(df: DataFrame, part) -> np.ndarray:
        """The sum of what ``part`` makes of the chunks of tasks; a row a task comes to the driver."""
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for columns in _chunks(batches, *names):
                got = part(*columns)
                total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})

        return sum(np.array(r["sums"]) for r in df.mapInArrow(run, "sums array<double>").collect())

    def first(x: np.ndarray, xl: np.ndarray) -> np.ndarray:
        u = _shares(x, xl, c, m, alpha)
        hot = (u.argmax(axis=2)[:, :, None] == np.arange(k)[None, None]).astype(float).reshape(len(x), -1)
        within = (u * _squares(x, c.reshape(-1, dims)).reshape(u.shape)).sum(axis=(0, 2))
        square = (x**2).sum(axis=1)
        parts = ([len(x)], x.sum(axis=0), [square.sum()], within, u.sum(axis=0), (u**2).sum(axis=0), hot.sum(axis=0), hot.T @ square, hot.T @ x)
        return np.concatenate([np.ravel(p) for p in parts])

    got = added(rows.select("x", "xl"), first)
    if not np.ndim(got):
        return rows.sparkSession.createDataFrame([], "setting int, explained double, silhouette double, inconsistency double")
    n, mean, square, within, su, su2, hn, hs, hx = np.split(got, np.cumsum([1, dims, 1, count, count * k, count * k, count * k, count * k]))
    n, mean = n[0], mean / n[0]
    hn = hn.reshape(count, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        explained = 1 - within / (square[0] - n * mean @ mean)
        hm, hs = hx.reshape(count, k, dims) / hn[:, :, None], hs.reshape(count, k) / hn  # nan in empty clusters

    def second(x: np.ndarray, xl: np.ndarray) -> np.ndarray:
        u = _shares(x, xl, c, m, alpha)
        own, order = u.argmax(axis=2), np.sort(u, axis=2)
        lead = order[:, :, -1] - order[:, :, -2]
        with np.errstate(divide="ignore", invalid="ignore"):
            far = (x**2).sum(axis=1)[:, None, None] - 2 * (x @ np.nan_to_num(hm).reshape(-1, dims).T).reshape(u.shape) + hs[None]
            far = np.where(hn[None] > 0, far, np.inf)
            mine = (own[:, :, None] == np.arange(k)[None, None])
            size = (mine * hn[None]).sum(axis=2)
            a = np.where(mine, far, 0).sum(axis=2) * size / (size - 1)
            b = np.where(mine, np.inf, far).min(axis=2)
            value = np.where((size > 1) & np.isfinite(b) & (np.maximum(a, b) != 0), (b - a) / np.maximum(a, b), 0.0)
        return np.concatenate([(lead * value).sum(axis=0), lead.sum(axis=0)])

    value, lead = added(rows.select("x", "xl"), second).reshape(2, count)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, xl in _chunks(batches, key, "x", "xl"):
            yield pa.RecordBatch.from_pydict({key: pa.array(ids, pa.int64()), "u": pa.array(list(_shares(x, xl, c, m, alpha).reshape(len(x), -1)), pa.list_(pa.float64()))})

    u = cut(rows.select(F.col(key).cast("long"), "x", "xl").mapInArrow(shares, f"{key} long, u array<double>"))
    met = edges.select("src", "dst", "w").join(u.select(F.col(key).alias("src"), F.col("u").alias("ua")), "src").join(u.select(F.col(key).alias("dst"), F.col("u").alias("ub")), "dst")
    apart = lambda w, a, b: np.append((w[:, None] * ((a - b) ** 2).reshape(len(w), count, k).sum(axis=2)).sum(axis=0), w.sum())
    found = added(met.select("w", "ua", "ub"), apart)
    spread = ((su2 / n - (su / n) ** 2).reshape(count, k).sum(axis=1)) * 2 * n / (n - 1) if n > 1 else np.full(count, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        uneven = found[:count] / (found[count] * spread) if np.ndim(found) else np.full(count, np.nan)
        columns = (explained, value / lead, uneven)
    out = [(i, *[float(v[i]) if np.isfinite(v[i]) else None for v in columns]) for i in range(count)]
    return rows.sparkSession.createDataFrame(out, "setting int, explained double, silhouette double, inconsistency double")


def spatial_blocks(points: DataFrame, k: int = 4, seed: int = 1, starts: int = 10, key: str = "hex_id") -> DataFrame:
    """(key, block): k-means on places, the best of several starts; no more blocks than different places."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = cut(points.select(key, F.col("x").cast("double"), F.col("y").cast("double")))
    k = min(k, rows.select("x", "y").distinct().limit(k).count())
    if k < 2:  # one place, or none
        return rows.select(key, F.lit(0).alias("block"))
    rows = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows)
    best = None
    for s in range(starts):
        model = KMeans(k=k, seed=seed + s, predictionCol="block").fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(rows).select(key, "block")
