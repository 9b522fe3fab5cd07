"""ln |I - rho W| of a sparse weight table, for spatial likelihoods.

Exact, by nested dissection of the lattice: cells are dealt to square tiles, a tile eliminates the cells whose
neighbours all lie in it, and what is left of four tiles (their rims, joined by the Schur complement) goes to the
tile that holds them. Each level is one grouped pass over tiles; a task meets one front, whose size is the length of a
rim and not the area inside. All values of rho are carried together.

Where fronts would be too large (a grid of some millions of cells), by Lanczos quadrature: random signs, one product with
the weights a step, and the quadrature of each probe held to the known traces of W and W²; the error that comes with it
is two standard errors over the probes and what the last steps still changed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: A tile of the first level has 2**LEAF cells on a side.
LEAF = 4
#: Largest front that is factorised: a square matrix of 8 bytes a number in one task.
FRONT = 4096
SCHUR = "rho int, tx long, ty long, ids array<long>, last array<int>, m binary, part double"


def lattice(edges: DataFrame, places: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, int]:
    """Cells (id, q, r, last) and edges (src, dst, w, q, r, level), both written, and the number of levels.

    ``level`` is the first level at which both ends of an edge lie in one tile; ``last`` is the level at which all neighbours
    of a cell do, so that it can be eliminated. ``places`` has (id, q, r), integers from which tiles follow.
    """
    low = places.agg(F.min("q"), F.min("r")).first()
    at = places.select("id", (F.col("q") - F.lit(low[0] or 0)).cast("long").alias("q"), (F.col("r") - F.lit(low[1] or 0)).cast("long").alias("r"))
    both = edges.join(at.withColumnsRenamed({"id": "src"}), "src").join(at.withColumnsRenamed({"id": "dst", "q": "q2", "r": "r2"}), "dst")
    apart = F.col("q").bitwiseXOR(F.col("q2")).bitwiseOR(F.col("r").bitwiseXOR(F.col("r2")))
    level = F.greatest(F.when(apart > 0, F.length(F.bin(apart))).otherwise(0) - leaf, F.lit(0))
    e = cut(both.select("src", "dst", "w", "q", "r", level.cast("int").alias("level")))
    last = e.select(F.col("src").alias("id"), "level").unionAll(e.select(F.col("dst").alias("id"), "level")).groupBy("id").agg(F.max("level").alias("last"))
    cells = cut(at.join(last, "id", "left").withColumn("last", F.coalesce("last", F.lit(0))))
    top = cells.agg(F.max("last")).first()[0]
    return cells, e, 1 + (top or 0)


def largest_front(cells: DataFrame, levels: int, leaf: int = LEAF) -> int:
    """Cells that the largest tile of any level still holds."""
    at = cells.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("last"))))
    tiles = at.groupBy("s", *[F.expr(f"shiftright({c}, s + {leaf})").alias(c) for c in ("q", "r")]).agg(F.count("*").alias("n"))
    return tiles.agg(F.max("n")).first()[0] or 0


def _eliminated(m: np.ndarray, goes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln |A| of the block that goes, and the Schur complement of the rest, for a stack of matrices."""
    a, b = m[:, goes][:, :, goes], m[:, goes][:, :, ~goes]
    c, d = m[:, ~goes][:, :, goes], m[:, ~goes][:, :, ~goes]
    if not goes.any():
        return np.zeros(len(m)), d
    sign, part = np.linalg.slogdet(a)
    part = np.where(sign > 0, part, np.nan)
    return part, d - c @ np.linalg.solve(a, b) if (~goes).any() else d


def _answer(rhos: Sequence[int], tx: int, ty: int, ids: np.ndarray, last: np.ndarray, goes: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    part, rest = _eliminated(m, goes)
    k, left = len(rhos), ids[~goes]
    return pd.DataFrame(
        {"rho": list(rhos), "tx": [tx] * k, "ty": [ty] * k, "ids": [left] * k, "last": [last[~goes]] * k, "m": [x.tobytes() for x in rest], "part": part}
    )


def dissected(cells: DataFrame, edges: DataFrame, levels: int, rhos: Sequence[float], leaf: int = LEAF) -> list[float]:
    """ln |I - rho W| for each of ``rhos``, exact, of what ``lattice`` returns; NaN where the matrix is not positive."""
    rho = np.array(rhos, dtype=float)

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["dst"].isna()].drop_duplicates("src").sort_values("src")
        ids, last = own["src"].to_numpy("int64"), own["last"].to_numpy("int32")
        w = np.zeros((len(ids), len(ids)))
        e = rows[rows["dst"].notna()]
        np.add.at(w, (np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"].to_numpy("int64"))), e["w"])
        m = np.eye(len(ids)) - rho[:, None, None] * w
        return _answer(range(len(rho)), key[0], key[1], ids, last, last == 0, m)

    def merge(level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            fronts, e = rows[rows["m"].notna()], rows[rows["m"].isna()]
            ids = np.concatenate([*map(np.asarray, fronts["ids"]), []]).astype("int64")
            last = np.concatenate([*map(np.asarray, fronts["last"]), []]).astype("int32")
            order = np.argsort(ids)
            ids, last, m, at = ids[order], last[order], np.zeros((1, len(ids), len(ids))), 0
            for x in fronts.itertuples():
                k = np.searchsorted(ids, np.asarray(x.ids))
                m[0][np.ix_(k, k)] += np.frombuffer(x.m).reshape(len(k), len(k))
            np.add.at(m[0], (np.searchsorted(ids, e["src"].to_numpy("int64")), np.searchsorted(ids, e["dst"].to_numpy("int64"))), -rho[key[0]] * e["w"].to_numpy())
            return _answer([key[0]], key[1], key[2], ids, last, last == level, m)

        return run

    def tile(c: str, s: int) -> Column:
        return F.shiftright(c, leaf + s)

    corners = cells.select(tile("q", 0).alias("tx"), tile("r", 0).alias("ty"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("w"), "last")
    inner = edges.where("level = 0").select(tile("q", 0).alias("tx"), tile("r", 0).alias("ty"), "src", "dst", "w", F.lit(0).alias("last"))
    front = cut(corners.unionAll(inner).groupBy("tx", "ty").applyInPandas(first, SCHUR))
    total = np.zeros(len(rho))

    def add(front: DataFrame) -> None:
        for x in front.groupBy("rho").agg(F.sum("part").alias("part")).collect():
            total[x["rho"]] += x["part"]

    add(front)
    for s in range(1, levels):
        # four tiles to one; a tile whose cells are all gone sends nothing on
        up = front.where(F.size("ids") > 0).select("rho", F.shiftright("tx", 1).alias("tx"), F.shiftright("ty", 1).alias("ty"), "ids", "last", "m", F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("w"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("last", "array<int>"), ("m", "binary"))]
        across = edges.where(F.col("level") == s).select(F.explode(F.sequence(F.lit(0), F.lit(len(rho) - 1))).alias("rho"), tile("q", s).alias("tx"), tile("r", s).alias("ty"), *none, "src", "dst", "w")
        front = cut(up.unionAll(across).groupBy("rho", "tx", "ty").applyInPandas(merge(s), SCHUR))
        add(front)
    return total.tolist()


def lanczos(edges: DataFrame, cells: DataFrame, steps: int = 24, probes: int = 16, seed: int = 3) -> Callable[[Sequence[float]], tuple[list[float], list[float]]]:
    """A function of rho that estimates ln |I - rho W| and its error, for W whose rows are a symmetric table divided by
    its row sums. All work on the table is done here.

    ``cells`` has (id). The weights of both directions of an edge give the symmetric table that has the same
    eigenvalues; an edge without its reverse is an error.
    """
    base = cut(cells.select("id").distinct())
    e = cut(edges.select("src", "dst", "w").join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v")), ["src", "dst"], "left").select("src", "dst", F.sqrt(F.col("w") * F.col("v")).alias("s")))
    known = e.agg(F.sum(F.col("s") * F.col("s")), F.count_if(F.col("s").isNull())).first()
    if known[1]:
        raise ValueError("quadrature needs weights that run both ways")
    n, square = base.count(), known[0] or 0.0
    cols = [f"z{p}" for p in range(probes)]
    unit = 1 / math.sqrt(max(n, 1))
    now = cut(base.select("id", *[F.when(F.xxhash64(F.lit(seed), F.lit(p), "id") % 2 == 0, unit).otherwise(-unit).alias(c) for p, c in enumerate(cols)]))
    before, alpha, beta = None, [], []
    for _ in range(min(steps, n)):
        product = e.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("s") * F.col(c)).alias("u" + c) for c in cols])
        both = now.join(product, "id", "left").na.fill(0.0)
        if before is not None:
            both = both.join(before.select("id", *[F.col(c).alias("p" + c) for c in cols]), "id")
            both = both.withColumns({"u" + c: F.col("u" + c) - float(b) * F.col("p" + c) for c, b in zip(cols, beta[-1], strict=True)})
        both = cut(both.select("id", *cols, *["u" + c for c in cols]))
        a = np.array(both.agg(*[F.sum(F.col(c) * F.col("u" + c)).alias(c) for c in cols]).first(), dtype=float)
        rest = both.select("id", *cols, *[(F.col("u" + c) - float(x) * F.col(c)).alias("u" + c) for c, x in zip(cols, a, strict=True)])
        b = np.sqrt(np.array(rest.agg(*[F.sum(F.col("u" + c) * F.col("u" + c)).alias(c) for c in cols]).first(), dtype=float))
        alpha.append(a)
        beta.append(b)
        before, now = now, cut(rest.select("id", *[(F.col("u" + c) / float(x) if x > 1e-9 else F.lit(0.0)).alias(c) for c, x in zip(cols, b, strict=True)]))
    a, b = np.array(alpha), np.array(beta)

    def at(rho: float, size: int) -> np.ndarray:
        out = []
        for p in range(probes):
            k = next((i + 1 for i in range(size) if b[i, p] <= 1e-9), size)
            t = np.diag(a[:k, p]) + np.diag(b[: k - 1, p], 1) + np.diag(b[: k - 1, p], -1)
            theta, vectors = np.linalg.eigh(t)
            tau, f = vectors[0] ** 2, np.log1p(-rho * np.clip(theta, -1, 1))
            # the part that a parabola explains is replaced by its known trace
            fit = np.polynomial.polynomial.polyfit(theta, f, min(2, k - 1), w=np.sqrt(tau))
            fit = np.append(fit, np.zeros(3 - len(fit)))
            out.append(n * float(tau @ (f - fit[1] * theta - fit[2] * theta**2)) + fit[2] * square)
        return np.array(out)

    def values(rhos: Sequence[float]) -> tuple[list[float], list[float]]:
        x, earlier = (np.array([at(r, k) for r in rhos]) for k in (len(a), max(1, len(a) - 4)))
        error = 2 * x.std(axis=1, ddof=1) / math.sqrt(probes) + np.abs(x.mean(axis=1) - earlier.mean(axis=1))
        return x.mean(axis=1).tolist(), error.tolist()

    return values


#: Interpolation runs over atanh(rho): in it ln |I - rho W| has no singularity nearer than pi / 2 to the real line.
HIGH = math.atanh(0.999)


@dataclass
class Determinant:
    """ln |I - rho W| as a function, from values at few points: ``compute`` gives values and errors for a list of rho."""

    compute: Callable[[Sequence[float]], tuple[list[float], list[float]]]
    nodes: int = 32
    high: float = HIGH
    _pieces: list[tuple[float, float, np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._add([(-self.high, self.high, self.nodes)])

    def _add(self, spans: Sequence[tuple[float, float, int]]) -> None:
        t = [(low + high) / 2 + (high - low) / 2 * np.cos(np.pi * (np.arange(n) + 0.5) / n) for low, high, n in spans]
        values = np.array(self.compute(np.tanh(np.concatenate(t)).tolist())[0])
        for (low, high, n), x in zip(spans, t, strict=True):
            self._pieces.insert(0, (low, high, x, values[:n]))
            values = values[n:]

    def refine(self, rhos: Sequence[float], half: float = 0.1, nodes: int = 7) -> None:
        """Narrow pieces around ``rhos``, used before the others."""
        self._add([(math.atanh(r) - half, math.atanh(r) + half, nodes) for r in rhos])

    def __call__(self, rho: float) -> float:
        t = math.atanh(rho)
        _, _, x, y = next((p for p in self._pieces if p[0] <= t <= p[1]), self._pieces[-1])
        d = t - x
        if (d == 0).any():
            return float(y[np.argmin(np.abs(d))])
        n = len(x)
        w = (-1.0) ** np.arange(n) * np.sin(np.pi * (np.arange(n) + 0.5) / n) / d
        return float((w @ y) / w.sum())


def determinant(edges: DataFrame, cells: DataFrame, key: str, place: tuple[str, str] | None, front: int = FRONT) -> Determinant:
    """Of the weights between ``cells`` (key, and the two columns of ``place``): exact where places are known and no front
    is larger than ``front``, else by quadrature."""
    if place:
        at = cells.select(F.col(key).alias("id"), F.col(place[0]).alias("q"), F.col(place[1]).alias("r"))
        c, e, levels = lattice(edges, at)
        if largest_front(c, levels) <= front:
            return Determinant(lambda rhos: (dissected(c, e, levels, rhos), [0.0] * len(rhos)))
    return Determinant(lanczos(edges, cells.select(F.col(key).alias("id"))))
