"""Exact top-k search by inner product with MaxScore, in shards of neighbouring vectors.

Vectors are whole numbers. A query has one term for each component. A shard holds vectors that are nearest to the
same pivot (a bounded sample of vectors), and what each term can add in it at most. A query is first answered in the
shard that would be its own; its k-th score there is the bar for all others. It goes on to the shards whose bound
reaches the bar: the sum of what the terms can add, or what the distance of the vectors from their mean allows.

In a shard, a term's posting list holds the vectors whose contribution is above the term's floor, sorted by component:
the head of the order for a negative weight, the tail for a positive one. With the terms in the order of what they
can add, the first ones are essential: those without which no vector reaches the bar. If their lists hold
fewer vectors than the shard, these postings are traversed, else all of it; the other terms are probed, some at a
time, only for the vectors that still compete, by what the rest of the terms can add and by the lengths
of the rest of both vectors. The best of all shards are merged by rank. Sums are of whole numbers, so results are exact;
ties go to the smaller id.

Shards stay where they are and are moved once (once for each lane of ``LANE`` blocks of queries); queries, a fiftieth
of the vectors in the registered query, are sent to them in blocks of ``QUERY_BLOCK``.

Defined cases: null vectors and vectors with null or non-finite components take no part, nor do those with a
null id; vectors of another length than the query's are no candidates for it; equal ids are searched as they
are, only rows with the query's own id are no candidates; shards with components over ``LARGEST`` are summed in
numbers of any size, and a score that does not fit in 64 bits is an error; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

QUERY_BLOCK = 512
SHARD = 4096
#: Blocks of queries that one task takes to a shard.
LANE = 64
#: Vectors that shards are built around, at most; and the vectors for each of them, at least.
PIVOTS = 256
AROUND = 1024
#: Whole numbers up to this give sums of products that fit in 64 bits for vectors of up to 512 components.
LARGEST = 1 << 27
#: The share of a shard that a posting list holds, and the terms that are probed at once.
POSTED = 0.125
PROBE = 8


def _bound(v: np.ndarray) -> np.ndarray:
    """Floating sums that bound whole numbers from above, rounding allowed for."""
    return v + np.abs(v) * 1e-9 + 1.0


def whole(raw: bytes, size: int) -> np.ndarray:
    """Vectors as 64-bit whole numbers, or where these might overflow as Python's."""
    x = np.frombuffer(raw, dtype="<f8").reshape(-1, size)
    if not len(x) or np.abs(x).max() <= LARGEST:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)


class Shard:
    """Vectors of one shard with their posting orders; counts the vectors whose scores it has summed to the end."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.scored = ids[order], x[order], 0
        self.by_term = np.ascontiguousarray(self.x.T)
        real = self.by_term.astype(np.float64)
        self.order = np.argsort(real, axis=1, kind="stable")
        n = len(ids)
        self.posted = max(1, int(n * POSTED))
        at = np.arange(x.shape[1])
        value = lambda k: real[at, self.order[:, k]]
        self.low, self.high = value(0), value(-1)
        self.floor_up, self.floor_down = value(n - 1 - min(self.posted, n - 1)), value(min(self.posted, n - 1))
        self.squares = real * real
        self.norm = self.squares.sum(axis=0)

    def postings(self, term: int, weight: int) -> np.ndarray:
        return self.order[term, -self.posted :] if weight > 0 else self.order[term, : self.posted]

    def search(self, own: int, q: np.ndarray, k: int, known: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) of this shard among those that reach ``known``."""
        real = q.astype(np.float64)
        top = real * np.where(real > 0, self.high, self.low)
        terms = np.argsort(-np.abs(real) * (self.high - self.low), kind="stable")  # those that tell the most first
        if known is None:
            known = self._first(own, q, k, terms)
        rest = np.concatenate([np.cumsum(top[terms][::-1])[::-1], [0.0]])
        rows = np.arange(len(self.ids))
        if known is not None:
            floor = real * np.where(real > 0, self.floor_up, self.floor_down)
            absent = np.concatenate([[0.0], np.cumsum(floor[terms])]) + rest  # in none of the first lists
            enough = np.flatnonzero(_bound(absent) < known)
            if len(enough):
                if enough[0] == 0:
                    return []
                inside = np.zeros(len(rows), dtype=bool)
                for t in terms[: enough[0]]:
                    inside[self.postings(t, q[t])] = True
                    if inside.sum() * 2 > len(rows):  # no cheaper than all of them
                        inside[:] = True
                        break
                rows = np.flatnonzero(inside)
        score = np.zeros(len(rows), dtype=self.by_term.dtype)
        left = self.norm[rows]
        q_left = float((real * real).sum())
        for i in range(0, len(terms), PROBE):
            part = terms[i : i + PROBE]
            whole_ = len(rows) == len(self.ids)
            score = score + q[part] @ (self.by_term[part] if whole_ else self.by_term[part][:, rows])
            if known is not None and len(rows) and i + PROBE < len(terms):
                left = left - (self.squares[part] if whole_ else self.squares[part][:, rows]).sum(axis=0)
                q_left -= float((real[part] ** 2).sum())
                reach = np.sqrt(np.maximum(left, 0.0) * max(q_left, 0.0) * (1 + 1e-9)) + 1e-6 * self.norm[rows] ** 0.5 * np.sqrt((real * real).sum())
                open_ = _bound(score.astype(np.float64) + np.minimum(rest[i + PROBE], reach)) >= known
                if open_.sum() < 0.8 * len(rows):
                    rows, score, left = rows[open_], score[open_], left[open_]
        self.scored += len(rows)
        return merged([], score, self.ids[rows], own, k)

    def _first(self, own: int, q: np.ndarray, k: int, terms: np.ndarray) -> int | None:
        """A first bar: the k-th score among the heads of some posting lists."""
        seed = np.unique(np.concatenate([self.postings(t, q[t])[:: 1 if q[t] < 0 else -1][: 4 * k] for t in terms[:8]]))
        self.scored += len(seed)
        found = merged([], self.x[seed] @ q, self.ids[seed], own, k)
        return found[k - 1][0] if len(found) >= k else None


def merged(best: list[tuple[int, int]], score: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best of ``best`` and of the scored ids, without the query's own id."""
    keep = ids != own
    score, ids = score[keep], ids[keep]
    if len(score) > k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= bar
        score, ids = score[keep], ids[keep]
    both = best + list(zip(score.tolist(), ids.tolist(), strict=True))
    return sorted(both, key=lambda b: (-b[0], b[1]))[:k]


def _near_pivots(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(size, pivot, vec_id, v) of both: the number of the pivot of the same length that a vector is nearest to."""
    hashed = F.xxhash64("vec_id")
    n = max(1, min(PIVOTS, vectors.count() // AROUND))
    taken = vectors.select(hashed.alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(n).collect()
    by_size: dict[int, list[list[float]]] = {}
    for r in taken:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    pivots = vectors.sparkSession.sparkContext.broadcast({n: np.array(v).reshape(-1, n) for n, v in by_size.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for size, y in x.groupby(x["v"].map(len)):
                v, p = np.array(y["v"].to_list(), dtype=np.float64).reshape(-1, size), pivots.value.get(size)
                near = np.zeros(len(y), dtype=np.int32) if p is None or not size else ((p * p).sum(axis=1)[None, :] - 2 * v @ p.T).argmin(axis=1)
                yield y.assign(size=np.int32(size), pivot=near.astype(np.int32))[["size", "pivot", "vec_id", "v"]]

    of = lambda df: df.select("vec_id", "v").mapInPandas(run, "size int, pivot int, vec_id long, v array<double>")
    return of(vectors), of(queries)


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of vectors: ids, and vectors as little-endian doubles (whole numbers)."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        v = np.array(x["v"].to_list(), dtype="<f8").reshape(len(x), -1)
        return pd.DataFrame([(*(int(x[k].iat[0]) for k in keys), x["vec_id"].to_numpy("<i8").tobytes(), v.tobytes())], columns=[*keys, "ids", "vectors"])

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} int" for k in keys) + ", ids binary, vectors binary")





def _search(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, scored) of query blocks (size, shard, block, ids, vectors, bars) in their shards (size, shard,
    ids, vectors). Rows of a shard come together: its vectors first, then block after block."""
    lane = (F.col("block") / LANE).cast("int")
    lanes = asked.select("size", "shard", lane.alias("lane")).distinct()
    held = shards.join(lanes, ["size", "shard"]).select(F.lit(0).alias("kind"), "size", "shard", "lane", F.lit(-1).alias("block"), "ids", "vectors", F.lit(None).cast("binary").alias("bars"))
    sent = asked.select(F.lit(1).alias("kind"), "size", "shard", lane.alias("lane"), "block", "ids", "vectors", "bars")
    both = held.unionAll(sent).repartition(partitions(shards.sparkSession), "size", "shard", "lane").sortWithinPartitions("size", "shard", "lane", "kind", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for x in batches:
            for r in x.itertuples(index=False):
                ids, v = np.frombuffer(r.ids, dtype="<i8"), whole(r.vectors, r.size)
                if r.kind == 0:
                    shard = Shard(ids, v)
                    continue
                bars = [None] * len(ids) if r.bars is None else [None if np.isnan(b) else int(np.floor(b)) for b in np.frombuffer(r.bars, "<f8")]
                out = []
                for i, q, bar in zip(ids.tolist(), v, bars, strict=True):
                    if q.dtype != shard.x.dtype:
                        q = q.astype(object)
                    before = shard.scored
                    hits = shard.search(i, q, k, bar)
                    if any(abs(s) >= 2**63 for s, _ in hits):
                        raise OverflowError("a score does not fit in 64 bits")
                    out += [(i, j, int(s), 0) for s, j in hits] + [(i, None, None, shard.scored - before)]  # the last row counts
                yield pd.DataFrame({c: pd.array([o[n] for o in out], dtype="Int64") for n, c in enumerate(("query_id", "vec_id", "score", "scored"))})

    return both.mapInPandas(run, "query_id long, vec_id long, score long, scored long")


def _reached(shards: DataFrame, asked: DataFrame) -> DataFrame:
    """Query blocks (size, block, homes, ids, vectors, bars) once for each shard that some of their queries go on to, with
    those queries alone. Bounds of shards meet blocks of queries in chunks of each."""

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for r in x.itertuples(index=False):
                v = np.frombuffer(r.vectors, dtype="<f8").reshape(-1, r.size)
                mean = v.mean(axis=0)
                far = np.sqrt(((v - mean) ** 2).sum(axis=1).max())
                out.append((r.size, r.shard, np.concatenate([v.min(axis=0), v.max(axis=0), mean, [far]]).astype("<f8").tobytes()))
            yield pd.DataFrame(out, columns=["size", "shard", "bounds"])

    known = shards.mapInPandas(bounds, "size int, shard int, bounds binary").withColumn("chunk", (F.col("shard") / 256).cast("int"))
    known = known.groupBy("size", "chunk").agg(F.collect_list(F.struct("shard", "bounds")).alias("known"))  # 256 rows of bounds

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples(index=False):
                ids, q, bars, homes = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vectors, "<f8").reshape(-1, r.size), np.frombuffer(r.bars, "<f8"), np.frombuffer(r.homes, "<i4")
                length = np.sqrt((q * q).sum(axis=1))
                out = []
                for s in r.known:
                    b = np.frombuffer(s["bounds"], "<f8")
                    low, high, mean, far = b[: r.size], b[r.size : 2 * r.size], b[2 * r.size : 3 * r.size], b[-1]
                    most = np.minimum(np.maximum(q, 0) @ high + np.minimum(q, 0) @ low, q @ mean + length * far)
                    on = np.flatnonzero(((_bound(most) >= bars) | np.isnan(bars)) & (homes != s["shard"]))
                    if len(on):
                        out.append((r.size, s["shard"], r.block, ids[on].tobytes(), q[on].tobytes(), bars[on].tobytes()))
                yield pd.DataFrame(out, columns=["size", "shard", "block", "ids", "vectors", "bars"])

    return asked.join(known, "size").mapInPandas(go, "size int, shard int, block int, ids binary, vectors binary, bars binary")


def _hits(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, scored): the k best of each shard that a query has gone to, and a row for the visit that says
    how many vectors it has scored."""
    near, asked = _near_pivots(vectors, queries)
    near, asked = cut(near), cut(asked)
    # numbers of shards: parts of at most some SHARD vectors of each pivot
    counts = near.groupBy("size", "pivot").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))  # a row a pivot
    before = Window.partitionBy("size").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("from", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int")))
    part = (F.col("from") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard")
    shards = cut(_packed(near.join(F.broadcast(counts), ["size", "pivot"]).select("size", part, "vec_id", "v"), ["size", "shard"]))
    home = asked.join(F.broadcast(counts), ["size", "pivot"]).select("size", part, "vec_id", "v")
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))).cast("int").alias("block")
    at_home = cut(_packed(home.select("size", "shard", block, "vec_id", "v"), ["size", "shard", "block"]).withColumn("bars", F.lit(None).cast("binary")))
    first = cut(_search(shards, at_home, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bars = first.withColumn("n", F.row_number().over(order)).where(f"n = {k} and score is not null").select(F.col("query_id").alias("vec_id"), F.col("score").alias("bar"))

    def packed(x: pd.DataFrame) -> pd.DataFrame:
        v = np.array(x["v"].to_list(), dtype="<f8").reshape(len(x), -1)
        bars_ = x["bar"].to_numpy(dtype=np.float64, na_value=np.nan)
        bars_ = np.nextafter(bars_, -np.inf)  # a score of over 53 bits may have been rounded up
        return pd.DataFrame([(int(x["size"].iat[0]), int(x["block"].iat[0]), x["shard"].to_numpy("<i4").tobytes(), x["vec_id"].to_numpy("<i8").tobytes(), v.tobytes(), bars_.astype("<f8").tobytes())], columns=["size", "block", "homes", "ids", "vectors", "bars"])

    rows = home.join(bars.dropDuplicates(["vec_id"]), "vec_id", "left").select("size", "shard", block, "vec_id", "v", F.col("bar").cast("double").alias("bar"))
    again = rows.groupBy("size", "block").applyInPandas(packed, "size int, block int, homes binary, ids binary, vectors binary, bars binary")
    return first.unionAll(_search(shards, cut(_reached(shards, again)), k))


def _small_batches(df: DataFrame, run):
    """``run()`` with Arrow batches of few rows, for rows are whole shards here; the setting is put back in any case."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "16")
    try:
        return cut(run())
    finally:
        conf.set(name, before)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (vec_id, v) the k best of ``vectors`` (vec_id, v),
    v arrays of whole numbers, given as doubles."""
    hits = _small_batches(vectors, lambda: _hits(vectors, queries, k)).where("score is not null").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored_share(vectors: DataFrame, queries: DataFrame, k: int = 5) -> float:
    """The share of all pairs of a query and a vector whose score is summed to the end."""
    scored = _small_batches(vectors, lambda: _hits(vectors, queries, k)).agg(F.sum("scored")).first()[0]
    return (scored or 0) / max(1, vectors.count() * queries.count())


def whole_numbers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), whole numbers as doubles; vectors that are null or hold null, NaN or
    infinity go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), x.alias("x"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    down = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)  # noqa: E731  larger doubles are whole
    return rows.where(~F.exists("x", bad)).select("vec_id", F.transform("x", lambda c: down(c * scale)).alias("v"))


#: DuckDB: every query against every vector.
SQL = """
with v as (select vec_id, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as v from embeddings
           where vec_id is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
