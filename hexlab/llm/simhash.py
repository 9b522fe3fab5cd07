"""SimHash near-duplicates by anchor points of a covering code.

Fingerprint: 64 bits, a bit is 1 if it is set in over half of the XXH64 (seed 42) of the word shingles,
repeats counted. Words are runs without ASCII white space, A-Z lower-cased; with fewer words than a
shingle takes, the whole sequence is the one shingle; without words (or null) the fingerprint is 0.

Links at ``threshold`` T or fewer differing bits. The 64 bits are cut in T // 2 + 1 blocks; two linked
fingerprints differ by at most one bit in one of the blocks. Over each block the anchors are the words of a
covering code: for T <= 3 the perfect Hamming [31,26] code times the free 32nd bit, radius R = 1; on the
narrow blocks of larger T every word, R = 0. Each fingerprint has one home anchor within R of its block,
and is replicated to every anchor within R + 1; at an anchor, homes meet visitors. A pair that differs
by one bit or less in a block therefore meets at both homes, whatever the other blocks are.

``wide`` adds 64 bits, made from the same hashes by a fixed mixing, which take no part in the search: a
pair links only if all 128 bits differ in at most ``wide`` places. That is what a threshold for near copies
of five-word similarity 0.8 needs (their 64 bits differ in 5 to 14 places), for at such a threshold chance
alone would link some of many fingerprints.

Every distinct fingerprint takes part once, so copies cost nothing; an anchor with more than ``BLOCK``
members is dealt in blocks of visitors, homes going to each. A task returns a spanning forest of the links
that it found, never the pairs of a group. With T = 3 an anchor holds 33 / 2**28 of all distinct
fingerprints, with T = 11 it holds 72 / 12288: the larger threshold is for tables of up to some 10**8.

Defined cases: copies have one fingerprint and one component; equal doc_ids are one document; rows with a
null doc_id link to nothing and have a null component; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, cut, partitions, small_batches

#: Members of an anchor that one task compares; larger anchors are dealt over several.
BLOCK = 4096
#: Comparisons and links held at once.
CHUNK = 1 << 17
#: Bits of every byte value, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits from each hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-shingle]))
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    hashes = shingle_hashes(text, shingle, seed)
    return majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, second: bool = False) -> DataFrame:
    """(doc_id, fp, fp2) of every row: the fingerprint as a signed 64-bit number; fp2 is 0 unless ``second``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            both = np.zeros((len(x), 2), dtype=np.uint64)
            for i, t in enumerate(x["text"]):
                if len(hashes := shingle_hashes(t, shingle, seed)):
                    both[i] = majority(hashes), majority(mixed(hashes)) if second else 0
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "fp": both[:, 0].astype(np.int64), "fp2": both[:, 1].astype(np.int64)})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fp long, fp2 long")


def _code() -> tuple[np.ndarray, np.ndarray]:
    """For a syndrome s: the masks that turn a word into the code words within distance 2 (0 means: none)."""
    masks = np.zeros((32, 16), dtype=np.uint32)
    for s in range(1, 32):
        masks[s, 0] = 1 << (s - 1)
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        masks[s, 1 : 1 + len(pairs)] = [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]
    used = masks > 0
    used[0, 0] = True  # a code word is its own anchor
    return masks, used


MASKS, USED = _code()


def _syndrome(words: np.ndarray) -> np.ndarray:
    s = np.zeros(words.shape, dtype=np.uint32)
    for k in range(5):
        check = np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1))
        s |= (np.bitwise_count(words & check).astype(np.uint32) & 1) << k
    return s


def anchors_of(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchors and home marks of fingerprints: anchor = block number * 2**32 + code word."""
    rows, keys, homes = [], [], []
    blocks = threshold // 2 + 1
    edges = [round(64 * b / blocks) for b in range(blocks + 1)]
    for b in range(blocks):
        width = edges[b + 1] - edges[b]
        part = (fp >> np.uint64(edges[b]) & np.uint64((1 << width) - 1)).astype(np.uint64)
        if width == 32:
            part = part.astype(np.uint32)
            free, word = part & np.uint32(1 << 31), part & np.uint32((1 << 31) - 1)
            s = _syndrome(word)
            near = (word[:, None] ^ MASKS[s]) | free[:, None]
            other = near[:, :1] ^ np.uint32(1 << 31)  # the free bit differs: then the 31 bits agree
            key = np.concatenate([near, other], axis=1)
            mark = np.concatenate([USED[s], np.ones((len(fp), 1), bool)], axis=1)
        else:
            key = part[:, None] ^ np.array([0, *(1 << k for k in range(width if threshold else 0))], dtype=np.uint64)
            mark = np.ones(key.shape, bool)
        home = np.zeros(mark.shape, bool)
        home[:, 0] = True
        rows.append(np.broadcast_to(np.arange(len(fp))[:, None], mark.shape)[mark])
        keys.append(key.astype(np.int64)[mark] + (b << 32))
        homes.append(home[mark])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root of each of n nodes under links (a, b): the smallest node of its component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[a] != root[b]
        low = np.minimum(root[a[open_]], root[b[open_]])
        high = np.maximum(root[a[open_]], root[b[open_]])
        a, b = high, low
    return root


def linked(fp: np.ndarray, fp2: np.ndarray, node: np.ndarray, group: np.ndarray, home: np.ndarray, threshold: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between homes and visitors of each run of equal ``group``."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((first, [len(group)])))
    nth = np.repeat(np.arange(len(first)), size)
    at = np.flatnonzero(home & (size[nth] > 1))
    values, number = np.unique(node, return_inverse=True)
    width = size[nth[at]]
    ends = np.cumsum(width)
    found_a, found_b, i = [], [], 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, side="right")))
        w = width[i:j]
        h = np.repeat(at[i:j], w)
        v = np.arange(len(h)) - np.repeat(np.cumsum(w) - w - first[nth[at[i:j]]], w)
        bits = np.bitwise_count(fp[h] ^ fp[v])
        near = np.flatnonzero((bits <= threshold) & (h != v))
        near = near[bits[near] + np.bitwise_count(fp2[h[near]] ^ fp2[v[near]]) <= wide]
        a, b = number[h[near]], number[v[near]]
        root = forest(a, b, len(values)) if len(a) else None
        if root is not None:
            a = np.unique(np.concatenate((a, b)))
            a = a[root[a] != a]
            found_a.append(a)
            found_b.append(root[a])
        i = j
    if not found_a:
        return values[:0], values[:0]
    root = forest(np.concatenate(found_a), np.concatenate(found_b), len(values))
    a = np.flatnonzero(root != np.arange(len(values)))
    return values[a], values[root[a]]


def near_links(distinct: DataFrame, threshold: int = 3, wide: int | None = None) -> DataFrame:
    """Links (a, b) between nodes of ``distinct`` (node, fp, fp2) that connect all that are near enough."""
    if not 0 <= threshold < 20:
        raise ValueError("blocks of at least 6 bits carry thresholds under 20")
    wide = 128 if wide is None else wide

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for i in range(0, len(x), 1024):
                part = x.iloc[i : i + 1024]
                row, key, home = anchors_of(part["fp"].to_numpy(np.int64).view(np.uint64), threshold)
                yield pd.DataFrame({"anchor": key, "home": home} | {k: part[k].to_numpy(np.int64)[row] for k in ("node", "fp", "fp2")})

    rows = distinct.select("node", "fp", "fp2").mapInPandas(spread, "anchor long, home boolean, node long, fp long, fp2 long")
    large = rows.groupBy("anchor").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
    large = cut(large.select("anchor", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    dealt = rows.join(large, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    block = F.explode(F.when(F.col("home") & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    dealt = dealt.select("anchor", block.alias("block"), "home", "node", "fp", "fp2")
    dealt = dealt.repartition(partitions(distinct.sparkSession), "anchor", "block").sortWithinPartitions("anchor", "block")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(x: pd.DataFrame) -> pd.DataFrame:
            group = np.cumsum(np.concatenate(([0], (np.diff(x["anchor"].to_numpy()) != 0) | (np.diff(x["block"].to_numpy()) != 0))))
            fp, fp2 = (x[k].to_numpy(np.int64).view(np.uint64) for k in ("fp", "fp2"))
            a, b = linked(fp, fp2, x["node"].to_numpy(np.int64), group, x["home"].to_numpy(bool), threshold, wide)
            return pd.DataFrame({"a": a, "b": b})

        for x in batches:
            held.append(x)
            if sum(map(len, held)) >= 40_000:
                x = pd.concat(held, ignore_index=True)
                other = np.flatnonzero((x["anchor"].to_numpy() != x["anchor"].iat[-1]) | (x["block"].to_numpy() != x["block"].iat[-1]))
                ends = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
                held = [x.iloc[ends:]]
                if ends:
                    yield links(x.iloc[:ends])
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 3, wide: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable over links."""
    prints = cut(fingerprints(docs, shingle, second=wide is not None))
    distinct = cut(prints.where("doc_id is not null").groupBy("fp", "fp2").agg(F.min("doc_id").alias("node")))
    found = components(near_links(distinct, threshold, wide))
    rooted = distinct.join(found, "node", "left").select("fp", "fp2", F.coalesce("root", "node").alias("component_id"))
    joined = prints.join(rooted, ["fp", "fp2"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents without near duplicates (Jaccard similarity of shingles of 4 / 5 or more, decided exactly): of each
    component the one with the smallest doc_id stays, rows with a null doc_id stay.

    Rows go by doc_id, so a component with a third of all rows is no group of the last join.
    """
    from .jaccard import similar

    gone = similar(docs, shingle, share).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
