"""Phrase collocations by top-order marginalisation.

Only windows of the longest order are counted: every word with the words that follow it inside its piece as lead
columns, padded where the piece ends. ROLLUP over those counts sums them to all shorter prefixes, and since every
occurrence of a phrase begins exactly one window, these sums are the counts of the shorter phrases. There is no
explosion of n-grams for each order.

A word that occurs less than ``least`` times cannot stand in a candidate, nor can two neighbours that meet less than
``least`` times. Two bit maps of the others (bounded size; filters that pass some rare ones and miss no frequent one) end
the windows there as the ends of pieces do. That changes no count of a phrase that can matter, and most windows, which
would lead nowhere, fall together in the task that reads them.

Defined cases: a null text counts as empty, a null lang as ``und``; rows repeated or with null ids count like any other; texts
without words give nothing; texts of any length are read whole; no rows give an empty result; further columns are not
read. Counts are exact up to 10**15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, cut, small_batches, spread

BREAK = b"\n"
#: Upper case to lower, every mark that ends a piece to a line feed, tab to space.
FOLD = bytes(ord("\n") if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Different words that a task holds before it hands their counts on.
HELD = 200_000
#: Bytes of a text that are looked at together, up to the end of a piece.
STRETCH = 1 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and folded text; a long text in stretches that end where a piece ends, so that its words are never all held."""
    for x in batches:
        for lang, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
            raw, at = text.encode().translate(FOLD), 0
            while len(raw) - at > STRETCH and (end := raw.find(BREAK, at + STRETCH)) >= 0:
                yield lang, raw[at:end]
                at = end
            yield lang, raw[at:] if at else raw


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "f"]
                )
            held.clear()

        for lang, raw in _rows(batches):
            counts = held.setdefault(lang, Counter())
            before = len(counts)
            counts.update(raw.split())
            size += len(counts) - before
            if size > HELD:
                yield from out()
                size = 0
        yield from out()

    found = texts.mapInArrow(run, "lang string, word string, f long")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f"))


#: Odd factors that spread the hashes of two neighbours over the bits of one.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def paired(h: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one; 0 where one of them is 0."""
    key = h[:-1] * FACTORS[0] ^ h[1:] * FACTORS[1]
    key ^= key >> np.uint64(29)
    key[key == 0] = 1
    return np.where((h[:-1] == 0) | (h[1:] == 0), np.uint64(0), key)


class Kept(dict):
    """The hash of a word of one language where the map of frequent words holds it, else 0."""

    def __init__(self, lang: str, bits: int, whole: np.ndarray):
        super().__init__({BREAK: 0, b"": 0})
        self.lang, self.mask, self.whole = lang.encode() + b"\n", (1 << bits) - 1, whole

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(self.lang + word, seed=42)
        s = h & self.mask
        kept = (h or 1) if self.whole[s >> 3] >> (s & 7) & 1 else 0
        if len(self) < HELD:
            self[word] = kept
        return kept


def _hashed(batches: Iterator[pa.RecordBatch], bits: int, whole: np.ndarray) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Words and hashes of each text; a line feed stands between pieces."""
    known: dict[str, Kept] = {}
    for lang, raw in _rows(batches):
        words = raw.replace(b"\n", b" \n ").split(b" ")
        words = [w for w in words if w]
        kept = known.get(lang)
        if kept is None:
            kept = known[lang] = Kept(lang, bits, whole)
        yield lang, words, np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def frequent_pairs(texts: DataFrame, words: tuple[int, Broadcast], least: int) -> DataFrame:
    """(h): hashes of neighbours that meet ``least`` times or more."""
    bits, shared = words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for _, _, h in _hashed(batches, bits, shared.value):
            key = paired(h)
            held.append(key[key != 0])
            size += len(held[-1])
            if size > 20 * HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def window_counts(texts: DataFrame, words: tuple[int, Broadcast], pairs: tuple[int, Broadcast], order: int) -> DataFrame:
    """(lang, w1 .. w<order>, f) of every padded window: pads are empty strings, which no word is.

    A window crosses the shuffle as one string, half as wide as its columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size, (bits, whole), (pair_bits, pair_map) = 0, (words[0], words[1].value), (pairs[0], pairs[1].value)
        mask = np.uint64((1 << pair_bits) - 1)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "window", "f"]
                )
            held.clear()

        for lang, found, h in _hashed(batches, bits, whole):
            key = paired(h)
            s = (key & mask).astype(np.int64)
            on = (key != 0) & (pair_map[s >> 3] >> (s & 7).astype(np.uint8) & 1 == 1)  # the next word belongs to the window
            run_ = np.append(on, False)
            size_of = np.where(h != 0, 1, 0)  # words in the window that begins here
            lead = run_
            for k in range(1, order):
                size_of += lead
                lead = lead & np.append(run_[k:], [False] * min(k, len(run_)))[: len(run_)]
            counts = held.setdefault(lang, Counter())
            before = len(counts)
            for k in range(1, order + 1):
                at = np.flatnonzero(size_of == k).tolist()
                counts.update([found[i] for i in at] if k == 1 else [b" ".join(found[i : i + k]) for i in at])
            size += len(counts) - before
            if size > 2 * HELD:
                yield from out()
                size = 0
        yield from out()

    counts = texts.mapInArrow(run, "lang string, window string, f long").groupBy("lang", "window").agg(F.sum("f").alias("f"))
    parts = F.split("window", " ")
    return counts.select("lang", *[F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(f"w{k + 1}") for k in range(order)], "f")


def phrase_counts(windows: DataFrame, order: int, least: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases up to ``order`` words with f >= least, from the counts of windows."""
    names = [f"w{k + 1}" for k in range(order)]
    longest = windows.where(F.col(names[-1]) != "").select("lang", F.concat_ws(" ", *names).alias("phrase"), F.lit(order).alias("words"), "f")
    # what ROLLUP sums away is null, a pad is an empty string
    sums = windows.rollup("lang", *names[:-1]).agg(F.sum("f").alias("f")).where("lang is not null and w1 is not null")
    size = sum((F.col(w).isNotNull().cast("int") for w in names[1:-1]), F.lit(1))
    real = F.lit(True)
    for w in names[1:-1]:  # windows that end before this word are no phrases of its length
        real = real & (F.coalesce(F.col(w), F.lit("-")) != "")
    shorter = sums.where(real).select("lang", F.concat_ws(" ", *names[:-1]).alias("phrase"), size.alias("words"), "f")
    return shorter.unionAll(longest).where(F.col("f") >= least)


def scored(counts: DataFrame, order: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all phrases of two words or more, by their lowest-scoring cut."""
    parts = F.split("phrase", " ")
    cuts = counts.where("words >= 2").select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    )
    cuts = cuts.withColumns({"first": F.concat_ws(" ", F.slice(parts, 1, F.col("k"))), "rest": F.concat_ws(" ", F.slice(parts, F.col("k") + 1, F.col("words")))})
    first = counts.where(F.col("words") < order).select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = counts.where(F.col("words") < order).select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    # 10**6 a a / (l r) in decimals of 38 digits; a is not above l or r, so the result fits in a long
    score = F.expr("cast((cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as bigint)")
    best = both.select("lang", "phrase", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def not_absorbed(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that do not lie in a longer one with at least ``percent`` hundredths of their count."""
    parts = F.split("phrase", " ")
    inner = candidates.where("words >= 3").select(
        "lang", F.col("a").alias("outer"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"), parts.alias("p"), "words"
    )
    inner = inner.select("lang", "outer", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1), lambda i: F.concat_ws(" ", F.slice("p", i, F.col("size"))))).alias("phrase"))
    most = cut(inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer")))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("outer") < percent * F.col("a"), F.lit(True))).drop("outer")


def first_ranked(candidates: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language with their ranks: by shares of 4096, then 64 shares, then all, so that no task
    meets more than 64 lists of that length."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    out = candidates
    for shares in (4096, 64):
        window = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        out = out.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most).drop("rank")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, order: int = 3, least: int = 10, percent: int = 50, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` highest-scoring phrases of each language.

    ``least`` is the smallest count of a candidate (2 or more words, ``order`` at most); a candidate goes where a longer one
    holds it with ``percent`` hundredths of its occurrences.
    """
    if order < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur at least once")
    small_batches(docs.sparkSession)
    texts = spread(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    words = cut(word_counts(texts))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = cut(words.where(F.col("f") >= least).select(F.xxhash64(F.concat_ws("\n", "lang", "word")).alias("h")))
    shared = bitmap(frequent, "h", frequent.count())
    met = cut(frequent_pairs(texts, shared, least))
    windows = cut(window_counts(texts, shared, bitmap(met, "h", met.count()), order))
    counts = cut(phrase_counts(windows, order, least))
    candidates = cut(scored(counts, order))
    ranked = first_ranked(not_absorbed(candidates, percent), most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: With an explosion for each order.
SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, list_filter(string_split_regex(p, '[ \t]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
          unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
grams AS (SELECT lang, 1 AS k, ws[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM places WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM places WHERE i + 2 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
absorbed AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN candidates b
  ON b.lang = s.lang AND b.k = 3 AND s.k = 2 AND s.phrase IN (b.ws[1] || ' ' || b.ws[2], b.ws[2] || ' ' || b.ws[3]) AND 100 * b.a >= 50 * s.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN absorbed USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
