"""Removal of every byte that lies in a string of ``length`` bytes which also starts anywhere else; or the same of
words (``unit="word"``), where a word's symbol is a 64-bit hash and white space between words does not count.

Suffixes of all documents are compared column by column, as in the multi-document construction of the
Burrows-Wheeler transform: every round inserts one more symbol at the front of each string of a collection,
moves the strings to their new order by a stable pass over that symbol, and updates the common prefixes of
neighbours (a new common prefix is one more than the least old one between the two). After the round of a
column, a string repeats from there if it shares ``length`` symbols with a neighbour.

What can match is brought together first. Of the ``gram``-byte strings in every window of ``length`` bytes the
one of smallest hash (the last such) is the window's anchor: equal windows have equal anchors at equal
offsets. So each window belongs to one anchor; the bytes of an anchor's successive windows are its context; only
contexts of one anchor string can share a window, and they are aligned at it. The collections are these
aligned contexts, and a round compares suffixes of the same column only. Contexts that occur more than
once repeat whole, and take part once.

Spark's shuffle and the written tables stand for the sequential external files; no task keeps files of its
own. An anchor string with over ``LARGE`` different contexts is not given to one task: its windows are counted
by a 128-bit hash, combined before the shuffle. Contexts and windows are taken as equal if 128-bit hashes are.

With ``words``, ``remove_repeats`` also reports runs of so many words, which may be shorter than ``length`` bytes.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; rows with equal doc_id and
text are two documents, copies of each other; texts of any length are taken whole; an empty table gives an
empty result; further columns are ignored or, in ``drop_repeats``, kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest, xxh3_128_digest

from .common import bitmap, cut, listed, partitions, small_batches

#: Symbols of an anchor string, by unit: powers of two.
GRAM = {"byte": 32, "word": 8}
#: Bytes of a symbol.
SIZE = {"byte": 1, "word": 8}
SYMBOL = {"byte": np.dtype(np.uint8), "word": np.dtype("<u8")}
Unit = Literal["byte", "word"]
#: Contexts that a collection takes before it is closed, and those of one anchor string that a task takes.
COLLECTION = 16384
LARGE = 50_000

_FACTOR = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(8)]
_LETTER = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)


def symbols(text: str, unit: Unit) -> bytes:
    """The symbols of a text, ``SIZE[unit]`` bytes each."""
    if unit == "byte":
        return text.encode("utf-8", "surrogatepass")
    return b"".join(map(xxh3_64_digest, text.split()))


def grams(raw: bytes, unit: Unit) -> np.ndarray:
    """A 64-bit hash of the ``GRAM[unit]`` symbols from each place on: a polynomial, by doubling."""
    x = np.frombuffer(raw, dtype=SYMBOL[unit])
    h = _LETTER[x] if unit == "byte" else x
    for k in range(GRAM[unit].bit_length() - 1):
        ahead = h[1 << k :]
        h = h[: -(1 << k)] * _FACTOR[k]
        h += ahead
    return h


def anchors(raw: bytes, length: int, unit: Unit = "byte") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its hash, its place, and the first and last window that it is the anchor of."""
    none = np.zeros(0, dtype=np.int64)
    windows = len(raw) // SIZE[unit] - length + 1
    if windows < 1:
        return none, none, none, none
    h = grams(raw, unit)
    width = length - GRAM[unit] + 1
    least = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    span = 1  # strings that each minimum covers
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.concatenate((first[1:], [windows])) - 1
    place = (np.uint64(0xFFFFFFFF) - (least[first] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    h = h[place]
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64), place, first, last


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def repeated(contexts: list[bytes], before: np.ndarray, length: int, unit: Unit = "byte") -> list[tuple[int, int, int]]:
    """(context, start, end) of the runs of symbols in windows that two contexts share at equal distance from their anchors.

    ``before``: the symbols of each context before its anchor. Contexts are different strings.
    """
    n, zero = len(contexts), length - GRAM[unit]
    size = np.array([len(c) // SIZE[unit] for c in contexts])
    low = zero - before
    high = low + size
    width = zero + length
    columns = np.zeros((n, width), dtype=SYMBOL[unit])
    at = np.arange(width)[None, :]
    columns[(at >= low[:, None]) & (at < high[:, None])] = np.frombuffer(b"".join(contexts), dtype=SYMBOL[unit])
    columns = np.ascontiguousarray(columns.T)
    order = np.arange(n)
    common = np.zeros(n + 1, dtype=np.uint16)  # with the string before it in the order
    hits = np.zeros((zero + 1, n), dtype=bool)
    for c in range(width - 1, int(low.min()) - 1, -1):
        symbol = columns[c][order]
        inside = (low[order] <= c) & (c < high[order])
        to = np.argsort(symbol, kind="stable")
        s, v = symbol[to], inside[to]
        same = np.flatnonzero((s[1:] == s[:-1]) & v[1:] & v[:-1]) + 1
        new = np.zeros(n + 1, dtype=np.uint16)
        if len(same):
            ranges = np.empty(2 * len(same), dtype=np.int64)
            ranges[0::2], ranges[1::2] = to[same - 1] + 1, to[same] + 1
            new[same] = np.minimum.reduceat(common, ranges)[0::2] + 1
        order, common = order[to], new
        if c <= zero:
            far = common >= length
            hits[c, order[far[:n] | far[1:]]] = True
    which, start = np.nonzero(hits.T)
    if not len(which):
        return []
    cuts = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1))))
    ends = np.concatenate((cuts[1:], [len(which)])) - 1
    k = which[cuts]
    return list(zip(k.tolist(), (start[cuts] - low[k]).tolist(), (start[ends] - low[k] + length).tolist(), strict=True))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = 400, unit: Unit = "byte") -> DataFrame:
    """(doc, text_key, spans): ranges of symbols of each document that lie in repeated strings, unmerged."""
    if length <= GRAM[unit]:
        raise ValueError(f"strings of over {GRAM[unit]} symbols")
    spark, z = docs.sparkSession, SIZE[unit]
    small_batches(spark)
    rows = _rows(docs)

    def only_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"gram": np.concatenate([*(anchors(symbols(t, unit), length, unit)[0] for t in x["text"]), np.zeros(0, dtype=np.int64)])})

    # anchor strings that occur once are not written: a bit map keeps most of them out of the second pass
    shared = cut(rows.select("text").mapInPandas(only_grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    bits, known = bitmap(shared, "gram", shared.count())

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            digests: list[bytes] = []
            gram, start, end, count = [], [], [], []
            for text in x["text"]:
                raw = symbols(text, unit)
                h, _, first, last = anchors(raw, length, unit)
                on = listed(known.value, bits, h)
                count.append(len(on))
                if len(on):
                    first, after = first[on], last[on] + length
                    gram.append(h[on])
                    start.append(first)
                    end.append(after)
                    digests.extend([xxh3_128_digest(raw[a:b]) for a, b in zip((z * first).tolist(), (z * after).tolist(), strict=True)])
            if digests:
                one, two = _halves(digests)
                doc, key = (np.repeat(x[c].to_numpy(), count) for c in ("doc", "text_key"))
                yield pd.DataFrame({"gram": np.concatenate(gram), "one": one, "two": two, "doc": doc, "text_key": key, "start": np.concatenate(start), "end": np.concatenate(end)})

    places = rows.mapInPandas(find, "gram long, one long, two long, doc long, text_key long, start long, end long")
    # written, so that the join stands on plain exchanges and a hot anchor string can be split
    places = cut(places.join(shared, "gram"))
    kinds = cut(places.groupBy("gram", "one", "two").agg(F.count("*").alias("n")))
    spread = cut(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    many = spread.agg(F.count("*"), F.count_if(F.col("kinds") > LARGE)).first()
    whole = kinds.where("n > 1").select("gram", "one", "two", F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    parts = [whole]
    if many[0] > many[1]:
        parts.append(_by_columns(rows, spread.where(F.col("kinds") <= LARGE).select("gram"), int(many[0] - many[1]), length, unit))
    if many[1]:
        parts.append(_by_windows(rows, spread.where(F.col("kinds") > LARGE).select("gram"), int(many[1]), length, unit))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    spans = places.join(found, ["gram", "one", "two"]).select("doc", "text_key", F.struct((F.col("start") + F.col("low")).alias("low"), F.coalesce(F.col("start") + F.col("high"), "end").alias("high")).alias("span"))
    return spans.groupBy("doc", "text_key").agg(F.collect_set("span").alias("spans"))


def _by_columns(rows: DataFrame, wanted: DataFrame, count: int, length: int, unit: Unit) -> DataFrame:
    z = SIZE[unit]
    bits, shared = bitmap(wanted, "gram", count)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for x in batches:
            digests: list[bytes] = []
            gram, before, found = [], [], []
            for text in x["text"]:
                raw = symbols(text, unit)
                h, place, first, last = anchors(raw, length, unit)
                if len(on := listed(shared.value, bits, h)):
                    h, place, first, after = h[on], place[on] - first[on], z * first[on], z * (last[on] + length)
                    for g, p, a, b in zip(h.tolist(), place.tolist(), first.tolist(), after.tolist(), strict=True):
                        context = raw[a:b]
                        digest = xxh3_128_digest(context)
                        if digest not in seen:
                            seen.add(digest)
                            digests.append(digest)
                            gram.append(g)
                            before.append(p)
                            found.append(context)
            if len(seen) > 500_000:
                seen.clear()
            one, two = _halves(digests)
            yield pd.DataFrame({"gram": np.array(gram, dtype=np.int64), "one": one, "two": two, "before": np.array(before, dtype=np.int32), "context": found})

    met = rows.select("text").mapInPandas(contexts, "gram long, one long, two long, before int, context binary").join(wanted, "gram", "left_semi")
    dealt = met.repartition(partitions(rows.sparkSession), "gram").sortWithinPartitions("gram", "one", "two")

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(x: pd.DataFrame) -> pd.DataFrame:
            x = x.drop_duplicates(["gram", "one", "two"]).reset_index(drop=True)
            out = []
            edges = np.flatnonzero(np.concatenate(([True], np.diff(x["gram"].to_numpy()) != 0)))
            sizes = np.diff(np.concatenate((edges, [len(x)])))
            i = 0
            while i < len(edges):  # whole anchor strings, some COLLECTION contexts at a time
                j = i + 1
                while j < len(edges) and edges[j] + sizes[j] - edges[i] <= COLLECTION:
                    j += 1
                part = slice(edges[i], edges[j - 1] + sizes[j - 1])
                for k, low, high in repeated(x["context"].iloc[part].tolist(), x["before"].to_numpy()[part], length, unit):
                    out.append((edges[i] + k, low, high))
                i = j
            k = [o[0] for o in out]
            keys = x[["gram", "one", "two"]].iloc[k].reset_index(drop=True)
            return keys.assign(low=np.array([o[1] for o in out], dtype=np.int64), high=np.array([o[2] for o in out], dtype=np.int64))

        for x in batches:
            held.append(x)
            if sum(map(len, held)) >= 2 * COLLECTION:
                x = pd.concat(held, ignore_index=True)
                other = np.flatnonzero(x["gram"].to_numpy() != x["gram"].iat[-1])
                ends = int(other[-1]) + 1 if len(other) else 0  # the last anchor string may go on in the next batch
                held = [x.iloc[ends:]]
                if ends:
                    yield done(x.iloc[:ends])
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return cut(dealt.mapInPandas(collect, "gram long, one long, two long, low long, high long"))


def _by_windows(rows: DataFrame, wanted: DataFrame, count: int, length: int, unit: Unit) -> DataFrame:
    """The same for anchor strings with very many contexts: every window by its hash."""
    z = SIZE[unit]
    bits, shared = bitmap(wanted, "gram", count)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for text in x["text"]:
                raw = symbols(text, unit)
                h, _, first, last = anchors(raw, length, unit)
                for i in listed(shared.value, bits, h).tolist():
                    one, two = np.frombuffer(xxh3_128_digest(raw[z * first[i] : z * (last[i] + length)]), dtype="<i8").tolist()
                    a, b = _halves([xxh3_128_digest(raw[z * p : z * (p + length)]) for p in range(first[i], last[i] + 1)])
                    yield pd.DataFrame({"gram": h[i], "one": one, "two": two, "low": np.arange(len(a)), "a": a, "b": b})

    met = rows.select("text").mapInPandas(windows, "gram long, one long, two long, low long, a long, b long").join(wanted, "gram", "left_semi")
    met = cut(met.dropDuplicates(["gram", "one", "two", "low"]))
    more = met.groupBy("gram", "a", "b").agg(F.count("*").alias("n")).where("n > 1").select("gram", "a", "b")
    return cut(met.join(more, ["gram", "a", "b"], "left_semi").select("gram", "one", "two", "low", (F.col("low") + length).alias("high")))


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _joined(docs: DataFrame, length: int, unit: Unit, words: int | None = None) -> DataFrame:
    """(row, found): the rows as they are, and the ranges found in their texts; with ``words``, also (passages): the ranges
    of words in repeated strings of so many words."""
    found = repeated_spans(docs, length, unit).withColumnRenamed("spans", "found")
    if words is not None:
        found = found.join(repeated_spans(docs, words, "word").withColumnRenamed("spans", "passages"), ["doc", "text_key"], "full")
    found = found.withColumnsRenamed({"doc": "found_doc", "text_key": "found_key"})
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    doc = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63)))
    return rows.join(found, (doc == F.col("found_doc")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("found_key")), "left")


def _removed(docs: DataFrame, length: int, words: int | None = None) -> DataFrame:
    """(row, new): the rows as they are; n_bytes, spans (removed byte ranges, maximal), kept (the bytes left) and
    passages (maximal ranges of words, none without ``words``)."""

    def ranges(found) -> list[tuple[int, int]]:
        return merged((s["low"], s["high"]) for s in found) if found is not None else []

    def clean(text: pd.Series, found: pd.Series, passages: pd.Series) -> pd.DataFrame:
        out = []
        for t, f, p in zip(text, found, passages, strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            spans = ranges(f)
            at, kept = 0, []
            for low, high in spans:
                kept.append(raw[at:low])
                at = high
            out.append((len(raw), [{"low": a, "high": b} for a, b in spans], b"".join([*kept, raw[at:]]), [{"low": a, "high": b} for a, b in ranges(p)]))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept", "passages"])

    span = "array<struct<low: long, high: long>>"
    passages = F.lit(None).cast(span) if words is None else F.col("passages")
    new = F.pandas_udf(clean, f"n_bytes long, spans {span}, kept binary, passages {span}")("row.text", "found", passages)
    return _joined(docs, length, "byte", words).select("row", new.alias("new"))


def remove_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, text) of every row: its removed byte ranges, the bytes left, and these as text.

    With ``words``, also (passages): the ranges of words, split at white space, that lie in strings of so many words which
    also start elsewhere. They may be shorter than ``length`` bytes; they are reported, and nothing is removed for them.
    """
    text = F.pandas_udf(_readable, "string")("new.kept")
    more = [] if words is None else ["new.passages"]
    return _removed(docs, length, words).select(F.col("row.doc_id").cast("long").alias("doc_id"), "new.n_bytes", "new.spans", "new.kept", text.alias("text"), *more)


def _readable(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some ranges of its words, each with the white space after it."""
    places = [m.span() for m in re.finditer(r"\S+", text)]
    at, kept = 0, []
    for low, high in spans:
        kept.append(text[at : places[low][0]])
        at = places[high][0] if high < len(places) else len(text)
    return "".join([*kept, text[at:]])


def drop_repeats(docs: DataFrame, length: int = 400, unit: Unit = "byte") -> DataFrame:
    """The documents, all of their columns, with what is left of their texts. With ``unit="byte"`` a character that
    loses some of its bytes goes whole."""

    def cleaned(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or f is None else without_words(t, merged((s["low"], s["high"]) for s in f)) for t, f in zip(text, found, strict=True)], dtype=object)

    if unit == "word":
        left = _joined(docs, length, unit)
        text = F.pandas_udf(cleaned, "string")("row.text", "found")
    else:
        left = _removed(docs, length)
        text = F.when(F.size("new.spans") == 0, F.col("row.text")).otherwise(F.pandas_udf(_readable, "string")("new.kept"))
    return left.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
