"""Line dedup by winnowing over line hashes: later runs of repeated lines are deleted.

A line is what lies between line feeds, without spaces, tabs and carriage returns at its ends; blank lines
have no number and are neither compared nor deleted. Of every ``window`` successive lines of a document the
one with the smallest hash (the last such) is a fingerprint, so two documents that share a run of
``window`` lines share a fingerprint in it. Fingerprints that occur once are dropped. The others meet by their lines: a
match is extended from the fingerprint to both sides, window by window, as far as the ``window`` - 1 lines beyond
which the next fingerprint takes over, so matches of any length are covered piece by piece. Hashes only
choose what is compared; windows meet by their whole lines. A run of ``window`` lines or more that occurs
earlier (by doc_id, then position) is deleted, so the first occurrence of each run stays.

Defined cases: a null text stays null; rows with equal doc_id and text are one document; null ids come last;
documents with fewer lines than a window lose nothing; a document may repeat itself; other columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bitmap, cut, listed, small_batches

BLANKS = " \t\r"


def numbered(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, and the places of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(BLANKS)]


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the minima of all windows, each once; of equal hashes the last."""
    out, last = [], -1
    for s in range(len(hashes) - window + 1):
        at = min(range(s, s + window), key=lambda i: (hashes[i], -i))
        if at != last:
            out.append(at)
            last = at
    return out


def without(text: str, starts: list[int], window: int) -> tuple[str, int]:
    """The text without the runs of ``window`` numbered lines that begin at ``starts``, and the lines deleted."""
    lines, places = numbered(text)
    gone = {places[i] for s in starts for i in range(s, s + window)}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


def repeated_runs(docs: DataFrame, window: int = 2) -> DataFrame:
    """(doc_id, text_key, starts): numbers of the lines at which a window begins that occurs earlier."""

    def prints(text: str) -> tuple[list[str], list[int], np.ndarray]:
        """The lines that are not blank, the places of the fingerprints among them, and their hashes."""
        lines, places = numbered(text)
        own = [lines[i].strip(BLANKS) for i in places]
        hashes = [xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63 for x in own]
        at = winnow(hashes, window)
        return own, at, np.array([hashes[p] for p in at], dtype=np.int64)

    def only_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"hash": np.concatenate([*(prints(t)[2] for t in x["text"]), np.zeros(0, dtype=np.int64)])})

    small_batches(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc")
    # equal rows are one document
    rows = docs.where("text is not null").select(key, F.xxhash64("text").alias("text_key"), "text")
    shared = cut(rows.select("text").mapInPandas(only_hashes, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    bits, known = bitmap(shared, "hash", shared.count())

    def extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for doc, key, text in zip(x["doc"], x["text_key"], x["text"], strict=True):
                own, at, hashes = prints(text)
                on = listed(known.value, bits, hashes) if len(at) else []
                starts = {s for k in on for s in range(max(0, at[k] - window + 1), min(at[k], len(own) - window) + 1)}
                out += [(doc, key, s, "\n".join(own[s : s + window])) for s in sorted(starts)]
            yield pd.DataFrame(out, columns=["doc", "text_key", "start", "run"])

    # both tables are written, so that the join stands on plain exchanges and a hot line can be split
    runs = cut(rows.mapInPandas(extended, "doc long, text_key long, start int, run string"))
    at = F.struct("doc", "text_key", "start")
    first = cut(runs.groupBy("run").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("run", "first"))
    later = runs.join(first, "run").where(at > F.col("first")).select("doc", "text_key", "start")
    return later.groupBy("doc", "text_key").agg(F.array_sort(F.collect_set("start")).alias("starts"))


def _cleaned(docs: DataFrame, window: int) -> DataFrame:
    """(row, new): the rows as they are, and their text less the later repeated runs with the counts of lines."""

    def clean(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, starts, strict=True):
            n = 0 if t is None else len(numbered(t)[1])
            kept, gone = (t, 0) if t is None or s is None else without(t, list(s), window)
            out.append((kept, n, gone))
        return pd.DataFrame(out, columns=["text", "line_count", "lines_gone"])

    gone = repeated_runs(docs, window).withColumnsRenamed({"doc": "gone_doc", "text_key": "gone_key"})
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    doc = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(2**63 - 1))
    joined = rows.join(gone, (doc == F.col("gone_doc")) & (F.xxhash64("row.text") == F.col("gone_key")), "left")
    new = F.pandas_udf(clean, "text string, line_count int, lines_gone int")("row.text", "starts")
    return joined.select("row", new.alias("new"))


def line_report(docs: DataFrame, window: int = 2) -> DataFrame:
    """(doc_id, text, line_count, lines_gone) of every row: the text without the later repeated runs."""
    return _cleaned(docs, window).select(F.col("row.doc_id").cast("long").alias("doc_id"), "new.text", "new.line_count", "new.lines_gone")


def drop_repeated_lines(docs: DataFrame, window: int = 2) -> DataFrame:
    """The documents, all of their columns, with their texts less the later repeated runs."""
    return _cleaned(docs, window).select(*[F.col("new.text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


#: DuckDB: the same rows from every window of lines, without fingerprints.
SQL = r"""
with t as (select doc_id, text, string_split(text, chr(10)) as parts from documents where text is not null),
l as (select doc_id, text, unnest(parts) as line, generate_subscripts(parts, 1) as i from t),
m as (select *, trim(line, ' ' || chr(9) || chr(13)) as body from l),
n as (select doc_id, text, i, body, row_number() over (partition by doc_id, text order by i) - 1 as k from m where body <> ''),
w as (select *, lead(body) over (partition by doc_id, text order by k) as after from n),
f as (select *, row_number() over (partition by body, after order by doc_id, k) as nth from w where after is not null),
g as (select doc_id, text, k from f where nth > 1 union select doc_id, text, k + 1 from f where nth > 1),
r as (select n.doc_id, n.text, n.i from n join g using (doc_id, text, k)),
o as (select m.doc_id, m.text, count(*) filter (m.body <> '') as n_lines, count(r.i) as n_removed,
             coalesce(string_agg(m.line, chr(10) order by m.i) filter (r.i is null), '') as kept
      from m left join r using (doc_id, text, i) group by m.doc_id, m.text)
select d.doc_id, coalesce(o.n_lines, 0) as n_lines, coalesce(o.n_removed, 0) as n_removed, sha256(o.kept) as kept_sha256
from documents d left join o on d.doc_id = o.doc_id and d.text = o.text
"""
