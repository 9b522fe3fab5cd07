"""Document fingerprints: a wide digest of the canonical text, equal buckets checked byte for byte.

Canonical text: NFKC, case folding, NFKC again, every run of white space one space, none at the ends.
Defined cases: a null text counts as empty; empty texts share one fingerprint; repeated rows are copies;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bucket_of, cut, partitions, small_batches


def canonical(text: str) -> str:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def likeness(a: str, b: str) -> float:
    """Of two exact digests: 1 if equal, else 0."""
    return float(a == b)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "fingerprint": [digest(canonical(t or "")) for t in x["text"]]})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fingerprint string")


def exact_classes(docs: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """(fingerprint, class_id, copies) of every fingerprint that two rows or more share.

    Rows meet by digest; the canonical bytes of equal digests are then compared by grouping on
    (digest, bytes), which combines copies before the shuffle, so a group with a third of all rows
    costs one row a task. A bit map of repeated digests, which grows with their number up to 64 MB, keeps most other
    texts out of that shuffle. Two texts of one digest raise an error: they would need another digest.
    """
    spark = docs.sparkSession
    prints = fingerprint(docs) if prints is None else prints
    many = prints.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("class_id")).where("copies > 1")
    many = cut(many)
    bits, shared = bitmap(many.select(F.conv(F.substring("fingerprint", 1, 16), 16, -10).cast("long").alias("h")), "h", many.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, mask = shared.value, (1 << bits) - 1
        for x in batches:
            out = []
            for t in x["text"]:
                canon = canonical(t or "")
                d = digest(canon)
                s = int(d[:16], 16) & mask
                if whole[s >> 3] >> (s & 7) & 1:
                    out.append((d, canon.encode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["fingerprint", "canon"])

    small_batches(spark)
    texts = docs.select("text").mapInPandas(run, "fingerprint string, canon binary").groupBy("fingerprint", "canon").agg(F.count("*").alias("n"))
    kinds = texts.groupBy("fingerprint").agg(F.count("*").alias("kinds"))
    checked = many.join(cut(kinds), "fingerprint")
    fail = F.raise_error(F.concat(F.lit("two canonical texts share the digest "), "fingerprint"))
    return checked.select("fingerprint", F.when(F.col("kinds") == 1, F.col("class_id")).otherwise(fail.cast("long")).alias("class_id"), "copies")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every text, and the text whose last third is replaced by the head of the next one (descending doc_id,
    equal ids by text, null ids last; after the last comes the first), both fingerprinted.

    One shuffle of the texts: rows are dealt to ranges of doc_id, and the head row of each range goes to
    the range before it as well, so a task reads its rows in order and always has the following one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    n = 4 * partitions(spark)
    bounds = sorted({int(b) for b in rows.stat.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)})
    rows = rows.withColumn("bucket", bucket_of(F.col("k"), bounds))
    heads = sorted((r["bucket"], r["k"]) for r in rows.groupBy("bucket").agg(F.max("k").alias("k")).collect())
    own = F.struct(F.col("bucket"), F.lit(0).alias("halo"))
    head, above = {}, {}  # of each range that has rows: its largest key, and the range that takes that row as well
    for i, (b, k) in enumerate(heads):
        head[b], above[b] = k, heads[(i + 1) % len(heads)][0]
    at = range(len(bounds) + 1)
    is_head = F.col("k") == F.array(*[F.lit(head.get(b)).cast("long") for b in at])[F.col("bucket")]
    to = F.when(is_head, F.array(*[F.lit(above.get(b)).cast("int") for b in at])[F.col("bucket")])
    dealt = rows.select("k", "doc_id", "text", F.explode(F.when(to.isNotNull(), F.array(own, F.struct(to.alias("bucket"), F.lit(1).alias("halo")))).otherwise(F.array(own))).alias("at"))
    dealt = dealt.select("doc_id", "text", "k", "at.bucket", "at.halo").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "halo", F.desc("k"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # a row that waits for the one after it
        for x in batches:
            out = []
            for doc_id, text, bucket, halo in zip(x["doc_id"].astype("Int64"), x["text"], x["bucket"], x["halo"], strict=True):
                canon = canonical(text)
                if held is not None and held[3] == bucket:
                    out.append(finish(held, text, canon))
                held = None if halo else (doc_id, text, canon, bucket)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    def finish(held, after: str, after_canon: str) -> tuple:
        doc_id, text, canon, _ = held
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        edited_canon = canonical(edited)
        mine, changed = digest(canon), digest(edited_canon)
        raw = edited.encode("utf-8", "surrogatepass")
        return doc_id, len(text), hashlib.sha256(raw).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, digest(after_canon))

    small_batches(spark)
    return dealt.drop("k").mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """``edited_fingerprints`` with the class of each text: class_id (smallest doc_id of its copies) and copies."""
    prints = cut(edited_fingerprints(docs))
    # written, so that the join stands on plain exchanges and a hot fingerprint can be split
    classes = cut(exact_classes(docs, prints.select("doc_id", "fingerprint")))
    return prints.join(classes, "fingerprint", "left").select(
        *prints.columns, F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies")
    )
