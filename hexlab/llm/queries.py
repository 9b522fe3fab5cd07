"""Queries of the text operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = classify(docs, train(docs, labels))
    return scored.select("doc_id", F.col("junk").alias("junk_score"), F.col("toxic").alias("toxic_score"), (F.col("toxic") >= 0.5).cast("int").alias("toxic"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents"), length=400, words=50)

    def covered(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])

    return left.select(
        "doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "text",
        covered("passages").alias("n_passage_words"), F.size("passages").cast("long").alias("n_passages"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_report

    kept = line_report(table(spark, sf_dir, "documents"), window=2)
    return kept.select(
        "doc_id", F.col("line_count").cast("long").alias("n_lines"), F.col("lines_gone").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256")
    )


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import top_k, whole_numbers

    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .rankqueue import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filters import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def packing_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing operator on instruction data: every reply with the turn before it as a prompt that bears no loss, under
    a limit of 2,048 loss-bearing tokens and 64 segments a sequence. The id is that of the conversation."""
    import public_tokenizers

    from .packing import pack

    turns = table(spark, sf_dir, "conversations")
    reply = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    before = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    rows = reply.join(before, ["conv_id", "turn"], "left").withColumnRenamed("conv_id", "doc_id")
    pieces = pack(rows, public_tokenizers.path("word_bpe_49k.json"), segments=64, loss=2048, prompt="prompt")
    return pieces.select(F.col("doc_id").alias("conv_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_simhash, op3_toxicity, op4_repeats, op5_licenses, op6_line_dedup, op7_maxscore, op8_bpe, op9_language_id, op10_packing, op11_rank_queue, op12_filter_audit, op13_collocations, packing_instructions)}


def _sql() -> dict[str, str]:
    from . import filters, licenses, lines, maxscore, phrases

    return {
        "op5_licenses": licenses.SQL, "op6_line_dedup": lines.SQL, "op7_maxscore": maxscore.SQL, "op12_filter_audit": filters.SQL, "op13_collocations": phrases.SQL,
    }


ORACLE_SQL = _sql()
