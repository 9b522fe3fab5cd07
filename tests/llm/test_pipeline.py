"""The stages on a small corpus with planted cases, and the registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexlab.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, small, tmp_path_factory):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 800")
    rows = docs.orderBy("doc_id").limit(60).collect()
    out = [tuple(r) for r in rows]
    base = rows[0]
    words = base["text"].split(" ")
    near = " ".join(words[:40] + ["changed"] + words[41:])
    flat = rows[2]["text"].replace("\n", " ").split(" ")  # one line, so that the lines stage leaves it alone
    passage = " ".join(rows[1]["text"].split()[:90])
    out += [(9001, base["text"], *base[2:]), (9002, near, *base[2:]), (9007, " ".join(flat), *base[2:]), (9008, " ".join(flat[:30] + ["changed"] + flat[31:]), *base[2:]), (9003, "12345 !!! 678", *base[2:]), (9004, None, *base[2:]), (9005, turned(rows[5]["text"]) + " " + passage + " own end here.", *base[2:]), (9006, turned(rows[6]["text"]) + " " + passage + " another tail.", *base[2:])]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(out, docs.schema).write.parquet(f"{path}/documents.parquet")
    return path


def turned(text):
    """Words that no other document has in this order."""
    return " ".join(reversed(text.split()[:120]))


def rows_two(texts):
    """The document of the corpus that 9007 and 9008 are near copies of."""
    return next(i for i, t in texts.items() if i < 9000 and t and t.replace("\n", " ") == texts[9007])


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, texts, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        rows = out.collect()
        ids = {r["doc_id"] for r in rows}
        if name == "language":
            assert set(texts) - ids == {9003, 9004}
        if name == "near_duplicates":
            assert not {9007, 9008} & ids and {rows_two(texts), 9005, 9006} <= ids
        if name == "repeats":
            left = {r["doc_id"]: r["text"] for r in rows}
            for i in (9005, 9006):  # the heads and ends stay, the passage goes
                assert left[i].split() == texts[i].split()[:120] + texts[i].split()[210:]
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name != "packing":
            assert out.columns == columns
        seen.append(name)
        docs = spark.createDataFrame(rows, out.schema)
    assert seen == ["language", "lines", "near_duplicates", "repeats", "packing"]
    assert corpus_pipeline.run(spark, corpus).count() > 0


ODD = ["row", "new", "doc", "text_key", "fp", "node", "k1", "n", "starts", "spans", "kept", "run", "gone_id", "component_id", "score", "h", "root", "token"]


def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 40").withColumns({c: F.lit(c) for c in ODD})
    rows = docs.collect()
    docs = spark.createDataFrame([*rows, rows[0], (None, "une ligne ici\nune ligne ici", *[None] * (len(docs.columns) - 2 - len(ODD)), *ODD)], docs.schema)
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame((found := stage(spark, docs, small)).collect(), found.schema)
        none = stage(spark, empty, small)
        assert none.count() == 0 and none.columns == found.columns
        if name != "packing":
            assert out.columns == docs.columns and {tuple(r[c] for c in ODD) for r in out.where("doc_id is not null").collect()} == {tuple(ODD)}
            assert out.where("doc_id is null").count() == 1
            docs = out


def test_lines_that_repeat_alone_go(spark):
    rows = [(1, "own one\nshared line\nown two"), (2, "own three\n shared line\t\nown four"), (3, "shared line"), (4, "a\nown five\na")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "own three\nown four", 3: "", 4: "a\nown five"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_give_the_rows_of_their_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    want = sorted(repr(tuple(r)) for r in rel.select(", ".join(got.columns)).fetchall())
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["op1_fingerprints", "op2_simhash", "op3_toxicity", "op4_repeats", "op8_bpe", "op9_language_id", "op10_packing"])
def test_queries_cover_all_documents(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = queries.QUERIES[name](spark, small)
    assert got.select("doc_id").distinct().count() == docs.count()
