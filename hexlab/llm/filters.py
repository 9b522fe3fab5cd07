"""Filter interaction audit: what every order of a set of filters keeps, removes, and loses of labelled rows.

Each filter stores the ids that fail it as a table of its own. The survivors of a prefix of filters do not depend
on the order inside the prefix, so prefixes are sets: all sets of a size are worked out at once from those one
smaller, survivors by a left-anti join with the table of one filter, removals by a left-semi join with the tables of
all filters that are not in the set yet. Ids that fail nothing meet no filter: they are counted once and stay out of
the joins. No group is collected anywhere; keys of all joins are unique ids on one side, and part values, labels and
texts that many rows share are combined before they are shuffled.

Defined cases: a null text counts as empty (no words, so it is too short; 0 distinct words of 0 are not too few); every
row is a document, also with a doc_id that is null or occurs twice; a row whose doc_id is null is never a copy and never
the original of one; rows of one doc_id and one text are no copies of each other; a document has a label if any row of
the labels with its doc_id says so; a null lang is the part ""; no rows give no parts and an empty result; further columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread


def text_filters() -> dict[str, Column]:
    """Whether ``text`` fails: A too few words, B too few distinct ones, C too many capitals, D markup or symbols."""
    n = F.size("words").cast("long")  # products of very long texts pass 32 bits
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct("words")).cast("long") < 50 * n,
        "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 3 * F.length("text").cast("long"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def measured(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per document: rid, part, good, toxic and a boolean column for each of the five filters. Written; texts
    are read once and only their SHA-256 goes on."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    tests = text_filters()
    rows = cut(
        spread(own)
        .withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
        .select(F.monotonically_increasing_id().alias("rid"), "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in tests.items()])
    )
    # the smallest doc_id of every text that several rows have: combined before the shuffle, then a join on plain exchanges
    first = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    out = rows.join(first, "digest", "left").join(marks, "doc_id", "left")
    return cut(
        out.select("rid", "part", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")], *tests, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))
    ), [*tests, "E"]


def failing_ids(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(filter, rid) of all failures, written with one folder, so one table of ids, for each filter."""
    found = F.filter(F.array(*[F.when(F.col(f), F.lit(k)) for k, f in enumerate(filters)]), lambda x: x.isNotNull())
    return cut(rows.select("rid", F.explode(found).alias("filter")), "filter")


def interactions(rows: DataFrame, filters: Sequence[str], losses: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Counts by part for every set of filters that comes before (a bit mask, ``before``).

    ``rows`` has rid (unique), part, a boolean column for each filter (true: it fails) and 0/1 columns ``losses``.
    Returns (part, before, survivors) for every set, and (part, before, filter, removed, and each of ``losses`` removed)
    for every set and filter outside it; combinations without a row are left out.
    """
    failing = failing_ids(rows, filters)
    touched = cut(rows.join(failing.select("rid").distinct(), "rid", "left_semi").select("rid", "part", *losses))
    whole = rows.groupBy("part").agg(F.count("*").alias("survivors")).withColumn("before", F.lit(0))
    hit = touched.groupBy("part").agg(F.count("*").alias("hit"))
    clean = whole.join(hit, "part", "left").select("part", (F.col("survivors") - F.coalesce("hit", F.lit(0))).alias("clean"))
    alive, removed, kept = touched.withColumn("before", F.lit(0)), [], []
    for size in range(len(filters)):
        outside = F.expr(f"filter(sequence(0, {len(filters) - 1}), k -> getbit(before, k) = 0)")
        steps = alive.withColumn("filter", F.explode(outside))
        gone = steps.join(failing, ["rid", "filter"], "left_semi")
        removed.append(gone.groupBy("part", "before", "filter").agg(F.count("*").alias("removed"), *[F.sum(c).cast("long").alias(c) for c in losses]))
        # each set comes from one set only: the one without its last filter
        last = steps.where(F.expr("shiftright(before, filter) = 0")).join(failing, ["rid", "filter"], "left_anti")
        alive = last.withColumn("before", F.expr("before + shiftleft(1, filter)")).drop("filter")
        if size + 1 < len(filters):
            alive = cut(alive)
        kept.append(alive.groupBy("part", "before").agg(F.count("*").alias("alive")))
    sets = clean.withColumn("before", F.explode(F.sequence(F.lit(1), F.lit((1 << len(filters)) - 1))))
    left = union(kept)
    survivors = sets.join(left, ["part", "before"], "left").select("part", "before", (F.col("clean") + F.coalesce("alive", F.lit(0))).alias("survivors"))
    return cut(whole.select("part", "before", "survivors").unionAll(survivors)), cut(union(removed))


def union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def audit(rows: DataFrame, filters: Sequence[str], losses: Mapping[str, str]) -> DataFrame:
    """One row per part, order of the filters and step. ``losses``: column of ``rows`` -> name of its count of removals.

    The number of orders is the factorial of the number of filters; the sets that are joined are 2 to that number."""
    k = len(filters)
    if not 0 < k < 8 or any(len(f) != 1 for f in filters):
        raise ValueError("give one to seven filters, named by one letter each: all orders are returned")
    survivors, removed = interactions(rows, filters, list(losses))
    # one text literal for all steps, as a plan with some thousand literals is slow to compile
    steps = [
        f"{''.join(map(str, order))} {step + 1} {order[step]} {sum(1 << i for i in order[:step])} {sum(1 << i for i in order[: step + 1])}"
        for order in permutations(range(k))
        for step in range(k)
    ]
    x = F.split("x", " ")
    grid = survivors.where("before = 0").select("part", F.explode(F.split(F.lit(";".join(steps)), ";")).alias("x"))
    grid = grid.select("part", F.translate(x[0], "".join(map(str, range(k))), "".join(filters)).alias("filter_order"), *[x[i + 1].cast("int").alias(c) for i, c in enumerate(("step", "filter", "before", "through"))])
    orders = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(k - 1 - s)) for s in range(k)]), F.bit_count("before") + 1)
    by_filter = removed.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.bit_count("before") == k - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(orders * F.col("removed")).alias("shapley"),
    )
    out = (
        grid.join(survivors.select("part", F.col("before").alias("through"), F.col("survivors").alias("kept")), ["part", "through"], "left")
        .join(removed, ["part", "before", "filter"], "left")
        .join(by_filter, ["part", "filter"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "part", "filter_order", "step", zero("kept").alias("kept"), zero("removed").alias("removed"), (zero("fails") - zero("removed")).alias("redundant"),
        zero("unique_fails").alias("unique_fails"), *[zero(c).alias(name) for c, name in losses.items()], zero("shapley").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters on ``docs``, with losses of documents labelled good and toxic."""
    rows, filters = measured(docs, labels)
    return audit(rows, filters, {"good": "good_lost", "toxic": "toxic_lost"})


#: By classes of the same failures instead of joins.
SQL = r"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, row_number() OVER () AS rid FROM documents),
words AS (SELECT rid, doc_id, t, part, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM own),
firsts AS (SELECT t, min(doc_id) AS first FROM own GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 3 * length(words.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS m
  FROM words LEFT JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
classes AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, m),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(f, bit)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM orders)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN m & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & bit <> 0 AND m & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM classes, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
