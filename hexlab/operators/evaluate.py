"""Markov forecasts and the scores of ordinal predictions; all scores from one pass of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import error_class, gap_label


# Fixed value: the status of a model that has predicted nothing.
NO_PREDICTION = "non_disponible"


def _states(df: DataFrame, n_states: int, name: str) -> DataFrame:
    return df.sparkSession.range(n_states).select(F.col("id").cast("int").alias(name))


def split_years(pairs: DataFrame, train: tuple[int, int], test: tuple[int, int], valid: tuple[int, int] | None = None) -> DataFrame:
    """Adds ``split`` by inclusive bounds on year_t."""
    y = F.col("year_t")
    out = F.when(y.between(*train), "train")
    if valid:
        out = out.when(y.between(*valid), "valid")
    return pairs.withColumn("split", out.when(y.between(*test), "test"))


def transition_counts(train: DataFrame, n_states: int, by: Sequence[str] = ()) -> DataFrame:
    """(by…, state_t, state_t1, n) for all pairs of states, 0 where there is none."""
    n = train.groupBy(*by, "state_t", "state_t1").agg(F.count("*").alias("n"))
    grid = _states(train, n_states, "state_t").crossJoin(_states(train, n_states, "state_t1"))
    if by:
        grid = grid.crossJoin(train.select(*by).distinct())  # states and folds are few
    return grid.join(F.broadcast(n), [*by, "state_t", "state_t1"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def transition_matrix(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``p``, the probability within the row, each count raised by 1e-9."""
    row = Window.partitionBy(*by, "state_t")
    return counts.withColumn("p", (F.col("n") + 1e-9) / F.sum(F.col("n") + 1e-9).over(row))


def markov_rule(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, state_t, predicted): the most frequent next state, the lowest on ties."""
    return counts.groupBy(*by, "state_t").agg(F.max_by("state_t1", F.struct("n", -F.col("state_t1"))).alias("predicted"))


def markov_predict(train: DataFrame, test: DataFrame, n_states: int) -> DataFrame:
    """``test`` with ``predicted``; states never seen in training go to 0."""
    rule = markov_rule(transition_counts(train, n_states))
    return test.join(F.broadcast(rule), "state_t", "left")  # a row a state


def markov_block_cv(train: DataFrame, n_states: int, block: str = "block") -> DataFrame:
    """Leave-one-block-out predictions in one pass: a fold's counts are all counts less the block's."""
    own = transition_counts(train, n_states, [block])
    every = own.groupBy("state_t", "state_t1").agg(F.sum("n").alias("all_n"))
    left = own.join(F.broadcast(every), ["state_t", "state_t1"]).select(block, "state_t", "state_t1", (F.col("all_n") - F.col("n")).alias("n"))
    return train.join(F.broadcast(markov_rule(left, [block])), [block, "state_t"], "left")  # a row a block and state


def confusion(df: DataFrame, obs: str, pred: str, n_states: int) -> DataFrame:
    """(observed, predicted, n, pct): counts for all pairs of states and the share within the observed row."""
    rows = df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull())
    n = rows.groupBy(F.col(obs).alias("observed"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))
    grid = _states(df, n_states, "observed").crossJoin(_states(df, n_states, "predicted"))
    out = grid.join(F.broadcast(n), ["observed", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("observed"))
    return out.withColumn("pct", F.when(total == 0, F.lit(0.0)).otherwise(F.round(100 * F.col("n") / total, 1)))


def scores(df: DataFrame, obs: str, pred: str, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """accuracy, kappa (quadratic weights), rmse, n; null scores where no pair is complete.

    The quadratic weights make the kappa a matter of five sums: no table of states is needed.
    """
    o, p = F.col(obs).cast("double"), F.col(pred).cast("double")
    rows = df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull())
    n = F.count("*")
    apart = F.sum((o - p) * (o - p))
    chance = F.sum(o * o) + F.sum(p * p) - 2 * F.sum(o) * F.sum(p) / n
    return rows.groupBy(*by).agg(
        F.round(F.avg((o == p).cast("double")), digits).alias("accuracy"),
        F.round(1 - apart / F.nullif(chance, F.lit(0.0)), digits).alias("kappa"),
        F.round(F.sqrt(apart / F.nullif(n, F.lit(0))), digits).alias("rmse"),
        n.alias("n"),
    )


def class_metrics(df: DataFrame, obs: str, pred: str, n_states: int) -> DataFrame:
    """(state, precision, recall, f1, support) of each state; undefined ones are null."""
    c = confusion(df, obs, pred, n_states)
    both = c.select(F.explode(F.array(F.struct(F.col("observed").alias("state"), F.lit(True).alias("o"), F.col("predicted").alias("other"), "n"), F.struct(F.col("predicted").alias("state"), F.lit(False).alias("o"), F.col("observed").alias("other"), "n"))).alias("s")).select("s.*")
    t = both.groupBy("state").agg(
        F.sum(F.when(F.col("o") & (F.col("state") == F.col("other")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("o"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("o"), F.col("n")).otherwise(0)).alias("named"),
    )
    t = t.withColumns({"precision": F.col("hit") / F.nullif("named", F.lit(0)), "recall": F.col("hit") / F.nullif("support", F.lit(0))})
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return t.select("state", F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"), F.round(f1, 3).alias("f1"), "support")


def pontius(df: DataFrame, obs: str, pred: str, n_states: int) -> DataFrame:
    """One row: kappa, k_location, k_quantity."""
    c = confusion(df, obs, pred, n_states)
    rows = c.groupBy(F.col("observed").alias("state")).agg(F.sum("n").alias("r"), F.sum(F.when(F.col("observed") == F.col("predicted"), F.col("n")).otherwise(0)).alias("d"))
    cols = c.groupBy(F.col("predicted").alias("state")).agg(F.sum("n").alias("s"))
    t = rows.join(cols, "state").agg(F.sum("d").alias("d"), F.sum("r").alias("n"), F.sum(F.col("r") * F.col("s")).alias("k"), F.sum(F.least("r", "s")).alias("m"))
    n = F.nullif(F.col("n"), F.lit(0))
    t = t.select((F.col("d") / n).alias("p"), (F.col("k") / (n * n)).alias("k"), (F.col("m") / n).alias("m"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0.0)), 3)
    p, k, m = F.col("p"), F.col("k"), F.col("m")
    return t.select(ratio(p - k, 1 - k).alias("kappa"), ratio(p - k, m - k).alias("k_location"), ratio(m - k, 1 - k).alias("k_quantity"))


def evaluate_predictions(predicted: DataFrame | None, obs: str, pred: str, n_states: int, model: str, with_pontius: bool = False) -> dict[str, DataFrame]:
    """Full evaluation of one model's predictions: ``summary`` (model, status, kappa, accuracy: one row), ``confusion``,
    ``classes`` and, if asked for, ``pontius``; no tables where there is no prediction (its status is ``NO_PREDICTION``)."""
    if predicted is None or predicted.where(F.col(pred).isNotNull()).isEmpty():
        return {}
    named = lambda df: df.select(F.lit(model).alias("model"), "*")
    out = {
        "summary": named(scores(predicted, obs, pred).select(F.lit("ok").alias("status"), "kappa", "accuracy")),
        "confusion": named(confusion(predicted, obs, pred, n_states)),
        "classes": named(class_metrics(predicted, obs, pred, n_states)),
    }
    if with_pontius:
        out["pontius"] = named(pontius(predicted, obs, pred, n_states))
    return out


def fold_summary(folds: DataFrame, value: str = "kappa") -> DataFrame:
    """Mean and sample deviation over folds that have a value; the deviation is null under two."""
    return folds.agg(F.round(F.avg(value), 3).alias("mean"), F.round(F.when(F.count(value) > 1, F.stddev_samp(value)), 3).alias("sd"))


def worst_year(panel: DataFrame, state: str = "state", year: str = "year") -> DataFrame:
    """The year with the most hexes in a state over 0, the earliest on ties: one row (year, infested)."""
    return panel.groupBy(year).agg(F.count_if(F.col(state) > 0).alias("infested")).orderBy(F.desc("infested"), year).limit(1)


def territory(predicted: DataFrame, obs: str = "state_t1", pred: str = "predicted", year: str = "year_t", key: str = "hex_id") -> DataFrame:
    """Observed, predicted, error class, size and signed label of the gap per hex, in the worst year."""
    worst = worst_year(predicted, obs, year).select(year)
    rows = predicted.join(F.broadcast(worst), year, "left_semi")  # one row
    gap = F.col(pred) - F.col(obs)
    return rows.select(key, year, F.col(obs).alias("observed"), F.col(pred).alias("predicted"), error_class(F.col(obs), F.col(pred)).alias("error"), F.abs(gap).alias("size"), gap_label(gap).alias("gap"))


def gap_domain(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """All signed gaps from the largest negative to the largest positive, with labels."""
    most = df.agg(F.max(F.abs(F.col(pred) - F.col(obs))).alias("m"))
    return most.select(F.explode(F.sequence(-F.col("m"), F.col("m"))).alias("gap")).select("gap", gap_label(F.col("gap")).alias("label"))


def class_weights(df: DataFrame, state: str, n_states: int) -> DataFrame:
    """Inverse-frequency weights of the states, with mean 1."""
    n = _states(df, n_states, "state").join(F.broadcast(df.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"))), "state", "left")
    all_ = Window.partitionBy()  # a row a state
    n = n.withColumn("n", F.coalesce("n", F.lit(0)))
    n = n.withColumn("w", F.sum("n").over(all_) / (n_states * F.greatest("n", F.lit(1))))
    return n.select("state", "n", (F.col("w") / F.avg("w").over(all_)).alias("weight"))
