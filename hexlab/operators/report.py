"""Spatio-temporal evaluation of forecasts, and assembly of the panel from declared builders."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import io
from ..sources.scratch import cut
from . import evaluate, models, panel

SUMMARY = "model string, kappa_spatial_mean double, kappa_spatial_sd double, kappa_temporal double, accuracy double, status string"

# Why a model cannot run.
NO_TRAIN, NO_TEST, OK = "train_vide", "test_vide", "ok"


@dataclass(frozen=True)
class Model:
    """A forecast to evaluate: (train, test) to ``test`` with ``predicted``, or None; whether its Pontius kappas are
    reported; and, where there is one, a way to predict all folds at once: (train, block) to predictions."""

    predict: Callable[[DataFrame, DataFrame], DataFrame | None]
    pontius: bool = False
    folds: Callable[[DataFrame, str], DataFrame] | None = None


def registry(covariates: Sequence[str], n_states: int, trees: int = 300, categorical: Sequence[str] = ()) -> dict[str, Model]:
    """Models by name."""
    return {
        "Markov": Model(lambda train, test: evaluate.markov_predict(train, test, n_states), True, lambda train, block: evaluate.markov_block_cv(train, n_states, block)),
        "RandomForest": Model(lambda train, test: models.forest_predict(train, test, ["state_t", *covariates], trees=trees, categorical=categorical)),
    }


def status_of(train: DataFrame, test: DataFrame) -> str:
    """Why a model cannot run, or "ok"."""
    if train.isEmpty():
        return NO_TRAIN
    return NO_TEST if test.isEmpty() else OK


def evaluate_models(pairs: DataFrame, train_years: tuple[int, int], test_years: tuple[int, int], n_states: int, use: dict[str, Model], block: str = "block") -> dict[str, DataFrame]:
    """Tables: ``summary`` (a row a model: kappa over spatial blocks within the training years and on the years held out),
    ``per_block``, and of the years held out ``confusion``, ``classes`` and, for models that ask for it, ``pontius``."""
    split = evaluate.split_years(pairs, train_years, test_years)
    train, test = cut(split.where("split = 'train'").drop("split")), cut(split.where("split = 'test'").drop("split"))
    why, spark = status_of(train, test), pairs.sparkSession
    blocks = [] if why == NO_TRAIN else sorted(r[0] for r in train.select(block).distinct().collect())  # 3 to 5
    parts: dict[str, list[DataFrame]] = {}
    rows = []
    for name, model in use.items():
        folds = None
        if model.folds is not None and blocks:
            folds = model.folds(train, block)
        else:
            for b in blocks:
                got = model.predict(train.where(F.col(block) != b), train.where(F.col(block) == b))
                if got is not None:
                    got = got.select(block, "state_t1", "predicted")
                    folds = got if folds is None else folds.unionAll(got)
        mean = None
        if folds is not None:
            per_block = cut(evaluate.scores(folds, "state_t1", "predicted", [block]).select(F.lit(name).alias("model"), F.col(block).alias("block"), "kappa"))
            parts.setdefault("per_block", []).append(per_block)
            mean = evaluate.fold_summary(per_block).first()
        last = model.predict(train, test) if why == OK else None
        found = evaluate.evaluate_predictions(last if last is None else cut(last), "state_t1", "predicted", n_states, name, model.pontius)
        for kind in ("confusion", "classes", "pontius"):
            if kind in found:
                parts.setdefault(kind, []).append(found[kind])
        s = found["summary"].first() if found else None
        status = s["status"] if s else why if why != OK else evaluate.NO_PREDICTION
        rows.append((name, mean and mean["mean"], mean and mean["sd"], s and s["kappa"], s and s["accuracy"], status))
    out = {"summary": spark.createDataFrame(rows, SUMMARY)}
    for kind, tables in parts.items():
        out[kind] = functools.reduce(DataFrame.unionAll, tables)
    return out


def quick_comparison(pairs: DataFrame, train_years: tuple[int, int], test_years: tuple[int, int], use: dict[str, Model]) -> DataFrame:
    """(model, status, accuracy, kappa, rmse, n) of each model on one split by years."""
    split = evaluate.split_years(pairs, train_years, test_years)
    train, test = cut(split.where("split = 'train'").drop("split")), cut(split.where("split = 'test'").drop("split"))
    why, out = status_of(train, test), []
    empty = pairs.sparkSession.createDataFrame([], "state_t1 int, predicted int")
    for name, model in use.items():
        got = model.predict(train, test) if why == OK else None
        status = why if why != OK else OK if got is not None else evaluate.NO_PREDICTION
        s = evaluate.scores(empty if got is None else got, "state_t1", "predicted")
        out.append(s.select(F.lit(name).alias("model"), F.lit(status).alias("status"), "*"))
    return functools.reduce(DataFrame.unionAll, out)


def cross_section(panel_: DataFrame, edges: DataFrame, year: int, covariates: Sequence[str], y: str = "severity", key: str = "hex_id") -> DataFrame:
    """The regressions of one year of the panel (``models.compare_models``)."""
    rows = panel_.where(F.col("year") == year).select(key, y, *covariates, *[c for c in ("q", "r") if c in panel_.columns and c not in covariates])
    return models.compare_models(rows, edges, y, list(covariates), key)


def panel_for_models(spark: SparkSession, path: str | None, regions: Sequence[str], width: float, build: Callable[[], tuple[DataFrame, dict[str, list[str]]]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """The panel and the groups of its covariates: from the cache where there is one, else built; without groups in
    the cache, or built on the fly, every covariate serves as its builder says."""
    if path is not None and (cached := io.cached_panel(spark, path, regions, width)) is not None:
        return cached
    return build()


def build_panel(cells: DataFrame, observed: DataFrame, items: dict[str, Callable[[DataFrame], DataFrame]], static: Sequence[DataFrame] = (), key: str = "hex_id") -> DataFrame:
    """Complete panel with the covariates of the builders; each builder gets the panel and returns (key, year, name)."""
    full = cut(panel.complete_panel(cells, observed.select("year"), observed, key))
    yearly = [build(full).select(key, "year", name) for name, build in items.items()]
    return panel.with_covariates(full, static, yearly, key).orderBy("year", key)
