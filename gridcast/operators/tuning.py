"""Hyper-parameter search: trials are rows, each trained by a task of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import models

#: Search space: batch sizes, epochs, dropout range, unit ranges (recurrent, perceptron), perceptron layers.
BATCHES, EPOCHS, DROPOUT, UNITS, MLP_UNITS, MLP_LAYERS = (16, 32, 64), (10, 20, 30), (0.1, 0.5), (32, 128), (100, 500), (1, 3)
TRIAL = "trial int, model string, batch int, epochs int, dropout double, units int, layers int"


def trial_grid(spark: SparkSession, model: str = "gru", trials: int = 20, seed: int = 11) -> DataFrame:
    """Seeded random draws from the search space."""
    rng = np.random.default_rng([seed, models.KINDS.index(model)])
    low, high = MLP_UNITS if model == "mlp" else UNITS
    rows = [
        (k, model, int(rng.choice(BATCHES)), int(rng.choice(EPOCHS)), round(float(rng.uniform(*DROPOUT)), 3), int(rng.integers(low, high + 1)), int(rng.integers(MLP_LAYERS[0], MLP_LAYERS[1] + 1)) if model == "mlp" else 1)
        for k in range(trials)
    ]
    return spark.createDataFrame(rows, TRIAL)


def run_trials(trials: DataFrame, windows: DataFrame, limit: int = 20_000, epochs: int | None = None, key: str = "i") -> DataFrame:
    """trial, model, epoch, metric, value of every trial; a trial that fails has no rows (it is pruned).

    Training data is the bounded sample of models.sample_matrices, sent to the workers once as a broadcast.
    """
    spark = trials.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast((*models.sample_matrices(windows, "train", limit, key), *models.sample_matrices(windows, "val", limit, key)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for t in df.itertuples():
                spec = models.Spec(t.model, int(t.units), int(t.layers), float(t.dropout), int(t.batch), int(epochs or t.epochs), seed=int(t.trial))
                try:
                    fitted = models.train(spec, *data.value)
                except (ValueError, FloatingPointError, np.linalg.LinAlgError):
                    continue
                rows = [(t.trial, t.model, h["epoch"], k, v) for h in fitted.history for k, v in h.items() if k != "epoch"]
                yield pd.DataFrame(rows, columns=["trial", "model", "epoch", "metric", "value"])

    own = trials.repartition(max(1, trials.count()), "trial")
    return own.mapInPandas(run, "trial int, model string, epoch int, metric string, value double")


def retrain(windows: DataFrame, trial: Row, key: str = "i") -> models.Fitted:
    """The model of a row of the trial grid, trained on every window."""
    return models.train_on(windows, models.Spec(trial["model"], trial["units"], trial["layers"], trial["dropout"], trial["batch"], trial["epochs"], seed=trial["trial"]), key)


def best_trial(history: DataFrame, metric: str = "val_nrmse") -> DataFrame:
    """model, trial, value: of every model the trial whose last epoch has the least value."""
    last = history.filter(F.col("metric") == metric).groupBy("model", "trial").agg(F.max_by("value", "epoch").alias("value"))
    return last.groupBy("model").agg(F.min_by(F.struct("trial", "value"), F.struct("value", "trial")).alias("best")).select("model", "best.trial", "best.value")
