"""Training data and the anomaly classifier.

The reference pulls the whole training query into one pandas frame on one
machine; here every step stays distributed: the scan is a pushed filter, the
means are one aggregate, the 80/20 split compares rows with the exact cut
key, and the classifier is Spark ML's gradient-boosted trees.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.functions.columns import as_of_for
from cargoscope.operators.scoring import ASSEMBLED, MODEL_INPUTS
from cargoscope.operators.tables import since_partitions
from cargoscope.plans.ranking import kth_key, with_global_position
from cargoscope.schemas import FEATURE_COLS, LABEL_COL

TRAIN_WINDOW_DAYS = 90
TRAIN_FRACTION = 0.8

# Classifier settings of the reference, mapped to Spark's GBT (fixed values).
GBT_PARAMS = {"maxDepth": 6, "stepSize": 0.05, "maxIter": 500, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "0.8", "minInstancesPerNode": 10, "seed": 42}
POSITIVE_WEIGHT = 10.0
PATIENCE = 20


def load_training(df: DataFrame, as_of=None, days: int = TRAIN_WINDOW_DAYS,
                  time_col: str = "timestamp", label_col: str = LABEL_COL) -> DataFrame:
    """Labelled rows of the last ``days`` days, bound included.

    The bound on day or month partitions is added where the table has them;
    the label filter is pushed to the parquet scan.
    """
    since = as_of_for(df, time_col, as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return since_partitions(df, since).filter(F.col(label_col).isNotNull() & (F.col(time_col) >= since))


def select_features(df: DataFrame, keep: list[str] = (), label_col: str = LABEL_COL) -> DataFrame:
    """The seven features and the label (B17). A missing
    ``hours_since_last_checkpoint`` column (absent from the warehouse table,
    S24) is taken as 0.0."""
    cols = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c)
            for c in FEATURE_COLS]
    return df.select(*keep, *cols, F.col(label_col))


def impute(df: DataFrame, cols: list[str] = FEATURE_COLS, strategy: str = "mean",
           fit_on: DataFrame | None = None) -> DataFrame:
    """Fill missing values (null or NaN) with a per-column statistic.

    ``strategy="mean"`` (the code's behaviour; exact) or ``"median"``
    (``percentile_approx``). Fitted on ``fit_on`` (default: all rows,
    including the later test part, as the reference does). The statistic is
    one aggregate row, so only ``len(cols)`` numbers reach the driver.
    """
    if strategy not in ("mean", "median"):
        raise ValueError(f"strategy must be mean or median, got {strategy!r}")
    source = df if fit_on is None else fit_on

    def present(c):
        return F.when(~F.isnan(F.col(c)), F.col(c))

    if strategy == "mean":
        stats = source.agg(*[F.avg(present(c)).alias(c) for c in cols]).first()
    else:
        stats = source.agg(*[F.percentile_approx(present(c), 0.5, 10000).alias(c)
                             for c in cols]).first()
    out = df
    for c in cols:
        value = stats[c]
        if value is not None:
            out = out.withColumn(c, F.when(F.col(c).isNull() | F.isnan(F.col(c)), F.lit(float(value)))
                                 .otherwise(F.col(c)))
    return out


def temporal_split(df: DataFrame, order: list[str], fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Adds ``split`` = train for the first ``floor(fraction * n)`` rows in
    ``order`` and test for the rest (F5, S23).

    ``order`` must be total; (time, device_id, a unique id) is the intended
    one. Only the cut is looked for, by selection on the whole key
    (``plans.ranking.kth_key``), so it makes no difference how many rows share
    a day, a minute or an instant. The rows themselves pass one comparison with
    the cut's key: no shuffle, no copy.
    """
    total = df.count()
    last = kth_key(df, order, math.floor(float(total) * float(fraction)))
    if last is None:
        return df.withColumn("split", F.lit("test"))
    key = F.struct(*[F.col(c) for c in order])
    return df.withColumn("split", F.when(key <= last, "train").otherwise("test"))


def with_row_positions(df: DataFrame, order: list[str], num_partitions: int | None = None) -> DataFrame:
    """Adds each row's exact 0-based position in ``order`` as ``row_pos``; a
    range shuffle of all rows, for callers that need more than the split."""
    return with_global_position(df, [F.col(c) for c in order], name="row_pos", total_name=None,
                                num_partitions=num_partitions)


def split_stats(split: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """Rows and anomaly rate per split."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.avg(F.col(label_col).cast("double")).alias("anomaly_rate"))


def training_frame(split: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """Model inputs, class weight (scale_pos_weight) and the validation flag."""
    return split.select(
        "*", *[F.col(c).cast("double").alias(f) for c, f in zip(FEATURE_COLS, MODEL_INPUTS)],
        F.col(label_col).cast("double").alias("label"),
        F.when(F.col(label_col) == 1, POSITIVE_WEIGHT).otherwise(1.0).alias("weight"),
        (F.col("split") == "test").alias("is_validation"))


def train(split: DataFrame, max_iter: int | None = None, label_col: str = LABEL_COL,
          early_stopping: bool = True, **overrides):
    """Fit ``VectorAssembler -> GBTClassifier`` on the split frame (M1).

    The test part is the validation set for early stopping when
    ``early_stopping`` (Spark stops on a validation tolerance; ``train_best``
    stops after a number of rounds). Returns the fitted ``PipelineModel``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    params = dict(GBT_PARAMS)
    if max_iter is not None:
        params["maxIter"] = int(max_iter)
    params.update(overrides)
    frame = training_frame(split, label_col)
    if not early_stopping:
        frame = frame.filter(~F.col("is_validation"))
    assembler = VectorAssembler(inputCols=MODEL_INPUTS, outputCol=ASSEMBLED, handleInvalid="keep")
    gbt = GBTClassifier(featuresCol=ASSEMBLED, labelCol="label", weightCol="weight", **params)
    if early_stopping:
        gbt.setValidationIndicatorCol("is_validation")
    return Pipeline(stages=[assembler, gbt]).fit(frame)


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """(round with the least loss, counted from 1; True if ``patience`` rounds
    passed after it without a lesser one). Of equal losses the first counts;
    what comes after the patience has run out is not looked at."""
    best, least = 0, math.inf
    for i, loss in enumerate(losses, 1):
        if loss < least:
            best, least = i, loss
        elif i - best >= patience:
            return best, True
    return best, False


def held_out_losses(model, split: DataFrame, label_col: str = LABEL_COL) -> list[float]:
    """Mean log loss of the test part after each round, rows weighted as in
    training; all rounds in one pass."""
    test = model.stages[0].transform(
        training_frame(split, label_col).filter(F.col("is_validation")))
    # Spark's logistic loss is 2 ln(1 + exp(-2 y F)), twice the log loss of its probabilities.
    return [x / 2 for x in model.stages[-1].evaluateEachIteration(test)]


def test_losses(model, split: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """One row: ``loss``, the model's weighted log loss on the test part, and
    ``constant_loss``, that of giving every row the train part's weighted share
    of positives."""
    from pyspark.ml.functions import vector_to_array

    frame = training_frame(split, label_col)
    p = vector_to_array("probability")[1]
    scored = model.transform(frame.filter(F.col("is_validation"))).agg(
        (-F.sum(F.col("weight") * F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))
         / F.sum("weight")).alias("loss"))
    held, up = F.col("is_validation"), F.col("label") == 1

    def weight(rows):
        return F.sum(F.when(rows, F.col("weight")).otherwise(0.0))

    share = weight(~held & up) / weight(~held)
    constant = frame.agg((-(weight(held & up) * F.log(share) + weight(held & ~up) * F.log(1 - share))
                          / weight(held)).alias("constant_loss"))
    return scored.crossJoin(constant)  # one row each


def first_rounds(model, n: int):
    """The fitted pipeline with its first ``n`` trees only."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassificationModel

    gbt = model.stages[-1]
    if n >= gbt.getNumTrees:
        return model
    gateway = SparkSession.active().sparkContext._gateway
    jvm = gateway.jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for i, (tree, weight) in enumerate(zip(gbt.trees[:n], gbt.treeWeights[:n])):
        trees[i], weights[i] = tree._java_obj, weight
    cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        gbt.uid, trees, weights))
    cut._resetUid(gbt.uid)
    return PipelineModel([*model.stages[:-1], gbt._copyValues(cut)])


def train_best(split: DataFrame, patience: int = PATIENCE, max_iter: int | None = None,
               label_col: str = LABEL_COL, **overrides) -> tuple[object, int, list[float]]:
    """Fit on the train part, stop ``patience`` rounds after the least held-out
    log loss and keep the rounds up to it (M1). Returns the pipeline, its best
    round and the losses of all rounds fitted.

    Spark's trainer has no such rule, so fits of 2, 4, 8, ... times the
    patience are tried until one shows the stop or reaches ``max_iter``; all of
    them together take at most twice the rounds of the last. Without test rows
    all rounds are kept and there are no losses.
    """
    most = GBT_PARAMS["maxIter"] if max_iter is None else int(max_iter)
    if split.filter(F.col("split") == "test").isEmpty():
        model = train(split, most, label_col, early_stopping=False, **overrides)
        return model, rounds_used(model), []
    rounds = min(most, 2 * patience)
    while True:
        model = train(split, rounds, label_col, early_stopping=False, **overrides)
        losses = held_out_losses(model, split, label_col)
        best, stopped = best_round(losses, patience)
        if stopped or rounds >= most:
            return first_rounds(model, max(best, 1)), max(best, 1), losses
        rounds = min(most, 2 * rounds)


def rounds_used(model) -> int:
    """Boosting rounds that the model kept."""
    return model.stages[-1].getNumTrees


def save_model(model, path: str) -> None:
    """Persist the fitted pipeline (A11); the path may be any Hadoop URI."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
