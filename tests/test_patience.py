"""Patience, best round and truncation of the boosted classifier (M1)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import evaluation, training
from cargoscope.schemas import FEATURE_COLS, LABEL_COL


def plain_best(losses, patience):
    """The rule, round by round over all earlier ones."""
    for i in range(1, len(losses) + 1):
        seen = losses[:i]
        best = seen.index(min(seen)) + 1
        if i - best >= patience:
            return best, True
    return (losses.index(min(losses)) + 1 if losses else 0), False


@pytest.mark.parametrize("seed", range(5))
def test_best_round_equals_the_plain_rule(seed):
    rnd = random.Random(seed)
    for _ in range(100):
        losses = [rnd.choice([0.1, 0.2, 0.3, 0.4, 0.5]) for _ in range(rnd.randrange(30))]
        for patience in (1, 3, 8):
            assert training.best_round(losses, patience) == plain_best(losses, patience)
    assert training.best_round([math.nan] * 5, 3) == (0, True)
    assert training.best_round([3.0, 2.0, 1.0, 5.0, 5.0, 0.1], 2) == (3, True)


def split_frame(spark, label):
    cols = [F.rand(seed=i).alias(c) for i, c in enumerate(FEATURE_COLS)]
    rows = spark.range(2000, numPartitions=4).select("id", *cols)
    return rows.select("*", label.cast("int").alias(LABEL_COL),
                       F.when(F.col("id") % 5 > 0, "train").otherwise("test").alias("split")).cache()


def test_learnable_labels_beat_the_base_rate(spark, scratch):
    label = (F.col(FEATURE_COLS[0]) + F.col(FEATURE_COLS[1]) > 1.5)
    split = split_frame(spark, label)
    model, best, losses = training.train_best(split, patience=3, max_iter=12, maxDepth=3, stepSize=0.3)
    assert training.rounds_used(model) == best <= len(losses) <= 12
    assert losses[best - 1] == min(losses[:best + 3])
    row = training.test_losses(model, split).first()
    assert row["loss"] == pytest.approx(losses[best - 1], abs=1e-9)
    assert row["loss"] < 0.5 * row["constant_loss"]
    training.save_model(model, f"{scratch}/cut")
    again = training.load_model(f"{scratch}/cut")
    assert training.rounds_used(again) == best
    assert training.test_losses(again, split).first() == row
    test = training.training_frame(split).filter("is_validation")
    from pyspark.ml.functions import vector_to_array
    scored = again.transform(test).withColumn("p", vector_to_array("probability")[1])
    base = test.agg(F.avg("label")).first()[0]
    assert evaluation.average_precision(scored, LABEL_COL, "p").first()[0] > 3 * base


def test_noise_stops_early_and_the_cut_equals_a_shorter_fit(spark):
    split = split_frame(spark, F.rand(seed=99) < 0.2)
    model, best, losses = training.train_best(split, patience=2, max_iter=40, maxDepth=4)
    assert len(losses) < 40 and best <= len(losses) - 2
    full = training.train(split, len(losses), early_stopping=False, maxDepth=4)
    cut = training.first_rounds(full, 2)
    assert training.rounds_used(cut) == 2 and training.first_rounds(full, 99) is full
    short = training.train(split, 2, early_stopping=False, maxDepth=4)
    assert (training.test_losses(cut, split).first()["loss"]
            == pytest.approx(training.test_losses(short, split).first()["loss"], abs=1e-12))


def test_no_test_rows(spark):
    split = split_frame(spark, F.col(FEATURE_COLS[0]) > 0.5).filter("split = 'train'")
    model, best, _ = training.train_best(split, patience=1, max_iter=2, maxDepth=2)
    assert best == training.rounds_used(model) >= 1
