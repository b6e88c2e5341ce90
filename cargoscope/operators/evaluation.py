"""Classifier evaluation (D7, D8, D9, M5), exact and distributed.

* ``classification_report``: one aggregate of the 2 × 2 confusion counts.
* ``roc_auc``: tie-correct rank statistic over the score histogram
  ``(Σ 2·pos·neg_below + pos·neg) / (2·P·N)``, counts kept integral.
* ``average_precision``: Σ (R_n − R_(n−1)) · P_n over distinct thresholds from
  the top.
The histogram is a partial aggregate (one row per distinct score); running
totals over it use ``plans.ranking`` so no window holds it in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.plans.ranking import with_running_sums
from cargoscope.schemas import ANOMALY_THRESHOLD

CLASS_NAMES = ("Normal", "Anomaly")
RESULT_DIGITS = 12


def with_prediction(df: DataFrame, score_col: str = "score",
                    threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """``prediction = 1`` when score >= threshold (the report's cut, M5)."""
    return df.withColumn("prediction", (F.col(score_col) >= F.lit(float(threshold))).cast("int"))


def confusion_counts(pred: DataFrame, label_col: str, pred_col: str = "prediction") -> DataFrame:
    y, p = F.col(label_col), F.col(pred_col)
    return pred.agg(F.count_if((y == 1) & (p == 1)).alias("tp"),
                    F.count_if((y == 0) & (p == 1)).alias("fp"),
                    F.count_if((y == 1) & (p == 0)).alias("fn"),
                    F.count_if((y == 0) & (p == 0)).alias("tn"))


def _ratio(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def classification_report(pred: DataFrame, label_col: str, pred_col: str = "prediction") -> DataFrame:
    """Per-class precision, recall, f1 and support; accuracy; macro and
    weighted averages (D7). Zero divisions give 0.0. Rows:
    Normal, Anomaly, accuracy, macro avg, weighted avg."""
    c = confusion_counts(pred, label_col, pred_col)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1, f1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp)
    s0, s1 = tn + fp, tp + fn
    acc = _ratio(tp + tn, n)

    def wavg(m0, m1):
        return F.when(n > 0, (s0.cast("double") * m0 + s1.cast("double") * m1) / n.cast("double")) \
            .otherwise(F.lit(0.0))

    def row(label, prec, rec, f, sup):
        return F.struct(F.lit(label).alias("class_label"), prec.alias("precision"),
                        rec.alias("recall"), f.alias("f1_score"), sup.cast("long").alias("support"))

    null = F.lit(None).cast("double")
    rows = F.array(
        row(CLASS_NAMES[0], p0, r0, f0, s0),
        row(CLASS_NAMES[1], p1, r1, f1, s1),
        row("accuracy", null, null, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), n),
    )
    return c.select(F.inline(rows))


def score_histogram(pred: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation)."""
    y = F.col(label_col)
    return (pred.filter(y.isNotNull() & F.col(score_col).isNotNull())
            .groupBy(F.col(score_col).alias("score"))
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def ranked_counts(pred: DataFrame, label_col: str, score_col: str,
                  num_partitions: int | None = None) -> DataFrame:
    """The score histogram with running counts from the lowest score and the
    totals: one range shuffle of distinct scores serves AUC, average precision
    and confusion counts alike."""
    return with_running_sums(score_histogram(pred, label_col, score_col), [F.col("score").asc()],
                             ["neg", "pos"], num_partitions=num_partitions)


def _curve_sums() -> list[F.Column]:
    dec = "decimal(38,0)"
    pos, neg = F.col("pos"), F.col("neg")
    below = F.col("cum_neg") - neg
    # Counts at or above a score, from the running counts below it.
    pos_above = F.col("total_pos") - F.col("cum_pos") + pos
    neg_above = F.col("total_neg") - F.col("cum_neg") + neg
    precision = pos_above.cast("double") / (pos_above + neg_above).cast("double")
    return [
        F.sum(pos.cast(dec) * below.cast(dec) * 2 + pos.cast(dec) * neg.cast(dec)).alias("pairs"),
        F.sum(pos.cast("double") * precision).alias("area"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N")]


def _auc() -> F.Column:
    return F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("pairs").cast("double")
                  / (F.col("P").cast("double") * F.col("N").cast("double") * 2))


def _average_precision() -> F.Column:
    return F.when(F.col("P") > 0, F.col("area") / F.col("P").cast("double"))


def roc_auc(pred: DataFrame, label_col: str, score_col: str = "score",
            num_partitions: int | None = None) -> DataFrame:
    """Tie-correct ROC AUC (D8); null when a class is absent."""
    return ranked_counts(pred, label_col, score_col, num_partitions).agg(*_curve_sums()).select(
        _auc().alias("roc_auc"))


def average_precision(pred: DataFrame, label_col: str, score_col: str = "score",
                      num_partitions: int | None = None) -> DataFrame:
    """Average precision over distinct thresholds from the top (D9); null
    without positives."""
    return ranked_counts(pred, label_col, score_col, num_partitions).agg(*_curve_sums()).select(
        _average_precision().alias("average_precision"))


def evaluate(pred: DataFrame, label_col: str, score_col: str = "score",
             threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """One row: ROC AUC, average precision and accuracy at the threshold (M5),
    all from one pass over the running counts. Rows without a label or score
    count nowhere."""
    at = F.col("score") >= threshold
    right = F.sum(F.when(at, F.col("pos")).otherwise(F.col("neg"))).alias("right")
    sums = ranked_counts(pred, label_col, score_col).agg(*_curve_sums(), right)
    rows = F.col("P") + F.col("N")
    return sums.select(_auc().alias("roc_auc"), _average_precision().alias("average_precision"),
                       F.when(rows > 0, F.col("right").cast("double") / rows.cast("double"))
                       .alias("accuracy"))
