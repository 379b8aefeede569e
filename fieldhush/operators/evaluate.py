"""Scores against labels: confusion counts, curves, thresholds, votes and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhush.operators.ranks import value_ranks
from fieldhush.sources.scratch import sized


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion(df: DataFrame, by: Sequence[str], label: str, pred: Column) -> DataFrame:
    """tp, fp, fn, tn with precision, recall, F1 and accuracy; empty denominators give 0."""
    p, y = pred.cast("boolean"), F.col(label) == 1
    g = df.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                            F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    return rates(g)


def rates(g: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    g = g.withColumn("precision", _zero(F.try_divide(tp, tp + fp))).withColumn("recall", _zero(F.try_divide(tp, tp + fn)))
    f1 = _zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return g.withColumn("f1", f1).withColumn("accuracy", _zero(F.try_divide(tp + tn, tp + fp + fn + tn)))


def pr_curve(df: DataFrame, by: Sequence[str], score: str, label: str, block_rows: int | None = None) -> DataFrame:
    """Precision and recall at every distinct score taken as the threshold (score >= threshold)."""
    y = F.col(label).cast("long")
    c = value_ranks(df, by, score, {"pos": y, "neg": 1 - y}, descending=True, block_rows=block_rows)
    total = df.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.sum(y).alias("__p"))
    c = c.join(sized(total), list(by)) if by else c.crossJoin(F.broadcast(total))
    return c.select(*by, F.col(score).alias("threshold"), F.try_divide("pos_cum", F.col("pos_cum") + F.col("neg_cum")).alias("precision"),
                    _zero(F.try_divide("pos_cum", "__p")).alias("recall"))


def best_threshold(curve: DataFrame, by: Sequence[str], least: float = 0.7) -> DataFrame:
    """Highest precision + recall with both at least ``least``, else without that rule; the lowest such threshold.

    The threshold is chosen on the labels it is judged on, so the result is optimistic.
    """
    total = F.col("precision") + F.col("recall")
    ok = (F.col("precision") >= least) & (F.col("recall") >= least)
    # Sums that differ by rounding noise count as equal, so the tie rule decides.
    key = F.struct(ok.cast("int").alias("ok"), F.round(total, 9).alias("s"), (-F.col("threshold")).alias("t"))
    row = F.struct("threshold", "precision", "recall", ok.alias("beats"))
    return curve.groupBy(*by).agg(F.max_by(row, key).alias("__b")).select(*by, "__b.*")


def threshold_sweep(df: DataFrame, by: Sequence[str], score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion measures at each listed threshold, from one aggregation."""
    y = F.col(label) == 1
    rows = df.select(*by, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), F.col(score).alias("__s"), y.alias("__y"))
    hit = F.col("__s") >= F.col("threshold")
    g = rows.groupBy(*by, "threshold").agg(
        F.count_if(hit & F.col("__y")).alias("tp"), F.count_if(hit & ~F.col("__y")).alias("fp"),
        F.count_if(~hit & F.col("__y")).alias("fn"), F.count_if(~hit & ~F.col("__y")).alias("tn"))
    return rates(g)


def roc_auc(df: DataFrame, by: Sequence[str], score: str, label: str, block_rows: int | None = None) -> DataFrame:
    """Area under the ROC curve from average ranks; null when a class is missing."""
    y = F.col(label).cast("long")
    r = value_ranks(df, by, score, {"pos": y}, block_rows=block_rows)
    g = r.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"),
                           F.sum(F.col("pos") * F.col("avg_rank")).alias("__rs"))
    u = F.col("__rs") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return g.withColumn("auc", F.try_divide(u, (F.col("n_pos") * F.col("n_neg")).cast("double"))).drop("__rs")


def segment_vote(df: DataFrame, by: Sequence[str], score: str, label: str, threshold: float, share: float = 0.5) -> DataFrame:
    """Clip-level vote: positive when at least ``share`` of its segments reach the threshold."""
    g = df.groupBy(*by).agg(F.max(label).alias(label), F.avg((F.col(score) >= threshold).cast("double")).alias("vote_share"))
    return g.withColumn("pred", (F.col("vote_share") >= share).cast("int"))


def majority_lift(df: DataFrame, by: Sequence[str], truth: str, pred: str, margin: float = 0.15) -> DataFrame:
    """Accuracy against the share of the most common class; ``confounded`` when the lift exceeds ``margin``."""
    g = df.groupBy(*by, truth).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(pred)).alias("hit"))
    out = g.groupBy(*by).agg((F.sum("hit") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("chance"))
    return out.withColumn("lift", F.col("accuracy") - F.col("chance")).withColumn("confounded", F.col("lift") > margin)


def pass_table(folds: DataFrame, by: Sequence[str], least: float = 0.7) -> DataFrame:
    """Mean precision and recall over folds and whether both reach ``least``."""
    g = folds.groupBy(*by).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    return g.withColumn("passes", (F.col("precision") >= least) & (F.col("recall") >= least))


def outcome(label: str, pred: Column) -> Column:
    p, y = pred.cast("boolean"), F.col(label) == 1
    return F.when(p & y, "TP").when(p & ~y, "FP").when(~p & y, "FN").otherwise("TN")


def closer_class(df: DataFrame, values: Sequence[str], outcome_col: str) -> DataFrame:
    """Per feature the mean of false alarms, detections and quiet baseline, and which of the two is closer."""
    long = df.select(outcome_col, F.explode(F.array(*[
        F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("v")) for v in values])).alias("__f")).select(outcome_col, "__f.*")
    mean = lambda k: F.avg(F.when(F.col(outcome_col) == k, F.col("v")))
    g = long.groupBy("feature").agg(mean("FP").alias("fp_mean"), mean("TP").alias("sim_mean"), mean("TN").alias("base_mean"))
    closer = F.when(F.abs(F.col("fp_mean") - F.col("sim_mean")) < F.abs(F.col("fp_mean") - F.col("base_mean")), "simulation").otherwise("baseline")
    return g.withColumn("closer", closer)


def alarm_rate(df: DataFrame, by: Sequence[str], label: str, pred: Column, high: float = 0.25) -> DataFrame:
    """False alarms over baseline clips per group; ``high`` marks rates above the limit."""
    g = df.filter(F.col(label) == 0).groupBy(*by).agg(F.count("*").alias("baseline"), F.count_if(pred).alias("false_alarms"))
    g = g.withColumn("rate", F.col("false_alarms") / F.col("baseline"))
    return g.withColumn("high", F.col("rate") > high)


# The verdict texts and their limits.
def matched_verdict(before: Column, after: Column) -> Column:
    """STABLE within 0.05, DATE CONFOUND LIKELY below -0.10, else SLIGHT DROP."""
    change = after - before
    return F.when(F.abs(change) < 0.05, "STABLE").when(change < -0.10, "DATE CONFOUND LIKELY").otherwise("SLIGHT DROP")
