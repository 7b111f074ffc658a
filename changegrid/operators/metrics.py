"""Change-detection metrics and losses as partial aggregates over scored pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.functions import expr

from changegrid.functions.expr import num

TARGET_F1, TARGET_IOU = 0.88, 0.80


def confusion(rows: DataFrame, by: Sequence[str] = (), thr: float = 0.5, prob: str = "prob", target: str = "target") -> DataFrame:
    """TP, FP, FN, TN; sums are associative, so batching and partitioning cannot change them."""
    hit = f"{prob} > {num(thr)}"
    return rows.groupBy(*by).agg(
        expr(f"count_if({hit} and {target} = 1) as tp"), expr(f"count_if({hit} and {target} = 0) as fp"),
        expr(f"count_if(not ({hit}) and {target} = 1) as fn"), expr(f"count_if(not ({hit}) and {target} = 0) as tn"),
    )


def _ratio(a: str, b: str) -> str:
    return f"coalesce(double({a}) / nullif(double({b}), 0D), 0D)"


def scores(counts: DataFrame) -> DataFrame:
    """F1, IoU, precision, recall, accuracy (0 when undefined) and kappa (NULL when undefined)."""
    n = "double(tp + fp + fn + tn)"
    chance = f"(((tp + fp) * double(tp + fn) + (fn + tn) * double(fp + tn)) / nullif({n} * {n}, 0D))"
    return counts.selectExpr(
        "*",
        f"{_ratio('2 * tp', '2 * tp + fp + fn')} as f1",
        f"{_ratio('tp', 'tp + fp + fn')} as iou",
        f"{_ratio('tp', 'tp + fp')} as precision",
        f"{_ratio('tp', 'tp + fn')} as recall",
        f"{_ratio('tp + tn', 'tp + fp + fn + tn')} as accuracy",
        f"((tp + tn) / nullif({n}, 0D) - {chance}) / nullif(1 - {chance}, 0D) as kappa",
    )


def cd_metrics(rows: DataFrame, by: Sequence[str] = (), thr: float = 0.5, **cols) -> DataFrame:
    return scores(confusion(rows, by, thr, **cols))


def sample_f1(rows: DataFrame, sample: str = "sample_id", thr: float = 0.5) -> DataFrame:
    """F1 per sample; an empty prediction of an empty truth counts as perfect."""
    return confusion(rows, [sample], thr).selectExpr(sample, "tp", "fp", "fn", "coalesce(2D * tp / nullif(double(2 * tp + fp + fn), 0D), 1D) as f1")


def f1_summary(samples: DataFrame) -> DataFrame:
    return samples.agg(
        expr("count(1) as n_samples"), expr("coalesce(avg(f1), 0D) as mean_f1"),
        expr("coalesce(min(f1), 0D) as worst_f1"), expr("coalesce(max(f1), 0D) as best_f1"),
    )


def worst_samples(samples: DataFrame, n: int = 10, sample: str = "sample_id") -> DataFrame:
    return samples.orderBy("f1", sample).limit(n)


def target_verdict(metrics: DataFrame, f1: float = TARGET_F1, iou: float = TARGET_IOU) -> DataFrame:
    return metrics.selectExpr("f1", "iou", f"f1 >= {num(f1)} as f1_met", f"iou >= {num(iou)} as iou_met").selectExpr("*", "f1_met and iou_met as success")


def evaluation_rows(metrics: DataFrame, checkpoint: str, split: str, threshold: float, n_samples: DataFrame, encoder: str) -> DataFrame:
    """Metrics with their run settings, ready for a JSON sink; `n_samples` is a one-row table of that column."""
    return metrics.selectExpr("*", "1 as _one").join(n_samples.selectExpr("n_samples", "1 as _one"), "_one").selectExpr(
        "f1", "iou", "precision", "recall", "accuracy", "kappa",
        f"'{checkpoint}' as checkpoint", f"'{split}' as split", f"{num(threshold)} as threshold",
        "bigint(n_samples) as n_samples", f"'{encoder}' as encoder",
    )


_DICE = "(1 - (2 * sum({p} * {y}) + {s}) / (sum({p}) + sum({y}) + {s}))"


def dice_loss(rows: DataFrame, by: Sequence[str] = (), smooth: float = 1.0, p: str = "prob", y: str = "target") -> DataFrame:
    return rows.groupBy(*by).agg(expr(f"{_DICE.format(p=p, y=y, s=num(smooth))} as dice_loss"))


def _check_weights(a: float, b: float) -> None:
    if abs(a + b - 1.0) >= 1e-6:
        raise ValueError(f"loss weights must sum to 1.0, got {a + b}")


def bce_dice_loss(
    rows: DataFrame, by: Sequence[str] = (), bce_weight: float = 0.5, dice_weight: float = 0.5, smooth: float = 1.0, p: str = "prob", y: str = "target"
) -> DataFrame:
    """Cross entropy plus Dice; logarithms are clamped at -100."""
    _check_weights(bce_weight, dice_weight)
    log = lambda x: f"if({x} <= 0, -100D, greatest(ln({x}), -100D))"
    bce = f"avg(-({y} * {log(p)} + (1 - {y}) * {log(f'(1 - {p})')}))"
    dice = _DICE.format(p=p, y=y, s=num(smooth))
    return rows.groupBy(*by).agg(
        expr(f"{bce} as bce"), expr(f"{dice} as dice_loss"), expr(f"{num(bce_weight)} * {bce} + {num(dice_weight)} * {dice} as loss")
    )


def focal_dice_loss(
    rows: DataFrame, by: Sequence[str] = (), alpha: float = 0.25, gamma: float = 2.0, focal_weight: float = 0.5, dice_weight: float = 0.5,
    smooth: float = 1.0, p: str = "prob", y: str = "target",
) -> DataFrame:
    """Focal term on probabilities clamped to [1e-6, 1-1e-6], plus Dice."""
    q = f"least(greatest({p}, 1e-6D), 1 - 1e-6D)"
    ce = f"(-({y} * ln({q}) + (1 - {y}) * ln(1 - {q})))"
    pt = f"({p} * {y} + (1 - {p}) * (1 - {y}))"
    focal = f"avg(({num(alpha)} * {y} + {num(1 - alpha)} * (1 - {y})) * {ce} * pow(1 - {pt}, {num(gamma)}))"
    dice = _DICE.format(p=p, y=y, s=num(smooth))
    return rows.groupBy(*by).agg(
        expr(f"{focal} as focal"), expr(f"{dice} as dice_loss"), expr(f"{num(focal_weight)} * {focal} + {num(dice_weight)} * {dice} as loss")
    )


def change_pct(mask: DataFrame, changed: str = "changed") -> DataFrame:
    return mask.groupBy("scene_id").agg(expr(f"avg({changed}) * 100 as change_pct"))


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float], prob: str = "prob", target: str = "target") -> DataFrame:
    """Metrics at many thresholds in one pass.

    A row is counted once, in the bin of thresholds it exceeds; running sums over the few bins
    give every confusion matrix. Rows are never multiplied by the number of thresholds.
    """
    ts = sorted(thresholds)
    passed = " + ".join(f"int({prob} > {num(t)})" for t in ts)
    bins = rows.selectExpr(f"{passed} as bin", f"{target} as y").groupBy("bin").agg(
        expr("count_if(y = 1) as pos"), expr("count_if(y = 0) as neg")
    )
    spark = rows.sparkSession
    levels = ", ".join(f"struct({k + 1} as k, {num(t)} as threshold)" for k, t in enumerate(ts))
    marks = spark.sql(f"select l.k as k, l.threshold as threshold from (select explode(array({levels})) as l)")
    # The marks and the bins both have at most len(thresholds)+1 rows.
    seeds = spark.sql(f"select explode(sequence(0, {len(ts)})) as bin, 0L as pos, 0L as neg")
    full = bins.unionByName(seeds).groupBy("bin").agg(expr("sum(pos) as pos"), expr("sum(neg) as neg"))
    above = full.selectExpr(
        "bin as k",
        "sum(pos) over (order by bin desc) as tp", "sum(neg) over (order by bin desc) as fp",
        "sum(pos) over () as _p", "sum(neg) over () as _n",
    )
    return scores(above.join(marks, "k").selectExpr("threshold", "tp", "fp", "_p - tp as fn", "_n - fp as tn"))


def run_comparison(rows: DataFrame, config: str, dataset: str, base: str, max_drop: float = 0.10, thr: float = 0.5) -> DataFrame:
    """F1 per configuration and dataset, drop against the base dataset, best configuration."""
    f1 = cd_metrics(rows, [config, dataset], thr).select(config, dataset, "f1", "iou")
    ref = f1.where(f"{dataset} = '{base}'").selectExpr(config, "f1 as base_f1")
    best = f1.groupBy(dataset).agg(expr(f"max_by({config}, struct(f1, {config})) as best_config"))
    return f1.join(ref, config, "left").join(best, dataset).selectExpr(
        config, dataset, "f1", "iou", "base_f1",
        "(base_f1 - f1) / nullif(base_f1, 0D) as drop",
        f"coalesce((base_f1 - f1) / nullif(base_f1, 0D) > {num(max_drop)}, false) as degraded",
        f"{config} = best_config as is_best",
    )
