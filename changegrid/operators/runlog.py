"""Training-run logs: epoch means, best epoch, checkpoints to keep, early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.functions import expr

from changegrid.functions.expr import num


def epoch_loss(steps: DataFrame) -> DataFrame:
    """Mean step loss per run and epoch."""
    return steps.groupBy("run_id", "epoch").agg(expr("sum(loss) / greatest(count(1), 1) as epoch_loss"))


def best_epoch(runs: DataFrame, score: str = "val_f1") -> DataFrame:
    """Epoch of the highest score, the earliest on ties."""
    return runs.groupBy("run_id").agg(
        expr(f"max_by(epoch, struct({score}, -epoch)) as best_epoch"), expr(f"max({score}) as best_score"), expr("count(1) as n_epochs")
    )


def topk_checkpoints(runs: DataFrame, k: int = 3, score: str = "val_f1") -> DataFrame:
    """Checkpoints to keep; the rank filter is applied before the shuffle as well."""
    return runs.selectExpr(
        "run_id", "epoch", score, f"row_number() over (partition by run_id order by {score} desc, epoch) as rank"
    ).where(f"rank <= {k}")


def early_stop(runs: DataFrame, patience: int = 15, min_delta: float = 1e-4, score: str = "val_f1") -> DataFrame:
    """Epoch at which a run would stop, NULL if it never does, and the accepted best score.

    A score counts only when it beats the last accepted best by more than `min_delta`, which
    a running maximum cannot express; the fold walks one run's epochs (one value per epoch).
    """
    step = (
        "if(s.stop is not null, s, if(e.score > s.best + {d},"
        " named_struct('best', e.score, 'wait', 0, 'stop', cast(null as int)),"
        " named_struct('best', s.best, 'wait', s.wait + 1, 'stop', if(s.wait + 1 >= {p}, int(e.epoch), null))))"
    ).format(d=num(min_delta), p=patience)
    start = "named_struct('best', double('-infinity'), 'wait', 0, 'stop', cast(null as int))"
    return (
        runs.groupBy("run_id")
        .agg(expr(f"array_sort(collect_list(struct(epoch, {score} as score))) as es"))
        .selectExpr("run_id", f"aggregate(es, {start}, (s, e) -> {step}) as s")
        .selectExpr("run_id", "s.stop as stop_epoch", "s.best as accepted_best", "s.wait as waited")
    )


def explode_history(history: DataFrame) -> DataFrame:
    """Parallel per-epoch lists to one row per epoch (numbered from 1)."""
    lists = [c for c in history.columns if c != "run_id"]
    return history.selectExpr("run_id", f"posexplode(arrays_zip({', '.join(lists)})) as (i, h)").selectExpr(
        "run_id", "i + 1 as epoch", *[f"h.{c} as {c}" for c in lists]
    )
