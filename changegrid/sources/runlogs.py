"""Training history files and evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changegrid.operators.runlog import explode_history

_HISTORY = "train_loss array<double>, val_loss array<double>, val_f1 array<double>, val_iou array<double>, lr array<double>"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History documents (one per file) to one row per run and epoch."""
    raw = spark.read.option("multiLine", "true").schema(_HISTORY).json(path)
    return explode_history(raw.selectExpr("regexp_extract(_metadata.file_path, '([^/]+)\\\\.[^./]+$', 1) as run_id", "*"))


def write_evaluation(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
