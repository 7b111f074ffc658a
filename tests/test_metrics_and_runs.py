import pytest

from changegrid.operators import dataset, metrics, runlog


def _rows(spark, pred, target):
    return spark.createDataFrame(list(zip(map(float, pred), target)), "prob double, target int")


def test_known_confusion(spark):
    m = metrics.cd_metrics(_rows(spark, [0.9, 0.9, 0.9, 0.1], [1, 0, 1, 0])).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 0, 1)
    assert m.f1 == pytest.approx(0.8) and m.iou == pytest.approx(2 / 3) and m.kappa == pytest.approx(0.5)


def test_perfect_and_empty(spark):
    assert metrics.cd_metrics(_rows(spark, [0.9, 0.9, 0.1, 0.1], [1, 1, 0, 0])).first().f1 == 1.0
    none = metrics.cd_metrics(_rows(spark, [0.0] * 4, [1] * 4)).first()
    assert (none.f1, none.iou, none.precision) == (0.0, 0.0, 0.0)
    zero = metrics.cd_metrics(_rows(spark, [0.0] * 4, [0] * 4)).first()
    assert zero.f1 == 0.0 and zero.kappa is None


def test_partitioning_cannot_change_metrics(spark):
    df = spark.range(1000).selectExpr("(id * 37 % 101) / 101D as prob", "int(id % 3 = 0) as target")
    assert metrics.cd_metrics(df.repartition(13)).first() == metrics.cd_metrics(df.coalesce(1)).first()


def test_sample_f1_of_two_empty_masks_is_one(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0), ("b", 0.9, 0)], "sample_id string, prob double, target int")
    assert {r.sample_id: r.f1 for r in metrics.sample_f1(df).collect()} == {"a": 1.0, "b": 0.0}
    assert metrics.f1_summary(metrics.sample_f1(df.limit(0))).first().mean_f1 == 0.0


def test_losses(spark):
    assert metrics.dice_loss(_rows(spark, [1, 1], [1, 1])).first().dice_loss == pytest.approx(0.0)
    clamp = metrics.bce_dice_loss(_rows(spark, [0.0, 1.0], [1, 0])).first()
    assert clamp.bce == pytest.approx(100.0)
    with pytest.raises(ValueError):
        metrics.bce_dice_loss(_rows(spark, [0.5], [1]), bce_weight=0.7, dice_weight=0.7)


def test_threshold_sweep_equals_single_runs(spark):
    df = spark.range(500).selectExpr("(id * 53 % 100) / 100D as prob", "int(id % 4 = 0) as target")
    for row in metrics.threshold_sweep(df, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        one = metrics.cd_metrics(df, thr=row.threshold).first()
        assert (row.tp, row.fp, row.fn, row.tn, row.f1) == (one.tp, one.fp, one.fn, one.tn, one.f1)


def _runs(spark, scores):
    return spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "run_id int, epoch int, val_f1 double")


def test_early_stopping(spark):
    stop = lambda scores: runlog.early_stop(_runs(spark, scores), patience=3).first()
    assert stop([0.5, 0.6, 0.7, 0.8]).stop_epoch is None
    assert stop([0.8, 0.7, 0.7, 0.7]).stop_epoch == 4
    assert stop([0.5, 0.8, 0.7, 0.9]).accepted_best == 0.9
    # Steps below min_delta add up without ever being accepted.
    assert stop([0.5, 0.50006, 0.50009, 0.5001]).stop_epoch == 4


def test_topk_and_best(spark):
    runs = _runs(spark, [0.5, 0.8, 0.7, 0.8])
    assert [r.epoch for r in runlog.topk_checkpoints(runs, 2).orderBy("rank").collect()] == [2, 4]
    assert runlog.best_epoch(runs).first().best_epoch == 2


def test_split_is_exact_and_stable(spark):
    ids = spark.range(1003).selectExpr("concat('img_', id) as image_id")
    split = dataset.image_split(ids)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 702, "val": 150, "test": 151}
    assert split.exceptAll(dataset.image_split(ids.repartition(7))).count() == 0
    assert dataset.leakage(split).count() == 0
    dataset.assert_no_leakage(split)
    with pytest.raises(RuntimeError):
        dataset.assert_no_leakage(split.unionByName(split.selectExpr("image_id", "'other' as split")))


def test_zero_counts_are_kept(spark):
    got = {r.split: r.n_patches for r in dataset.split_counts(spark.sql("select 'val' as split")).collect()}
    assert got == {"train": 0, "val": 1, "test": 0}
