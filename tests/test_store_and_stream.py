import json

import pytest

from changegrid import fixtures as fx
from changegrid.operators import detections as det
from changegrid.plans.change_detection import detect_changes
from changegrid.sources import detections as store, images, rasters, runlogs
from changegrid.streaming import ingest


@pytest.fixture()
def one(spark):
    return spark.sql(
        "select 0 as scene_id, 1L as region_id, 1600D as area_m2, 0.92D as mean_confidence, 10D as bbox_minx, 10D as bbox_miny,"
        " 50D as bbox_maxx, 50D as bbox_maxy, '2023-01-01' as timestamp_a, '2024-01-01' as timestamp_b"
    )


def test_empty_store_reads_with_schema(spark, tmp_path):
    df = store.read_detections(spark, str(tmp_path / "none"))
    assert df.count() == 0 and "detection_id" in df.columns


def test_insert_fills_in_and_query_finds(spark, tmp_path, one):
    path = str(tmp_path / "d")
    store.insert(one, path)
    rows = store.read_detections(spark, path)
    row = rows.first()
    assert len(row.detection_id) == 36 and row.created_at is not None and row.epsg == 4326
    assert det.by_id(rows, row.detection_id).count() == 1 and det.by_id(rows, "x' or '1'='1").count() == 0
    for box, n in {(0, 0, 100, 100): 1, (500, 500, 600, 600): 0, (-180, -90, 180, 90): 1, (999, 999, 1000, 1000): 0, (50, 50, 60, 60): 1}.items():
        assert det.bbox_query(rows, *box).count() == n
    store.insert(one.selectExpr("*", "'x' as extra"), path)
    assert store.read_detections(spark, path).count() == 2 and "extra" in store.read_detections(spark, path).columns


def test_dedup_insert_adds_nothing_twice(spark, tmp_path, one):
    path = str(tmp_path / "d")
    rows = one.selectExpr("*", "'id-1' as detection_id")
    store.insert(rows, path, dedup=True)
    store.insert(rows.unionByName(rows), path, dedup=True)
    assert store.read_detections(spark, path).count() == 1


def test_box_filter_reaches_the_files(spark, tmp_path, one, capsys):
    path = str(tmp_path / "d")
    store.insert(one, path)
    det.bbox_query(store.read_detections(spark, path), 0, 0, 1, 1).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "LessThanOrEqual(bbox_minx,1.0)" in plan


def test_exact_box_test_sees_the_notch(spark):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), named_struct('x', 10D, 'y', 2D), named_struct('x', 2D, 'y', 2D), named_struct('x', 2D, 'y', 10D), named_struct('x', 0D, 'y', 10D), named_struct('x', 0D, 'y', 0D))"
    df = spark.sql(f"select 'L' as detection_id, 0D as bbox_minx, 0D as bbox_miny, 10D as bbox_maxx, 10D as bbox_maxy, array(array({ring})) as polygons")
    hit = lambda *b: det.bbox_query(df, *b).count() == 1
    assert not hit(5, 5, 8, 8) and hit(2, 5, 8, 8) and hit(0.5, 0.5, 0.6, 0.6) and hit(-5, -5, 20, 20) and hit(1, -5, 1.5, 20)


def test_aoi_join_equals_brute_force(spark):
    d = spark.range(300).selectExpr("concat('d', id) as detection_id", "(id * 37 % 211) * 9D as x", "(id * 53 % 197) * 8D as y", "pow(id % 13, 3) + 1 as s").selectExpr(
        "detection_id", "x as bbox_minx", "y as bbox_miny", "x + s as bbox_maxx", "y + s as bbox_maxy")
    a = spark.range(40).selectExpr("id as aoi_id", "(id * 71 % 97) * 20D - 100 as x", "(id * 29 % 89) * 18D as y", "pow(10, id % 5) as s").selectExpr(
        "aoi_id", "x as minx", "y as miny", "x + s as maxx", "y + s as maxy")
    want = d.crossJoin(a).where("bbox_minx <= maxx and bbox_maxx >= minx and bbox_miny <= maxy and bbox_maxy >= miny").select("aoi_id", "detection_id")
    got = det.aoi_join(d, a, cell=50.0)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_geojson_documents(spark, tmp_path, one):
    bare_row = one.selectExpr("*", "'a' as detection_id", "cast(null as array<array<array<struct<x:double,y:double>>>>) as polygons")
    assert det.geojson_features(bare_row).count() == 0
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D), named_struct('x', 0D, 'y', 0D))"
    rows = one.selectExpr("*", "'a' as detection_id", f"array(array({ring})) as polygons")
    doc = json.loads(det.geojson_features(rows).first().feature)
    assert doc["geometry"]["type"] == "Polygon" and doc["geometry"]["coordinates"][0][2] == [1.0, 1.0] and doc["properties"]["area_m2"] == 1600.0
    store.write_geojson(rows, str(tmp_path / "g"))
    assert json.loads(spark.read.text(str(tmp_path / "g")).first().value)["properties"]["detection_id"] == "a"
    bare = spark.sql("""select 1 as id, '{"type":"Point","coordinates":[1,2]}' as geometry union all select 2, null""")
    assert [json.loads(r.feature)["properties"]["id"] for r in det.wrap_features(bare).collect()] == [1]


def test_result_document_defaults(one):
    row = det.result_rows(one).first()
    assert (row.detection_id, row.centroid_x, row.bbox.maxx, row.timestamp_a, row.created_at) == ("", 0.0, 50.0, "2023-01-01", "")


def _png(path, rgb):
    import struct, zlib

    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[r].tobytes() for r in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_path):
    import numpy as np

    rgb = np.random.default_rng(0).integers(0, 256, (4, 6, 3), dtype=np.uint8)
    for split in ("train", "val", "test"):
        for side in ("A", "B", "label"):
            _png(tmp_path / split / side / f"img_{split}.png", rgb)
    got = images.read_images(spark, str(tmp_path / "train" / "A")).orderBy("band").collect()
    assert [r.image_id for r in got] == ["img_train"] * 3
    for r in got:
        assert np.allclose(np.reshape(r.data, (4, 6)), rgb[:, :, r.band] / 255.0)
    files = images.file_listing(spark, str(tmp_path))
    assert images.split_layout(files).first().layout == "presplit"
    assert [r.image_id for r in images.image_ids(files).collect()] == ["img_test", "img_train", "img_val"]
    assert images.with_split(files).where("split = 'val' and side = 'label'").count() == 1
    assert images.route_files(files).select("reader").distinct().first().reader == "plain"
    import hashlib

    data = (tmp_path / "val" / "B" / "img_val.png").read_bytes()
    assert images.file_digests(spark, str(tmp_path / "val" / "B")).first().digest == hashlib.sha256(data).hexdigest()[:8]
    names = spark.createDataFrame([("/x/site1_A.tif",), ("/x/site1_B.TIF",), ("/x/other.png",)], "path string")
    assert {(r.image_id, r.side) for r in images.suffix_pairs(names).collect()} == {("site1", "A"), ("site1", "B")}
    assert images.route_files(names).where("reader = 'raster'").count() == 2
    images.write_patches(images.with_split(files).select("image_id", "side", "split"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("split = 'train'").count() == 3


def test_change_map_and_history_round_trip(spark, tmp_path, pixels, meta_of):
    import numpy as np

    img = np.random.default_rng(1).random((5, 6))
    rasters.write_change_map(pixels(img, value="p"), meta_of([(0, 5, 6)]), str(tmp_path / "m"), block=4)
    back = rasters.read_blocks(spark, str(tmp_path / "m" / "blocks"))
    assert back.where("band = 2").selectExpr("sum(size(data)) as n").first().n == 30
    assert spark.read.parquet(str(tmp_path / "m" / "scenes")).first().band_tags["1"]["DESCRIPTION"] == "binary_change_mask"
    (tmp_path / "run7.json").write_text(json.dumps({k: [0.1, 0.2] for k in ("train_loss", "val_loss", "val_f1", "val_iou", "lr")}))
    rows = runlogs.read_history(spark, str(tmp_path / "run7.json")).orderBy("epoch").collect()
    assert [(r.run_id, r.epoch, r.val_f1) for r in rows] == [("run7", 1, 0.1), ("run7", 2, 0.2)]


def _detector(spark, sf):
    blocks, meta = fx.raster_blocks(spark, sf), fx.scene_meta(spark, sf)

    def detect(batch):
        wanted = batch.select("scene_id").distinct()
        return detect_changes(blocks.join(wanted, "scene_id"), meta, 5, fx.BLOCK_H, fx.COLS, min_area_px=4)

    return detect


def test_one_or_many_batches_give_the_same_detections(spark, sf, tmp_path):
    rows = fx.manifest(spark, sf).selectExpr("pair_id", "scene_id", "cast(submitted_at as timestamp) as submitted_at").where("pair_id < 3")
    rows.repartition(2, "pair_id").write.parquet(str(tmp_path / "in"))
    got = {}
    for files in (None, 1):
        out = str(tmp_path / f"out{files}")
        stream = ingest.read_manifest(spark, str(tmp_path / "in"), max_files=files)
        q = ingest.run_detection(stream, _detector(spark, sf), out, out + "-ckpt")
        q.awaitTermination()
        ids = [r.detection_id for r in ingest.read_stream_detections(spark, out).select("detection_id").collect()]
        assert len(ids) == len(set(ids))
        got[files] = set(ids)
        assert det.status_counts(ingest.read_log(spark, out)).first().status == "complete"
    assert got[None] == got[1] and got[1]


def test_a_failing_batch_is_logged_and_passed(spark, tmp_path):
    spark.sql("select 1L as pair_id, 0 as scene_id, timestamp'2024-01-01 00:00:00' as submitted_at").write.parquet(str(tmp_path / "in"))

    def broken(batch):
        raise RuntimeError("no such image")

    out = str(tmp_path / "out")
    ingest.run_detection(ingest.read_manifest(spark, str(tmp_path / "in")), broken, out, out + "-c").awaitTermination()
    row = ingest.read_log(spark, out).first()
    assert row.status == "failed" and "no such image" in row.message


def test_one_broken_pair_fails_alone_and_is_tried_again(spark, one, tmp_path):
    at = "timestamp'2024-01-01 00:00:00' as submitted_at"
    spark.sql(f"select id as pair_id, int(id) as scene_id, {at} from range(6)").coalesce(1).write.parquet(str(tmp_path / "in"))
    out, healed = str(tmp_path / "out"), []

    def detect(batch):
        if not healed and batch.where("pair_id = 3").count():
            raise RuntimeError("no such image")
        return batch.selectExpr("string(pair_id) as detection_id", "scene_id", "1D as area_m2")

    ingest.run_detection(ingest.read_manifest(spark, str(tmp_path / "in")), detect, out, out + "-c").awaitTermination()
    assert {r.pair_id for r in ingest.read_log(spark, out).where("status = 'failed'").collect()} == {3}
    assert ingest.read_stream_detections(spark, out).count() == 5
    healed.append(True)
    spark.sql(f"select 9L as pair_id, 9 as scene_id, {at}").write.mode("append").parquet(str(tmp_path / "in"))
    ingest.run_detection(ingest.read_manifest(spark, str(tmp_path / "in")), detect, out, out + "-c").awaitTermination()
    assert {r.detection_id for r in ingest.read_stream_detections(spark, out).collect()} == {*"0123459"}
    assert ingest.read_log(spark, out).where("pair_id = 3 and attempt = 2 and status = 'complete'").count() == 1


def test_a_replayed_batch_leaves_each_detection_once(spark, tmp_path):
    """The first try is halved by an error and its checkpoint is lost after it was stored; the second goes through whole."""
    at = "timestamp'2024-01-01 00:00:00' as submitted_at"
    spark.sql(f"select id as pair_id, int(id) as scene_id, {at} from range(4)").coalesce(1).write.parquet(str(tmp_path / "in"))
    out, tries = str(tmp_path / "out"), []

    def detect(batch):
        tries.append(batch.count())
        if len(tries) == 1:
            raise RuntimeError("lost")
        return batch.selectExpr("string(pair_id) as detection_id", "scene_id", "1D as area_m2")

    for name in ("c1", "c2"):
        ingest.run_detection(ingest.read_manifest(spark, str(tmp_path / "in")), detect, out, str(tmp_path / name)).awaitTermination()
    assert tries[0] == 4 and tries[-1] == 4 and len(tries) > 3
    assert sorted(r.detection_id for r in ingest.read_stream_detections(spark, out).collect()) == [*"0123"]
    assert ingest.read_log(spark, out).count() == 4 and spark.read.parquet(f"{out}/log").count() == 8


def test_a_half_written_batch_is_not_seen(spark, tmp_path):
    """A driver that is lost between the parts and the commit leaves nothing that is read."""
    spark.sql("select 1L as pair_id, 0 as scene_id, timestamp'2024-01-01 00:00:00' as submitted_at").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    rows = spark.sql("select 'stale' as detection_id, 0 as scene_id, 1D as area_m2, 4 as bucket, 'p-0' as part")
    rows.write.partitionBy("bucket", "part").parquet(f"{out}/detections")
    assert ingest.read_stream_detections(spark, out).count() == 0
    detect = lambda batch: batch.selectExpr("'new' as detection_id", "scene_id", "1D as area_m2")
    ingest.run_detection(ingest.read_manifest(spark, str(tmp_path / "in")), detect, out, out + "-c").awaitTermination()
    assert [r.detection_id for r in ingest.read_stream_detections(spark, out).collect()] == ["new"]


def test_a_later_batch_reads_its_scenes_only(spark, tmp_path):
    at = "timestamp'2024-01-01 00:00:00' as submitted_at"
    detect = lambda batch: batch.selectExpr("concat('d', scene_id) as detection_id", "scene_id", "1D as area_m2")
    out = str(tmp_path / "out")
    for lo, hi in ((0, 20), (20, 22)):
        spark.sql(f"select id as pair_id, int(id % 20) as scene_id, {at} from range({lo}, {hi})").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.run_detection(ingest.read_manifest(spark, str(tmp_path / "in")), detect, out, out + "-c").awaitTermination()
    assert ingest.read_stream_detections(spark, out).count() == 20  # the scenes that came again added nothing
    batch = spark.sql("select 0L as pair_id, 3 as scene_id")
    earlier = ingest._earlier_ids(batch, out, 5)
    plan = earlier._jdf.queryExecution().toString()
    assert [r.detection_id for r in earlier.collect()] == ["d3"] and "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1][:200]


def test_stream_dedup_and_totals(spark, sf, tmp_path, one):
    m = fx.manifest(spark, sf).selectExpr("pair_id", "scene_id", "cast(submitted_at as timestamp) as submitted_at")
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    dedup = ingest.dedup_submissions(ingest.read_manifest(spark, str(tmp_path / "in")), "40 days")
    q = dedup.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("pairs").count() == m.select("pair_id").distinct().count()
    one.write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(one.schema).parquet(str(tmp_path / "d"))
    q = ingest.serve_totals(stream, "totals", str(tmp_path / "c2"), every=None)
    q.awaitTermination()
    row = spark.table("totals").first()
    assert (row.total, row.total_area, row.avg_confidence) == (1, 1600.0, 0.92)
