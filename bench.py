"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs to completion into a sink that discards rows. Product tables (score map,
labels, detections) that queries read are built first and timed as `build_*`.
"""

from __future__ import annotations

import json
import os
import time

from changegrid import catalog
from changegrid.session import local_session

HEADLINE = (
    "detect_changes", "detect_changes_full", "change_score", "percentile_stretch", "split_tiles", "stitch_tiles", "stitch_tiles_cli", "tile_pairs", "score_tiles",
    "regions", "polygonize", "zonal_mean", "neighbour_edges", "warp_bilinear", "warp_blocks", "resize_bilinear", "blur3",
    "knn2", "ratio_matches", "fit_homography", "registration_qc", "cd_metrics", "threshold_sweep", "bce_dice_loss",
    "image_split", "best_epoch", "topk_checkpoints", "early_stop", "leakage_check", "patch_ids",
    "aoi_join", "bbox_query", "bbox_query_exact", "area_filter", "detection_stats", "detection_list", "manifest_dedup",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.read.parquet(f"{sf}/events.parquet").selectExpr("sum(value)").collect()  # start-up, not measured
    queries, times = dict(catalog.QUERIES), {}

    def timed(name, fn):
        start = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    timed("build_raster", lambda: catalog.raster_blocks(spark, sf))
    timed("build_scores", lambda: catalog.score_map(spark, sf))
    timed("build_labels", lambda: catalog.labelled(spark, sf))
    timed("build_detections", lambda: catalog.detection_table(spark, sf))
    for name in HEADLINE:
        timed(name, lambda: run(queries[name](spark, sf)))
    pixels = catalog.prob(spark, sf).count()
    changed = catalog.mask(spark, sf).count()
    found = catalog.detection_table(spark, sf).count()
    rates = {
        "split_stitch_pixels_per_sec": round(pixels / times["stitch_tiles"]),
        "label_changed_pixels_per_sec": round(changed / times["regions"]),
        "bbox_rows_per_sec": round(found / times["bbox_query"]),
    }
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf.rstrip("/")), "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
