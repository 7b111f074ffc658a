"""Continuous detection: manifests arrive as files, detections and a job log grow.

Every write makes a part of its own, which nobody sees until its batch commits: one file per batch
lists the batch's parts and is put in place by one rename. A batch that is replayed after a lost
driver writes new parts and replaces that list; parts of the earlier try are listed nowhere.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import expr, lit
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from changegrid.operators.detections import stats
from changegrid.sources.detections import SCHEMA, complete

SCENE_BUCKETS = 256
SCENE_BUCKET = f"int(pmod(xxhash64(scene_id), {SCENE_BUCKETS}))"
COMMIT_SCHEMA = "batch_id long, kind string, part string"
MANIFEST_SCHEMA = "pair_id long, scene_id int, submitted_at timestamp"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def dedup_submissions(manifest: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per pair; the watermark bounds the ids kept in state."""
    return manifest.withWatermark("submitted_at", delay).dropDuplicatesWithinWatermark(["pair_id"])


def latest_submissions(manifest: DataFrame) -> DataFrame:
    """Batch twin of the dedup: first submission per pair."""
    return manifest.groupBy("pair_id").agg(
        expr("min_by(scene_id, struct(submitted_at, event_id)) as scene_id"), expr("min(submitted_at) as submitted_at"), expr("count(1) as n_rows")
    )


def run_detection(
    manifest: DataFrame,
    detect: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    attempts: int = 3,
) -> StreamingQuery:
    """Detect changes for the pairs of each micro-batch and append them to `out`.

    `detect` maps a batch of manifest rows to detection rows. A failing batch is halved by a hash
    of its pairs until the failing pairs stand alone; those are logged with their message, all
    others are stored. Failed pairs of earlier batches are tried again with the next batch, up to
    `attempts` times. Output: `out/detections` by scene bucket and part, `out/log` (a row per pair
    and attempt) by part, `out/commits` (a file per batch that lists its parts).
    """

    def store(rows: DataFrame, batch: DataFrame, batch_id: int) -> str:
        rows, part = complete(rows), _new_part()
        # A scene that comes again adds only what is new; other scenes are not read.
        earlier = _earlier_ids(batch, out, batch_id)
        rows = rows if earlier is None else rows.join(earlier, "detection_id", "left_anti")
        placed = rows.withColumn("bucket", expr(SCENE_BUCKET)).withColumn("part", lit(part))
        placed.write.mode("append").partitionBy("bucket", "part").parquet(f"{out}/detections")
        return part

    def attempt(pairs: DataFrame, batch_id: int, depth: int) -> list[tuple[DataFrame, str, str]]:
        """Store what can be stored: (pairs, part, "") per stored part, (pairs, "", message) per failing one."""
        try:
            return [(pairs, store(detect(pairs), pairs, batch_id), "")]
        except Exception as e:
            if pairs.select("pair_id").distinct().count() <= 1:
                return [(pairs, "", str(e)[:2000] or type(e).__name__)]
        found = []
        for side in (0, 1):
            half = pairs.where(f"xxhash64(pair_id, {depth}) & 1 = {side}")
            if not half.isEmpty():
                found += attempt(half, batch_id, depth + 1)
        return found

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pairs = batch.select("pair_id", "scene_id", lit(1).alias("attempt"))
        again = _failed_pairs(spark, out, batch_id, attempts)
        if again is not None:
            pairs = pairs.unionByName(again.join(pairs.select("pair_id"), "pair_id", "left_anti"))
        done, log_part = attempt(pairs, batch_id, 0), _new_part()
        logs = [
            p.select("pair_id", "scene_id", "attempt").withColumns(
                {"status": lit("failed" if message else "complete"), "message": lit(message), "finished_at": expr("current_timestamp()")}
            )
            for p, _, message in done
        ]
        log = reduce(DataFrame.unionByName, logs).withColumns({"batch_id": lit(batch_id).cast("long"), "part": lit(log_part)})
        log.write.mode("append").partitionBy("part").parquet(f"{out}/log")
        _commit(spark, out, batch_id, [("log", log_part), *(("detections", part) for _, part, _ in done if part)])

    return (
        manifest.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _read(spark: SparkSession, path: str, **options) -> DataFrame | None:
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _new_part() -> str:
    return f"p-{uuid.uuid4().hex}"


def _commit(spark: SparkSession, out: str, batch_id: int, parts: list[tuple[str, str]]) -> None:
    """Make the parts of a batch visible, and those of an earlier try of it invisible, by one rename."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    final, draft = hadoop.Path(f"{out}/commits/{batch_id}.json"), hadoop.Path(f"{out}/commits/_{batch_id}-{uuid.uuid4().hex}")
    text = "\n".join(json.dumps({"batch_id": batch_id, "kind": kind, "part": part}) for kind, part in parts)
    stream = draft.getFileSystem(conf).create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, overwrite)


def _committed(spark: SparkSession, out: str, kind: str, before: int | None = None) -> DataFrame | None:
    """(part) of the committed batches, or of those before a batch; a row per part."""
    try:
        commits = spark.read.schema(COMMIT_SCHEMA).json(f"{out}/commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return commits.where(f"kind = '{kind}'" + ("" if before is None else f" and batch_id < {before}")).select("part")


def _earlier_ids(batch: DataFrame, out: str, batch_id: int) -> DataFrame | None:
    """Ids that earlier batches wrote for the scenes of this batch; this batch's own are left out, so replays repeat.

    The buckets of the batch's scenes, at most SCENE_BUCKETS numbers, choose the folders to be read.
    """
    parts, stored = _committed(batch.sparkSession, out, "detections", batch_id), _read(batch.sparkSession, f"{out}/detections")
    if parts is None or stored is None:
        return None
    scenes = batch.select("scene_id").distinct()
    buckets = [r["bucket"] for r in scenes.selectExpr(f"{SCENE_BUCKET} as bucket").distinct().collect()]
    there = stored.where(stored["bucket"].isin(buckets)).select("scene_id", "detection_id", "part")
    return there.join(parts, "part").join(scenes, "scene_id", "left_semi").select("detection_id").distinct()


def _failed_pairs(spark: SparkSession, out: str, batch_id: int, attempts: int) -> DataFrame | None:
    """Pairs whose last attempt in earlier batches failed, with their next attempt's number."""
    parts, log = _committed(spark, out, "log", batch_id), _read(spark, f"{out}/log")
    if parts is None or log is None:
        return None
    last = log.join(parts, "part").groupBy("pair_id").agg(expr("max_by(struct(status, scene_id, attempt), batch_id) as s"))
    return last.where(f"s.status = 'failed' and s.attempt < {attempts}").selectExpr("pair_id", "s.scene_id", "s.attempt + 1 as attempt")


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """The log of all committed batches."""
    return spark.read.parquet(f"{out}/log").join(_committed(spark, out, "log"), "part").drop("part")


def read_stream_detections(spark: SparkSession, out: str) -> DataFrame:
    """Detections of all committed batches; an empty frame with the schema where there are none."""
    parts, stored = _committed(spark, out, "detections"), _read(spark, f"{out}/detections", mergeSchema="true")
    if parts is None or stored is None:
        return spark.createDataFrame([], SCHEMA)
    return stored.join(parts, "part").drop("part", "bucket")


def live_totals(detections: DataFrame) -> DataFrame:
    """Running count, area and mean confidence over a stream of detections."""
    return stats(detections)


def serve_totals(detections: DataFrame, name: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Keep the totals in an in-memory table that a viewer can poll."""
    writer = live_totals(detections).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
