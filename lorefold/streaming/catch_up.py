"""The projection of a growing log: catching up by Structured Streaming, rebuild, freshness and snapshots."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.operators.fold import fold_fields, read_log
from lorefold.session import cut

#: Parts that the kept log is divided into by a hash of the aggregate; a batch reads the parts it touches.
PARTS = 64
_ROWS = "entity_id string, field string, value string, position long, event_id string"
_STATUS = "batch long, position long, is_rebuilding boolean, updated_at timestamp"


def _part(column: str):
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")


def touched_entities(changed: DataFrame, merges: DataFrame) -> DataFrame:
    """(id): the aggregates of ``changed`` (id) and all that merges (a, b), valid or not, tie to them.

    One round for each link of the longest chain from a changed one; only ids
    travel, and there are as many merges as people confirmed.
    """
    both = merges.select("a", "b").unionAll(merges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ids = cut(changed.filter("id IS NOT NULL").distinct())
    frontier = ids
    while True:
        frontier = cut(both.join(frontier, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct().join(ids, "id", "left_anti"))
        if frontier.isEmpty():
            return ids
        ids = cut(ids.unionAll(frontier))


def _merges_of(log: DataFrame) -> DataFrame:
    return read_log(log.filter("type = 'EntitiesMerged'")).filter("merged_id IS NOT NULL").select(F.col("aggregate_id").alias("a"), F.col("merged_id").alias("b"))


def _refold(known: DataFrame, touched: DataFrame) -> DataFrame:
    """The fields of ``touched`` (id) from the part of the log that concerns them; an entity that holds nothing has one row of nulls."""
    folded = fold_fields(read_log(known.join(touched.withColumnRenamed("id", "aggregate_id"), "aggregate_id", "left_semi"))).select("entity_id", "field", "value", "position", "event_id")
    folded = cut(folded)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in folded.dtypes if c != "entity_id"]
    gone = touched.select(F.col("id").alias("entity_id"), *nothing).join(folded.select("entity_id").distinct(), "entity_id", "left_anti")
    return folded.unionByName(gone)


def catch_up(spark: SparkSession, log_dir: str, state_dir: str, checkpoint_dir: str, files_per_batch: int = 64) -> DataFrame:
    """Takes what is new under ``log_dir`` into the projection under ``state_dir`` and returns it.

    Each micro-batch keeps its events by batch and part, which makes a batch
    that is tried again overwrite itself. It folds the entities it touches,
    with those that merges tie to them, from the parts of the log that hold
    them, and writes them as a new generation with the position reached. The
    stream's own checkpoint holds which files were taken.
    """
    schema = spark.read.parquet(log_dir).schema

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("part", _part("aggregate_id")).persist()
        try:
            batch.write.mode("overwrite").partitionBy("part").parquet(f"{state_dir}/events/batch={number}")
            _merges_of(batch).write.mode("overwrite").parquet(f"{state_dir}/merges/batch={number}")
            merges = spark.read.schema("a string, b string").parquet(f"{state_dir}/merges")
            changed = batch.select(F.col("aggregate_id").alias("id")).unionAll(_merges_of(batch).select(F.col("b").alias("id")))
            touched = touched_entities(changed, merges)
            parts = [r.part for r in touched.select(_part("id").alias("part")).distinct().collect()]  # at most PARTS
            known = spark.read.schema(batch.schema).option("basePath", f"{state_dir}/events").parquet(f"{state_dir}/events").filter(F.col("part").isin(parts))
            _refold(known, touched).write.mode("overwrite").parquet(f"{state_dir}/fields/batch={number}")
            reached = batch.agg(F.coalesce(F.max("position"), F.lit(0)).alias("position"))
            _mark(spark, state_dir, number, reached, False)
        finally:
            batch.unpersist()

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if _is_file(spark, log_dir):  # a stream reads folders
        folder, _, name = log_dir.rpartition("/")
        source, log_dir = source.option("pathGlobFilter", name), folder
    query = (
        source.parquet(log_dir)
        .writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return projection(spark, state_dir)


def rebuild(spark: SparkSession, log_dir: str, state_dir: str, checkpoint_dir: str) -> DataFrame:
    """The projection folded from the whole log again: old generations and the stream's checkpoint are dropped first.

    While it runs, ``freshness`` says so.
    """
    for folder in (f"{state_dir}/events", f"{state_dir}/merges", f"{state_dir}/fields", f"{state_dir}/status", checkpoint_dir):
        _delete(spark, folder)
    _mark(spark, state_dir, -1, spark.range(1).select(F.lit(0).cast("long").alias("position")), True)
    return catch_up(spark, log_dir, state_dir, checkpoint_dir, files_per_batch=1 << 30)


def _mark(spark: SparkSession, state_dir: str, number: int, reached: DataFrame, is_rebuilding: bool) -> None:
    row = reached.select(F.col("position").cast("long").alias("position"), F.lit(is_rebuilding).alias("is_rebuilding"), F.current_timestamp().alias("updated_at"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/status/batch={number}")


def freshness(spark: SparkSession, state_dir: str) -> DataFrame:
    """(position, is_rebuilding): how far the projection has got; (0, false) where there is none."""
    try:
        status = spark.read.schema(_STATUS).parquet(f"{state_dir}/status")
    except AnalysisException:
        status = spark.createDataFrame([], _STATUS)
    return status.agg(F.coalesce(F.max("position"), F.lit(0)).alias("position"), F.coalesce(F.max_by("is_rebuilding", "batch"), F.lit(False)).alias("is_rebuilding"))


def stamped(rows: DataFrame, state_dir: str) -> DataFrame:
    """Any read with the freshness of the projection it comes from."""
    return rows.crossJoin(F.broadcast(freshness(rows.sparkSession, state_dir)))  # one row


def projection(spark: SparkSession, state_dir: str) -> DataFrame:
    """The newest generation of every entity's fields."""
    rows = spark.read.parquet(f"{state_dir}/fields")
    newest = rows.groupBy("entity_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["entity_id", "batch"]).filter("field IS NOT NULL").drop("batch")


def save_snapshot(rows: DataFrame, position: int, folder: str) -> bool:
    """Keeps the projection as it was at ``position``, unless one of a later position is kept; whether it was."""
    kept = latest_snapshot(rows.sparkSession, folder)
    if kept is not None and kept > position:
        return False
    rows.write.mode("overwrite").parquet(f"{folder}/position={position}")
    return True


def latest_snapshot(spark: SparkSession, folder: str) -> int | None:
    """The position of the newest snapshot, or None."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return max((int(n.split("=")[1]) for n in names if n.startswith("position=")), default=None)


def snapshot_due(position: int, last: int, cadence: float = float("inf")) -> bool:
    """Whether a snapshot is due; by default none ever is."""
    return position - last >= cadence


def rebuild_from_snapshot(log: DataFrame, folder: str) -> DataFrame:
    """The projection of the whole log, folding only entities that changed after the newest snapshot.

    A snapshot that can't be read is dropped, and everything is folded.
    """
    spark = log.sparkSession
    position = latest_snapshot(spark, folder)
    if position is not None:
        try:
            kept = spark.read.parquet(f"{folder}/position={position}").select("entity_id", "field", "value", "position", "event_id")
        except AnalysisException:
            _delete(spark, f"{folder}/position={position}")
            return rebuild_from_snapshot(log, folder)
        merges = _merges_of(log)
        tail = log.filter(F.col("position") > position)
        touched = touched_entities(tail.select(F.col("aggregate_id").alias("id")).unionAll(_merges_of(tail).select(F.col("b").alias("id"))), merges)
        return kept.join(touched.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti").unionByName(_refold(log, touched).filter("field IS NOT NULL"))
    return fold_fields(read_log(log)).select("entity_id", "field", "value", "position", "event_id")


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder, or below a temporary one where none is named."""
    from lorefold.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}" if ":" in base else str(Path(base) / f"{name}-{uuid.uuid4().hex}")
