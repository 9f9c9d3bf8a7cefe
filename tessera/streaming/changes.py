"""Change streams: the difference of two table versions as an event log, and Structured Streaming reads of such a log."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.filters import compile_filter
from tessera.functions.scope import Scope
from tessera.operators.stages import run_pipeline


#: Later than any event.
END = "9000-01-01 00:00:00"


def change_events(before: DataFrame, after: DataFrame, key: str, db: str, coll: str, first: int = 1) -> DataFrame:
    """One event for each inserted, updated or deleted row, by one full outer join on the key.

    _id._seq orders events by key from ``first`` on within a version; updateDescription has the top-level fields that changed.
    """
    names = [c for c in after.columns if c != key]
    b = before.select(F.col(key).alias("_b"), F.struct("*").alias("old"))
    a = after.select(F.col(key).alias("_a"), F.struct("*").alias("new"))
    j = b.join(a, F.col("_b") == F.col("_a"), "full")

    def changed(n: str) -> Column:
        return ~F.col("old").getField(n).eqNullSafe(F.col("new").getField(n)) if n in before.columns else F.col("new").getField(n).isNotNull()

    kind = F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete").when(reduce(lambda x, y: x | y, [changed(n) for n in names], F.lit(False)), "update")
    updated = F.array_compact(F.array(*[F.when(changed(n) & F.col("new").getField(n).isNotNull(), F.lit(n)) for n in names]))
    removed = F.array_compact(F.array(*[F.when(changed(n) & F.col("new").getField(n).isNull(), F.lit(n)) for n in names]))
    events = j.select(kind.alias("operationType"), F.coalesce("_a", "_b").alias("_key"), "old", "new", updated.alias("_u"), removed.alias("_r")).where("operationType is not null")
    from tessera.sources.scratch import global_row_number

    numbered = global_row_number(events, [F.col("_key").asc()], "_seq")
    return numbered.select(
        F.struct((F.col("_seq") + first - 1).alias("_seq")).alias("_id"),
        "operationType",
        F.struct(F.lit(db).alias("db"), F.lit(coll).alias("coll")).alias("ns"),
        F.current_timestamp().alias("wallTime"),
        F.struct(F.col("_key").alias(key)).alias("documentKey"),
        F.when(F.col("operationType") != "delete", F.col("new")).alias("fullDocument"),
        F.when(F.col("operationType") != "insert", F.col("old")).alias("fullDocumentBeforeChange"),
        F.when(F.col("operationType") == "update", F.struct(F.col("_u").alias("updatedFields"), F.col("_r").alias("removedFields"))).alias("updateDescription"),
    )


def watch(spark: SparkSession, folder: str, schema: T.StructType, pipeline: list[dict] | None = None, *, resume_after: int | None = None, db: str | None = None, coll: str | None = None) -> DataFrame:
    """A stream over an append-only log of events; the checkpoint of its query is the resume token."""
    events = spark.readStream.schema(schema).parquet(folder)
    if resume_after is not None:
        events = events.where(F.col("_id._seq") > resume_after)
    for name, value in (("db", db), ("coll", coll)):
        if value is not None:
            events = events.where(F.col(f"ns.{name}") == value)
    return run_pipeline(Scope(events), pipeline).df if pipeline else events


def tail(spark: SparkSession, folder: str, schema: T.StructType, filter_: dict | None = None, glob: str | None = None) -> DataFrame:
    """Existing matches first, then rows as they are appended."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)
    return rows.where(compile_filter(filter_, Scope(rows))) if filter_ else rows


def tumbling(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts and sums of value by event-time windows (an extension: the document API has no windows over streams)."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = rows.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = rows.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def run_bounded(events: DataFrame, shape: Callable[[DataFrame], DataFrame], time: str, folder: str) -> DataFrame:
    """The whole result of an event-time aggregate in append mode over a stream whose source has an end.

    What is there is read to its end first. Then one row far in the future, from a second source, moves the watermark past every window and
    session, so that the open ones come out too; its own never does. Output, state and that row are under ``folder``.
    """
    spark, end = events.sparkSession, f"{folder}/end"
    bare = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema.fields])
    spark.createDataFrame([], bare).write.parquet(end)
    stream = shape(events.unionByName(spark.readStream.schema(bare).parquet(end)))
    run_to_end(stream, folder)
    last = spark.range(1).select(*[(F.lit(END) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in bare.fields])
    last.write.mode("append").parquet(end)
    return run_to_end(stream, folder)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads its output back; output and checkpoint are under ``folder``."""
    spark = stream.sparkSession
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    writer.foreachBatch(save).outputMode(mode).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
