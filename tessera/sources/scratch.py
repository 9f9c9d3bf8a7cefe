"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset on a local session, a temporary folder of this machine."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("tessera.checkpoint.dir", None)
    if not found:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("tessera.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # the session has ended; the shared folder is cleared by its owner
        pass


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and read back: cuts the lineage and fixes values such as generated ids. The files live until the Python process ends."""
    target = f"{scratch_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    atexit.register(_remove, df.sparkSession, target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a row number over the whole table from 1 on, without one task that sees all rows.

    Rows are dealt by ranges of the order and numbered inside; the driver gets one count for each partition. Ties are dealt and numbered
    by a hash of the row, so that one frequent value isn't one task.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "void" not in f.dataType.simpleString()]
    order = [*order, F.xxhash64(*plain).asc()]
    part = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = part.groupBy("_part").count().orderBy("_part").collect()
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["_part"], total))
        total += r["count"]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long")).where("false")
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn(name, inside.cast("long")).join(F.broadcast(table), "_part").withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset")
