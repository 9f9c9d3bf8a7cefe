"""Files in chunks: two tables, files and chunks, as a file bucket keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: bytes of a chunk.
CHUNK = 255 * 1024


def upload(files: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of a table (_id, filename, uploadDate, content binary), e.g. of Spark's binaryFile source."""
    size = F.octet_length("content")
    meta = files.select("_id", "filename", "uploadDate", size.cast("long").alias("length"), F.lit(chunk).alias("chunkSize"), F.md5("content").alias("md5"))
    n = F.greatest(F.ceil(size / chunk), F.lit(1)).cast("int")
    parts = files.select(F.col("_id").alias("files_id"), "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("n"))
    return meta, parts.select("files_id", "n", F.substring("content", F.col("n") * chunk + 1, F.lit(chunk)).alias("data"))


def download(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(_id, filename, content): chunks of each file joined in order. A file must fit one row."""
    joined = chunks.groupBy("files_id").agg(F.sort_array(F.collect_list(F.struct("n", F.hex("data").alias("data")))).alias("parts"))
    content = F.unhex(F.array_join(F.transform("parts", lambda p: p["data"]), ""))
    return files.join(joined, files["_id"] == joined["files_id"]).select("_id", "filename", content.alias("content"))


def newest_by_name(files: DataFrame) -> DataFrame:
    return files.groupBy("filename").agg(F.max_by(F.struct(*files.columns), F.struct("uploadDate", "_id")).alias("f")).select("f.*")


def delete(files: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the files whose _id is in ``gone``."""
    return files.join(gone.select("_id"), "_id", "left_anti"), chunks.join(gone.select(F.col("_id").alias("files_id")), "files_id", "left_anti")
