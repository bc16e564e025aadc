"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (tests) gets a temporary folder of this machine; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/skein-{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage with a copy that survives the loss of any executor, and fixes values such as
    ``spark_partition_id()`` that a re-run of the plan might give differently.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    names = [f for f in df.schema.fields if f.name not in partition_by] + [f for f in df.schema.fields if f.name in partition_by]
    return spark.read.schema(type(df.schema)(names)).parquet(path)


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``id``, ``text`` (null: empty) and the columns named in ``more``; others, clashing or not, go."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def crc_mod(column: str, n: int):
    """crc32 of an integer id written as decimal text, modulo ``n``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Ids up to which a set of them is sent to every task (8 MB of longs); counted first. Larger sets are joined by shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``df`` with (``left_semi``) or without (``left_anti``) the rows whose id is in ``ids``, a written table of one column."""
    column = ids.columns[0]
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how).select(*df.columns)
