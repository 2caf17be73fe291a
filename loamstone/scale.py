"""Helpers for plans that must hold at cluster scale: shared materialization and skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster that is an error, as
    executors would write to folders of their own machines.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loamstone-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_written: list[str] = []


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage and is read again from replicated storage when an executor is lost. The table is
    removed when the driver ends, or by ``intermediates`` once what was made from it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, at = _file_system(spark, path)
    system.deleteOnExit(at)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates(spark: SparkSession):
    """Remove at the end what ``materialize`` wrote inside: for work that writes its result within."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            system, at = _file_system(spark, path)
            system.delete(at, True)
        del _written[before:]


def salt_of(column: Column, salts: int) -> Column:
    """A stable salt in ``[0, salts)`` from a row's own identity."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` in the order of (group, order), with _part and _place: where each lies in that order.

    Rows are sorted by range over the cluster, so a group with a third of them fills as many
    partitions as any other rows would. It is written once, so that places stay what they are.
    """
    sorted_rows = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    return materialize(sorted_rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")), "placed")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 1 within the group by ``order``; no group is gathered in one task."""
    held = placed(rows, group, order)
    parts = held.groupBy(*group, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")  # one row for each partition of a group
    return held.join(parts, [*group, "_part"]).withColumn(name, (F.col("_place") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_part", "_place", "_first", "_before")


def latest_before(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that isn't NULL on an earlier row of the group.

    Within a partition of the sorted rows it is a window over the group's rows there; what earlier
    partitions leave is one row for each of them.
    """
    held = placed(rows.withColumn("_value", value), [group], order)
    inside = F.last("_value", ignorenulls=True).over(W.partitionBy(group, "_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1))
    parts = held.groupBy(group, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_place"))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(group, "_part", carried.alias("_carried"))
    return held.withColumn("_inside", inside).join(parts, [group, "_part"]).withColumn(name, F.coalesce("_inside", "_carried")).drop("_part", "_place", "_value", "_inside", "_carried")
