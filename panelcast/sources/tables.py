"""Typed scans, sinks and round trips through a shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset it is an error,
    except on a local master, as in a bare test session: there one temporary folder is made,
    registered and removed with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="panelcast-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/panelcast/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder once and go on from the written table.

    Cuts the lineage and survives lost executors, like a reliable checkpoint, but runs
    the plan a single time and reads back columns instead of whole rows.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType, null_value: str = "NA"
) -> DataFrame:
    """CSV scan with a header and a declared schema; a malformed record is an error."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", null_value)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    null_value: str = "NA",
) -> None:
    """Overwrite *path*. Partitioned output is clustered first so it stays in few, large files."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        # hint, not a fixed count: the adaptive planner splits a hot partition value
        # into several files and merges the small ones
        writer = (
            df.hint("rebalance", *partition_by)
            .write.mode("overwrite")
            .format(fmt)
            .partitionBy(*partition_by)
        )
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", null_value)
    writer.save(path)


def round_trip(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write to Parquet in the shared folder and read it back with the same schema."""
    path = shared_dir(df.sparkSession)
    write_table(df, path, partition_by=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
