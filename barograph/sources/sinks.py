"""Result sinks. Writers replace whole tables or whole partitions, so a repeated run after
a failure leaves the same result."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, fmt: str = "parquet", meta: dict | None = None) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    if meta:
        row = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()])
        row.write.mode("overwrite").json(f"{path}_meta")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the ``by`` partitions present in ``df`` (dynamic overwrite)."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def table_version(spark: SparkSession, *inputs: str) -> str:
    """A name for the present state of the input tables: paths, bytes, files, time of the last change.

    Inputs that are no path (settings) count by their text.
    """
    conf, states = spark._jsc.hadoopConfiguration(), []
    for name in inputs:
        states.append(name)
        if "/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            files = path.getFileSystem(conf)
            total = files.getContentSummary(path)
            states.append(f"{total.getLength()} {total.getFileCount()} {files.getFileStatus(path).getModificationTime()}")
    return hashlib.sha256("\n".join(states).encode()).hexdigest()[:24]


def read_or_build(spark: SparkSession, path: str, key: str, build, by: tuple[str, ...] = ()) -> DataFrame:
    """Result cached under a run key; the key names split and newest date, so it never goes stale.

    ``by`` partitions the stored table, so that a lookup on these columns reads only their files.
    """
    target = f"{path}/run={key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = build()
        rows = rows.repartition(*by) if by else rows
        rows.write.mode("overwrite").partitionBy(*by).parquet(target)
    return spark.read.parquet(target)
