"""Session for tests, bench and local use, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(name: str = "ledgerloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return tune(spark)


#: Shuffled bytes that one task takes at most, where adaptive execution puts partitions together.
PARTITION_BYTES = 8 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Run-time settings the plans rely on.

    The Java compiler leaves methods above 8000 bytes of bytecode interpreted, so a stage
    whose generated method is larger is better run operator by operator.

    Rows of documents shrink some 50 times as they are shuffled, so a partition of Spark's 64 MB takes gigabytes to sort
    and to group. Tasks get at most ``PARTITION_BYTES``; a session that asks for less is left as it is.

    Written tables are compressed by zstd, which takes less disk than Spark's snappy; a session that names another codec keeps it.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    codec = "spark.sql.parquet.compression.codec"
    if spark.conf.get(codec) == "snappy":
        spark.conf.set(codec, "zstd")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > PARTITION_BYTES:
        spark.conf.set(size, str(PARTITION_BYTES))
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A new directory for written tables below the folder the cluster shares (spark.checkpoint.dir).

    Only on a local master, as in tests, a temporary folder stands in for an absent setting; elsewhere it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = shared or os.path.join(tempfile.gettempdir(), "ledgerloom-work")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
