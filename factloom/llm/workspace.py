"""Tables that live in the folder which the driver and all executors share.

Lineage is cut by writing a Parquet table there and reading it again, so a lost executor costs at
most the tasks that were running on it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}  # temporary folders, by application


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset: on one machine a temporary folder, on a
    cluster an error, since executors don't see each other's folders."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        found = _OWN.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="factloom-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def write_table(df: DataFrame, name: str, compression: str = "zstd", fewer: int = 1) -> tuple[DataFrame, str]:
    """Write ``df`` under a fresh path of the shared folder; gives the table read back, and its path.

    fewer: how many times smaller than the documents its rows are together, about; as many times fewer files
    than shuffle partitions are written.
    """
    spark = df.sparkSession
    if fewer > 1:
        df = df.coalesce(max(1, partitions(spark) // fewer))
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared folder in buckets of ``key``, as many as there are shuffle partitions: a join on
    the key then shuffles only the other side. Gives the table read back, and its name in the catalog. ``df`` should
    come out of a shuffle by the key, so that each bucket is one file.
    """
    spark = df.sparkSession
    table = f"factloom_{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/factloom/{table}")
    writer.bucketBy(partitions(spark), key).saveAsTable(table)
    return spark.table(table), table


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Forget a table of :func:`write_bucketed` and delete its files."""
    spark.sql(f"drop table if exists {table}")
    drop_table(spark, f"{shared_dir(spark)}/factloom/{table}")


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`write_table` that no pending plan reads any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the unit in which work is dealt out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(table: DataFrame, key: str, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each ``key`` of a written table from 0 without gaps, never holding a whole key in one task.

    Rows are dealt by their file and place in it, whatever they hold, into as many parts of a key as there
    are shuffle partitions, and numbered by ``order`` inside a part; a part starts where the ones before it
    end. The table of part sizes has at most (distinct keys x partitions) rows.
    """
    n = partitions(table.sparkSession)
    stands = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    dealt = table.select("*", F.pmod(stands, F.lit(n)).cast("int").alias("__part"))
    sizes = dealt.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(key, "__part").orderBy(*order)
    ranked = dealt.withColumn("__row", F.row_number().over(inside) - 1)
    return ranked.join(bases, [key, "__part"]).withColumn(out, F.col("__base") + F.col("__row")).drop("__part", "__base", "__row")
