"""What several operators of this subpackage share.

Every operator takes the names of the columns it reads, selects only those, and
so tolerates any further columns, whatever their names are.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that written() made and that is not read any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        if "docloom-" in f.rpartition("/")[2]:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Drops tables of written(), and lets the driver find out which shuffles nothing refers to any more, so that their files go."""
    for df in tables:
        dropped(df)
    gc.collect()
    spark._jvm.System.gc()


def gapless(df: DataFrame, group: str, keys: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """Adds ``out``: numbers from 0 without gaps within each ``group``, in an order that ``keys`` decide.

    A group is never sorted in one task: it is cut into hashed buckets, the buckets'
    sizes (at most ``buckets`` rows a group) are summed up, and each bucket is numbered on its own.
    """
    d = df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = d.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_g"), F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at")
    )
    own = Window.partitionBy("_g", "_b").orderBy(*keys)
    return (
        d.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_gb")))
        .withColumn(out, (F.col("_at") + F.row_number().over(own) - 1).cast("long"))
        .drop("_b", "_gb", "_g", "_at")
    )


def id_fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def fold_of(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3


def bounded_ids(df: DataFrame, key: str, strata: list[str], limit: int) -> DataFrame:
    """The distinct keys of each combination of ``strata`` if there are at most ``limit``, else the ``limit`` of the smallest hashes.

    Keys are dealt to 16 pieces a stratum by hash. A limit on the rank is applied before each shuffle and sort,
    so no task gets more than ``limit`` keys from another.
    """
    h = F.xxhash64(F.col(key), F.lit(7))
    keys = df.where(F.col(key).isNotNull()).select(*strata, key).distinct().withColumn("_h", h)
    first = Window.partitionBy(*strata, F.pmod("_h", F.lit(16))).orderBy("_h", key)
    best = Window.partitionBy(*strata).orderBy("_h", key)
    keys = keys.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit)
    return keys.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit).drop("_r", "_h")


def docs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
