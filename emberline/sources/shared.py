"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows from which a counted table is joined by shuffles alone: it could be much larger than its files let Spark think.
MANY = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset and Spark is local (tests), a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def drop_tables(spark: SparkSession) -> int:
    """Deletes the tables that queries of this session wrote to the shared folder, with what still reads them; how many."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith(f"emberline-{spark.sparkContext.applicationId}-")]
    return sum(bool(files.delete(path, True)) for path in own)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emberline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The same, with its number of rows, which the write counts."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
