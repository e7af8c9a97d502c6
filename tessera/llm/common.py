"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(col: str | Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where fewer of its partitions than that hold rows, as in a table of one row group.

    Partition numbers are counted from the files' metadata; a table of many row groups isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if 0 < filled < cores else df


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir`` or set on the context.

    A session without one gets a folder in the warehouse, but only in local mode, as in
    tests: on a cluster that could be a folder of the driver's machine, so it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
    return sc._jsc.sc().getCheckpointDir().get()


#: The folder of each table that :func:`materialise` wrote.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return a reader of it.

    Cuts lineage so that a lost executor costs a re-read, and lets later steps read only
    the columns they need. The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    saved = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[saved] = path
    return saved


def release(*saved: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote, once nothing that is still to be computed reads them.

    Spark deletes the files of finished shuffles when the driver collects its garbage, which a
    driver with little to do puts off; so that is asked for here.
    """
    for df in saved:
        jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        hadoop = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        hadoop.getFileSystem(jsc.hadoopConfiguration()).delete(hadoop, True)
    if saved:
        jvm.System.gc()
