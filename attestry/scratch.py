"""Written intermediate tables in the folder that the cluster shares.

A table written here cuts the lineage: a lost executor costs a reread of a few files, not a rerun of the
stages before. The folder is the one named by ``spark.checkpoint.dir``. Only where that is unset and everything runs
in one process (tests, a laptop) a temporary local folder takes its place; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Removes a query's shuffle files when it ends; a written table needs them no longer.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """The folder that this application writes its intermediate tables to."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="attestry-")
        _own[app] = f"{named.rstrip('/')}/attestry-{app}"
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet under a new name and read again."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """`df` with `name`, a long: its place (from 1) in the order of the columns `order`, without a task that sees all rows.

    Rows are dealt to ranges whose bounds Spark samples from all of `order`, so ranges stay even however skewed a column
    is; they are sorted and written, and each range's first number is the number of rows in the ranges before it.
    """
    at = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = at.join(F.broadcast(before), part == F.col("_part"))
    return own.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*df.columns, name)


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() returned, once nothing that is still to run reads them."""
    for table in tables:
        _delete(table.sparkSession, table.__dict__["written_to"])


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it once its results have been used."""
    _delete(spark, root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
