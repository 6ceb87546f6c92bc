"""Reading and writing tables, and cutting lineage in a place all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, format: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """A table from Parquet, CSV (with header), JSON or ORC, by the ending of its path or by ``format``."""
    format = format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.format({"jsonl": "json"}.get(format, format))
    if format == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def write(df: DataFrame, path: str, format: str | None = None, mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    """A table as Parquet, CSV, JSON or ORC, by the ending of its path or by ``format``."""
    format = format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.format({"jsonl": "json"}.get(format, format)).mode(mode).options(**options)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session without the setting gets a folder of its own.  On a cluster
    there is no folder that could be guessed, so the setting must be there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file:///tmp/quillstat-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Tables of up to this many groups are broadcast to the rows they are joined to.
FEW = 100_000


def few(groups: DataFrame) -> DataFrame:
    """A stored table of one row per group, marked for broadcast if it is counted to be small.

    Spark only guesses the size of a checkpoint from what it was made of, and
    would bring all rows of a group to one task to join them.
    """
    return F.broadcast(groups) if groups.limit(FEW + 1).count() <= FEW else groups


def settled_groups(df: DataFrame) -> DataFrame:
    return few(settled(df))


#: Spark deletes the shuffle files of a query when it has ended.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "table", clean: bool = False) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back.

    Cuts the lineage like a checkpoint, but compressed and column by column, so
    later steps read only the columns they need.  A lost executor loses nothing.
    With ``clean`` the shuffle files that led to the rows go at once, not when
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstat-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(FILE_CLEANUP, None)
    if clean:
        spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that ``written`` made in this process, oldest first.
_made: list[str] = []


def tables_made() -> int:
    return len(_made)


def release(spark: SparkSession, first: int, last: int) -> None:
    """Deletes tables number first to last - 1 of this process: for callers that have stored what was read from them."""
    for i in range(first, last):
        if _made[i]:
            at = spark._jvm.org.apache.hadoop.fs.Path(_made[i])
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _made[i] = ""
