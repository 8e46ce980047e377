"""Session helpers: a local session for tests and benches, and lineage cuts for iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cpus: str | int = "*", app: str = "nearloom", memory: str | None = None) -> SparkSession:
    """A local session for tests and benches; a cluster job brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory or "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The folder named by ``spark.checkpoint.dir`` wins. A temporary folder is made only for a
    local master, where driver and executors share one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written data.

    Survives the loss of executors, keeps the partitioning, and stops the plan of an
    iterative job from growing with the number of rounds.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and continue from the files.

    For loops whose joins repeat: a checkpoint hands on the constraints that the optimizer derived for its plan, which
    multiply with every round, while a table has none.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession, rows: int | None = None) -> int:
    """Partitions for ``rows`` small rows: all cores for little data, 100,000 rows each for much."""
    if rows is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cores = min(spark.sparkContext.defaultParallelism, -(-rows // 250))
    return max(1, cores, -(-rows // 100_000))


def number_rows(df: DataFrame, column: str, number: str = "number") -> DataFrame:
    """Distinct non-null values of a column with their place in ascending order, from 0.

    The sort is a range shuffle, places are counted within its partitions and shifted by the
    sums of the partitions before: no task sees all rows.
    """
    ordered = df.select(column).filter(F.col(column).isNotNull()).distinct().sort(column)
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(starts, "_part").select(column, (F.col("_start") + place).alias(number))


def write_bucketed(df: DataFrame, key: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``df`` hashed by ``key`` and read it back as a bucketed table.

    Every later join on ``key`` meets this side where it lies: only the other side is shuffled.
    The files go to ``path`` or to the shared checkpoint folder.
    """
    spark = df.sparkSession
    name = f"nearloom_{uuid.uuid4().hex}"
    path = path or f"{ensure_checkpoint_dir(spark)}/{name}"
    n = buckets or bucket_count(spark)
    rows = df.repartition(n, key)
    rows.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not share the driver's path.

    Local workers inherit the driver's path; elsewhere the sources go out once as a zip.
    """
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_nearloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="nearloom-src-", dir="/tmp"), "nearloom")
    sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package)))
    sc._nearloom_shipped = True
