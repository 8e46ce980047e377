"""Words, folds and tables shared by the text operators."""

from __future__ import annotations

import gc
import math
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.session import ensure_checkpoint_dir

# A word is a run of characters outside space, tab, line feed, vertical tab, form feed and
# carriage return. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text modulo ``parts``. A null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(parts))


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8 with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def parts_for(rows: int, rows_per_part: int, floor: int = 1) -> int:
    """Partitions that hold about ``rows_per_part`` rows each."""
    return max(floor, math.ceil(rows / rows_per_part))


def root_parts(rows: int, least: int = 256) -> int:
    """Number of parts where neither the parts nor the rows of a part exceed about sqrt(rows)."""
    return max(1, math.ceil(rows / max(least, math.isqrt(max(rows, 1)))))


def release() -> None:
    """Give memory that a task no longer needs back, since its Python worker lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def write_shared(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: compressed, and read again after a loss."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Let the driver collect the plans of finished jobs now, with which their shuffle files go."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def forget(df: DataFrame) -> None:
    """Delete the files of a table of ``write_shared`` (or of a bucketed table with a name) that no later step reads."""
    spark = df.sparkSession
    if getattr(df, "_shared_name", None):
        spark.sql(f"DROP TABLE IF EXISTS {df._shared_name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    sweep(spark)
