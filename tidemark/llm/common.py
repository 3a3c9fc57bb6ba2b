"""Helpers shared by the operators: tables, lineage cuts, hash folds and result checks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; checked by counting before it is.
BROADCAST_ROWS = 200_000


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, which they may not have on their path; once for each context."""
    context = spark.sparkContext
    if not getattr(context, "_tidemark_shipped", False):
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="tidemark-package-")) / "tidemark_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or, on one machine only, a local one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder; its lineage ends there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; the table goes when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = target
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of written() that df reads; for any other df nothing."""
    target = getattr(df, "_written_at", None)
    if target is not None:
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_name(name: str, taken: list[str]) -> str:
    """name, or the first of _name, __name, ... that no column has (names differ in more than case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def fold(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast where a count shows that it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
