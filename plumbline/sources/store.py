"""The replay store: package rows and a commit row that marks them complete.

A batch writes its package rows first and its commit rows last, each in a folder of its own batch number, so a
batch that is run again overwrites what it left. Readers take only package rows whose commit row is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record(packages: DataFrame, commits: DataFrame, root: str, batch: int) -> None:
    packages.write.mode("overwrite").parquet(f"{root}/packages/batch={batch}")
    commits.write.mode("overwrite").parquet(f"{root}/commits/batch={batch}")


def complete(packages: DataFrame, commits: DataFrame) -> DataFrame:
    """Package rows without orphans."""
    return packages.join(commits.select("commit").distinct(), "commit", "left_semi")


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    commits = spark.read.parquet(f"{root}/commits").drop("batch")
    return complete(spark.read.parquet(f"{root}/packages").drop("batch"), commits), commits


def interleaved(packages: DataFrame, commits: DataFrame) -> DataFrame:
    """Package rows then their commit row, in the order of the range."""
    p = packages.select("seq", F.lit(0).alias("kind"), "package", F.to_json(F.struct(*packages.columns)).alias("row"))
    c = commits.select("seq", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("package"), F.to_json(F.struct(*commits.columns)).alias("row"))
    return p.unionByName(c).orderBy("seq", "kind", "package")


class BadLine(ValueError):
    """A line of a store that isn't the row it should be."""


def _torn(spark: SparkSession, path: str) -> bool:
    """Whether a file's last byte isn't a line end. One byte is read; a folder's files are whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(where)
    if status.isDirectory() or status.getLen() == 0:
        return False
    stream = fs.open(where)
    try:
        stream.seek(status.getLen() - 1)
        return stream.read() != ord("\n")
    finally:
        stream.close()


def read_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of a JSON-lines file that one writer appends to: a last line without its line end is what an interrupted
    write left and is dropped; blank lines are skipped; any other line without `key` is refused."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.monotonically_increasing_id().alias("at"))
    if _torn(spark, path):
        lines = lines.where(F.col("at") != lines.agg(F.max("at")).first()[0])
    rows = lines.where(F.trim("value") != "").withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    bad = rows.where(F.coalesce(F.col(f"row.{key}").cast("string"), F.lit("")) == "").select("value").first()
    if bad is not None:
        raise BadLine(f"not a row with {key!r}: {bad[0][:80]}")
    return rows.select("row.*")


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends rows to a folder of JSON lines, nulls kept; a reader of the folder sees whole files only."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def cached(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under a key (a merge base, or a file's size and time), built and written where it isn't yet. A
    build that was interrupted left no marker and is made again."""
    path = f"{root}/{key}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
