"""What the training-data operators share: the shared work folder, worker paths, text batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The six ASCII white-space bytes that separate words.
ASCII_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


#: Rows of an Arrow batch where the session has Spark's default; texts are long, and a worker holds a batch several times.
BATCH_ROWS = 1000


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and keep their batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for local masters a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif spark.sparkContext.master.startswith("local["):
            named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(done: DataFrame) -> None:
    """Delete what `written` gave, once everything that reads it has itself been written."""
    jvm, conf = done.sparkSession._jvm, done.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(done.written_path)
    path.getFileSystem(conf).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


def text_batches(texts: Iterable[str], size: int = 1 << 18) -> Iterator[list[tuple[int, str]]]:
    """Lists of (row, text) of together at most about `size` characters; a longer text comes in a list of its own."""
    batch: list[tuple[int, str]] = []
    room = size
    for row, text in enumerate(texts):
        if batch and len(text) > room:
            yield batch
            batch, room = [], size
        batch.append((row, text))
        room -= len(text) + 1
    if batch:
        yield batch


def overlapping(text: str, overlap: int, size: int = 1 << 18) -> Iterator[str]:
    """The text in pieces of `size` characters and the `overlap` before them: no run of overlap + 1 is missed."""
    for at in range(0, max(1, len(text)), size):
        yield text[max(0, at - overlap) : at + size]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bounded_sample(rows: DataFrame, by: str, key: str, bound: int) -> DataFrame:
    """About `bound` rows (exactly all, if there are fewer) for each value of `by`, chosen by a hash of `key`.

    Counts cover all rows; what is kept depends on the keys alone, so reruns agree. The values of `by`
    must be few (languages, label values): their counts come to the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    span = 1 << 31
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(span))
    limits = [x for k, n in counts.items() for x in (F.lit(k), F.lit(span if n <= bound else int(span * (bound / n))).cast("long"))]
    if not limits:
        return rows.limit(0)
    return rows.where(draw < F.create_map(*limits)[F.col(by)])


def bounded_labels(labels: DataFrame, label: str, bound: int) -> tuple[DataFrame, dict[int, int]]:
    """About `bound` labelled ids of each label 0 and 1, and how many there are of each in all.

    The sample is small enough to broadcast (its size is the parameter's, not the table's), so the texts it
    is joined with need no shuffle.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias(label))
    counts = {int(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
    return F.broadcast(bounded_sample(rows, label, "doc_id", bound)), counts
