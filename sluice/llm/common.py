"""What the operators of this package share: shared storage, whole-text word patterns, joins of checked size."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A broadcast side never has more rows than this.
BROADCAST_ROWS = 200_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where a session on one machine names none (a test) is a temporary folder set; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(`df`, written once as a Parquet table in the shared folder and read from there; its path).

    The files outlive any executor, so what follows never goes back before them. They go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sluice-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Removes a stored table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ALPHABET, ALPHABET.lower())


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast `df`, given only if its counted rows are within `bound`; else Spark's own choice of join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or where `df` has a column of that name in any case, a longer one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a column of texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    return [x or b"" for x in column.cast(pa.large_binary() if large else pa.binary()).to_pylist()]


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = 8_000_000):
    """Slices of a batch of about `most` bytes of text at a time, so that a batch of long texts is never held twice."""
    sizes = batch.column(text).nbytes
    step = max(1, int(batch.num_rows * most / max(1, sizes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and `label` of at most about `most` rows of `docs` that `labels` marks, stored.

    Labels that repeat are averaged. Ids are taken by a hash, at most about `most` of them; where an id has several texts, rows are taken by a hash of
    both, and rows equal in both once, so neither many labels nor many rows of one id make it larger."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias(label))
    n = marks.count()
    if n > most:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(marks), "doc_id")  # about `most` marks
    rows = stored(rows.groupBy("doc_id", "hash").agg(F.any_value("text").alias("text"), F.any_value(label).alias(label)), "labelled")
    if (n := rows.count()) > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return rows.select("doc_id", "text", label)


def slices(texts: pa.Array, rows: int = 1024, most: int = 8_000_000):
    """Lists of texts, null as empty, of at most `rows` texts and about `most` bytes, but for single texts that are longer."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, side="right"))))
        yield [x or "" for x in texts[at:end].to_pylist()]
        at = end


def copies(groups: DataFrame, count: str, name: str, chunk: int = 65_536) -> DataFrame:
    """Each row of the stored table `groups` as often as its column `count` says, numbered from 0 in the column `name`.

    Rows that stand for more than `chunk` are dealt out in parts of as many, so no task makes all copies of one row."""
    few = groups.where(F.col(count) <= chunk).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    many = groups.where(F.col(count) > chunk).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / chunk)))).repartition("__part")
    last = F.least(F.col(count), (F.col("__part") + 1) * chunk) - 1
    return few.unionByName(many.withColumn(name, F.explode(F.sequence(F.col("__part") * chunk, last))).drop("__part"))


def split_join(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Joins many rows of `left` to the one row of each key of `right`.

    `right` has a column `count` with the rows that `left` has of a key. Keys of more than a thousandth of all
    rows are fewer than a thousand and are broadcast, so no task gets the rows of a hot key; the rest are hashed."""
    total = right.agg(F.sum(count)).first()[0] or 0
    cut = max(1, total // 1000)
    hot = right.where(F.col(count) > cut).drop(count)
    rest = right.where(F.col(count) <= cut).drop(count)
    marked = left.join(F.broadcast(hot.select(F.col(key), F.lit(True).alias("__hot"))), key, "left")
    of_hot = marked.where("__hot").drop("__hot").join(F.broadcast(hot), key, how)
    of_rest = marked.where("__hot is null").drop("__hot").join(rest, key, how)
    return of_hot.unionByName(of_rest)
