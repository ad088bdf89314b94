"""What the training-data operators share: reading, durable cuts of lineage, small column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java's class of the six ASCII white-space bytes.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows and bounded bytes, so that long texts don't meet in one Python buffer."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the folder set on its context; a temporary one only where none is set and the master has no other executors."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="sluice-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and cut off from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete shuffles and checkpoints that nothing refers to; by itself it does when the driver's memory runs short, and disks may be full by then."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written to the shared folder as a table of columns and read again, and where it stands."""
    at = f"{shared_folder(df.sparkSession)}/sluice-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


#: Keys that a half-join may broadcast; more are shuffled.
FEW_KEYS = 1 << 19


def having(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of df with the values of keys, which is counted first: broadcast if it is small, so that df needs no shuffle."""
    keys = checkpointed(keys.distinct())
    return df.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, keys.columns, "left_semi")


def forget(spark: SparkSession, at: str) -> None:
    """Deletes a table that was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once a row.

    A one-row generator stands between them and what follows: the optimizer would otherwise inline
    an array into a lambda and evaluate it again for every element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def unsigned_crc32(c: Column) -> Column:
    return F.crc32(F.encode(c, "UTF-8"))


def id_remainder(c: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % modulus


def apart(taken: Iterable[str], *names: str) -> list[str]:
    """names, with so many underscores before them that they clash neither with taken nor, by their case, in Spark."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def rows_by_key(docs: DataFrame, keys: DataFrame, doc_id: str, text: str, how: str) -> DataFrame:
    """docs with ("left_semi") or without ("left_anti") the rows whose id and text hash stand in keys(i, t); columns of any name stay."""
    t, a, b = apart(docs.columns, "t", "a", "b")
    d, k = docs.withColumn(t, F.xxhash64(text)), keys.select(F.col("i").alias(a), F.col("t").alias(b))
    return d.join(k, d[doc_id].eqNullSafe(k[a]) & (d[t] == k[b]), how).drop(t)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first `keys` columns, which the batches bring in order; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        columns = [b.column(k).to_pylist() for k in range(keys)]
        start = 0
        for i, value in enumerate(zip(*columns)):
            if value != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, value
        if b.num_rows > start:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def parts(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have most bytes together, or are one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def to_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values as bytes of seven bits each, lowest first, and where each begins, with the end."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << (7 * k))
        if not more.any():
            break
        n += more
    ends = np.append(0, np.cumsum(n))
    out, alive, k = np.empty(int(ends[-1]), np.uint8), np.arange(len(v)), 0
    while len(alive):
        more = n[alive] > k + 1
        out[ends[alive] + k] = ((v[alive] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        alive, k = alive[more], k + 1
    return out, ends


def from_varints(raw: bytes | np.ndarray) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    ends = np.flatnonzero(b < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    v, more = (b[starts] & 127).astype(np.uint64), ends - starts
    for k in range(1, int(more.max(initial=0)) + 1):
        alive = np.flatnonzero(more >= k)
        v[alive] |= (b[starts[alive] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return v


def binaries(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of binaries that stand in a row in raw, from ends[k] up to ends[k + 1]."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
