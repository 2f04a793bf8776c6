"""What the corpus operators share: bounded Arrow slices, lineage cuts, free names."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a task holds as numpy arrays at a time (one row may exceed it).
SLICE_BYTES = 1 << 20
#: Bytes of a shuffle partition, and keys that are joined by broadcast at most.
PARTITION_BYTES, HOT = 64 << 20, 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, where that is unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='waymark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/waymark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove written tables that no later result reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()[:1]}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` has at most ``limit`` bytes in each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.array(pc.binary_length(batch[column]).fill_null(0), dtype=np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Return freed memory to the system: a Python worker goes on to other tasks and keeps what it doesn't give back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # Not glibc.


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the task gives its memory back."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return done


def map_text(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to slices of ``df`` that are bounded by the text in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column):
            yield fn(piece)

    return df.mapInArrow(tidy(run), schema)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    return text.encode().split() if text else []


def word_count(text: str):
    """The number of words of a text column, as a JVM expression; null has none."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(trimmed, " \t\n\x0b\x0c\r", "")).cast("long")


def partitions(spark: SparkSession, size: int = 0) -> int:
    """Shuffle partitions: those configured, or as many as hold ``PARTITION_BYTES`` of ``size`` each if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, size: int = 0) -> DataFrame:
    """Apply ``fn`` to the rows of each key; a key's rows must fit in memory, ``size`` is about the bytes of all.

    Many small groups cost one pass over sorted rows instead of a call to
    Spark's grouped functions each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
            same = bool(rest) and all(rest[-1][k][-1].as_py() == batch[k][0].as_py() for k in keys)
            edges = [0, *(np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1).tolist(), batch.num_rows]
            if rest and not same:
                yield from done(rest)
                rest = []
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                rest.append(batch.slice(x, y - x))
                if y < batch.num_rows:
                    yield from done(rest)
                    rest = []
        if rest:
            yield from done(rest)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = parts[0] if len(parts) == 1 else pa.concat_batches(parts)
        if (out := fn(rows)) is not None:
            yield out

    return df.repartition(partitions(df.sparkSession, size), *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def join_hot(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row per key and, as ``n``, how many of ``rows`` have it.

    Keys of more than a ``HOT``th of the ``total`` rows, of which there are fewer
    than ``HOT``, are broadcast, so that no task gets all rows of one of them; the
    others are joined by shuffling. Rows of no fact, and of null keys, go.
    """
    hot = facts.where(F.col(n) > total / HOT).drop(n)
    warm = facts.where(F.col(n) <= total / HOT).drop(n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(warm, key))
