"""Tables that are small enough for tasks, and batches of texts as arrays."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Features, words and pairs up to which a table is compiled and sent to the tasks; larger ones are joined.
LOCAL_ROWS = 1_000_000
#: Characters of the words of such a table.
LOCAL_CHARS = 20_000_000
#: Characters or words that are worked on at once.
AT_ONCE = 100_000


def free(name: str, taken: list[str]) -> str:
    """The name, or a longer one if a column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def fetched(*tables: tuple[DataFrame, tuple[str, ...]]) -> list[pa.Table] | None:
    """The named columns of some tables; None if one is beyond the bounds. All are measured in one job before any is read."""
    sizes = None
    for i, (df, columns) in enumerate(tables):
        one = df.select(F.length(F.col(columns[0]).cast("string")).alias("n")).limit(LOCAL_ROWS + 1).agg(F.lit(i).alias("i"), F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))
        sizes = one if sizes is None else sizes.union(one)
    if any(r["rows"] > LOCAL_ROWS or r["chars"] > LOCAL_CHARS for r in sizes.collect()):
        return None
    return [df.select(*columns).toArrow() for df, columns in tables]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of some texts one after the other (null is empty), and where each begins and the last ends."""
    column = pa.concat_arrays([pc.fill_null(column.cast(pa.string()), "")])
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def within(df: DataFrame, column: str, most: int | None = None) -> bool:
    """Whether a table, of which a text column is measured, is within the bounds of tasks."""
    most = LOCAL_ROWS if most is None else most
    rows, chars = df.select(F.length(column).alias("n")).limit(most + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows <= most and chars <= LOCAL_CHARS


def slices(sizes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` (else AT_ONCE) units."""
    most = most or AT_ONCE
    begin = held = 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def list_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def parts(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with about AT_ONCE units at a time, so that what a task holds does not follow the length of its rows."""
    for i, j in slices(sizes):
        yield batch.slice(i, j - i)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster shares.

    Sets a folder of its own only where none is set and the session has a single machine; on a cluster it raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sinolex-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
