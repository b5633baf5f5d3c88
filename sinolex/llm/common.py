"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Ids up to which a set of documents is broadcast to pick texts; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the text ``null``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("null"))), F.lit(n))


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the folder that the cluster shares.

    Sets a folder of its own only where none is set and the session has a single machine; on a cluster it raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sinolex-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def of_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` with (or without) the distinct ids; broadcast only if they are few."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


#: Parts into which the rows of one group are dealt before they are joined with what is known of the group.
SALTS = 64


def with_least(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the smallest ``value`` of the rows with equal ``keys``; a large group is spread over ``SALTS`` tasks."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "__salt").agg(F.min(value).alias("__least"))
    least = parts.select(*keys, "__salt", F.min("__least").over(Window.partitionBy(*keys)).alias(name))
    return salted.join(least, [*keys, "__salt"]).drop("__salt")


def free(name: str, taken: list[str]) -> str:
    """The name, or a longer one if a column has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


#: Rows of a batch between Spark and Python. Batches of many long texts would not fit beside each other in an executor.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def map_texts(df: DataFrame, keys: list[str], text: str, rows: Callable[[], Callable[[list], list]], out: str, at_once: int = 500) -> DataFrame:
    """The columns ``keys`` of every row with what Python makes of its text.

    ``rows()`` is called once for each task and gives a function from the texts of some rows to one tuple for each, with
    the schema ``out``. Integers pass as text, since pandas would turn those beside nulls into floats.
    """
    import pandas as pd

    small_batches(df.sparkSession)
    whole = {k: isinstance(df.schema[k].dataType, IntegralType) for k in keys}
    names = [f"__k{i}" for i in range(len(keys))]
    given = [(F.col(f"`{k}`").cast("string") if whole[k] else F.col(f"`{k}`")).alias(n) for k, n in zip(keys, names, strict=True)]
    made = StructType.fromDDL(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = rows()
        for batch in batches:
            for at in range(0, len(batch), at_once):
                part = batch.iloc[at : at + at_once].reset_index(drop=True)
                done = pd.DataFrame(work(part["__text"].tolist()), columns=made.names)
                yield pd.concat([part[names], done], axis=1)

    fields = [StructField(n, StringType() if whole[k] else df.schema[k].dataType) for k, n in zip(keys, names, strict=True)]
    done = df.select(*given, F.col(f"`{text}`").alias("__text")).mapInPandas(run, StructType(fields + made.fields))
    return done.select(*[F.col(n).cast(df.schema[k].dataType).alias(k) for k, n in zip(keys, names, strict=True)], *made.names)


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits (wraps on overflow)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte value at each of 64 places in a word.
PLACES = 64
_table = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 64, PLACES * 256, np.uint64, endpoint=False)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of the bytes ``raw``, computed on the whole array at once.

    Each byte gives a random number by its value and place; a word's numbers are summed and mixed with its length.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    places = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    letters = raw[places + np.repeat(starts, sizes)]
    value = _table[(places & (PLACES - 1)) * 256 + letters]
    if len(far := np.flatnonzero(places >= PLACES)):
        value[far] = mix64(value[far] + (places[far] // PLACES).astype(np.uint64) * _ODD)
    return mix64(np.add.reduceat(value, first) + sizes.astype(np.uint64) * _ODD)


def spans(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that are no gap."""
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
    return edge[::2], edge[1::2]


def hash_text_words(data: bytes) -> np.ndarray:
    """A 64-bit hash for each white-space separated word of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    return hash_spans(raw, *spans((raw == 32) | ((raw >= 9) & (raw <= 13))))


def hash_runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` neighbouring hashes."""
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _ODD + hashes[i : len(hashes) - size + 1 + i]
    return mix64(out)
