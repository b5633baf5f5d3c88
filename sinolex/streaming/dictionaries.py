"""User dictionaries that change while a stream runs, as numbered snapshots.

A snapshot is a whole dictionary in a folder of its own; it counts once its number is in the log, so a reader never sees half
of one. Each micro-batch takes the latest snapshot and notes which, before its words are cut. A batch that runs again after a
failure takes the one that was noted, so its result is the same although the dictionary has changed since.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinolex.operators import dictionary
from sinolex.operators.segment import Segmenter

WORDS = "word string, weight double, ord int"


@dataclass(frozen=True)
class Snapshots:
    """Snapshots below a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def latest(self) -> int:
        """The number of the last snapshot; 0, the empty dictionary, before the first."""
        return self._log("log", "snapshot long").agg(F.coalesce(F.max("snapshot"), F.lit(0))).first()[0]

    def words(self, snapshot: int) -> DataFrame:
        """The words (word, weight, ord) of a snapshot."""
        return self.spark.read.parquet(f"{self.path}/words/{snapshot}") if snapshot else self.spark.createDataFrame([], WORDS)

    def publish(self, entries: DataFrame) -> int:
        """A new snapshot: the last one with more (word, weight); of equal words the first weight stays. One writer at a time."""
        number = self.latest() + 1
        both = self.words(number - 1).select("word", "weight", F.lit(0).alias("ord")).union(entries.select("word", "weight", F.lit(1).alias("ord")))
        dictionary.upsert(both).withColumn("ord", F.lit(0)).write.mode("overwrite").parquet(f"{self.path}/words/{number}")
        self.spark.createDataFrame([(number,)], "snapshot long").write.mode("append").parquet(f"{self.path}/log")
        return number

    def add_word(self, word: str, weight: float = 3.0) -> int:
        return self.publish(self.spark.createDataFrame([(word, weight)], "word string, weight double"))

    def of_batch(self, stream: str, batch: int) -> int:
        """The snapshot of a micro-batch of a stream: the one noted for it, else the latest, which is noted."""
        noted = self._log("batches", "stream string, batch long, snapshot long").where((F.col("stream") == stream) & (F.col("batch") == batch)).first()
        if noted:
            return noted["snapshot"]
        number = self.latest()
        self.spark.createDataFrame([(stream, batch, number)], "stream string, batch long, snapshot long").write.mode("append").parquet(f"{self.path}/batches")
        return number


def cutter(segmenter: Segmenter, snapshots: Snapshots, text: str, stream: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: gives ``write`` the batch with its tokens and the snapshot that cut it. The model is compiled anew only for a new snapshot."""
    compiled: dict[int, object] = {}

    def run(batch: DataFrame, number: int) -> None:
        snapshot = snapshots.of_batch(stream, number)
        own = segmenter.with_words(snapshots.words(snapshot)) if snapshot else segmenter
        if snapshot not in compiled:
            compiled.clear()
            compiled[snapshot] = own.table()
        write(own.cut(batch, text, table=compiled[snapshot]).withColumn("snapshot", F.lit(snapshot)), number)

    return run
