"""Trained models as folders of Parquet tables: all that is needed to cut or tag again, the edges and the ratio among the parameters.

A segmenter's two weights are mostly opposite. Compressed, the first is kept as a 16-bit float (relative error up to 2^-11,
absolute up to 2^-25), the second only where the two do not add up to zero within ``OPPOSITE``, with four decimals.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinolex.operators.segment import SegmenterModel
from sinolex.operators.tagging import TaggerModel


#: Sum of a feature's two weights up to which they count as opposite.
OPPOSITE = 1e-4


def _bits(df: DataFrame, column: str, to_half: bool) -> DataFrame:
    """A column of doubles as the bits of 16-bit floats, or back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).to_numpy(zero_copy_only=False)
            v = v.astype(np.float16).view(np.int16) if to_half else v.view(np.float16).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v)], names=["feature", column])

    return df.select("feature", column).mapInArrow(run, f"feature string, {column} {'short' if to_half else 'double'}")


def compress(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature, half) and the exceptions (feature, inside) of (feature, weights) with two weights each."""
    first, second = F.col("weights")[0], F.col("weights")[1]
    odd = weights.where(F.abs(first + second) > OPPOSITE).select("feature", F.round(second, 4).alias("inside"))
    return _bits(weights.select("feature", first.alias("half")), "half", True), odd


def decompress(halves: DataFrame, odd: DataFrame) -> DataFrame:
    """(feature, weights) again."""
    both = _bits(halves, "half", False).join(odd, "feature", "left")
    return both.select("feature", F.array("half", F.coalesce("inside", -F.col("half"))).alias("weights"))


def _write(path: str, tables: dict[str, DataFrame | None], facts: dict) -> None:
    for name, table in tables.items():
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(t for t in tables.values() if t is not None).sparkSession
    facts |= {"tables": sorted(n for n, t in tables.items() if t is not None)}
    spark.createDataFrame([(json.dumps(facts, ensure_ascii=False),)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")


def _read(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    facts = json.loads(spark.read.parquet(f"{path}/facts").first()[0])
    return facts, {name: spark.read.parquet(f"{path}/{name}") for name in facts["tables"]}


def save_segmenter(model: SegmenterModel, path: str, compressed: bool = False) -> None:
    """Weights, known words, bigrams and parameters."""
    halves, odd = compress(model.weights) if compressed else (None, None)
    _write(path, {"weights": None if compressed else model.weights, "halves": halves, "odd": odd, "words": model.words, "bigrams": model.bigrams}, {"params": model.params})


def load_segmenter(spark: SparkSession, path: str) -> SegmenterModel:
    facts, tables = _read(spark, path)
    weights = decompress(tables["halves"], tables["odd"]) if "halves" in tables else tables["weights"]
    return SegmenterModel(weights, tables.get("words"), tables.get("bigrams"), facts["params"])


def save_tagger(model: TaggerModel, path: str) -> None:
    """Weights, tags, known words, parts, characters and parameters."""
    _write(path, {"weights": model.weights, "words": model.words, "parts": model.parts, "chars": model.chars}, {"params": model.params, "tags": model.tags})


def load_tagger(spark: SparkSession, path: str) -> TaggerModel:
    facts, tables = _read(spark, path)
    return TaggerModel(tables["weights"], facts["tags"], tables["words"], tables["parts"], tables["chars"], facts["params"])
