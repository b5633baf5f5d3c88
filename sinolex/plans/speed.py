"""How fast an engine cuts line files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinolex.engine import Engine
from sinolex.sources.lines import numbered_lines

#: Lines of each file that are read.
MOST_LINES = 100_000


def seconds(run: Callable[[], object]) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def throughput(spark: SparkSession, path: str, engine: Engine, most: int | None = MOST_LINES) -> DataFrame:
    """One row of lines, characters, seconds and characters a second of cutting (and tagging) the files; reading is taken off."""
    rows = numbered_lines(spark, path)
    if most is not None:
        rows = rows.where(F.col("line") < most)
    rows = rows.select(F.xxhash64("path", "line").alias("id"), "value")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars")).first()
    reading = seconds(lambda: rows.write.format("noop").mode("overwrite").save())
    whole = seconds(lambda: engine.cut(rows, "id", "value").write.format("noop").mode("overwrite").save())
    took = max(whole - reading, 1e-9)
    return spark.createDataFrame([(size["n"], size["chars"], took, size["chars"] / took)], "lines long, chars long, seconds double, chars_per_s double")
