"""Stateless text operators on streams. The same expressions run on batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sinolex.functions.charset import preprocess
from sinolex.operators import rules
from sinolex.operators.chars import char_features


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A stream of line files: (path, text)."""
    return spark.readStream.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the normalised text and the resolved rule hits."""
    return df.withColumn("clean", preprocess(F.col(text))).withColumn("hits", rules.resolve(rules.extract_info(F.col(text))))


def piece_list(text: str = "text") -> Column:
    """The pieces (s, t) of a text between and inside rule hits, in the row."""
    return rules.cut_by_rules(F.col(text), rules.resolve(rules.extract_info(F.col(text))))


def pieces(df: DataFrame, text: str = "text") -> DataFrame:
    """The texts' pieces between and inside rule hits, as rows with their place ``at`` in the text's pieces."""
    return df.select("*", F.posexplode(piece_list(text)).alias("at", "p")).select("*", F.col("p.s").alias("piece"), F.col("p.t").alias("type")).drop("p")


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("features", char_features(preprocess(F.col(text))))
