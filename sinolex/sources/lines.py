"""Line files, dictionaries, feature tables and models as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# How tags of the default dictionary's files are joined, and its thresholds.
TAG_JOINS = {"nrf": "nr", "nr1": "nr"}
LEAST_PROB, LEAST_FREQ = 0.99, 0


def read_lines(spark: SparkSession, path: str, schema: str | T.DataType | None = None, strip: bool = True, skip_empty: bool = True) -> DataFrame:
    """(path, value[, data]): stripped lines; with a schema also the line parsed as JSON, null where it is none."""
    rows = spark.read.text(path)
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "") if strip else F.col("value")
    rows = rows.select(F.col("_metadata.file_path").alias("path"), text.alias("value"))
    if skip_empty:
        rows = rows.where("value != ''")
    return rows if schema is None else rows.withColumn("data", F.from_json("value", schema))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): every line with its number in its file, from 0.

    Lines are counted by block of a file; only the blocks' counts are summed up file by file.
    """
    block = F.col("_metadata.file_block_start").alias("block")
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), block, "value").withColumn("at", F.monotonically_increasing_id())
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(ahead) - F.col("n"))
    inside = Window.partitionBy("path", "block").orderBy("at")
    numbered = rows.withColumn("k", F.row_number().over(inside) - 1).join(counts.drop("n"), ["path", "block"])
    return numbered.select("path", (F.col("before") + F.col("k")).alias("line"), "value")


def read_values(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(path, line, data, text): each line as a VARIANT where it is JSON, else as trimmed text; empty lines are left out.

    ``most`` ends each file after so many lines, empty ones counted.
    """
    rows = numbered_lines(spark, path)
    if most is not None:
        rows = rows.where(F.col("line") < most)
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    rows = rows.select("path", "line", F.try_parse_json("value").alias("data"), text.alias("text")).where("text != ''")
    return rows.select("path", "line", "data", F.when(F.col("data").isNull(), F.col("text")).alias("text"))


def first_lines(lines: DataFrame, order: str, n: int, skip_empty: bool = True) -> DataFrame:
    """The first n lines by a line number; empty lines that are skipped count towards n."""
    kept = lines.where(F.col(order) < n)
    return kept.where("value != ''") if skip_empty else kept


def to_lines(df: DataFrame, column: str) -> DataFrame:
    """The line each value is written as: JSON for nested values, text without line breaks, numbers as text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        line = F.translate(column, "\n", "")
    elif isinstance(kind, T.NumericType):
        line = F.col(column).cast("string")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        line = F.to_json(column)
    else:
        raise TypeError(f"no line form for {kind.simpleString()}")
    return df.select(line.alias("value"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    to_lines(df, column).write.text(path)


def parse_segment_dictionary(lines: DataFrame) -> DataFrame:
    """(word, weight) from ``word`` or ``word<tab>weight``; other lines are dropped."""
    f = F.split("value", "\t")
    weight = F.when(F.size(f) == 2, F.expr("try_cast(split(value, '\t')[1] AS double)")).otherwise(F.lit(1.0))
    return lines.where(F.size(f).isin(1, 2)).select(F.lower(F.trim(f[0])).alias("word"), weight.alias("weight")).where("word != '' and weight is not null")


def parse_tag_dictionary(lines: DataFrame) -> DataFrame:
    """(word, tag, weight) from ``word<tab>tag[<tab>weight]``; a null weight makes the tag hard; other lines are dropped."""
    f = F.split("value", "\t")
    rows = lines.where(F.size(f).isin(2, 3)).select(f[0].alias("word"), f[1].alias("tag"), F.when(F.size(f) == 3, F.expr("try_cast(split(value, '\t')[2] AS double)")).alias("weight"), F.size(f).alias("n"))
    return rows.where("n = 2 or weight is not null").drop("n")


def parse_default_dictionary(lines: DataFrame, prob: float = LEAST_PROB, freq: int = LEAST_FREQ) -> DataFrame:
    """(word, tag, prob, freq) from (path, value); the tag is the file's stem; of equal words the first file's stays."""
    f = F.split("value", "\t")
    stem = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    joins = F.create_map(*[F.lit(x) for pair in TAG_JOINS.items() for x in pair])
    rows = lines.where((F.size(f) == 3) & (stem != "")).select("path", f[0].alias("word"), F.coalesce(joins[stem], stem).alias("tag"), F.expr("try_cast(split(value, '\t')[1] AS double)").alias("prob"), F.expr("try_cast(split(value, '\t')[2] AS bigint)").alias("freq"))
    first = Window.partitionBy("word").orderBy("path", F.desc("freq"))
    return rows.where((F.col("prob") >= prob) & (F.col("freq") > freq)).withColumn("n", F.row_number().over(first)).where("n = 1").select("word", "tag", "prob", "freq")


def write_features(nodes: DataFrame, index: DataFrame, keys: list[str], path: str, tags: DataFrame | None = None, miss: str = "any") -> None:
    """Feature numbers of each sample as Parquet: (sent_id, features, tags). Missing features are number 0, once for each position."""
    feature_numbers(nodes, index, keys, tags, miss).write.mode("overwrite").parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples whose features have numbers already, as ``write_features`` writes them."""
    samples.write.mode("overwrite").parquet(path)


def feature_numbers(nodes: DataFrame, index: DataFrame, keys: list[str], tags: DataFrame | None = None, miss: str = "any") -> DataFrame:
    rows = nodes.select(*keys, "pos", F.explode_outer("features").alias("feature")).join(index, "feature", "left")
    held = F.count("idx")
    none = (held < F.count(F.lit(1))) if miss == "any" else (held == 0)
    at = rows.groupBy(*keys, "pos").agg(F.array_sort(F.collect_list("idx")).alias("ids"), none.alias("none"))
    at = at.select(*keys, "pos", F.when(F.col("none"), F.concat(F.array(F.lit(0)), "ids")).otherwise(F.col("ids")).alias("ids"))
    out = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("f")).select(*keys, F.col("f.ids").alias("features"))
    return out if tags is None else out.join(tags, keys)


def read_samples(spark: SparkSession, path: str, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """A feature table, whole or a Bernoulli sample of it."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")
    rows = spark.read.parquet(path)
    return rows if ratio == 1 else rows.sample(ratio, seed)


def repeat(df: DataFrame, times: int) -> DataFrame:
    """The rows several times over."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def load_params(params: dict, known: dict) -> dict:
    """The known parameters, overlaid by those that are stored."""
    return known | {k: v for k, v in params.items() if k in known}
