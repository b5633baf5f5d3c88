"""User and default dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sinolex.operators import tables
from sinolex.operators.automaton import Trie, code_points
from sinolex.operators.automaton import greedy as takes
from sinolex.operators.chars import chars, let
from sinolex.operators.tables import slices

SPACES = "\t \r　"


def upsert(entries: DataFrame, order: str = "ord") -> DataFrame:
    """(word, weight): keys trimmed and in lower case, without blank characters; of equal keys the first stays."""
    key = F.lower(F.translate(F.trim("word"), SPACES, ""))
    first = Window.partitionBy("key").orderBy(order)
    rows = entries.withColumn("key", key).where("key != ''").withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select(F.col("key").alias("word"), "weight")


def substrings(text: Column, shortest: int, longest: int) -> Column:
    """All substrings of a text by place (from 0) and length. Each is made from the characters, not by a walk from the text's start."""

    def of(cs: Column) -> Column:
        n = F.size(cs)

        def at(i: Column) -> Column:
            sizes = F.sequence(F.lit(shortest), F.least(F.lit(longest), n - i))
            return F.when(n - i >= shortest, F.transform(sizes, lambda k: F.struct(i.alias("b"), k.alias("n"), F.array_join(F.slice(cs, i + 1, k), "").alias("word")))).otherwise(F.array().cast("array<struct<b:int,n:int,word:string>>"))

        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(places, at))

    return let(chars(text), of)


def matches(df: DataFrame, keys: list[str], text: str, words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Occurrences of dictionary words: (keys, b, n, word, the words' other columns)."""
    rows = df.select(*keys, F.explode(substrings(F.col(text), shortest, longest)).alias("x")).select(*keys, "x.*")
    return rows.join(words, "word")


def _found(df: DataFrame, keys: list[str], text: str, words: pa.Table, scan: bool) -> DataFrame:
    """(keys, m): the longest words of a small dictionary by place, or with ``scan`` those that a scan from the left takes."""
    weight = dict(zip(*(words.column(c).to_pylist() for c in ("word", "weight")), strict=True))
    weight.pop("", None), weight.pop(None, None)
    table = Trie(list(weight)), np.array([float("nan") if w is None else float(w) for w in weight.values()])
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, weights = shared.value
        for batch in batches:
            texts = batch.column(len(keys))
            for i, j in slices(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)):
                codes, sizes = code_points([t or "" for t in texts[i:j].to_pylist()])
                ends = np.cumsum(sizes)
                found = trie.longest_at(codes, np.repeat(ends, sizes))
                at = takes(found, trie.sizes) if scan else np.flatnonzero(found >= 0)
                word = found[at]
                row = np.searchsorted(ends, at, side="right")
                columns = [pa.array((at - (ends - sizes)[row]).astype(np.int32)), pa.array(trie.sizes[word].astype(np.int32)), pa.array(weights[word], mask=np.isnan(weights[word]))]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)), pa.StructArray.from_arrays(columns, ["b", "n", "weight"]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[i:j] for k in range(len(keys))), lists], names=[*keys, "m"])

    given = df.select(*keys, text)
    return given.mapInArrow(run, StructType([*[given.schema[k] for k in keys], *StructType.fromDDL(f"m {MATCH}").fields]))


MATCH = "array<struct<b:int,n:int,weight:double>>"


def _parts(words: DataFrame) -> Iterator[pa.Table]:
    """The dictionary (word, weight) in parts that are within the bounds of tasks, one at a time."""
    n, chars = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    parts = max(-(-n // tables.LOCAL_ROWS), -(-chars // tables.LOCAL_CHARS), 1)
    for k in range(parts):
        yield words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k).select("word", "weight").toArrow()


def longest_match(df: DataFrame, keys: list[str], text: str, words: DataFrame) -> DataFrame:
    """For each place the longest word that begins there: (keys, b, n, weight). ``words`` (word, weight) are distinct.

    The time doesn't depend on the longest word. A dictionary beyond the bounds of tasks is taken in parts by the hash of the
    word; the longest match of all parts counts.
    """
    every = None
    for k, part in enumerate(_parts(words)):
        own = _found(df, keys, text, part, False).select(*keys, F.explode("m").alias("x")).select(*keys, "x.*")
        every = own if every is None else every.union(own)
    return every if k == 0 else every.groupBy(*keys, "b").agg(F.max("n").alias("n"), F.max_by("weight", "n").alias("weight"))


def greedy(df: DataFrame, keys: list[str], text: str, words: DataFrame) -> DataFrame:
    """Matches of a scan from the left that takes the longest word and goes on behind it: (keys, b, n, weight).

    One pass over each text, without a shuffle where the dictionary is within the bounds of tasks. ``words`` are distinct.
    """
    n, chars = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    if n <= tables.LOCAL_ROWS and chars <= tables.LOCAL_CHARS:
        return _found(df, keys, text, words.select("word", "weight").toArrow(), True).select(*keys, F.explode("m").alias("x")).select(*keys, "x.*")
    found = longest_match(df, keys, text, words).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "n", "weight"))).alias("m"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matches = batch.column("m")
            owner = np.repeat(np.arange(len(matches)), matches.value_lengths().to_numpy())
            columns = matches.flatten().flatten()
            kept, end, last = [], 0, -1
            for i, (o, b, n) in enumerate(zip(owner.tolist(), columns[0].to_pylist(), columns[1].to_pylist(), strict=True)):
                if o != last:
                    last, end = o, 0
                if b >= end:
                    kept.append(i)
                    end = b + n
            at, of = pa.array(kept, pa.int64()), pa.array(owner[kept], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(of) for k in keys], *[c.take(at) for c in columns]], names=[*keys, "b", "n", "weight"])

    schema = StructType([*[found.schema[k] for k in keys], *StructType.fromDDL("b int, n int, weight double").fields])
    return found.mapInArrow(walk, schema)


def boosts(scan: DataFrame, keys: list[str]) -> DataFrame:
    """What matches add to the scores of characters: (keys, pos, add_b, add_i).

    The first character gets the weight as a beginning, the others as continuations, the one behind as a beginning.
    """
    rows = scan.select(*keys, "b", "n", "weight", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    start = (F.col("k") == 0) | (F.col("k") == F.col("n"))
    rows = rows.select(*keys, (F.col("b") + F.col("k")).alias("pos"), F.when(start, F.col("weight")).otherwise(0.0).alias("b"), F.when(start, 0.0).otherwise(F.col("weight")).alias("i"))
    return rows.groupBy(*keys, "pos").agg(F.sum("b").alias("add_b"), F.sum("i").alias("add_i"))


def look_up(tokens: DataFrame, default: DataFrame, hard: DataFrame | None = None) -> DataFrame:
    """Adds ``dict_tag``: the user's tag for a word before the default one; null if neither has it."""
    rows = tokens.join(default.select("word", F.col("tag").alias("d")), "word", "left")
    if hard is None:
        return rows.withColumn("dict_tag", F.col("d")).drop("d")
    rows = rows.join(hard.select("word", F.col("tag").alias("h")), "word", "left")
    return rows.withColumn("dict_tag", F.coalesce("h", "d")).drop("d", "h")
