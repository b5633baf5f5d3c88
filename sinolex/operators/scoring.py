"""Linear scores of nodes and their best tags: look up, sum, argmax.

A weight table of up to ``LOCAL_WEIGHTS`` features is sent to the tasks, which score their nodes where they are. A larger
one is joined: features are exploded, met by the shuffle, and summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EMPTY = "/"
LOCAL_WEIGHTS = 200_000


def node_scores(nodes: DataFrame, keys: list[str], weights: DataFrame, n_tags: int, features: str = "features", miss: str = "any") -> DataFrame:
    """(keys, scores) from (keys, features) and (feature, weights): summed weights for each tag.

    If any feature (or with ``miss="all"`` every one) has no weights, those of the empty feature count once.
    """
    few = weights.select("feature", "weights").limit(LOCAL_WEIGHTS + 1)
    if few.count() <= LOCAL_WEIGHTS:
        return _local_scores(nodes, keys, few.toArrow(), n_tags, features, miss)
    rows = nodes.select(*keys, F.explode_outer(features).alias("feature")).join(weights.select("feature", "weights"), "feature", "left")
    sums = [F.coalesce(F.sum(F.col("weights")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(n_tags)]
    held = F.count("weights")
    missing = (held < F.count(F.lit(1))) if miss == "any" else (held == 0)
    summed = rows.groupBy(*keys).agg(*sums, missing.alias("missing"))
    empty = weights.where(F.col("feature") == EMPTY).agg(*[F.coalesce(F.max(F.col("weights")[k]), F.lit(0.0)).alias(f"e{k}") for k in range(n_tags)])
    both = summed.join(F.broadcast(empty))  # one row
    return both.select(*keys, F.array(*[F.col(f"s{k}") + F.when(F.col("missing"), F.col(f"e{k}")).otherwise(0.0) for k in range(n_tags)]).alias("scores"))


def _local_scores(nodes: DataFrame, keys: list[str], weights: pa.Table, n_tags: int, features: str, miss: str) -> DataFrame:
    names = weights.column("feature").to_pylist()
    table = np.zeros((len(names) + 1, n_tags))  # the last row is that of a feature without weights
    for i, w in enumerate(weights.column("weights").to_pylist()):
        table[i, : len(w)] = w[:n_tags]
    empty = table[names.index(EMPTY)] if EMPTY in names else table[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {name: i for i, name in enumerate(names)}  # one index for all batches of a task
        for batch in batches:
            lists = batch.column(len(keys))
            sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            distinct = np.array([rows.get(f, len(names)) for f in coded.dictionary.to_pylist()] + [len(names)], np.int64)
            found = distinct[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)]
            ends = np.cumsum(sizes)
            running = np.concatenate((np.zeros((1, n_tags)), np.add.reduceat(table[found], (ends - sizes)[sizes > 0], axis=0))) if len(found) else np.zeros((1, n_tags))
            place = np.where(sizes > 0, np.cumsum(sizes > 0), 0)
            held = np.concatenate(([0], np.cumsum(found < len(names))))
            n_held = held[ends] - held[ends - sizes]
            missing = ((n_held < sizes) | (sizes == 0)) if miss == "any" else n_held == 0
            out = running[place] + missing[:, None] * empty
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * n_tags, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], scores], names=[*keys, "scores"])

    given = nodes.select(*keys, features)
    return given.mapInArrow(run, StructType([*[given.schema[k] for k in keys], *StructType.fromDDL("scores array<double>").fields]))


def best(scores: Column) -> Column:
    """Place of the largest score, the first at ties, from 0."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def add_scores(scores: Column, more: Column) -> Column:
    return F.zip_with(scores, more, lambda a, b: a + F.coalesce(b, F.lit(0.0)))
