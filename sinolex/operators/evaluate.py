"""Precision, recall, F1 and accuracy of tag sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinolex.operators.chars import let
from sinolex.operators.tables import list_sizes, parts


def tokens_of(tags: Column, names: list[str]) -> Column:
    """Tag numbers to tag names."""
    return F.transform(tags, lambda t: F.element_at(F.array(*[F.lit(n) for n in names]), t + 1))


def chunks(tags: Column, begin: int = 0, inside: int = 1) -> Column:
    """(pos, len) of the chunks: each begins at a beginning and goes on while tags continue it."""

    def of(ts: Column) -> Column:
        breaks = F.filter(F.transform(ts, lambda t, i: F.when(t != inside, F.struct(i.alias("pos"), t.alias("tag")))), lambda x: x.isNotNull())

        def ended(found: Column, size: Column) -> Column:
            whole = F.transform(found, lambda x, k: F.struct(x["pos"].alias("pos"), (F.coalesce(F.get(found, k + 1)["pos"], size) - x["pos"]).alias("len"), x["tag"].alias("tag")))
            return F.transform(F.filter(whole, lambda x: x["tag"] == begin), lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len")))

        return let(F.struct(breaks.alias("found"), F.size(ts).alias("size")), lambda x: let(x["found"], lambda f: ended(f, x["size"])))

    return let(tags, of)


def chunk_rows(df: DataFrame, key: str, tags: str) -> DataFrame:
    """The chunks as rows."""
    return df.select(key, F.explode(chunks(F.col(tags))).alias("c")).select(key, "c.*")


def tag_chunks(gold: pa.Array, pred: pa.Array) -> list[np.ndarray]:
    """For each side of a batch a number for each chunk (0 begins, 1 goes on, others end it) from its row, place and length."""
    sides = []
    for tags in (gold, pred):
        sizes = pc.fill_null(tags.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sides.append((sizes, pc.fill_null(tags.flatten().cast(pa.int64()), 1).to_numpy(zero_copy_only=False)))
    room = np.maximum(sides[0][0], sides[1][0])
    base, out = np.cumsum(room) - room, []
    for sizes, flat in sides:
        starts = np.cumsum(sizes) - sizes
        # a break is a tag that does not go on, or a row's first one; a chunk reaches to the next break
        breaks = flat != 1
        breaks[starts[sizes > 0]] = True
        at = np.flatnonzero(breaks)
        length = np.diff(np.append(at, len(flat)))
        row = np.repeat(np.arange(len(sizes)), sizes)[at]
        out.append(((base[row] + at - starts[row]) << 31 | length)[flat[at] == 0])
    return out


def f1(df: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """One row of micro-averaged figures over the corpus; null precision or recall without chunks, F1 0 without a correct one.

    Chunks are counted inside each row; only the three counts are summed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3, np.int64)
        for batch in (p for b in batches for p in parts(b, np.maximum(list_sizes(b.column(0)), list_sizes(b.column(1))))):
            spans = tag_chunks(batch.column(0), batch.column(1))
            total += len(spans[0]), len(spans[1]), len(np.intersect1d(*spans, assume_unique=True))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=["n_gold", "n_pred", "n_correct"])

    sums = df.select(gold, pred).mapInArrow(run, "n_gold long, n_pred long, n_correct long")
    counts = sums.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_gold", "n_pred", "n_correct")])
    precision, recall = F.col("n_correct") / F.nullif("n_pred", F.lit(0)), F.col("n_correct") / F.nullif("n_gold", F.lit(0))
    score = F.when(F.col("n_correct") == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return counts.select("n_gold", "n_pred", "n_correct", precision.alias("precision"), recall.alias("recall"), score.alias("f1"))


def accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Share of right tags and of samples that are right throughout."""
    same = F.aggregate(F.zip_with(gold, pred, lambda a, b: F.when(a.eqNullSafe(b), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    rows = df.select(same.alias("same"), F.size(gold).alias("n"))
    return rows.agg((F.sum("same") / F.nullif(F.sum("n"), F.lit(0))).alias("token_acc"), (F.sum((F.col("same") == F.col("n")).cast("int")) / F.nullif(F.count("*"), F.lit(0))).alias("sample_acc"))
