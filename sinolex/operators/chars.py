"""Characters, boundary tags and words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chars(text: Column) -> Column:
    """Code points of a text; none for null or empty."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def words_of(text: Column) -> Column:
    """White-space separated tokens, which stand for gold words where a corpus has no others."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def explode_chars(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(chars(F.col(text))).alias("pos", "ch"))


def word_to_tag(words: Column) -> Column:
    """One tag for each character: 0 begins a word, 1 continues it."""
    return F.flatten(F.transform(words, lambda w: F.transform(chars(w), lambda _, i: F.when(i == 0, 0).otherwise(1))))


def tag_to_word(text: Column, tags: Column) -> Column:
    """Words of a text by its tags. The first character begins a word whatever its tag."""
    starts = F.filter(F.transform(tags, lambda t, i: F.when((t == 0) | (i == 0), i + 1).otherwise(F.lit(0))), lambda i: i > 0)
    both = F.struct(chars(text).alias("cs"), starts.alias("s"))

    def cut(x: Column) -> Column:
        n = F.size(x["cs"])
        return F.transform(x["s"], lambda at, k: F.array_join(F.slice(x["cs"], at, F.greatest(F.coalesce(F.get(x["s"], k + 1), n + 1) - at, F.lit(0))), ""))

    return F.coalesce(let(both, cut), F.array().cast("array<string>"))


def char_features(text: Column) -> Column:
    """For each character its features from the characters up to three places away."""
    before = [(1, "b", "bc"), (2, "a", "ac"), (3, "z", "zc")]
    after = [(1, "d", "cd"), (2, "e", "ce"), (3, "f", "cf")]

    def of(cs: Column) -> Column:
        def at(i: Column, k: int) -> Column:
            return F.get(cs, i + k)

        def one(c: Column, i: Column) -> Column:
            out = [F.concat(F.lit("c"), c), F.when(i == 0, F.lit("[START]")), F.when(i == F.size(cs) - 1, F.lit("[END]"))]
            out += [x for k, single, pair in before for x in (F.concat(F.lit(single), at(i, -k)), F.concat(F.lit(pair), at(i, -k), F.lit("."), c))]
            out += [x for k, single, pair in after for x in (F.concat(F.lit(single), at(i, k)), F.concat(F.lit(pair), c, F.lit("."), at(i, k)))]
            return F.array_compact(F.array(*out))

        return F.transform(cs, one)

    return let(chars(text), of)


#: Kinds of features by the places, from the character, of the characters in them.
NEAR = [("c", 0, None), ("b", -1, None), ("bc", -1, 0), ("a", -2, None), ("ac", -2, 0), ("z", -3, None), ("zc", -3, 0), ("d", 1, None), ("cd", 0, 1), ("e", 2, None), ("ce", 0, 2), ("f", 3, None), ("cf", 0, 3)]
EDGES = ["[START]", "[END]"]


def char_feature_counts(df: DataFrame, text: str) -> DataFrame:
    """(feature, freq) of ``char_features`` over all texts.

    Features are counted as packed numbers inside tasks, so only distinct ones are shuffled, and written out once they are summed.
    """
    none = 0x110000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for begin in range(0, len(texts), 500):
                part = texts[begin : begin + 500]
                # three places between texts, so that no character has one of another text beside it
                codes = np.frombuffer(("\x00" * 3).join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                sizes = np.array([len(t) for t in part])
                starts = np.cumsum(sizes + 3) - sizes - 3
                padded = np.full(len(codes) + 6, none, np.int64)
                inside = np.ones(len(codes), bool)
                gaps = (starts[1:, None] - np.arange(1, 4)).ravel()
                inside[gaps] = False
                padded[3:-3] = np.where(inside, codes, none)
                at = np.flatnonzero(inside) + 3
                kinds, totals = [], []
                for kind, (_, left, right) in enumerate(NEAR):
                    a, b = padded[at + left], padded[at + right] if right is not None else np.full(len(at), none)
                    held = (a != none) if right is None else (a != none) & (b != none)
                    keys, n = np.unique((a[held] << 21 | b[held]) + (np.int64(kind) << 42), return_counts=True)
                    kinds.append(keys)
                    totals.append(n)
                kinds.append((np.arange(len(EDGES)) + len(NEAR)).astype(np.int64) << 42)
                totals.append(np.full(len(EDGES), len(part)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(totals).astype(np.int64))], names=["key", "freq"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            kind, a, b = (keys >> 42).tolist(), (keys >> 21 & 0x1FFFFF).tolist(), (keys & 0x1FFFFF).tolist()
            names = [EDGES[k - len(NEAR)] if k >= len(NEAR) else NEAR[k][0] + chr(x) + ("" if y == none else "." + chr(y)) for k, x, y in zip(kind, a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1)], names=["feature", "freq"])

    sums = df.select(text).mapInArrow(count, "key long, freq long").groupBy("key").agg(F.sum("freq").alias("freq"))
    return sums.mapInArrow(write, "feature string, freq long")
