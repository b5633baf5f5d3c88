"""Corpus statistics and vocabularies for the segmenter and the tagger, as aggregations and joins.

Corpora are long tables: (sent_id, pos, word) and for tagging a tag. Words are normalised before they are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.functions import predicates as P
from sinolex.functions.charset import preprocess_text
from sinolex.operators.chars import chars
from sinolex.operators.tables import AT_ONCE, durable, slices, within

#: Characters of texts whose words are counted at once.
COUNTED_AT_ONCE = 2_000_000
#: Words, held as numbers, of which the neighbours are counted at once.
PAIRED_AT_ONCE = 2_000_000


def long_words(df: DataFrame, key: str, words: Column) -> DataFrame:
    return df.select(F.col(key).alias("sent_id"), F.posexplode(words).alias("pos", "word"))


def length_histogram(words: DataFrame, longest: int = 10) -> DataFrame:
    """Tokens by word length with their share; all longer ones are one class."""
    counts = words.groupBy(F.least(F.length("word"), F.lit(longest + 1)).alias("len")).agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def frequencies(words: DataFrame, column: str = "word") -> DataFrame:
    return words.groupBy(column).agg(F.count("*").alias("freq"))


def unigrams(freqs: DataFrame, keep: Column) -> DataFrame:
    return freqs.where(keep)


def kept_ratio(freqs: DataFrame, keep: Column) -> DataFrame:
    """Share of tokens whose word is kept."""
    return freqs.agg((F.sum(F.when(keep, F.col("freq")).otherwise(0)) / F.sum("freq")).alias("kept_ratio"))


def pairs(words: DataFrame) -> DataFrame:
    """Neighbouring words with their count."""
    following = F.lead("word").over(Window.partitionBy("sent_id").orderBy("pos"))
    rows = words.select(F.col("word").alias("pre"), following.alias("suf")).where("suf is not null")
    return rows.groupBy("pre", "suf").agg(F.count("*").alias("freq"))


def pairs_in(df: DataFrame, words: Column) -> DataFrame:
    """As ``pairs``, from arrays of words, in which neighbours lie side by side."""
    rows = df.select(words.alias("w"))
    both = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("pre"), b.alias("suf")))
    return rows.select(F.explode(both).alias("x")).groupBy(F.col("x.pre").alias("pre"), F.col("x.suf").alias("suf")).agg(F.count("*").alias("freq"))


def _coded(texts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Of normalised texts: null and the distinct words, and all words as places in them with a null before, between and behind texts."""
    clean, found = preprocess_text(), re.compile(r"[^\x20\x09-\x0D]+").findall
    for batch in texts:
        column = batch.column(0)
        for i, j in slices(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False), COUNTED_AT_ONCE):
            flat: list[str | None] = [None]
            for words in (found(clean(t)) for t in column[i:j].to_pylist() if t):
                if words:
                    flat += words
                    flat.append(None)
            coded = pa.array(flat, pa.string()).dictionary_encode()
            yield pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary]), pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, freq) of the normalised words of texts, counted inside tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, code in _coded(batches):
            yield pa.RecordBatch.from_arrays([names[1:], pa.array(np.bincount(code, minlength=len(names))[1:].astype(np.int64))], names=["word", "freq"])

    return df.select(text).mapInArrow(run, "word string, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))


def _gathered(coded: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """As ``_coded``, about PAIRED_AT_ONCE words at a time."""

    def joined(held: list[pa.DictionaryArray]) -> tuple[pa.Array, np.ndarray]:
        whole = pa.chunked_array(held).unify_dictionaries()
        code = np.concatenate([pc.fill_null(part.indices, -1).to_numpy(zero_copy_only=False) for part in whole.chunks])
        return pa.concat_arrays([pa.nulls(1, pa.string()), whole.chunk(0).dictionary]), code.astype(np.int64) + 1

    held, n = [], 0
    for names, code in coded:
        code = code[1:] if held else code  # the null behind the texts before is the one before these
        held.append(pa.DictionaryArray.from_arrays(pa.array((code - 1).astype(np.int32), mask=code == 0), names[1:]))
        n += len(code)
        if n >= PAIRED_AT_ONCE:
            yield joined(held)
            held, n = [], 0
    if held:
        yield joined(held)


def neighbour_rows(df: DataFrame, text: str) -> DataFrame:
    """(pre, suf, freq) of neighbouring normalised words, counted for some texts at a time; pre is null before the first word of a
    text, suf behind the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, code in _gathered(_coded(batches)):
            keys, freq = np.unique(code[:-1] * len(names) + code[1:], return_counts=True)
            for i in range(0, len(keys), AT_ONCE):
                pre, suf = (names.take(pa.array(k)) for k in np.divmod(keys[i : i + AT_ONCE], len(names)))
                yield pa.RecordBatch.from_arrays([pre, suf, pa.array(freq[i : i + AT_ONCE].astype(np.int64))], names=["pre", "suf", "freq"])

    return df.select(text).mapInArrow(run, "pre string, suf string, freq long")


def summed_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pre", "suf").agg(F.sum("freq").alias("freq"))


def text_pairs(df: DataFrame, text: str) -> DataFrame:
    """As ``pairs_in``, from texts, of which the words are normalised ones.

    Few of a task's pairs come twice once they are counted some texts at a time, so rows are dealt by pair before they are
    summed: a map of all pairs of a task would hold more than it saves.
    """
    rows = neighbour_rows(df, text).where("pre is not null and suf is not null")
    return summed_pairs(rows.repartition("pre", "suf"))


def ending(word: Column, n: int) -> Column:
    """The slice from length - n on; a start below 0 counts from the end once more, as slices do."""
    size = F.length(word)
    start = F.when(size >= n, size - n).otherwise(F.greatest(2 * size - n, F.lit(0)))
    return F.substring(word, start + 1, size)


def ambiguous(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Of counted neighbours those of which a known word could be cut across the border: (pre, suf, freq).

    Known words within the bounds of tasks are looked up there, row by row, so ``counts`` may be partial ones as well.
    """
    counted = counts.where("pre != '' and suf != ''")
    u = known.select("word").distinct()
    if within(u, "word"):
        return _crossing(counted, u)
    counted = summed_pairs(counted)
    after = [F.concat(F.substring("pre", -1, 1), F.substring("suf", 1, i)) for i in (3, 2, 1)]
    before = [F.concat(ending(F.col("pre"), i), F.substring("suf", 1, 1)) for i in (3, 2, 1)]
    rows = counted.select("pre", "suf", "freq", F.explode(F.array(F.struct(F.col("pre").alias("side"), F.array(*after).alias("c")), F.struct(F.col("suf").alias("side"), F.array(*before).alias("c")))).alias("x"))
    rows = rows.select("pre", "suf", "freq", "x.side", F.explode(F.array_distinct("x.c")).alias("word"))
    rows = rows.join(u, "word", "left_semi").join(u.withColumnRenamed("word", "side"), "side", "left_semi")
    return rows.select("pre", "suf", "freq").distinct()


def _crossing(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (pre, suf, freq) that a known word could cross, without a shuffle."""
    sides = {
        "pre": [F.concat(F.substring("pre", -1, 1), F.substring("suf", 1, i)) for i in (3, 2, 1)],
        "suf": [F.concat(ending(F.col("pre"), i), F.substring("suf", 1, 1)) for i in (3, 2, 1)],
    }
    found = rows
    for side, candidates in sides.items():
        for k, candidate in enumerate([F.col(side), *candidates]):
            name = f"{side}_{k}"
            found = found.join(F.broadcast(known.select(F.col("word").alias(name))), candidate == F.col(name), "left")  # within the bounds of tasks
    held = {side: F.col(f"{side}_0").isNotNull() & F.coalesce(*[f"{side}_{k}" for k in (1, 2, 3)]).isNotNull() for side in sides}
    return found.where(held["pre"] | held["suf"]).select("pre", "suf", "freq")


def back_fill(bigrams: DataFrame, known: DataFrame, trim: int, word_min: int = 2, word_max: int = 4, chinese: bool = True) -> tuple[DataFrame, DataFrame]:
    """Frequent bigrams, and the words with the bigrams' own valid members; bigrams with a member that is still unknown go."""
    frequent = durable(bigrams.where(F.col("freq") >= trim))  # looked at for its members and by itself
    members = frequent.select(F.explode(F.array("pre", "suf")).alias("word")).distinct()
    valid = members.where(P.keep_unigram(F.col("word"), None, word_min, word_max, chinese=chinese))
    words = known.select("word").union(valid).distinct()
    kept = frequent.join(words.withColumnRenamed("word", "pre"), "pre", "left_semi").join(words.withColumnRenamed("word", "suf"), "suf", "left_semi")
    return words, kept.select("pre", "suf", "freq")


def trim_features(freqs: DataFrame, feature_trim: int, gap_1: int, gap_2: int, gap_3: int, bigram_trim: int) -> DataFrame:
    """Frequent features; pairs of characters need more the farther apart they are."""
    f, n = F.col("feature"), F.col("freq")

    def starts(*prefixes: str) -> Column:
        return F.substring(f, 1, 2).isin(*prefixes)

    keep = F.when(starts("zc", "cf"), n > gap_3).when(starts("ac", "ce"), n > gap_2).when(starts("bc", "cd"), n > gap_1).when(starts("wl", "wr"), n >= bigram_trim)
    return freqs.where(keep.otherwise(n >= feature_trim))


def length_features() -> list[str]:
    """The word length features, which are always in the index."""
    return [f"{side}{i}{j}" for i in range(1, 10) for j in range(1, 10) for side in ("wl", "wr")]


def index_features(freqs: DataFrame, always: list[str] | None = None) -> DataFrame:
    """(feature, idx) by falling frequency from 1 on; features of ``always`` that are missing follow, / is 0.

    Numbers come from counts of whole partitions of a range sort, so no task sees all features.
    """
    spark = freqs.sparkSession
    rows = durable(freqs.select("feature", "freq"))  # the range sort looks at it twice
    if always:
        extra = spark.createDataFrame([(f,) for f in always], "feature string").join(rows, "feature", "left_anti")
        rows = rows.union(extra.select("feature", F.lit(-1).cast("long")))
    rows = rows.where("feature != '/'").orderBy(F.desc("freq"), "feature").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(F.desc("freq"), "feature")
    rows = durable(rows.withColumn("n", F.row_number().over(inside)))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    numbered = rows.join(F.broadcast(before), "part").select("feature", (F.col("before") + F.col("n")).cast("int").alias("idx"))
    return numbered.union(spark.createDataFrame([("/", 0)], "feature string, idx int"))


# The tagger's statistics.


def tag_frequencies(tokens: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Tokens by tag; with a dictionary also those whose raw word it doesn't hold."""
    if dictionary is None:
        return tokens.groupBy("tag").agg(F.count("*").alias("freq"))
    flagged = tokens.join(dictionary.select("word").distinct().withColumn("held", F.lit(1)), "word", "left")
    return flagged.groupBy("tag").agg(F.count("*").alias("freq"), F.sum(F.when(F.col("held").isNull(), 1).otherwise(0)).alias("freq_model"))


def without(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    return words.join(dictionary.select("word").distinct(), "word", "left_anti")


def char_frequencies(words: DataFrame, trim: int = 1) -> DataFrame:
    """Frequent characters that are not Chinese. Words are counted first, or are counted already."""
    counts = counts_of(words).select("freq", F.explode(chars(F.col("word"))).alias("ch")).groupBy("ch").agg(F.sum("freq").alias("freq"))
    return counts.where(~P.has_chinese(F.col("ch")) & (F.col("freq") >= trim))


def counts_of(words: DataFrame) -> DataFrame:
    """(word, freq) of tokens, or of words that are counted already."""
    return words if "freq" in words.columns else frequencies(words)


def part_frequencies(words: DataFrame, known: DataFrame) -> DataFrame:
    """Proper beginnings and endings of the words that are not known. Words are counted before known ones go and before they are
    cut; ``words`` may be counted already."""
    counted = without(counts_of(words), known).where(F.length("word") > 1)
    cuts = F.sequence(F.lit(1), F.length("word") - 1)
    parts = F.flatten(F.transform(cuts, lambda i: F.array(F.col("word").substr(F.lit(1), i), F.col("word").substr(i + 1, F.length("word")))))
    return counted.select("freq", F.explode(parts).alias("part")).groupBy("part").agg(F.sum("freq").alias("freq"))


def trim_parts(parts: DataFrame, longest: int = 4, chinese: int = 300, numbers: int = 400, others: int = 1000) -> DataFrame:
    """Frequent parts with their kind; the tagger uses the Chinese ones."""
    p = F.col("part")
    kind = F.when(P.has_chinese(p), "chinese").when(P.is_pure_number(p), "number").otherwise("other")
    least = F.when(kind == "chinese", chinese).when(kind == "number", numbers).otherwise(others)
    return parts.where((F.length(p) <= longest) & (F.col("freq") >= least)).withColumn("kind", kind)


def unknown_words(words: DataFrame, dictionary: DataFrame, known: DataFrame, parts: DataFrame) -> DataFrame:
    """Words outside the dictionary and the known words of which no beginning or ending is a known part."""
    counted = durable(without(without(counts_of(words), dictionary), known))
    longest = parts.agg(F.coalesce(F.max(F.length("part")), F.lit(0))).first()[0]
    # only beginnings and endings as long as a part can be one
    cuts = F.when(F.least(F.length("word") - 1, F.lit(longest)) > 0, F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(longest)))).otherwise(F.array().cast("array<int>"))
    own = F.flatten(F.transform(cuts, lambda i: F.array(F.substring("word", F.lit(1), i), F.substring("word", -i, i))))
    having = counted.select("word", F.explode(own).alias("part")).join(parts.select("part"), "part", "left_semi").select("word").distinct()
    return counted.join(having, "word", "left_anti")


def add_common_chars(known: DataFrame, unknown: DataFrame, char_set: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known words with the unknown ones that are frequent characters; the words that stay unknown."""
    common = char_set.select(F.col("ch").alias("word"))
    words = known.select("word").union(unknown.select("word").join(common, "word", "left_semi")).distinct()
    return words, unknown.join(common, "word", "left_anti")
