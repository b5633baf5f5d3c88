"""Word segmentation: normalise, score characters, boost by dictionary, join characters to words.

A model within the bounds of ``tables`` is cut by a row transform, on batches and streams. A larger one is joined: characters
become rows, which is a batch job with shuffles. Both give the same words.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinolex.functions.charset import preprocess
from sinolex.operators import dictionary, features, local, rules, scoring
from sinolex.operators.chars import tag_to_word
from sinolex.operators.tables import free


@dataclass(frozen=True)
class SegmenterModel:
    """Tables of a trained segmenter. weights: (feature, weights of beginning and continuation)."""

    weights: DataFrame
    words: DataFrame | None = None
    bigrams: DataFrame | None = None
    params: dict = field(default_factory=dict)

    def param(self, name: str, default):
        return self.params.get(name, default)


@dataclass(frozen=True)
class Segmenter:
    """An immutable segmenter; changed dictionaries make a new one."""

    model: SegmenterModel
    user_words: DataFrame | None = None
    use_rules: bool = False

    def with_words(self, entries: DataFrame) -> Segmenter:
        """With more user words (word, weight, ord) of any length; earlier entries stay before later ones of the same key."""
        if self.user_words is None:
            return replace(self, user_words=entries)
        later = entries.select("word", "weight", F.struct(F.lit(1).alias("turn"), "ord").alias("ord"))
        none = F.lit(None).cast(entries.schema["ord"].dataType)
        earlier = dictionary.upsert(self.user_words).select("word", "weight", F.struct(F.lit(0).alias("turn"), none.alias("ord")).alias("ord"))
        return replace(self, user_words=earlier.union(later))

    def pieces(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, seg, piece, type): gaps, which are segmented, and rule hits, which are words."""
        if not self.use_rules:
            return df.select(F.col(key), F.lit(0).alias("seg"), F.col(text).alias("piece"), F.lit(None).cast("string").alias("type"))
        hits = rules.resolve(rules.extract_info(F.col(text)))
        return df.select(F.col(key), F.posexplode(rules.cut_by_rules(F.col(text), hits)).alias("seg", "p")).select(key, "seg", F.col("p.s").alias("piece"), F.col("p.t").alias("type"))

    def table(self) -> local.SegmentTable | None:
        """The model compiled for tasks; None if it is too large."""
        m = self.model
        return local.segment_table(m.weights, m.words, m.bigrams, m.param("word_min", 2), m.param("word_max", 4), self.user_words)

    def clean(self, text: Column) -> Column:
        m = self.model
        return preprocess(text, m.param("convert_num_letter", True), m.param("normalize_num_letter", False), m.param("convert_exception", True)) if m.param("norm_text", True) else text

    def cut(self, df: DataFrame, text: str, out: str = "tokens", table: local.SegmentTable | None = None) -> DataFrame:
        """All rows and columns of a batch or a stream, with ``out``: tokens of word and type."""
        table = table or self.table()
        if table is None:
            raise ValueError("the model is too large for a row transform; use segment on a batch")
        hits = F.transform(rules.resolve(rules.extract_info(F.col(text))), lambda h: F.struct(h["b"].alias("b"), h["e"].alias("e"), h["t"].alias("t"))) if self.use_rules else F.array()
        names = free("clean", df.columns), free("hits", df.columns)
        rows = df.select("*", self.clean(F.col(text)).alias(names[0]), hits.cast("array<struct<b:int,e:int,t:string>>").alias(names[1]))
        return local.cut(rows, table, text, *names, out)

    def scored(self, df: DataFrame, text: str, out: str = "scores", table: local.SegmentTable | None = None) -> DataFrame:
        """All rows and columns, with ``out``: for each character its scores as a beginning and inside. Rules are not used."""
        table = table or self.table()
        if table is None:
            raise ValueError("the model is too large for a row transform; use char_scores on a batch")
        name = free("clean", df.columns)
        return local.score(df.select("*", self.clean(F.col(text)).alias(name)), table, name, out)

    def char_scores(self, gaps: DataFrame, keys: list[str], text: str) -> DataFrame:
        """(keys, pos, scores) of every character."""
        m = self.model
        rows = gaps.select(*keys, self.clean(F.col(text)).alias("clean"))
        nodes = features.segment_features(rows, keys, "clean", m.words, m.bigrams, m.param("word_min", 2), m.param("word_max", 4))
        scores = scoring.node_scores(nodes, [*keys, "pos"], m.weights, 2)
        if self.user_words is None:
            return scores
        words = dictionary.upsert(self.user_words)
        more = dictionary.boosts(dictionary.greedy(rows, keys, "clean", words), keys)
        joined = scores.join(more, [*keys, "pos"], "left")
        return joined.select(*keys, "pos", scoring.add_scores(F.col("scores"), F.array("add_b", "add_i")).alias("scores"))

    def segment_typed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, tokens of word and type) for every row; type names the rule that found the word, else it is null."""
        if (table := self.table()) is None:
            return self.segment_joined(df, key, text)
        out = free("tokens", [key, text])
        return self.cut(df.select(F.col(key), F.col(text)) if key != text else df.select(key), text, out, table).select(key, F.col(out).alias("tokens"))

    def segment_joined(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """As ``segment_typed``, by joins with a model of any size; keys are unique."""
        kind = "array<struct<word:string,type:string>>"
        pieces = self.pieces(df, key, text)
        gaps = pieces.where("type is null and length(piece) > 0").select(key, "seg", "piece")
        scores = self.char_scores(gaps, [key, "seg"], "piece")
        tags = scores.select(key, "seg", "pos", (F.col("scores")[1] > F.col("scores")[0]).cast("int").alias("tag")).groupBy(key, "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("t"))
        words = tag_to_word(F.col("piece"), F.col("t.tag"))
        cut = gaps.join(tags, [key, "seg"]).select(key, "seg", F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(None).cast("string").alias("type"))).alias("tokens"))
        whole = pieces.where("type is not null").select(key, "seg", F.array(F.struct(F.col("piece").alias("word"), "type")).alias("tokens"))
        joined = cut.union(whole).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg", "tokens"))).alias("s")).select(key, F.flatten("s.tokens").alias("tokens"))
        return df.select(key).join(joined, key, "left").select(key, F.coalesce("tokens", F.array().cast(kind)).alias("tokens"))

    def segment(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, words) for every row; null and empty texts have none. ``concat(words) = text``."""
        return self.segment_typed(df, key, text).select(key, F.col("tokens.word").alias("words"))
