"""One object for cutting and tagging text, made from stored models, dictionaries and switches."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinolex.operators.segment import Segmenter
from sinolex.operators.tagging import Tagger, tagset
from sinolex.sources import lines, models

#: Weight of a user word where none is given.
WEIGHT = 3.0


@dataclass(frozen=True)
class Engine:
    """Immutable; changed dictionaries make a new one."""

    segmenter: Segmenter
    tagger: Tagger | None = None

    @staticmethod
    def init(spark: SparkSession, segmenter: str, tagger: str | None = None, rules: bool = False, default_tags: str | None = None, user_words: str | None = None, user_tags: str | None = None) -> Engine:
        """From folders of stored models and paths of dictionary files; without a tagger texts are only cut."""
        cut = Segmenter(models.load_segmenter(spark, segmenter), use_rules=rules)
        if user_words:
            rows = lines.parse_segment_dictionary(lines.read_lines(spark, user_words))
            cut = cut.with_words(rows.withColumn("ord", F.lit(0)))
        if tagger is None:
            return Engine(cut)
        default = lines.parse_default_dictionary(lines.read_lines(spark, default_tags)).select("word", "tag") if default_tags else spark.createDataFrame([], "word string, tag string")
        made = Tagger(models.load_tagger(spark, tagger), default)
        if user_tags:
            rows = lines.parse_tag_dictionary(lines.read_lines(spark, user_tags))
            made = made.with_tags(rows.where("weight is null").select("word", "tag")).with_soft_tags(rows.where("weight is not null"))
        return Engine(cut, made)

    def add_word(self, word: str, weight: float = WEIGHT) -> Engine:
        """With a word that is cut out; the first weight of a word stays."""
        row = self.segmenter.model.weights.sparkSession.createDataFrame([(word, weight, 0)], "word string, weight double, ord int")
        return replace(self, segmenter=self.segmenter.with_words(row))

    def add_word_tag(self, word: str, tag: str, weight: float | None = None) -> Engine:
        """With a tag for a word: the only one, or with a weight one that adds to the model's score."""
        if self.tagger is None:
            raise ValueError("this engine has no tagger")
        spark = self.tagger.default.sparkSession
        if weight is None:
            row = spark.createDataFrame([(word, tag)], "word string, tag string")
            old = self.tagger.hard
            return replace(self, tagger=self.tagger.with_tags(row if old is None else old.where(F.col("word") != word).select("word", "tag").union(row)))
        row = spark.createDataFrame([(word, tag, weight)], "word string, tag string, weight double")
        old = self.tagger.soft
        return replace(self, tagger=self.tagger.with_soft_tags(row if old is None else old.select("word", "tag", "weight").union(row)))

    def tags(self) -> DataFrame:
        return tagset(self.segmenter.model.weights.sparkSession)

    def cut(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, words), or with a tagger (key, tokens of word and tag). Words found by a rule have its name as tag.

        Tags are found for normalised words; the words themselves are those of the text. Works on batches and streams; models
        too large for row transforms need a batch.
        """
        typed = self.segmenter.segment_typed(df, key, text).select(key, F.col("tokens.word").alias("words"), F.col("tokens.type").alias("types"))
        return typed.select(key, "words") if self.tagger is None else self.tagger.tag(typed, key, "words", types="types")
