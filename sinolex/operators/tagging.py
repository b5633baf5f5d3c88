"""Part-of-speech tagging: dictionary first, then the model, rule tags over both."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinolex.functions.charset import preprocess
from sinolex.operators import dictionary, features, local, scoring
from sinolex.operators.tables import free

# The tags and their names.
TAGSET = {
    "model": {"a": "形容词", "ad": "副形词", "an": "名形词", "c": "连词", "d": "副词", "f": "方位词", "m": "数词", "n": "名词", "nr": "人名", "ns": "地名", "nt": "组织机构名", "nz": "专有名词", "o": "拟声词", "p": "介词", "q": "量词", "r": "代词", "s": "处所词", "t": "时间词", "u": "助词", "v": "动词", "vi": "不及物动词", "w": "标点符号", "wx": "特殊字符符号", "x": "各类字符串"},
    "rule": {"email": "email", "id": "身份证号", "ip": "ip", "jp": "日文", "ru": "俄文", "ko": "韩文", "tel": "电话号码", "url": "url"},
    "deleted": {"vl": "动词性惯用语", "vn": "名动词", "nl": "名词性惯用语", "h": "前缀词", "k": "后缀词", "nr1": "中文姓氏", "nrf": "外文人名", "vd": "副动词", "dl": "副词惯用语", "al": "形容词惯用语"},
}


def tagset(spark) -> DataFrame:
    return spark.createDataFrame([(g, t, n) for g, tags in TAGSET.items() for t, n in tags.items()], "grp string, tag string, name string")


@dataclass(frozen=True)
class TaggerModel:
    """Tables of a trained tagger. weights: (feature, a weight for each of ``tags``, which are sorted)."""

    weights: DataFrame
    tags: list[str]
    words: DataFrame
    parts: DataFrame
    chars: DataFrame
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Tagger:
    model: TaggerModel
    default: DataFrame
    hard: DataFrame | None = None
    soft: DataFrame | None = None

    def with_tags(self, hard: DataFrame) -> Tagger:
        """With the user's (word, tag), which go before the default dictionary."""
        return replace(self, hard=hard)

    def with_soft_tags(self, soft: DataFrame) -> Tagger:
        """With the user's (word, tag, weight), which add to the model's scores."""
        return replace(self, soft=soft)

    def table(self) -> local.TagTable | None:
        """The model and the dictionaries compiled for tasks; None if they are too large."""
        m = self.model
        return local.tag_table(m.weights, m.tags, m.words, m.parts, m.chars, self.default, self.hard, self.soft, m.params.get("norm_text", True))

    def tagged(self, df: DataFrame, words: str, types: str | None = None, out: str = "tokens", table: local.TagTable | None = None) -> DataFrame:
        """All rows and columns of a batch or a stream, with ``out``: words and their tags. ``types`` beside the words go first."""
        table = table or self.table()
        if table is None:
            raise ValueError("the model is too large for a row transform; use tag on a batch")
        if types is None:
            return local.tag(df, table, words, None, out)
        name = free("types", df.columns)
        # one type beside each word, whatever was given
        kinds = F.transform(words, lambda _, i: F.get(F.col(types), i).cast("string"))
        return local.tag(df.withColumn(name, kinds), table, words, name, out).drop(name)

    def tag(self, df: DataFrame, key: str, words: str, rule_tags: DataFrame | None = None, types: str | None = None) -> DataFrame:
        """(key, tokens of word and tag) for every row.

        Tags by rule go before all others: ``types`` names an array beside the words, ``rule_tags`` has (key, word, rule_tag)
        for any equal word of the text. Words are looked up inside tasks, so a frequent word is no hot key; where the model or
        a dictionary is too large for that, or with ``rule_tags``, by joins.
        """
        if rule_tags is None and (table := self.table()) is not None:
            own = [key, words] + [types] * (types is not None)
            out = free("tokens", own)
            return self.tagged(df.select(*own), words, types, out, table).select(key, F.col(out).alias("tokens"))
        return self.tag_joined(df, key, words, rule_tags, types)

    def tag_joined(self, df: DataFrame, key: str, words: str, rule_tags: DataFrame | None = None, types: str | None = None) -> DataFrame:
        """As ``tag``, by joins with tables of any size; keys are unique."""
        both = F.arrays_zip(F.col(words).alias("w"), (F.col(types) if types else F.transform(words, lambda _: F.lit(None).cast("string"))).alias("t"))
        raw = df.select(F.col(key), F.posexplode(both).alias("pos", "x")).select(key, "pos", F.col("x.w").alias("raw"), F.col("x.t").alias("type"))
        tokens = raw.select(key, "pos", "raw", "type", preprocess(F.col("raw")).alias("word") if self.model.params.get("norm_text", True) else F.col("raw").alias("word"))
        looked = dictionary.look_up(tokens, self.default, self.hard)
        info = features.word_info(tokens.select("word"), self.model.words, self.model.parts, self.model.chars)
        # neighbours are taken before dictionary words go, as they are context for the rest
        nodes = features.tag_features(looked.select(key, "pos", "word", "dict_tag"), info, key, ("dict_tag",)).where("dict_tag is null")
        n = len(self.model.tags)
        scores = scoring.node_scores(nodes, [key, "pos", "word"], self.model.weights, n)
        if self.soft is not None:
            names = self.model.tags
            boost = self.soft.where(F.col("tag").isin(names)).groupBy("word").agg(*[F.sum(F.when(F.col("tag") == t, F.col("weight")).otherwise(0.0)).alias(f"b{k}") for k, t in enumerate(names)])
            scores = scores.join(boost, "word", "left").select(key, "pos", scoring.add_scores(F.col("scores"), F.array(*[f"b{k}" for k in range(n)])).alias("scores"))
        names = F.array(*[F.lit(t) for t in self.model.tags])
        chosen = scores.select(key, "pos", F.element_at(names, scoring.best(F.col("scores")) + 1).alias("model_tag"))
        rows = looked.join(chosen, [key, "pos"], "left")
        tag = F.coalesce("dict_tag", "model_tag")
        if rule_tags is not None:
            rows = rows.join(rule_tags.select(key, F.col("word").alias("raw"), "rule_tag").dropDuplicates([key, "raw"]), [key, "raw"], "left")
            tag = F.coalesce(F.col("rule_tag"), tag)
        tag = F.coalesce(F.col("type"), tag)
        done = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("raw").alias("word"), tag.alias("tag")))).alias("t"))
        done = done.select(key, F.transform("t", lambda x: F.struct(x["word"].alias("word"), x["tag"].alias("tag"))).alias("tokens"))
        return df.select(key).join(done, key, "left").select(key, F.coalesce("tokens", F.array().cast("array<struct<word:string,tag:string>>")).alias("tokens"))
