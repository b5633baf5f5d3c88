"""Chinese fixtures, as the driver's tables hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sinolex.operators.tagging import TAGSET

ZH_WORDS = ["王小明", "欧阳修", "诸葛孔明", "上官", "赵李明华", "明", "一二三四五六", "三百二十", "百分之五", "12%", "1,234.5万", "12:30", ".", "5月份", "3时", "8小时", "１２万", "Ａｂｃ", "⑪号", "ⓐ组", "中国人", "é", "トリ", "你好！", "…", "a　b", "", "12\n", "几十万", "🙂笑"]


def values(words: list[str]) -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)


def words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in ZH_WORDS], "word string")


def tagset_values() -> str:
    return ", ".join(f"('{g}', '{t}', '{n}')" for g, tags in TAGSET.items() for t, n in tags.items())
