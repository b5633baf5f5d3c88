"""Tests on words as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family names of one and of two characters.
SURNAMES = (
    "赵李吴郑王冯陈褚蒋沈韩杨朱秦尤许何吕张孔曹严魏陶姜戚邹喻窦潘葛奚范彭郎鲁韦"
    "俞袁酆鲍史廉岑薛倪滕殷罗郝邬傅卞康伍卜顾孟穆萧尹姚邵"
    "湛汪祁禹狄臧宋茅董梁杜阮闵贾娄郭盛刁钟徐邱骆"
    "蔡樊凌霍虞柯昝卢莫裘缪丁贲邓郁崔龚嵇邢裴翁荀於惠甄"
    "芮羿储靳汲邴糜弓隗侯宓蓬郗仲伊栾钭刘詹"
    "韶郜黎蓟薄蒲邰鄂蔺乔胥莘翟谭贡逄姬冉郦雍郤璩"
    "濮扈冀郏尚晏瞿阎慕茹宦艾易慎戈廖庾暨衡耿弘匡寇禄阙"
    "殳沃夔厍聂晁敖融訾阚饶毋乜鞠巢蒯後竺逯桓"
    "仉晋楚闫汝鄢涂钦缑亢牟佘佴赏谯笪佟"
)
LONG_SURNAMES = (
    "万俟 司马 上官 欧阳 夏侯 诸葛 闻人 东方 赫连 皇甫 尉迟 公羊 澹台 公冶 宗政 濮阳 淳于 单于 太叔 申屠 "
    "公孙 仲孙 轩辕 令狐 钟离 宇文 长孙 慕容 鲜于 闾丘 司徒 司空 亓官 司寇 子车 颛孙 端木 巫马 公西 漆雕 "
    "乐正 壤驷 公良 拓跋 夹谷 宰父 谷梁 段干 百里 东郭 南门 呼延 羊舌 微生 梁丘 左丘 东门 西门 南宫 第五"
).split()
# The published number, percent and time forms.
NUMBER = r"(?U)^(?:\d+(?:,\d+)?(?:\.\d+)?(?:万|亿|万亿|万千|千万|千|点|亿千|兆)|\d+[%％]?|\d*\.\d*[%％]?|\d+:\d+|[零一二三四五六七八九十百千万亿]{3,9})\n?\z"
PURE_NUMBER = r"(?U)^(?:\d+[%％]?|\d*\.\d*[%％]?)\n?\z"
PERCENT = "百分之"
TIME = r"(?U)\d(?:年|月|日|小?时|分|秒)"
SEPARATORS = "@，·ん"


def has_chinese(word: Column) -> Column:
    return word.rlike("[一-龥]")


def is_number(word: Column) -> Column:
    return word.rlike(NUMBER)


def is_pure_number(word: Column) -> Column:
    return word.rlike(PURE_NUMBER)


def has_percent(word: Column) -> Column:
    return word.contains(PERCENT)


def has_time(word: Column) -> Column:
    return word.rlike(TIME)


def is_name(word: Column) -> Column:
    """Whether a word has the shape of a Chinese personal name, by its length and family name."""

    def surname(at: int) -> Column:
        return F.instr(F.lit(SURNAMES), F.substring(word, at, 1)) > 0

    double = F.substring(word, 1, 2).isin(LONG_SURNAMES)
    n = F.length(word)
    by_length = F.when(n == 2, surname(1)).when(n == 3, surname(1) | double).when(n == 4, (surname(1) & surname(2)) | double)
    return F.coalesce(by_length.otherwise(F.lit(False)), F.lit(False))


def has_separator(word: Column) -> Column:
    return reduce(lambda a, b: a | b, (word.contains(c) for c in SEPARATORS))


def keep_unigram(word: Column, freq: Column | None, word_min: int = 2, word_max: int = 4, trim: int = 1, chinese: bool = True, common: int = 500) -> Column:
    """Whether a corpus word joins the segmenter's vocabulary. Without a frequency, names never do."""
    good = F.length(word).between(word_min, word_max) & ~is_number(word) & ~has_percent(word) & ~has_time(word) & ~has_separator(word)
    if chinese:
        good &= has_chinese(word)
    if freq is None:
        return good & ~is_name(word)
    return good & (freq >= trim) & ((freq >= common) | ~is_name(word))


def keep_tag_unigram(word: Column, freq: Column, word_max: int = 4, trim: int = 1, common: int = 500) -> Column:
    """The tagger's test: any script, no least length; single characters may be separators."""
    good = (F.length(word) <= word_max) & ~is_number(word) & ~has_percent(word) & ~has_time(word) & ((F.length(word) == 1) | ~has_separator(word))
    return good & (freq >= trim) & ((freq >= common) | ~is_name(word))
