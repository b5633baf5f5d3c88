"""Character normalisation as Catalyst expressions. All of them keep the number of characters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "ん"
ASCII_LOWER = "".join(map(chr, range(ord("a"), ord("z") + 1)))
ASCII_UPPER = ASCII_LOWER.upper()

# The sentence marks that become one, the ideographic space, the number words, and the allowed characters.
MARKS = "。；！？…"
WIDE_SPACE = "　"
NUMBER_WORDS = "几二三四五六七八九十千万亿兆零"
ALLOWED = "\\x09-\\x0d\\x20-\\x7e\\xa0£¥©®°±×÷‐-”•·・…‰※℃℉Ⅰ-ⅹ①-⒛\\u3000-】〔-〞㈠-㈩一-龥﹐-﹫！-～￠￡￥"


def run(first: str, n: int) -> str:
    """n characters from the first one on."""
    return "".join(map(chr, range(ord(first), ord(first) + n)))


#: Signs that stand for 1, 2, 3 and so on: circled, in brackets, with a full stop, ideographs in brackets.
COUNTED = [run("①", 20), run("⑴", 20), run("⒈", 20), run("㈠", 10)]
WIDE_DIGITS = run("０", 10)
WIDE_UPPER, WIDE_LOWER = run("Ａ", 26), run("ａ", 26)
BRACKET_LOWER, CIRCLED_UPPER, CIRCLED_LOWER = run("⒜", 26), run("Ⓐ", 26), run("ⓐ", 26)


def convert_table() -> tuple[str, str]:
    """Wide, circled and bracketed digits and letters to ASCII; numbers of two digits to 9; sentence marks to one."""
    digits = "".join(str(min(i + 1, 9)) for row in COUNTED for i in range(len(row)))
    source = WIDE_DIGITS + "".join(COUNTED) + WIDE_UPPER + WIDE_LOWER + BRACKET_LOWER + CIRCLED_UPPER + CIRCLED_LOWER + WIDE_SPACE + MARKS
    target = "0123456789" + digits + ASCII_UPPER + ASCII_LOWER * 2 + ASCII_UPPER + ASCII_LOWER + " " + "。" * len(MARKS)
    return source, target


def normalize_table() -> tuple[str, str]:
    """All digits and number words to 7, all letters to Z. The wide j stays as it is, as in the published models."""
    digits = "0123456789" + NUMBER_WORDS + WIDE_DIGITS + "".join(COUNTED)
    letters = WIDE_UPPER + WIDE_LOWER.replace("ｊ", "") + ASCII_UPPER + ASCII_LOWER + BRACKET_LOWER + CIRCLED_UPPER + CIRCLED_LOWER
    return digits + letters + WIDE_SPACE + MARKS, "7" * len(digits) + "Z" * len(letters) + " " + "。" * len(MARKS)


def convert(text: Column) -> Column:
    return F.translate(text, *convert_table())


def normalize(text: Column) -> Column:
    return F.translate(text, *normalize_table())


def mask_unknown(text: Column) -> Column:
    """Each character outside the allowed class becomes one mark."""
    return F.regexp_replace(text, f"[^{ALLOWED}]", UNKNOWN)


def preprocess(text: Column, convert_num_letter: bool = True, normalize_num_letter: bool = False, convert_exception: bool = True) -> Column:
    if normalize_num_letter:
        text = normalize(text)
    elif convert_num_letter:
        text = convert(text)
    return mask_unknown(text) if convert_exception else text


def preprocess_text(convert_num_letter: bool = True, normalize_num_letter: bool = False, convert_exception: bool = True) -> Callable[[str], str]:
    """What ``preprocess`` does, for distinct words inside tasks."""
    tables = normalize_table() if normalize_num_letter else convert_table() if convert_num_letter else ("", "")
    table, unknown, wide = str.maketrans(*tables), re.compile(f"[^{ALLOWED}]"), not any(map(str.isascii, tables[0]))
    found = re.compile(f"[{re.escape(tables[0])}]").search if tables[0] else lambda _: None

    def converted(text: str) -> str:
        """Texts without a character of the table are left as they are, as translating takes long."""
        return text if wide and text.isascii() or not found(text) else text.translate(table)

    return (lambda text: unknown.sub(UNKNOWN, converted(text))) if convert_exception else converted
