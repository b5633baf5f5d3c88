"""Entities by rule (addresses, ids, telephone numbers) with exact offsets.

Patterns are matched inside tasks, where one pass gives words and places; overlaps and pieces are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "array<struct<s:string,b:int,e:int,t:string>>"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]\d{2}|[1-9]?\d)"
# The published shapes of the entities. (?U): digits of any script are digits.
RULES = {
    "url": r"(?U)(?<=[^.])((?:(?:https?|ftp|file)://|(?<![a-zA-Z\-.])www\.)[\-A-Za-z0-9+&@()#/%?=~_|!:,.;]+[\-A-Za-z0-9+&@#/%=~_|])(?=[<一-龥￥，。；！？、“”‘’>（）—《》…● \t\n])",
    "email": r"(?U)(?<=[^0-9a-zA-Z.\-])([a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+(?:\.[a-zA-Z0-9_.-]+)*\.[a-zA-Z0-9]{2,6})(?=[^0-9a-zA-Z.\-])",
    "id": r"(?U)(?<=[^0-9a-zA-Z])((?:1[1-5]|2[1-3]|3[1-7]|4[1-6]|5[0-4]|6[1-5]|71|81|82|91)(?:0[0-9]|1[0-9]|2[0-9]|3[0-4]|4[0-3]|5[1-3]|90)(?:0[0-9]|1[0-9]|2[0-9]|3[0-9]|4[0-3]|5[1-7]|6[1-4]|7[1-4]|8[1-7])(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])\d{3}[0-9xX])(?=[^0-9a-zA-Z])",
    "ip": rf"(?U)(?<=[^0-9])({OCTET}\.{OCTET}\.{OCTET}\.{OCTET})(?=[^0-9])",
    "cell": r"(?U)(?<=[^\d])((?:(?:\+86)?[- ]?)?1[3-9][0-9][- ]?\d{4}[- ]?\d{4})(?=[^\d])",
    "landline": r"(?U)(?<=[^\d])([(（]?0\d{2,3}[)） —-]{1,2}\d{7,8}|\d{3,4}[ -]\d{3,4}[ -]\d{4})(?=[^\d])",
}
#: What every hit of a rule holds; texts without it are not searched.
SIGNS = {"url": r"://|www\.", "email": "@", "id": r"(?U)\d{6}(?:18|19|20)\d{9}", "ip": r"(?U)\d\.\d{1,3}\.\d{1,3}\.\d", "cell": r"(?U)1[3-9][0-9][- ]?\d{4}[- ]?\d{4}", "landline": r"(?U)\d[)） —-]{1,2}\d{7}|\d[ -]\d{3,4}[ -]\d{4}"}
TYPES = {"url": "url", "email": "email", "id": "id", "ip": "ip", "cell": "tel", "landline": "tel"}


def _finder(names: tuple[str, ...], padded: bool) -> Callable[[Column], Column]:
    """Hits of some rules, rule by rule. Python's patterns are those above: its digits are of any script without a switch."""
    found = [(TYPES[r], *(re.compile(p[r].replace("(?U)", "")) for p in (SIGNS, RULES))) for r in names]

    @F.arrow_udf(HIT)
    def find(texts: pa.Array) -> pa.Array:
        sizes, words, begins, ends, kinds = [0], [], [], [], []
        for text in texts.to_pylist():
            source = f"￥{text}￥" if padded and text is not None else text
            for kind, sign, rule in found:
                if text is None or sign.search(text) is None:
                    continue
                for m in rule.finditer(source):
                    words.append(m[1])
                    begins.append(m.start(1) - padded)
                    ends.append(m.end(1) - padded)
                    kinds.append(kind)
            sizes.append(len(words))
        columns = [pa.array(words, pa.string()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string())]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, ["s", "b", "e", "t"]))

    return find


def extract(text: Column, rule: str, padded: bool = True) -> Column:
    """Hits of one rule in order. Padding lets a hit touch the text's ends; without it none does."""
    return _finder((rule,), padded)(text)


def extract_phone(text: Column, padded: bool = True) -> Column:
    return _finder(("cell", "landline"), padded)(text)


def extract_info(text: Column) -> Column:
    """Hits of all rules: url, email, id, ip, telephone."""
    return _finder(tuple(RULES), True)(text)


def resolve(hits: Column) -> Column:
    """Hits by start (ties as listed), without those that begin before the last kept one ends."""
    ranked = F.transform(hits, lambda h, i: F.struct(h["b"].alias("b"), i.alias("i"), h.alias("h")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(HIT).alias("hits"))

    def add(state: Column, r: Column) -> Column:
        hit = r["h"]
        keep = hit["b"] >= state["end"]
        return F.struct(F.when(keep, hit["e"]).otherwise(state["end"]).alias("end"), F.when(keep, F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"))

    return F.aggregate(F.array_sort(ranked), start, add)["hits"]


def cut_by_rules(text: Column, hits: Column) -> Column:
    """Pieces of the text in order: (piece, type), where a null type is a gap between hits. No piece is empty."""
    kind = "array<struct<s:string,t:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def piece(s: Column, t: Column) -> Column:
        return F.struct(s.alias("s"), t.cast("string").alias("t"))

    def add(state: Column, h: Column) -> Column:
        gap = piece(F.substring(text, state["at"] + 1, h["b"] - state["at"]), F.lit(None))
        return F.struct(h["e"].alias("at"), F.concat(state["out"], F.array(gap, piece(h["s"], h["t"]))).alias("out"))

    done = F.aggregate(hits, start, add)
    tail = piece(F.substring(text, done["at"] + 1, F.length(text)), F.lit(None))
    return F.coalesce(F.filter(F.concat(done["out"], F.array(tail)), lambda p: F.length(p["s"]) > 0), F.array().cast(kind))

