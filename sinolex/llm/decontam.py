"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every run of ``WINDOW`` consecutive words of a benchmark item is a set that a document must contain whole and in order.
The words of the items are ordered by their count in the corpus. As containment must be total, the necessary prefix of a
window is its rarest word: only documents with that word can hold the window. Bounds on place and length drop starts at
which the window would not fit, and the words at the remaining starts are compared one by one.

Null and empty texts have no words: such documents have no hit and such items no window. An item of fewer words than a
window is one window. Equal counts are ordered by the word. Repeated rows stay; rows that share a doc_id are told apart
by their text. Items with a null id are hit as others are, but are not in the list of items nor counted in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinolex.llm.common import durable

WINDOW = 10
#: Bytes of item words or windows up to which they are broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 32_000_000
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), GAPS), "")


def small(df: DataFrame, column: str) -> DataFrame:
    """With a broadcast hint if the measured bytes of the column are within the bound."""
    size = df.agg(F.coalesce(F.sum(F.length(column) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def windows(items: DataFrame, id_col: str = "item_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """Distinct windows: words in order, with the items that hold them."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    rows = rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(length)).alias("w"))
    return rows.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("window", F.concat_ws(" ", "w"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WINDOW, keyed: bool = False) -> DataFrame:
    """For each document row: its words and those inside any occurrence of a window, and the items found.

    ``keyed`` adds ``key``, the hash of the row's text.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    wins = durable(windows(items, length=length))
    spread = base.where(F.col("text").isNotNull()).select("doc_id", "key", F.posexplode(words(F.col("text"))).alias("at", "word"))
    vocabulary = wins.select(F.explode("w").alias("word")).distinct()
    rarity = durable(spread.select("word").join(small(vocabulary, "word"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")))
    # the rarest word of each window, with its place in it
    placed = wins.select("window", F.posexplode("w").alias("offset", "word")).join(rarity, "word", "left")
    first = placed.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("p"))
    prefix = first.where("p.n > 0").join(wins, "window").select(F.col("p.word").alias("word"), F.col("p.offset").alias("offset"), "window", F.size("w").alias("len"), "items")
    prefix = durable(prefix.groupBy("word").agg(F.collect_list(F.struct("offset", "window", "len", "items")).alias("wins"), F.sum(F.length("window")).alias("size")))
    found = spread.join(small(prefix.select("word"), "word"), "word", "left_semi").groupBy("doc_id", "key", "word").agg(F.collect_list("at").alias("places"))
    # one row for each document: rare words with their places, and the windows they stand for
    per_doc = found.join(small_by(prefix, "size").drop("size"), "word").groupBy("doc_id", "key").agg(F.collect_list(F.struct("places", "wins")).alias("c"))
    rows = base.withColumn("n_words", F.coalesce(F.size(words(F.col("text"))), F.lit(0))).alias("d").join(per_doc.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.key") == F.col("p.key")), "left")
    # explode keeps Catalyst from folding the split into each comparison below
    rows = rows.select("d.doc_id", "d.key", "n_words", "c", F.explode(F.array(F.when(F.col("c").isNotNull(), words(F.col("text"))))).alias("w"))

    def fits(c: Column) -> Column:
        starts = F.flatten(F.transform(c["wins"], lambda v: F.transform(c["places"], lambda at: F.struct((at - v["offset"]).alias("at"), v["len"].alias("len"), v["window"].alias("window"), v["items"].alias("items")))))
        return F.filter(starts, lambda s: (s["at"] >= 0) & (s["at"] + s["len"] <= F.col("n_words")) & (F.concat_ws(" ", F.slice(F.col("w"), F.greatest(s["at"], F.lit(0)) + 1, s["len"])) == s["window"]))

    rows = rows.select("doc_id", "key", "n_words", F.explode(F.array(F.flatten(F.transform("c", fits)))).alias("hits"))
    held = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1))))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = rows.select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"), F.coalesce(held, F.array().cast("array<int>")).alias("places"), F.coalesce(names, F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated"), *["key"] * keyed)


def small_by(df: DataFrame, column: str) -> DataFrame:
    size = df.agg(F.coalesce(F.sum(F.col(column) + 128), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
