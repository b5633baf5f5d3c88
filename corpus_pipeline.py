"""From raw documents to a training mix in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.llm import decontam, jaccard, langid, mixing, substring
from sinolex.llm.common import BROADCAST_IDS, WORD, durable, free, of_ids, table

#: A text of at least LONG code points whose best cosine is below LEAST_SCORE is in no language that was learned.
LONG = 400
LEAST_SCORE = 0.3


#: Keys of rows without an id lie at or above this.
NO_ID = 1 << 62


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those of (doc_id, key), where key is the hash of the text; null ids are equal."""
    names = free("rejected_id", docs.columns), free("rejected_key", docs.columns)
    rejected = durable(rows.select(F.col("doc_id").alias(names[0]), F.col("key").alias(names[1])).distinct())
    hint = F.broadcast(rejected) if rejected.count() <= BROADCAST_IDS else rejected
    return docs.join(hint, F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])), "left_anti")


def with_ids(docs: DataFrame, mark: str) -> DataFrame:
    """Gives rows without an id but with words one made of their text, above usual ids, and marks them."""
    made = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    key = F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    return docs.withColumn(mark, made).withColumn("doc_id", F.when(F.col(mark), key).otherwise(F.col("doc_id").cast("long")))


def own_ids(docs: DataFrame, mark: str, like: DataFrame) -> DataFrame:
    """Takes the made ids out again; columns as in ``like``."""
    doc_id = F.when(~F.col(mark), F.col("doc_id")).cast(like.schema["doc_id"].dataType)
    return docs.withColumn("doc_id", doc_id).select(*[F.col(f"`{c}`") for c in like.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or text, and long ones that resemble no learned language.

    Learns from all rows with text and lang. Null texts go; rows with equal (doc_id, text) are judged alike, a null id being
    an id. Without a labelled row all documents go, as none is in a learned language. Any further columns stay.
    """
    prototypes = langid.train(docs)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("n"), "text")
    found = langid.predict(keyed, prototypes, keep=["doc_id", "key", "n"])
    unlike = (F.col("n") >= LONG) & (F.col("score") < LEAST_SCORE)
    # texts stay in Spark: only the rejected rows' keys come back from Python
    return without(docs, found.where((F.col("lang_pred") == "und") | unlike))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group, one with an id if there is any; of rows that share its doc_id, one.

    Rows without an id are linked by an id made of their text, so of equal ones one stays. Null and empty texts have no
    group and stay. Ties between rows of one id go by the text's hash, then the text. Any further columns stay.
    """
    mark = free("made_id", docs.columns)
    rows = with_ids(docs, mark)
    groups = durable(jaccard.classes(rows))
    dropped = groups.where("doc_id != component_id").select("doc_id").distinct()
    kept = of_ids(rows, durable(dropped), "left_anti")
    if not groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        n = free("row_of_id", rows.columns)
        kept = kept.withColumn(n, F.row_number().over(order)).where((F.col(n) == 1) | F.col("doc_id").isNull())
    return own_ids(kept, mark, docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of earlier documents out; drops documents of which nothing is left.

    Rows without an id count as later than those with one. Texts without a repeated passage, null and empty ones stay as
    they are; changed texts have one space between words and their n_chars counted anew. Repeated rows of one id are no
    earlier document for each other. Any further columns stay.
    """
    mark = free("made_id", docs.columns)
    given, docs = docs, with_ids(docs, mark)
    others = [c for c in docs.columns if c != "doc_id"]
    words, lost, kept = (free(n, docs.columns) for n in ("words_before", "words_lost", "text_kept"))
    rows = substring.removed(docs, keep=others, names=(words, lost, kept)).where((F.col(lost) == 0) | (F.col(lost) < F.col(words)))
    changed = F.col(lost) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in others:
        new["n_chars"] = F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return own_ids(rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]), mark, given)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a window of a benchmark item, with ids or without.

    Null and empty texts stay; items without an id count as others. Without items nothing goes. Of rows that share an id
    only those with a window go. Any further columns stay.
    """
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), keyed=True)
    return without(docs, found.where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each document what is taken, and its copies with their shards and places.

    Null texts have size 0 and a null source is a source of its own; an empty table gives an empty mix.
    """
    return mixing.mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("benchmark", benchmark), ("mix", mix)]

#: Hashes decide the order of draws and the similarity of languages, which SQL can't restate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
