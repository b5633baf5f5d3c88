"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinolex.llm import decontam, html, jaccard, langid, lm, media, mixing, phrases, quality, search, substring, toxicity, warc
from sinolex.llm.common import durable, id_bucket, table
from sinolex.llm.oracles import ORACLES  # noqa: F401


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("copies", lambda c: F.concat_ws(":", c["shard"].cast("string"), c["words"].cast("string"))), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("copies").alias("n_copies"), shards.alias("shards"))


def labelled(spark: SparkSession, sf_dir: str, label: str, rows: int) -> list[tuple[str, int]]:
    labels = table(spark, sf_dir, "labels").where(id_bucket("doc_id", 5) != 0)
    return quality.sample(table(spark, sf_dir, "documents"), labels, label, rows)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.Model(labelled(spark, sf_dir, "quality", quality.ROWS_PER_CLASS))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), id_bucket("doc_id", 7) != 2, lambda i: id_bucket(i, 7) == 2)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.encode(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.removed(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.train(docs.where(id_bucket("doc_id", 4) != 2))
    return langid.predict(docs, prototypes, keep=["doc_id"]).select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.Model(labelled(spark, sf_dir, "toxic", toxicity.ROWS_PER_CLASS))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = durable(search.build(table(spark, sf_dir, "documents")))
    return search.search(index, table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.read(durable(warc.write(pages)), payloads=False)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(table(spark, sf_dir, "documents"))
    return found.withColumn("rank", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_quality, op3_lm, op4_jaccard, op5_html, op6_media, op7_substring, op8_decontaminate, op9_language, op10_toxicity, op11_search, op12_warc, op13_phrases)}
