"""Stages of the pipeline on rows without ids and rows that share one."""

import random

import corpus_pipeline

RNG = random.Random(8)


def text(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(n))


A, B, C, D, ITEM, NAMELESS = text(90), text(90), text(90), text(90), text(12), text(12)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_duplicates_without_ids(spark, docs_of):
    docs = docs_of([(2**60 + 1, A, "en", "s"), (None, A, "en", "s"), (None, B, "en", "s"), (None, B, "en", "s"), (None, B + " more", "en", "s"), (None, C, "en", "s"), (None, "", "en", "s"), (None, None, "en", "s"), (4, D, "en", "s")])
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    got = rows_of(out)
    assert out.schema == docs.schema and [t for i, t in got if i is not None] == [A, D]
    rest = [t for i, t in got if i is None]
    assert len(rest) == 4 and {"", None, C} < set(rest) and sum(t in (B, B + " more") for t in rest) == 1


def test_passages_without_ids(spark, docs_of):
    docs = docs_of([(3, A, "en", "s"), (None, A + " " + B, "en", "s"), (None, C, "en", "s"), (None, "", "en", "s")])
    out = corpus_pipeline.passages(spark, docs, "")
    assert out.columns == docs.columns and rows_of(out) == sorted([(3, A), (None, B), (None, C), (None, "")], key=str)


def test_benchmark_rows_without_ids(spark, docs_of, tmp_path):
    spark.createDataFrame([(1, ITEM), (None, NAMELESS)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(None, A, "en", "s"), (5, B, "en", "s"), (None, None, "en", "s"), (7, C, "en", "s")]
    dirty = [(None, f"{C} {ITEM}", "en", "s"), (5, f"{ITEM} {D}", "en", "s"), (6, f"{D} {NAMELESS}", "en", "s"), (None, f"{NAMELESS} {D}", "en", "s")]
    out = corpus_pipeline.benchmark(spark, docs_of(clean + dirty), str(tmp_path))
    assert rows_of(out) == sorted([(i, t) for i, t, *_ in clean], key=str)


def test_language_stage(spark, docs_of):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    en, de = (lambda n: " ".join(rng.choice(["the", "thing", "and", "other", "that"]) for _ in range(n))), (lambda n: " ".join(rng.choice(["sch\u00f6n", "eine", "lichung", "ver\u00e4", "und"]) for _ in range(n)))
    clean = [(i, en(60) if i % 2 else de(60), "en" if i % 2 else "de", "s") for i in range(60)] + [(None, en(80), "en", "s"), (3, de(70), "de", "s")]
    odd = [(100, None, "en", "s"), (101, "", "en", "s"), (102, "12 34 !!", "en", "s"), (103, "\u0436\u0449\u044d " * 150, None, "s")]
    docs = docs_of(clean + odd).withColumn("score", F.lit("own")).withColumn("key", F.lit(1))
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns and rows_of(out) == sorted([(i, t) for i, t, *_ in clean], key=str)
    assert corpus_pipeline.language(spark, docs.limit(0), "").collect() == []


def test_whole_run_against_each_stage_by_hand(spark, docs_of, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["the", "an", "er", "ing", "on"]) for _ in range(3))
    body = lambda n: " ".join(word() for _ in range(n))
    passage, item = body(80), body(12)
    texts = {i: body(120) for i in range(12)}
    texts[12] = texts[3]  # an exact copy
    texts[13] = texts[4] + " more"  # a near copy
    texts[14] = body(100) + " " + passage
    texts[15] = body(100) + " " + passage + " " + body(10)  # a passage of an earlier document
    texts[16] = body(50) + " " + item + " " + body(50)  # a benchmark item
    texts[17] = "123 456"  # no letter
    docs_of([(i, t, "en", f"s{i % 2}") for i, t in texts.items()]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts) - {12, 13, 16, 17}
    sizes = {i: len(texts[i].split()) - (80 if i == 15 else 0) for i in got}
    assert {i: r["size"] for i, r in got.items()} == sizes
    of = lambda s: sum(n for i, n in sizes.items() if i % 2 == s)
    # weights 5 and 2: the first source stops at twice its size, the second takes the rest
    target = {0: 2 * of(0), 1: round(1.5 * (of(0) + of(1))) - 2 * of(0)}
    assert all(abs(sum(r["taken"] for i, r in got.items() if i % 2 == s) - target[s]) <= 1 for s in (0, 1))
