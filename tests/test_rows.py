"""Cutting and tagging as row transforms against the joins, on batches and streams, and the dictionary automaton."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinolex.engine import Engine
from sinolex.functions.charset import preprocess, preprocess_text
from sinolex.operators import automaton, dictionary, features, tables
from sinolex.operators.segment import Segmenter, SegmenterModel
from sinolex.operators.tagging import Tagger, TaggerModel
from sinolex.plans import fixtures
from sinolex.plans.speed import throughput
from sinolex.sources import lines
from sinolex.streaming.dictionaries import Snapshots, cutter

RNG = random.Random(2)


def made(alphabet, n):
    return "".join(RNG.choice(alphabet) for _ in range(n))


TEXTS = [None, "", "a", "明明"] + [made("abcd王明１②é🙂 \n", RNG.randint(1, 40)) for _ in range(60)] + ["a@b.com bca 110101199003077571d", "x13912345678", "8.8.8.8 http://a.b/c ", made("abc明", 3000)]
WORDS = sorted({made("abcd王1", RNG.randint(2, 4)) for _ in range(60)})
BIGRAMS = [(RNG.choice(WORDS), RNG.choice(WORDS), 1) for _ in range(200)]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgé漢🙂"])
def test_trie_against_plain_search(alphabet):
    for _ in range(40):
        words = sorted({made(alphabet, RNG.randint(1, 9)) for _ in range(RNG.randint(0, 30))})
        texts = [made(alphabet, RNG.randint(0, 60)) for _ in range(4)]
        trie = automaton.Trie(words)
        codes, sizes = automaton.code_points(texts)
        found = trie.longest_at(codes, np.repeat(np.cumsum(sizes), sizes))
        best = [max((w for w in words if t.startswith(w, k)), key=len, default=None) for t in texts for k in range(len(t))]
        assert [words[i] if i >= 0 else None for i in found] == best
        want, at = [], 0
        for t in texts:
            k = 0
            while k < len(t):
                if w := best[at + k]:
                    want.append(at + k)
                k += len(w) if w else 1
            at += len(t)
        assert automaton.greedy(found, trie.sizes).tolist() == want


def test_scan_time_does_not_depend_on_the_longest_word():
    text = made("abcd", 100_000) + "a" * 100_000
    took = []
    for longest in (5, 200):
        trie = automaton.Trie(sorted({made("abcd", RNG.randint(2, longest)) for _ in range(5000)} | {"a" * longest}))
        began = time.perf_counter()
        codes, sizes = automaton.code_points([text])
        automaton.greedy(trie.longest_at(codes, np.full(len(codes), len(codes))), trie.sizes)
        took.append(time.perf_counter() - began)
    assert max(took) < 10 * took[0] + 1


@pytest.mark.parametrize("rows", [1_000_000, 7])
def test_greedy_with_small_and_large_dictionaries(spark, monkeypatch, rows):
    monkeypatch.setattr(tables, "LOCAL_ROWS", rows)
    words = {made("abc", RNG.randint(1, 6)): float(i) for i in range(40)}
    texts = ["", None, *(made("abcx", RNG.randint(0, 50)) for _ in range(30)), made("abcx", 2000)]
    want = set()
    for i, t in enumerate(texts):
        k = 0
        while t and k < len(t):
            w = max((w for w in words if t.startswith(w, k)), key=len, default=None)
            if w:
                want.add((i, k, len(w), words[w]))
            k += len(w) if w else 1
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame(list(words.items()), "word string, weight double")
    assert {tuple(r) for r in dictionary.greedy(df, ["id"], "text", table).collect()} == want
    longest = {(i, k, max(len(w) for w in words if t.startswith(w, k))) for i, t in enumerate(texts) if t for k in range(len(t)) if any(t.startswith(w, k) for w in words)}
    assert {tuple(r)[:3] for r in dictionary.longest_match(df, ["id"], "text", table).collect()} == longest
    assert dictionary.greedy(df, ["id"], "text", table.limit(0)).collect() == []


def test_normalisation_in_tasks(spark):
    texts = [t for t in TEXTS if t] + fixtures.ZH_WORDS
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for options in itertools.product((True, False), repeat=3):
        assert [r[0] for r in df.select(preprocess(F.col("text"), *options)).collect()] == list(map(preprocess_text(*options), texts))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


@pytest.fixture(scope="module")
def weights(spark, texts):
    nodes = features.segment_features(texts.select("id", preprocess(F.col("text")).alias("text")), ["id"], "text", known(spark), bigrams(spark))
    names = sorted(r["f"] for r in nodes.select(F.explode("features").alias("f")).distinct().collect())
    rows = [(f, [RNG.randint(-8, 8) / 4, RNG.randint(-8, 8) / 4]) for f in names if RNG.random() < 0.9]
    return spark.createDataFrame([*rows, ("/", [0.25, 0.5])], "feature string, weights array<double>")


def known(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


def bigrams(spark):
    return spark.createDataFrame(BIGRAMS, "pre string, suf string, freq int")


def user(spark):
    return spark.createDataFrame([("abab", 2.0, 0), ("dc", 2.0, 1), ("明", 2.0, 2), ("王明王明王明", 2.0, 3)], "word string, weight double, ord int")


@pytest.mark.parametrize(("words", "pairs", "rules", "boosted"), [(0, 0, 0, 0), (1, 0, 1, 0), (1, 1, 0, 0), (1, 1, 1, 1), (0, 0, 1, 1)])
def test_rows_and_joins_cut_alike(spark, texts, weights, words, pairs, rules, boosted):
    segmenter = Segmenter(SegmenterModel(weights, known(spark) if words else None, bigrams(spark) if pairs else None), use_rules=bool(rules))
    segmenter = segmenter.with_words(user(spark)) if boosted else segmenter
    by_rows, by_joins = (sorted(f(texts, "id", "text").collect()) for f in (segmenter.segment_typed, segmenter.segment_joined))
    assert by_rows == by_joins
    assert all("".join(t["word"] for t in r["tokens"]) == (TEXTS[r["id"]] or "") and all(t["word"] for t in r["tokens"]) for r in by_rows)
    scores = {r["id"]: [tuple(x) for x in r["scores"]] for r in segmenter.scored(texts, "text").collect()}
    joined = segmenter.char_scores(texts.where("length(text) > 0"), ["id"], "text").collect()
    assert all(scores[r["id"]][r["pos"]] == tuple(r["scores"]) for r in joined) and sum(map(len, scores.values())) == len(joined)


def test_repeated_keys_and_clashing_columns(spark, weights):
    df = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (None, "dd"), (1, None)], "id long, text string").withColumn("clean", F.lit("c")).withColumn("hits", F.lit(1)).withColumn("tokens", F.lit(2))
    segmenter = Segmenter(SegmenterModel(weights))
    assert segmenter.segment(df, "id", "text").count() == 4
    out = segmenter.cut(df, "text", "cut")
    assert out.columns == [*df.columns, "cut"] and out.where("clean = 'c' and hits = 1 and tokens = 2").count() == 4
    assert segmenter.segment(df.limit(0), "id", "text").collect() == []


def test_models_too_large_for_tasks(spark, texts, weights, monkeypatch):
    segmenter = Segmenter(SegmenterModel(weights, known(spark)))
    want = sorted(segmenter.segment(texts, "id", "text").collect())
    monkeypatch.setattr(tables, "LOCAL_ROWS", 50)
    assert segmenter.table() is None and sorted(segmenter.segment(texts, "id", "text").collect()) == want
    with pytest.raises(ValueError):
        segmenter.cut(texts, "text")


TAGS = ["a", "n", "v"]


def taggers(spark):
    tokens = [(i, [RNG.choice([*WORDS, "of", "the", "王明", "Ａ", "zzzzzzz", ""]) for _ in range(RNG.randint(0, 9))]) for i in range(100)]
    df = spark.createDataFrame([*tokens, (900, None), (901, [])], "id long, words array<string>")
    words, parts, chars = (spark.createDataFrame([(x,) for x in sorted(set(rows))], f"{c} string") for c, rows in (("word", WORDS[:20]), ("part", [w[:k] for w in WORDS[20:40] for k in (1, 2)]), ("ch", ["a", "王", "z"])))
    clean = df.select("id", F.posexplode("words").alias("pos", "w")).select("id", "pos", preprocess(F.col("w")).alias("word"))
    nodes = features.tag_features(clean, features.word_info(clean, words, parts, chars), "id")
    names = sorted(r["f"] for r in nodes.select(F.explode("features").alias("f")).distinct().collect())
    assert {n[:2] for n in names} >= {"vw", "wx", "wk", "ck", "c1"} and any("*" in n for n in names)
    weights = spark.createDataFrame([*((f, [RNG.randint(-8, 8) / 4 for _ in TAGS]) for f in names if RNG.random() < 0.9), ("/", [0.25, 0.5, 0.0])], "feature string, weights array<double>")
    default = spark.createDataFrame([("of", "p"), ("the", "u")], "word string, tag string")
    return df, Tagger(TaggerModel(weights, TAGS, words, parts, chars), default)


def test_rows_and_joins_tag_alike(spark, monkeypatch):
    df, tagger = taggers(spark)
    hard = spark.createDataFrame([("the", "q"), (WORDS[0], "ns")], "word string, tag string")
    soft = spark.createDataFrame([(WORDS[3], "n", 3.0), ("zzzzzzz", "v", 2.0), ("zzzzzzz", "xx", 2.0)], "word string, tag string, weight double")
    for t in (tagger, tagger.with_tags(hard), tagger.with_soft_tags(soft), tagger.with_tags(hard).with_soft_tags(soft)):
        assert sorted(t.tag(df, "id", "words").collect()) == sorted(t.tag_joined(df, "id", "words").collect())
    typed = df.withColumn("types", F.transform("words", lambda w, i: F.when(i % 3 == 1, F.lit("tel"))))
    assert sorted(tagger.tag(typed, "id", "words", types="types").collect()) == sorted(tagger.tag_joined(typed, "id", "words", types="types").collect())
    want = sorted(tagger.tag(df, "id", "words").collect())
    monkeypatch.setattr(tables, "LOCAL_ROWS", 20)
    assert tagger.table() is None and sorted(tagger.tag(df, "id", "words").collect()) == want
    with pytest.raises(ValueError):
        tagger.tagged(df, "words")


def test_the_same_engine_on_a_batch_and_a_stream(spark, texts, weights, tmp_path):
    texts.write.parquet(str(tmp_path / "in"))
    _, tagger = taggers(spark)
    segmenter = Segmenter(SegmenterModel(weights, known(spark), bigrams(spark)), use_rules=True).with_words(user(spark))
    for name, engine in (("cut", Engine(segmenter)), ("tag", Engine(segmenter, tagger))):
        stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = engine.cut(stream, "id", "text").writeStream.format("memory").queryName(f"rows_{name}").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(spark.table(f"rows_{name}").collect()) == sorted(engine.cut(texts, "id", "text").collect())
    assert len(q.recentProgress) > 1


def test_a_word_added_between_two_batches_changes_the_second_only(spark, tmp_path):
    weights = spark.createDataFrame([("/", [0.0, 0.0])], "feature string, weights array<double>")
    segmenter, words = Segmenter(SegmenterModel(weights)), Snapshots(spark, str(tmp_path / "dict"))
    schema, folder, seen = "id long, text string", str(tmp_path / "in"), []

    def run():
        def write(df, number):
            seen.extend((r["id"], number, r["snapshot"], [t["word"] for t in r["tokens"]]) for r in df.collect())

        stream = spark.readStream.schema(schema).parquet(folder)
        q = stream.writeStream.foreachBatch(cutter(segmenter, words, "text", "s", write)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    spark.createDataFrame([(1, "xaby")], schema).write.mode("append").parquet(folder)
    run()
    assert words.latest() == 0 and words.add_word("ab") == 1
    spark.createDataFrame([(2, "xaby")], schema).write.mode("append").parquet(folder)
    run()
    assert words.publish(spark.createDataFrame([("xa", 5.0), ("AB", -9.0)], "word string, weight double")) == 2
    assert {tuple(r)[:2] for r in words.words(2).collect()} == {("ab", 3.0), ("xa", 5.0)}
    spark.createDataFrame([(3, "xaby")], schema).write.mode("append").parquet(folder)
    run()
    assert seen == [(1, 0, 0, ["x", "a", "b", "y"]), (2, 1, 1, ["x", "ab", "y"]), (3, 2, 2, ["xa", "b", "y"])]
    # a batch that runs again takes the snapshot it had
    assert [words.of_batch("s", k) for k in (0, 1, 2, 9)] == [0, 1, 2, 2] and words.of_batch("other", 0) == 2


def test_throughput_by_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("甲乙 丙\n\nabc\n12\n", encoding="utf-8")
    engine = Engine(Segmenter(SegmenterModel(spark.createDataFrame([("/", [0.0, 0.0])], "feature string, weights array<double>"))))
    whole, part = (throughput(spark, str(tmp_path), engine, most).first() for most in (None, 2))
    assert (whole["lines"], whole["chars"], part["lines"], part["chars"]) == (8, 18, 4, 8) and whole["seconds"] > 0
    assert whole["chars_per_s"] == pytest.approx(whole["chars"] / whole["seconds"])


def test_values_of_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text('{"k": 3}\n  plain　\n\n[1, 2]\n{bad\n7\nlast', encoding="utf-8")
    rows = {r["line"]: (r["data"], r["text"]) for r in lines.read_values(spark, str(tmp_path)).select("line", F.to_json("data").alias("data"), "text").collect()}
    assert rows == {0: ('{"k":3}', None), 1: (None, "plain"), 3: ("[1,2]", None), 4: (None, "{bad"), 5: ("7", None), 6: (None, "last")}
    assert lines.read_values(spark, str(tmp_path), 3).count() == 2
