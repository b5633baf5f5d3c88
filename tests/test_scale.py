"""Steps that must not grow faster than their input: what they shuffle, hold and return."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.functions.charset import preprocess
from sinolex.operators import coded, crf, features, rules, vocab
from sinolex.operators.chars import char_feature_counts, words_of
from sinolex.operators.lattice import Lattice
from sinolex.operators.tagging import Tagger, TaggerModel
from sinolex.plans import queries
from sinolex.sources import lines
from sinolex.streaming import text as streams

TEXTS = [("a", "one two one two\tthree １２ two"), ("b", ""), ("c", None), ("d", "two　wide\x0bwords\x85 one"), ("e", "one"), ("f", " \n ")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(df):
    return vocab.long_words(df, "id", words_of(preprocess(F.col("text"))))


def test_words_and_neighbours_are_counted_in_tasks(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "id string, text string")
    monkeypatch.setattr(vocab, "COUNTED_AT_ONCE", 20)
    tokens = words(df)
    assert rows_of(vocab.word_counts(df, "text")) == rows_of(vocab.frequencies(tokens))
    assert rows_of(vocab.text_pairs(df, "text")) == rows_of(vocab.pairs(tokens))
    ends = vocab.summed_pairs(vocab.neighbour_rows(df, "text"))
    assert rows_of(ends.where("pre is null")) == [(None, "one", 2), (None, "two", 1)]
    assert rows_of(vocab.char_frequencies(vocab.word_counts(df, "text"))) == rows_of(vocab.char_frequencies(tokens))


def test_pairs_of_a_task_are_not_held_in_one_map(spark, monkeypatch):
    """adjacent_bigram_freq: all distinct pairs of a task were held in a hash map before the shuffle, which spilled."""
    df = spark.createDataFrame([*TEXTS, ("g", "one two"), ("g", "one two"), (None, "two one")], "id string, text string")
    plan = plan_of(vocab.text_pairs(df, "text"))
    above, below = plan.split("Exchange hashpartitioning(pre", 1)
    assert above.count("HashAggregate") == 2 and "Aggregate" not in below
    wanted = rows_of(vocab.pairs_in(df, words_of(preprocess(F.col("text")))))
    ends = []
    for unit in (1, 7, 1_000_000):  # words of one text, of some and of all at a time
        monkeypatch.setattr(vocab, "PAIRED_AT_ONCE", unit)
        assert rows_of(vocab.text_pairs(df, "text")) == wanted != []
        ends.append(rows_of(vocab.summed_pairs(vocab.neighbour_rows(df, "text")).where("pre is null or suf is null")))
    assert ends[0] == ends[1] == ends[2] and all(pre or suf for pre, suf, _ in ends[0])
    given = vocab.neighbour_rows(Probe(df.select("text").coalesce(1)), "text")
    assert [b.num_rows for b in given] == [len({r[:2] for r in rows_of(vocab.neighbour_rows(df.coalesce(1), "text"))})]
    monkeypatch.setattr(vocab, "AT_ONCE", 3)
    assert max(b.num_rows for b in vocab.neighbour_rows(Probe(df.select("text")), "text")) == 3


def test_ambiguous_pairs_are_chosen_before_the_shuffle(spark, monkeypatch):
    """All pairs with all their candidates were shuffled twice."""
    df = spark.createDataFrame([("a", "ab cd ef gb cde xab c"), ("b", "bc ab cd d")], "id string, text string")
    known = spark.createDataFrame([("ab",), ("bc",), ("de",), ("cd",), ("bcd",)], "word string")
    rows = vocab.neighbour_rows(df, "text").where("pre is not null and suf is not null")
    few = vocab.ambiguous(rows, known)
    assert "SortMergeJoin" not in plan_of(few)
    by_rows = rows_of(vocab.summed_pairs(few))
    monkeypatch.setattr("sinolex.operators.tables.LOCAL_ROWS", 1)
    assert rows_of(vocab.ambiguous(vocab.summed_pairs(rows), known)) == by_rows != []


def test_features_of_tags_are_counted_by_distinct_pairs(spark, monkeypatch):
    """every word of every text was joined, ordered and spelt out with all its features."""
    texts = ["a*b c ab abc zz*y a*b", "wa*b c zz*y q", "q", "", None, "ab ab ab cdx xcd xcd a*b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = spark.createDataFrame([("ab",), ("a*b",), ("wa*b",), ("w*c",)], "word string")
    parts, chars = spark.createDataFrame([("a",), ("c",), ("cd",), ("x",)], "part string"), spark.createDataFrame([("q",), ("z",)], "ch string")
    tokens, pairs = words(df), vocab.summed_pairs(vocab.neighbour_rows(df, "text"))
    skipped = spark.createDataFrame([("c",), ("ab",)], "word string")
    wanted = []
    for bound in (1_000_000, 1):  # known words and parts in tasks, and joined
        monkeypatch.setattr("sinolex.operators.tables.LOCAL_ROWS", bound)
        info = features.word_info(vocab.word_counts(df, "text"), known, parts, chars)
        nodes = features.tag_features(tokens, info)
        for skip in (None, skipped):
            own = nodes if skip is None else nodes.join(skip, "word", "left_anti")
            plain = own.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("freq"))
            assert rows_of(features.tag_feature_counts(pairs, info, skip)) == (given := rows_of(plain)) != []
            wanted.append(given)
    assert wanted[:2] == wanted[2:]


def test_features_of_known_words_are_counted_in_tasks(spark, monkeypatch):
    """every place of every text was joined with every word that it could begin or end."""
    texts = ["abcdab cab", "", None, "ab", "dabcabab", "xx", "b" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = spark.createDataFrame([("ab",), ("abc",), ("ca",), ("da",), ("bb",), ("a",), ("cdabx",)], "word string")
    bigrams = spark.createDataFrame([("ab", "ca"), ("da", "bb"), ("abc", "da"), ("ab", "ab"), ("ab", "zz")], "pre string, suf string")
    nodes = features.segment_features(df, ["id"], "text", known, bigrams)
    plain = rows_of(nodes.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("freq")))
    counted = features.segment_feature_counts(df, "text", known, bigrams)
    assert "Generate" not in plan_of(counted)
    assert rows_of(counted) == plain
    words_only = rows_of(features.segment_feature_counts(df, "text", known, bigrams, of_chars=False))
    assert {r[0] for r in words_only} == {r[0] for r in plain if r[0][0] in "vxw"}
    monkeypatch.setattr("sinolex.operators.tables.LOCAL_ROWS", 1)
    assert rows_of(features.segment_feature_counts(df, "text", known, bigrams)) == plain
    assert rows_of(features.segment_feature_counts(df, "text", known, bigrams, of_chars=False)) == words_only


def test_rules_in_one_pass_and_pieces_in_the_row(spark):
    """each rule was matched twice by column expressions, and pieces were grouped by a shuffle."""
    text = "订单110105199601021234，电话13007919123，见 http://www.a.com/o?k=1 从10.12.34.7发给c1@mail.org。٠٢١-١٢٣٤٥٦٧٨ 🙂021-12345678"
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "13007919123"), (5, "a@b.org")], "id long, text string")
    rows = df.select("id", "text", streams.piece_list().alias("p"), rules.extract_info(F.col("text")).alias("h"), rules.extract_phone(F.col("text"), False).alias("bare"))
    plan = plan_of(rows)
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
    found = rows.collect()
    assert ["".join(p["s"] for p in r["p"]) for r in found] == [r["text"] or "" for r in found]
    assert all(r["text"][h["b"] : h["e"]] == h["s"] for r in found for h in r["h"])
    assert [[p["t"] for p in r["p"] if p["t"]] for r in found] == [["id", "tel", "url", "ip", "email", "tel"]] * 2 + [[], [], ["tel"], ["email"]]
    assert found[4]["bare"] == [] and found[4]["h"][0]["b"] == 0


def test_words_are_tagged_by_distinct_forms(spark, monkeypatch):
    """cut_pos_rules: features were spelt out and summed for every distinct word, also for words that a rule had tagged."""
    rows = [(1, ["a1", "of", "x9", "known", "x9"], ["tel", None, None, "ip", None]), (2, [], []), (3, None, None), (4, ["b2", None, "c3"], None), (5, ["d4", "e5"], ["url"]), (6, ["f6", "known", "g7"], ["id", None, "id"]), (6, ["f6", "known", "g7"], [None, None, None])]
    df = spark.createDataFrame(rows, "id long, words array<string>, types array<string>")
    names = [("wk", [0.5, 0.0]), ("vk", [0.0, 0.25]), ("xknown", [0.0, 2.0]), ("vknown", [1.0, 0.0]), ("wknown", [0.0, 0.125]), ("ck", [0.0, 0.375]), ("c1x", [0.0, 1.0]), ("[START]", [0.0, 0.75]), ("/", [0.0, 0.125])]
    weights = spark.createDataFrame(names, "feature string, weights array<double>")
    held = [spark.createDataFrame([(v,)], f"{c} string") for c, v in (("word", "known"), ("part", "zz"), ("ch", "x"))]
    tagger = Tagger(TaggerModel(weights, ["n", "v"], *held), spark.createDataFrame([("of", "p")], "word string, tag string"))
    keyed = df.withColumn("k", F.row_number().over(Window.orderBy("id", F.desc("types"))))
    for types in (None, "types"):
        got, want = ({r["k"]: [tuple(t) for t in r["tokens"]] for r in f(keyed, "k", "words", types=types).collect()} for f in (tagger.tag, tagger.tag_joined))
        full = {k for k, v in got.items() if all(w is not None for w, _ in v)}
        assert {k: got[k] for k in full} == {k: want[k] for k in full} and len(got) == len(rows) and len(full) == 6
    assert got[1] == [("a1", "tel"), ("of", "p"), ("x9", "v"), ("known", "ip"), ("x9", "n")]

    table, spelt, chars_of = tagger.table(), [], []
    single, own_chars = table.single, table.own_chars
    monkeypatch.setattr(table, "single", lambda *a: spelt.append(a) or single(*a))
    monkeypatch.setattr(table, "own_chars", lambda w: chars_of.append(w) or own_chars(w))
    words = [f"y{i}" for i in range(500)]
    code, begins, ends = np.arange(500), np.zeros(500, np.int64), np.full(500, 500)
    names, plain = table.tag(words, code, begins, ends)
    assert len(spelt) < 20 and len(chars_of) == 500
    chars_of.clear()
    names, some = table.tag(words, code, begins, ends, code % 2 == 0)
    assert len(chars_of) == 250 and (some[1::2] == plain[1::2]).all() and (some[::2] == -1).all()


def _texts_with_tags(spark):
    texts = ["abcab", "", None, "b", "中abc aab", "zzq"]
    df = spark.createDataFrame(list(enumerate(texts)), "sent_id long, text string")
    return df.withColumn("tags", F.transform(F.split("text", ""), lambda _, i: (i % 2).cast("int")))


def test_features_get_their_numbers_in_tasks(spark, monkeypatch):
    """F8: every feature of every character was joined with the index and grouped twice."""
    df = _texts_with_tags(spark)
    index = vocab.index_features(char_feature_counts(df, "text").where("freq >= 2"))
    plain = rows_of(lines.feature_numbers(features.segment_features(df, ["sent_id"], "text"), index, ["sent_id"]))
    samples = features.text_samples(df, ["sent_id"], "text", index)
    assert "Exchange" not in plan_of(samples) and rows_of(samples) == plain
    monkeypatch.setattr("sinolex.operators.tables.LOCAL_ROWS", 1)
    assert rows_of(features.text_samples(df, ["sent_id"], "text", index)) == plain


def test_samples_that_are_not_stored_train_alike(spark, monkeypatch):
    """samples were stored and shuffled with all their feature numbers."""
    df = _texts_with_tags(spark)
    index = vocab.index_features(char_feature_counts(df, "text").where("freq >= 2"))
    samples = features.text_samples(df, ["sent_id"], "text", index, ("tags",))
    start = crf.start_weights(index, 2)
    for batches, block in ((1, crf.BLOCK), (2, 20)):
        runs = [crf.train(samples, start, 2, epochs=3, batches=batches, block=block, keep=keep, patience=-9.0) for keep in (True, False)]
        tables = [np.array([r["weights"] for r in run.weights.orderBy("idx").collect()]) for run in runs]
        assert np.allclose(*tables) and np.abs(tables[0]).max() > 0
        assert np.allclose(runs[0].edges.edge, runs[1].edges.edge) and np.allclose(runs[0].losses, runs[1].losses)


class Probe:
    """A DataFrame whose row transforms run here; they give their batches."""

    def __init__(self, df):
        self.df, self.schema = df, df.schema

    def select(self, *columns):
        return Probe(self.df.select(*columns))

    def mapInArrow(self, f, schema):
        return list(f(iter(self.df.toArrow().combine_chunks().to_batches())))


def test_tasks_hold_some_rows_at_a_time(spark, tmp_path, monkeypatch):
    """a batch of 10,000 rows was worked on and returned whole, however long they were."""
    samples = spark.range(40).select(F.col("id").alias("sent_id"), F.expr("transform(sequence(1, 5), x -> array(CAST(x % 2 AS INT)))").alias("features"))
    w = crf.Weights(np.array([[0.0, 1.0], [0.5, 0.0]]), 1.0, np.array([[1.0, 0.0], [0.0, 0.5]]))
    whole = {f.__name__: rows_of(f(samples, w)) for f in (crf.decode, crf.node_marginals)}
    monkeypatch.setattr("sinolex.operators.tables.AT_ONCE", 25)
    for f, size in ((crf.decode, 5), (crf.node_marginals, 50)):
        batches = f(Probe(samples), w)
        assert [b.num_rows for b in batches] == [size] * 8
        given = [tuple(tuple(v) if isinstance(v, list) else v for v in r.values()) for b in batches for r in b.to_pylist()]
        assert np.allclose(*[[x for r in rows for v in r for x in (v if isinstance(v, (tuple, list)) else [v])] for rows in (sorted(given), sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in whole[f.__name__]))])
    spark.range(3).withColumn("text", F.lit("a")).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(queries.BATCH)
    spark.conf.set(queries.BATCH, "10000")
    queries.load(spark, str(tmp_path))
    assert int(spark.conf.get(queries.BATCH)) <= 1000
    spark.conf.set(queries.BATCH, before)


def _coded(spark, monkeypatch, block_words):
    """Coded texts and what is known of their words; some are context only, of some nothing is known, some hold a star."""
    monkeypatch.setattr(coded, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(coded, "SHARD_FEATURES", 40)
    texts = [*TEXTS, ("g", "one two wa*b wa *b one a*b two"), ("h", "w w*b cl*x l x ?* zz9zz9 zz9 q k 中z中z中z"), (None, "one one lost two"), ("i", "one two wa b zz9zz9 one k k vk 中z"), ("j", "three three three"), ("k", "one a b wa*b one wa a b a*b")]
    df = spark.createDataFrame(texts, "id string, text string")
    known = spark.createDataFrame([(w,) for w in ("one", "two", "wa*b", "wa", "*b", "a", "a*b", "w", "w*b", "b", "k", "vk")], "word string")
    parts = spark.createDataFrame([("th",), ("ee",), ("w*",), ("cl*x",), ("wor",), ("cl",)], "part string")
    tokens = vocab.long_words(df.where("id is not null"), "id", words_of(preprocess(F.col("text"))))
    info = features.word_info(words(df), known, parts, spark.createDataFrame([("z",), ("9",), ("?",)], "ch string"))
    skipped = spark.createDataFrame([("two",), ("x",)], "word string")
    rows = coded.coded_texts(df, "id", "text").localCheckpoint()
    return df, rows, tokens, info, skipped, F.when(F.length("word") > 2, 0).otherwise(1)


def _trained(index, samples, **how):
    run = crf.train(samples, crf.start_weights(index, 2), 2, epochs=3, patience=-9.0, **how)
    return {r["feature"]: r["weights"] for r in index.join(run.weights, "idx").collect()}, run


def test_features_of_words_are_numbered_by_block(spark, monkeypatch):
    """every feature of every word was spelt out, joined with the index and grouped twice, and pulled row by row."""
    for block_words, least in ((1_000_000, 1), (7, 2)):
        df, rows, tokens, info, skipped, tag = _coded(spark, monkeypatch, block_words)
        assert rows_of(coded.counted(rows)) == rows_of(vocab.word_counts(df, "text"))
        nodes = features.tag_features(tokens, info).join(skipped, "word", "left_anti")
        freqs = nodes.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
        index = vocab.index_features(freqs).localCheckpoint()
        gold = vocab.without(tokens, skipped).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", tag.alias("k")))).alias("g")).select("sent_id", F.col("g.k").alias("tags"))
        want, plain = _trained(index, lines.feature_numbers(nodes, index, ["sent_id"], gold, miss="all"))
        own_index, samples = coded.tag_samples(rows, info, tag, least, skipped)
        got, packed = _trained(own_index, samples)
        assert len(got) == own_index.count() == own_index.select("idx").distinct().count() and samples.shards > 1
        assert got.keys() == want.keys() and all(np.allclose(got[f], want[f]) for f in want)
        assert np.allclose(plain.losses, packed.losses) and np.allclose(plain.edges.edge, packed.edges.edge)


def test_packed_blocks_are_dealt_to_batches(spark, monkeypatch):
    _, rows, _, info, skipped, tag = _coded(spark, monkeypatch, 7)
    index, samples = coded.tag_samples(rows, info, tag, 1, skipped)
    assert samples.blocks.count() > 2
    got, run = _trained(index, samples, batches=2)
    assert len(run.log) == 3 and np.isfinite(run.losses).all() and any(w[0] for w in got.values())
    none, empty = _trained(*coded.tag_samples(rows.where("false"), info, tag, 1, skipped))
    assert not none and empty.losses[0] == 0


def test_the_tagger_is_trained_without_rows_of_words(spark, monkeypatch, tmp_path):
    """all words with their features crossed four shuffles."""

    def never(*_, **__):
        raise AssertionError("features of all words are spelt out")

    spark.createDataFrame([(f"d{i}", "one two three one two four " * 3 + "five " * i) for i in range(6)], "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", "two")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for module, name in ((features, "tag_features"), (lines, "feature_numbers"), (crf, "blocks")):
        monkeypatch.setattr(module, name, never)
    got = {r["feature"]: (r["w0"], r["w1"]) for r in queries.train_tagger_step(spark, str(tmp_path)).collect()}
    assert got["wone"] == (-1.0, 1.0) and "wtwo" not in got and got["vtwo"][0] > 0


def test_independent_positions_are_not_rounded_along_long_texts():
    """sums along long texts were off in the ninth digit of the weights."""
    rng, sizes = np.random.default_rng(0), np.array([3, 0, 20_000, 1])
    lattice, none, hardly = Lattice(sizes), np.zeros((2, 2)), np.full((2, 2), 1e-300)
    assert (lattice.marginals(np.zeros((20_004, 2)), none)[1] == 0.5).all()
    y = rng.normal(size=(20_004, 2))
    for a, b in zip(lattice.marginals(y, none), lattice.marginals(y, hardly), strict=True):
        assert np.allclose(a, b)
    assert (lattice.viterbi(y, np.stack((none, none))) == lattice.viterbi(y, np.stack((hardly, hardly)))).all()
