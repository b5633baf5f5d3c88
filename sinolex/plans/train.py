"""Training from labelled corpora: statistics, vocabulary, features, index, gradient steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinolex.functions import predicates as P
from sinolex.functions.charset import preprocess
from sinolex.operators import crf, features, vocab
from sinolex.operators.chars import word_to_tag
from sinolex.operators.segment import SegmenterModel
from sinolex.operators.tables import durable
from sinolex.operators.tagging import TaggerModel
from sinolex.sources.lines import feature_numbers

SEGMENT_DEFAULTS = {"norm_text": True, "convert_num_letter": True, "normalize_num_letter": False, "convert_exception": True, "word_min": 2, "word_max": 4, "unigram_trim": 1, "bigram_trim": 1, "feature_trim": 1, "gap_1": 0, "gap_2": 0, "gap_3": 0}
TAG_DEFAULTS = {"norm_text": True, "word_max": 4, "unigram_trim": 1, "char_trim": 1, "part_chinese": 1, "part_number": 400, "part_other": 1000, "part_length": 4, "feature_trim": 1}


def weight_table(index: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature, weights) from (feature, idx) and (idx, weights)."""
    return index.join(weights, "idx").select("feature", "weights")


def facts(trained: crf.Trained) -> dict:
    """The edges and the ratio as parameters of a model."""
    return {"edge": trained.edges.edge.tolist(), "ratio": float(trained.edges.ratio)}


def train_segmenter(corpus: DataFrame, epochs: int = 5, batches: int = 1, held_out: DataFrame | None = None, state: str | None = None, **params) -> tuple[SegmenterModel, crf.Trained]:
    """A segmenter from (sent_id, words). ``held_out`` sentences are evaluated after each epoch, ``state`` lets a run go on."""
    p = SEGMENT_DEFAULTS | params
    norm = F.transform("words", lambda w: preprocess(w, p["convert_num_letter"], p["normalize_num_letter"], p["convert_exception"])) if p["norm_text"] else F.col("words")

    def normal(df: DataFrame) -> DataFrame:
        return df.select("sent_id", norm.alias("words")).where("size(words) > 0")

    samples = durable(normal(corpus))
    words = vocab.long_words(samples, "sent_id", F.col("words"))
    freqs = vocab.frequencies(words)
    known = durable(vocab.unigrams(freqs, P.keep_unigram(F.col("word"), F.col("freq"), p["word_min"], p["word_max"], p["unigram_trim"])).select("word"))
    known, bigrams = vocab.back_fill(vocab.ambiguous(vocab.pairs_in(samples, F.col("words")), known), known, p["bigram_trim"], p["word_min"], p["word_max"])
    known, bigrams = durable(known), durable(bigrams)

    def nodes_of(df: DataFrame) -> DataFrame:
        return durable(features.segment_features(df.select("sent_id", F.array_join("words", "").alias("text")), ["sent_id"], "text", known, bigrams, p["word_min"], p["word_max"]))

    def numbered(df: DataFrame, nodes: DataFrame) -> DataFrame:
        return feature_numbers(nodes, index, ["sent_id"], df.select("sent_id", word_to_tag(F.col("words")).alias("tags")))

    nodes = nodes_of(samples)
    counts = nodes.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("freq"))
    kept = vocab.trim_features(counts, p["feature_trim"], p["gap_1"], p["gap_2"], p["gap_3"], p["bigram_trim"])
    index = durable(vocab.index_features(kept, vocab.length_features()))
    tests = None
    if held_out is not None:
        given = durable(normal(held_out))
        tests = numbered(given, nodes_of(given))
    trained = crf.train(numbered(samples, nodes), crf.start_weights(index, 2), 2, epochs, batches, held_out=tests, state=state)
    return SegmenterModel(weight_table(index, trained.weights), known, bigrams, p | facts(trained)), trained


def train_tagger(corpus: DataFrame, default: DataFrame, epochs: int = 5, batches: int = 1, state: str | None = None, cut: bool = True, **params) -> tuple[TaggerModel, crf.Trained]:
    """A tagger from (sent_id, tokens of word and tag); dictionary words are context but no samples.

    With ``cut`` features whose weights tell nothing apart are left out of the model in the end.
    """
    p = TAG_DEFAULTS | params
    raw = corpus.select("sent_id", F.posexplode("tokens").alias("pos", "t")).select("sent_id", "pos", F.col("t.word").alias("raw"), F.col("t.tag").alias("tag"))
    tokens = durable(raw.select("sent_id", "pos", (preprocess(F.col("raw")) if p["norm_text"] else F.col("raw")).alias("word"), "tag"))
    tags = [r["tag"] for r in tokens.select("tag").distinct().orderBy("tag").collect()]  # as many as the tagset has
    open_words = vocab.without(tokens, default)
    freqs = vocab.frequencies(open_words)
    known = durable(vocab.unigrams(freqs, P.keep_tag_unigram(F.col("word"), F.col("freq"), p["word_max"], p["unigram_trim"])).select("word").union(default.select("word")).distinct())
    char_set = durable(vocab.char_frequencies(open_words, p["char_trim"]))
    parts = durable(vocab.trim_parts(vocab.part_frequencies(tokens, known), p["part_length"], p["part_chinese"], p["part_number"], p["part_other"]).where("kind = 'chinese'"))
    known, _ = vocab.add_common_chars(known, vocab.unknown_words(tokens, default, known, parts), char_set)
    known = durable(known)
    info = features.word_info(tokens, known, parts, char_set)
    nodes = features.tag_features(tokens.select("sent_id", "pos", "word"), info)
    nodes = durable(nodes.join(default.select("word").distinct(), "word", "left_anti"))
    counts = nodes.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("freq")).where(F.col("freq") >= p["feature_trim"])
    index = durable(vocab.index_features(counts))
    numbers = F.array(*[F.lit(t) for t in tags])
    gold = tokens.join(nodes.select("sent_id", "pos"), ["sent_id", "pos"], "left_semi").groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", (F.array_position(numbers, F.col("tag")) - 1).cast("int").alias("k")))).alias("g")).select("sent_id", F.col("g.k").alias("tags"))
    data = feature_numbers(nodes, index, ["sent_id"], gold, miss="all")
    trained = crf.train(data, crf.start_weights(index, len(tags)), len(tags), epochs, batches, state=state)
    weights = crf.prune(trained.weights) if cut else trained.weights
    return TaggerModel(weight_table(index, weights), tags, known, parts, char_set, p | facts(trained)), trained
