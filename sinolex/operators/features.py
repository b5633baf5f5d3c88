"""Features of characters (segmentation) and of words (tagging), as joins and projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.operators import local
from sinolex.operators.automaton import Trie, code_points
from sinolex.operators.chars import char_feature_counts, char_features, chars
from sinolex.operators.dictionary import matches
from sinolex.operators.tables import durable, fetched, slices, within
from sinolex.sources.lines import feature_numbers

#: Words up to which what is known of them is sent to the tasks that spell out pairs.
FEW_WORDS = 200_000


def segment_features(df: DataFrame, keys: list[str], text: str, words: DataFrame | None = None, bigrams: DataFrame | None = None, word_min: int = 2, word_max: int = 4) -> DataFrame:
    """(keys, pos, features) for every character.

    Word features come from the longest known words that end and begin at the character and at its neighbours; all four
    are aggregates of one table of matches, joined by place.
    """
    rows = df.select(*keys, F.posexplode(char_features(F.col(text))).alias("pos", "features"))
    if words is None:
        return rows
    found = matches(df, keys, text, words.select("word").distinct(), word_min, word_max)
    ends = found.groupBy(*keys, (F.col("b") + F.col("n") - 1).alias("pos")).agg(F.max_by("word", "n").alias("w"))
    starts = found.groupBy(*keys, F.col("b").alias("pos")).agg(F.max_by("word", "n").alias("w"))

    def shifted(table: DataFrame, by: int, name: str) -> DataFrame:
        return table.select(*keys, (F.col("pos") + by).alias("pos"), F.col("w").alias(name))

    for table, by, name in ((ends, 0, "pre_in"), (starts, 0, "post_in"), (ends, 1, "pre_ex"), (starts, -1, "post_ex")):
        rows = rows.join(shifted(table, by, name), [*keys, "pos"], "left")
    left, right = F.concat_ws("*", "pre_ex", "post_in"), F.concat_ws("*", "pre_in", "post_ex")
    both_left, both_right = F.col("pre_ex").isNotNull() & F.col("post_in").isNotNull(), F.col("pre_in").isNotNull() & F.col("post_ex").isNotNull()
    more = [F.concat(F.lit("v"), "pre_in"), F.concat(F.lit("x"), "post_in")]
    more += [F.when(both_left, F.concat(F.lit("wl"), F.length("pre_ex").cast("string"), F.length("post_in").cast("string"))), F.when(both_right, F.concat(F.lit("wr"), F.length("pre_in").cast("string"), F.length("post_ex").cast("string")))]
    if bigrams is not None:
        known = bigrams.select(F.concat_ws("*", "pre", "suf").alias("pair")).distinct()
        rows = rows.join(known.select(F.col("pair").alias("pl")), (F.col("pl") == left) & both_left, "left").join(known.select(F.col("pair").alias("pr")), (F.col("pr") == right) & both_right, "left")
        more += [F.concat(F.lit("wl"), "pl"), F.concat(F.lit("wr"), "pr")]
    return rows.select(*keys, "pos", F.concat("features", F.array_compact(F.array(*more))).alias("features"))


def segment_feature_counts(df: DataFrame, text: str, words: DataFrame | None = None, bigrams: DataFrame | None = None, word_min: int = 2, word_max: int = 4, of_chars: bool = True) -> DataFrame:
    """(feature, freq) of ``segment_features`` over all texts; without ``of_chars`` of words only.

    Features are counted inside tasks, where words and bigrams are within their bounds; only the counts are shuffled.
    """
    counts = char_feature_counts(df, text) if of_chars else None
    if words is None:
        return counts
    asked = [(words.select("word").where(F.length("word").between(word_min, word_max)).distinct(), ("word",))]
    if bigrams is not None:
        asked.append((bigrams.select("pre", "suf").distinct(), ("pre", "suf")))
    if (found := fetched(*asked)) is None:
        rows = segment_features(df.select(F.monotonically_increasing_id().alias("row"), text), ["row"], text, words, bigrams, word_min, word_max)
        names = F.col("features") if of_chars else F.filter("features", lambda f: f.rlike(r"(?s)^(?:v|x|w[lr]\d).+|^w[lr]\d\d$|^w[lr].+\*"))
        return rows.select(F.explode(names).alias("feature")).groupBy("feature").agg(F.count("*").alias("freq"))
    given = _word_feature_counts(df, text, found[0].column(0).to_pylist(), [tuple(r.values()) for r in found[1].to_pylist()] if bigrams is not None else [])
    every = given if counts is None else counts.union(given)
    return every.groupBy("feature").agg(F.sum("freq").alias("freq"))


def text_samples(df: DataFrame, keys: list[str], text: str, index: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carried columns, feature numbers of the characters) of the texts that have characters; keys are unique.

    An index within the bounds of tasks is sent to them, and nothing is shuffled; a larger one is joined.
    """
    rows = df.where(F.length(text) > 0)
    if (found := fetched((index, ("feature", "idx")))) is not None:
        return local.number_texts(rows.select(*keys, *carry, text), text, found[0])
    return feature_numbers(segment_features(rows, keys, text), index, keys, rows.select(*keys, *carry) if carry else None)


def _word_feature_counts(df: DataFrame, text: str, words: list[str], bigrams: list[tuple[str, str]]) -> DataFrame:
    """(feature, freq), one part for each task."""
    of = {w: i for i, w in enumerate(words)}
    pairs = np.array(sorted({of[p] * len(words) + of[s] for p, s in bigrams if p in of and s in of}), np.int64)
    shared = df.sparkSession.sparkContext.broadcast((words, Trie(words), Trie([w[::-1] for w in words]), pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, trie, backwards, pairs = shared.value
        starts, ends, together = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64)
        most = int(trie.sizes.max()) + 1 if len(words) else 1
        sizes_of = np.zeros(most * most, np.int64)
        for batch in batches:
            column = batch.column(0)
            for i, j in slices(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)):
                codes, sizes = code_points([t or "" for t in column[i:j].to_pylist()])
                if not len(codes) or not len(words):
                    continue
                stop = np.repeat(np.cumsum(sizes), sizes)
                start = stop - np.repeat(sizes, sizes)
                begin = trie.longest_at(codes, stop)
                end = backwards.longest_at(codes[::-1], len(codes) - start[::-1])[::-1]
                starts += np.bincount(begin[begin >= 0], minlength=len(words))
                ends += np.bincount(end[end >= 0], minlength=len(words))
                at = np.flatnonzero((end[:-1] >= 0) & (begin[1:] >= 0) & (start[:-1] == start[1:]))
                left, right = end[at].astype(np.int64), begin[at + 1].astype(np.int64)
                sizes_of += np.bincount(trie.sizes[left] * most + trie.sizes[right], minlength=most * most)
                if len(pairs):
                    keys = left * len(words) + right
                    place = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
                    together += np.bincount(place[pairs[place] == keys], minlength=len(pairs))
        names, freq = [], []
        for kind, n in (("v", ends), ("x", starts)):
            held = np.flatnonzero(n)
            names += [kind + words[k] for k in held.tolist()]
            freq += n[held].tolist()
        for side in ("wl", "wr"):  # each is seen from both of its sides
            for k in np.flatnonzero(sizes_of).tolist():
                names.append(f"{side}{k // most}{k % most}")
                freq.append(int(sizes_of[k]))
            for k in np.flatnonzero(together).tolist():
                names.append(f"{side}{words[pairs[k] // len(words)]}*{words[pairs[k] % len(words)]}")
                freq.append(int(together[k]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(freq, pa.int64())], names=["feature", "freq"])

    return df.select(text).mapInArrow(run, "feature string, freq long")


def word_info(words: DataFrame, known: DataFrame, parts: DataFrame, char_set: DataFrame, longest: int = 4) -> DataFrame:
    """For each distinct word: whether it is known, else its longest known proper beginning and ending, and its rare characters."""
    distinct = words.select("word").distinct()
    if (tables := fetched((known.select("word").distinct(), ("word",)), (parts.select("part").distinct(), ("part",)), (char_set.select("ch").distinct(), ("ch",)))) is not None:
        return _word_info_in_tasks(distinct, *tables, longest)
    flagged = distinct.join(known.select("word").distinct().withColumn("known", F.lit(True)), "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))
    open_words = flagged.where(~F.col("known")).select("word")
    cuts = F.when(F.length("word") > 1, F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(longest)))).otherwise(F.array().cast("array<int>"))
    cut = open_words.select("word", F.explode(cuts).alias("n"))
    p = parts.select("part").distinct()
    lefts = cut.select("word", "n", F.col("word").substr(F.lit(1), F.col("n")).alias("part")).join(p, "part").groupBy("word").agg(F.max_by("part", "n").alias("lft"))
    rights = cut.select("word", "n", F.col("word").substr(F.length("word") - F.col("n") + 1, F.col("n")).alias("part")).join(p, "part").groupBy("word").agg(F.max_by("part", "n").alias("rgt"))
    held = open_words.select("word", F.explode(F.array_distinct(chars(F.col("word")))).alias("ch")).join(char_set.select("ch").distinct(), "ch").groupBy("word").agg(F.collect_set("ch").alias("held"))
    info = flagged.join(lefts, "word", "left").join(rights, "word", "left").join(held, "word", "left")
    return info.withColumn("held", F.coalesce("held", F.array().cast("array<string>")))


def _word_info_in_tasks(distinct: DataFrame, *tables: pa.Table) -> DataFrame:
    """As ``word_info``, where known words, parts and characters are within the bounds of tasks."""
    *found, longest = tables
    shared = distinct.sparkSession.sparkContext.broadcast([set(t.column(0).to_pylist()) for t in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, chars = shared.value
        for batch in batches:
            rows = []
            for w in batch.column(0).to_pylist():
                cuts = range(min(len(w or "") - 1, longest), 0, -1)
                open_word = w is not None and w not in known
                lft = next((w[:n] for n in cuts if w[:n] in parts), None) if open_word else None
                rgt = next((w[-n:] for n in cuts if w[-n:] in parts), None) if open_word else None
                rows.append((w is not None and not open_word, lft, rgt, list({c for c in w if c in chars}) if open_word else []))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            kinds = pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["word", "known", "lft", "rgt", "held"])

    return distinct.mapInArrow(run, "word string, known boolean, lft string, rgt string, held array<string>")


def _own_chars(w: Column, held: Column) -> list[Column]:
    """Features of the characters of a word of which nothing is known."""
    n = F.length(w)

    def at(i: int) -> Column:
        return F.substring(w, i, 1)

    def one(name: str, i: int, when: Column) -> Column:
        return F.when(when & F.array_contains(held, at(i)), F.concat(F.lit(name), at(i)))

    out = [F.when(n.between(1, 3), F.lit("ck"))]
    out += [one(f"c{i}", i, n >= i) for i in (1, 2, 3)] + [one("c4", 4, n >= 4)]
    return [*out, one("c6", -1, n >= 5), one("c5", -2, n > 5)]


def _single(x, w: str, left: str, right: str, unknown: str, there: Column) -> list[Column]:
    """Features of one word: itself, or its known beginning and ending, or that nothing is known of it."""
    none = there & ~x["known"] & x["lft"].isNull() & x["rgt"].isNull()
    return [F.when(there & x["known"], F.concat(F.lit(w), x["word"])), F.when(there & ~x["known"], F.concat(F.lit(left), x["lft"])), F.when(there & ~x["known"], F.concat(F.lit(right), x["rgt"])), F.when(none, F.lit(unknown))]


def _names(x) -> dict[str, Column]:
    """The forms under which a word enters a pair; null where it has none."""
    return {"w": F.when(x["known"], x["word"]), "l": F.when(~x["known"], x["lft"]), "r": F.when(~x["known"], x["rgt"])}


#: Kinds of the features of the word before, the word itself and the one behind.
BEFORE, OWN, BEHIND = {"w": "v", "l": "bl", "r": "br"}, {"w": "w", "l": "cl", "r": "cr"}, {"w": "x", "l": "dl", "r": "dr"}


def _paired(left: dict[str, Column], kinds: dict[str, str], right: dict[str, Column], others: dict[str, str]) -> list[Column]:
    return [F.concat(F.lit(kinds[i] + others[j]), left[i], F.lit("*"), right[j]) for i in "wlr" for j in "wlr"]


def _own(x) -> list[Column]:
    bare = ~x["known"] & x["lft"].isNull() & x["rgt"].isNull()
    return [*_single(x, *OWN.values(), "wk", F.lit(True)), *[F.when(bare, c) for c in _own_chars(x["word"], x["held"])]]


def tag_feature_counts(pairs: DataFrame, info: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(feature, freq) of ``tag_features`` over all words, from counted neighbours (pre, suf, freq), null at the ends of texts.

    Each feature is one of a word or of two neighbours, so distinct words and pairs are joined and spelt out, not all words of
    all texts. Words of ``skipped`` are context only.
    """
    n, before, behind = F.col("freq"), F.col("pre").isNotNull(), F.col("suf").isNotNull()
    # how often a word is one of its own features, how often it is before and behind a word that has features, and at an end
    counts = [F.when(behind, n), F.when(behind & ~before, n), F.when(before & ~behind, n), F.when(before & behind, n)]
    open_pre = open_suf = F.lit(True)
    if skipped is not None:
        gone = skipped.select("word").distinct()
        gone = F.broadcast(gone) if within(gone, "word") else gone
        for side in ("pre", "suf"):
            pairs = pairs.join(gone.select(F.col("word").alias(side), F.lit(True).alias(f"{side}_gone")), side, "left")
        open_pre, open_suf = F.col("pre_gone").isNull(), F.col("suf_gone").isNull()
    zero = F.lit(0).cast("long")

    def by(side: str, **sums: Column) -> DataFrame:
        return pairs.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("word")).agg(*[F.coalesce(F.sum(c), zero).alias(k) for k, c in sums.items()])

    after = by("suf", own=F.when(open_suf, counts[0]), first=F.when(open_suf, counts[1]), ahead=F.when(open_pre, counts[3]))
    ahead = by("pre", last=F.when(open_pre, counts[2]), back=F.when(open_suf, counts[3]))
    words = after.join(ahead, "word", "left").join(info, "word")
    me = {c: F.col(c) for c in ("word", "known", "lft", "rgt", "held")}
    yes = F.lit(True)
    kinds = [("own", _own(me)), ("back", _single(me, *BEFORE.values(), "vk", yes)), ("ahead", _single(me, *BEHIND.values(), "xk", yes)), ("first", [F.lit("[START]")]), ("last", [F.lit("[END]")])]
    rows = [F.struct(f.alias("feature"), F.coalesce(c, zero).alias("freq")) for c, features in kinds for f in features]
    singles = durable(words.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("feature is not null and freq > 0").groupBy("feature").agg(F.sum("freq").alias("freq")))
    forms = F.when(F.col("known"), F.array(F.struct(F.lit("w").alias("k"), F.col("word").alias("f")))).otherwise(F.filter(F.array(F.struct(F.lit("l").alias("k"), F.col("lft").alias("f")), F.struct(F.lit("r").alias("k"), F.col("rgt").alias("f"))), lambda x: x["f"].isNotNull()))
    facts = info.select("word", forms.alias("forms")).where("size(forms) > 0")
    facts = F.broadcast(facts) if within(facts, "word", FEW_WORDS) else facts
    both = pairs.where(before & behind)
    for side in ("pre", "suf"):
        both = both.join(facts.select(F.col("word").alias(side), F.col("forms").alias(f"{side}_forms")), side)
    both = both.select(F.when(open_suf, n).otherwise(zero).alias("to_suf"), F.when(open_pre, n).otherwise(zero).alias("to_pre"), F.explode("pre_forms").alias("p"), "suf_forms").select("to_suf", "to_pre", "p", F.explode("suf_forms").alias("q"))
    # a pair of forms makes two features, which are spelt out once it is summed
    summed = both.groupBy(F.col("p.k").alias("i"), F.col("q.k").alias("j"), F.concat("p.f", F.lit("*"), "q.f").alias("name")).agg(F.sum("to_suf").alias("to_suf"), F.sum("to_pre").alias("to_pre"))

    def kind(of: dict[str, str], column: str) -> Column:
        return F.when(F.col(column) == "w", of["w"]).when(F.col(column) == "l", of["l"]).otherwise(of["r"])

    spelt = F.array(*[F.struct(F.concat(kind(left, "i"), kind(right, "j"), "name").alias("feature"), F.col(c).alias("freq")) for left, right, c in ((BEFORE, OWN, "to_suf"), (OWN, BEHIND, "to_pre"))])
    paired = summed.select(F.explode(spelt).alias("x")).select("x.*").where("freq > 0")
    every = singles.union(paired)
    # only a single feature with a star can be spelt as one of a pair
    return every if singles.where(F.col("feature").contains("*")).isEmpty() else every.groupBy("feature").agg(F.sum("freq").alias("freq"))


def tag_features(tokens: DataFrame, info: DataFrame, key: str = "sent_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, word, carried columns, features) for every word, from what is known of it and of its two neighbours."""
    rows = tokens.join(info, "word")
    order = Window.partitionBy(key).orderBy("pos")
    own = F.struct("word", "known", "lft", "rgt")
    rows = rows.withColumn("p", F.lag(own).over(order)).withColumn("q", F.lead(own).over(order))
    me = {c: F.col(c) for c in ("word", "known", "lft", "rgt", "held")}
    pre, suf = F.col("p"), F.col("q")
    has_pre, has_suf = pre.isNotNull(), suf.isNotNull()
    out = _single(pre, *BEFORE.values(), "vk", has_pre) + [F.when(~has_pre, F.lit("[START]"))] + _own(me)
    out += _single(suf, *BEHIND.values(), "xk", has_suf) + [F.when(~has_suf, F.lit("[END]"))]
    out += _paired(_names(pre), BEFORE, _names(me), OWN) + _paired(_names(me), OWN, _names(suf), BEHIND)
    return rows.select(key, "pos", "word", *carry, F.array_compact(F.array(*out)).alias("features"))
