"""Documents linked by the Jaccard similarity of their word n-grams, with adaptive multi-match prefixes.

Documents with equal n-gram sets are one node. The n-grams of a node are ordered by an estimate of their frequency, rare
ones first, then by hash. Two sets with enough in common share at least l of their first size - needed + l n-grams; each
node picks the l of least estimated cost (postings to read and candidates to verify), so a node whose prefix is made of
frequent n-grams gets a longer prefix and must share correspondingly more of it. Candidates are verified on whole sets.

Components need no link between documents that are joined already. So each posting list is first compared with one pivot
(a star, not all pairs), twice; pairs of what is still apart follow, in size classes that the threshold lets meet.

Null and empty texts have no n-gram and stay alone. A text of fewer words is one n-gram. Rows that share a doc_id are one
document: each of their texts has its own set and links, all get one component. Documents with a null id get a null component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.llm.common import BROADCAST_IDS, durable, hash_runs, hash_text_words, of_ids, with_least
from sinolex.llm.components import components

WORDS = 5
PERCENT = 80
#: Frequent n-grams whose estimated counts are sent to the tasks (16 bytes each). The rest count as rare, which costs time but loses nothing.
FREQUENT = 1 << 17
#: An n-gram is reported as frequent by a task if it comes this often among LOOK n-grams.
LEAST = 4
LOOK = 1_000_000
MATCHES = (1, 2, 3, 4, 6, 8, 12)


def ngrams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    h = hash_text_words(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    return np.unique(hash_runs(h, min(words, len(h))))


def needed(n: int, percent: int = PERCENT) -> int:
    """Fewest common n-grams of a set of n with any set that is similar enough."""
    return -(-percent * n // 100)


def prefix(grams: np.ndarray, names: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, int]:
    """The prefix of a set, how many of its n-grams must be shared, and the frequency of the last. ``names``: frequent n-grams in order."""
    n = len(grams)
    freq = np.zeros(n, np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
        freq = np.where(names[at] == grams, counts[at], 0)
    by = np.lexsort((grams.view(np.int64), freq))
    running = np.cumsum(freq[by])
    base, best = n - needed(n, percent), None
    for matches in MATCHES:
        if matches > needed(n, percent):
            break
        met = running[base + matches - 1]
        cost = (base + matches) + met + n * met / matches
        if best is None or cost < best[0]:
            best = cost, matches
    chosen = by[: base + best[1]]
    return grams[chosen], best[1], int(freq[chosen[-1]])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                g = ngrams(text, words)
                d = hashlib.blake2b(g.tobytes(), digest_size=16).digest()
                rows.append((len(g), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            out = pd.DataFrame(rows, columns=["n", "s1", "s2"])
            for at, name in enumerate(("doc_id", "none", "key")):
                out.insert(at, name, batch[name].to_numpy())
            yield out

    # a null id passes as 0 beside a mark, so that ids stay whole numbers in pandas
    marked = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("key"), "text")
    made = marked.mapInPandas(run, "doc_id long, none boolean, key long, n long, s1 long, s2 long")
    return made.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "key", "n", "s1", "s2")


def frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that come often, with estimates of their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def often(parts: list[np.ndarray]) -> pd.DataFrame:
            names, counts = np.unique(np.concatenate(parts), return_counts=True)
            keep = counts >= LEAST
            return pd.DataFrame({"g": names[keep].view(np.int64), "c": counts[keep]})

        parts, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                parts.append(ngrams(text, words))
                size += len(parts[-1])
                if size >= LOOK:
                    yield often(parts)
                    parts, size = [], 0
        if parts:
            yield often(parts)

    found = texts.select("text").mapInPandas(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "g").limit(FREQUENT).toArrow()
    names = found.column("g").to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(names)
    return names[by], found.column("c").to_numpy().astype(np.int64)[by]


def prefixes(texts: DataFrame, words: int, percent: int, names: np.ndarray, counts: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sizes, matches, grams, last = [], [], [], [], []
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                g = ngrams(text, words)
                if len(g):
                    p, m, f = prefix(g, names, counts, percent)
                    ids.append(i), sizes.append(len(g)), matches.append(m), grams.append(p.view(np.int64)), last.append(f)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "n": np.array(sizes, np.int64), "m": np.array(matches, np.int32), "last": np.array(last, np.int64), "grams": grams})

    return texts.mapInPandas(run, "doc_id long, n long, m int, last long, grams array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough."""
    pairs = durable(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                yield pd.DataFrame({"doc_id": part["doc_id"], "set": [ngrams(t, words).tobytes() for t in part["text"]]})

    own = of_ids(texts, durable(ids)).mapInPandas(sets, "doc_id long, set binary")
    both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(own.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    n, m = F.length("x"), F.length("y")
    both = both.where(F.least(n, m) * 100 >= F.greatest(n, m) * percent)

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.loc[good, ["a", "b"]]

    return durable(both.select("a", "b", "x", "y").mapInPandas(similar, "a long, b long").distinct())


def shareable(lists: DataFrame) -> DataFrame:
    """Prefix n-grams that two documents hold: (gram, doc_id, n, pos, before), ``before``: how many such the document has earlier."""
    grams = lists.select("doc_id", "n", F.posexplode("grams").alias("pos", "gram"))
    shared = grams.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi").select("gram")
    order = Window.partitionBy("doc_id", "n").orderBy("pos")
    return grams.join(shared, "gram").withColumn("before", F.row_number().over(order) - 1)


def possible(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, shared prefix n-grams) those that can be similar enough.

    They must share as many as the smaller of their two choices. And all common n-grams up to the end of the prefix that
    ends first are among the shared ones, so the rest of that set bounds what else they can have in common.
    """
    own = lists.select("doc_id", "n", "m", F.size("grams").alias("p"), F.struct("last", F.element_at("grams", -1).alias("gram")).alias("end"))
    for side in "ab":
        pairs = pairs.join(own.select(F.col("doc_id").alias(side), *[F.col(c).alias(c + side) for c in ("n", "m", "p", "end")]), side)
    rest_of_first = F.when(F.col("enda") <= F.col("endb"), F.col("na") - F.col("pa")).otherwise(F.col("nb") - F.col("pb"))
    common = F.least(F.col("shared") + rest_of_first, "na", "nb")
    enough = common * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return pairs.where(enough & (F.col("shared") >= F.least("ma", "mb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)).select("a", "b", "shared")


def star(postings: DataFrame, lists: DataFrame, percent: int, pivot) -> DataFrame:
    """For each document its best pivot, if possible: of the lists it is in, each gives one document, and the one met most often counts."""
    pivots = postings.groupBy("gram").agg(pivot("doc_id").alias("b"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("gram", "b")
    met = postings.select("gram", F.col("doc_id").alias("a")).join(pivots, "gram").where("a != b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    best = met.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("less"))).alias("x")).select("a", (-F.col("x.less")).alias("b"), "x.shared")
    return possible(best, lists, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rest(postings: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that can be similar enough."""
    mixed = postings.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("gram")
    rows = durable(postings.join(mixed, "gram"))
    # two sets that are similar enough are in one size class or in neighbouring ones
    size_class: Column = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    left = rows.select("gram", size_class.alias("k"), *[F.col(c).alias(d) for c, d in (("doc_id", "a"), ("label", "la"), ("n", "na"), ("pos", "ia"), ("before", "ca"))])
    right = rows.select("gram", F.explode(F.array(size_class - 1, size_class, size_class + 1)).alias("k"), *[F.col(c).alias(d) for c, d in (("doc_id", "b"), ("label", "lb"), ("n", "nb"), ("pos", "ib"), ("before", "cb"))])
    # before this n-gram only n-grams that some other document holds can be common, and behind it no more than either set has left
    most = F.least("ca", "cb") + 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
    alike = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    pairs = left.join(right, ["gram", "k"]).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & alike)
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    return possible(shared, lists, percent).select("a", "b")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = durable(signatures(docs, words))
    full = base.where("n > 0 and doc_id is not null")
    member = durable(with_least(full.select("doc_id", "key", "s1", "s2"), ["s1", "s2"], "doc_id", "first").select("doc_id", "key", "first"))
    # copies go by id and text, as other texts of the same id have no other representative
    copies = durable(member.where("doc_id != first").select("doc_id", "key").distinct())
    several = member.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a != b").select("doc_id", "a")
    twice = member.join(several, "doc_id").where("first != a").select("a", F.col("first").alias("b")).distinct()
    texts = docs.where(F.col("doc_id").isNotNull()).withColumn("key", F.xxhash64("text"))
    texts = texts.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, ["doc_id", "key"], "left_anti").drop("key")
    names, counts = frequent(texts, words)
    lists = durable(prefixes(texts, words, percent, names, counts))
    postings = durable(shareable(lists).withColumn("label", F.col("doc_id")))
    edges = durable(twice)
    for pivot in (F.min, F.max):
        found = verified(star(postings, lists, percent, pivot), texts, words, percent)
        edges = durable(edges.union(found))
        labels = components(edges)
        named = postings.drop("label").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        postings = durable(named.select("gram", "doc_id", "n", "pos", "before", F.coalesce("component", "doc_id").alias("label")))
    edges = edges.union(verified(rest(postings, lists, percent), texts, words, percent))
    labels = components(edges)
    # a document of several rows may be a copy in some and a first one in others
    owner = member.groupBy("doc_id").agg(F.min("first").alias("first"))
    owner = owner.join(labels.withColumnRenamed("node", "first"), "first", "left").select("doc_id", F.coalesce("component", "first").alias("c"))
    return base.join(owner, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
