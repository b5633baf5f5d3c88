"""Mixing sources to target weights, in DataFrame operations only.

The documents of a source are dealt by a hash into blocks. A source's target in words becomes an exact number of block
draws: whole passes over all its blocks, and for the rest blocks in permuted order, the last one cut to the word. A
splitting tree halves the output shards again and again; at each node the draws of all sources are split by a
multivariate hypergeometric draw: source by source, the number that goes left is drawn at once from the hypergeometric
distribution of the left places that are still free. A shard then takes the next draws of each source's permuted list,
and its rows are shuffled by a hash. The number of shards, and with it the depth of the tree, follows from the words to take.

Nodes are spread over tasks; running sums go over hash ranges of a source's blocks, never over all of them in one task.
A node holds two numbers for each source in a row.

Null texts have size 0. A null source is a source of its own, last in order. Ties of the permutation are ordered by block
or id. Repeated rows are separate documents; rows that share a doc_id and a text get equal shards and places. Very long
texts count as one document. Empty tables give no row. Sources with size 0 have target 0. Other columns are not read.
"""

from __future__ import annotations

from math import ceil, lgamma, log2, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.llm.common import WORD, durable

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Words of a shard, about, and the least depth of the tree.
SHARD_WORDS = 50_000_000
LEAST_LEVELS = 4
#: Blocks that a shard gets, about, and the most words of a block (its last document may exceed them).
SHARD_BLOCKS = 64
BLOCK_WORDS = 50_000
#: Blocks of a hash range of a source.
RANGE_BLOCKS = 4096
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 20_000
SEED = 31


def sized(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (source, source_size): rank, weight and target of each source, by filling up to the caps."""
    rows = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    rows = rows.withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    rows = rows.withColumn("before", F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    rows = rows.withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("all", F.sum("source_size").over(whole) * share)
    full = (F.col("all") - F.col("before")) / F.col("left") >= F.col("most") / F.col("weight")
    rows = rows.withColumn("full", full)
    rest = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))).over(whole)
    level = (F.col("all") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(F.lit(0.0))).over(whole)) / F.nullif(rest, F.lit(0.0))
    return rows.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight"))).select("source", "rank", "weight", "source_size", "target")


def chance(*of: Column | str) -> Column:
    """A number in [0, 1) from a hash; the same at every run."""
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(n: Column) -> Column:
    """ln n! for whole n: exact below 16, Stirling's series from there on."""
    logs = F.array(*[F.lit(lgamma(k + 1)) for k in range(16)])

    def series(x: Column) -> Column:
        return x * F.log(x) - x + F.log(x * 2 * pi) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)

    return F.when(n < 16, F.get(logs, n.cast("int"))).otherwise(let(F.greatest(n, F.lit(16)).cast("double"), series))


def hypergeometric(u: Column, total: Column, good: Column, draws: Column) -> Column:
    """How many of ``draws`` out of ``total`` are among the ``good``, drawn by u in [0, 1).

    Probabilities are taken off u from the mode outwards by their ratios, over twelve standard deviations on both sides.
    """
    given = F.struct(u.alias("u"), total.alias("total"), good.alias("good"), draws.alias("draws"))

    def bounds(g: Column) -> Column:
        other = g["total"] - g["good"]
        low, high = F.greatest(F.lit(0).cast("long"), g["draws"] - other), F.least(g["draws"], g["good"])
        mode = F.floor((g["draws"] + 1).cast("double") * (g["good"] + 1) / (g["total"] + 2)).cast("long")
        share = g["good"].cast("double") / F.greatest(g["total"], F.lit(1))
        deviation = F.sqrt(g["draws"] * share * (1 - share) * (g["total"] - g["draws"]) / F.greatest(g["total"] - 1, F.lit(1)))
        return F.struct(g["u"].alias("u"), g["total"].alias("total"), g["good"].alias("good"), g["draws"].alias("draws"), other.alias("other"), low.alias("low"), high.alias("high"), F.greatest(low, F.least(high, mode)).alias("mode"), (F.ceil(deviation * 12).cast("long") + 24).alias("reach"))

    def walk(f: Column) -> Column:
        taken = {"good": f["mode"], "other": f["draws"] - f["mode"], "total": f["draws"]}
        terms = F.array(*[F.array(f[c], k, f[c] - k) for c, k in taken.items()])
        logs = F.transform(terms, lambda t: F.aggregate(F.transform(t, lambda n, i: log_factorial(n) * F.when(i == 0, 1).otherwise(-1)), F.lit(0.0), lambda a, x: a + x))
        chance_of_mode = F.exp(F.get(logs, F.lit(0)) + F.get(logs, F.lit(1)) - F.get(logs, F.lit(2)))
        reach = F.least(f["high"] - f["low"], f["reach"])
        steps = F.when(reach > 0, F.sequence(F.lit(1).cast("long"), reach)).otherwise(F.array().cast("array<bigint>"))

        def step(s: Column, k: Column) -> Column:
            above, below = f["mode"] + k, f["mode"] - k
            up = F.when(above <= f["high"], s["up"] * ((f["good"] - above + 1).cast("double") * (f["draws"] - above + 1)) / (above.cast("double") * (f["other"] - f["draws"] + above))).otherwise(0.0)
            down = F.when(below >= f["low"], s["down"] * ((below + 1).cast("double") * (f["other"] - f["draws"] + below + 1)) / ((f["good"] - below).cast("double") * (f["draws"] - below))).otherwise(0.0)
            next_ = F.struct(s["left"].alias("before"), s["x"].alias("x"), up.alias("up"), down.alias("down"))
            found = lambda n: F.when((n["before"] < 0) | (n["before"] >= n["up"] + n["down"]), n["x"]).when(n["before"] < n["up"], above).otherwise(below)
            left = lambda n: F.when(n["before"] < 0, n["before"]).otherwise(n["before"] - n["up"] - n["down"])
            return let(next_, lambda n: F.struct(left(n).alias("left"), found(n).alias("x"), n["up"].alias("up"), n["down"].alias("down")))

        return let(chance_of_mode, lambda p: F.aggregate(steps, F.struct((f["u"] - p).alias("left"), f["mode"].alias("x"), p.alias("up"), p.alias("down")), step)["x"])

    return let(let(given, bounds), walk)


def split() -> tuple[Column, Column]:
    """How a node (level, path, quotas and starts by source) is halved: the column ``left``, and the two children made of it."""
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(F.array().cast("array<bigint>").alias("left"), F.floor(total / 2).cast("long").alias("free"), total.alias("all"))

    def one(state: Column, at: Column) -> Column:
        quota = F.element_at("quotas", at)
        drawn = F.struct(state.alias("s"), quota.alias("q"), hypergeometric(chance("level", "path", at), state["all"], state["free"], quota).alias("x"))
        return let(drawn, lambda d: F.struct(F.concat(d["s"]["left"], F.array(d["x"])).alias("left"), (d["s"]["free"] - d["x"]).alias("free"), (d["s"]["all"] - d["q"]).alias("all")))

    places = F.when(F.size("quotas") > 0, F.sequence(F.lit(1), F.size("quotas"))).otherwise(F.array().cast("array<int>"))
    right = F.zip_with("quotas", "left", lambda q, x: q - x)
    level, path = (F.col("level") + 1).alias("level"), F.col("path") * 2
    children = F.array(F.struct(level, path.alias("path"), F.col("left").alias("quotas"), F.col("starts")), F.struct(level, (path + 1).alias("path"), right.alias("quotas"), F.zip_with("starts", "left", lambda s, x: s + x).alias("starts")))
    return F.aggregate(places, start, one)["left"], children


def tree(quotas: DataFrame, levels: int) -> DataFrame:
    """From (rank, quota): which draws of each source a shard takes: (rank, shard, start, n), start from 0."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q"))
    node = node.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("path"), F.col("q.rank").alias("ranks"), F.col("q.quota").alias("quotas"), F.transform("q", lambda _: F.lit(0).cast("long")).alias("starts"))
    ranks, node = node.select("ranks"), node.drop("ranks")
    left, children = split()
    for level in range(levels):
        node = node.withColumn("left", left).select(F.explode(children).alias("n")).select("n.*")
        if level % 3 == 2:  # eight times the nodes: deal them anew
            node = node.repartition(min(1 << (level + 1), 2048), "path")
    rows = node.join(F.broadcast(ranks)).select("path", F.explode(F.arrays_zip("ranks", "starts", "quotas")).alias("x"))
    return rows.select(F.col("x.ranks").alias("rank"), F.col("path").cast("int").alias("shard"), F.col("x.starts").alias("start"), F.col("x.quotas").alias("n")).where("n > 0")


def running(blocks: DataFrame, value: str, seed: int, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the blocks of the source that come earlier in an order by hash.

    Hash ranges are summed first, so a task has the blocks of one range.
    """
    h = F.xxhash64(F.lit(SEED + seed), "rank", "block")
    parts = F.floor(F.col("blocks") / RANGE_BLOCKS) + 1
    part = F.least(F.floor((h.cast("double") / 2.0**64 + 0.5) * parts).cast("long"), parts - 1)
    rows = durable(blocks.withColumn("h", h).withColumn("part", part))
    sums = rows.groupBy("rank", "part").agg(F.sum(value).alias("n"))
    ranges = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = sums.select("rank", "part", (F.sum("n").over(ranges) - F.col("n")).alias("of_ranges"))
    inside = Window.partitionBy("rank", "part").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("here", F.sum(value).over(inside) - F.col(value)).join(before, ["rank", "part"])
    return rows.withColumn(name, F.col("here") + F.col("of_ranges")).drop("h", "part", "here", "of_ranges")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, levels: int | None = None) -> DataFrame:
    """One row for each document: size, source_size, target, taken, and ``copies`` (pass, shard, place in the shard's order, words)."""
    rows = durable(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), sized(docs, text).alias("size"), F.xxhash64(text).alias("key")))
    stats = durable(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    n_sources, most = stats.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    if levels is None:
        levels = max(LEAST_LEVELS, ceil(log2(max(1.0, most / SHARD_WORDS))))
    block_words = max(1, min(BLOCK_WORDS, ceil(most / (SHARD_BLOCKS << levels))))
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("int")
    stats = stats.select("source", "rank", "source_size", "target", passes.alias("passes"), (words - passes * F.col("source_size")).alias("rest"), (F.ceil(F.col("source_size") / block_words) + 1).cast("long").alias("blocks"))
    hint = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda d: d)
    rows = rows.alias("d").join(hint(stats.alias("s")), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", "key", "size", "rank", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "key"), F.col("blocks")).alias("block"))
    blocks = rows.groupBy("rank", "block").agg(F.sum("size").alias("words")).join(hint(stats.drop("source")), "rank")
    blocks = running(blocks, "words", 0, "before")
    # words that the last, partial pass takes of the block
    blocks = blocks.withColumn("part_words", F.greatest(F.least(F.col("rest") - F.col("before"), F.col("words")), F.lit(0)))
    blocks = blocks.withColumn("draws", F.col("passes") + (F.col("part_words") > 0).cast("int"))
    blocks = durable(running(blocks, "draws", 1, "first"))
    quotas = durable(blocks.groupBy("rank").agg(F.sum("draws").cast("long").alias("quota")))
    shards = tree(quotas, levels)
    # draws meet the shards' ranges in cells of their usual length
    cell = (F.floor(F.col("quota") / (1 << levels)) + 1).cast("long")
    cells = quotas.select("rank", cell.alias("cell"))
    ranges = shards.join(hint(cells), "rank").select("rank", "shard", "start", "n", F.explode(F.sequence(F.floor(F.col("start") / F.col("cell")), F.floor((F.col("start") + F.col("n") - 1) / F.col("cell")))).alias("c"))
    draws = blocks.where("draws > 0").join(hint(cells), "rank").select("rank", "block", "first", "cell", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)).alias("k"))
    draws = draws.select("rank", "block", "k", (F.col("first") + F.col("k")).alias("at"), F.floor((F.col("first") + F.col("k")) / F.col("cell")).alias("c"))
    dealt = draws.join(ranges, ["rank", "c"]).where("start <= at and at < start + n").groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("k", "shard"))).alias("s"))
    blocks = blocks.select("rank", "block", "passes", "part_words", "source_size", "target").join(dealt.select("rank", "block", F.col("s.shard").alias("shards")), ["rank", "block"], "left")
    rows = rows.join(blocks, ["rank", "block"])
    inside = Window.partitionBy("rank", "block").orderBy(F.xxhash64(F.lit(SEED + 2), "doc_id", "key"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("some", F.greatest(F.least(F.col("part_words") - (F.sum("size").over(inside) - F.col("size")), F.col("size")), F.lit(0)))
    shards = F.coalesce("shards", F.array().cast("array<int>"))
    copies = F.transform(shards, lambda shard, i: F.struct(i.alias("pass"), shard.alias("shard"), F.xxhash64(F.lit(SEED), "doc_id", "key", i).alias("place"), F.when(i < F.col("passes"), F.col("size")).otherwise(F.col("some")).alias("words")))
    rows = rows.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix as rows (shard, place, doc_id, words): each shard in its shuffled order, ready to be written by shard."""
    rows = mixed.select("doc_id", F.explode("copies").alias("c")).select("doc_id", "c.*")
    return rows.repartition("shard").sortWithinPartitions("shard", "place", "doc_id")
