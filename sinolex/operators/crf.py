"""Linear-chain conditional random fields: marginals, decoding, and training with weights that stay in Spark.

A sample is (sent_id, features: array of arrays of feature numbers, tags). Samples are dealt to blocks. The weights are a
table (idx, weights); for a step each block pulls those of its own features by a join, computes expected and observed counts
for its sentences at once, and Spark sums what comes back by feature and joins it to the weights. Neither the driver nor a
task holds all weights or all gradients: the driver keeps the edge table, the ratio and a row of figures for each epoch.

The edge gradient is indexed as the weights are, and is not scaled by the ratio. Samples are dealt to mini-batches by block
and epoch, without padding. The error of an epoch is the mean log loss of its samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructType

from sinolex.operators import evaluate
from sinolex.operators.lattice import Lattice, log_sum
from sinolex.operators.tables import durable, list_sizes, parts, slices, within

__all__ = ["Edges", "Weights", "converged", "decode", "gain", "gradient", "log_sum", "node_marginals", "prune", "train", "weight_stats"]

#: Feature occurrences of a block of samples.
BLOCK = 2_000_000
#: Feature occurrences whose gradients are summed at once.
OCCURRENCES = 4_000_000
#: Weights up to which all are sent to the tasks.
LOCAL_WEIGHTS = 200_000
#: Losses that a gain is measured over, the factor of the second ratio that is decoded, and the least share of tags that it must change.
WINDOW = 10
LESS = 0.99
LEAST_CHANGE = 2e-5
MOST_STEP, MOST_WEIGHT, LEAST_RATIO = 1.0, 10.0, 1e-6


@dataclass
class Edges:
    """edge: [previous tag, next tag]; ratio: weight of the edges."""

    edge: np.ndarray
    ratio: float = 1e-4

    @property
    def scaled(self) -> np.ndarray:
        return self.edge * self.ratio


@dataclass
class Weights(Edges):
    """Edges and node weights [features, tags] of a model that fits into tasks."""

    node: np.ndarray | None = None

    @staticmethod
    def zeros(n_features: int, n_tags: int) -> Weights:
        return Weights(np.zeros((n_tags, n_tags)), node=np.zeros((n_features, n_tags)))


def start_weights(index: DataFrame, n_tags: int, seed: int | None = None) -> DataFrame:
    """(idx, weights): zeros, or with a seed normal numbers of deviation 0.4."""
    one = [F.lit(0.0) if seed is None else F.randn(seed + k) * 0.4 for k in range(n_tags)]
    return index.select("idx", F.array(*one).alias("weights"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of arrays of arrays of numbers: positions of each row, numbers of each position, and the numbers."""
    def sizes(lists: pa.Array) -> np.ndarray:
        return pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    inner = column.flatten()
    return sizes(column), sizes(inner), inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def scores(node: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Summed weights of the features of each position."""
    out = np.zeros((len(sizes), node.shape[1]))
    held = np.flatnonzero(sizes)
    if len(held):
        out[held] = np.add.reduceat(node[rows], (np.cumsum(sizes) - sizes)[held], axis=0)
    return out


def _columns(batch: pa.RecordBatch, key: str) -> tuple[pa.Array, Lattice, np.ndarray, np.ndarray]:
    positions, sizes, rows = flat(batch.column("features"))
    return batch.column(key), Lattice(positions), sizes, rows


def decode(df: DataFrame, w: Weights, key: str = "sent_id") -> DataFrame:
    """(key, tags) by Viterbi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, list_sizes(b.column("features")))):
            keys, lattice, sizes, rows = _columns(batch, key)
            tags = lattice.viterbi(scores(w.node, sizes, rows), w.scaled[None])[0]
            yield pa.RecordBatch.from_arrays([keys, listed(tags.astype(np.int32), lattice.sizes)], names=[key, "tags"])

    given = df.select(key, "features")
    return given.mapInArrow(run, StructType([given.schema[key], *StructType.fromDDL("tags array<int>").fields]))


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def node_marginals(df: DataFrame, w: Weights, key: str = "sent_id") -> DataFrame:
    """(key, pos, tag, prob)."""
    t = w.edge.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, list_sizes(b.column("features")))):
            keys, lattice, sizes, rows = _columns(batch, key)
            prob = lattice.marginals(scores(w.node, sizes, rows), w.scaled)[1]
            pos = np.arange(len(prob)) - lattice.starts[lattice.owner]
            columns = [keys.take(pa.array(np.repeat(lattice.owner, t))), pa.array(np.repeat(pos, t).astype(np.int32)), pa.array(np.tile(np.arange(t, dtype=np.int32), len(prob))), pa.array(prob.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "pos", "tag", "prob"])

    given = df.select(key, "features")
    return given.mapInArrow(run, StructType([given.schema[key], *StructType.fromDDL("pos int, tag int, prob double").fields]))


# Steps with weights that stay in Spark.


def with_blocks(samples: DataFrame, block: int, batches: int = 0) -> DataFrame:
    """The samples with their block; where there is one batch only, all are of one."""
    if batches == 1:
        return samples.select(F.lit(0).alias("block"), *samples.columns)
    occurrences = samples.agg(F.coalesce(F.sum(F.aggregate("features", F.lit(0).cast("long"), lambda a, f: a + F.size(f))), F.lit(0))).first()[0]
    return samples.select(F.pmod(F.xxhash64("sent_id"), F.lit(max(1, -(-occurrences // block)))).alias("block"), *samples.columns)


def blocks(samples: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The samples with their block, and (block, idx): the features of each block."""
    dealt = durable(with_blocks(samples, block))
    return dealt, durable(dealt.select("block", F.explode(F.array_distinct(F.flatten("features")).cast("array<long>")).alias("idx")).distinct())


def pulled(needs: DataFrame, weights: DataFrame) -> DataFrame:
    """(of, idx, weights): the weights that each block needs."""
    return needs.join(weights.select(F.col("idx").cast("long").alias("idx"), "weights"), "idx").select(F.col("block").alias("of"), "idx", "weights")


def _block(samples: pa.Table, weights: pa.Table, t: int) -> tuple[Lattice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its lattice, sizes of its positions, their features as rows, the features, and the scores."""
    positions, sizes, features = flat(samples.column("features").combine_chunks())
    names = weights.column("idx").to_numpy()
    by = np.argsort(names)
    node = weights.column("weights").combine_chunks().flatten().to_numpy().reshape(-1, t)[by]
    rows = np.searchsorted(names[by], features)
    return Lattice(positions), sizes, rows, names[by], scores(node, sizes, rows)


STEP = "idx long, g array<double>, n long, loss double, ratio double, nodes long, now long, less long"


def gradient(samples: DataFrame, needs: DataFrame, weights: DataFrame, edges: Edges) -> tuple[DataFrame, dict]:
    """(idx, g, n): gradient of the log loss by feature and the samples that hold it; and figures of the whole step.

    The figures are the edge gradient, that of the ratio, the loss, the samples, the positions, and how many of them are
    tagged right under the ratio and under a slightly smaller one, which are decoded in one pass.
    """
    t = edges.edge.shape[0]

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        lattice, sizes, rows, names, y = _block(own, known, t)
        tags = own.column("tags").combine_chunks().flatten().to_numpy().astype(np.int64)
        return pa.Table.from_arrays(*_step_columns(names, *_step(lattice, sizes, rows, len(names), y, tags, edges)))

    return _summed(samples.where("size(features) > 0").groupBy("block").cogroup(pulled(needs, weights).groupBy("of")).applyInArrow(run, STEP), t)


def _step(lattice: Lattice, sizes: np.ndarray, rows: np.ndarray, n: int, y: np.ndarray, tags: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some samples: gradients of n features, samples that hold each, the edge gradient, and the figures of STEP with the samples first."""
    t = edges.edge.shape[0]
    z, prob, pairs = lattice.marginals(y, edges.scaled)
    seen = lattice.seen_pairs(tags, t)
    here = np.arange(len(tags))
    loss = z.sum() - y[here, tags].sum() - (seen * edges.scaled).sum()
    best = lattice.viterbi(y, np.stack((edges.scaled, edges.scaled * LESS)))
    delta = prob
    delta[here, tags] -= 1
    g, held = np.zeros((n, t)), np.zeros(n, np.int64)
    ends, stops = np.append(0, np.cumsum(lattice.sizes)), np.append(0, np.cumsum(sizes))
    for i, j in slices(np.diff(stops[ends]), OCCURRENCES):  # whole sentences
        (a, b), own = ends[[i, j]], rows[stops[ends[i]] : stops[ends[j]]]
        of = np.repeat(here[a:b], sizes[a:b])
        g += np.stack([np.bincount(own, delta[of, k], n) for k in range(t)], axis=1)
        met = np.sort(lattice.owner[of] * n + own)
        held += np.bincount(met[np.diff(met, prepend=-1) > 0] % max(n, 1), minlength=n)
    return g, held, pairs - seen, np.array([(lattice.sizes > 0).sum(), loss, ((pairs - seen) * edges.edge).sum(), len(tags), (best[0] == tags).sum(), (best[1] == tags).sum()], float)


def _step_columns(names: np.ndarray, g: np.ndarray, held: np.ndarray, pairs: np.ndarray, figures: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    """The columns of STEP: a row for each feature, and a last one with the edge gradient and the figures."""
    t, none = g.shape[1], np.zeros(len(names))
    columns = [pa.array(np.append(names, -1)), listed(np.concatenate((g.ravel(), pairs.ravel())), np.append(np.full(len(names), t), t * t)), pa.array(np.append(held, figures[0]).astype(np.int64))]
    columns += [pa.array(np.append(none, v).astype(kind)) for v, kind in zip(figures[1:], (float, float, np.int64, np.int64, np.int64), strict=True)]
    return columns, [f.split(" ")[0] for f in STEP.split(", ")]


def gradient_in_tasks(samples: DataFrame, weights: pa.Table, edges: Edges) -> tuple[DataFrame, dict]:
    """As ``gradient``, with weights (idx, weights) that fit into tasks: samples stay where they are, each task sums its own."""
    t = edges.edge.shape[0]
    by = np.argsort(weights.column("idx").to_numpy())
    names = weights.column("idx").to_numpy()[by].astype(np.int64)
    shared = samples.sparkSession.sparkContext.broadcast((names, weights.column("weights").combine_chunks().flatten().to_numpy().reshape(-1, t)[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, node = shared.value
        sums = [np.zeros((len(names), t)), np.zeros(len(names), np.int64), np.zeros((t, t)), np.zeros(6)]
        for batch in batches:
            lists, tags = batch.column(0), batch.column(1)
            for i, j in slices(lists.value_lengths().to_numpy(zero_copy_only=False)):
                positions, sizes, features = flat(lists[i:j])
                rows = np.searchsorted(names, features)
                own = tags[i:j].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                for total, part in zip(sums, _step(Lattice(positions), sizes, rows, len(names), scores(node, sizes, rows), own, edges), strict=True):
                    total += part
        held = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays(*_step_columns(names[held], sums[0][held], sums[1][held], *sums[2:]))

    return _summed(samples.where("size(features) > 0").select("features", "tags").mapInArrow(run, STEP), t)


def _summed(rows: DataFrame, t: int) -> tuple[DataFrame, dict]:
    sums = durable(rows)
    by_feature = sums.where("idx >= 0").groupBy("idx").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(t)]).alias("g"), F.sum("n").alias("n"))
    total = sums.where("idx < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "loss", "ratio", "nodes", "now", "less")], F.array(*[F.coalesce(F.sum(F.col("g")[k]), F.lit(0.0)) for k in range(t * t)]).alias("edge")).first()
    return by_feature, total.asDict() | {"edge": np.array(total["edge"]).reshape(t, t)}


# Steps over packed blocks.


@dataclass
class Packed:
    """Samples in blocks that are opened inside tasks, for models of any size.

    blocks: one row for each, with its number ``block``; needs: (block, shard, idx): the features of a block that are of a shard,
    in order and packed, where a feature's shard is its number modulo ``shards``; opened: gives, of a block's row and its
    features in order, positions of each sentence, features of each position, their places, and the tags.
    """

    blocks: DataFrame
    needs: DataFrame
    shards: int
    opened: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed planes of their bytes; rising ones as steps."""
    x = np.ascontiguousarray(x).ravel()
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd"), np.uint8)
    x = np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()
    return np.cumsum(x) if rising else x


def numbers(column: pa.ChunkedArray, kind: type, rising: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that packed rows hold, one row after the other, and how many each holds."""
    rows = [unpack(r, kind, rising) for c in column.chunks for r in c.to_pylist()]
    return np.concatenate([*rows, np.empty(0, kind)]), np.array([len(r) for r in rows], np.int64)


def pulled_packed(samples: Packed, weights: DataFrame, t: int) -> DataFrame:
    """(block, idx, weights): the weights that each block needs, packed."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        names = known.column("idx").to_numpy()
        by = np.argsort(names)
        node = np.concatenate((known.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, t)[by], np.zeros((1, t))))
        names, (keys, sizes) = names[by], numbers(asked.column("idx"), np.int64, True)
        at = np.searchsorted(names, keys)
        at[np.append(names, -1)[at] != keys] = len(names)
        ends = np.cumsum(np.append(0, sizes)).tolist()
        pulled = [pack(node[at[i:j]]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"block": asked.column("block"), "idx": asked.column("idx"), "weights": pa.array(pulled, pa.binary())})

    idx = F.col("idx").cast("long")
    own = weights.select(F.pmod(idx, F.lit(samples.shards)).cast("int").alias("of"), idx.alias("idx"), "weights")
    return samples.needs.groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(run, "block long, idx binary, weights binary")


PUSHED = "shard int, idx binary, g binary, n binary, figures array<double>"


def gradient_packed(samples: Packed, weights: DataFrame, edges: Edges) -> tuple[DataFrame, dict]:
    """As ``gradient``, over packed blocks: what blocks and shards exchange are rows of packed numbers."""
    t, shards, opened = edges.edge.shape[0], samples.shards, samples.opened

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        names, _ = numbers(known.column("idx"), np.int64, True)
        by = np.argsort(names)
        names, node = names[by], numbers(known.column("weights"), np.float64)[0].reshape(-1, t)[by]
        positions, sizes, rows, tags = opened(block, names)
        y, stops = np.zeros((len(sizes), t)), np.append(0, np.cumsum(sizes))
        for i, j in slices(sizes, OCCURRENCES):
            y[i:j] = scores(node, sizes[i:j], rows[stops[i] : stops[j]])
        g, held, pairs, figures = _step(Lattice(positions), sizes, rows, len(names), y, tags, edges)
        shard = names % shards
        by = np.flatnonzero(held)
        by = by[np.argsort(shard[by], kind="stable")]
        ends = np.searchsorted(shard[by], np.arange(shards + 1))
        some = np.flatnonzero(np.diff(ends)).tolist()
        columns = [pa.array([pack(x[by[ends[s] : ends[s + 1]]], x is names) for s in some] + [None], pa.binary()) for x in (names, g, held.astype(np.int32))]
        return pa.Table.from_arrays([pa.array([*some, -1], pa.int32()), *columns, pa.array([None] * len(some) + [[*figures, *pairs.ravel()]], pa.list_(pa.float64()))], names=["shard", "idx", "g", "n", "figures"])

    def add(rows: pa.Table) -> pa.Table:
        names, of = np.unique(numbers(rows.column("idx"), np.int64, True)[0], return_inverse=True)
        g, n = numbers(rows.column("g"), np.float64)[0].reshape(-1, t), numbers(rows.column("n"), np.int32)[0]
        g = np.stack([np.bincount(of, g[:, k], len(names)) for k in range(t)], axis=1)
        return pa.table({"idx": names, "g": listed(g.ravel(), np.full(len(names), t)), "n": np.bincount(of, n, len(names)).astype(np.int64)})

    pushed = durable(samples.blocks.groupBy("block").cogroup(pulled_packed(samples, weights, t).groupBy("block")).applyInArrow(run, PUSHED))
    by_feature = pushed.where("shard >= 0").groupBy("shard").applyInArrow(add, "idx long, g array<double>, n long")
    total = np.array(pushed.where("shard < 0").agg(*[F.coalesce(F.sum(F.col("figures")[k]), F.lit(0.0)) for k in range(6 + t * t)]).first())
    n, loss, ratio, nodes, now, less = total[:6].tolist()
    return by_feature, {"n": int(n), "loss": loss, "ratio": ratio, "nodes": int(nodes), "now": int(now), "less": int(less), "edge": total[6:].reshape(t, t)}


def clipped(x: Column, most: float) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(-most))


def stepped(weights: DataFrame, by_feature: DataFrame, rate: float, decay: bool) -> DataFrame:
    """The weights after a step: mean gradients of features, steps and weights clipped, then, if asked, all shrunk by the rate."""
    own = by_feature.select(F.col("idx").cast("long").alias("idx"), "g", "n")
    rows = weights.select(F.col("idx").cast("long").alias("idx"), "weights").join(own, "idx", "left")
    new = F.when(F.col("g").isNull(), F.col("weights")).otherwise(F.zip_with("weights", "g", lambda w, g: clipped(w - clipped(g / F.col("n") * rate, MOST_STEP), MOST_WEIGHT)))
    return rows.select("idx", (F.transform(new, lambda w: w - w * rate) if decay else new).alias("weights"))


def step_edges(edges: Edges, figures: dict, rate: float, decay: bool) -> Edges:
    """The edges and the ratio after a step. The ratio follows how many tags a smaller one gets wrong, unless those are few."""
    if not figures["n"]:
        return edges
    edge = np.clip(edges.edge - rate * figures["edge"] / figures["n"], -MOST_WEIGHT, MOST_WEIGHT)
    better = figures["now"] - figures["less"]
    change = 0.0 if abs(better) < np.ceil(figures["nodes"] * LEAST_CHANGE) else better / figures["nodes"]
    ratio = edges.ratio + rate * change / (0.01 * edges.ratio)
    return Edges(edge * (1 - rate) if decay else edge, ratio if ratio >= 0 else LEAST_RATIO)


def gain(losses: list[float]) -> float:
    """Mean gain of the last loss over those of the window before it, relative to itself; the first loss is its own gain."""
    *before, last = losses[-WINDOW - 1 :]
    return (before[0] - last) / len(before) / abs(last) if before and last else last


def converged(losses: list[float], patience: float) -> bool:
    return len(losses) > 2 and gain(losses) < patience


def decode_blocks(samples: DataFrame, needs: DataFrame, weights: DataFrame, edges: Edges) -> DataFrame:
    """(sent_id, gold, pred) of dealt samples by Viterbi, with weights that stay in Spark."""
    t = edges.edge.shape[0]
    kind = samples.schema["sent_id"].dataType.simpleString()

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        lattice, _, _, _, y = _block(own, known, t)
        tags = lattice.viterbi(y, edges.scaled[None])[0]
        return pa.Table.from_arrays([own.column("sent_id"), own.column("tags").cast(pa.list_(pa.int32())), listed(tags.astype(np.int32), lattice.sizes)], names=["sent_id", "gold", "pred"])

    return samples.where("size(features) > 0").groupBy("block").cogroup(pulled(needs, weights).groupBy("of")).applyInArrow(run, f"sent_id {kind}, gold array<int>, pred array<int>")


LOG = "epoch int, loss double, gain double, rate double, ratio double, edge array<double>, token_acc double, precision double, recall double, f1 double, max_w double, min_w double, mean_w double, mean_abs_w double"


@dataclass
class Trained:
    """weights: (idx, weights); log: a row of figures for each epoch."""

    weights: DataFrame
    edges: Edges
    log: list[dict]

    @property
    def losses(self) -> list[float]:
        return [r["loss"] for r in self.log]


def resumed(weights: DataFrame, edges: Edges, state: str) -> Trained:
    """What the state table at ``state`` holds: the last whole epoch, or the start."""
    spark = weights.sparkSession
    try:
        log = [r.asDict() for r in spark.read.schema(LOG).parquet(f"{state}/log").orderBy("epoch").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Trained(weights, edges, [])
    last = log[-1]
    t = edges.edge.shape[0]
    return Trained(spark.read.parquet(f"{state}/weights/{last['epoch']}"), Edges(np.array(last["edge"]).reshape(t, t), last["ratio"]), log)


def train(samples: DataFrame | Packed, weights: DataFrame, n_tags: int, epochs: int = 5, batches: int = 1, rate: float = 1.0, drop: float = 0.1, patience: float = 1e-4, decay: bool = False, seed: int = 0, held_out: DataFrame | None = None, state: str | None = None, block: int = BLOCK, keep: bool = True) -> Trained:
    """Stochastic gradient descent from ``weights`` (idx, weights) over samples with tags.

    The rate falls with the epochs and inside them. After each epoch ``held_out`` samples are decoded for the log. With
    ``state``, a folder that the cluster shares, each epoch's weights and figures are written there, the figures last; a run
    that finds such a folder goes on behind its last whole epoch. Training ends once the gain is under ``patience``.

    ``Packed`` samples stay in their blocks. Without ``keep`` others are not stored but made again for each step, and not shuffled, if the weights fit into tasks.
    """
    spark = weights.sparkSession
    found = Trained(weights, Edges(np.zeros((n_tags, n_tags))), [])
    if state:
        found = resumed(weights, found.edges, state)
    weights, edges, log = durable(found.weights), found.edges, found.log
    whole = isinstance(samples, Packed)
    few = not whole and not keep and within(weights.select(F.col("idx").cast("string").alias("idx")), "idx", LOCAL_WEIGHTS)
    dealt, needs = (samples.blocks, samples.needs) if whole else (with_blocks(samples, block, batches), None) if few else blocks(samples, block)
    tests = blocks(held_out, block) if held_out is not None else None
    while len(log) < epochs and not converged([r["loss"] for r in log], patience):
        epoch, loss, n, step = len(log), 0.0, 0, rate
        for b in range(batches):
            chosen = F.pmod(F.xxhash64("block", F.lit(seed + epoch)), F.lit(batches)) == b
            part = dealt.where(chosen) if batches > 1 else dealt
            if whole:
                by_feature, figures = gradient_packed(replace(samples, blocks=part, needs=needs.where(chosen) if batches > 1 else needs), weights, edges)
            elif few:
                by_feature, figures = gradient_in_tasks(part, weights.select("idx", "weights").toArrow(), edges)
            else:
                by_feature, figures = gradient(part, needs.where(chosen) if batches > 1 else needs, weights, edges)
            step = rate * float(np.exp(-(epoch + b / batches) * drop))
            weights, edges = durable(stepped(weights, by_feature, step, decay)), step_edges(edges, figures, step, decay)
            loss, n = loss + figures["loss"], n + figures["n"]
        row = {"epoch": epoch, "loss": loss / max(n, 1), "rate": step, "ratio": float(edges.ratio), "edge": edges.edge.ravel().tolist()} | weight_stats(weights).first().asDict()
        row["gain"] = gain([r["loss"] for r in log] + [row["loss"]])
        if tests:
            tags = durable(decode_blocks(*tests, weights, edges))
            row |= {k: v for k, v in (evaluate.accuracy(tags, "gold", "pred").first().asDict() | evaluate.f1(tags, "sent_id", "gold", "pred").first().asDict()).items() if k in LOG}
        if state:
            weights.write.mode("overwrite").parquet(f"{state}/weights/{epoch}")
            names = StructType.fromDDL(LOG).fieldNames()
            spark.createDataFrame([tuple(row.get(c) for c in names)], LOG).coalesce(1).write.mode("append").parquet(f"{state}/log")
        log.append(row)
    return Trained(weights, edges, log)


def prune(weights: DataFrame, keep: int = 0, share: float = 1e-4) -> DataFrame:
    """Without features whose weights hardly differ and are small: a range under ``share`` of that of all weights, and ten times
    their mean not above the mean of all. Feature ``keep`` always stays."""
    low, high = F.array_min("weights"), F.array_max("weights")
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    whole = weights.agg(F.min(low).alias("low"), F.max(high).alias("high"), (F.sum(total) / F.sum(F.size("weights"))).alias("mean"))
    flat_one = (high - low < (F.col("high") - F.col("low")) * share) & (10 * total / F.size("weights") <= F.col("mean"))
    return weights.join(F.broadcast(whole)).where(~flat_one | (F.col("idx") == keep)).select(weights.columns)  # one row


def weight_stats(weights: DataFrame) -> DataFrame:
    """Largest, smallest, mean and mean absolute weight; means are over features, not cells."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    size = F.aggregate("weights", F.lit(0.0), lambda a, x: a + F.abs(x))
    return weights.agg(F.max(F.array_max("weights")).alias("max_w"), F.min(F.array_min("weights")).alias("min_w"), (F.sum(total) / F.count("*")).alias("mean_w"), (F.sum(size) / F.count("*")).alias("mean_abs_w"))
