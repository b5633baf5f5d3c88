"""Lattices, gradients, training with weights in Spark, resumed runs, pruning and compressed models."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinolex.operators import crf
from sinolex.operators.lattice import Lattice
from sinolex.operators.segment import Segmenter, SegmenterModel
from sinolex.plans import train
from sinolex.sources import models

SAMPLES = [(1, [[1], [2], [1, 3]], [0, 1, 0]), (2, [[2], [3]], [1, 1]), (3, [[1]], [0]), (4, [], [])]
GOLD = [["我们", "在", "北京", "大学", "学习"], ["他", "在", "大学", "学习", "中文"], ["北京", "是", "首都"], ["我们", "学习", "中文"], ["他们", "是", "学生"], ["学生", "在", "学习"]]


def test_lattices_by_enumeration():
    rng = np.random.default_rng(0)
    sizes, t = np.array([4, 0, 1, 6, 2]), 3
    lattice, y = Lattice(sizes), rng.normal(size=(13, t)) * 3
    edges = rng.normal(size=(2, t, t)) * 2
    z, prob, pairs = lattice.marginals(y, edges[0])
    best = lattice.viterbi(y, edges)
    want_pairs, begin = np.zeros((t, t)), 0
    for s, n in enumerate(sizes):
        if not n:
            assert z[s] == 0
            continue
        own = y[begin : begin + n]
        paths = list(product(range(t), repeat=int(n)))
        for k, edge in enumerate(edges):
            values = np.array([sum(own[i, x] for i, x in enumerate(p)) + sum(edge[a, b] for a, b in zip(p, p[1:])) for p in paths])
            assert tuple(best[k, begin : begin + n]) == paths[values.argmax()]
            if k == 0:
                p = np.exp(values - values.max())
                p /= p.sum()
                assert abs(z[s] - (np.log(np.exp(values - values.max()).sum()) + values.max())) < 1e-9
                assert np.allclose(prob[begin : begin + n], [[sum(q for q, x in zip(p, paths) if x[i] == tag) for tag in range(t)] for i in range(n)])
                for q, x in zip(p, paths):
                    np.add.at(want_pairs, (list(x[:-1]), list(x[1:])), q)
        begin += n
    assert np.allclose(pairs, want_pairs)
    tags = np.array([0, 1, 1, 2, 0, 1, 0, 1, 0, 1, 0, 2, 2])
    assert lattice.seen_pairs(tags, t).sum() == 9 and lattice.seen_pairs(tags, t)[0, 1] == 3
    # equal paths: the smaller tags
    assert Lattice(np.array([3])).viterbi(np.zeros((3, 2)), np.zeros((1, 2, 2))).tolist() == [[0, 0, 0]]
    empty = Lattice(np.array([], np.int64))
    assert len(empty.marginals(np.zeros((0, 2)), np.zeros((2, 2)))[0]) == 0 and empty.viterbi(np.zeros((0, 2)), np.zeros((1, 2, 2))).shape == (1, 0)


def samples_of(spark, rows=SAMPLES):
    return spark.createDataFrame(rows, "sent_id long, features array<array<int>>, tags array<int>")


def table(spark, node):
    return spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(node)], "idx int, weights array<double>")


@pytest.mark.parametrize("block", [crf.BLOCK, 2])
def test_gradient_by_differences(spark, block):
    rng = np.random.default_rng(1)
    node, edges = rng.normal(size=(4, 2)), crf.Edges(rng.normal(size=(2, 2)), 0.5)
    dealt, needs = crf.blocks(samples_of(spark), block)
    rows, figures = crf.gradient(dealt, needs, table(spark, node), edges)
    got = {r["idx"]: r for r in rows.collect()}
    assert figures["n"] == 3 and figures["nodes"] == 6 and {i: r["n"] for i, r in got.items()} == {1: 2, 2: 2, 3: 2}

    def loss(n, e):
        return crf.gradient(dealt, needs, table(spark, n), e)[1]["loss"]

    step = np.zeros((4, 2))
    step[1, 0] = 1e-4
    assert abs((loss(node + step, edges) - loss(node - step, edges)) / 2e-4 - got[1]["g"][0]) < 1e-3
    turn = np.array([[0, 1e-4], [0, 0]])
    slope = (loss(node, crf.Edges(edges.edge + turn, 0.5)) - loss(node, crf.Edges(edges.edge - turn, 0.5))) / 2e-4
    assert abs(slope - figures["edge"][0, 1] * 0.5) < 1e-3
    by_ratio = (loss(node, crf.Edges(edges.edge, 0.5001)) - loss(node, crf.Edges(edges.edge, 0.4999))) / 2e-4
    assert abs(by_ratio - figures["ratio"]) < 1e-3


def test_both_ratios_are_decoded(spark):
    # under ratio 1 the edges turn the second position, under 0.99 they no longer do
    rows = [(k, [[0], [1]], [0, 1]) for k in range(10)]
    node, edges = [[5.0, 0.0], [0.995, 0.0]], crf.Edges(np.array([[0.0, 1.0], [0.0, 0.0]]), 1.0)
    figures = crf.gradient(*crf.blocks(samples_of(spark, rows)), table(spark, node), edges)[1]
    assert (figures["nodes"], figures["now"], figures["less"]) == (20, 20, 10)
    assert crf.step_edges(edges, figures, 0.1, False).ratio == pytest.approx(1.0 + 0.1 * (10 / 20) / 0.01)
    few = figures | {"now": 10, "less": 10}
    assert crf.step_edges(edges, few, 0.1, False).ratio == 1.0
    worse = figures | {"now": 0, "less": 20}
    assert crf.step_edges(edges, worse, 0.1, False).ratio == crf.LEAST_RATIO


def test_steps_are_clipped_and_shrunk(spark):
    weights = table(spark, [[0.0, 1.0], [9.5, -9.5], [2.0, 2.0]])
    g = spark.createDataFrame([(0, [8.0, -1.0], 2), (1, [-9.0, 9.0], 3)], "idx long, g array<double>, n long")
    got = {r["idx"]: r["weights"] for r in crf.stepped(weights, g, 0.5, False).collect()}
    assert got == {0: [-1.0, 1.25], 1: [10.0, -10.0], 2: [2.0, 2.0]}
    assert {r["idx"]: r["weights"] for r in crf.stepped(weights, g, 0.5, True).collect()}[2] == [1.0, 1.0]


def test_gain_over_a_window():
    assert crf.gain([5.0]) == 5.0 and crf.gain([4.0, 2.0]) == 1.0
    losses = [20.0, *range(12, 2, -1)]
    assert crf.gain([float(x) for x in losses]) == pytest.approx((20 - 3) / 10 / 3)
    assert crf.gain([99.0] + [float(x) for x in losses]) == pytest.approx((20 - 3) / 10 / 3)
    assert not crf.converged([1.0, 1.0], 1e-4) and crf.converged([1.0, 1.0, 1.0], 1e-4)


@pytest.mark.parametrize("batches", [1, 2])
def test_training_goes_on_where_it_was_stopped(spark, tmp_path, batches):
    samples, start = samples_of(spark), crf.start_weights(spark.range(4).selectExpr("int(id) AS idx"), 2)
    options = {"batches": batches, "held_out": samples, "block": 3}
    whole = crf.train(samples, start, 2, 3, **options)
    crf.train(samples, start, 2, 1, state=str(tmp_path / "s"), **options)
    # a driver lost after weights were written but before the log counts the epoch not
    table(spark, [[7.0, 7.0]] * 4).write.parquet(str(tmp_path / "s/weights/1"))
    again = crf.train(samples, start, 2, 3, state=str(tmp_path / "s"), **options)
    assert [r["epoch"] for r in again.log] == [0, 1, 2] and np.allclose(whole.losses, again.losses)
    assert np.allclose(*([r["weights"] for r in t.weights.orderBy("idx").collect()] for t in (whole, again)))
    assert np.allclose(whole.edges.edge, again.edges.edge) and whole.edges.ratio == again.edges.ratio
    assert whole.losses[-1] < whole.losses[0] and all(0 <= r["token_acc"] <= 1 and r["f1"] is not None for r in again.log)


def test_training_learns(spark):
    trained = crf.train(samples_of(spark), crf.start_weights(spark.range(4).selectExpr("int(id) AS idx"), 2), 2, 4)
    node = np.array([r["weights"] for r in trained.weights.orderBy("idx").collect()])
    w = crf.Weights(trained.edges.edge, trained.edges.ratio, node)
    assert {r["sent_id"]: r["tags"] for r in crf.decode(samples_of(spark), w).collect()} == {1: [0, 1, 0], 2: [1, 1], 3: [0], 4: []}
    dealt, needs = crf.blocks(samples_of(spark), 2)
    assert all(r["gold"] == r["pred"] for r in crf.decode_blocks(dealt, needs, trained.weights, trained.edges).collect())
    noise = crf.start_weights(spark.range(2000).selectExpr("int(id) AS idx"), 2, 5).selectExpr("stddev(weights[0]) AS s").first()["s"]
    assert abs(noise - 0.4) < 0.05


def test_prune(spark):
    rows = [(0, [0.0, 0.0]), (1, [3.0, -3.0]), (2, [0.0, 0.0]), (3, [5.0, 5.0]), (4, [-1.0, -1.0])]
    weights = spark.createDataFrame(rows, "idx int, weights array<double>")
    # the mean of all is 0.8: flat ones go if ten times their mean is not above it
    assert sorted(r["idx"] for r in crf.prune(weights).collect()) == [0, 1, 3]


def test_compressed_models(spark, tmp_path):
    corpus = spark.createDataFrame(list(enumerate(GOLD)), "sent_id long, words array<string>")
    model, trained = train.train_segmenter(corpus, epochs=3, held_out=corpus, state=str(tmp_path / "state"))
    assert [r["epoch"] for r in trained.log] == [0, 1, 2] and trained.log[-1]["f1"] > 0.9
    path = str(tmp_path / "model")
    models.save_segmenter(model, path, compressed=True)
    back = models.load_segmenter(spark, path)
    assert back.params["ratio"] == trained.edges.ratio and back.params["edge"] == trained.edges.edge.tolist()
    was, now = ({r["feature"]: r["weights"] for r in m.weights.collect()} for m in (model, back))
    assert was.keys() == now.keys()
    assert all(abs(now[f][0] - w[0]) <= abs(w[0]) / 2048 + 2**-25 and abs(now[f][1] - w[1]) <= abs(w[0]) / 2048 + 2e-4 for f, w in was.items())
    texts = spark.createDataFrame([(i, "".join(s)) for i, s in enumerate(GOLD)], "id long, text string")
    assert sorted(Segmenter(back).segment(texts, "id", "text").collect()) == sorted(Segmenter(model).segment(texts, "id", "text").collect())
    odd = spark.createDataFrame([("a", [0.5, -0.5]), ("b", [0.5, 0.25]), ("c", [0.1, -0.1 + 5e-5])], "feature string, weights array<double>")
    halves, exceptions = models.compress(odd)
    assert [tuple(r) for r in exceptions.collect()] == [("b", 0.25)] and dict(halves.dtypes)["half"] == "smallint"
    assert {r["feature"]: r["weights"] for r in models.decompress(halves, exceptions).collect()}["b"] == [0.5, 0.25]
    assert isinstance(back, SegmenterModel) and spark.read.parquet(f"{path}/halves").where(F.col("half").isNull()).count() == 0
