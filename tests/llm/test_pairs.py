"""Jaccard join, passages, decontamination and mixing against brute force, with awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sinolex.llm import components, decontam, fmindex, jaccard, mixing, substring

RNG = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(300)] + ["Été", "naïve", "ß"]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def text(n):
    return " ".join(words(n))


def other_text(n, rng=random.Random(9)):
    """From a generator of its own, so that the other texts stay what they are."""
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def mutated(t, share):
    return " ".join(w if RNG.random() > share else RNG.choice(VOCABULARY) for w in t.split())


def corpus():
    base, passage, line = text(120), text(70), "a very common line of six words"
    rows = [(i, text(RNG.randint(1, 150)), "en", f"s{i % 4}") for i in range(20)]
    rows += [(20 + i, mutated(base, 0.01), "en", "s0") for i in range(25)]
    rows += [(50 + i, f"{text(RNG.randint(5, 90))} {passage} {text(20)}", "en", "s1") for i in range(8)]
    rows += [(60 + i, f"{line} {text(4)}", "en", "s2") for i in range(6)]
    rows += [(70, None, "en", None), (71, "", "en", "s0"), (72, " \n\t", "en", "s0"), (73, "one two three", "en", "s1"), (74, "ONE two\nthree", "en", "s1"), (75, rows[3][1], "en", "s3"), (76, rows[3][1], "en", "s3"), (76, rows[3][1], "en", "s3"), (77, "x " * 400, "en", "s0"), (78, "x " * 300, "en", "s0"), (None, rows[3][1], "en", "s1"), (79, text(3000), "en", "s2")]
    return rows


ROWS = corpus()


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_against_all_pairs(docs_of):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs_of(ROWS)).collect()}
    sets = {i: shingles(t) for i, t, *_ in ROWS if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {(i, len(s), root(i)) for i, s in sets.items()} | {(None, len(shingles(ROWS[3][1])), None)}
    assert got == want
    assert jaccard.classes(docs_of(ROWS)).count() == len(ROWS)


def test_jaccard_of_rows_that_share_an_id(docs_of):
    """A near copy of the second text of an id reaches what its first text is a copy of."""
    a, b, c = other_text(200), other_text(200), other_text(200)
    near = " ".join(["other", *b.split()[1:-1], "words"])
    rows = [(3, a), (5, a), (5, b), (7, near), (4, c), (5, c), (9, c), (11, other_text(200))]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.classes(docs_of([(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (4, 3), (9, 3), (11, 11)}


def test_jaccard_with_columns_of_clashing_names(docs_of):
    docs = docs_of(ROWS)
    for name in ("key", "n", "s1", "component_id", "none"):
        docs = docs.withColumn(name, F.lit("mine"))
    assert sorted(map(repr, jaccard.classes(docs).collect())) == sorted(map(repr, jaccard.classes(docs_of(ROWS)).collect()))


@pytest.mark.parametrize("hot", [2000, 2])
def test_passages_against_all_windows(docs_of, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.removed(docs_of(ROWS)).collect()}
    first = {}
    for i, t, *_ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = set()
    for i, t, *_ in ROWS:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(50)}
        want.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == want


def test_passages_carry_columns_of_any_name(docs_of):
    docs = docs_of(ROWS).withColumn("n_words", F.lit("mine")).withColumn("__0", F.lit(1)).withColumn("windows", F.lit(2))
    rows = substring.removed(docs, keep=["n_words", "__0", "windows"], names=("a", "b", "c"))
    assert rows.columns == ["doc_id", "n_words", "__0", "windows", "a", "b", "c"]
    assert rows.where("n_words = 'mine' and windows = 2").count() == len(ROWS)


def test_fm_index_finds_windows_of_other_texts():
    rng = np.random.default_rng(0)
    sequences = [rng.integers(1, 5, n) for n in (30, 7, 100, 3)]
    index = fmindex.FmIndex(sequences, 6, 6, [8, 5, 9, 5])
    where = defaultdict(set)
    for s, found in zip(sequences, index.match(sequences), strict=True):
        for k in range(len(s) - 5):
            where[tuple(s[k : k + 6].tolist())].add(int(found[k]))
    groups = [next(iter(g)) for g in where.values()]
    assert all(len(g) == 1 for g in where.values()) and len(set(groups)) == len(groups) and min(groups) >= 0
    owner = {}
    for s, doc in zip(sequences, (8, 5, 9, 5), strict=True):
        for k in range(len(s) - 5):
            run = tuple(s[k : k + 6].tolist())
            owner[run] = min(doc, owner.get(run, doc))
    assert all(index.least[next(iter(g))] == owner[run] for run, g in where.items())
    queries = [rng.integers(1, 7, 200), sequences[2], rng.integers(1, 5, 5)]
    for q, found in zip(queries, index.match(queries), strict=True):
        assert [int(g) for g in found] == [next(iter(where.get(tuple(q[k : k + 6].tolist()), {-1}))) for k in range(len(q) - 5)]


def test_a_shard_streams_later_documents_against_owners():
    rng = np.random.default_rng(4)
    shared = [rng.integers(1, 1 << 60, n, np.uint64) for n in (14, 9, 30)]
    rows = []
    for doc, anchor, parts in ((5, 1, (0,)), (3, 1, (0, 1)), (9, 1, (1, 0)), (9, 1, (1, 0)), (7, 2, (2,)), (7, 2, (2,)), (8, 3, (1,)), (2, 3, (2, 1)), (8, 3, (2,))):
        own = [rng.integers(1, 1 << 60, 5, np.uint64)]
        rows.append((doc, anchor, 100 * len(rows), np.concatenate([own[0], *[shared[i] for i in parts], own[0]])))
    frame = pd.DataFrame([(d, d, a, f, w.tobytes()) for d, a, f, w in rows], columns=["doc_id", "key", "anchor", "first", "words"])
    got = {(r.doc_id, int(w)) for r in substring.search(frame, 8).itertuples() for w in r.windows}
    least = {}
    for d, a, _, w in rows:
        for k in range(len(w) - 7):
            run = (a, *w[k : k + 8].tolist())
            least[run] = min(d, least.get(run, d))
    assert got == {(d, f + k) for d, a, f, w in rows for k in range(len(w) - 7) if least[(a, *w[k : k + 8].tolist())] < d}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}


ITEMS = [(1, text(25)), (2, text(10)), (3, "only three words"), (4, "Été"), (5, ""), (6, None), (7, ROWS[5][1]), (8, ROWS[5][1]), (None, other_text(14))]


def test_decontamination_against_all_windows(spark, docs_of):
    rows = [*ROWS, (90, f"{text(3)} {ITEMS[0][1][:60]} {text(9)}", "en", "s"), (91, f"{text(5)}, {ITEMS[1][1].upper()}! {text(2)}", "en", "s"), (92, "é Été; naïve only THREE words", "en", "s"), (93, f"before {ITEMS[-1][1]} after", "en", "s"), (94, other_text(2000) + " only three words " + other_text(2000), "en", "s")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {tuple(r) for r in decontam.contaminated(docs_of(rows).withColumn("key", F.lit(1)).withColumn("n_words", F.lit(2)), items.withColumn("w", F.lit("w")).withColumn("window", F.lit(0))).collect()}
    low = str.maketrans(decontam.UPPER, decontam.LOWER)

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))

    windows = defaultdict(set)
    for i, t in ITEMS:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    want = set()
    for i, t, *_ in rows:
        w, hit, held = split(t), set(), set()
        for win, items_of in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    held |= items_of - {None}
        want.add((i, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(map(str, held))).encode()).hexdigest(), bool(hit)))
    assert got == want


def test_mix_meets_targets(docs_of):
    rows = [(i, text(RNG.randint(0, 400)), "en", s) for i, s in enumerate("abcda" * 40)] + [(900, None, "en", None), (901, text(50), "en", None), (902, "", "en", "z"), (0, text(30), "en", "a")]
    docs = docs_of(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    target |= {s: level * weight[s] for s in free}
    source = {r["source"]: None for r in docs.collect()}
    assert set(source) == set(sizes)
    by_size = defaultdict(list)
    for r in got:
        by_size[r["source_size"], round(r["target"], 6)].append(r)
    for s in order:
        own = by_size[sizes[s], round(target[s], 6)]
        assert sum(r["taken"] for r in own) == round(target[s])
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"]) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    shards = mixing.shuffled(mixing.mix(docs)).groupBy("shard").agg(F.sum("words").alias("n")).collect()
    assert sum(r["n"] for r in shards) == sum(r["taken"] for r in got)


def test_tree_splits_quotas_exactly(spark):
    quotas = {1: 37, 2: 0, 3: 100, 4: 3, 7: 100_000}
    for levels in (0, 3, 5):
        rows = mixing.tree(spark.createDataFrame(list(quotas.items()), "rank int, quota long"), levels).collect()
        held = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["shard"]):
            held[r["rank"]] += range(r["start"], r["start"] + r["n"])
        # the shards' ranges follow each other and cover every draw once
        assert {k: held[k] for k in quotas} == {k: list(range(q)) for k, q in quotas.items()}
        loads = defaultdict(int)
        for r in rows:
            loads[r["shard"]] += r["n"]
        assert len(loads) == 1 << levels and max(loads.values()) - min(loads.values()) <= levels


@pytest.mark.parametrize(("total", "good", "draws"), [(10, 4, 5), (60, 30, 7), (500, 250, 300), (7, 7, 3), (7, 0, 3), (3, 1, 0)])
def test_hypergeometric_draws(spark, total, good, draws):
    from math import comb

    rows = spark.range(20_000).select((F.col("id") + 0.5).alias("i"))
    x = mixing.hypergeometric(F.col("i") / 20_000, *[F.lit(v).cast("long") for v in (total, good, draws)])
    got = {r["x"]: r["n"] / 20_000 for r in rows.select(x.alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()}
    for k in range(draws + 1):
        want = comb(good, k) * comb(total - good, draws - k) / comb(total, draws) if k <= good and draws - k <= total - good else 0
        assert abs(got.get(k, 0) - want) < 2e-4, k


def test_large_hypergeometric_draws(spark):
    rows = spark.range(2000).select((F.col("id") + 0.5).alias("i"))
    x = mixing.hypergeometric(F.col("i") / 2000, *[F.lit(v).cast("long") for v in (10**9, 4 * 10**8, 10**6)])
    got = np.array([r["x"] for r in rows.select(x.alias("x")).collect()])
    assert abs(got.mean() - 400_000) < 30 and abs(got.std() - (10**6 * 0.24 * 0.999) ** 0.5) < 10


def test_mix_follows_the_tree(docs_of):
    rows = [(i, text(RNG.randint(1, 60)), "en", f"s{i % 3}") for i in range(300)]
    mixes = {levels: {r["doc_id"]: r for r in mixing.mix(docs_of(rows), levels=levels).collect()} for levels in (0, 2, 4)}
    for levels, got in mixes.items():
        words = defaultdict(int)
        for r in got.values():
            for c in r["copies"]:
                words[c["shard"]] += c["words"]
        assert len(words) == 1 << levels and min(words.values()) > 0.25 * max(words.values())
        # documents of one source are in many shards, and what is taken doesn't depend on the tree
        assert sum(r["taken"] for r in got.values()) == sum(r["taken"] for r in mixes[0].values())
    assert any([c["shard"] for c in mixes[2][i]["copies"]] != [c["shard"] >> 2 for c in mixes[4][i]["copies"]] for i in mixes[2])


def test_mix_of_many_sources(docs_of):
    rows = [(i, text(8), "en", f"s{i % 150}") for i in range(900)]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == 900 and all(r["taken"] <= 2 * r["size"] for r in got) and len({c["shard"] for r in got for c in r["copies"]}) == 16


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    assert jaccard.classes(none).collect() == []
    assert substring.removed(none).collect() == []
    assert mixing.mix(none).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(none, items).collect() == []
    assert {r["contaminated"] for r in decontam.contaminated(docs_of(ROWS[:3]), items).collect()} == {False}
