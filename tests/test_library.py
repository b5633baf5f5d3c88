"""The library's operators against plain Python and DuckDB."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sinolex.functions import charset, predicates
from sinolex.operators import crf, dictionary, evaluate, features, rules, scoring, vocab
from sinolex.operators.chars import char_feature_counts, char_features, tag_to_word, word_to_tag
from sinolex.operators.segment import Segmenter, SegmenterModel
from sinolex.operators.tagging import Tagger, TaggerModel, tagset
from sinolex.plans import fixtures, sql, train
from sinolex.sources import lines
from sinolex.streaming import text as streams

ZH_TEXTS = ["", None, "我", "你好", "开源ＡＢ１２③⑪ⓒ⒟㈩", "笑🙂é ü　トリ。；！？…", "几百万人在二三年", "ｊｇ"]


def column(spark, values, name="text"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {name} string")


def test_normalisation_keeps_length(spark):
    rows = column(spark, ZH_TEXTS).select("id", "text", charset.preprocess(F.col("text")).alias("c"), charset.preprocess(F.col("text"), normalize_num_letter=True).alias("n")).collect()
    for r in rows:
        assert r["text"] is None or len(r["c"]) == len(r["n"]) == len(r["text"])
    by = {r["text"]: r for r in rows}
    assert by["开源ＡＢ１２③⑪ⓒ⒟㈩"]["c"] == "开源AB1239cd9" and by["开源ＡＢ１２③⑪ⓒ⒟㈩"]["n"] == "开源ZZ7777ZZ7"
    assert by["笑🙂é ü　トリ。；！？…"]["c"] == "笑んん ん んん。。。。。"
    assert by["几百万人在二三年"]["n"] == "7百7人在77年" and by["ｊｇ"]["n"] == "ｊZ"
    a, b = charset.convert_table()
    assert len(a) == len(b) == len(set(a))


def test_predicates(spark):
    got = {r["word"]: r for r in fixtures.words(spark).select("word", predicates.is_number(F.col("word")).alias("num"), predicates.is_name(F.col("word")).alias("name"), predicates.has_time(F.col("word")).alias("time")).collect()}
    assert {w for w, r in got.items() if r["name"]} == {"王小明", "欧阳修", "诸葛孔明", "赵李明华"}
    assert {w for w, r in got.items() if r["num"]} >= {"一二三四五六", "三百二十", "12%", "1,234.5万", "12:30", ".", "１２万", "12\n"}
    assert {w for w, r in got.items() if r["time"]} == {"5月份", "3时", "8小时"}


RULE_TEXTS = [
    "联系17358560923@gmail.com或13912345678。", "13912345678", "电话010-89736182,400 800 1234", "身份证11010519491231002X和110105199913310021", "ip 192.168.1.1,1.705.665.70 256.1.1.1",
    "见http://m.weibo.cn/2703294971/44101 和www.a.com/x。", "", None, "a@b.com,c@d.cn", "１13912345678", "https://x.y/z", "13912345678 13912345678", "+86 139-1234-5678x",
]


def python_hits(text):
    padded, out = f"￥{text}￥", []
    for name, pattern in rules.RULES.items():
        for m in re.finditer(pattern.replace("(?U)", ""), padded):
            out.append((m[1], m.start() - 1, m.end() - 1, rules.TYPES[name]))
    return out


def test_rules_against_python(spark):
    rows = column(spark, RULE_TEXTS).select("text", rules.extract_info(F.col("text")).alias("h"), rules.resolve(rules.extract_info(F.col("text"))).alias("r"), rules.cut_by_rules(F.col("text"), rules.resolve(rules.extract_info(F.col("text")))).alias("p")).collect()
    for r in rows:
        want = python_hits(r["text"]) if r["text"] is not None else []
        assert [tuple(h) for h in r["h"]] == want
        kept, end = [], 0
        for h in sorted(want, key=lambda h: h[1]):
            if h[1] >= end:
                kept.append(h)
                end = h[2]
        assert [tuple(h) for h in r["r"]] == kept
        assert "".join(p["s"] for p in r["p"]) == (r["text"] or "") and all(p["s"] for p in r["p"])
        assert [p["s"] for p in r["p"] if p["t"]] == [h[0] for h in kept]
    first = rows[0]
    assert [h["s"] for h in first["r"]] == ["17358560923@gmail.com", "13912345678"]


def test_tags_and_words(spark):
    rows = spark.createDataFrame([(["我们", "在", "北京"],), ([],), (["x"],)], "words array<string>").select("words", F.array_join("words", "").alias("t"), word_to_tag(F.col("words")).alias("g"))
    for r in rows.select("words", "g", tag_to_word(F.col("t"), F.col("g")).alias("back")).collect():
        assert r["back"] == r["words"] and r["g"] == [int(i > 0) for w in r["words"] for i in range(len(w))]
    assert spark.range(1).select(tag_to_word(F.lit("我"), F.array(F.lit(1))).alias("w")).first()["w"] == ["我"]


def plain_features(i, t, u, b):
    c, n = t[i], len(t)
    out = ["c" + c] + (["[START]"] if i == 0 else []) + (["[END]"] if i == n - 1 else [])
    for k, x, y in ((1, "b", "bc"), (2, "a", "ac"), (3, "z", "zc")):
        if i >= k:
            out += [x + t[i - k], y + t[i - k] + "." + c]
    for k, x, y in ((1, "d", "cd"), (2, "e", "ce"), (3, "f", "cf")):
        if i + k < n:
            out += [x + t[i + k], y + c + "." + t[i + k]]

    def ending(at):
        return next((t[at - k + 1 : at + 1] for k in (4, 3, 2) if at - k + 1 >= 0 and at < n and t[at - k + 1 : at + 1] in u), None)

    def starting(at):
        return next((t[at : at + k] for k in (4, 3, 2) if at >= 0 and at + k <= n and t[at : at + k] in u), None)

    v, x, pre, post = ending(i), starting(i), ending(i - 1) if i else None, starting(i + 1)
    out += (["v" + v] if v else []) + (["x" + x] if x else [])
    for name, p, s in (("wl", pre, x), ("wr", v, post)):
        if p and s:
            out += [f"{name}{len(p)}{len(s)}"] + ([f"{name}{p}*{s}"] if (p, s) in b else [])
    return sorted(out)


def test_segment_features_against_python(spark):
    u, b = {"北京", "京大", "大学", "北京大学", "学生"}, {("北京", "大学"), ("大学", "学生")}
    texts = ["北京大学生", "我", "京大学学生会", "大学生"]
    known, pairs = spark.createDataFrame([(w,) for w in u], "word string"), spark.createDataFrame(list(b), "pre string, suf string")
    got = features.segment_features(column(spark, texts), ["id"], "text", known, pairs).collect()
    assert {(r["id"], r["pos"]): sorted(r["features"]) for r in got} == {(i, k): plain_features(k, t, u, b) for i, t in enumerate(texts) for k in range(len(t))}
    assert column(spark, ["", None]).select(F.size(char_features(F.col("text"))).alias("n")).collect()[0]["n"] == 0


def plain_tag_features(i, words, u, parts, held):
    def forms(w):
        if w in u:
            return {"w": w}
        out = {}
        for k in range(min(len(w), 5) - 1, 0, -1):
            if "l" not in out and w[:k] in parts:
                out["l"] = w[:k]
            if "r" not in out and w[-k:] in parts:
                out["r"] = w[-k:]
        return out

    names = ({"w": "v", "l": "bl", "r": "br"}, {"w": "w", "l": "cl", "r": "cr"}, {"w": "x", "l": "dl", "r": "dr"})
    sides = [forms(words[j]) if 0 <= j < len(words) else None for j in (i - 1, i, i + 1)]
    out = []
    for side, own, unknown in zip(sides, names, ("vk", "wk", "xk"), strict=True):
        if side is not None:
            out += [own[k] + x for k, x in side.items()] or [unknown]
    out += (["[START]"] if sides[0] is None else []) + (["[END]"] if sides[2] is None else [])
    w = words[i]
    if not sides[1]:
        out += ["ck"] if 1 <= len(w) <= 3 else []
        at = {f"c{k + 1}": w[k] for k in range(min(4, len(w)))}
        if len(w) >= 5:
            at["c6"] = w[-1]
        if len(w) > 5:
            at["c5"] = w[-2]
        out += [k + c for k, c in at.items() if c in held]
    for left, right, p, s in ((sides[0], sides[1], names[0], names[1]), (sides[1], sides[2], names[1], names[2])):
        if left is not None and right is not None:
            out += [p[a] + s[b] + x + "*" + y for a, x in left.items() for b, y in right.items()]
    return sorted(out)


def test_tag_features_against_python(spark):
    u, parts, held = {"我", "学习"}, {"中", "山", "山岗", "村", "岗村"}, set("abc123.")
    samples = [["我", "山岗村", "学习"], ["abcdef", "我", "a1", "中山"], ["x"], ["12345", "山岗村", "岗村村"], ["1.2c"]]
    tokens = spark.createDataFrame([(i, p, w) for i, s in enumerate(samples) for p, w in enumerate(s)], "sent_id long, pos int, word string")
    info = features.word_info(tokens, *(spark.createDataFrame([(x,) for x in v], f"{n} string") for v, n in ((u, "word"), (parts, "part"), (held, "ch"))))
    got = {(r["sent_id"], r["pos"]): sorted(r["features"]) for r in features.tag_features(tokens, info).collect()}
    assert got == {(i, p): plain_tag_features(p, s, u, parts, held) for i, s in enumerate(samples) for p in range(len(s))}


def test_scores_and_ties(spark):
    weights = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0]), ("/", [10.0, 0.0])], "feature string, weights array<double>")
    nodes = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "zz"]), (3, ["zz"]), (4, [])], "id long, features array<string>")
    for miss, want in (("any", {1: [1.5, 1.0], 2: [11.0, 2.0], 3: [10.0, 0.0], 4: [10.0, 0.0]}), ("all", {1: [1.5, 1.0], 2: [1.0, 2.0], 3: [10.0, 0.0], 4: [10.0, 0.0]})):
        assert {r["id"]: r["scores"] for r in scoring.node_scores(nodes, ["id"], weights, 2, miss=miss).collect()} == want
    assert spark.range(1).select(scoring.best(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("k")).first()["k"] == 1


def test_dictionary_scan(spark):
    entries = spark.createDataFrame([("北京", 2.0, 0), (" 北京大学 ", 3.0, 1), ("北京", 9.0, 2), ("ABC", 1.0, 3), ("大学生", 1.5, 4), (" ", 1.0, 5)], "word string, weight double, ord int")
    words = dictionary.upsert(entries)
    assert {tuple(r) for r in words.collect()} == {("北京", 2.0), ("北京大学", 3.0), ("abc", 1.0), ("大学生", 1.5)}
    df = column(spark, ["北京大学生", "在北京ABCabc", "大学大学生"])
    got = {(r["id"], r["b"], r["n"], r["weight"]) for r in dictionary.greedy(df, ["id"], "text", words).collect()}
    assert got == {(0, 0, 4, 3.0), (1, 1, 2, 2.0), (1, 6, 3, 1.0), (2, 2, 3, 1.5)}
    boost = {(r["id"], r["pos"]): (r["add_b"], r["add_i"]) for r in dictionary.boosts(dictionary.greedy(df, ["id"], "text", words), ["id"]).collect()}
    assert boost[0, 0] == (3.0, 0.0) and boost[0, 1] == (0.0, 3.0) and boost[0, 4] == (3.0, 0.0)


def test_statistics(spark):
    sentences = [["亲口", "交代", "工作"], ["业务", "口交", "代"], ["亲口", "交代"]]
    words = spark.createDataFrame([(i, p, w) for i, s in enumerate(sentences) for p, w in enumerate(s)], "sent_id long, pos int, word string")
    known = spark.createDataFrame([("亲口",), ("交代",), ("口交",)], "word string")
    assert {tuple(r) for r in vocab.ambiguous(vocab.pairs(words), known).collect()} == {("亲口", "交代", 2), ("口交", "代", 1)}
    words2, kept = vocab.back_fill(vocab.ambiguous(vocab.pairs(words), known), known, 2)
    assert {r["word"] for r in words2.collect()} == {"亲口", "交代", "口交"} and kept.count() == 1
    parts = {r["part"]: r["freq"] for r in vocab.part_frequencies(words, known).collect()}
    assert parts == {"工": 1, "作": 1, "业": 1, "务": 1}
    index = {r["feature"]: r["idx"] for r in vocab.index_features(spark.createDataFrame([("a", 3), ("b", 9), ("c", 3), ("/", 99)], "feature string, freq long"), ["b", "wl11"]).collect()}
    assert index == {"/": 0, "b": 1, "a": 2, "c": 3, "wl11": 4}
    assert len(vocab.length_features()) == 162


def test_counts_of_features_and_pairs_inside_tasks(spark):
    texts = ["", None, "a", "ab.c", "明abc明abc", "🙂é\n x", "a" * 50]
    df = column(spark, texts)
    rows = df.select(F.explode(F.flatten(char_features(F.col("text")))).alias("f")).groupBy("f").count()
    assert {tuple(r) for r in char_feature_counts(df, "text").collect()} == {tuple(r) for r in rows.collect()}
    words = [["a", "b", "a", "b"], ["c"], [], None, ["a", "b"]]
    arrays = spark.createDataFrame(list(enumerate(words)), "sent_id long, w array<string>")
    assert {tuple(r) for r in vocab.pairs_in(arrays, F.col("w")).collect()} == {tuple(r) for r in vocab.pairs(vocab.long_words(arrays, "sent_id", F.col("w"))).collect()} == {("a", "b", 3), ("b", "a", 1)}


def test_f1_against_chunk_rows(spark):
    rows = [(1, [0, 1, 0, 2, 1, 0], [0, 1, 0, 0, 1, 0]), (2, [1, 0], [0, 0, 1]), (3, [], []), (4, None, [0]), (5, [0, None, 1], [0, 1, 1])]
    df = spark.createDataFrame(rows, "id long, gold array<int>, pred array<int>")
    sets = [{tuple(r) for r in evaluate.chunk_rows(df, "id", c).collect()} for c in ("gold", "pred")]
    got = evaluate.f1(df, "id", "gold", "pred").first()
    assert (got["n_gold"], got["n_pred"], got["n_correct"]) == (len(sets[0]), len(sets[1]), len(sets[0] & sets[1]))


def test_evaluation(spark):
    rows = [(1, [0, 1, 0, 1], [0, 1, 0, 1]), (2, [1, 1, 0], [0, 1, 1]), (3, [0, 1, 1], [0, 0, 1]), (4, [1, 1], [1, 1])]
    df = spark.createDataFrame(rows, "id long, gold array<int>, pred array<int>")
    f = evaluate.f1(df, "id", "gold", "pred").first()
    assert (f["n_gold"], f["n_pred"], f["n_correct"]) == (4, 5, 2) and f["precision"] == 0.4 and f["recall"] == 0.5
    both = evaluate.chunk_rows(df, "id", "gold").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("c")).collect()
    direct = {r["id"]: r["c"] for r in df.select("id", evaluate.chunks(F.col("gold")).alias("c")).collect()}
    assert {r["id"]: r["c"] for r in both} == {k: v for k, v in direct.items() if v}
    a = evaluate.accuracy(df, "gold", "pred").first()
    assert abs(a["token_acc"] - 9 / 12) < 1e-9 and a["sample_acc"] == 0.5


GOLD = [["我们", "在", "北京", "大学", "学习"], ["他", "在", "大学", "学习", "中文"], ["北京", "是", "首都"], ["我们", "学习", "中文"], ["他们", "是", "学生"], ["学生", "在", "学习"]]


def test_trained_segmenter(spark):
    corpus = spark.createDataFrame(list(enumerate(GOLD)), "sent_id long, words array<string>")
    model, trained = train.train_segmenter(corpus, epochs=6)
    assert trained.losses[-1] < trained.losses[0]
    texts = column(spark, ["".join(s) for s in GOLD] + ["", None, "我", "电话13912345678在北京"])
    got = {r["id"]: r["words"] for r in Segmenter(model).segment(texts, "id", "text").collect()}
    assert [got[i] for i in range(len(GOLD))] == GOLD and got[6] == got[7] == [] and got[8] == ["我"]
    ruled = {r["id"]: r["words"] for r in Segmenter(model, use_rules=True).segment(texts, "id", "text").collect()}
    assert "13912345678" in ruled[9] and "".join(ruled[9]) == "电话13912345678在北京"
    words = spark.createDataFrame([("京大学", 30.0, 0)], "word string, weight double, ord int")
    assert "京大学" in {r["id"]: r["words"] for r in Segmenter(model).with_words(words).segment(texts, "id", "text").collect()}[0]


def test_long_and_repeated_user_words(spark):
    weights = spark.createDataFrame([("nothing", [0.0, 0.0])], "feature string, weights array<double>")
    texts = column(spark, ["abcdefghxyz"])

    def words(rows):
        return spark.createDataFrame(rows, "word string, weight double, ord int")

    def cut(segmenter):
        return segmenter.segment(texts, "id", "text").first()["words"]

    base = Segmenter(SegmenterModel(weights)).with_words(words([("abcdefgh", 2.0, 0), ("abc", 9.0, 1)]))
    assert cut(base)[0] == "abcdefgh"
    more = base.with_words(words([("xyz", 2.0, -1), ("abcdefgh", -5.0, -2)]))
    assert cut(more) == ["abcdefgh", "xyz"] and cut(more.with_words(words([("xyz", -5.0, -9)]))) == ["abcdefgh", "xyz"]
    assert cut(Segmenter(SegmenterModel(weights)).with_words(words([]))) == cut(Segmenter(SegmenterModel(weights)))


def test_tagger(spark):
    tags = {"我们": "r", "他": "r", "他们": "r", "在": "p", "是": "v", "北京": "ns", "大学": "n", "学习": "v", "中文": "nz", "首都": "n", "学生": "n"}
    corpus = spark.createDataFrame([(i, [(w, tags[w]) for w in s]) for i, s in enumerate(GOLD)], "sent_id long, tokens array<struct<word:string,tag:string>>")
    default = spark.createDataFrame([("北京", "ns")], "word string, tag string")
    model, trained = train.train_tagger(corpus, default, epochs=6)
    assert trained.losses[-1] < trained.losses[0] and model.tags == sorted(set(tags.values()))
    texts = spark.createDataFrame([*enumerate(GOLD), (9, [])], "id long, words array<string>")
    tagger = Tagger(model, default)

    def run(t, **more):
        return {r["id"]: [(x["word"], x["tag"]) for x in r["tokens"]] for r in t.tag(texts, "id", "words", **more).collect()}

    got = run(tagger)
    assert [got[i] for i in range(len(GOLD))] == [[(w, tags[w]) for w in s] for s in GOLD] and got[9] == []
    assert run(tagger.with_tags(spark.createDataFrame([("北京", "v")], "word string, tag string")))[2][0] == ("北京", "v")
    assert run(tagger.with_soft_tags(spark.createDataFrame([("首都", "v", 99.0), ("首都", "none", 999.0)], "word string, tag string, weight double")))[2][2] == ("首都", "v")
    ruled = spark.createDataFrame([(2, "首都", "tel")], "id long, word string, rule_tag string")
    assert run(tagger, rule_tags=ruled)[2][2] == ("首都", "tel")
    assert tagset(spark).count() == 42


def test_sources(spark, tmp_path):
    (tmp_path / "n.txt").write_text("苹果\t0.995\t10\n坏行\n低\t0.5\t9\n零\t1.0\t0\n", encoding="utf-8")
    (tmp_path / "nr1.txt").write_text("王\t1.0\t5\n苹果\t1.0\t3\n", encoding="utf-8")
    raw = lines.read_lines(spark, str(tmp_path))
    assert {tuple(r) for r in lines.parse_default_dictionary(raw).collect()} == {("苹果", "n", 0.995, 10), ("王", "nr", 1.0, 5)}
    given = spark.createDataFrame([("Word\t2.5",), ("plain",), ("a\tb\tc",), ("x\tv\t3",), ("y\tn",), ("bad\tnum",)], "value string")
    assert {tuple(r) for r in lines.parse_segment_dictionary(given).collect()} == {("word", 2.5), ("plain", 1.0)}
    assert {tuple(r) for r in lines.parse_tag_dictionary(given).collect()} >= {("x", "v", 3.0), ("y", "n", None)}
    nested = spark.createDataFrame([(["a", "b"], "x\ny", 3)], "l array<string>, s string, n int")
    assert [lines.to_lines(nested, c).first()[0] for c in ("l", "s", "n")] == ['["a","b"]', "xy", "3"]
    with pytest.raises(TypeError):
        lines.to_lines(nested.select(F.lit(True).alias("b")), "b")
    numbered = spark.createDataFrame([(0, "a"), (1, ""), (2, "b"), (3, "c")], "n int, value string")
    assert [r["value"] for r in lines.first_lines(numbered, "n", 3).orderBy("n").collect()] == ["a", "b"]
    index = spark.createDataFrame([("/", 0), ("f", 1)], "feature string, idx int")
    nodes = spark.createDataFrame([(1, 0, ["f", "g"]), (1, 1, ["f"])], "sent_id long, pos int, features array<string>")
    lines.write_features(nodes, index, ["sent_id"], f"{tmp_path}/f.parquet")
    assert lines.read_samples(spark, f"{tmp_path}/f.parquet").first()["features"] == [[0, 1], [1]]
    with pytest.raises(ValueError):
        lines.read_samples(spark, f"{tmp_path}/f.parquet", 0)
    assert lines.load_params({"word_max": 4} | {"odd": 1}, {"word_max": 3, "word_min": 2}) == {"word_max": 4, "word_min": 2}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("电话13912345678。\nＡ１\n", encoding="utf-8")
    stream = streams.pieces(streams.annotate(streams.read_text(spark, str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("pieces").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("pieces").collect()
    assert Counter(r["piece"] for r in rows) == Counter(["电话", "13912345678", "。", "Ａ１"]) and "A1" in {r["clean"] for r in rows}


def test_entry_without_the_other_subpackage(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    plain = builtins.__import__

    def missing(name, *a, **k):
        if name.startswith("sinolex.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name="sinolex.llm")
        return plain(name, *a, **k)

    for name in [n for n in sys.modules if n.startswith("sinolex.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", missing)
    found = entry.queries()
    assert "segment" in found and not any(k.startswith("op") or k == "pipeline" for k in found)
    assert set(entry.oracle_sql()) <= set(found)


def test_oracle_fragments():
    assert duckdb.sql(f"SELECT {sql.PREPROCESS.of(sql.quote('Ａé⑪'))}").fetchall() == [("Aん9",)]


def test_models_survive_the_disk_and_an_engine_is_made_of_them(spark, tmp_path):
    from sinolex.engine import Engine
    from sinolex.operators.segment import SegmenterModel
    from sinolex.operators.tagging import TaggerModel
    from sinolex.sources import models

    weights = spark.createDataFrame([("c ", [5.0, 0.0]), ("b ", [5.0, 0.0]), ("[START]", [5.0, 0.0]), ("/", [0.0, 1.0])], "feature string, weights array<double>")
    models.save_segmenter(SegmenterModel(weights, params={"norm_text": True}), str(tmp_path / "cut"))
    tag_weights = spark.createDataFrame([("wk", [0.5, 0.0]), ("[START]", [0.0, 0.75]), ("/", [0.0, 0.125])], "feature string, weights array<double>")
    none = [spark.createDataFrame([], f"{c} string") for c in ("word", "part", "ch")]
    models.save_tagger(TaggerModel(tag_weights, ["n", "v"], *none, {"norm_text": True}), str(tmp_path / "tag"))
    back = models.load_tagger(spark, str(tmp_path / "tag"))
    assert back.tags == ["n", "v"] and back.params == {"norm_text": True} and {r["feature"]: list(r["weights"]) for r in back.weights.collect()} == {r["feature"]: list(r["weights"]) for r in tag_weights.collect()}
    assert models.load_segmenter(spark, str(tmp_path / "cut")).words is None
    (tmp_path / "words.txt").write_text("cdef\t4\n")
    engine = Engine.init(spark, str(tmp_path / "cut"), str(tmp_path / "tag"), rules=True, user_words=str(tmp_path / "words.txt"))
    texts = spark.createDataFrame([(1, "abcdefg a@b.com x"), (2, ""), (3, None), (4, "８.8.8.8")], "id long, text string")
    got = {r["id"]: [(t["word"], t["tag"]) for t in r["tokens"]] for r in engine.cut(texts, "id", "text").collect()}
    assert [w for w, _ in got[1]] == ["ab", "cdef", "g", " ", "a@b.com", " ", "x"] and got[1][4] == ("a@b.com", "email")
    assert got[1][0] == ("ab", "v") and got[1][1] == ("cdef", "n") and got[2] == got[3] == [] and "".join(w for w, _ in got[4]) == "８.8.8.8"
    more = engine.add_word("fg", 9.0).add_word_tag("ab", "ns").add_word_tag("x", "v", 5.0)
    got = {r["id"]: [(t["word"], t["tag"]) for t in r["tokens"]] for r in more.cut(texts.where("id = 1"), "id", "text").collect()}
    assert got[1][0] == ("ab", "ns") and got[1][-1] == ("x", "v")
    assert {r["words"][0] for r in Engine(engine.segmenter).cut(texts.where("id = 1"), "id", "text").collect()} == {"ab"} and engine.tags().count() == 42


def test_lines_have_numbers(spark, tmp_path):
    from sinolex.sources import lines

    for name, n in (("a.txt", 2500), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" if i % 5 else "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = lines.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2503 and all(r["value"] == (f"{r['path'].split('/')[-1]} {r['line']}" if r["line"] % 5 else "") for r in got)
    first = lines.first_lines(lines.numbered_lines(spark, str(tmp_path / "b.txt")), "line", 2).collect()
    assert [(r["line"], r["value"]) for r in first] == [(1, "b.txt 1")]


def test_weight_statistics(spark):
    from sinolex.operators import crf

    rows = spark.createDataFrame([("a", [1.0, -2.0]), ("b", [0.5, 0.0])], "feature string, weights array<double>")
    r = crf.weight_stats(rows).first()
    assert (r["max_w"], r["min_w"], r["mean_w"], r["mean_abs_w"]) == (1.0, -2.0, -0.25, 1.75)


def test_scores_by_table_and_by_join(spark, monkeypatch):
    from sinolex.operators import scoring

    nodes = spark.createDataFrame([(1, 0, ["a", "b", "z"]), (1, 1, ["b"]), (2, 0, []), (2, 1, None), (3, 0, ["z"]), (None, 0, ["a", "a", "b"])], "id long, pos int, features array<string>")
    weights = spark.createDataFrame([("a", [1.0, -1.0]), ("b", [0.5, 0.25]), ("/", [8.0, 16.0])], "feature string, weights array<double>")
    for miss in ("any", "all"):
        got = {}
        for bound in (200_000, 2):
            monkeypatch.setattr(scoring, "LOCAL_WEIGHTS", bound)
            got[bound] = sorted(map(str, scoring.node_scores(nodes, ["id", "pos"], weights, 2, miss=miss).collect()))
        assert got[2] == got[200_000] and len(got[2]) == 6
    rows = {(r["id"], r["pos"]): list(r["scores"]) for r in scoring.node_scores(nodes, ["id", "pos"], weights, 2).collect()}
    assert rows == {(1, 0): [9.5, 15.25], (1, 1): [0.5, 0.25], (2, 0): [8, 16], (2, 1): [8, 16], (3, 0): [8, 16], (None, 0): [2.5, -1.75]}
