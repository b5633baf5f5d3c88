"""Scores, prints and predictions against plain restatements; empty tables, very long texts, clashing names."""

import cmath
import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sinolex.llm import langid, media, quality, toxicity

RNG = random.Random(8)


def made(syllables, n):
    return " ".join("".join(RNG.choice(syllables) for _ in range(RNG.randint(1, 3))) for _ in range(n)) + "."


EN, DE = ["the", "and", "ing", "er", "th", "on"], ["sch", "ein", "lich", "ung", "ä", "ver"]
LONG = made(EN, 30_000)


def test_quality_is_the_difference_of_sizes():
    texts = [(made(EN, 50), 1) for _ in range(30)] + [(made(DE, 50) + "%%%", 0) for _ in range(30)]
    model = quality.Model(texts)
    assert len(model.beta) == 2
    makers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False) for d in model.dictionaries]
    for t in [made(EN, 40), made(DE, 500), "é" * 3000, "x", LONG]:
        data = t.encode()
        good, bad = (sum(len(m.compress(data[i : i + quality.PIECE])) for i in range(0, len(data), quality.PIECE)) for m in makers)
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.beta[0] * (bad - good) / len(data) + model.beta[1])))))
    assert model.score("") == model.score(None) == pytest.approx(1 / (1 + math.exp(-model.beta[1])))
    # a dictionary holds a passage of each of its texts
    assert all(t.encode()[:20] in model.dictionaries[0] or len(t) > 110_000 // 15 for t, y in texts[:30:2])


def plain_prints(samples):
    """Peak pairs by a slow Fourier transform."""
    x = [s - 128 for s in samples]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
    turns = [cmath.exp(-2j * math.pi * k / media.FRAME) for k in range(media.FRAME)]
    peaks = []
    for at in range(0, len(x) - media.FRAME + 1, media.HOP):
        frame = [a * w for a, w in zip(x[at : at + media.FRAME], window)]
        power = [abs(sum(v * turns[k * i % media.FRAME] for i, v in enumerate(frame))) if k > 1 else 0.0 for k in range(media.FRAME // 2 + 1)]
        local = {k: power[k] for k in range(1, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1]}
        peaks.append(sorted(local, key=lambda k: (-round(local[k], 2), k))[: media.PEAKS])
    return sorted((i, a << 20 | b << 8 | gap) for gap in range(1, media.FAN + 1) for i in range(len(peaks) - gap) for a in peaks[i] for b in peaks[i + gap])


def test_prints_by_a_plain_transform():
    for data in (made(EN, 300).encode(), made(DE, 200).encode()):
        samples = media.payload(data)
        times, prints = media.fingerprint(samples)
        assert list(zip(times.tolist(), prints.tolist())) == plain_prints(samples)


def plain_vector(text, dimensions):
    """Bound and permuted letters of each n-gram, summed one by one."""
    codes, gap = [0], True
    for c in text:
        code = ord(c.lower()[0]) if c.isalpha() else 0
        if code or not gap:
            codes.append(code)
        gap = not code
    if not gap:
        codes.append(0)
    encoder, total = langid.Encoder(dimensions), np.zeros(dimensions)
    for i in range(len(codes) - langid.ORDER + 1):
        bound = np.ones(dimensions)
        for k in range(langid.ORDER):
            bound *= np.roll(encoder.letter(codes[i + k]), k)
        total += bound
    return total / np.linalg.norm(total)


def test_languages_by_plain_cosines(spark):
    rows = [(i, made(EN if i % 2 else DE, 20), "en" if i % 2 else "de") for i in range(20)] + [(20, "Ünd, 12 the!", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = langid.train(df, dimensions=500)
    vectors = {i: plain_vector(t, 500) for i, t, _ in rows}
    sums = {name: sum(vectors[i] for i, _, lang in rows if lang == name) for name in ("de", "en")}
    want = {name: v / np.linalg.norm(v) for name, v in sums.items()}
    assert all(np.allclose(prototypes[n], want[n], atol=1e-4) for n in want)
    for r in langid.predict(df, prototypes).collect():
        cosines = {n: float(want[n] @ vectors[r["doc_id"]]) for n in want}
        assert r["score"] == pytest.approx(max(0, *cosines.values()), abs=1e-3) and r["lang_pred"] == max(cosines, key=cosines.get)


def plain_value(model, words):
    """The network's value of one window, a number at a time."""
    p, h = {k: v.astype(float) for k, v in model.p.items()}, toxicity.HIDDEN
    inputs = [np.concatenate((p["word"][model.vocabulary.get(w, 0)], np.mean([p["char"][r] for r in toxicity.char_rows(w)], axis=0))) for w in words]

    def sig(x):
        return 1 / (1 + math.exp(-x))

    def states(xs, side):
        state, out = [0.0] * h, []
        for x in xs:
            a = [sum(x[i] * p["in" + side][i, k] for i in range(len(x))) + p["a" + side][k] for k in range(3 * h)]
            s = [sum(state[i] * p["u" + side][i, k] for i in range(h)) for k in range(3 * h)]
            z = [sig(a[k] + s[k]) for k in range(h)]
            r = [sig(a[h + k] + s[h + k]) for k in range(h)]
            n = [math.tanh(a[2 * h + k] + r[k] * s[2 * h + k]) for k in range(h)]
            state = [n[k] + z[k] * (state[k] - n[k]) for k in range(h)]
            out.append(state)
        return out

    both = [f + b for f, b in zip(states(inputs, "f"), states(inputs[::-1], "b")[::-1])]
    e = [math.exp(sum(x * v for x, v in zip(s, p["v"]))) for s in both]
    pooled = [sum(w * s[k] for w, s in zip(e, both)) / sum(e) for k in range(2 * h)]
    return sum(x * w for x, w in zip(pooled, p["w"])) + float(p["b"][0])


def test_toxicity_by_a_plain_network():
    texts = [(made(EN, 30) + " grack " * (i % 2), i % 2) for i in range(60)]
    model = toxicity.Model(texts)
    scorer = toxicity.Scorer(model)
    for t in (made(EN, 10), made(EN, 30) + " grack odd", made(DE, 60)):
        words = [toxicity.normal(w) for w in toxicity.split(t)]
        value = max(plain_value(model, words[s : s + toxicity.WINDOW]) for s in toxicity.windows(len(words)))
        assert float(scorer.score([t])[0]) == pytest.approx(1 / (1 + math.exp(-(model.slope * value + model.offset))), abs=1e-3)


def test_empty_tables_long_texts_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string"
    texts = [(made(EN, 40), 1) for _ in range(12)] + [(made(DE, 40), 0) for _ in range(12)]
    good, toxic = quality.Model(texts), toxicity.Model(texts)
    prototypes = langid.train(spark.createDataFrame([(i, t, "en" if y else "de") for i, (t, y) in enumerate(texts)], schema))
    none = spark.createDataFrame([], schema)
    assert langid.train(none) == {}
    docs = spark.createDataFrame([(1, LONG, None), (1, LONG, None), (None, None, None)], schema)
    clash = docs.withColumn("score", F.lit("mine")).withColumn("__text", F.lit(1)).withColumn("__k0", F.lit(2)).withColumn("media", F.lit(3)).withColumn("lang_pred", F.lit(4))
    for run in (lambda df: quality.score(df, good, ["doc_id"]), lambda df: toxicity.score(df, toxic, ["doc_id"]), lambda df: langid.predict(df, prototypes, keep=["doc_id"]), lambda df: media.digest(media.encode(df, ["doc_id"]), ["doc_id"])):
        assert run(none).collect() == []
        rows = run(docs).collect()
        assert len(rows) == 3 and sorted(map(repr, rows)) == sorted(map(repr, run(clash).collect()))
        assert len({repr(r) for r in rows if r["doc_id"] == 1}) == 1
