"""Scores, languages, media, pages and the language model."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinolex.llm import html, langid, lm, media, quality, toxicity
from sinolex.llm.common import hash_text_words, id_bucket

RNG = random.Random(5)


def made(syllables, n):
    return " ".join("".join(RNG.choice(syllables) for _ in range(RNG.randint(1, 3))) for _ in range(n)) + "."


EN, DE = ["the", "and", "ing", "er", "th", "on"], ["sch", "ein", "lich", "ung", "ä", "ver"]
AWKWARD = [(1000, None, None, None), (1001, "", "en", None), (1002, " 12 !! ", None, "s"), (None, "the and ing", "en", "s"), (2**60 + 1, "the thing", "en", "s")]


def test_word_hashes_follow_the_words():
    a, b = hash_text_words("Ab  c\tdé ab\n".encode()), hash_text_words("c ab Ab dé".encode())
    assert a[0] == b[2] and a[1] == b[0] and a[2] == b[3] and a[3] == b[1] and len(set(a.tolist())) == 4
    assert len(hash_text_words(b"")) == len(hash_text_words(b" \n")) == 0
    words = [f"{i}x{j}" for i in range(200) for j in range(50)]
    assert len(set(hash_text_words(" ".join(words).encode()).tolist())) == len(words)


def test_language(docs_of):
    rows = [(i, made(EN if i % 2 else DE, 30), "en" if i % 2 else "de", "s") for i in range(80)] + AWKWARD
    docs = docs_of(rows)
    found = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs.where(id_bucket("doc_id", 4) != 2))).collect()}
    assert all(found[i]["lang_pred"] == rows[i][2] and 0 <= found[i]["score"] <= 1 for i in range(80))
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and 2**60 + 1 in found and None in found
    clash = docs.withColumn("lang_pred", F.lit(1)).withColumn("__text", F.lit(2)).withColumn("__k0", F.lit(3))
    assert langid.predict(clash, {}).columns == [*docs.columns, "__text", "__k0", "lang_pred", "score"]
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}


def test_encoder_doesnt_depend_on_its_store(monkeypatch):
    texts = [made(EN + DE, 60) for _ in range(6)]
    whole = [langid.Encoder().encode(t) for t in texts]
    monkeypatch.setattr(langid, "CACHE_ROWS", 150)
    small = langid.Encoder()
    assert all(np.allclose(small.encode(t), v, atol=1e-5) for t, v in zip(texts, whole, strict=True))


def labelled(n, good, bad):
    return [(i, bad() if i % 3 == 0 else good(), "en", "s") for i in range(n)], [(i, int(i % 3 != 0)) for i in range(n)]


def test_quality(spark, docs_of):
    rows, labels = labelled(240, lambda: made(EN, 60), lambda: " ".join(w + "%%%" for w in made(EN, 60).split()))
    docs = docs_of(rows + AWKWARD)
    lab = spark.createDataFrame(labels, "doc_id long, quality int").where(id_bucket("doc_id", 5) != 0)
    sample = quality.sample(docs, lab, "quality", 50)
    assert sample == quality.sample(docs.repartition(5), lab, "quality", 50) and len(sample) == 100
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.Model(sample), ["doc_id"]).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.95
    assert set(got) >= {1000, 1001, None, 2**60 + 1} and all(0 <= s <= 1 for s in got.values())
    assert {r["score"] for r in quality.score(docs, quality.Model([]), ["doc_id"]).collect()} == {0.5}
    assert quality.sample(docs_of([]), lab, "quality") == []


def test_toxicity(docs_of):
    def toxic():
        w = made(EN, 80).split()
        for _ in range(2):
            w.insert(RNG.randrange(len(w)), RNG.choice(["blorb", "Grack,", "zuff!"]))
        return " ".join(w)

    texts = [(toxic(), 1) if i % 3 == 0 else (made(EN, 80), 0) for i in range(360)]
    model = toxicity.Model(texts)
    fresh = [(toxic(), 1) if i % 2 == 0 else (made(EN, 80), 0) for i in range(100)] + [(made(EN, 500) + " grack " + made(EN, 500), 1)]
    docs = docs_of([(i, t, "en", "s") for i, (t, _) in enumerate(fresh)] + AWKWARD)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, (_, y) in enumerate(fresh)]) > 0.95
    assert len(got) == len(fresh) + len(AWKWARD) and all(0 <= s <= 1 for s in got.values())
    assert {r["score"] for r in toxicity.score(docs, toxicity.Model([]), ["doc_id"]).collect()} == {0.5}


def test_gradients_of_the_network():
    model = toxicity.Model([("bad one two", 1), ("good three four", 0)] * 8)
    words = [b"", b"bad", b"one", b"two", b"odd"]
    rows = np.array([model.vocabulary.get(w, 0) for w in words])
    pieces = [toxicity.char_rows(w) for w in words]
    grid, mask, _ = model.lay([np.array([1, 2, 3]), np.array([4, 1])])
    y = np.array([1.0, 0.0])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def vectors():
        return np.concatenate((model.p["word"][rows], toxicity.trigram_mean(words, model.p["char"])), 1)

    def loss():
        q = toxicity.sigmoid(model.forward(vectors(), grid, mask))
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    grads = model.backward(grid, mask, y, rows, pieces)
    for name, place in (("inf", (2, 3)), ("ub", (1, 14)), ("v", (4,)), ("w", (7,)), ("ab", (2,)), ("uf", (0, 13)), ("word", (rows[1], 0)), ("char", (int(pieces[1][0]), 2))):
        p, step = model.p[name], 1e-2
        p[place] += step
        up = loss()
        p[place] -= 2 * step
        down = loss()
        p[place] += step
        assert abs((up - down) / (2 * step) - grads[name][place]) < 2e-4 + 0.05 * abs(grads[name][place]), name


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 36, 37, 100, 1003):
        starts = toxicity.windows(n)
        assert {w for s in starts for w in range(s, s + toxicity.WINDOW)} >= set(range(n))


def test_media_round_trip(docs_of):
    texts = ["", "a", "x" * 575, "y" * 576, "z" * 577, "é" * 1000, made(EN, 3000), "a"]
    docs = docs_of([(i, t, "en", "s") for i, t in enumerate(texts)] + [(99, None, "en", "s"), (None, "a", "en", "s")])
    got = {r["doc_id"]: r for r in media.digest(media.encode(docs, ["doc_id"]), ["doc_id"]).collect()}
    for i, t in [*enumerate(texts), (99, "")]:
        data = t.encode()
        pad = data + b"\xff" * (576 - len(data) if not data else -len(data) % 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        assert r["media_bytes"] == len(pad) + 44 and media.from_wav(media.to_wav(pad)) == pad
    assert got[1]["feature"] == got[7]["feature"] == got[None]["feature"] != got[2]["feature"]
    stored = media.encode(docs, ["doc_id"]).where("doc_id = 6").first()
    assert hashlib.sha256(bytes(stored["media"])).hexdigest() == got[6]["media_sha256"] and list(stored["times"]) == sorted(stored["times"])


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Menu</a></li></ul></nav><header>Site</header><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><h1>Head &amp; line</h1><p>One <b>bold</b>
 word&nbsp;here<br>next &lt;tag&gt;<p>Two&#33;<div class="ad">Buy</div><aside>Side</aside><form>Name<input></form></p>
<section class="comments"><p>I disagree</p></section></article><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    url = "https://a.example/1"
    rows = [(1, url, PAGE), (2, None, None), (3, url, ""), (4, url, "plain words only"), (4, url, "plain words only"), (5, url, "<p>a<p>b")]
    boiler = " ".join(f"b{i}" for i in range(20))
    rows += [(10 + i, "http://u@B.example:80/x?y", f"<div>{boiler}</div><div>story {i} alone</div>") for i in range(5)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("host", F.lit(1))
    got = {}
    for r in html.extract(docs).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[1] == ["Head & line\nOne bold word here\nnext <tag>\nTwo!"]
    assert got[2] == [""] and got[3] == [""] and got[4] == ["plain words only"] * 2 and got[5] == ["a\nb"]
    assert all(got[10 + i] == [f"story {i} alone"] for i in range(5))
    assert html.extract(docs.limit(0)).collect() == []


def test_html_wrappers_named_after_furniture(spark):
    wrapped = {c: f'<div class="{c}"><article><p>Text</p></article></div>' for c in ("content has-sidebar", "content-sidebar-wrap", "no-sidebar", "with-header", "content sidebar")}
    assert all(html.blocks(p)[0] == ["Text"] for p in wrapped.values())
    inner = '<article><div class="article-header"><h1>Head</h1></div><section id="related-work"><p>Before</p></section><div class="related"><article>Teaser</article></div><div class="cookie-notice">Cookies</div></article>'
    assert html.blocks(inner)[0] == ["Head", "Before"]
    # comment sections and elements of furniture stay furniture
    for around in ('<div class="comments">{}</div>', '<section id="comments"><div>{}</div></section>', "<aside>{}</aside>", '<nav class="x">{}</nav>'):
        assert html.blocks(around.format("<article>Reply</article>")) == ([], [("Reply", True)])
    docs = spark.createDataFrame([(i, "http://w.example", p) for i, p in enumerate(wrapped.values())], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract(docs).collect()} == {"Text"}


def test_html_marks_on_every_element():
    def text(inner):
        return html.blocks(f"<article>{inner}</article>")[0]

    assert text('<p class="ad">x</p><p>y</p>') == ["y"] and text('<p>x<br>y<p class="ad">z<br>zz</p>w') == ["x", "y", "w"]
    assert text('<section id="related-work"><p>k</p></section><div class="share-price">s</div>') == ["k", "s"]
    assert text('One <span class="ad">Buy <span>now</span> it</span> word<p class="promo-box">pro<p>Next') == ["One word", "pro", "Next"]
    assert text('One <span class="promo">Buy</span> word<p class="sponsored">pro<p>Next') == ["One word", "Next"]
    assert text('<ul class="menu"><li>a</li></ul><ul><li class="ad">q<li>w</ul>') == ["w"] and text("A <a role='share' href=x>Share</a> B") == ["A B"]
    assert text('<h1 class="header">T</h1><pre>x <span class="comment"># c</span></pre><li class=comments>no') == ["T", "x # c"]
    assert text("1 < 2 <b title='>'>&lt;b&gt;</b> <6") == ["1 < 2 <b> <6"]


def test_html_reads_broken_pages_in_one_pass():
    import time

    for page in ('<a "x' * 200_000, "<a<a" * 200_000, "<div>" * 50_000 + "</section>" * 50_000, "<!--" * 200_000, "<script>" * 100_000, "<" * 500_000, '<p class="' + "advert_" * 100_000 + '!">x', "<a class  " * 100_000):
        began = time.time()
        html.blocks(page)
        assert time.time() - began < 5, page[:20]
    long = "<article>" + "<p>some words</p>" * 50_000 + "</article>"
    assert len(html.blocks(long)[0]) == 50_000


def random_page(rng, shared):
    """HTML with its main blocks and its others (text, furniture)."""
    parts, main, rest = [], [], []

    def words(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    def block(inside, marked=False):
        text = rng.choice(shared) if rng.random() < 0.4 else words(rng.randint(1, 12))
        tag = rng.choice(["p", "div", "h2", "blockquote"])
        if marked or rng.random() < 0.2:
            rest.append((text, True))
            return f'<{tag} class="{rng.choice(["ad", "cookie-notice", "x comments", "share"])}">{text}</{tag}>'
        (main.append(text) if inside else rest.append((text, False)))
        return f"<{tag} class=plain>{text.replace(' ', rng.choice([' ', ' <b>', '  ', chr(10)]), 1)}</{tag}>"

    nav = words(5)
    rest.append((nav, True))
    parts.append(f"<!doctype html><html><body><nav><a href=/>{nav}</a></nav><script>if (a<b) p('<p>no</p>')</script>")
    parts += [block(False) for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.5:
        parts.append("<article>" + "".join(block(True) for _ in range(rng.randint(0, 4))) + "</article>")
    parts += [block(False) for _ in range(rng.randint(0, 3))]
    parts.append("</body></html>")
    return "".join(parts), main, rest


@pytest.mark.parametrize("array_bytes", [1_000_000, 0, 4000])
def test_html_against_brute_force(spark, monkeypatch, array_bytes):
    monkeypatch.setattr(html, "ARRAY_BYTES", array_bytes)
    rng = random.Random(array_bytes)
    shared = [" ".join(f"s{k}x{i}" for i in range(rng.randint(3, 20))) for k in range(12)]
    pages = [(i, f"https://h{rng.randrange(5)}.example/{i}", *random_page(rng, shared)) for i in range(90)]
    rows = spark.createDataFrame([(i, url, page) for i, url, page, *_ in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(rows).collect()}
    streams = {i: (url.split("/")[2], [w for text, _ in rest for w in text.split()]) for i, url, _, _, rest in pages}

    def runs(i):
        words = streams[i][1]
        return [tuple(words[k : k + html.MIN_RUN]) for k in range(len(words) - html.MIN_RUN + 1)]

    held = Counter((streams[i][0], run) for i, *_ in pages for run in set(runs(i)))
    decided = 0
    for i, _, _, main, rest in pages:
        cover = set()
        for k, run in enumerate(runs(i)):
            if held[streams[i][0], run] > 1:
                cover |= set(range(k, k + html.MIN_RUN))
        kept, at = [], 0
        for text, furniture in rest:
            n = len(text.split())
            if not furniture and sum(w in cover for w in range(at, at + n)) < html.COVERED * n:
                kept.append(text)
            at += n
        decided += not main and len(kept) < sum(not f for _, f in rest)
        assert got[i] == "\n".join(main or kept), i
    assert decided > 5


def test_html_query_on_the_small_table(spark):
    import html as entities
    import re

    from sinolex.llm import queries

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op5_html(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|br|h1)>", inner)]
        want = "\n".join(b for b in want if b)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (want, len(want), p["url"])


def test_html_runs_of_a_large_host(spark, monkeypatch):
    rng = random.Random(3)
    notices = [" ".join(f"n{k}x{i}" for i in range(12)) for k in range(40)]
    # each notice is on two pages of the host, once a run over two blocks; an article page is one of the two for some
    rows = []
    for i in range(80):
        k = i % 40
        notice = f"<div>{notices[k]}</div>" if k % 3 else f"<div>{notices[k][: len(notices[k]) // 2]}</div><div>{notices[k][len(notices[k]) // 2 :]}</div>"
        body = f"<p>story {i} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) + "</p>"
        rows.append((i, "http://big.example/p", notice + (f"<article>{body}</article>" if i % 7 == 0 else body)))
    rows += [(None, "http://big.example/p", f"<p>{'same words on both rows of this page ' * 2}</p>")] * 2 + [(90, "http://other.example", f"<p>{notices[1]}</p>"), (2**60 + 1, "http://big.example/q", None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)

    def texts():
        return sorted((-1 if r["page_id"] is None else r["page_id"], r["text"]) for r in html.extract(docs).collect())

    whole = texts()
    monkeypatch.setattr(html, "ARRAY_BYTES", 300)
    assert texts() == whole and len(whole) == len(rows)
    got = dict(whole)
    assert all(got[i].startswith(f"story {i} ") and "\n" not in got[i] for i in range(80))
    assert got[-1] == "" and got[90] == notices[1] and got[2**60 + 1] == ""


def test_html_pairs_on_a_host_of_many_pages(spark):
    notice = " ".join(f"n{i}" for i in range(12))
    docs = spark.createDataFrame([(i, "http://big.example", f"<p>{notice} k{i // 2} {notice.replace('n', f'v{i // 2}n')}</p><p>{i} is alone</p>") for i in range(1202)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(docs).collect()} == {i: f"{i} is alone" for i in range(1202)}


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(1)
    for n, length in ((200, 3), (60, 8), (5, 8), (0, 2)):
        tokens, pages = rng.integers(0, 3, n), np.sort(rng.integers(0, 6, n))
        pages_of = {}
        for i in range(n - length + 1):
            if pages[i] == pages[i + length - 1]:
                pages_of.setdefault(tuple(tokens[i : i + length]), set()).add(int(pages[i]))
        want = np.zeros(n, bool)
        for i in range(n - length + 1):
            if pages[i] == pages[i + length - 1] and len(pages_of[tuple(tokens[i : i + length])]) > 1:
                want[i : i + length] = True
        assert (html.repeated(tokens, pages, length) == want).all()


def small_hmm(n=6, seed=2):
    hmm = lm.Hmm(np.arange(1.0, n + 1))
    rng = np.random.default_rng(seed)
    hmm.start, hmm.move = rng.dirichlet(np.ones(lm.STATES)), rng.dirichlet(np.ones(lm.STATES), lm.STATES)
    hmm.emit = rng.dirichlet(np.arange(1.0, n + 1), lm.STATES).T + 1e-3
    hmm.emit /= hmm.emit.sum(axis=0)
    return hmm.ready()


@pytest.mark.parametrize("block", [3, 1_000_000])
def test_forward_is_exact(monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    hmm = small_hmm()
    texts = [np.array([0, 3, 5, 1, 1]), np.array([2]), np.empty(0, np.int64), np.arange(40) % 6]
    for x, got in zip(texts, hmm.logprob(texts), strict=True):
        a, total = hmm.start, 0.0
        for i, s in enumerate(x):
            a = (a @ hmm.move if i else a) * hmm.emit[s]
        total = math.log10(a.sum()) if len(x) else 0.0
        assert abs(got - total) < 1e-4
    assert hmm.logprob([]).tolist() == [] and hmm.expect([])[0].sum() == 0


@pytest.mark.parametrize("block", [1, 2, 1_000_000])
def test_expected_counts_by_enumeration(monkeypatch, block):
    from itertools import product

    monkeypatch.setattr(lm, "BLOCK", block)
    hmm, x = small_hmm(), np.array([0, 3, 5, 3])
    start, move, emit = np.zeros(lm.STATES), np.zeros((lm.STATES, lm.STATES)), np.zeros((6, lm.STATES))
    total = 0.0
    for z in product(range(lm.STATES), repeat=len(x)):
        p = hmm.start[z[0]] * hmm.emit[x[0], z[0]]
        for i in range(1, len(x)):
            p *= hmm.move[z[i - 1], z[i]] * hmm.emit[x[i], z[i]]
        total += p
        start[z[0]] += p
        for i in range(1, len(x)):
            move[z[i - 1], z[i]] += p
        for i in range(len(x)):
            emit[x[i], z[i]] += p
    got = hmm.expect([np.array([1]), x])
    one = hmm.expect([np.array([1])])
    for a, b, c in zip(got, one, (start, move, emit), strict=True):
        assert np.allclose(a - b, c / total, atol=1e-4)


def test_whole_texts_are_trained_on_as_in_one_block(monkeypatch):
    rng = np.random.default_rng(4)
    hmm, texts = small_hmm(), [rng.integers(0, 6, n) for n in (700, 3, 0, 41, 41, 1300)]
    whole = hmm.expect(texts)
    monkeypatch.setattr(lm, "BLOCK", 100)
    for a, b in zip(whole, hmm.expect(texts), strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-3)
    assert abs(whole[2].sum() - sum(map(len, texts))) < 0.1 and abs(whole[1].sum() - sum(len(x) - 1 for x in texts if len(x))) < 0.1


def test_neighbour_counts_give_the_states():
    rng, groups = np.random.default_rng(0), np.arange(6)
    emit = np.repeat(np.array([[0.5, 0.5, 0, 0, 0, 0], [0, 0, 0.5, 0.5, 0, 0], [0, 0, 0, 0, 0.5, 0.5]]), 1, axis=0)
    move, pairs, z = np.array([[0.1, 0.9, 0], [0, 0.1, 0.9], [0.9, 0, 0.1]]), np.zeros((6, 6)), 0
    last = 0
    for _ in range(20_000):
        z = rng.choice(3, p=move[z])
        s = rng.choice(6, p=emit[z])
        pairs[last, s] += 1
        last = s
    hmm = lm.Hmm(pairs.sum(0) + 1)
    hmm.fit_pairs(pairs, groups)
    model = hmm.emit @ (hmm.start[:, None] * hmm.move) @ hmm.emit.T
    assert np.abs(model - pairs / pairs.sum()).max() < 0.01


def test_shares_of_a_class_add_up_to_one():
    rng = np.random.default_rng(1)
    counts = [rng.integers(1, 6, rng.integers(0, 30)) for _ in range(8)]
    every = np.concatenate(counts)
    n1, n2 = int((every == 1).sum()), int((every == 2).sum())
    words = np.array([len(c) for c in counts], float)
    shares = lm.Shares(np.array([c.sum() for c in counts], float), words, n1, n2)
    for b, c in enumerate(counts):
        assert abs(sum(10 ** shares.log(b, int(k)) for k in c) + max(1, len(c)) * 10 ** shares.log(b, 0) - 1) < 1e-9
    assert lm.Shares(np.zeros(3), np.zeros(3), 0, 0).log(1, 0) == 0


@pytest.mark.parametrize(("share", "least"), [(1e-6, 4), (0.01, 2), (1e-6, 10**9)])
def test_language_model(docs_of, monkeypatch, share, least):
    monkeypatch.setattr(lm, "SHARE", share)
    monkeypatch.setattr(lm, "LEAST", least)
    # an open vocabulary: every fifth word is new
    rows = [(i, " ".join(w if RNG.random() < 0.8 else f"{w}{RNG.randrange(10**9)}" for w in made(EN if i % 2 else DE, RNG.randint(0, 60)).split()), "en", "s") for i in range(240)]
    rows += [*AWKWARD, (3, "other text", "en", "s"), (4, "twice twice", "en", "s"), (4, "twice twice", "en", "s")]
    docs = docs_of(rows).withColumn("__train", F.lit(1)).withColumn("key", F.lit("k"))
    got = lm.score(docs, id_bucket("doc_id", 7) != 2, lambda i: id_bucket(i, 7) == 2).collect()

    def tokens(t):
        return [*(t or "").encode().lower().split(), b" "]

    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    scored = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["n_known"] for r in scored) < 0.9 * sum(r["n_tokens"] for r in scored)
    if (share, least) == (1e-6, 4):  # as in production
        assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)
    assert all(r["score"] < 0 for r in got)


def test_language_model_reads_a_very_long_text_whole(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 500)
    rows = [(i, made(EN, 40), "en", "s") for i in range(30)] + [(99, made(EN, 9000), "en", "s")]
    small = {r["doc_id"]: r["score"] for r in lm.score(docs_of(rows), F.lit(True), lambda i: F.lit(False)).collect()}
    monkeypatch.setattr(lm, "BLOCK", 1_000_000)
    whole = {r["doc_id"]: r["score"] for r in lm.score(docs_of(rows), F.lit(True), lambda i: F.lit(False)).collect()}
    assert all(abs(small[i] - whole[i]) < 1e-3 * abs(whole[i]) for i in whole)


def test_language_model_without_rows(docs_of):
    assert lm.score(docs_of([]), F.lit(True), lambda i: F.lit(False)).collect() == []
    rows = lm.score(docs_of(["a b", None]), F.lit(False), lambda i: F.lit(True)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
