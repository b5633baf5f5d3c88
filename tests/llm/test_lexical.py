"""Search, WARC bundles and phrases against brute force, with awkward rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sinolex.llm import phrases, queries, search, varbytes, warc

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(60)] + ["Été", "naïve", "x1", "漢字"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text(n):
    return " ".join(RNG.choice(VOCABULARY[: RNG.randint(2, len(VOCABULARY))]) for _ in range(n))


def test_numbers_in_few_bytes():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**35, 2**62], np.int64)
    data, ends = varbytes.pack(values)
    assert varbytes.unpack(data).tolist() == values.tolist() and ends[-1] == len(data) and ends[:3].tolist() == [1, 2, 3]
    assert varbytes.pack(np.empty(0, np.int64))[0] == b"" and len(varbytes.unpack(b"")) == 0
    firsts, sizes = np.array([0, 3]), np.array([3, 2])
    steps = varbytes.gaps(np.array([2, 5, 9, 1, 4]), firsts)
    assert steps.tolist() == [2, 3, 4, 1, 3] and varbytes.undo_gaps(steps, firsts, sizes).tolist() == [2, 5, 9, 1, 4]


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def ranked(rows, items, top=10):
    """(item, rank, score) with all doc_ids that may stand there, by scoring every document."""
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, n_terms = len(docs), sum(sum(d.values()) for _, d in docs)
    df = Counter(w for _, d in docs for w in d)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, d in docs:
            m = 100 - 90 + (90 * sum(d.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * d[w]) // (1000 * d[w] + 8 * m)) for w in words if w in d)
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return out


DOCS = [(i, text(RNG.randint(1, 60))) for i in range(150)] + [(200 + i, "same words here, same score") for i in range(30)] + [(300, None), (301, ""), (302, "  ,.!"), (None, "same words here, same score"), (303, text(5000)), (7, text(20)), (-4, "x1-X1_x1 ÉTÉ")]
ITEMS = [(1, text(8)), (2, "same score"), (3, "W1 w2, W1!"), (4, None), (5, "--"), (6, "nowhere"), (None, "été naïve"), (7, text(3)), (7, text(3)), (8, " ".join(VOCABULARY))]


@pytest.mark.parametrize(("shard_bytes", "block_terms"), [(search.SHARD_BYTES, search.BLOCK_TERMS), (300, 5), (1, 1000)])
def test_search_against_all_documents(spark, shard_bytes, block_terms):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("rank", F.lit("mine")).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("q", F.lit(1)).withColumn("terms", F.lit("t"))
    found = search.search(search.build(docs, shard_bytes=shard_bytes), items, block_terms=block_terms)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(ranked(DOCS, ITEMS), key=repr)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_of_nothing(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(search.build(none), items).collect() == []
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert search.search(search.build(docs), items.limit(0)).collect() == []
    named = spark.createDataFrame([("a", "same score")], "item_id string, text string")
    assert [r["doc_id"] for r in search.search(search.build(docs), named, top=3).collect()] == [200, 201, 202]


def test_merge_looks_up_what_it_need_not_merge():
    rng = np.random.default_rng(1)
    for _ in range(60):
        ids = np.sort(rng.choice(1000, 80, replace=False)).tolist()
        lists, total = [], Counter()
        for _ in range(rng.integers(1, 7)):
            docs = np.sort(rng.choice(80, rng.integers(1, 80), replace=False)).tolist()
            adds = rng.integers(0, 2 ** int(rng.integers(1, 6)), len(docs)).tolist()
            lists.append((docs, adds, max(adds)))
            total.update(dict(zip(docs, adds, strict=True)))
        best = []
        search.merge(lists, ids, best, 5)
        assert sorted(best, reverse=True) == sorted(((s, -ids[d]) for d, s in total.items() if s), reverse=True)[:5]


PAGES = [(i, f"http://h/{i % 7}", f"<p>{text(RNG.randint(0, 80))}</p>") for i in range(60)]
PAGES += [(100 + i, f"http://c/{i}?q=a b%20c", "<p>copy</p>") for i in range(40)] + [(200, None, None), (201, "u", ""), (None, "n", "<p>copy</p>"), (None, "n", "alone"), (None, "n", "alone"), (203, "line\r\nbreak é", "x\r\n\r\ny"), (204, "big", "é" * 400_000), (5, "http://h/5", PAGES[5][2])]


def bundles(spark, rows=PAGES, **size):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("salt", F.lit("s")).withColumn("owner", F.lit(2))
    return warc.write(pages.repartition(3), **size).persist()


@pytest.mark.parametrize("size", [{}, {"frame_bytes": 200, "bundle_bytes": 1000}])
def test_warc_round_trip(spark, size):
    made = bundles(spark, **size)
    got = warc.read(made).collect()
    assert len(got) == len(PAGES)
    groups = defaultdict(list)
    for page, url, html in PAGES:
        shown = url and url.replace("\r", "%0D").replace("\n", "%0A")
        groups[html or ""].append((page is not None, page or 0, url is not None, url or "", page, shown))
    left = Counter()
    for html, rows in groups.items():
        top = max(rows)
        payload = html.encode()
        for k, row in enumerate(sorted(rows, reverse=True)):
            kind = ("response", None) if k == 0 else ("revisit", None if top[4] is None else str(top[4]))
            left[(None if row[4] is None else str(row[4]), row[5], *kind, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload if k == 0 else None)] += 1
    assert left == Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in got)
    assert len({r["record_id"] for r in got}) == len(got)


def test_bundles_are_seekable_and_indexed(spark):
    made = bundles(spark, frame_bytes=500, bundle_bytes=4000)
    rows = made.collect()
    assert len(rows) > 3 and len({r["bundle"] for r in rows}) == len(rows)
    for r in rows:
        data = bytes(r["data"])
        table = warc.seek_table(data)
        # any reader sees one file: frames one after the other, the seek table being skipped
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole == b"".join(warc.frame(data, table, k) for k in range(len(table))) and whole.startswith(b"WARC/1.1\r\n")
        for e in r["entries"]:
            record = warc.frame(data, table, e["frame"])[e["offset"] : e["offset"] + e["length"]]
            assert record.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {e['record_id']}\r\n".encode() in record
    every = {r["record_id"]: r for r in warc.read(made).collect()}
    some = sorted(every)[::5]
    found = warc.fetch(made, spark.createDataFrame([(i,) for i in [*some, some[0], "<urn:page:none>"]], "record_id string")).collect()
    assert {r["record_id"]: r for r in found} == {i: every[i] for i in some} and len(found) == len(some)


def test_bundles_as_files(spark, tmp_path):
    made = bundles(spark)
    for r in made.collect():
        (tmp_path / r["bundle"]).write_bytes(bytes(r["data"]))
    back = warc.read(warc.read_files(spark, str(tmp_path)))
    assert sorted(back.collect(), key=repr) == sorted(warc.read(made).collect(), key=repr)
    with pytest.raises(ValueError):
        warc.seek_table(b"no seek table here")
    assert warc.read(bundles(spark, [])).collect() == []


def test_page_ids_of_any_text(spark):
    ids = ["a:b", "", None, "x\r\ny", "é %3A", "-"]
    pages = spark.createDataFrame([(i, "http://u/a%20b?c=d e", f"html {k}") for k, i in enumerate(ids)] + [("z", None, "html 0")], "page_id string, url string, html string")
    got = {bytes(r["payload"]).decode() if r["payload"] else None: (r["page_id"], r["url"], r["refers_to"]) for r in warc.read(warc.write(pages)).collect()}
    assert [got[f"html {k}"][0] for k in range(1, 6)] == ids[1:] and got["html 1"][1] == "http://u/a%20b?c=d e"
    assert got["html 0"] == ("z", None, None) and got[None] == ("a:b", "http://u/a%20b?c=d e", "z")


def test_damaged_payloads_are_seen():
    name, record = warc.make_record("1", "u", warc.payload_digest(b"good"), 4, 0, None, b"good")
    assert warc.row_of(*warc.parse(record)[:2])[0] == "1" and name == warc.parse(record)[0]["WARC-Record-ID"]
    with pytest.raises(ValueError):
        warc.row_of(*warc.parse(record.replace(b"good", b"evil"))[:2])


def collocations(rows, least, longest=5, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {(p[i:j], a) for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
        rows = []
        for p, a in cands.items():
            if any(sub == p and 100 * b >= 100 * a for sub, b in held):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], total[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return out


PHRASES = [("en", text(RNG.randint(0, 60)) + RNG.choice([". ", "\n", ";", ""]) + text(20)) for _ in range(60)] + [(None, "A b,a B\x0bc a b")] * 3 + [("und", "a b c d e f")] * 3
PHRASES += [("de", None), ("de", ""), ("de", " .,\t"), ("de", "é Ü ö"), ("de", "é Ü ö"), ("en", text(4000)), ("en", "of the many of the many of the many")] * 2


@pytest.mark.parametrize(("least", "shard_bytes", "rows_bound"), [(3, phrases.SHARD_BYTES, 500_000), (5, 500, 500_000), (2, 400, 0)])
def test_phrases_against_all_runs(spark, monkeypatch, least, shard_bytes, rows_bound):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", rows_bound)
    docs = spark.createDataFrame(PHRASES, "lang string, text string").withColumn("word", F.lit(1)).withColumn("shard", F.lit("x")).repartition(3)
    got = phrases.collocations(docs, least=least, shard_bytes=shard_bytes)
    assert sorted(map(tuple, got.collect())) == sorted(collocations(PHRASES, least))
    assert least > 3 or any(len(r["phrase"].split()) > 3 for r in got.collect())
    few = phrases.collocations(docs, least=least, longest=3, top=4, shard_bytes=shard_bytes)
    assert sorted(map(tuple, few.collect())) == sorted(collocations(PHRASES, least, 3, 4))


def test_phrase_scores_beyond_64_bits(spark):
    big = 3 * 10**11
    rows = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, len int, f long")
    total = spark.createDataFrame([("en", 9 * 10**12)], "lang string, n long")
    original = phrases.frequent
    try:
        phrases.frequent = lambda *_: (rows, total)
        (got,) = phrases.collocations(rows).collect()
    finally:
        phrases.frequent = original
    assert got["score"] == 1000 * (big - 1) * 9 * 10**12 // big**2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).collect() == []


def test_queries_of_the_operators(spark, tmp_path):
    """The registered queries over a folder of tables, by the same brute force."""
    spark.createDataFrame([(i, t, "en") for i, t in DOCS], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, queries.op11_search(spark, str(tmp_path)).collect()), key=repr) == sorted(ranked(DOCS, ITEMS), key=repr)
    pages = queries.op12_warc(spark, str(tmp_path))
    assert pages.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and pages.count() == len(PAGES)
    assert [r["refers_to"] for r in pages.where("page_id = 110").collect()] == [139]
    assert sorted(map(tuple, queries.op13_phrases(spark, str(tmp_path)).collect())) == sorted(collocations([("en", t) for _, t in DOCS], 100))
