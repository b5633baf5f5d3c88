"""Collocations by vertical positional lists.

Documents are dealt to shards of about ``SHARD_BYTES`` of one language. A shard numbers its words in order, with a gap after
each piece, so neighbours in a piece have neighbouring numbers and no others. Its word lists (where each word stands) are
joined with the words that are frequent in the whole corpus. Then phrases grow by a word at a time: in each shard the sorted
occurrences of the frequent phrases of k words, moved on by k, are merge-joined with the sorted word postings; each pair of a
phrase and the word behind it gives a list, whose length is its exact frequency in the shard. Spark sums the lengths over
the shards and keeps the lists of phrases that are frequent in the corpus. As a part of a phrase is at least as frequent,
none is missed. Up to ``BROADCAST_ROWS`` frequent words or phrases are known to the tasks, so a shard's lists never leave
its row; more are joined with the lists. The results are the same.

The score of a phrase is that of its weakest cut, floor(1000 * a * n / (l * r)) in 38-digit decimals. A phrase is dropped if
a candidate one word longer that holds it is as frequent; longer ones need no look, as what lies between is as frequent too.

Null texts are empty, a null language is ``und``. Texts without words give nothing. Very long texts are cut into no parts: a
text is in one shard whole. Repeated rows and ids count each time; doc_id is not read, nor is any other column, so names
cannot clash. Equal scores go by frequency, then by the phrase's bytes. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.llm import varbytes
from sinolex.llm.common import durable, hash_spans, mix64, small_batches, spans

LEAST = 100
LONGEST = 5
TOP = 2000
SHARD_BYTES = 6_000_000
#: Frequent words, or phrases of one length, up to which they are sent to the tasks; more meet the shards' lists in a join.
BROADCAST_ROWS = 500_000
#: Pairs of a phrase and a word that a task sums before it sends them, and places for each bucket of pairs.
PAIRS_AT_ONCE = 4_000_000
BUCKET_PLACES = 1_000_000

#: A-Z to a-z, marks between pieces and line breaks to one line break, tabs to spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256))


def positions(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of folded bytes: starts and ends of the words, their hashes, and their numbers with a gap after each piece."""
    raw = np.frombuffer(data, np.uint8)
    breaks = raw == 10
    starts, ends = spans(breaks | (raw == 32))
    pieces = np.cumsum(breaks)[starts] if len(starts) else np.empty(0, np.int64)
    return starts, ends, hash_spans(raw, starts, ends), np.arange(len(starts)) + pieces


def gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some stretches one after the other, and their offsets."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return raw[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)], offsets.astype(np.int32)


def binaries(data: np.ndarray | bytes, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data if isinstance(data, bytes) else data.tobytes())])


def chunks(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, int, bytes]]:
    """(lang, shard, folded bytes): a task's texts by language in stretches of about so many bytes."""
    part, count = TaskContext.get().partitionId(), 0
    texts: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            own = text.as_buffer().to_pybytes()
            texts.setdefault(lang, []).append(own)
            sizes[lang] = sizes.get(lang, 0) + len(own)
            if sizes[lang] >= shard_bytes:
                yield lang, part << 32 | count, b"\n".join(texts.pop(lang)).translate(FOLD)
                sizes[lang], count = 0, count + 1
    for lang, own in texts.items():
        yield lang, part << 32 | count, b"\n".join(own).translate(FOLD)
        count += 1


def word_lists(docs: DataFrame, lists: bool, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, shard, word, n) of each shard's words, with ``at``, their packed numbers, if ``lists``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard, data in chunks(batches, shard_bytes):
            starts, ends, hashes, at = positions(data)
            if not len(starts):
                continue
            _, first, of, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            words = binaries(*gather(np.frombuffer(data, np.uint8), starts[first], ends[first] - starts[first]), pa.string())
            columns = [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), shard)), words, pa.array(n)]
            if lists:
                columns.append(packed(at[np.argsort(of, kind="stable")], n))
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "shard", "word", "n", "at"][: len(columns)])

    return docs.mapInArrow(run, "lang string, shard long, word string, n long" + ", at binary" * lists)


def shards_of_known(docs: DataFrame, known: dict[str, dict[bytes, int]], shard_bytes: int) -> DataFrame:
    """Shards with the lists of the known words, made where the texts are."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard, data in chunks(batches, shard_bytes):
            starts, ends, hashes, at = positions(data)
            ids = shared.value.get(lang, {})
            _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
            own = np.array([ids.get(data[i:j], -1) for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)
            held = np.flatnonzero(own[of] >= 0) if len(own) else np.empty(0, np.int64)
            if len(held):
                yield shard_row(lang, shard, *listed(own[of[held]], at[held]), b"", b"", b"")

    return docs.mapInArrow(run, SHARD)


SHARD = "lang string, shard long, word_ids binary, word_n binary, word_at binary, phrase_ids binary, phrase_n binary, phrase_at binary"


def shard_row(lang: str, shard: int, *lists: bytes) -> pa.RecordBatch:
    columns = [pa.array([lang], pa.string()), pa.array([shard], pa.int64()), *(pa.array([x], pa.binary()) for x in lists)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in SHARD.split(", ")])


def listed(ids: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Distinct ids, the lengths of their lists, and the packed lists, from rising places with an id each."""
    by = np.argsort(ids, kind="stable")
    names, n = np.unique(ids, return_counts=True)
    return names.tobytes(), n.tobytes(), varbytes.pack(varbytes.gaps(at[by], np.cumsum(n) - n))[0]


def packed(at: np.ndarray, n: np.ndarray, rising: bool = True) -> pa.Array:
    """Lists of numbers, rising ones as steps, as bytes; ``n`` are their lengths."""
    firsts = np.cumsum(n) - n
    data, ends = varbytes.pack(varbytes.gaps(at, firsts) if rising else at)
    return binaries(data, np.concatenate(([0], ends[firsts + n - 1])), pa.binary())


def numbered(df: DataFrame) -> DataFrame:
    """With dense numbers ``id`` from 0, kept so that every use sees the same ones. Only the sizes of partitions are collected."""
    kept = durable(df.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes, before = {r["part"]: r["n"] for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}, 0
    rows = []
    for k in sorted(sizes):
        rows.append((k, before))
        before += sizes[k]
    offsets = df.sparkSession.createDataFrame(rows, "part long, before long")
    inside = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("part", part.cast("long")).join(F.broadcast(offsets), "part").withColumn("id", F.col("before") + inside).drop("part", "before")  # a row for each partition


def bundled(lists: DataFrame) -> DataFrame:
    """One row for each shard: its phrases' ids, lengths and lists (``level`` 1), and those of its words (``level`` 0)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"lang": [rows["lang"].iloc[0]], "shard": [rows["shard"].iloc[0]]}
        for level, name in ((0, "word"), (1, "phrase")):
            own = rows[rows["level"] == level]
            out |= {f"{name}_ids": [own["id"].to_numpy(np.int64).tobytes()], f"{name}_n": [own["n"].to_numpy(np.int64).tobytes()], f"{name}_at": [b"".join(own["at"])]}
        return pd.DataFrame(out)

    return lists.groupBy("lang", "shard").applyInPandas(run, SHARD)


def sorted_places(ids: bytes, n: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of some lists in order of place, with the ids of whose they are."""
    sizes = np.frombuffer(n, np.int64)
    place = varbytes.undo_gaps(varbytes.unpack(at), np.cumsum(sizes) - sizes, sizes) if len(sizes) else np.empty(0, np.int64)
    by = np.argsort(place, kind="stable")
    return place[by], np.repeat(np.frombuffer(ids, np.int64), sizes)[by]


def extensions(r: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: phrases of k words, the words behind them, and where they begin, sorted by phrase, word and place."""
    word_at, words = sorted_places(r["word_ids"], r["word_n"], r["word_at"])
    at, phrases = (word_at, words) if k == 1 else sorted_places(r["phrase_ids"], r["phrase_n"], r["phrase_at"])
    if not len(at) or not len(word_at):
        return (np.empty(0, np.int64),) * 3
    # both sides are sorted: a merge join of the places k behind a phrase with those of words
    other = np.minimum(np.searchsorted(word_at, at + k), len(word_at) - 1)
    met = np.flatnonzero(word_at[other] == at + k)
    p, w, place = phrases[met], words[other[met]], at[met]
    by = np.lexsort((w, p))  # stable: places stay in order
    return p[by], w[by], place[by]


def runs(p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal neighbours of sorted pairs begin, and how many they are."""
    firsts = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])))) if len(p) else np.empty(0, np.int64)
    return firsts, np.diff(np.append(firsts, len(p)))


def summed(p: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order with their summed counts."""
    by = np.lexsort((w, p))
    p, w, n = p[by], w[by], n[by]
    firsts, _ = runs(p, w)
    return p[firsts], w[firsts], np.add.reduceat(n, firsts) if len(n) else n


def pair_counts(shards: DataFrame, k: int, least: int, buckets: int) -> DataFrame:
    """(p, w, f) of the phrases that are frequent in the corpus: a phrase of k words and the word behind it.

    A task sums the list lengths of its shards. Its pairs go to buckets by hash, sorted and packed in a row for each bucket,
    which takes about three bytes a pair; a bucket's rows are summed in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def ship() -> Iterator[pa.RecordBatch]:
            p, w, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bucket = (mix64(p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            p, w, n, bucket = p[by], w[by], n[by], bucket[by]
            firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
            sizes = np.diff(np.append(firsts, len(bucket)))
            new_p = np.concatenate(([True], np.diff(p) != 0))
            new_p[firsts] = True
            steps = packed(p, sizes), packed(np.where(new_p, w, np.diff(w, prepend=0)), sizes, False), packed(n, sizes, False)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[firsts]), *steps], names=["bucket", "p", "w", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                p, w, _ = extensions(r, k)
                if len(p):
                    firsts, n = runs(p, w)
                    held.append((p[firsts], w[firsts], n))
                    size += len(n)
                    if size >= PAIRS_AT_ONCE:
                        yield from ship()
                        held, size = [], 0
        if held:
            yield from ship()

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for p, w, n in zip(rows["p"], rows["w"], rows["n"], strict=True):
            p, w = np.cumsum(varbytes.unpack(p)), varbytes.unpack(w)
            new = np.flatnonzero(np.diff(p, prepend=-1))
            parts.append((p, varbytes.undo_gaps(w, new, np.diff(np.append(new, len(p)))), varbytes.unpack(n)))
        p, w, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        often = n >= least
        return pd.DataFrame({"p": p[often], "w": w[often], "f": n[often]})

    sent = shards.mapInArrow(run, "bucket long, p binary, w binary, n binary")
    return sent.groupBy("bucket").applyInPandas(total, "p long, w long, f long")


def grown_known(shards: DataFrame, k: int, p: np.ndarray, w: np.ndarray, ids: np.ndarray) -> DataFrame:
    """The shards with the lists of known phrases of k + 1 words in place of those of k."""
    by = np.lexsort((w, p))
    shared = shards.sparkSession.sparkContext.broadcast((p[by], w[by], ids[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, behind, ids = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                own, word, place = extensions(r, k)
                firsts, n = runs(own, word)
                a, b = own[firsts], word[firsts]
                # sorted pairs among sorted pairs: the stretch of the phrase, then the word in it
                low, high = np.searchsorted(names, a), np.searchsorted(names, a, "right")
                while len(live := np.flatnonzero(low < high)):
                    middle = (low[live] + high[live]) // 2
                    less = behind[middle] < b[live]
                    low[live[less]], high[live[~less]] = middle[less] + 1, middle[~less]
                low = np.minimum(low, max(len(names) - 1, 0))
                found = np.where((names[low] == a) & (behind[low] == b), ids[low], -1) if len(names) else np.full(len(a), -1)
                of = np.repeat(found, n)
                kept = np.flatnonzero(of >= 0)
                order = kept[np.argsort(place[kept], kind="stable")]
                yield shard_row(r["lang"], r["shard"], r["word_ids"], r["word_n"], r["word_at"], *listed(of[order], place[order]))

    return shards.mapInArrow(run, SHARD)


def grown_joined(shards: DataFrame, k: int, sums: DataFrame) -> DataFrame:
    """As ``grown_known``, with any number of phrases: the shards' lists meet them by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p, w, place = extensions(r, k)
                if len(p):
                    firsts, n = runs(p, w)
                    columns = [pa.array([r["lang"]] * len(n), pa.string()), pa.array(np.full(len(n), r["shard"])), pa.array(p[firsts]), pa.array(w[firsts]), pa.array(n), packed(place, n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "shard", "p", "w", "n", "at"])

    lists = shards.mapInArrow(run, "lang string, shard long, p long, w long, n long, at binary").join(sums.select("p", "w", "id"), ["p", "w"])
    own = bundled(lists.select("lang", "shard", F.lit(1).alias("level"), "id", "n", "at")).drop("word_ids", "word_n", "word_at")
    return shards.select("lang", "shard", "word_ids", "word_n", "word_at").join(own, ["lang", "shard"])


def frequent(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, len, f) of the phrases of up to ``longest`` words with f >= ``least``, and (lang, n) of all words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).where("text != ''")
    counts = word_lists(rows, False, shard_bytes).groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = durable(counts.groupBy("lang", F.when(F.col("f") >= least, F.col("word")).alias("word")).agg(F.sum("f").alias("f")))
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = numbered(counts.where("word is not null"))
    n_words, n_places = words.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    if n_words <= BROADCAST_ROWS:
        known: dict[str, dict[bytes, int]] = {}
        for r in words.select("lang", "word", "id").toArrow().to_pylist():
            known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
        shards = shards_of_known(rows, known, shard_bytes)
    else:
        ones = word_lists(rows, True, shard_bytes).join(words.select("lang", "word", "id"), ["lang", "word"])
        shards = bundled(ones.select("lang", "shard", F.lit(0).alias("level"), "id", "n", "at"))
    shards = durable(shards)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_places // BUCKET_PLACES)
    level = words.select("lang", "id", F.col("word").alias("phrase"), "f")
    found = level.select("lang", "phrase", F.lit(1).alias("len"), "f")
    for k in range(1, longest):
        sums = numbered(pair_counts(shards, k, least, buckets))
        before, behind = level.select("lang", F.col("id").alias("p"), "phrase"), words.select(F.col("id").alias("w"), "word")
        level = durable(sums.join(before, "p").join(behind, "w").select("lang", "id", F.concat_ws(" ", "phrase", "word").alias("phrase"), "f"))
        found = found.union(level.select("lang", "phrase", F.lit(k + 1), "f"))
        if k + 1 < longest:
            if sums.count() <= BROADCAST_ROWS:
                pairs = sums.select("p", "w", "id").toArrow()
                shards = durable(grown_known(shards, k, *(pairs.column(c).to_numpy().astype(np.int64) for c in ("p", "w", "id"))))
            else:
                shards = durable(grown_joined(shards, k, sums))
    return found, total


def cuts(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, len, a, k, head, tail): every way to cut a phrase of two words or more in two."""
    w = F.split("phrase", " ")
    rows = phrases.where("len > 1").select("lang", "phrase", "len", F.col("f").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    return rows.select("lang", "phrase", "len", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("len") - F.col("k")), " ").alias("tail"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    found, total = frequent(docs, lang, text, least, longest, shard_bytes)
    found = durable(found)
    f = found.select("lang", "phrase", "f")
    ways = cuts(found)
    scored = ways.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(F.broadcast(total) if total.count() <= BROADCAST_ROWS else total, "lang")
    # 19 and 18 digits: the products have 37 and are exact
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # the first cut leaves all but the first word, the last one all but the last
    inside = ways.where("len > 2 and (k = 1 or k = len - 1)").select("lang", F.explode(F.array(F.when(F.col("k") == 1, F.col("tail")), F.when(F.col("k") == F.col("len") - 1, F.col("head")))).alias("phrase"), "a").where("phrase is not null")
    kept = best.join(inside, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
