"""Ranked lexical search: postings compressed by shard, merged document at a time, best documents of each item.

``build`` deals the documents to shards of about ``SHARD_BYTES`` of text, each made in one task without a shuffle. A shard is
one row: its documents by rising doc_id with their lengths, a sorted dictionary of terms, and for each term its postings as
gaps between document numbers and frequencies, all in variable bytes. Terms are 64-bit hashes of their bytes: only a clash
with a term of an item could change a result.

``search`` takes the items in blocks of about ``BLOCK_TERMS`` terms, so what is sent to the tasks has a bound. A first pass
sums the blocks' document frequencies over the shards. The second one merges, for each item and shard, the item's postings
document at a time by a heap of cursors (k-way), with a heap of the best documents keyed by score, then doc_id. Once that
heap is full, lists that together cannot lift a document into it are no longer merged but looked up for the documents that
the other lists name; this leaves out no document that belongs into the result. A window merges the shards' results.

Null texts and texts without a term are no documents: they count in nothing and are never found. Items without a term, or
whose terms occur nowhere, have no rows. Rows that share a doc_id are documents of their own, equal ones have equal scores in
no stated order; a null doc_id is found as null, after all others at equal scores. Rows that share an item_id are one item
with the terms of all; a null item_id is an item. Very long texts are indexed whole. Empty tables give no rows. Other columns
are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.llm import varbytes
from sinolex.llm.common import durable, hash_text_words

TOP = 10
SHARD_BYTES = 8_000_000
BLOCK_TERMS = 200_000
NO_ID = (1 << 63) - 1

_LETTERS = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Every byte that is no part of a term becomes a space, A-Z become a-z.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b in _LETTERS else 32 for b in range(256))


def terms_of(text: str | None) -> np.ndarray:
    """Hashes of the terms of a text in order."""
    return hash_text_words(text.encode("utf-8", "surrogatepass").translate(FOLD)) if text else np.empty(0, np.uint64)


SHARD = "n_docs long, n_tokens long, ids binary, sizes binary, terms binary, dfs binary, steps binary, step_ends binary, tfs binary, tf_ends binary"


def make_shard(ids: list[int], docs: list[np.ndarray]) -> dict:
    """One row of the index from documents and their terms."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    sizes = np.array([len(docs[i]) for i in order], np.int64)
    words = np.concatenate([docs[i] for i in order])
    names, at = np.unique(words, return_inverse=True)
    # one number for each (term, document), so that a sort brings equal ones together
    pairs, tf = np.unique(at.astype(np.int64) * len(order) + np.repeat(np.arange(len(order)), sizes), return_counts=True)
    term, doc = np.divmod(pairs, len(order))
    df = np.bincount(term, minlength=len(names))
    firsts = np.cumsum(df) - df
    last = firsts + df - 1
    steps, step_ends = varbytes.pack(varbytes.gaps(doc, firsts))
    tfs, tf_ends = varbytes.pack(tf)
    return {
        "n_docs": len(order), "n_tokens": int(sizes.sum()), "ids": np.array(ids, np.int64)[order].tobytes(), "sizes": varbytes.pack(sizes)[0], "terms": names.tobytes(), "dfs": varbytes.pack(df)[0],
        "steps": steps, "step_ends": varbytes.pack(varbytes.gaps(step_ends[last], np.array([0])))[0], "tfs": tfs, "tf_ends": varbytes.pack(varbytes.gaps(tf_ends[last], np.array([0])))[0],
    }


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index: a row for each shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, terms, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch["id"], batch["text"], strict=True):
                found = terms_of(t)
                if not len(found):
                    continue
                ids.append(i), terms.append(found)
                size += len(t)
                if size >= shard_bytes:
                    yield pd.DataFrame([make_shard(ids, terms)])
                    ids, terms, size = [], [], 0
        if ids:
            yield pd.DataFrame([make_shard(ids, terms)])

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text}`").alias("text")).where("text != ''")
    return rows.mapInPandas(run, SHARD)


def items_of(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of each item that has any, as hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "term": [np.unique(terms_of(t)).view(np.int64) for t in batch["text"]]})

    rows = durable(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).withColumn("row", F.monotonically_increasing_id()))
    named = rows.where("text != ''").select("row", "text").mapInPandas(run, "row long, term array<long>")
    own = named.join(rows.select("row", "item_id"), "row").select("item_id", F.explode("term").alias("term"))
    return own.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def postings(shard, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Which of the sorted ``wanted`` terms the shard holds, with the documents and frequencies of each."""
    names = np.frombuffer(shard.terms, np.uint64)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    held = np.flatnonzero(names[at] == wanted)
    rows = at[held]
    if not len(rows):
        return held, [], []
    df = varbytes.unpack(shard.dfs)[rows]
    out = []
    for data, ends in ((shard.steps, shard.step_ends), (shard.tfs, shard.tf_ends)):
        ends = np.concatenate(([0], np.cumsum(varbytes.unpack(ends))))
        sizes = ends[rows + 1] - ends[rows]
        place = np.arange(int(sizes.sum())) + np.repeat(ends[rows] - (np.cumsum(sizes) - sizes), sizes)
        out.append(varbytes.unpack(np.frombuffer(data, np.uint8)[place]))
    firsts = np.cumsum(df) - df
    docs = varbytes.undo_gaps(out[0], firsts, df)
    return held, np.split(docs, firsts[1:]), np.split(out[1], firsts[1:])


def merge(lists: list[tuple[list[int], list[int], int]], ids: list[int], best: list[tuple[int, int]], top: int) -> None:
    """Puts a shard's documents with high scores into the heap ``best`` of (score, -doc_id).

    A list holds documents in order, what each adds to the score, and the most that it adds.
    """
    lists.sort(key=lambda x: x[2])
    reach = [0]
    for x in lists:
        reach.append(reach[-1] + x[2])
    at = [0] * len(lists)
    #: Lists before this one cannot lift a document into the heap on their own.
    rest = 0
    floor = best[0][0] if len(best) == top else 0
    while rest < len(lists) and reach[rest + 1] < floor:
        rest += 1
    heap = [(lists[i][0][0], i) for i in range(rest, len(lists))]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            i = heap[0][1]
            docs, adds, _ = lists[i]
            k = at[i]
            score += adds[k]
            at[i] = k = k + 1
            if k < len(docs):
                heapq.heapreplace(heap, (docs[k], i))
            else:
                heapq.heappop(heap)
        for i in range(rest - 1, -1, -1):
            if score + reach[i + 1] < floor:
                break
            docs, adds, _ = lists[i]
            at[i] = k = bisect_left(docs, doc, at[i])
            if k < len(docs) and docs[k] == doc:
                score += adds[k]
        if score <= 0:
            continue
        entry = (score, -ids[doc])
        if len(best) < top:
            heapq.heappush(best, entry)
            if len(best) < top:
                continue
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        else:
            continue
        floor = best[0][0]
        old = rest
        while rest < len(lists) and reach[rest + 1] < floor:
            rest += 1
        if rest != old:
            heap = [x for x in heap if x[1] >= rest]
            heapq.heapify(heap)


def search_block(index: DataFrame, block: list[tuple[object, list[int]]], n_docs: int, n_tokens: int, item_type: str, top: int) -> DataFrame:
    """(item_id, doc_id, score) of each task's best documents for the items of a block."""
    spark = index.sparkSession
    wanted = np.unique(np.concatenate([np.array(t, np.int64) for _, t in block]).view(np.uint64))
    asked = [np.searchsorted(wanted, np.array(t, np.int64).view(np.uint64)).tolist() for _, t in block]

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for shard in batch.itertuples(index=False):
                names = np.frombuffer(shard.terms, np.uint64)
                at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                total += np.where(names[at] == wanted, varbytes.unpack(shard.dfs)[at], 0)
        own = np.flatnonzero(total)
        yield pd.DataFrame({"at": own, "df": total[own]})

    df = np.zeros(len(wanted), np.int64)
    for r in index.select("terms", "dfs").mapInPandas(held, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():  # at most a block's terms
        df[r["at"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for batch in batches:
            for shard in batch.itertuples(index=False):
                held, docs, tfs = postings(shard, wanted)
                ids = np.frombuffer(shard.ids, np.int64).tolist()
                m = 100 - 90 + (90 * varbytes.unpack(shard.sizes) * n_docs) // n_tokens
                lists = {}
                for t, d, tf in zip(held.tolist(), docs, tfs, strict=True):
                    adds = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[d]))
                    lists[t] = d.tolist(), adds.tolist(), int(adds.max())
                for item, heap in zip(asked, best, strict=True):
                    if own := [lists[t] for t in item if t in lists]:
                        merge(own, ids, heap, top)
        rows = [(q, -doc, score) for q, heap in enumerate(best) for score, doc in heap]
        yield pd.DataFrame(rows, columns=["q", "doc_id", "score"])

    found = index.mapInPandas(run, "q int, doc_id long, score long")
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q int, item_id {item_type}")
    return found.join(F.broadcast(names), "q").select("item_id", "doc_id", "score")  # at most a block's items


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest scores above 0 of each item, equal ones by doc_id."""
    spark = items.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_tokens").alias("l")).first()
    asked = durable(items_of(items, item_id, text))
    n_terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n_blocks = -(-n_terms // block_terms)
    found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    if size["n"]:
        for b in range(n_blocks):
            block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect()  # about BLOCK_TERMS terms
            if block:
                found = found.union(search_block(index, [(r["item_id"], r["terms"]) for r in block], size["n"], size["l"], kind, top))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
