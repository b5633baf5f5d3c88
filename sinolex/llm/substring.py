"""Removal of passages that an earlier document holds, with an FM-index for each shard.

Every window of ``WINDOW`` words has an anchor, the word run of ``ANCHOR`` words in it with the smallest hash. Equal
windows have equal anchors, so windows are dealt to shards by their anchor; only anchors that occur in two documents take
part. A shard holds, in a compressed FM-index, the stretches of words around its anchors from the documents that can own
them, which are all but an anchor's last; the stretches of all but an anchor's first are streamed against it. Backward
search over the wavelet matrix gives, window by window, the smallest indexed document that holds the same words, if any
does. Windows with a smaller document lose their words.

Anchors of more than ``HOT`` documents would fill a shard. Their windows are taken one by one, equal ones are put together
before they are shuffled, and the distinct windows, each with its smallest document, are dealt to shards of their own by
their words, indexed and looked up there once.

Documents of the same words are searched once: all copies but the smallest lose everything if they hold a window.

Null and empty texts have no words. Texts of fewer words than a window keep all. Rows that share a doc_id are no earlier
document for each other. Documents with a null id keep all and take nothing from others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinolex.llm.common import SALTS, durable, hash_runs, hash_text_words, map_texts, with_least
from sinolex.llm.fmindex import FmIndex

WINDOW = 50
ANCHOR = 10
#: Words of a shard, about.
SHARD_WORDS = 100_000
#: Documents of an anchor from which on its windows are dealt by their own words; those of fewer fit in a shard.
HOT = 1000


def anchors(words: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word run, and for each window the place of its anchor (the first at ties)."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = hash_runs(words, size)
    places = np.empty(len(words) - window + 1, np.int64)
    for at in range(0, len(places), 20_000):
        view = np.lib.stride_tricks.sliding_window_view(runs[at : at + 20_000 + window - size], window - size + 1)[: len(places) - at][:20_000]
        places[at : at + 20_000] = at + np.arange(len(view)) + view.argmin(axis=1)
    return runs, places


def stretches(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of windows with anchors of one hash; a repeated phrase is one run."""
    edge = np.flatnonzero(names[1:] != names[:-1]) + 1
    return np.concatenate(([0], edge)), np.concatenate((edge, [len(names)])) - 1


def index_of(owned: dict[bytes, int], window: int) -> tuple[np.ndarray, np.ndarray, FmIndex]:
    """The distinct words and short word runs of the contents, in order, and the index of the contents with their documents."""
    sequences = [np.frombuffer(c, np.uint64) for c in owned]
    whole = np.concatenate(sequences)
    names, flat = np.unique(whole, return_inverse=True)
    numbers = np.split(flat.astype(np.int64) + 1, np.cumsum([len(x) for x in sequences])[:-1])
    return names, np.unique(hash_runs(whole, min(ANCHOR, window))), FmIndex(numbers, window, len(names), list(owned.values()))


def among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value in the ordered ``known``, and whether it is there."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def stream(contents: list[bytes], names: np.ndarray, runs: np.ndarray, index: FmIndex) -> list[np.ndarray]:
    """The smallest indexed document that holds each window of the contents; the largest number where none does.

    Only windows whose short word runs all occur in the index can be found, so only the parts made of such windows are
    searched, where a search seldom fails; words that the index does not hold are number 0, which no match passes.
    """
    flat, sizes = np.frombuffer(b"".join(contents), np.uint64), np.array([len(c) // 8 for c in contents])
    depth, ends = index.depth, np.cumsum(sizes)
    out = np.full(len(flat), np.iinfo(np.int64).max)
    missing = np.concatenate(([0], np.cumsum(~among(hash_runs(flat, min(ANCHOR, depth)), runs)[1])))
    span = depth - min(ANCHOR, depth) + 1
    possible = np.zeros(len(flat), bool)
    possible[: len(missing) - span] = missing[span:] == missing[: len(missing) - span]
    possible &= np.arange(len(flat)) + depth <= np.repeat(ends, sizes)
    edge = np.flatnonzero(np.diff(possible, prepend=False))
    edge = np.append(edge, len(flat)) if len(edge) % 2 else edge
    first, last = edge[::2], edge[1::2]
    at, there = among(flat, names)
    numbers, least = np.where(there, at + 1, 0), np.append(index.least, np.iinfo(np.int64).max)  # -1 means no group
    for i, j, groups in zip(first.tolist(), last.tolist(), index.match([numbers[i : j + depth - 1] for i, j in zip(first, last, strict=True)]) if len(first) else [], strict=True):
        out[i:j] = least[groups]
    return [x[: max(0, len(x) - depth + 1)] for x in np.split(out, ends[:-1])]


def search(rows: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """The windows of a shard's stretches that a smaller document holds: (doc_id, key, windows).

    Of each anchor all but the last document can hold a window first, and all but the first can repeat one: the former
    are indexed, the latter streamed against the index.
    """
    docs = rows["doc_id"]
    by_anchor = docs.groupby(rows["anchor"])
    first, last = (docs > by_anchor.transform("min")).to_numpy(), (docs < by_anchor.transform("max")).to_numpy()
    owned = rows[last].groupby("words", sort=False)["doc_id"].min().to_dict()
    later = rows[first]
    if not owned or later.empty:
        return pd.DataFrame({"doc_id": np.empty(0, np.int64), "key": np.empty(0, np.int64), "windows": []})
    contents = list(dict.fromkeys(later["words"]))
    found = dict(zip(contents, stream(contents, *index_of(owned, window)), strict=True))
    out = []
    for d, key, start, c in zip(later["doc_id"].tolist(), later["key"].tolist(), later["first"].tolist(), later["words"], strict=True):
        hit = np.flatnonzero(found[c] < d)
        if len(hit):
            out.append((d, key, (hit + start).astype(np.int32)))
    return pd.DataFrame(out, columns=["doc_id", "key", "windows"])


def owners(rows: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """The smallest document of each distinct window of a shard: (code, owner)."""
    contents = rows["words"].tolist()
    found = stream(contents, *index_of(dict(zip(contents, rows["least"].tolist(), strict=True)), window))
    return pd.DataFrame({"code": rows["code"], "owner": [int(f[0]) for f in found]})


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("n_words", "n_removed", "kept"), window: int = WINDOW, size: int = ANCHOR) -> DataFrame:
    """Every row with its words, those removed and the text that is kept, joined by one space.

    ``keep``: columns to carry; ``names``: what the three new columns are called.
    """
    keep = keep or []
    carried = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)]
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("key"), F.col(text).alias("text"), *carried)
    plain = docs.select("doc_id", "key", "text")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                words = (t or "").encode("utf-8", "surrogatepass").split()
                d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                rows.append((len(words), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            out = batch[["doc_id", "key"]].copy()
            out[["n", "s1", "s2"]] = rows
            yield out

    signed = plain.where("text is not null and doc_id is not null").mapInPandas(sign, "doc_id long, key long, n long, s1 long, s2 long").where(f"n >= {window}")
    signed = durable(signed.drop("n"))
    copies = durable(with_least(signed, ["s1", "s2"], "doc_id", "first").where("doc_id != first").select("doc_id", "key").distinct())
    few = copies.count() <= 500_000
    texts = plain.where("text is not null and doc_id is not null").join(F.broadcast(copies) if few else copies, ["doc_id", "key"], "left_anti")

    def list_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                runs, places = anchors(hash_text_words(t.encode("utf-8", "surrogatepass")), window, size)
                rows.append(np.unique(runs[places]).view(np.int64))
            out = batch[["doc_id", "key"]].copy()
            out["anchors"] = rows
            yield out[[len(r) > 0 for r in rows]]

    listed = durable(texts.mapInPandas(list_anchors, "doc_id long, key long, anchors array<long>"))
    single = listed.select("doc_id", "key", F.explode("anchors").alias("anchor"))
    shared = single.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("docs")).where("lo != hi").select("anchor", (F.col("docs") > HOT).alias("hot"))
    kinds = [F.collect_list(F.when(F.col("hot") == h, F.col("anchor"))).alias(n) for h, n in ((False, "anchors"), (True, "hot"))]
    hits = durable(single.join(shared, "anchor").groupBy("doc_id", "key").agg(*kinds))
    total, hot = hits.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0)), F.coalesce(F.sum(F.size("hot")), F.lit(0))).first()
    shards = max(1, -(-total * (window + window // 2) // SHARD_WORDS))

    def cut(column: str, whole: bool):
        """Stretches with an anchor of the column, as they are or window by window."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names_out = ["shard", "anchor", "doc_id", "key", "first", "words"]
            for batch in batches:
                out, held = [], 0
                for d, key, t, wanted in zip(batch["doc_id"], batch["key"], batch["text"], batch[column], strict=True):
                    words = hash_text_words(t.encode("utf-8", "surrogatepass"))
                    runs, places = anchors(words, window, size)
                    first, last = stretches(runs[places])
                    names = runs[places[first]]
                    for i in np.flatnonzero(np.isin(names.view(np.int64), wanted)).tolist():
                        shard, anchor = int(names[i] % np.uint64(shards)), int(names[i].view(np.int64))
                        spans = [(int(first[i]), int(last[i]) + window)] if whole else [(at, at + window) for at in range(int(first[i]), int(last[i]) + 1)]
                        for begin, end in spans:
                            out.append((shard, anchor, d, key, begin, words[begin:end].tobytes()))
                            held += end - begin
                    if held > 500_000:
                        yield pd.DataFrame(out, columns=names_out)
                        out, held = [], 0
                yield pd.DataFrame(out, columns=names_out)

        return run

    schema = "shard long, anchor long, doc_id long, key long, first int, words binary"
    found = texts.join(hits, ["doc_id", "key"])
    pieces = found.where("size(anchors) > 0").select("doc_id", "key", "text", "anchors").mapInPandas(cut("anchors", True), schema)
    gone = pieces.groupBy("shard").applyInPandas(lambda rows: search(rows, window), "doc_id long, key long, windows array<int>")
    if hot:
        single = found.where("size(hot) > 0").select("doc_id", "key", "text", "hot").mapInPandas(cut("hot", False), schema)
        distinct = single.groupBy("words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least != most")
        distinct = distinct.select("words", "least", F.xxhash64("words").alias("code"))
        dealt = durable(distinct.withColumn("shard", F.pmod("code", F.lit(max(1, hot * window // SHARD_WORDS)))))
        named = dealt.groupBy("shard").applyInPandas(lambda rows: owners(rows, window), "code long, owner long")
        # the places of one window, which many documents may hold, go to SALTS tasks; its owner is two numbers
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        places = single.select("doc_id", "key", "first", F.xxhash64("words").alias("code"), salt.alias("salt"))
        named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        gone = gone.union(places.join(named, ["code", "salt"]).where("owner < doc_id").groupBy("doc_id", "key").agg(F.collect_list("first").alias("windows")))
    gone = gone.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("windows")).alias("windows"))
    gone = gone.select("doc_id", "key", "windows", F.lit(False).alias("whole")).union(copies.select("doc_id", "key", F.lit(None).cast("array<int>"), F.lit(True)))
    joined = docs.alias("d").join(gone.alias("g"), (F.col("d.doc_id") == F.col("g.doc_id")) & (F.col("d.key") == F.col("g.key")), "left")
    carried = [f"__{i}" for i in range(len(keep))]
    joined = joined.select("d.doc_id", F.struct("text", "windows", "whole").alias("work"), *carried)

    def drop(rows: list[dict]) -> list[tuple[int, int, str]]:
        out = []
        for row in rows:
            words = (row["text"] or "").encode("utf-8", "surrogatepass").split()
            n, lost, starts = len(words), 0, row["windows"]
            if row["whole"]:
                words, lost = [], n
            elif starts is not None and len(starts):
                edge = np.zeros(n + 1, np.int64)
                starts = np.unique(np.asarray(starts))
                edge[starts] += 1
                np.add.at(edge, starts + window, -1)
                cover = np.cumsum(edge[:-1]) > 0
                words, lost = [w for w, c in zip(words, cover.tolist(), strict=True) if not c], int(cover.sum())
            out.append((n, lost, b" ".join(words).decode("utf-8", "surrogatepass")))
        return out

    made = map_texts(joined, ["doc_id", *carried], "work", lambda: drop, "__n long, __lost long, __kept string")
    new = [F.col(c).alias(name) for c, name in zip(("__n", "__lost", "__kept"), names, strict=True)]
    return made.select("doc_id", *[F.col(i).alias(c) for i, c in zip(carried, keep, strict=True)], *new)
