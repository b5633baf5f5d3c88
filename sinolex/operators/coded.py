"""Corpora as blocks of numbered words, for features of words whose index is beyond the bounds of tasks.

A block is what one task reads, up to about BLOCK_WORDS words: its texts as numbers of its own distinct words, and what is known
of these. A feature's number is a 63-bit hash of its spelling, put together from the hashes of its parts, so features that are
spelt alike have the same number wherever they come from (two of 20 million kept ones among 400 million clash with a chance of
about a thousandth); / is 0. Features belong to shards by their number. Blocks and shards exchange rows of packed numbers, one
for each block and shard: no feature of a word or of its neighbours is a row, and none is spelt out but those of the index.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinolex.functions.charset import preprocess_text
from sinolex.operators import crf
from sinolex.operators.automaton import _BACK, _BASE, mixed, powers
from sinolex.operators.crf import numbers, pack, unpack
from sinolex.operators.features import BEFORE, BEHIND, OWN
from sinolex.operators.tables import durable, text_bytes

#: Words of the texts of a block.
BLOCK_WORDS = 1_000_000
#: Features that blocks ask a shard for, over all blocks.
SHARD_FEATURES = 1_000_000
OF_BLOCK = ["sizes", "codes", "names", "facts", "held"]
#: Bits at which facts about a word begin: whether it is known, whether it is no sample, its tag, and bytes of its known ends.
FACTS, MASKS = (0, 1, 2, 18, 34), (1, 1, 0xFFFF, 0xFFFF, 0xFFFF)
START, END, EMPTY = "[START]", "[END]", "/"


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def coded_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(block, word, code, freq, sizes, codes, names): the distinct normalised words of a block and how often they come, and, in one
    row of it without a word, its texts and all its words. Words of texts without a key are counted only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, found = preprocess_text(), re.compile(r"[^\x20\x09-\x0D]+").findall
        block = TaskContext.get().partitionId() << 32

        def fresh() -> tuple[dict[str, int], list[np.ndarray], np.ndarray]:
            names = defaultdict()
            names.default_factory = names.__len__
            return names, [], []

        def rows() -> pa.RecordBatch:
            n = len(names)
            freq = np.bincount(np.concatenate([*held, *loose]), minlength=n)
            texts = [pack(np.array([len(h) for h in held], np.int32)), pack(np.concatenate([*held, np.empty(0, np.int32)]))]
            words = pa.array(names, pa.string())
            columns = [pa.concat_arrays([words, pa.nulls(1, pa.string())]), pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.append(freq, 0).astype(np.int64))]
            columns += [pa.array([None] * n + [x], pa.binary()) for x in (*texts, packed(pa.table({"word": words})))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, block)), *columns], names=["block", "word", "code", "freq", "sizes", "codes", "names"])

        (names, held, loose), size = fresh(), 0
        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = found(clean(t)) if t else []
                if not words:
                    continue
                (held if own else loose).append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= BLOCK_WORDS:
                    yield rows()
                    (names, held, loose), size, block = fresh(), 0, block + 1
        if size:
            yield rows()

    return df.select(F.col(key).isNotNull().alias("own"), text).mapInArrow(run, "block long, word string, code int, freq long, sizes binary, codes binary, names binary")


def counted(rows: DataFrame) -> DataFrame:
    """(word, freq) over all blocks."""
    return rows.where("word is not null").groupBy("word").agg(F.sum("freq").alias("freq"))


def with_facts(rows: DataFrame, info: DataFrame, tag: Column, skipped: DataFrame | None = None) -> DataFrame:
    """(block, sizes, codes, names, facts, held): coded texts, and what ``features.word_info`` says of their words, with each word's tag; words
    of ``skipped`` are context but no samples. Beginnings and endings are noted by their bytes, all but characters in one number."""
    known, gone = F.coalesce("known", F.lit(False)), F.lit(False)
    facts = info.withColumn("tag", tag)
    if skipped is not None:
        facts = facts.join(skipped.select("word", F.lit(True).alias("gone")).distinct(), "word", "left")
        gone = F.coalesce("gone", gone)
    parts = known, gone, F.coalesce("tag", F.lit(0)), F.coalesce(F.octet_length("lft"), F.lit(0)), F.coalesce(F.octet_length("rgt"), F.lit(0))
    one = sum((F.shiftleft(p.cast("long"), shift) for p, shift in zip(parts[1:], FACTS[1:], strict=True)), parts[0].cast("long"))
    bare = ~known & F.col("lft").isNull() & F.col("rgt").isNull() & (F.size("held") > 0)
    facts = facts.select("word", one.alias("facts"), F.when(bare, F.col("held")).alias("held"))
    words = rows.where("word is not null").select(F.col("block").alias("of"), "word", "code").join(facts, "word").select("of", "code", "facts", "held")

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("code")
        held = packed(words.select(["held"])) if words.column("held").null_count < len(words) else None
        return texts.append_column("facts", pa.array([pack(words.column("facts").to_numpy())], pa.binary())).append_column("held", pa.array([held], pa.binary()))

    texts = rows.where("word is null").select("block", "sizes", "codes", "names")
    return texts.groupBy("block").cogroup(words.groupBy("of")).applyInArrow(run, f"block long, {', '.join(f'{c} binary' for c in OF_BLOCK)}")


# Hashes of spellings: that of xy is hash(x) + BASE ** len(x) * hash(y).

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


class Spellings:
    """Hashes of stretches of the bytes of texts."""

    def __init__(self, column: pa.Array):
        self.data, self.at = text_bytes(column)
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * powers(len(self.data), _BASE), out=self.sums[1:])
        self.back = powers(len(self.data) + 1, _BACK)

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (self.sums[starts + sizes] - self.sums[starts]) * self.back[starts]

    def cut(self, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The stretches as texts."""
        ends = np.cumsum(np.append(0, sizes))
        data = self.data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def spelling(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and the lengths of texts; null is as the empty one."""
    texts = Spellings(column)
    sizes = np.diff(texts.at)
    return texts.hashes(texts.at[:-1], sizes), sizes


def number(hashes: np.ndarray) -> np.ndarray:
    """The numbers of features by their hashes; never 0."""
    return np.maximum((mixed(hashes) >> np.uint64(1)).astype(np.int64), 1)


def before(prefixes: list[str], of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The numbers of prefixes[of] before texts that have these hashes."""
    own, sizes = spelling(pa.array(prefixes))
    return number(own[of] + powers(int(sizes.max()) + 1, _BASE)[sizes][of] * hashes)


def found(names: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in sorted names; -1 where they have none. Nothing has the number -1."""
    if not len(names):
        return np.full(asked.shape, -1, np.int32)
    out = np.full(asked.shape, -1, np.int32)
    held = np.flatnonzero(asked.ravel() >= 0)
    held = held[np.argsort(asked.ravel()[held])]  # in order they are found sooner
    keys = asked.ravel()[held]
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    out.ravel()[held] = np.where(names[at] == keys, at, -1)
    return out


class Block:
    """A block's words and neighbours, with the numbers of their features: one row for each distinct one, -1 for none."""

    def __init__(self, sizes: bytes, codes: bytes, names: bytes, facts: bytes, held: bytes | None):
        word, facts = unpacked(names).column("word").combine_chunks(), unpack(facts, np.int64)
        self.sizes, self.codes = (unpack(x, np.int32).astype(np.int64) for x in (sizes, codes))
        n = len(word)
        self.last = np.zeros(len(self.codes), bool)
        self.last[np.cumsum(self.sizes) - 1] = True
        self.first = np.roll(self.last, 1)
        known, gone, self.tags, left, right = (facts >> shift & mask for shift, mask in zip(FACTS, MASKS, strict=True))
        self.known, self.gone = known.astype(bool), gone.astype(bool)
        #: The forms under which words enter features: the word or its beginning, and its ending; w, l, r are 0, 1, 2.
        self.spellings = Spellings(word)
        begin, end = self.spellings.at[:-1], self.spellings.at[1:]
        right = np.where(self.known, 0, right)
        self.begins, self.lengths = np.stack((begin, end - right), axis=1), np.stack((np.where(self.known, end - begin, left), right), axis=1)
        self.kinds = np.stack((np.where(self.known, 0, np.where(left > 0, 1, -1)), np.where(right > 0, 2, -1)), axis=1)
        self.hashes = self.spellings.hashes(self.begins, self.lengths)
        self.powers = powers(int(self.lengths.max(initial=0)) + 2, _BASE)
        self.bare = np.flatnonzero((self.kinds < 0).all(axis=1))
        self.chars = self._chars(word, unpacked(held).column("held").combine_chunks() if held else pa.nulls(n, pa.list_(pa.string())))
        self.own = np.concatenate([self._singles(OWN, "wk"), *[self._char_numbers(names) for names in self.chars]], axis=1)
        self.before, self.behind = self._singles(BEFORE, "vk"), self._singles(BEHIND, "xk")
        self.start, self.end = number(spelling(pa.array([START, END]))[0]).tolist()
        at = np.flatnonzero(~self.last)
        keys, self.pair_of, self.pair_n = np.unique(self.codes[at] * n + self.codes[at + 1], return_inverse=True, return_counts=True)
        self.pre, self.suf = np.divmod(keys, max(n, 1))
        #: Of each word that is not the last of a text its pair with the next.
        self.pair = np.full(len(self.codes), -1, np.int64)
        self.pair[at] = self.pair_of
        self.to_suf, self.to_pre = self._pairs(BEFORE, OWN), self._pairs(OWN, BEHIND)

    def _singles(self, kinds: dict[str, str], unknown: str) -> np.ndarray:
        prefixes = [kinds[k] for k in "wlr"]
        out = np.full(self.kinds.shape, -1, np.int64)
        held = self.kinds >= 0
        out[held] = before(prefixes, self.kinds[held], self.hashes[held])
        out[self.bare, 0] = number(spelling(pa.array([unknown]))[0])[0]
        return out

    def _chars(self, words: pa.Array, chars: pa.Array) -> list[list[str | None]]:
        """Features of the characters of words of which nothing is known, as ``features._own_chars``."""
        texts, held = (x.take(pa.array(self.bare)).to_pylist() for x in (words, chars))
        if not len(self.bare):
            return []
        columns = [["ck" if 1 <= len(w) <= 3 else None for w in texts]]
        for name, i, least in (("c1", 0, 1), ("c2", 1, 2), ("c3", 2, 3), ("c4", 3, 4), ("c6", -1, 5), ("c5", -2, 6)):
            columns.append([name + w[i] if len(w) >= least and w[i] in (h or ()) else None for w, h in zip(texts, held, strict=True)])
        return columns

    def _char_numbers(self, names: list[str | None]) -> np.ndarray:
        out, column = np.full((len(self.known), 1), -1, np.int64), pa.array(names, pa.string())
        out[self.bare, 0] = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, number(spelling(column)[0]))
        return out

    def _forms(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Of pairs the combinations of their forms: column, form before, form behind, and the pairs that have both."""
        for column, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            yield column, i, j, np.flatnonzero((self.kinds[self.pre, i] >= 0) & (self.kinds[self.suf, j] >= 0))

    def _pairs(self, left: dict[str, str], right: dict[str, str]) -> np.ndarray:
        prefixes, star = [left[i] + right[j] for i in "wlr" for j in "wlr"], spelling(pa.array(["*"]))[0][0]
        out = np.full((len(self.pre), 4), -1, np.int64)
        for column, i, j, at in self._forms():
            a, b = self.pre[at], self.suf[at]
            name = self.hashes[a, i] + self.powers[self.lengths[a, i]] * (star + _BASE * self.hashes[b, j])
            out[at, column] = before(prefixes, self.kinds[a, i] * 3 + self.kinds[b, j], name)
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the features of all samples in order, and how often they come; and / in any case."""
        n, open_word = len(self.known), ~self.gone
        sample = open_word[self.codes]
        ahead, behind = np.flatnonzero(self.first < sample), np.flatnonzero(self.last < sample)
        sums = [(self.own, np.bincount(self.codes[sample], minlength=n)), (self.before, np.bincount(self.codes[ahead - 1], minlength=n)), (self.behind, np.bincount(self.codes[behind + 1], minlength=n))]
        sums += [(self.to_suf, self.pair_n * open_word[self.suf]), (self.to_pre, self.pair_n * open_word[self.pre])]
        sums.append((np.array([[self.start], [self.end]]), np.array([(self.first & sample).sum(), (self.last & sample).sum()])))
        keys, freq = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for names, count in sums:
            for column in names.T:
                held = (column >= 0) & (count > 0)
                keys.append(column[held])
                freq.append(count[held])
        keys, freq = np.concatenate(keys), np.concatenate(freq)
        by = np.argsort(keys)
        keys, freq = keys[by], freq[by]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[starts], np.add.reduceat(freq, starts)

    def positions(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the samples: words of each text, features of each word, the places of these in sorted names, and tags."""
        at = np.flatnonzero(~self.gone[self.codes])
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[at]
        code, ahead, behind = self.codes[at], np.flatnonzero(~self.first[at]), np.flatnonzero(~self.last[at])
        own, pre, suf, to_suf, to_pre = (found(names, x) for x in (self.own, self.before, self.behind, self.to_suf, self.to_pre))
        start, end = found(names, np.array([self.start, self.end])).tolist()
        wide = np.cumsum([0, *[x.shape[1] for x in (own, pre, suf, to_suf, to_pre)]])
        rows = np.full((len(at), wide[-1]), -1, np.int32)
        rows[:, : wide[1]] = own[code]
        rows[self.first[at], wide[1]] = start
        rows[self.last[at], wide[2]] = end
        rows[ahead, wide[1] : wide[2]] = pre[self.codes[at[ahead] - 1]]
        rows[behind, wide[2] : wide[3]] = suf[self.codes[at[behind] + 1]]
        rows[ahead, wide[3] : wide[4]] = to_suf[self.pair[at[ahead] - 1]]
        rows[behind, wide[4] :] = to_pre[self.pair[at[behind]]]
        rows[(rows < 0).all(axis=1), 0] = found(names, np.zeros(1, np.int64))[0]
        held = rows >= 0
        return np.bincount(owner, minlength=len(self.sizes)), held.sum(axis=1), rows[held], self.tags[code]

    def spelt(self, asked: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The numbers of features that are asked for and are here, and their spelling."""
        asked = np.sort(asked)
        places, names = [], []
        forms = [self.spellings.cut(self.begins[:, i], self.lengths[:, i]) for i in (0, 1)]

        def add(numbers: np.ndarray, spell) -> None:
            place = found(asked, numbers)
            _, at = np.unique(place, return_index=True)
            at = at[place[at] >= 0]
            places.append(place[at])
            names.append(spell(at))

        for text, one in ((EMPTY, 0), (START, self.start), (END, self.end)):
            add(np.array([one]), lambda at, text=text: pa.array([text] * len(at), pa.string()))
        for kinds, unknown, numbers in ((OWN, "wk", self.own), (BEFORE, "vk", self.before), (BEHIND, "xk", self.behind)):
            prefixes = pa.array([kinds[k] for k in "wlr"])
            for i in (0, 1):
                held = np.flatnonzero(self.kinds[:, i] >= 0)
                add(numbers[held, i], lambda at, held=held, prefixes=prefixes, i=i: pc.binary_join_element_wise(prefixes.take(pa.array(self.kinds[held[at], i])), forms[i].take(pa.array(held[at])), ""))
            add(numbers[self.bare[:1], 0], lambda at, unknown=unknown: pa.array([unknown] * len(at), pa.string()))
        for column, own in enumerate(self.chars, 2):
            add(self.own[self.bare, column], lambda at, own=own: pa.array(own, pa.string()).take(pa.array(at)))
        for left, right, numbers in ((BEFORE, OWN, self.to_suf), (OWN, BEHIND, self.to_pre)):
            prefixes = pa.array([left[i] + right[j] for i in "wlr" for j in "wlr"])
            for column, i, j, held in self._forms():

                def spell(at: np.ndarray, held=held, i=i, j=j, prefixes=prefixes) -> pa.Array:
                    a, b = self.pre[held[at]], self.suf[held[at]]
                    parts = prefixes.take(pa.array(self.kinds[a, i] * 3 + self.kinds[b, j])), forms[i].take(pa.array(a)), pa.array(["*"] * len(at), pa.string()), forms[j].take(pa.array(b))
                    return pc.binary_join_element_wise(*parts, "")

                add(numbers[held, column], spell)
        place, first = np.unique(np.concatenate(places), return_index=True)
        return asked[place], pa.concat_arrays(names).take(pa.array(first))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for block, *columns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield block, Block(*columns)


def _block(rows: pa.Table) -> Block:
    return Block(*[rows.column(c)[0].as_py() for c in OF_BLOCK])


def feature_needs(blocks: DataFrame, least: int, shards: int) -> DataFrame:
    """(block, shard, idx, own): the features of each block that come ``least`` times in all blocks, and those among them that it
    is the one to spell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches):
            keys, freq = held.counts()
            shard = keys % shards
            by = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[by], np.arange(shards + 1))
            keys, freq = keys[by], freq[by].astype(np.int32)
            some = np.flatnonzero(np.diff(ends))
            columns = [pa.array([pack(x[ends[s] : ends[s + 1]], rising) for s in some.tolist()], pa.binary()) for x, rising in ((keys, True), (freq, False))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some.astype(np.int32)), *columns], names=["block", "shard", "idx", "freq"])

    def keep(rows: pa.Table) -> pa.Table:
        keys, sizes = numbers(rows.column("idx"), np.int64, True)
        freq, _ = numbers(rows.column("freq"), np.int32)
        names, first, of = np.unique(keys, return_index=True, return_inverse=True)
        kept = (np.bincount(of, weights=freq) >= least) | (names == 0)
        own = np.zeros(len(keys), bool)
        own[first[kept]] = True
        held, ends = kept[of], np.cumsum(np.append(0, sizes))
        columns = [[pack(x[i:j][held[i:j]], rising) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)] for x, rising in ((keys, True), (own, False))]
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "idx": pa.array(columns[0], pa.binary()), "own": pa.array(columns[1], pa.binary())})

    rows = blocks.mapInArrow(count, "block long, shard int, idx binary, freq binary")
    return rows.groupBy("shard").applyInArrow(keep, "block long, shard int, idx binary, own binary")


def index_of(blocks: DataFrame, needs: DataFrame) -> DataFrame:
    """(feature, idx) of all features that blocks need."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        keys, _ = numbers(asked.column("idx"), np.int64, True)
        own, _ = numbers(asked.column("own"), np.bool_)
        idx, names = _block(block).spelt(keys[own])
        return pa.table({"feature": names, "idx": idx})

    return blocks.groupBy("block").cogroup(needs.groupBy("block")).applyInArrow(run, "feature string, idx long")


def _opened(block: pa.Table, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _block(block).positions(names)


def tag_samples(rows: DataFrame, info: DataFrame, tag: Column, least: int, skipped: DataFrame | None = None) -> tuple[DataFrame, crf.Packed]:
    """The index (feature, idx) of the features of words that come ``least`` times, and samples for ``crf.train``, from coded texts.

    They are those of ``features.tag_features`` and ``lines.feature_numbers``, where only a word without any feature of the
    index has /.
    """
    blocks = durable(with_facts(rows, info, tag, skipped))
    words = rows.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    shards = max(1, -(-2 * words // SHARD_FEATURES))
    needs = durable(feature_needs(blocks, least, shards))
    index = durable(index_of(blocks, needs))
    return index, crf.Packed(blocks, needs.select("block", "shard", "idx"), shards, _opened)
