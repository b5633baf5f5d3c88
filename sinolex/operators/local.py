"""Cutting and tagging as row transforms: features, scores and best tags of whole texts inside the row, without a shuffle.

The tables of a model are compiled to arrays once, in the driver, if their measured size is within the bounds of ``tables``, and
broadcast; a task reads them once. A batch of texts is one long row of characters (or words), and each kind of feature is one
look-up over all of it. The transforms keep all rows and columns and have no state, so they run on batches and streams alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sinolex.functions.charset import preprocess_text
from sinolex.operators import dictionary
from sinolex.operators.automaton import Keys, Trie, code_points, greedy, mixed
from sinolex.operators.tables import fetched, list_sizes, parts, slices, text_bytes

START, END, EMPTY = "[START]", "[END]", "/"
SINGLES = {"c": 0, "b": -1, "a": -2, "z": -3, "d": 1, "e": 2, "f": 3}
PAIRS = {"bc": -1, "ac": -2, "zc": -3, "cd": 1, "ce": 2, "cf": 3}


def weight_rows(table: pa.Table, n_tags: int) -> np.ndarray:
    """Weights by row with one more row of zeros, that of a feature without weights."""
    column = table.column("weights").combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes) + 1, n_tags))
    values = column.flatten().to_numpy(zero_copy_only=False)
    row, k = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = k < n_tags
    out[row[held], k[held]] = values[held]
    return out


class SegmentTable:
    """A segmenter's weights by kind of feature, its words as tries, and the user's words."""

    def __init__(self, weights: pa.Table, words: list[str] | None, bigrams: list[tuple[str, str]] | None, user: list[tuple[str, float]]):
        names = weights.column("feature").to_pylist()
        self.w = weight_rows(weights, 2)
        none = len(names)
        rows = {n: i for i, n in enumerate(names)}
        self.start, self.end, self.empty = (rows.get(n, none) for n in (START, END, EMPTY))
        singles = [(f[0], f[1], i) for f, i in rows.items() if len(f) == 2 and f[0] in SINGLES]
        pairs = [(f[:2], f[2], f[4], i) for f, i in rows.items() if len(f) == 5 and f[3] == "." and f[:2] in PAIRS]
        #: Characters that are in any feature are numbered from 1 on.
        held = sorted({c for _, c, _ in singles} | {c for p in pairs for c in p[1:3]})
        self.number = np.zeros(0x110000, np.int32)
        number = {c: i + 1 for i, c in enumerate(held)}
        self.number[[ord(c) for c in held]] = np.arange(1, len(held) + 1)
        self.single = {k: np.full(len(held) + 1, none, np.int32) for k in SINGLES}
        for k, c, i in singles:
            self.single[k][number[c]] = i
        kinds = {k: n for n, k in enumerate(PAIRS)}
        keys = self.pair_keys(*[np.array(x, np.int64) for x in ([kinds[p[0]] for p in pairs], [number[p[1]] for p in pairs], [number[p[2]] for p in pairs])])
        self.pairs = Keys(keys)
        self.pair_rows = np.append(np.array([p[3] for p in pairs], np.int64)[np.argsort(keys)], none)
        self.words = self.backwards = self.bigrams = None
        if words is not None:
            self.words, self.backwards = Trie(words), Trie([w[::-1] for w in words])
            self.before, self.behind = (np.array([rows.get(k + w, none) for w in words] + [none], np.int64) for k in "vx")
            longest = max(map(len, words), default=0)
            self.lengths = {side: np.array([[rows.get(f"{side}{i}{j}", none) for j in range(longest + 1)] for i in range(longest + 1)], np.int64) for side in ("wl", "wr")}
            if bigrams is not None:
                of = {w: i for i, w in enumerate(words)}
                known = [(of[p], of[s], f"{p}*{s}") for p, s in dict.fromkeys(bigrams) if p in of and s in of]
                keys = self.bigram_keys(*[np.array([k[i] for k in known], np.int64) for i in (0, 1)])
                by = np.argsort(keys)
                self.bigrams = Keys(keys)
                self.bigram_rows = {side: np.array([rows.get(side + known[i][2], none) for i in by] + [none], np.int64) for side in ("wl", "wr")}
        self.user = Trie([w for w, _ in user]) if user else None
        self.boost = np.array([b for _, b in user], float)

    @staticmethod
    def pair_keys(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((kind + 1) << 42 | a << 21 | b)

    @staticmethod
    def bigram_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(a << 32 | b)

    def scores(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The scores (beginning, inside) of characters, whose pieces begin and end at the given places."""
        n, none = len(codes), len(self.w) - 1
        total, missing = np.zeros((n, 2)), np.zeros(n, bool)

        def add(at: np.ndarray, rows: np.ndarray) -> None:
            total[at] += self.w[rows]
            missing[at[rows == none]] = True

        self.visit(codes, begins, ends, add)
        total[missing] += self.w[self.empty]
        if self.user is not None:
            self.add_boosts(codes, ends, total)
        return total

    def numbers(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each character how many features have a number, and the numbers in order; 0 comes first where one has none."""
        none, columns = len(self.w) - 1, []
        missing = np.full(len(codes), -1, np.int64)

        def add(at: np.ndarray, rows: np.ndarray) -> None:
            own = np.full(len(codes), -1, np.int64)
            held = rows != none
            own[at[held]] = idx[rows[held]]
            missing[at[~held]] = 0
            columns.append(own)

        self.visit(codes, begins, ends, add)
        table = np.sort(np.stack([missing, *columns], axis=1), axis=1)
        return (table >= 0).sum(axis=1), table[table >= 0]

    def visit(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, add) -> None:
        """Calls add(places, rows) for each kind of feature; a place has one of a kind at most."""
        n = len(codes)
        here = np.arange(n)
        number = self.number[codes]

        def near(step: int) -> np.ndarray:
            """Places whose neighbour so far away is in their piece."""
            return np.flatnonzero((here + step >= begins) & (here + step < ends))

        firsts, lasts = np.flatnonzero(here == begins), np.flatnonzero(here == ends - 1)
        add(here, self.single["c"][number])
        add(firsts, np.full(len(firsts), self.start))
        add(lasts, np.full(len(lasts), self.end))
        for kind, (pair, step) in enumerate(PAIRS.items()):
            at = near(step)
            other, own = number[at + step], number[at]
            add(at, self.single[pair.replace("c", "")][other])
            a, b = (other, own) if step < 0 else (own, other)
            add(at, self.pair_rows[self.pairs.find(self.pair_keys(np.int64(kind), a.astype(np.int64), b.astype(np.int64)))])
        if self.words is not None:
            self.add_words(codes, begins, ends, near, add)

    def add_words(self, codes, begins, ends, near, add) -> None:
        n = len(codes)
        starting = self.words.longest_at(codes, ends)
        ending = self.backwards.longest_at(codes[::-1], n - begins[::-1])[::-1]
        sizes = self.words.sizes
        for own, rows in ((ending, self.before), (starting, self.behind)):
            at = np.flatnonzero(own >= 0)
            add(at, rows[own[at]])
        for side, step in (("wl", -1), ("wr", 1)):
            at = near(step)
            left, right = (ending[at - 1], starting[at]) if step < 0 else (ending[at], starting[at + 1])
            both = (left >= 0) & (right >= 0)
            at, left, right = at[both], left[both], right[both]
            add(at, self.lengths[side][sizes[left], sizes[right]])
            if self.bigrams is not None:
                found = self.bigrams.find(self.bigram_keys(left, right))
                held = found < len(self.bigrams.keys)
                add(at[held], self.bigram_rows[side][found[held]])

    def add_boosts(self, codes, ends, total) -> None:
        found = self.user.longest_at(codes, ends)
        at = greedy(found, self.user.sizes)
        word = found[at]
        sizes, boost = self.user.sizes[word], self.boost[word]
        np.add.at(total[:, 0], at, boost)
        behind = at + sizes
        inside = behind < ends[at]
        np.add.at(total[:, 0], behind[inside], boost[inside])
        firsts = np.cumsum(sizes) - sizes
        k = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
        np.add.at(total[:, 1], (np.repeat(at, sizes) + k)[k > 0], np.repeat(boost, sizes)[k > 0])


def segment_table(weights: DataFrame, words: DataFrame | None, bigrams: DataFrame | None, word_min: int, word_max: int, user: DataFrame | None) -> SegmentTable | None:
    """The compiled model; None if one of its tables is too large."""
    asked = [(weights, ("feature", "weights"))]
    if words is not None:
        asked.append((words.select("word").where(F.length("word").between(word_min, word_max)).distinct(), ("word",)))
        if bigrams is not None:
            asked.append((bigrams.select("pre", "suf").distinct(), ("pre", "suf")))
    if user is not None:
        asked.append((dictionary.upsert(user), ("word", "weight")))
    if (found := fetched(*asked)) is None:
        return None
    by_columns = {tuple(t.column_names): t for t in found}
    known, pairs, boosts = (by_columns.get(c) for c in (("word",), ("pre", "suf"), ("word", "weight")))
    return SegmentTable(
        found[0], None if known is None else known.column("word").to_pylist(), None if pairs is None else [(r["pre"], r["suf"]) for r in pairs.to_pylist()],
        [(r["word"], float(r["weight"] or 0)) for r in boosts.to_pylist()] if boosts is not None else [],
    )


def number_texts(df: DataFrame, text: str, index: pa.Table) -> DataFrame:
    """The rows of ``df`` without ``text`` but with the feature numbers of its characters, by an index (feature, idx)."""
    idx = index.column("idx").to_numpy().astype(np.int64)
    zeros = pa.FixedSizeListArray.from_arrays(pa.array(np.zeros(2 * len(idx))), 2).cast(pa.list_(pa.float64()))
    shared = df.sparkSession.sparkContext.broadcast((SegmentTable(pa.table({"feature": index.column("feature"), "weights": zeros}), None, None, []), idx))
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, idx = shared.value
        for batch in batches:
            column = batch.column(text)
            for i, j in slices(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)):
                codes, sizes = code_points([t or "" for t in column[i:j].to_pylist()])
                ends = np.cumsum(sizes)
                own, numbers = table.numbers(codes, np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), idx)
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(own))).astype(np.int32)), pa.array(numbers.astype(np.int32)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in kept), lists], names=[*kept, "features"])

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in kept], *StructType.fromDDL("features array<array<int>>").fields]))


TOKENS = "array<struct<word:string,type:string>>"
TOKEN = pa.struct([("word", pa.string()), ("type", pa.string())])


def cut_batch(table: SegmentTable, text: pa.Array, clean: pa.Array, hits: pa.Array) -> pa.Array:
    """Tokens of each text. ``clean`` has as many characters; ``hits`` are stretches that are words with a type."""
    raw, offsets = text_bytes(text)
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    rows = np.searchsorted(leads, offsets)  # of each text its first character
    n = len(leads)
    if not n:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(text) + 1, np.int32)), pa.array([], TOKEN))
    codes = np.frombuffer(text_bytes(clean)[0].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    new = np.zeros(n, bool)
    new[rows[:-1][rows[:-1] < n]] = True
    whole = np.zeros(n, bool)
    of_row = np.repeat(rows[:-1], pc.fill_null(hits.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    stretches = hits.flatten()
    b, e = (stretches.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + of_row for k in ("b", "e"))
    for edge in (b, e):
        new[edge[edge < n]] = True
    sizes = e - b
    whole[np.repeat(b, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = True
    # pieces between hits are scored by themselves
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    own = np.flatnonzero(~whole)
    begins, ends = np.repeat(first, length)[own], np.repeat(first + length, length)[own]
    shift = np.cumsum(whole)[own]  # characters of hits before, which are left out
    scores = table.scores(codes[own], begins - shift, ends - shift)
    new[own[scores[:, 1] <= scores[:, 0]]] = True
    at = np.flatnonzero(new)
    ends_at = np.append(leads[at], len(raw)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends_at), pa.py_buffer(raw.tobytes()))
    kind = np.full(len(at), -1, np.int64)
    kind[np.searchsorted(at, b)] = np.arange(len(b))
    types = stretches.field("t").take(pa.array(np.where(kind < 0, 0, kind), mask=kind < 0)) if len(b) else pa.nulls(len(at), pa.string())
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, rows).astype(np.int32)), pa.StructArray.from_arrays([words, types], ["word", "type"]))


def cut(df: DataFrame, table: SegmentTable, text: str, clean: str, hits: str, out: str) -> DataFrame:
    """The rows of ``df`` without the columns ``clean`` and ``hits`` but with their tokens."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in df.columns if c not in (clean, hits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)):
                tokens = cut_batch(shared.value, *(part.column(c) for c in (text, clean, hits)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), tokens], names=[*kept, out])

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in kept], *StructType.fromDDL(f"`{out}` {TOKENS}").fields]))


SCORES = "array<struct<b:double,i:double>>"


def score(df: DataFrame, table: SegmentTable, clean: str, out: str) -> DataFrame:
    """The rows of ``df`` without the column ``clean`` but with the scores of its characters."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in df.columns if c != clean]

    def scored(column: pa.Array) -> pa.Array:
        codes, sizes = code_points([t or "" for t in column.to_pylist()])
        ends = np.cumsum(sizes)
        s = shared.value.scores(codes, np.repeat(ends - sizes, sizes), np.repeat(ends, sizes))
        pairs = pa.StructArray.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1])], ["b", "i"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(clean)
            sizes = pc.fill_null(pc.utf8_length(given), 0).to_numpy(zero_copy_only=False)
            for i, j in slices(sizes):
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in kept), scored(given[i:j])], names=[*kept, out])

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in kept], *StructType.fromDDL(f"`{out}` {SCORES}").fields]))


class TagTable:
    """A tagger's weights, what it knows of words, and the dictionaries."""

    def __init__(self, weights: pa.Table, tags: list[str], words: list[str], parts: list[str], chars: list[str], fixed: dict[str, str], soft: dict[str, np.ndarray], clean: bool):
        self.rows = {f: i for i, f in enumerate(weights.column("feature").to_pylist())}
        self.w = weight_rows(weights, len(tags))
        self.tags, self.words, self.parts, self.chars, self.fixed, self.soft, self.clean = tags, set(words), set(parts), set(chars), fixed, soft, clean
        self.empty = self.rows.get(EMPTY, len(self.w) - 1)

    def names(self, word: str) -> tuple[str | None, str | None, str | None]:
        """The forms under which a word is known: itself, else its longest known proper beginning and ending."""
        if word in self.words:
            return word, None, None
        cuts = range(min(len(word) - 1, 4), 0, -1)
        return None, next((word[:n] for n in cuts if word[:n] in self.parts), None), next((word[-n:] for n in cuts if word[-n:] in self.parts), None)

    @staticmethod
    def single(names: tuple, kinds: tuple[str, str, str], unknown: str) -> list[str]:
        return [k + x for k, x in zip(kinds, names, strict=True) if x is not None] or [unknown]

    def own_chars(self, word: str) -> list[str]:
        """Features of the characters of a word of which nothing is known."""
        n = len(word)
        places = [("c1", 0, n >= 1), ("c2", 1, n >= 2), ("c3", 2, n >= 3), ("c4", 3, n >= 4), ("c6", n - 1, n >= 5), ("c5", n - 2, n > 5)]
        return ["ck"] * (1 <= n <= 3) + [k + word[i] for k, i, there in places if there and word[i] in self.chars]

    @staticmethod
    def pair(left: tuple, right: tuple, kinds: tuple[str, str, str], others: tuple[str, str, str]) -> list[str]:
        return [f"{a}{b}{x}*{y}" for a, x in zip(kinds, left, strict=True) if x is not None for b, y in zip(others, right, strict=True) if y is not None]

    def summed(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each list of features their summed weights, and whether one has none. The last row is that of no feature."""
        none = len(self.w) - 1
        sizes = np.array([len(x) for x in lists] + [0])
        rows = np.fromiter((self.rows.get(f, none) for x in lists for f in x), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(sizes)), sizes)
        out, missing = np.zeros((len(sizes), self.w.shape[1])), np.zeros(len(sizes), bool)
        np.add.at(out, of, self.w[rows])
        missing[of[rows == none]] = True
        return out, missing

    def tag(self, words: list[str], code: np.ndarray, begins: np.ndarray, ends: np.ndarray, done: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        """Tags as places in a list of names. ``words`` are the distinct words, ``code`` the tokens, in sentences that begin and end as given.

        Tokens that are ``done`` need no tag and are context only; their place is that of the dictionaries, else -1. Features and
        their sums are found once for each form under which words are known, as most words share a few.
        """
        names = sorted(set(self.fixed.values()) | set(self.tags))
        place = {t: i for i, t in enumerate(names)}
        fixed = np.array([place[self.fixed[w]] if w in self.fixed else -1 for w in words], np.int64)
        out = fixed[code]
        at = np.flatnonzero(out < 0 if done is None else (out < 0) & ~done)
        if not len(at):
            return names, out
        numbers: dict[tuple, int] = {}
        form = np.array([numbers.setdefault(self.names(w), len(numbers)) for w in words], np.int64)
        forms, none = list(numbers), numbers.get((None, None, None), -1)
        wanted, which = np.unique(code[at], return_inverse=True)
        own_features: dict[tuple, int] = {}
        mine = [(f, tuple(self.own_chars(words[i])) if f == none else ()) for i, f in zip(wanted.tolist(), form[wanted].tolist(), strict=True)]
        row = np.array([own_features.setdefault(x, len(own_features)) for x in mine], np.int64)[which]
        sums, lost = self.summed([self.single(forms[f], ("w", "cl", "cr"), "wk") + list(more) for f, more in own_features])
        total, missing = sums[row], lost[row]
        sides = ((-1, at > begins[at], ("v", "bl", "br"), "vk", START), (1, at + 1 < ends[at], ("x", "dl", "dr"), "xk", END))
        for step, there, kinds, unknown, edge in sides:
            inner, outer = np.flatnonzero(there), np.flatnonzero(~there)
            sums, lost = self.summed([[edge]])
            total[outer] += sums[0]
            missing[outer] |= lost[0]
            other, own = form[code[at[inner] + step]], form[code[at[inner]]]
            near, which = np.unique(other, return_inverse=True)
            sums, lost = self.summed([self.single(forms[i], kinds, unknown) for i in near.tolist()])
            total[inner] += sums[which]
            missing[inner] |= lost[which]
            both = np.flatnonzero((other != none) & (own != none))
            pairs, which = np.unique(other[both] * len(forms) + own[both], return_inverse=True)
            left, right = np.divmod(pairs, len(forms))
            of_me = ("w", "cl", "cr")
            lists = [self.pair(forms[i], forms[j], kinds, of_me) if step < 0 else self.pair(forms[j], forms[i], of_me, kinds) for i, j in zip(left.tolist(), right.tolist(), strict=True)]
            sums, lost = self.summed(lists)
            total[inner[both]] += sums[which]
            missing[inner[both]] |= lost[which]
        total[missing] += self.w[self.empty]
        for i in (i for i in wanted.tolist() if words[i] in self.soft):
            total[code[at] == i] += self.soft[words[i]]
        out[at] = np.array([place[t] for t in self.tags], np.int64)[total.argmax(axis=1)]
        return names, out


def tag_table(weights: DataFrame, tags: list[str], words: DataFrame, parts: DataFrame, chars: DataFrame, default: DataFrame, hard: DataFrame | None, soft: DataFrame | None, clean: bool = True) -> TagTable | None:
    """The compiled model; None if one of its tables is too large."""
    asked = [(weights, ("feature", "weights")), (words.select("word").distinct(), ("word",)), (parts.select("part").distinct(), ("part",)), (chars.select("ch").distinct(), ("ch",)), (default, ("word", "tag"))]
    asked += [(hard, ("word", "tag"))] * (hard is not None) + [(soft, ("word", "tag", "weight"))] * (soft is not None)
    if (found := fetched(*asked)) is None:
        return None
    w, known, part, ch, *given = found
    fixed = {r["word"]: r["tag"] for t in given if t.num_columns == 2 for r in t.to_pylist() if r["tag"] is not None}
    boosts: dict[str, np.ndarray] = {}
    for r in (r for t in given if t.num_columns == 3 for r in t.to_pylist()):
        if r["tag"] in tags and r["weight"] is not None:
            boosts.setdefault(r["word"], np.zeros(len(tags)))[tags.index(r["tag"])] += r["weight"]
    return TagTable(w, tags, known.column("word").to_pylist(), part.column("part").to_pylist(), ch.column("ch").to_pylist(), fixed, boosts, clean)


TAGGED = "array<struct<word:string,tag:string>>"


def tag_batch(table: TagTable, words: pa.Array, types: pa.Array) -> pa.Array:
    sizes = pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    coded = pc.fill_null(words.flatten(), "").dictionary_encode()
    distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if table.clean and distinct:
        # different words may be one after normalisation
        again = pa.array(map(preprocess_text(), distinct), pa.string()).dictionary_encode()
        distinct, code = again.dictionary.to_pylist(), again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
    kinds = types.flatten().cast(pa.string()) if len(types) else None
    done = None if kinds is None else kinds.is_valid().to_numpy(zero_copy_only=False)
    names, at = table.tag(distinct, code, np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes), done)
    tags = pa.array(names, pa.string()).take(pa.array(at, mask=at < 0)) if len(at) else pa.array([], pa.string())
    if kinds is not None:
        tags = pc.coalesce(kinds, tags)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([words.flatten(), tags], ["word", "tag"]))


def tag(df: DataFrame, table: TagTable, words: str, types: str | None, out: str) -> DataFrame:
    """The rows of ``df`` with their tagged words. ``types`` beside the words go before all tags."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, list_sizes(batch.column(words))):
                kinds = part.column(types) if types else pa.array([], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, tag_batch(shared.value, part.column(words), kinds)], names=[*kept, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{out}` {TAGGED}").fields]))
