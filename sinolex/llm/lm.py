"""Hidden Markov language model, trained by Baum-Welch with counts summed across partitions.

Words that are at least ``SHARE`` of the training tokens and come ``LEAST`` times are symbols of their own (there can be no
more than 1 / ``SHARE`` of them); all other words stand in ``CLASSES`` classes by word ending. In a class a known word has
the share (count - d) / (class tokens + 1) with the discount d = n1 / (n1 + 2 n2), where n1 and n2 words come once and
twice. What the discounts leave, d * class words + 1, is the mass of unseen words; it is divided among them as if a class
had as many unseen words as known ones, so that a text's probability is that of its spelling. These rules are the same at
every size.

The states start from counts of neighbouring symbols in the whole training corpus, summed by Spark in ``2 * PAIRED`` groups of
symbols, to which a hidden Markov chain of two steps is fitted. Then each Baum-Welch round reads the whole training corpus:
tasks run scaled forward-backward over whole texts and emit expected counts, Spark sums them, and the driver holds one
table of bounded size. A text's score is the exact log10 probability of its token sequence by the scaled forward recursion
with the members' shares, which come from a join with the counts of all training words.

A null text is an empty one: its only token is the end. Without training rows the base is 0 and the score that of an
untrained model. Very long texts are read whole, ``BLOCK`` tokens in memory at a time with exact messages between blocks.
Equal counts are ordered by the word. Repeated rows stay; rows that share a doc_id are told apart by their text. Other
columns of ``docs`` are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinolex.llm.common import durable, lower_words

STATES = 8
#: Least share of the training tokens and least count of a word that is a symbol.
SHARE = 1e-6
LEAST = 4
CLASSES = 2048
#: Most frequent symbols that are counted beside their neighbours one by one; the others are so many groups by word ending.
PAIRED = 256
PAIR_ROUNDS = 60
ROUNDS = 2
#: Tokens whose messages are in memory at once.
BLOCK = 1_200_000
END = b" "  # no word holds a space
PSEUDO = 5.0
NO_ID = 1 << 34


def bucket(word: bytes, n: int = CLASSES) -> int:
    return zlib.crc32(word[-3:]) % n


def count_words(df: DataFrame) -> DataFrame:
    """(w, n) over the texts ``__text``; each text adds one end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["__text"]:
                counts.update(lower_words(text))
                if len(counts) > 250_000:
                    yield pd.DataFrame({"w": list(counts), "n": list(counts.values())})
                    counts = Counter()
            counts[END] += len(batch)
        if counts:
            yield pd.DataFrame({"w": list(counts), "n": list(counts.values())})

    return df.mapInPandas(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Ids(dict):
    """Symbol numbers; a word without one has its class's."""

    def __init__(self, own: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(own))
        self.base = len(own)

    def __missing__(self, word: bytes) -> int:
        return self.base + bucket(word)


class Symbols:
    """Which symbol a token is."""

    def __init__(self, own: list[bytes]):
        self.ids = Ids(own)
        self.n = len(own) + CLASSES

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def groups(self) -> np.ndarray:
        """The group of each symbol in the counts of neighbours."""
        own = [i if i < PAIRED else PAIRED + bucket(w, PAIRED) for i, w in enumerate(self.ids)]
        return np.concatenate((np.array(own, np.int64), PAIRED + np.arange(CLASSES) % PAIRED))

    def __reduce__(self):
        return Symbols, (list(self.ids),)


class Shares:
    """Which share of its class a word has. ``tokens`` and ``words``: of each class; n1, n2: words that come once, twice."""

    def __init__(self, tokens: np.ndarray, words: np.ndarray, n1: int, n2: int):
        self.discount = min(0.95, max(0.1, (n1 + 0.5) / (n1 + 2 * n2 + 1)))
        self.room = tokens + 1.0
        self.unseen_log = np.log10((self.discount * words + 1) / np.maximum(1, words))

    def log(self, b: int, count: int) -> float:
        """log10 of the share of a word of class b with this count."""
        return float((np.log10(count - self.discount) if count else self.unseen_log[b]) - np.log10(self.room[b]))


class Layout:
    """Token sequences step by step: those of step t are ``laid[at[t]:at[t + 1]]``, longest sequences first."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(x) for x in texts], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        self.n, sizes = len(sizes), sizes[: int((sizes > 0).sum())]
        steps = int(sizes[0]) if len(sizes) else 0
        self.live = np.searchsorted(-sizes, -np.arange(steps), side="left")
        self.at = np.concatenate(([0], np.cumsum(self.live)))
        self.laid = np.empty(int(self.at[-1]), np.int32)
        for rank, i in enumerate(self.order[: len(sizes)].tolist()):
            self.laid[self.at[: sizes[rank]] + rank] = texts[i]

    def blocks(self) -> list[tuple[int, int]]:
        """Ranges of steps of about ``BLOCK`` tokens."""
        out, first, steps = [], 0, len(self.live)
        while first < steps:
            last = max(first + 1, int(np.searchsorted(self.at, self.at[first] + BLOCK, side="right")) - 1)
            out.append((first, min(last, steps)))
            first = out[-1][1]
        return out


class Hmm:
    def __init__(self, prior: np.ndarray):
        self.prior = prior / prior.sum()
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 1 / STATES)
        self.emit = np.repeat(self.prior[:, None], STATES, 1)

    def fit_pairs(self, pairs: np.ndarray, groups: np.ndarray, seed: int = 5) -> None:
        """States from counts of neighbours by group: expectation maximisation on a chain of two steps. Members of a group begin alike."""
        rng = np.random.default_rng(seed)
        share = np.bincount(groups, self.prior, len(pairs))
        emit = (share + 1e-9)[:, None] * (rng.gamma(1.0, 1.0, (len(pairs), STATES)) + 0.05)
        emit /= emit.sum(axis=0)
        start, move = self.start, np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
        for _ in range(PAIR_ROUNDS if pairs.any() else 0):
            joint = start[:, None] * move
            ratio = pairs / np.maximum(emit @ joint @ emit.T, 1e-300)
            expected = joint * (emit.T @ ratio @ emit) + 0.1
            emit = emit * (ratio @ (emit @ joint.T)) + emit * (ratio.T @ (emit @ joint)) + share[:, None]
            emit /= emit.sum(axis=0)
            start, move = expected.sum(axis=1) / expected.sum(), expected / expected.sum(axis=1, keepdims=True)
        self.start, self.move = start, move
        self.emit = emit[groups] * (self.prior / np.maximum(share[groups], 1e-300))[:, None]
        self.emit /= self.emit.sum(axis=0)

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start = (start + 0.1) / (start + 0.1).sum()
        self.move = move + 0.1
        self.move /= self.move.sum(axis=1, keepdims=True)
        self.emit = emit + PSEUDO * self.prior[:, None]
        self.emit /= self.emit.sum(axis=0)

    def ready(self) -> Hmm:
        """In single precision, as tasks use it."""
        self.emit32, self.move32, self.start32 = self.emit.astype(np.float32), self.move.astype(np.float32), self.start.astype(np.float32)
        return self

    def forward(self, x: Layout, first: int, last: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, state shares and scales of a range of steps; ``before``: the shares at the step ahead of it."""
        at = x.at[first : last + 1] - x.at[first]
        seen = self.emit32[x.laid[x.at[first] : x.at[last]]]
        alpha, scale, ones = np.empty_like(seen), np.empty(len(seen), np.float32), np.ones(STATES, np.float32)
        a = before
        for t, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            now, c = alpha[lo:hi], scale[lo:hi]
            if a is None:
                now[:] = self.start32
            else:
                np.dot(a[: hi - lo], self.move32, out=now)
            now *= seen[lo:hi]
            np.dot(now, ones, out=c)
            now /= c[:, None]
            a = now
        return seen, alpha, scale

    def expect(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and symbols over whole token sequences."""
        x = Layout(texts)
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(self.emit.shape)
        blocks, ahead_of = x.blocks(), []
        if not blocks:
            return start, move, emit
        before = None
        for first, last in blocks:  # shares at the blocks' ends; the last block's are computed on the way back
            ahead_of.append(before)
            if last < len(x.live):
                before = self.forward(x, first, last, before)[1][-x.live[last - 1] :].copy()
        back, beta = np.ascontiguousarray(self.move32.T), np.ones((x.live[0], STATES), np.float32)
        for (first, last), before in zip(reversed(blocks), reversed(ahead_of), strict=True):
            seen, alpha, scale = self.forward(x, first, last, before)
            seen /= scale[:, None]
            gamma = alpha.copy()
            at = (x.at[first : last + 1] - x.at[first]).tolist()
            for t in range(last - 1, first - 1, -1):
                lo, hi = at[t - first], at[t - first + 1]
                b = beta[: hi - lo]
                gamma[lo:hi] *= b
                if t:
                    ahead = seen[lo:hi]
                    ahead *= b
                    np.dot(ahead, back, out=b)
            if before is None:
                start += gamma[: at[1]].sum(axis=0)
            else:
                move += self.move * (before[: at[1]].T @ seen[: at[1]])
            live = x.live[first:last]
            inner = np.arange(at[1], at[-1])
            move += self.move * (alpha[inner - np.repeat(live[:-1], live[1:])].T @ seen[at[1] :])
            symbols = x.laid[x.at[first] : x.at[last]]
            for k in range(STATES):
                emit[:, k] += np.bincount(symbols, gamma[:, k], len(emit))
        return start, move, emit

    def logprob(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each symbol sequence: the whole sequence, one step after another."""
        x = Layout(texts)
        total, before = np.zeros(x.n), None
        for first, last in x.blocks():
            _, alpha, scale = self.forward(x, first, last, before)
            before = alpha[-x.live[last - 1] :].copy()
            rows = np.arange(x.at[first], x.at[last]) - np.repeat(x.at[first:last], x.live[first:last])
            total += np.bincount(rows, np.log10(scale.astype(np.float64)), x.n)
        out = np.zeros(x.n)
        out[x.order] = total
        return out


def slices(sizes: list[int], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` tokens."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def sequences(batch: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in batch["x"]]


def neighbours(encoded: DataFrame, symbols: Symbols) -> np.ndarray:
    """How often a symbol of one group comes ahead of one of another."""
    groups, n = symbols.groups(), 2 * PAIRED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n * n)
        for batch in batches:
            texts = sequences(batch)
            for first, last in slices([len(x) for x in texts]):
                g = groups[np.concatenate(texts[first:last])]
                inner = np.ones(len(g), bool)
                inner[np.cumsum([len(x) for x in texts[first:last]]) - 1] = False  # nothing follows a text's end
                at = np.flatnonzero(inner)
                total += np.bincount(g[at] * n + g[at + 1], minlength=n * n)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"p": held.astype(np.int32), "c": total[held].astype(np.int64)})

    summed = encoded.select("x").mapInPandas(run, "p int, c long").groupBy("p").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.zeros(n * n)
    pairs[summed.column("p").to_numpy()] = summed.column("c").to_numpy()
    return pairs.reshape(n, n)


def baum_welch(encoded: DataFrame, hmm: Hmm) -> None:
    """One round over all texts."""
    hmm.ready()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            texts = sequences(batch)
            for first, last in slices([len(x) for x in texts]):
                got = hmm.expect(texts[first:last])
                total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            start, move, emit = total
            used = np.flatnonzero(emit.sum(axis=1) > 0)
            rows = np.concatenate((np.concatenate((start[None], move)), emit[used])).astype(np.float32)
            yield pd.DataFrame({"s": np.concatenate((-1 - np.arange(STATES + 1), used)).astype(np.int32), **{f"c{k}": rows[:, k] for k in range(STATES)}})

    counts = encoded.select("x").mapInPandas(run, "s int, " + ", ".join(f"c{k} float" for k in range(STATES)))
    summed = counts.groupBy("s").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(STATES)]).toArrow()
    s = summed.column("s").to_numpy()
    if not len(s):
        return
    c = np.stack([summed.column(f"c{k}").to_numpy() for k in range(STATES)], 1)
    table = np.zeros((len(hmm.prior) + STATES + 1, STATES))
    table[s] = c  # starts and moves have the numbers -1, -2 and on
    hmm.update(table[-1], table[-2 : -2 - STATES : -1], table[: len(hmm.prior)])


def score(docs: DataFrame, training, held_out, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Scores every row of ``docs``; learns from the rows for which the column ``training`` is true."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"), F.coalesce(training, F.lit(False)).alias("__train"))
    counts = durable(count_words(rows.where("__train").select("__text")))
    times = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)) for k in (1, 2)]
    n, v, n1, n2 = counts.agg(*[F.coalesce(c, F.lit(0)) for c in (F.sum("n"), F.count("*"), *times)]).first()
    least = max(LEAST, -int(-n * SHARE // 1))
    often = counts.where(F.col("n") >= least).toArrow()
    found = sorted(zip(often.column("w").to_pylist(), often.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    if END not in {w for w, _ in found}:
        found.append((END, counts.where(F.col("w") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    own, own_counts = [w for w, _ in found], np.array([c for _, c in found], np.float64)
    b = F.pmod(F.crc32(F.expr("substring(w, -3)")), F.lit(CLASSES)).cast("int")
    rare = counts.where((F.col("n") < least) & (F.col("w") != F.lit(END))).withColumn("b", b)
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rare.groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["b"]], words[r["b"]] = r["n"], r["v"]
    shares, symbols = Shares(tokens, words, n1, n2), Symbols(own)
    ids = symbols.ids

    # a null id passes as 0 with a key of its own, so that ids stay whole numbers in pandas
    no_id = F.when(F.col("doc_id").isNull(), F.lit(NO_ID)).otherwise(F.lit(0))
    keyed = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), (F.coalesce(F.crc32("__text"), F.lit(1 << 32)) + no_id).alias("key"), "__text", "__train")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id", "key", "__train"]].copy()
            out["x"] = [symbols.encode([*lower_words(t), END]).tobytes() for t in batch["__text"]]
            yield out

    encoded = durable(keyed.mapInPandas(encode, "doc_id long, key long, __train boolean, x binary"))
    learn = encoded.where("__train")
    hmm = Hmm(np.concatenate((own_counts + 0.01, shares.room)))
    hmm.fit_pairs(neighbours(learn, symbols), symbols.groups())
    for _ in range(rounds):
        baum_welch(learn, hmm)
    hmm.ready()
    log_all = float(np.log10(n + v + 1))
    own_logs, own_known, size = np.log10(own_counts + 1), own_counts > 0, len(own)
    unseen = shares.unseen_log - np.log10(shares.room)

    def rares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(doc, word, occurrences) of the words that are no symbol of their own."""
        for batch in batches:
            docs, keys, found, times = [], [], [], []
            for i, key, text in zip(batch["doc_id"], batch["key"], batch["__text"], strict=True):
                new = Counter(w for w in lower_words(text) if w not in ids)
                docs += [i] * len(new)
                keys += [key] * len(new)
                found += new.keys()
                times += new.values()
                if len(docs) > 200_000:
                    yield pd.DataFrame({"doc_id": np.array(docs, np.int64), "key": np.array(keys, np.int64), "w": found, "k": times})
                    docs, keys, found, times = [], [], [], []
            yield pd.DataFrame({"doc_id": np.array(docs, np.int64), "key": np.array(keys, np.int64), "w": found, "k": times})

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = sequences(batch)
            for first, last in slices([len(x) for x in texts]):
                made = []
                for x, path in zip(texts[first:last], hmm.logprob(texts[first:last]), strict=True):
                    common = x[x < size]
                    made.append((len(x), int(own_known[common].sum()), float(own_logs[common].sum()) - len(x) * log_all, path + float(unseen[x[x >= size] - size].sum())))
                out = batch.iloc[first:last][["doc_id", "key"]].copy()
                out[["n_tokens", "known", "base", "path"]] = made
                yield out.astype({"n_tokens": "int64", "known": "int64"})

    # rare words count as unseen above; what known ones have more
    as_unseen = counts.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(shares.unseen_log)], "b int, as_unseen double")
    gains = rare.join(F.broadcast(as_unseen), "b").select("w", F.log10(F.col("n") + 1).alias("base_log"), (F.log10(F.col("n") - shares.discount) - F.col("as_unseen")).alias("gain"))
    parts = keyed.mapInPandas(rares, "doc_id long, key long, w binary, k long")
    known = parts.join(gains, "w").groupBy("doc_id", "key").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("base_log")).alias("logs"), F.sum(F.col("k") * F.col("gain")).alias("gains"))
    paths = encoded.mapInPandas(forward, "doc_id long, key long, n_tokens long, known long, base double, path double")
    joined = paths.alias("p").join(known.alias("r"), (F.col("p.doc_id") == F.col("r.doc_id")) & (F.col("p.key") == F.col("r.key")), "left")
    # rows that share id and text have summed their words once for each of them
    same = F.count("*").over(Window.partitionBy("p.doc_id", "p.key"))
    more = [(F.coalesce(c, F.lit(0.0)) / same).alias(name) for c, name in (("r.logs", "logs"), ("r.gains", "gains"))]
    out = joined.select(F.when(F.col("p.key") < NO_ID, F.col("p.doc_id")).alias("doc_id"), "n_tokens", "known", "base", "path", (F.coalesce("r.k", F.lit(0)) / same).cast("long").alias("more"), *more)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.col("logs")).alias("base_score"), (F.col("path") + F.col("gains")).alias("score"))
