"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled good and bad texts. A text is compressed piece by piece with each;
the difference of the two sizes, divided by the text's bytes, becomes a score through a logistic curve fitted on labelled
texts that neither dictionary has seen. Nothing else enters the score.

A null text is an empty one and gets the calibrated score of difference 0. If a class has no labelled row, every score is the
share of good labels (0.5 without labels). Documents with several labels train once for each label row. Very long texts are
compressed whole, piece by piece. Columns but the keys and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinolex.llm.common import map_texts

#: Labelled rows of each class that are used: half build the dictionary, half calibrate. This bounds what the driver reads.
ROWS_PER_CLASS = 400
DICTIONARY_BYTES = 110_000
#: Bytes compressed at a time, so that a dictionary counts in long texts as in short ones.
PIECE = 1024
LEVEL = 3


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS_PER_CLASS, text: str = "text") -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts of each class, chosen by a hash of the id; the same rows at every run."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = ids.where("y = 0").orderBy(*order).limit(rows).union(ids.where("y = 1").orderBy(*order).limit(rows)).dropDuplicates()
    got = docs.select("doc_id", F.col(text).alias("t")).join(F.broadcast(chosen), "doc_id").orderBy(*order, "y", "t").limit(4 * rows).collect()
    return [(r["t"] or "", r["y"]) for r in got]


class Model:
    def __init__(self, texts: list[tuple[str, int]]):
        good = [t.encode("utf-8", "surrogatepass") for t, y in texts if y == 1]
        bad = [t.encode("utf-8", "surrogatepass") for t, y in texts if y == 0]
        share = (len(good) + 1) / (len(good) + len(bad) + 2) if texts else 0.5
        self.dictionaries, self.beta = None, np.array([0, np.log(share / (1 - share))])
        if len(good) < 2 or len(bad) < 2:
            return
        self.dictionaries = [self.build(x[::2]) for x in (good, bad)]
        x = np.array([self.features(t) for t in good[1::2] + bad[1::2]])
        self.beta = self.calibrate(x, np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2])))

    @staticmethod
    def build(texts: list[bytes]) -> bytes:
        """A passage of each text, from places drawn with a fixed seed, so that each text has its share of the dictionary."""
        rng, share = np.random.default_rng(7), max(64, DICTIONARY_BYTES // len(texts))
        starts = [int(rng.integers(0, max(1, len(t) - share + 1))) for t in texts]
        return b"\n".join(t[at : at + share] for t, at in zip(texts, starts, strict=True))[:DICTIONARY_BYTES]

    @staticmethod
    def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Logistic regression by Newton steps with a small ridge; both classes weigh alike."""
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
        scale = np.maximum(x.std(axis=0), 1e-9)
        scale[-1] = 1
        design, beta = x / scale, np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            gradient = design.T @ (weight * (y - p)) - 1e-2 * beta
            hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(len(beta))
            beta = beta + np.linalg.solve(hessian, gradient)
        return beta / scale

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "_made"):
            self._made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False) for d in self.dictionaries]
        return self._made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, data: bytes) -> np.ndarray:
        """Normalised difference of the compressed sizes, 1."""
        good, bad = self.compressors()
        g = b = 0
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            g += len(good.compress(piece))
            b += len(bad.compress(piece))
        return np.array([(b - g) / max(1, len(data)), 1.0])

    def score(self, text: str | None) -> float:
        x = self.features((text or "").encode("utf-8", "surrogatepass")) if self.dictionaries else np.array([0.0, 1])
        return float(1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30))))


def score(df: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """The columns ``keys`` with a score for each row."""
    return map_texts(df, keys, text, lambda: lambda texts: [(model.score(t),) for t in texts], "score double")
