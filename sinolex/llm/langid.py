"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the product (binding) of its letters' vectors, each
rolled (permuted) by its place; a document is the sum (bundle) of its n-gram vectors, a language the bundle of its
documents. The prediction is the language whose prototype has the largest cosine with the document.

Null texts and texts without a letter get ``und`` and score 0. Without a labelled training row every text gets ``und``.
Equal cosines go to the first language in code point order. Repeated rows stay; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinolex.llm.common import map_texts

DIMENSIONS = 512
ORDER = 3
SEED = 20240917
#: N-gram vectors kept by a worker; beyond it the store starts anew (results don't change).
CACHE_ROWS = 40_000

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all that is no letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)), np.uint32, 0x110000)
    return _letters


class Encoder:
    """Turns texts into unit vectors."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.rows = np.empty(0, np.int64)
        self.vectors = np.empty((0, self.dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            rng = np.random.Generator(np.random.Philox(key=[SEED, code]))
            self.letters[code] = rng.integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.letters[code]

    def learn(self, keys: np.ndarray) -> None:
        """Adds vectors for n-grams that are not stored yet."""
        made = np.empty((len(keys), self.dimensions), np.float32)
        for i, key in enumerate(keys.tolist()):
            bound = np.ones(self.dimensions, np.int8)
            for place in range(ORDER):
                bound = bound * np.roll(self.letter(key >> (21 * place) & 0x1FFFFF), place)
            made[i] = bound
        rows = np.concatenate((self.rows, len(self.vectors) + np.arange(len(keys))))
        self.vectors = np.concatenate((self.vectors, made))
        merged = np.concatenate((self.keys, keys))
        by = np.argsort(merged)
        self.keys, self.rows = merged[by], rows[by]

    def encode(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; None if it has no letter."""
        if not text:
            return None
        codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        if not codes.any():
            return None
        codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # one gap between words
        keys = codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)
        keys, counts = np.unique(keys, return_counts=True)
        total = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(keys), 8192):  # a bounded slice of n-grams at once
            part = keys[at : at + 8192]
            spot = np.minimum(np.searchsorted(self.keys, part), max(len(self.keys) - 1, 0))
            new = part[self.keys[spot] != part] if len(self.keys) else part
            if len(new):
                if len(self.keys) + len(new) > CACHE_ROWS:
                    self.clear()
                    new = part
                self.learn(new)
                spot = np.searchsorted(self.keys, part)
            total += counts[at : at + 8192].astype(np.float32) @ self.vectors[self.rows[spot]]
        norm = float(np.linalg.norm(total))
        return total / norm if norm else None


def train(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes from all rows of ``df`` that have a language: vectors are bundled in the tasks, then summed by Spark.

    What comes back holds one vector for each language and nothing that grows with the rows.
    """

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(dimensions), {}
        for batch in batches:
            for t, name in zip(batch["t"], batch["l"], strict=True):
                if (v := encoder.encode(t)) is not None:
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        for name, v in sums.items():
            yield pd.DataFrame({"l": name, "d": np.arange(dimensions, dtype=np.int32), "v": np.round(v * 1e6).astype(np.int64)})

    parts = df.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInPandas(bundle, "l string, d int, v long")
    rows = parts.groupBy("l", "d").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["l"], np.zeros(dimensions))[r["d"]] = r["v"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v))}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default, but for those of the same name) with the language and its cosine (0 if negative)."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (lang_col, score_col)]
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32) if names else None

    def work():
        encoder = Encoder(matrix.shape[1] if names else DIMENSIONS)

        def one(text: str | None) -> tuple[str, float]:
            v = encoder.encode(text) if names else None
            if v is None:
                return "und", 0.0
            cosines = matrix @ v
            best = int(np.argmax(cosines))
            return names[best], float(np.clip(cosines[best], 0, 1))

        return lambda texts: [one(t) for t in texts]

    return map_texts(df, keep, text, work, f"`{lang_col}` string, `{score_col}` double")
