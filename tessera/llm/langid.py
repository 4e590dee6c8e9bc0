"""Language identification by hyperdimensional profiles.

Every letter has a random +-1 vector. A letter trigram is bound by permuting the vectors by
position and multiplying them, a text bundles its trigrams by adding them, and a language's
prototype bundles its training texts. A text takes the language of the prototype with the
largest cosine.

Training counts trigrams by language over all training rows (partial sums in each task), so what
reaches one place is a prototype per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.common import fresh, slices

#: Symbols: 0 for what is no letter, a-z, and 21 classes that all other letters fall into.
SYMBOLS, DIM, SEED = 48, 1024, 20240607
CODES = SYMBOLS**3
#: Names of the columns that ``identify`` adds; underscores are put behind them while the input has one of the names.
ADDED = ("__lang", "__score")


def _symbol(c: int) -> int:
    if not chr(c).isalpha():
        return 0
    return c - 96 if 97 <= c <= 122 else 27 + c * 2654435761 % 2**32 % 21


@lru_cache(1)
def _symbols() -> np.ndarray:
    return np.array([_symbol(c) for c in range(0xD800)] + [0] * (0x10000 - 0xD800), np.int64)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams around each letter, and their counts; none if there is no letter."""
    c = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), np.uint32)
    table = _symbols()
    s = table[np.minimum(c, 0xFFFF)]
    for x in np.unique(c[c >= 0xD800]).tolist():
        s[c == x] = _symbol(x)
    codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return np.unique(codes[s[1:-1] > 0], return_counts=True)


class Bound:
    """Trigram vectors, made when first asked for and kept one behind the other: DIM bytes for each trigram met, CODES x DIM at most.

    A table with a place for each code would take all of its memory where the system hands it out in huge pages.
    """

    def __init__(self) -> None:
        letters = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * 2 - 1
        self.parts = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]
        self.place, self.known = np.full(CODES, -1, np.int32), 0
        self.vectors = np.zeros((0, DIM), np.int8)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.place[codes] < 0])
        if len(new):
            upto = self.known + len(new)
            if upto > len(self.vectors):
                room = np.empty((min(CODES, upto + upto // 2), DIM), np.int8)
                room[: self.known] = self.vectors[: self.known]
                self.vectors = room
            a, b, c = self.parts
            self.vectors[self.known : upto] = a[new // SYMBOLS**2] * b[new // SYMBOLS % SYMBOLS] * c[new % SYMBOLS]
            self.place[new] = np.arange(self.known, upto, dtype=np.int32)
            self.known = upto
        return self.vectors[self.place[codes]].astype(np.float32)


@lru_cache(1)
def bound() -> Bound:
    return Bound()


def bundles(grams: list[tuple[np.ndarray, np.ndarray]], block: int = 2048) -> np.ndarray:
    """A row per text: the sum of its trigram vectors by count."""
    out = np.zeros((len(grams), DIM), np.float32)
    if grams:
        row = np.repeat(np.arange(len(grams)), [len(g[0]) for g in grams])
        code, col = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
        n = np.concatenate([g[1] for g in grams]).astype(np.float32)
        for k in range(0, len(code), block):
            here = (col >= k) & (col < k + block)
            m = np.zeros((len(grams), min(block, len(code) - k)), np.float32)
            m[row[here], col[here] - k] = n[here]
            out += m @ bound()[code[k : k + block]]
    return out


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes from ``text``, ``lang``: unit vectors by language. There are as many as languages."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                code = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(n[code])], ["lang", "code", "n"])
            sums.clear()

        for b in slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code, n = trigrams(text)
                if lang not in sums and len(sums) >= 64:
                    yield from flush()
                sums.setdefault(lang, np.zeros(CODES, np.int64))[code] += n
        yield from flush()

    def bundle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(DIM)
        for k in range(0, len(pdf), 4096):  # whole numbers: the order of the rows doesn't show
            total += pdf.n.to_numpy(np.float64)[k : k + 4096] @ bound()[pdf.code.to_numpy()[k : k + 4096]].astype(np.float64)
        return pd.DataFrame({"lang": [key[0]], "vector": [total]})

    counts = rows.select("text", "lang").where("lang is not null").mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = sorted((r.lang, r.vector) for r in counts.groupBy("lang").applyInPandas(bundle, "lang string, vector array<double>").collect())
    vectors = np.array([v for _, v in found]).reshape(-1, DIM)
    return [lang for lang, _ in found], (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def predict(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and cosine (0 to 1) of each text; ``und`` and 0 without a letter."""
    grams = [trigrams(t) for t in texts]
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    x = bundles(grams)
    cosine = (x @ prototypes.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    best = cosine.argmax(1)
    some = [len(g[0]) > 0 for g in grams]
    return (
        [langs[k] if ok else "und" for k, ok in zip(best, some, strict=True)],
        [float(np.clip(cosine[i, k], 0, 1)) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, some, strict=True))],
    )


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and two more for language and score (0 to 1), named ``fresh(docs.columns, *ADDED)``.

    Only the text counts. A null text, or one without a letter, is ``und`` with score 0; so is every text
    if nothing was learned. Rows are judged one by one, so repeated rows, null ids and clashing names
    of other columns make no difference, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector per language
    at, added = docs.columns.index(text_col), fresh(docs.columns, *ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = predict(b.column(at).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *added])

    fields = [StructField(added[0], StringType()), StructField(added[1], DoubleType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))
