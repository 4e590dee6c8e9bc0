"""Toxicity by a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed embeddings of the word and of its first letters. Filters
of several widths slide over the words, each takes its maximum over the whole text, and
a logistic layer weighs the maxima. The language that picks the threshold is found from the
text as well, by word frequencies.

Labels, ids, languages and sources are used in training only. Training takes a bounded
sample (``max_rows`` documents, chosen by a hash of the id); scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import discard, fresh, slices, spool

BUCKETS, DIM, FILTERS, WIDTHS, SEED = 1 << 18, 12, 8, (1, 2, 3), 11
PREFIXES = (3, 4, 5)
WORD = re.compile(r"[^\W\d_]+")
#: So many languages at most get a threshold of their own, which bounds the model.
MAX_LANGS = 64
#: The score at which a text counts as toxic.
CUT = 0.3
#: Name of the column that ``score`` adds; underscores are put behind it while the input has it.
ADDED = "__score"


class Features(dict):
    """Word -> its hashed features; forgotten when there are too many."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        keys = [word, *(f"{n}|{word[:n]}" for n in PREFIXES)]
        self[word] = found = tuple(crc32(k.encode()) % BUCKETS for k in keys)
        return found


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # by width: width x DIM x FILTERS
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    langs: np.ndarray  # BUCKETS x languages: log frequency of a word
    threshold: np.ndarray  # by language, as a logit

    def vectors(self, feats: np.ndarray) -> np.ndarray:
        return self.embedding[feats].sum(1)


def _maxima(e: np.ndarray, filters: list[np.ndarray], at: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Responses of each width at each place of texts laid end to end; ``at`` is the word at a place.

    Responses that would reach over a text's end are lost by the padding words between texts.
    """
    out = []
    for f in filters:
        parts = [e @ f[k] for k in range(len(f))]
        z = parts[0][at]
        for k in range(1, len(f)):
            z[:-k] += parts[k][at[k:]]
        out.append(z)
    return out


def _lay(texts: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers end to end, a pad in front of each text and after the last, and where each text begins."""
    gap = max(WIDTHS) - 1
    flat, starts = [], []
    for t in texts:
        starts.append(len(flat))
        flat += t or [pad]
        flat += [pad] * gap
    return np.array(flat, np.int64), np.array(starts, np.int64)


def logits(model: Model, feats: np.ndarray, texts: list[list[int]]) -> np.ndarray:
    at, starts = _lay(texts, len(feats))
    e = np.vstack([model.vectors(feats), np.zeros((1, DIM), np.float32)]) if len(feats) else np.zeros((1, DIM), np.float32)
    top = np.hstack([np.maximum.reduceat(z, starts, axis=0) for z in _maxima(e, model.filters, at, starts)])
    return np.maximum(top + model.bias, 0) @ model.weight + model.offset


def languages(model: Model, feats: np.ndarray, texts: list[list[int]]) -> np.ndarray:
    own = model.langs[feats[:, 0]] if len(feats) else np.zeros((0, model.langs.shape[1]))
    return np.array([own[t].sum(0).argmax() if t else 0 for t in texts])


def scores(model: Model, feats: np.ndarray, texts: list[list[int]]) -> np.ndarray:
    """0 to 1; CUT is where the threshold of the text's language lies."""
    at_cut = np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(logits(model, feats, texts) - model.threshold[languages(model, feats, texts)] + at_cut, -30, 30)))


def _number(docs: list[list[str]], known: Features) -> tuple[np.ndarray, list[list[int]]]:
    """Distinct words' features, and the texts as numbers of words."""
    number: dict[str, int] = {}
    texts = [[number.setdefault(w, len(number)) for w in d] for d in docs]
    return np.array([known[w] for w in number], np.int64).reshape(-1, 1 + len(PREFIXES)), texts


def fit(rows: list[tuple[str, int, str]], *, epochs: int = 12, batch: int = 32, rate: float = 0.05, seed: int = SEED) -> Model:
    """Rows of text, label, language -> model. The same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    feats, texts = _number([words_of(t) for t, _, _ in rows], Features())
    label = np.array([y for _, y, _ in rows], np.float32)
    # languages with a threshold of their own; what is rarer shares the last one
    common = Counter(x for _, _, x in rows).most_common()
    names = sorted(x for x, n in common[:MAX_LANGS] if n >= 20) + [None]
    lang = np.array([names.index(x) if x in names else len(names) - 1 for _, _, x in rows], np.int64)

    by_lang = np.zeros((BUCKETS, len(names)))
    for t, k in zip(texts, lang, strict=True):
        np.add.at(by_lang[:, k], feats[t, 0] if t else [], 1)
    words = by_lang.sum(0)
    by_lang = np.where(words > 0, np.log((by_lang + 0.1) / (words + 0.1 * BUCKETS)), -1e6).astype(np.float32)  # a class without rows is never found

    fold = rng.integers(0, 5, len(rows))  # 0, 1: where a start for the embedding is counted; 4: calibration
    count = np.zeros((2, BUCKETS))
    for t, y, k in zip(texts, label, fold, strict=True):
        if k < 2 and t:
            count[int(y), np.unique(feats[np.unique(t)])] += 1
    share = max(1e-3, label[fold < 2].mean()) if (fold < 2).any() else 0.1
    n = count.sum(0)
    odds = np.log((count[1] + share) / (count[0] + 1 - share) * (1 - share) / share) * n / (n + 4)

    embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = odds / 2
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 1 / len(f)
    m = Model(embedding, filters, np.full(FILTERS * len(WIDTHS), -0.5, np.float32), np.full(FILTERS * len(WIDTHS), 0.2, np.float32), -2.0, by_lang, np.zeros(len(names)))

    slow = {k: np.full(x.shape, 1e-4, np.float32) for k, x in (("e", m.embedding), ("b", m.bias), ("w", m.weight), *((f"f{i}", f) for i, f in enumerate(m.filters)))}

    def step(key: str, x: np.ndarray, g: np.ndarray) -> None:
        slow[key] += g * g
        x -= rate * g / np.sqrt(slow[key])

    learn = np.flatnonzero((fold == 2) | (fold == 3))
    off = np.float32(1e-4)
    for _ in range(epochs if len(learn) else 0):
        rng.shuffle(learn)
        for k in range(0, len(learn), batch):
            idx = learn[k : k + batch]
            own = [texts[i] for i in idx]
            used, where = np.unique(np.concatenate([np.array(t, np.int64) for t in own] + [np.zeros(0, np.int64)]), return_inverse=True)
            cuts = np.cumsum([0, *map(len, own)])
            own = [where[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
            f = feats[used]
            e = np.vstack([m.vectors(f), np.zeros((1, DIM), np.float32)])
            at, starts = _lay(own, len(used))
            ends = np.append(starts[1:], len(at))
            tops, places = [], []
            for z in _maxima(e, m.filters, at, starts):
                p = np.array([a + z[a:b].argmax(0) for a, b in zip(starts, ends)])
                places.append(p)
                tops.append(np.take_along_axis(z, p, 0))
            h = np.hstack(tops) + m.bias
            r = np.maximum(h, 0)
            g = (1 / (1 + np.exp(-np.clip(r @ m.weight + m.offset, -30, 30))) - label[idx]) / len(idx)
            g = g.astype(np.float32)
            dh = np.outer(g, m.weight) * (h > 0)
            off += g.sum() ** 2
            m.offset -= float(rate * g.sum() / np.sqrt(off))
            de = np.zeros_like(e)
            for i, (fl, p) in enumerate(zip(m.filters, places, strict=True)):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                gf = np.zeros_like(fl)
                for j in range(len(fl)):
                    w = at[np.minimum(p + j, len(at) - 1)]
                    gf[j] = np.einsum("nf,nfd->df", d, e[w])
                    np.add.at(de, w.ravel(), (d[:, :, None] * fl[j].T[None]).reshape(-1, DIM))
                step(f"f{i}", fl, gf)
            step("b", m.bias, dh.sum(0))
            step("w", m.weight, g @ r)
            rows_, back = np.unique(f, return_inverse=True)
            ge = np.zeros((len(rows_), DIM), np.float32)
            np.add.at(ge, back.ravel(), np.repeat(de[:-1], f.shape[1], axis=0))
            slow["e"][rows_] += ge * ge
            m.embedding[rows_] -= rate * ge / np.sqrt(slow["e"][rows_])

    held = np.flatnonzero(fold == 4)
    if len(held):
        z = np.concatenate([logits(m, feats, [texts[i] for i in held[k : k + 64]]) for k in range(0, len(held), 64)])
        overall = _threshold(z, label[held], 0.0)
        for k in range(len(names)):
            own = lang[held] == k
            m.threshold[k] = _threshold(z[own], label[held][own], overall)
    return m


def _threshold(z: np.ndarray, y: np.ndarray, default: float) -> float:
    """The logit that parts the labels with the fewest errors, in the middle of its gap; the default with few examples."""
    if y.sum() < 3 or (1 - y).sum() < 3:
        return default
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.append(0, np.cumsum(y)) + ((1 - y).sum() - np.append(0, np.cumsum(1 - y)))
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    low, high = z[max(0, k - 1)], z[min(len(z) - 1, k)]
    return float((low + high) / 2)


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, max_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest hashes of their ids, of at most ``max_bytes`` of text altogether.

    Rows without id or label are left out. A null language is one of its own. An id has one label (the greatest of several) and one text (the
    one with the smallest hash), so repeated rows change nothing. Documents are taken in the order of the hashes while they fit.
    """
    y = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    y = y.groupBy("i").agg(F.max("y").alias("y"))
    pick = spool(y.orderBy(F.xxhash64("i"), "i").limit(max_rows), "toxic_pick")  # ids only, before any text is read
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t"), F.coalesce(F.col(lang_col), F.lit("")).alias("l"))
    # places of the texts first: their sizes say which fit
    known = found.select("i", "l", F.xxhash64("t").alias("h"), F.octet_length("t").alias("n")).join(F.broadcast(pick), "i")  # max_rows ids at most
    own = known.groupBy("i", "y").agg(F.min(F.struct("h", "n", "l")).alias("x")).select("i", "y", "x.*")
    chosen, room = [], max_bytes
    for r in sorted(own.collect(), key=lambda r: (r.h, r.i)):  # max_rows rows of numbers
        if r.n <= room:
            chosen.append(r)
            room -= r.n
    ids = docs.sparkSession.createDataFrame([(r.i, r.h) for r in chosen], "i long, h long")
    texts = found.join(F.broadcast(ids), (found.i == ids.i) & (F.xxhash64("t") == ids.h)).select(found.i, "t").groupBy("i").agg(F.min("t").alias("t")).collect()  # max_bytes at most
    by = {r.i: r.t for r in texts}
    discard(pick)
    return fit([(by[r.i], r.y, r.l) for r in sorted(chosen, key=lambda r: r.i) if r.i in by])


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score, in a column named ``fresh(docs.columns, ADDED)``.

    Null and empty texts, and texts without a letter, get the score of no words. Rows are judged one by one, so
    repeated rows, null ids and clashing names of other columns make no difference; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows whatever the corpus
    at, (added,) = docs.columns.index(text_col), fresh(docs.columns, ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = Features(), shared.value
        for b in slices(batches, 128):
            found = scores(m, *_number([words_of(t) for t in b.column(at).to_pylist()], known))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(added, DoubleType())]))
