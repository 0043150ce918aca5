"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades.

Grades are 0, 1, …, K - 1. One weight per feature is shared by all thresholds: ``P(grade <= k) = s(t_k - w x)`` with the
logistic s and ordered thresholds t; the expected severity is the sum over k of ``P(grade > k)``. Features are words and the
first 4, 5 and 6 letters of words (inflected forms share those), valued by the logarithm of one plus their count. Only
features that mark higher grades in the training rows are kept, so a long harmless text adds nothing.

The table of labels says toxic or not. ``severities`` turns that into three grades: 0 not toxic, 1 toxic, 2 toxic with
more marking words than the median of the toxic training rows. Rows with grades of their own can be given
to ``train`` as they are.

Training takes at most ``ROWS`` labelled rows of each label (the first by hash, at most ``MAX_CHARS`` characters long; a
fifth by CRC-32 of the id is held out for tests). Every document is scored on its whole text.

Cases: null or empty texts, and texts without a marking word, get the scores of an empty text; labels that are null, or
without a document, train nothing; rows labelled twice count twice; with labels of one grade only, or none, every
severity is 0; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingestkit.llm.common import fields

ROWS, MAX_CHARS, SELECTED = 2_500, 20_000, 20_000
_LETTERS = re.compile(r"[^\W\d_]+")


def _marks(word: str) -> set[str]:
    return {word + "$"} | {word[:n] for n in (4, 5, 6) if len(word) >= n}


def counted(text: str | None) -> Counter:
    """Words of a text with their counts."""
    return Counter(_LETTERS.findall(text.lower())) if text else Counter()


def select(texts: list[str], toxic: np.ndarray, at_least: int = 4, share: float = 0.01, odds: float = 2.5, most: int = SELECTED) -> list[str]:
    """Features whose share of toxic rows is e^odds times that of the others or more, most telling first.

    A feature must follow ``at_least`` different words (and ``share`` of the number of toxic rows) where toxic rows first use it: families of copies repeat their
    words in one context and count once.
    """
    seen, contexts = (Counter(), Counter()), {}
    for text, label in zip(texts, toxic):
        words = _LETTERS.findall(text.lower())
        first: dict[str, str] = {}
        for before, word in zip(["", *words], words):
            if word not in first:
                first[word] = before
        marks = {m: before for word, before in reversed(first.items()) for m in _marks(word)}
        seen[int(label)].update(list(marks))
        if label:
            for m, before in marks.items():
                contexts.setdefault(m, set()).add(before)
    n = (int((~toxic).sum()), int(toxic.sum()))
    rated = []
    for name, where in contexts.items():
        if len(where) >= max(at_least, share * n[1]):
            lift = np.log((seen[1][name] + 0.5) / (n[1] + 1)) - np.log((seen[0][name] + 0.5) / (n[0] + 1))
            if lift >= odds:
                rated.append((-lift * np.sqrt(len(where)), name))
    return [name for _, name in sorted(rated)[:most]]


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def vector(self, words: Counter, cache: dict[str, tuple[int, ...]]) -> dict[int, float]:
        total: dict[int, int] = {}
        for word, n in words.items():
            slots = cache.get(word)
            if slots is None:
                slots = cache[word] = tuple(self.names[m] for m in _marks(word) if m in self.names)
            for s in slots:
                total[s] = total.get(s, 0) + n
        return {s: float(np.log1p(n)) for s, n in total.items()}

    def exceed(self, words: Counter, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
        """``P(grade > k)`` for every threshold."""
        x = sum(self.weights[s] * v for s, v in sorted(self.vector(words, cache).items()))
        return 1 / (1 + np.exp(np.clip(self.thresholds - x, -60, 60)))


def severities(texts: list[Counter], toxic: np.ndarray, names: list[str]) -> np.ndarray:
    known = set(names)
    marked = np.array([sum(n for w, n in t.items() if _marks(w) & known) for t in texts])
    return np.where(toxic, np.where(marked > (np.median(marked[toxic]) if toxic.any() else 0), 2, 1), 0)


def train(texts: list[Counter], grades: np.ndarray, names: list[str], rounds: int = 800, decay: float = 1e-5) -> Model:
    """Maximum likelihood with L2 decay by AdaGrad; thresholds stay ordered as gaps are learned by their logarithm."""
    top = int(grades.max()) if len(grades) else 0
    model = Model({n: k for k, n in enumerate(names)}, np.zeros(len(names)), np.full(max(top, 1), 60.0))
    if not top or not names or not (grades == 0).any():
        return model
    cache: dict[str, tuple[int, ...]] = {}
    vectors = [model.vector(t, cache) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(v) for v in vectors])
    slot = np.array([s for v in vectors for s in v], np.int64)
    value = np.array([x for v in vectors for x in v.values()])
    first, gaps, w = 0.0, np.zeros(top - 1), np.zeros(len(names))
    seen = [np.full_like(np.atleast_1d(p), 1e-8) for p in (w, np.array([first]), gaps)]
    for _ in range(rounds):
        t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        x = np.bincount(row, value * w[slot], len(texts))
        p = 1 / (1 + np.exp(np.clip(x[:, None] - t, -60, 60)))  # P(grade <= k)
        hi = np.where(grades < top, p[np.arange(len(p)), np.minimum(grades, top - 1)], 1.0)
        lo = np.where(grades > 0, p[np.arange(len(p)), np.maximum(grades - 1, 0)], 0.0)
        # cumulated probability at the grade and below it
        mass = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        per_t = np.zeros(top)
        np.add.at(per_t, np.minimum(grades, top - 1), np.where(grades < top, dhi, 0))
        np.add.at(per_t, np.maximum(grades - 1, 0), np.where(grades > 0, -dlo, 0))
        per_t /= len(texts)
        slope = np.bincount(slot, value * (dlo - dhi)[row], len(names)) / len(texts) - decay * w
        turn = np.array([per_t.sum()])
        widen = np.cumsum(per_t[::-1])[::-1][1:] * np.exp(gaps)
        for s, g in zip(seen, (slope, turn, widen)):
            s += g ** 2
        w = w + 0.3 * slope / np.sqrt(seen[0])
        first += float(0.3 * turn[0] / np.sqrt(seen[1][0]))
        gaps = gaps + 0.3 * widen / np.sqrt(seen[2])
    model.weights, model.thresholds = w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """The bounded sample: ``(text, toxic)``, the first rows of either label by hash."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    ranked = marked.select("doc_id", "toxic", F.xxhash64("doc_id").alias("_h"))
    short = docs.where(F.length("text") <= max_chars).select(F.col("doc_id").alias("_id"))
    picked = ranked.join(short, F.col("doc_id") == F.col("_id")).withColumn(
        "_r", F.row_number().over(Window.partitionBy("toxic").orderBy("_h", "doc_id"))).where(F.col("_r") <= rows).select("doc_id", "toxic")
    chosen = F.broadcast(picked.distinct())  # at most 2 * ROWS rows
    texts = docs.where(F.length("text") <= max_chars).select(F.col("doc_id").alias("_id"), "text")
    found = texts.join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    # where documents repeat, the first of an order that does not depend on where they lie
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "toxic").limit(4 * rows)
    return [(r[1], int(r[2])) for r in sorted(found.collect(), key=lambda r: (str(r[0]), r[1], r[2]))]


def fitted(sample: list[tuple[str, int]]) -> Model:
    texts, toxic = [counted(t) for t, _ in sample], np.array([bool(x) for _, x in sample], bool)
    names = select([t for t, _ in sample], toxic)
    return train(texts, severities(texts, toxic, names), names)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, grade`` (the highest that is at least as likely as not), ``severity`` (expected grade), ``p_toxic``, ``toxic``."""
    docs = fields(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fitted(training_rows(docs, labels))))  # SELECTED features at most

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = pickle.loads(shared.value), {}
        for batch in batches:
            if len(cache) > 500_000:
                cache.clear()
            over = [model.exceed(counted(t.as_py()), cache) for t in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array([int((p >= 0.5).sum()) for p in over], pa.int32()),
                 pa.array([float(p.sum()) for p in over], pa.float64()), pa.array([float(p[0]) for p in over], pa.float64())],
                names=["doc_id", "grade", "severity", "p_toxic"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(step, f"doc_id {id_type}, grade int, severity double, p_toxic double").withColumn("toxic", F.col("p_toxic") >= 0.5)
