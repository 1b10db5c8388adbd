"""Toxicity by classifier chains.

Categories are predicted one after the other: each has a linear (logistic) model over the words of a text and the
probabilities of the categories before it. While training, those probabilities are out of fold: K models, each fitted
without a fifth of the rows, predict that fifth, so a later model meets earlier probabilities as good as it will get.

Categories are columns of the labels: a category is met where its column equals the value given. The query's are
`low_quality` (quality 0), then `toxic` (toxic 1); other label tables may name more. Training reads at most `sample`
labelled rows (by a hash of the id); what words count at all is chosen from these by their log-odds. The K fits without
a fold and the one on all rows are tasks of one Spark job a category. Prediction reads every document.

Edge cases: a null or empty text has the models' base rates; rows whose label of any category is null aren't learned
from; a category without labelled rows of both kinds has probability 0 (no such row) or its share; labels of rows that
repeat an id: the least counts; rows with a null id go, of rows that repeat one the least stays. Ids may be of any type.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import keyed, lean, text_slices, word_hashes
from tidemark.llm.decontam import plain

CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
FOLDS = 5


def _word_sets(column: pa.Array) -> Iterator[np.ndarray]:
    texts = pa.array([plain(x.as_py()) for x in column], pa.binary()).cast(pa.string())
    for _, data, offsets in text_slices(texts):
        words, _, _, first = word_hashes(data, offsets)
        for i in range(len(offsets) - 1):
            yield np.unique(words[first[i] : first[i + 1]])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Linear:
    """Logistic regression over word presence and dense extras, by Adam with an L2 penalty."""

    def __init__(self, sets: list[np.ndarray], extra: np.ndarray, y: np.ndarray, words: int, rounds: int = 150, penalty: float = 1e-4):
        self.words = np.zeros(0, np.uint64)
        both = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        kinds, which = np.unique(both, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        n1 = max(1.0, float(y.sum()))
        n0 = max(1.0, len(y) - n1)
        c1 = np.bincount(which, y[owner], minlength=len(kinds))
        c0 = np.bincount(which, minlength=len(kinds)) - c1
        gain = np.abs(np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))) * np.sqrt(c1 + c0)
        keep = np.sort(np.argsort(-gain, kind="stable")[:words])
        self.words = kinds[keep]
        place = np.full(len(kinds), -1)
        place[keep] = np.arange(len(keep))
        col, row = place[which], owner
        row, col = row[col >= 0], col[col >= 0]
        w, v, bias = np.zeros(len(keep)), np.zeros(extra.shape[1]), float(np.log(n1 / n0))
        state = [(np.zeros_like(np.atleast_1d(p)), np.zeros_like(np.atleast_1d(p))) for p in (w, v, bias)]
        for step in range(1, rounds + 1):
            p = _logistic(np.bincount(row, w[col], minlength=len(y)) + extra @ v + bias)
            miss = (p - y) / max(1, len(y))
            grads = (np.bincount(col, miss[row], minlength=len(w)) + penalty * w, extra.T @ miss + penalty * v, miss.sum(keepdims=True))
            moves = []
            for (m, s), g in zip(state, grads, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                moves.append(0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-10))
            w, v, bias = w - moves[0], v - moves[1], bias - float(moves[2][0])
        self.w, self.v, self.bias = w, v, bias

    def predict(self, words: np.ndarray, owner: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Of rows given as distinct (row, word) pairs and their extras."""
        if not len(self.words):
            return _logistic(extra @ self.v + self.bias)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = self.words[at] == words
        return _logistic(np.bincount(owner[hit], self.w[at[hit]], minlength=len(extra)) + extra @ self.v + self.bias)


class Chain:
    """Linear models of the categories in order."""

    def __init__(self, names: list[str], models: list[Linear]):
        self.names, self.models = names, models

    @classmethod
    def fitted(cls, spark: SparkSession, names: list[str], sets: list[np.ndarray], told: np.ndarray, fold: np.ndarray, words: int = 2000) -> Chain:
        """told: a column of 0 and 1 for each name. Each category's fits (without each fold, and whole) run as tasks."""
        models: list[Linear] = []
        extra = np.zeros((len(sets), 0))
        if not len(sets):
            return cls(names, models)
        for y in told.astype(float).T:
            shared = spark.sparkContext.broadcast((sets, extra, y, fold, words))
            rows = spark.range(FOLDS + 1, numPartitions=FOLDS + 1).mapInArrow(_fits(shared), "k long, model binary, out binary").collect()
            got = {r.k: r for r in rows}
            out = np.zeros(len(sets))
            for k in range(FOLDS):
                out[fold == k] = np.frombuffer(got[k].out, np.float64)
            models.append(pickle.loads(got[FOLDS].model))
            extra = np.column_stack([extra, out])
            shared.unpersist()
        return cls(names, models)

    @staticmethod
    def _pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    def predict(self, sets: list[np.ndarray]) -> np.ndarray:
        """A column of probabilities for each category."""
        extra = np.zeros((len(sets), 0))
        words, owner = self._pairs(sets)
        for model in self.models:
            extra = np.column_stack([extra, model.predict(words, owner, extra)])
        return extra if self.models else np.zeros((len(sets), len(self.names)))


def _fits(shared):
    """Task k fits without fold k and predicts that fold; the last one fits on all rows and hands its model back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, extra, y, fold, words = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                model = Linear([sets[i] for i in rest], extra[rest], y[rest], words)
                out = model.predict(*Chain._pairs([sets[i] for i in own]), extra[own])
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(model) if k == FOLDS else b""], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["k", "model", "out"])

    return run


def train(documents: DataFrame, labels: DataFrame, sample: int = 8000, categories: dict[str, tuple[str, int]] | None = None) -> Chain:
    categories = categories or CATEGORIES
    columns = sorted({c for c, _ in categories.values()})
    told = keyed(labels, "doc_id", *columns).where(" and ".join(f"{c} is not null" for c in columns))
    n = told.count()
    share = min(1 << 20, int(1.2 * sample * (1 << 20) / max(1, n)))
    chosen = told.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)

    marks = F.array(*[(F.col(c) == value).cast("long") for c, value in categories.values()])
    rows = keyed(documents, "doc_id", "text").join(F.broadcast(chosen.select("doc_id", marks.alias("told"))), "doc_id")  # at most `sample` rows

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in _word_sets(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("told"), sets], ["id", "told", "words"])

    id_hash = F.xxhash64(F.col("doc_id").cast("string")).alias("id")
    got = sorted(rows.select(id_hash, "text", "told").mapInArrow(run, "id long, told array<long>, words binary").collect())
    fold = np.array([r.id % FOLDS for r in got])
    told_marks = np.array([r.told for r in got]).reshape(len(got), len(categories))
    return Chain.fitted(documents.sparkSession, [*categories], [np.frombuffer(r.words, np.uint64) for r in got], told_marks, fold)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 8000, categories: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """(doc_id, p_<category>..., toxic) of each document; toxic: whether the last category reaches the threshold."""
    chain = train(documents, labels, sample, categories)
    docs = keyed(documents, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.names]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.predict(list(_word_sets(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names)))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names))
    return scored.select("doc_id", *[F.round(n, 6).alias(n) for n in names], (F.col(names[-1]) >= threshold).alias("toxic"))
