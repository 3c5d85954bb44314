"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, then calibrated by a temperature. n-grams of 1 to 3
lower-case characters are hashed to FEATURES columns. Document frequencies come from every training text; the regression
sees a bounded sample, SAMPLE rows of each language at most (about), chosen by a hash of doc_id and text; copies of one
row count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.calibration import softmax, temperature
from psephos.llm.common import arrow_map, bounded_sample, documents, fold, pieces

FEATURES = 1 << 15
SAMPLE = 1000
#: A text is read in stretches of so many characters, so that a very long one needs little memory; no n-gram is lost.
STRETCH = 1 << 20
FIRST, SECOND, THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of 1 to 3 characters occurs in the whole text."""
    total = np.zeros(FEATURES, dtype=np.int64)
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    for at in range(0, max(len(text), 1), STRETCH):
        c = np.frombuffer(text[max(0, at - 2) : at + STRETCH].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        old = min(at, 2)
        one = c * FIRST
        two = one[:-1] ^ (c[1:] * SECOND) if len(c) > 1 else c[:0]
        three = two[:-1] ^ (c[2:] * THIRD) if len(c) > 2 else c[:0]
        # n-grams that lie wholly in what the stretch before has read are not counted again
        for k, h in enumerate((one[old:], two[max(0, old - 1) :], three[max(0, old - 2) :])):
            total += np.bincount((((h + np.uint64(k)) * FIRST) >> shift).astype(np.int64), minlength=FEATURES)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = ngram_counts(text)
        used = np.flatnonzero(counts)
        values = np.log1p(counts[used]) * self.idf[used]
        return used, values / max(np.sqrt((values * values).sum()), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its probability; `und` and 0 without a letter or without any learned language."""
        if not has_letter(text) or not self.languages:
            return "und", 0.0
        used, values = self.vector(text)
        p = softmax(((values @ self.weights[used] + self.bias) / self.temperature)[None, :])[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each feature occurs, and how many texts there are; at most FEATURES numbers reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES + 1, dtype=np.int64), 0
        for batch in batches:
            for piece in pieces(batch):
                for t in piece.column(0).to_pylist():
                    df[:FEATURES] += ngram_counts(t) > 0
                    n += 1
        df[FEATURES] = n
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(df[used], pa.int64())], ["feature", "n"])

    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in texts.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out[:FEATURES], int(out[FEATURES])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (FEATURES x classes) and bias of a softmax regression by FTRL-proximal steps with L1 and L2 penalties."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            used, values = np.append(rows[k][0], FEATURES), np.append(rows[k][1], 1.0)
            w = weights(used)
            p = softmax((values @ w)[None, :])[0]
            p[target[k]] -= 1.0
            g = values[:, None] * p[None, :]
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * w
            n[used] += g * g
    w = weights(slice(None))
    return w[:FEATURES], w[FEATURES]


def train_language_model(training: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """Learn from rows with a text with a letter and a non-null lang; none gives a model that answers `und`."""
    rows = training.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    df, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = LanguageModel([], idf, np.zeros((0, 0)), np.zeros(0), 1.0)
        kept = [(name, doc, *model.vector(t)) for doc, t, name in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(t)]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2].astype("<u2").tobytes() for k in kept], pa.binary()), pa.array([k[3].astype("<f4").tobytes() for k in kept], pa.binary())],
            ["lang", "doc_id", "used", "weight"],
        )

    drawn = bounded_sample(rows, "lang", sample, "doc_id", "text")
    some = sorted(arrow_map(drawn, vectors, "lang string, doc_id long, used binary, weight binary").collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["used"]))
    languages = sorted({r["lang"] for r in some})
    if not languages:
        return LanguageModel([], idf, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    data = [(np.frombuffer(r["used"], dtype="<u2").astype(np.int64), np.frombuffer(r["weight"], dtype="<f4").astype(np.float64)) for r in some]
    target = np.array([languages.index(r["lang"]) for r in some])
    back = np.arange(len(data)) % 5 == 4
    w, b = ftrl([d for d, k in zip(data, back) if not k], target[~back], len(languages))
    logits = np.array([v @ w[u] + b for (u, v), k in zip(data, back) if k]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, w, b, temperature(logits, target[back]))


def predict_languages(docs: DataFrame, model: LanguageModel, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every whole text.

    A null text, an empty one and one without a letter are `und` with score 0; repeated rows each get their answer;
    equal probabilities go to the language that sorts first; further columns of docs are not looked at.
    """
    small = LanguageModel(model.languages, model.idf.astype(np.float32), model.weights.astype(np.float32), model.bias, model.temperature)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [small.predict(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learned from the documents outside fold 1 of 3, applied to all."""
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 3) == 1
    return predict_languages(docs, train_language_model(docs.where(~held_out)), held_out)
