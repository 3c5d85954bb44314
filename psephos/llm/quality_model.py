"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network, temperature-calibrated.

A word gives up to three tokens: its letters in lower case, what is left of it (punctuation, digits as 0), and a mark
if its letters are all capitals; a token equal to the one before it is read as the repeat token. Tokens are hashed to
BUCKETS. Each bucket has a fixed sparse random index vector; its context vector is the sum, over all documents, of the
index vectors of the tokens within two places. A document's features are the mean and the spread of its tokens'
vectors. The network is fitted to a bounded sample, SAMPLE labelled rows of each label at most (about).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.calibration import temperature
from psephos.llm.common import alone, arrow_map, documents, fold, forget_all, labelled_texts, labels, pieces, texts_as_bytes

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 13, 48, 4, 2
SAMPLE = 4000
HIDDEN, EPOCHS = 24, 40
REPEAT, CAPITALS = 0, 1
CHUNK = 128
#: Words that a worker remembers within a task; longer ones than LONGEST_REMEMBERED bytes are worked out each time.
REMEMBERED, LONGEST_REMEMBERED = 150_000, 64
#: A document is pooled in stretches of so many tokens, so that a very long one needs little memory.
STRETCH = 200_000


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's nonzero components."""
    rng = np.random.default_rng(20)
    return np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO], rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


class Tokens:
    """Token buckets of texts; what a worker remembers is bounded."""

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _bucket(kind: str, text: str) -> int:
        return 2 + zlib.crc32((kind + text).encode("utf-8", "surrogatepass")) % (BUCKETS - 2)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        letters = "".join(c for c in text if c.isalpha())
        rest = "".join("0" if c.isdigit() else c for c in text if not c.isalpha())
        out = []
        if letters:
            out.append(self._bucket("w", letters.lower()))
            if len(letters) > 1 and letters.isupper():
                out.append(CAPITALS)
        if rest:
            out.append(self._bucket("p", rest))
        return np.array(out, dtype="<u2").tobytes()

    def forget(self) -> None:
        self.known.clear()

    def of(self, text: bytes | None) -> np.ndarray:
        alone(self)
        words = text.split() if text else []
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = set(words).difference(known)
        for w in new:
            known[w] = self._word(w)
        out = np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u2").astype(np.int64)
        for w in [w for w in new if len(w) > LONGEST_REMEMBERED]:
            del known[w]
        if len(out) > 1:
            out[1:][out[1:] == out[:-1]] = REPEAT
        return out


TOKENS = Tokens()


def context_sums(texts: DataFrame) -> np.ndarray:
    """Context vectors (BUCKETS x DIMS) over all texts. Tasks add up their own; sums meet by chunk of buckets, in two rounds that stream."""

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, sign = index_vectors()
        total = np.zeros(BUCKETS * DIMS)
        held: list[np.ndarray] = []

        def add(tokens: np.ndarray) -> None:
            # Documents lie WINDOW empty places apart, so none is another's context.
            for step in range(1, WINDOW + 1):
                a, b = tokens[:-step], tokens[step:]
                real = (a >= 0) & (b >= 0)
                for x, y in ((a[real], b[real]), (b[real], a[real])):
                    for k in range(NONZERO):
                        total[:] += np.bincount(x * DIMS + where[y, k], weights=sign[y, k], minlength=BUCKETS * DIMS)

        gap, waiting = np.full(WINDOW, -1), 0
        try:
            for batch in batches:
                for piece in pieces(batch):
                    for t in texts_as_bytes(piece.column(0)):
                        held += [TOKENS.of(t), gap]
                        waiting += len(held[-2])
                        if waiting > STRETCH:
                            add(np.concatenate(held))
                            held, waiting = [], 0
            if held:
                add(np.concatenate(held))
        finally:
            forget_all()
        blocks = total.astype("<i8").reshape(-1, CHUNK * DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["chunk", "sums"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(x, dtype="<i8")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "sums"])

    sums = texts.mapInArrow(own, "chunk int, sums binary")
    sums = sums.repartition("chunk", F.spark_partition_id() % 16).mapInArrow(meet, "chunk int, sums binary")
    out = np.zeros((BUCKETS // CHUNK, CHUNK * DIMS))
    for r in sums.repartition("chunk").mapInArrow(meet, "chunk int, sums binary").collect():
        out[r["chunk"]] += np.frombuffer(r["sums"], dtype="<i8")
    return out.reshape(BUCKETS, DIMS)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors without their common direction, plus the buckets' own index vectors."""
    where, sign = index_vectors()
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    seen = np.abs(sums).sum(axis=1) > 0
    if seen.any():
        unit[seen] -= unit[seen].mean(axis=0)
    own = np.zeros((BUCKETS, DIMS))
    np.put_along_axis(own, where, sign / math.sqrt(NONZERO), axis=1)
    return (unit + own).astype(np.float32)


def pooled(tokens: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of all tokens, the shares of the two marks, and the logarithm of how many there are."""
    n = len(tokens)
    counts = np.bincount(tokens, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    share = (counts[used] / max(n, 1)).astype(np.float32)
    mean = share @ vectors[used]
    spread = np.sqrt(np.maximum(share @ (vectors[used] ** 2) - mean**2, 0))
    return np.concatenate([mean, spread, [counts[REPEAT] / max(n, 1), counts[CAPITALS] / max(n, 1), math.log1p(n) / 10]]).astype(np.float32)


@dataclass
class QualityModel:
    vectors: np.ndarray
    shift: np.ndarray = field(default_factory=lambda: np.zeros(2 * DIMS + 3))
    scale: np.ndarray = field(default_factory=lambda: np.ones(2 * DIMS + 3))
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability of label 1; without labelled rows to learn from, the prior of one half."""
        if not self.layers:
            return np.full(len(texts), self.prior)
        x = np.stack([pooled(TOKENS.of(t), self.vectors) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(x)[:, 0] / self.temperature, -500, 500)))


def fit_network(model: QualityModel, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int) -> None:
    """Two layers by Adam on the weighted log loss; a fifth of the rows is held back for the temperature."""
    back = np.arange(len(y)) % 5 == 4
    rng = np.random.default_rng(3)
    model.shift, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model.layers = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in model.layers], [np.zeros_like(p) for p in model.layers], 0
    train = np.flatnonzero(~back)
    xs = (x - model.shift) / model.scale
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            if len(rows) == 0:
                continue
            w1, b1, w2, b2 = model.layers
            h = np.tanh(xs[rows] @ w1 + b1)
            d = ((1 / (1 + np.exp(-np.clip(h @ w2 + b2, -500, 500)))) - y[rows, None]) * weight[rows, None] / len(rows)
            dh = (d @ w2.T) * (1 - h * h)
            t += 1
            for k, g in enumerate((xs[rows].T @ dh + 1e-4 * w1, dh.sum(axis=0), h.T @ d + 1e-4 * w2, d.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.layers[k] = model.layers[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    z = model.logits(x[back])[:, 0]
    model.temperature = temperature(np.stack([np.zeros_like(z), z], axis=1), y[back].astype(int))


def train_quality_model(docs: DataFrame, labelled: DataFrame, label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """docs (doc_id, text): all texts, for the word vectors; labelled (doc_id, label): the rows to learn labels from.

    Of an id with several labels the greatest counts; rows with a null id or label teach nothing; copies of one row count once.
    """
    model = QualityModel(word_vectors(context_sums(docs.select(F.col("text").cast("string").alias("text")))))
    texts, counts = labelled_texts(docs, labelled, label, sample)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [pooled(TOKENS.of(t), model.vectors).tobytes() for t in texts_as_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    rows = sorted(arrow_map(texts.select("doc_id", "text", "label"), features, "doc_id long, label int, x binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    if not rows:
        return model
    order = np.random.default_rng(11).permutation(len(rows))
    x = np.stack([np.frombuffer(rows[k]["x"], dtype=np.float32) for k in order]).astype(np.float64)
    y = np.array([float(rows[k]["label"]) for k in order])
    drawn_of = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(int(k), 1) / drawn_of[int(k)] for k in y])
    fit_network(model, x, y, np.minimum(weight / weight.mean(), 10.0), EPOCHS)
    return model


def quality_filter(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs, all columns as they are, without the rows whose score is below threshold. No shuffle.

    Null and empty texts have no tokens and get the network's answer to that; repeated rows and rows with a null id each
    get theirs; without labelled rows every score is one half, so all stay; an empty table gives none.
    """
    at = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.scores(texts_as_bytes(batch.column(at))) >= threshold))

    return arrow_map(docs, work, docs.schema)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text.

    Null and empty texts have no tokens and get the network's answer to that; repeated rows each get theirs; without
    labelled rows every score is one half; further columns of docs are not looked at.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores(texts_as_bytes(batch.column(2)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    return train_quality_model(docs, labels(spark, sf_dir).where(fold(F.col("doc_id"), 5) != 0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: labels learned outside fold 0 of 5, every document scored."""
    docs = documents(spark, sf_dir)
    return score_quality(docs, trained(spark, docs, sf_dir))
