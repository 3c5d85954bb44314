"""Toxicity: noisy-channel deobfuscation of words, then a score of the restored text.

A character trigram model is counted over all documents. A word that may be disguised - letters with symbols or digits among
them or at the ends, runs of one letter, single letters set apart - becomes a lattice: each place offers the character itself, the letters it
may stand for, nothing (separators, repeats) or, in a second reading, a border between words, each at a channel cost;
Viterbi decoding finds the cheapest path under the character model, for words and stretches of any length. Plain words have a lattice of one path and are left as they are.

Features are the restored words and their first LEAD letters. Their counts in toxic and other labelled documents come
from a bounded sample, SAMPLE labelled rows of each label at most (about); those that speak clearly for label 1 form the
lexicon, all of them: the sample bounds how many there can be. A logistic regression on the sum of the lexicon's weights found in a document gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import arrow_map, documents, fold, labelled_texts, labels, pieces, stored, texts_as_bytes

SAMPLE = 6000
LEAD = (4, 5, 6)
REMEMBERED = 400_000
#: What longer words restore to is not remembered but worked out each time.
REMEMBERED_LENGTH = 160

#: Characters and the letters they may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = set(".-_*~'`^/\\,:;")
ENDS = "".join(sorted(SEPARATORS))
#: Channel costs (negative log probabilities).
AS_LETTER, AS_ITSELF, SKIPPED, ONE_OF_RUN, TWO_OF_RUN = 1.0, 6.0, 1.5, 0.5, 1.0

#: Rows of the character model: 0 is whatever is no letter, 1 to 26 a to z, 27 any other letter.
SYMBOLS = 28


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of three characters in a row over all texts, as SYMBOLS^3 numbers. Each task adds up its own."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(256, dtype=np.int64)
        for c in range(97, 123):
            table[c] = table[c - 32] = c - 96
        table[128:192] = -1  # continuation bytes of UTF-8 belong to the character before
        table[192:] = 27
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch):
                for t in texts_as_bytes(piece.column(0)):
                    for at in range(0, len(t or b""), 1 << 20):
                        s = table[np.frombuffer(t[at : at + (1 << 20)], dtype=np.uint8)]
                        s = np.concatenate([[0, 0], s[s >= 0], [0]])
                        total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["gram", "n"])

    out = np.zeros(SYMBOLS**3)
    for r in texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), smoothed with the bigram's and the plain frequencies."""
    c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = c.sum(axis=(0, 1)) + 1.0
    one = one / one.sum()
    two = c.sum(axis=0)
    two = (two + 2 * one[None, :]) / (two.sum(axis=1, keepdims=True) + 2)
    return -np.log((c + 4 * two[None, :, :]) / (c.sum(axis=2, keepdims=True) + 4))


def _put(way: tuple | None) -> list[str]:
    """What a way back (the way before, what was put) put, in order."""
    out = []
    while way is not None:
        way, put = way
        out.append(put)
    return out[::-1]


class Restorer:
    """Restored words of texts under a character model; what it remembers is bounded."""

    #: A character that may stand for a letter or be a separator, or a run of one letter. A word with a letter and one of
    #: these may be disguised, wherever in it they are.
    disguised = regex.compile("[" + regex.escape("".join(sorted({*STANDS_FOR, *SEPARATORS}))) + r"]|(\p{L})\1\1")
    letter = regex.compile(r"\p{L}")
    decoration = regex.compile(r"([^\p{L}\p{N}])\1+$")
    outer = ".,;:?\"'()[]{}<>«»“”„…"
    voiceless = "".join(c for c in ".,;:?\"'()[]{}<>«»“”„…" if c not in STANDS_FOR)

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    def places(self, word: str, borders: bool = False) -> Iterator[list[tuple[str, float]]]:
        """For each place: (what is put there, its cost); runs of three or more of a letter are one place.

        With borders, separators and spaces may as well be the border between two words.
        """
        k = 0
        while k < len(word):
            c = word[k]
            run = k
            while run < len(word) and word[run] == c:
                run += 1
            if c.isalpha() and run - k >= 3:
                yield [(c, ONE_OF_RUN), (c * 2, TWO_OF_RUN)]
                k = run
                continue
            options = [(c, 0.0 if c.isalpha() else AS_ITSELF)]
            options += [(x, AS_LETTER) for x in STANDS_FOR.get(c, "")]
            if c in SEPARATORS or c == " ":
                options += [("", SKIPPED), *([(" ", SKIPPED)] if borders else [])]
            yield options
            k += 1

    def decode(self, word: str, borders: bool = False) -> str:
        """The cheapest path; states are the last two symbols, each with its way back. Where one state is left, all ways
        are the same up to it, so what they put is written out and let go."""
        out: list[str] = []
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.places(word, borders):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, way) in sorted(best.items(), key=lambda x: x[0]):
                for put, extra in options:
                    x, y, total = a, b, cost + extra
                    for c in put:
                        s = symbol(c)
                        total += self.costs[x][y][s]
                        x, y = y, s
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (way, put) if put else way)
            best = after
            if len(best) == 1:
                [(state, (_, way))] = best.items()
                out += _put(way)
                best = {state: (0.0, None)}
        way = min(((cost + self.costs[a][b][0], a, b, way) for (a, b), (cost, way) in best.items()), key=lambda x: x[:3])[3]
        return "".join(out + _put(way))

    def word(self, word: str) -> tuple[str, ...]:
        """The restored words of one word in lower case: its letters as they are and, where it may be disguised, decoded."""
        # Signs that stand for no letter have no say at the ends; others are left for the lattice.
        plain = word.strip(self.voiceless)
        if plain.isalpha() and not self.disguised.search(plain):
            return (plain,)
        out = regex.findall(r"\p{L}+", word)
        # Signs at the ends may be letters or decoration: both readings count.
        for reading in dict.fromkeys([word, self.decoration.sub("", word).strip(self.outer)]):
            if self.letter.search(reading) and self.disguised.search(reading):
                out += regex.findall(r"\p{L}+", self.decode(reading))
                if not SEPARATORS.isdisjoint(reading.strip(ENDS)):
                    out += regex.findall(r"\p{L}+", self.decode(reading, borders=True))
        return tuple(dict.fromkeys(out))

    def spaced(self, split: list[str]) -> set[str]:
        """What stretches of three or more single characters set apart may be: one word, or words with borders among them."""
        out: set[str] = set()
        run: list[str] = []
        for w in [*split, "--"]:
            if len(w) == 1 or (len(w) == 2 and w[1] in SEPARATORS and w != "--"):
                run.append(w[0])
            elif run:
                if len(run) >= 3:
                    out.update(regex.findall(r"\p{L}+", self.decode("".join(run))))
                    out.update(regex.findall(r"\p{L}+", self.decode(" ".join(run), borders=True)))
                run = []
        return out

    def words(self, text: bytes | None) -> set[str]:
        """All restored words of a whole text, single letters set apart put together."""
        split = in_words(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        distinct = set(split)
        for w in distinct.difference(known):
            known[w] = self.word(w)
        out = self.spaced(split).union(*map(known.__getitem__, distinct))
        for w in [w for w in distinct if len(w) > REMEMBERED_LENGTH]:
            del known[w]
        return out


def in_words(text: bytes | None) -> list[str]:
    return (text or b"").decode("utf-8", "replace").lower().split()


def features(words: set[str]) -> set[str]:
    return words | {f"{w[:n]}~" for w in words for n in LEAD if len(w) >= n}


@dataclass
class ToxicityModel:
    costs: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -20.0
    _restorer: Restorer | None = None
    _hits: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_restorer": None, "_hits": {}}

    @property
    def restorer(self) -> Restorer:
        if self._restorer is None:
            self._restorer = Restorer(self.costs)
        return self._restorer

    def weight(self, word: str) -> float:
        """Of a restored word's features the strongest counts."""
        return max([self.lexicon.get(word, 0.0), *(self.lexicon.get(f"{word[:n]}~", 0.0) for n in LEAD if len(word) >= n)])

    def evidence(self, text: bytes | None) -> float:
        """The weights of the distinct restored words that the lexicon knows."""
        split = in_words(text)
        distinct, hits = set(split), self._hits
        if len(hits) > REMEMBERED:
            hits.clear()
        for w in distinct.difference(hits):
            hits[w] = tuple(x for x in self.restorer.word(w) if self.weight(x))
        found = self.restorer.spaced(split).union(*filter(None, map(hits.__getitem__, distinct)))
        for w in [w for w in distinct if len(w) > REMEMBERED_LENGTH]:
            del hits[w]
        return sum(sorted(map(self.weight, found)))

    def score(self, text: bytes | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.evidence(text) + self.offset))))


def train_toxicity_model(docs: DataFrame, labelled: DataFrame, label: str = "toxic", sample: int = SAMPLE, least: int = 3) -> ToxicityModel:
    """docs (doc_id, text): all texts, for the character model; labelled (doc_id, label): the rows to learn labels from.

    Of an id with several labels the greatest counts; rows with a null id or label teach nothing; copies of one row count once.
    """
    model = ToxicityModel(trigram_costs(trigram_counts(docs.select(F.col("text").cast("string").alias("text")))))
    texts = stored(labelled_texts(docs, labelled, label, sample)[0], "labelled-texts")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found: dict[str, list[int]] = {}
                for t, y in zip(texts_as_bytes(piece.column(1)), piece.column(2).to_pylist()):
                    for f in features(model.restorer.words(t)):
                        found.setdefault(f, [0, 0])[y] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["feature", "clean", "toxic"])

    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return model
    counts = texts.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Log odds, less 1.5 standard errors: a few chance meetings of a rare word with label 1 are no evidence.
    weight = F.log(F.col("toxic") / toxic) - F.log((F.col("clean") + 0.5) / (clean + 1.0)) - 1.5 * F.sqrt(1 / F.col("toxic") + 1 / (F.col("clean") + 0.5))
    strong = counts.where(F.col("toxic") >= least).withColumn("weight", weight).where("weight >= 1.0")
    model.lexicon = {r["feature"]: float(r["weight"]) for r in strong.collect()}

    def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(2), pa.array([model.evidence(t) for t in texts_as_bytes(batch.column(1))], pa.float64())], ["label", "x"])

    rows = sorted((r["x"], r["label"]) for r in arrow_map(texts, evidence, "label int, x double").collect())
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    a, b = 0.5, -2.0
    for _ in range(50):  # Newton steps of a logistic regression with a weak penalty
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum() + 0.1 * b])
        h = p * (1 - p)
        step = np.linalg.solve(np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]]), g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    model.slope, model.offset = a, b
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text.

    Null and empty texts hold no word, so they get the score of no evidence; so does every text if there are no
    labelled rows of both kinds; repeated rows each get theirs; further columns of docs are not looked at.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([model.score(t) for t in texts_as_bytes(batch.column(2))])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: labels learned outside fold 0 of 5, every document scored."""
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train_toxicity_model(docs, labels(spark, sf_dir).where(fold(F.col("doc_id"), 5) != 0)))
