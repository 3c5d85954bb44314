"""Small helpers that the corpus operators share: folds, words, samples, Arrow rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from psephos.shared import new_path, stored  # noqa: F401

#: The six ASCII white-space characters; everything between them is a word. bytes.split() uses the same six.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, mod parts; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices of a few rows, so that what a task unpacks at once stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def regrouped(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes, or of one row, as large as that allows."""
    held: list[pa.RecordBatch] = []
    size = 0

    def put_together() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        waiting = [batch] if batch.num_rows else []
        while waiting:
            piece = waiting.pop()
            if piece.num_rows > 1 and piece.nbytes > most:
                half = piece.num_rows // 2
                waiting += [piece.slice(half), piece.slice(0, half)]
                continue
            if held and size + piece.nbytes > most:
                yield put_together()
                held, size = [], 0
            held.append(piece)
            size += piece.nbytes
    if held:
        yield put_together()


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = 256, together: int | None = None) -> DataFrame:
    """mapInArrow with a function of batches of a few rows or, with together, of so many bytes. What the function remembers goes when the task ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for piece in regrouped(batches, together) if together else (p for b in batches for p in pieces(b, rows)):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out
        finally:
            forget_all()

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def bounded_sample(rows: DataFrame, kind: str, most: int, *key: str) -> DataFrame:
    """About `most` rows of each kind (not more but for chance), chosen by a hash of the key columns: the same rows
    whatever the partitions. Rows with the same kind and key count once, so that copies of one row cannot fill the sample.

    One approximate count of distinct keys per kind is taken over all rows; a kind with fewer than `most` is taken whole.
    """
    drawn = rows.withColumn("_draw", F.xxhash64(F.lit("sample"), *key))
    counts = {r[kind]: r["n"] for r in drawn.groupBy(kind).agg(F.approx_count_distinct("_draw", 0.02).alias("n")).collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, most / max(n, 1))
        keep = keep | (F.col(kind).eqNullSafe(F.lit(value)) & (F.pmod("_draw", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    return drawn.where(keep).dropDuplicates([kind, "_draw"]).drop("_draw")


def labelled_ids(labelled: DataFrame, label: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of about `sample` ids of each label at most, and how many ids have each label.

    Of an id with several labels the greatest counts; null ids and labels other than 0 and 1 are left out.
    """
    known = labelled.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return bounded_sample(known, "label", sample, "doc_id"), counts


def labelled_texts(docs: DataFrame, labelled: DataFrame, label: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of about `sample` rows of each label at most, and how many ids have each label.

    The second draw bounds the rows where many share one id.
    """
    drawn, counts = labelled_ids(labelled, label, sample)
    # At most about 2 * sample ids of 8 bytes: that bound makes the broadcast safe.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")
    return bounded_sample(texts, "label", sample, "doc_id", "text"), counts


_REMEMBERING: list = []


def alone(owner) -> None:
    """What a Python worker remembers for one operator goes when another one works in it, so that memory doesn't add up over stages."""
    if not _REMEMBERING or _REMEMBERING[0] is not owner:
        for other in _REMEMBERING:
            other.forget()
        _REMEMBERING[:] = [owner]


def forget_all() -> None:
    """Give what this worker remembers, and the memory it lay in, back."""
    if not _REMEMBERING:
        return
    for owner in _REMEMBERING:
        owner.forget()
    _REMEMBERING.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Kept:
    """What has been worked out, in two generations: when the young one is full it becomes the old one, and what is met
    again moves back. So what is frequent stays and what came once goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young

    def missing(self, keys: set) -> set:
        """The keys in neither generation; the others are in the young one afterwards."""
        new = keys.difference(self.young)
        if self.old:
            again = new.intersection(self.old)
            self.young.update({k: self.old[k] for k in again})
            new -= again
        return new
