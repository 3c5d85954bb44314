"""Best-fit packing: bounded-space online best-fit over token lengths, with the open bins in a bitset keyed by free space."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import arrow_map, documents, stored
from psephos.llm.tokens import TOGETHER, encoder, word_bpe

CAPACITY = 4096
#: Bins that a task keeps open at once. When all are open and none fits, the fullest one closes.
OPEN_BINS = 2048
#: Pieces that one task packs; the rows of a task are a hash sample of all, so each sees the same mix of lengths.
PIECES_PER_TASK = 100_000


class BestFit:
    """Open bins by free space: bit f of `bits` is set if a bin with f free places is open."""

    def __init__(self, capacity: int, most_open: int, first_id: int):
        self.capacity, self.most_open, self.next_id = capacity, most_open, first_id
        self.bits, self.open = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def _put(self, free: int, number: int) -> None:
        if not self.bins[free]:
            self.bits |= 1 << free
        self.bins[free].append(number)
        self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item: the open bin that it leaves fullest, or a new one."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.next_id
            self.next_id += 1
        if free > length:
            self._put(free - length, number)
        return number, self.capacity - free


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids with the end id, in pieces of at most capacity."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = encoder(tokenizer).many(batch.column(1), end_id)
        size = np.diff(ends, prepend=0)
        count = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(size[row] - start, capacity)
        first = (ends - size)[row] + start
        raw = memoryview(ids).cast("B")
        crcs = [zlib.crc32(raw[a:b]) for a, b in zip((4 * first).tolist(), (4 * (first + length)).tolist())]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), work, "doc_id long, piece int, start long, length long, ids_crc32 long", together=TOGETHER)


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN_BINS) -> DataFrame:
    """pieces with sequence_id and offset added; pieces need a length of 1 to capacity.

    The rows are dealt to tasks by a hash and each task packs its own, in the order of that hash, so a rerun task gives
    the same bins. Memory: the open bins of a task. Sequences of different tasks never share a number.
    """
    pieces = stored(pieces, "pieces")
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = BestFit(capacity, most_open, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    dealt = pieces.repartition(tasks, mixed).sortWithinPartitions(mixed, "doc_id", "piece", "start", "length", "ids_crc32")
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack whole documents. A null text counts as empty (its piece is the end id); rows that share a doc_id are
    packed each; an empty table gives no rows; further columns of docs are not looked at."""
    return pack(cut(docs, tokenizer, end_id, capacity), capacity)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of at most 4096 tokens."""
    return pack_documents(documents(spark, sf_dir), word_bpe())
