"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

File format. A folder with two Parquet tables:

- `codebook`: one row, `lengths` array<int> - the code length of each id from 0 (0: the id does not occur). Codes are
  canonical: shorter first, then by id; no code is longer than LONGEST bits (package-merge).
- `segments`: rows in ascending doc_id order (null ids first), in files in that order too. A row holds whole documents:
  `part`, `segment` (its place), `within` (ids of the part before it), `n_tokens`, `doc_ids` array<bigint>, `doc_tokens` array<bigint>, `checkpoints` binary -
  the bit offset (unsigned 64-bit, little-endian) at which each block of BLOCK ids starts -, and `bits` binary, the codes
  one after the other, most significant bit first. A block is decoded from its checkpoint alone.

A segment closes at SEGMENT ids, so its size is bounded by that and by one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import documents, new_path, regrouped, stored
from psephos.llm.tokens import TOGETHER, binaries, encoder, id_kind, word_bpe

LONGEST = 18
BLOCK = 512
SEGMENT = 1_000_000
SEGMENT_SCHEMA = "part int, segment int, within long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code length of each symbol, none above longest (package-merge); 0 for symbols that do not occur."""
    lengths = np.zeros(len(counts), dtype=np.int32)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols need codes of more than {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    n = len(used)
    # At each level: the merged order of the single symbols (True) and the packages (False) made of the level below.
    levels: list[np.ndarray] = []
    packages = np.zeros(0)
    for _ in range(longest):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        merged = both[order]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    take = 2 * n - 2
    for single in reversed(levels):
        taken = single[:take]
        symbols = int(taken.sum())
        lengths[used[:symbols]] += 1
        take = 2 * (len(taken) - symbols)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol as a number."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids and the bit offset of each block."""
    if len(ids) == 0:
        return b"", np.zeros(0, dtype="<u8")
    out = np.zeros(len(ids) * LONGEST // 32 + 2, dtype=np.uint64)
    checkpoints, at = [], 0
    # A few blocks at a time, so that what is computed stays in the processor's cache.
    for k in range(0, len(ids), 64 * BLOCK):
        part = ids[k : k + 64 * BLOCK]
        size = lengths[part]
        ends = np.cumsum(size, dtype=np.int64)
        ends += at
        starts = ends - size
        placed = codes[part] << (64 - size - (starts & 31)).astype(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        word = word[first]
        # Codes share no bit, so a sum puts them together; every word has a code that starts in it, up to the last.
        out[word] += np.add.reduceat(placed >> np.uint64(32), first)
        out[word + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
        checkpoints.append(starts[::BLOCK])
        at = int(ends[-1])
    return out[: (at >> 5) + 1].astype(">u4").tobytes()[: (at + 7) // 8], np.concatenate(checkpoints).astype("<u8")


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LONGEST-bit prefix: the symbol whose code it starts with, and that code's length."""
    symbols, sizes = np.zeros(1 << LONGEST, dtype=np.uint32), np.ones(1 << LONGEST, dtype=np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = (1 << (LONGEST - lengths[order])).astype(np.int64)
    total = int(spans.sum())
    symbols[:total] = np.repeat(order, spans)
    sizes[:total] = np.repeat(lengths[order], spans)
    return symbols, sizes


def decode(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids; all blocks advance together, each from its own checkpoint."""
    if n == 0:
        return np.zeros(0, dtype="<u4")
    symbols, sizes = table
    raw = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = checkpoints.astype(np.int64)
    blocks = len(at)
    out = np.zeros((BLOCK, blocks), dtype="<u4")
    rest = n - (blocks - 1) * BLOCK
    for k in range(BLOCK):
        if k == rest:
            if blocks == 1:
                break
            at = at[:-1]
        code = (window[at >> 3] >> (32 - LONGEST - (at & 7)).astype(np.uint32)) & ((1 << LONGEST) - 1)
        out[k, : len(at)] = symbols[code]
        at = at + sizes[code]
    return out.T.reshape(-1)[:n]


def tokens_and_counts(docs: DataFrame, tokenizer: str, end_id: int, kind: str, text: str, doc_id: str) -> DataFrame:
    """(doc_id, ids) of the documents (counts null) and, in the same pass over the texts, one row for each task with
    counts: how many times the ids from 0 on occur in it, as 64-bit integers (ids null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for piece in regrouped(batches, TOGETHER):
            ids, ends = encoder(tokenizer).many(piece.column(1), end_id)
            c = np.bincount(ids)
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total[: len(c)] += c
            yield pa.RecordBatch.from_arrays([piece.column(0), binaries(ids.astype(kind), ends), pa.nulls(len(ends), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    names = ["doc_id", "ids", "counts"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, counts binary")


def token_counts(counted: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, from the tasks' rows of tokens_and_counts."""

    def used(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n = np.frombuffer(x, dtype=np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["id", "n"])

    return counted.select("counts").where("counts is not null").mapInArrow(used, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every text and write the files described above. The vocabulary bounds what the driver holds.

    A null text counts as empty (it has the end id alone); null doc_ids come first; rows that share a doc_id (or have
    none) each keep their place, ordered by a hash of their ids; an empty table gives a codebook without codes and no segment.
    """
    spark = docs.sparkSession
    kind = id_kind(tokenizer, end_id)
    width = np.dtype(kind).itemsize
    tokens = stored(tokens_and_counts(docs, tokenizer, end_id, kind, text, doc_id), "tokens")
    counted = {r["id"]: r["n"] for r in token_counts(tokens).collect()}
    counts = np.zeros(max(counted, default=0) + 1, dtype=np.int64)
    for k, n in counted.items():
        counts[k] = n
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tolist(),)], "lengths array<int>").coalesce(1).write.parquet(f"{folder}/codebook")
    sizes = lengths.tobytes()

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        lengths = np.frombuffer(sizes, dtype=np.int32)
        codes = canonical_codes(lengths)
        made, before, names, held, waiting = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, before, names, held, waiting
            bits, checkpoints = encode(np.frombuffer(b"".join(held), dtype=kind), lengths, codes)
            row = [[part], [made], [before], [waiting], [names], [[len(x) // width for x in held]], [checkpoints.tobytes()], [bits]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            made, before, names, held, waiting = made + 1, before + waiting, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")])

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(k)
                held.append(x)
                waiting += len(x) // width
                if waiting >= SEGMENT:
                    yield close()
        if held:
            yield close()

    # The hash and the row's place split rows that share a doc_id (or have none) over many parts.
    placed = tokens.where("counts is null").select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("place"))
    key = ["doc_id", "hash", "place"]
    ordered = placed.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "ids")
    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(f"{folder}/segments")


@lru_cache(maxsize=2)
def _table(sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return decode_table(np.frombuffer(sizes, dtype=np.int32))


def read_token_files(spark: SparkSession, folder: str, only_crc: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids as written (little-endian unsigned 32-bit), and how many ids the files hold before them.

    With only_crc, ids_crc32 (their unsigned crc32) takes the place of ids.
    """
    row = spark.read.schema("lengths array<int>").parquet(f"{folder}/codebook").head()
    sizes = np.array(row["lengths"], dtype=np.int32).tobytes()
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/segments")
    # One number for each file part reaches the driver: how many ids the parts before it hold.
    before, at = {}, 0
    for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toLocalIterator():
        before[r["part"]], at = at, at + r["n"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in ("part", "within", "n_tokens", "checkpoints", "bits")}
                r = {c: v.as_py() for c, v in r.items()}
                names, each = (batch.column(c)[k].values for c in ("doc_ids", "doc_tokens"))
                ids = decode(r["bits"], np.frombuffer(r["checkpoints"], dtype="<u8"), r["n_tokens"], _table(sizes))
                ends = np.cumsum(each.to_numpy())
                first = ends - each.to_numpy()
                raw = memoryview(ids).cast("B")
                last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip((4 * first).tolist(), (4 * ends).tolist())], pa.int64()) if only_crc else binaries(ids, ends)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(first + before[r["part"]] + r["within"], pa.int64()), each, last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if only_crc else "ids"],
                )

    return segments.mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if only_crc else "ids binary"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write the token files of all documents, read them back, one row per document."""
    folder = new_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder, word_bpe())
    return read_token_files(spark, folder, only_crc=True)
