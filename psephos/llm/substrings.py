"""Substring dedup by a de Bruijn graph of word windows.

A window is WINDOW consecutive words of one document: an edge of the graph from its first WINDOW - 1 words to its last.
Words go that lie in a window whose word sequence also starts in a document with a smaller doc_id.

Exact copies of a smaller document's text lose all their windows, so they need no search and take no part in it.

1. Anchors. Every window has one: the least hash among its runs of ANCHOR words. Equal windows have equal anchors, and
   neighbouring windows mostly share one, so the anchors of all documents are few. An anchor found in one row only
   shows that none of its windows repeats. The others are marked in a bit filter of fixed size (FILTER_BITS); where it
   fills up, more windows go on, none is lost.
2. Edges. Windows with a marked anchor, once for each document, with a 64-bit hash and their place.
3. Each repeated edge gets its source coordinate: the first place of the smallest document that has it. Edges are dealt
   once for that: rows of one edge meet in one task, three longs each, and are sorted there.
4. Compaction. Joined with their sources, edges that follow each other in a document and in its source at once form a
   nonbranching path: a span (document, place, length, source, place there).
5. Verification. The words of every span are digested at the source coordinate and at its own; only a span whose
   digests agree counts. A document's words that its spans' windows cover, wherever these windows stand in it, go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from psephos.llm.common import alone, arrow_map, documents, stored, texts_as_bytes

WINDOW, ANCHOR = 13, 5
FILTER_BITS = 27
DOC_FILTER_BITS = 24
#: Word hashes that a worker remembers within a task; those of longer words than LONGEST_REMEMBERED bytes are worked out each time.
REMEMBERED, LONGEST_REMEMBERED = 100_000, 64
#: A place is a long: a few bits of the text (for rows that share a doc_id), the word's number.
PLACE_BITS, TEXT_BITS = 28, 11
#: Anchors are told apart by so many bits; two that agree in them only let more windows go on.
ANCHOR_BITS = 48
FIRST, SECOND, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes:
    """64-bit hashes of words; what a worker remembers is bounded."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def forget(self) -> None:
        self.known.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        alone(self)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = set(words).difference(known)
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
        out = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        for w in [w for w in new if len(w) > LONGEST_REMEMBERED]:
            del known[w]
        return out


WORDS = WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def rolled(hashes: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    """A hash of every run of size words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * by + hashes[k : k + n]
    return _mixed(out)


def anchors_of(hashes: np.ndarray) -> np.ndarray:
    """The anchor of every window."""
    low, width = rolled(hashes, ANCHOR, SECOND), 1
    while width < WINDOW - ANCHOR + 1:
        step = min(width, WINDOW - ANCHOR + 1 - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def text_bits(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, 1) & ((1 << TEXT_BITS) - 1)


def bit_filter(hashes: DataFrame, bits: int) -> Broadcast:
    """A broadcast set of the lower bits of the one long column of hashes: 2^bits bits, whatever the number of rows.

    Chunks of 2^15 bits are put together by the tasks that hold them; the driver only joins these.
    """
    spark = hashes.sparkSession
    column = hashes.columns[0]
    size = min(bits, 15)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            low = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << bits) - 1)
            chunk = (low >> np.uint64(size)).astype(np.int64)
            order = np.argsort(chunk, kind="stable")
            low, chunk = low[order], chunk[order]
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
            for a, b in zip(first, [*first[1:], len(chunk)]):
                kept = chunks.setdefault(int(chunk[a]), np.zeros(1 << size, dtype=bool))
                kept[(low[a:b] & np.uint64((1 << size) - 1)).astype(np.int64)] = True
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in chunks.values()], pa.binary())], ["chunk", "bits"])

    dealt = hashes.repartition(F.shiftright(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)), size))
    out = np.zeros(1 << bits >> 3, dtype=np.uint8)
    width = 1 << size >> 3
    for r in dealt.mapInArrow(gather, "chunk int, bits binary").toLocalIterator():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def in_filter(bits: bytes, size: int, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64((1 << size) - 1)
    return (np.frombuffer(bits, dtype=np.uint8)[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def text_key() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("chars")]


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, chars) of rows of docs (doc_id, text) whose text a smaller document has: same length and same 128 bits of hashes."""
    keys = stored(docs.where("doc_id is not null and text is not null").select("doc_id", *text_key()), "text-keys")
    firsts = stored(keys.groupBy("h1", "h2", "chars").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "first-copies")
    return keys.join(firsts, ["h1", "h2", "chars"]).where("first < doc_id").select("doc_id", "h1", "h2", "chars").distinct()


def repeated_anchors(docs: Rows) -> DataFrame:
    """(anchor) of anchors found in two rows or more, each counted once a row. No doc_id goes along: where rows share one,
    more anchors are marked than repeat in two documents, and their windows are told apart later."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for name, t in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
            words = t.split() if t and name is not None else []
            if len(words) >= WINDOW:
                found.append(np.unique(anchors_of(WORDS.of(words)) & np.uint64((1 << ANCHOR_BITS) - 1)))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["anchor"])

    return docs.map(work, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")


def edges(docs: Rows, marked: Broadcast) -> DataFrame:
    """(edge, doc_id, at) of the windows with a marked anchor, each once for a document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for name, t in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
            words = t.split() if t and name is not None else []
            if len(words) < WINDOW:
                continue
            hashes = WORDS.of(words)
            at = np.flatnonzero(in_filter(marked.value, FILTER_BITS, anchors_of(hashes)))
            if len(at) == 0:
                continue
            edge, first = np.unique(rolled(hashes, WINDOW, FIRST)[at], return_index=True)
            at = at[first]
            parts.append((edge.view(np.int64), np.full(len(at), name, dtype=np.int64), at + (text_bits(t) << PLACE_BITS)))
        if not parts:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["edge", "doc_id", "at"])

    return docs.map(work, "edge long, doc_id long, at long")


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, at, size, source, source_at): nonbranching paths of windows that a smaller document also has.

    at and source_at hold text bits and word number; size counts windows.
    """
    of_edge = Window.partitionBy("edge").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_source = found.withColumns({"source": F.first("doc_id").over(of_edge), "source_at": F.first("at").over(of_edge)})
    met = with_source.where("source < doc_id").select("doc_id", "at", "source", (F.col("source_at") - F.col("at")).alias("apart"))
    place = Window.partitionBy("doc_id").orderBy("source", "apart", "at")
    path = met.withColumn("path", F.col("at") - F.row_number().over(place))
    return path.groupBy("doc_id", "source", "apart", "path").agg(F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("size")).select("doc_id", "at", "size", "source", (F.col("at") + F.col("apart")).alias("source_at"))


def id_filter(ids: DataFrame) -> Broadcast:
    """A bit filter of the ids in the one column."""
    return bit_filter(ids.select(F.xxhash64(ids.columns[0]).alias("h")), DOC_FILTER_BITS)


@dataclass(frozen=True)
class Rows:
    """Tables of (doc_id, text and more), each with tests of its ids by bit filters: (filter, whether ids in it pass).

    Null ids are in no filter; a filter may hold others than it was made for. Tests run in the task that does the work
    on the rows, so that no second Python worker stands beside it.
    """

    tables: tuple[tuple[DataFrame, tuple[tuple[Broadcast, bool], ...]], ...]

    def passing(self, marked: Broadcast, inside: bool) -> Rows:
        return Rows(tuple((df, (*tests, (marked, inside))) for df, tests in self.tables))

    def map(self, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._map(df, tests, work, schema) for df, tests in self.tables])

    def rows(self) -> DataFrame:
        return self.map(lambda batch: batch, self.tables[0][0].schema)

    def packed_rows(self) -> DataFrame:
        """The rows with their texts packed, to be shuffled."""
        plain = self.tables[0][0].schema
        schema = StructType([StructField(f.name, BinaryType()) if f.name == "text" else f for f in plain.fields])
        return self.map(partial(pack_texts, at=plain.names.index("text")), schema)

    @staticmethod
    def _map(df: DataFrame, tests: tuple[tuple[Broadcast, bool], ...], work: Callable, schema: str | StructType) -> DataFrame:
        names = df.columns

        def tested(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            hashes = batch.column(len(names)).to_numpy(zero_copy_only=False).view(np.uint64)
            null = np.asarray(batch.column(0).is_null())
            kept = np.ones(batch.num_rows, dtype=bool)
            for marked, inside in tests:
                kept &= (in_filter(marked.value, DOC_FILTER_BITS, hashes) & ~null) == inside
            passed = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(kept))
            return work(passed) if passed.num_rows else None

        return arrow_map(df.withColumn("_hash", F.xxhash64("doc_id")), tested, schema)


def digest_of(words: list[bytes], at: int, size: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[at : at + size + WINDOW - 1]))


def pack_texts(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """The batch with its column of texts packed one by one: its length in eight bytes, then zstd."""
    codec = pa.Codec("zstd")
    packed = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts_as_bytes(batch.column(at))]
    columns = [pa.array(packed, pa.binary()) if k == at else c for k, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def unpacked_texts(column: pa.Array) -> list[bytes | None]:
    codec = pa.Codec("zstd")
    return [None if p is None else codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True) for p in column.to_pylist()]


def _inside(place: int) -> tuple[int, int]:
    return place >> PLACE_BITS, place & ((1 << PLACE_BITS) - 1)


def source_digests(docs: Rows, found: DataFrame) -> DataFrame:
    """(source, source_at, size, digest) of the words at the source coordinates, asked once each."""
    asked = found.select("source", "source_at", "size").distinct().groupBy("source").agg(F.collect_list(F.struct("source_at", "size")).alias("asked"))
    asked = stored(asked, "asked")
    rows = docs.passing(id_filter(asked.select("source")), True).packed_rows().join(asked.withColumnRenamed("source", "doc_id"), "doc_id")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, t, asked_of in zip(batch.column(0).to_pylist(), unpacked_texts(batch.column(1)), batch.column(2).to_pylist()):
            words, bits = (t or b"").split(), text_bits(t or b"")
            for a in asked_of:
                text, at = _inside(a["source_at"])
                if text == bits:
                    out.append((name, a["source_at"], a["size"], digest_of(words, at, a["size"])))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["source", "source_at", "size", "digest"])

    return arrow_map(rows.select("doc_id", "text", "asked"), work, "source long, source_at long, size int, digest binary").distinct()


def kept_words(words: list[bytes], removable: list[dict], bits: int) -> list[bytes]:
    """The words that no verified span's windows cover."""
    if len(words) < WINDOW or not removable:
        return words
    edge = rolled(WORDS.of(words), WINDOW, FIRST)
    gone = np.zeros(len(edge), dtype=bool)
    for s in removable:
        text, at = _inside(s["at"])
        if text == bits and at + s["size"] <= len(edge) and digest_of(words, at, s["size"]) == s["digest"]:
            gone[at : at + s["size"]] = True
    if not gone.any():
        return words
    gone = np.isin(edge, edge[gone])
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, np.flatnonzero(gone), 1)
    np.add.at(steps, np.flatnonzero(gone) + WINDOW, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", texts: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, text, rest) of every document, or with texts=False kept_sha256 in place of text.

    rest is a struct of the columns named in carry, null without any.

    A text that loses nothing stays as it is; of another, the kept words are joined by one space. A null text has no
    words (and stays null). Rows with a null doc_id lose nothing and are nobody's source. Rows that share a doc_id are
    no smaller than each other; each loses what a smaller document has. An empty table gives no rows; further columns
    are not looked at.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), rest.alias("rest"))
    copies = stored(exact_copies(every.select("doc_id", "text")), "copies")
    copied = id_filter(copies.select("doc_id"))
    # Rows that the filter lets in are few; those that are no copies after all (or have no copy's text) go back to the others.
    hashes, key = ["h1", "h2", "chars"], ["doc_id", "h1", "h2", "chars"]
    keyed = Rows(((every.withColumns(dict(zip(hashes, text_key()))), ()),)).passing(copied, True)
    back = stored(keyed.rows().join(copies, key, "left_anti").select("doc_id", "text", "rest"), "no-copies")
    rows = Rows(((every, ((copied, False),)), (back, ())))
    bare = Rows(tuple((df.drop("rest"), tests) for df, tests in rows.tables))
    marked = bit_filter(repeated_anchors(bare), FILTER_BITS)
    found = stored(spans(edges(bare, marked)), "spans")
    digests = stored(source_digests(bare, found), "digests")
    verified = found.join(digests, ["source", "source_at", "size"]).groupBy("doc_id").agg(F.collect_set(F.struct("at", "size", "digest")).alias("removable"))
    verified = stored(verified, "verified")
    own = id_filter(verified.select("doc_id"))

    def result(batch: pa.RecordBatch, copy: bool = False, packed: bool = False) -> pa.RecordBatch:
        n, removed, last = [], [], []
        found_texts = unpacked_texts(batch.column(1)) if packed else texts_as_bytes(batch.column(1))
        lists = batch.column(3).to_pylist() if packed else [None] * batch.num_rows
        for t, removable in zip(found_texts, lists):
            words = (t or b"").split()
            kept = kept_words(words, removable, text_bits(t)) if removable and words else words
            if copy and len(words) >= WINDOW:
                kept = []
            n.append(len(words))
            removed.append(len(words) - len(kept))
            if texts:
                last.append(t if len(kept) == len(words) else b" ".join(kept))
            else:
                last.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        final = pa.array(last, pa.binary()).cast(pa.string()) if texts else pa.array(last, pa.string())
        own_columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), final, batch.column(2)]
        return pa.RecordBatch.from_arrays([*own_columns, *(batch.columns[3:] if copy else [])], [*schema.names, *(hashes if copy else [])])

    name = "text" if texts else "kept_sha256"
    schema = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add(name, "string").add("rest", every.schema["rest"].dataType)
    inside = rows.passing(own, True).packed_rows().join(verified, "doc_id", "left").select("doc_id", "text", "rest", "removable")
    # What is left of a copy is short or nothing, so its text ends here and the rest meets the keys of copies.
    with_key = StructType([*schema.fields, *keyed.tables[0][0].select(hashes).schema.fields])
    of_copies = keyed.map(partial(result, copy=True), with_key).join(copies, key, "left_semi").select(schema.names)
    parts = [arrow_map(inside, partial(result, packed=True), schema), rows.passing(own, False).map(result, schema), of_copies]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what all documents lose and keep."""
    return without_repeats(documents(spark, sf_dir), texts=False).drop("rest")


OP6_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from d where len(w) >= 13),
wins as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as k from starts),
low as (select k, min(doc_id) as first from wins group by k),
bad as (select distinct wins.doc_id, wins.i + o.o as i from wins join low using (k), (select unnest(range(13)) as o) o where low.first < wins.doc_id),
gone as (select doc_id, count(*) as n, list(i) as places from bad group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed,
       sha256(case when g.n is null then coalesce(array_to_string(d.w, ' '), '')
              else coalesce((select string_agg(w, ' ' order by i) from (select unnest(d.w) as w, unnest(range(1, len(d.w) + 1)) as i) u
                             where not list_contains(g.places, i)), '') end) as kept_sha256
from d left join gone g using (doc_id)
"""
