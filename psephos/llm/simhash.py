"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints: a bit is 1 if it is set in over half of the XXH64 hashes of a text's shingles. Two fingerprints are linked
if they differ in at most 4 bits. Finding the links:

- The 64 bits are split into three segments (22, 21 and 21 bits). Of at most 4 errors, some two segments hold at most 2.
- A segment, as a word of 23 bits, is decoded by the perfect binary (23, 12) Golay code. Its keys are the codewords that
  it and its neighbours at one bit decode to: 1 key or 6. Two words at most 2 bits apart have a word between them, at one
  bit or less from both, whose codeword is a key of both.
- So two linked fingerprints share a pair of keys in one of the three pairs of segments. They meet in the group of that
  pair of keys, where the exact distance is verified.

Only distinct fingerprints are compared. A group gives the links of a spanning forest, not all its pairs. Groups of more
than GROUP fingerprints are split into blocks, and every pair of blocks is compared by itself, so no task holds more.

The pipeline's stage asks for similar texts instead (near_texts): the same keys of wider fingerprints give candidates at
a larger radius, beyond what the keys guarantee, and the similarity is computed on the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import arrow_map, documents, stored, texts_as_bytes
from psephos.llm.components import components
from psephos.llm.substrings import FILTER_BITS, bit_filter, in_filter

SHINGLE, SEED, MOST_BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GROUP = 20_000
#: Fingerprints whose keys one task works out.
KEYED = 20_000
#: Rows of a group up to which near_texts takes all its pairs at once.
SMALL = 16
#: Rows and members of sets in one block of a family; a task compares two blocks.
BLOCK, MEMBERS = 400, 400_000
#: Fingerprints of 64 bits that near_texts takes of a text: one 128-bit hash of each shingle gives both.
WIDE = 2
#: Hashes counted at a time, so that a very long text needs little memory.
STRETCH = 200_000
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: bytes | None) -> int:
    """Of a whole text: A-Z in lower case, words between ASCII white space, shingles with repeats; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STRETCH):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + STRETCH)].tolist(), last[at : at + STRETCH].tolist())], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > n))


def _remainder(word: int) -> int:
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= GOLAY << (k - 11)
    return word


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, patterns): remainders of the lower 12 and upper 11 bits; for each remainder the error patterns that
    lead to the word's keys - first the least one, then those of weight 4 if the least one has weight 3, else repeats."""
    low = np.array([_remainder(w) for w in range(1 << 12)], dtype=np.int64)
    high = np.array([_remainder(w << 12) for w in range(1 << 11)], dtype=np.int64)
    one = [_remainder(1 << k) for k in range(23)]
    found: dict[int, list[int]] = {0: [0]}
    weight = {0: 0}
    for size in (1, 2, 3, 4):
        for places in combinations(range(23), size):
            s = 0
            for k in places:
                s ^= one[k]
            pattern = sum(1 << k for k in places)
            if s not in found:
                found[s], weight[s] = [pattern], size
            elif size == 4 and weight[s] == 3:
                found[s].append(pattern)
    patterns = np.array([(found[s] + found[s][:1] * 6)[:6] for s in range(1 << 11)], dtype=np.int64)
    return low, high, patterns


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Six keys (with repeats) of each 23-bit word: the upper 12 bits of the codewords, which identify them."""
    low, high, patterns = golay_tables()
    remainder = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[remainder]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for fingerprints: each pair of segments gives the pairs of their keys, each once."""
    keys = [golay_keys(((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    # Repeats stand at the end of a row's six keys: a word has either one key or six.
    six = [k[:, 1] != k[:, 0] for k in keys]
    rows, out = [], []
    for pair, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        for i in range(6):
            for j in range(6):
                real = np.flatnonzero((six[a] if i else np.True_) & (six[b] if j else np.ones(len(prints), dtype=bool)))
                rows.append(real)
                out.append((pair << 24) | (keys[a][real, i] << 12) | keys[b][real, j])
    return np.concatenate(rows), np.concatenate(out)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, print) of every whole text; print holds the 64 bits as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t) for t in texts_as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "print"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), work, "doc_id long, print long")


def near(prints: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ others[None, :]) <= MOST_BITS


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning(prints: np.ndarray, ids: np.ndarray, block: int = 512) -> Iterator[tuple[int, int]]:
    """Links (id, id) that tie together what the links within one group tie together. Memory: block^2."""
    forest = Forest(len(ids))
    for i in range(0, len(ids), block):
        for j in range(i, len(ids), block):
            for a, b in zip(*(x.tolist() for x in np.nonzero(near(prints[i : i + block], prints[j : j + block])))):
                if i + a < j + b and forest.tie(i + a, j + b):
                    yield int(ids[i + a]), int(ids[j + b])


def links_in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (group, print, rep) that come sorted by group. What is held is one group, or part of one batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def found(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        out: list[tuple[int, int]] = []
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(first, len(keys)))
        # Small groups together: each row against the one so many places on, while it is of the same group.
        small = np.repeat(sizes <= 32, sizes)
        for step in range(1, int(min(32, sizes.max()))):
            hit = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:]) & (np.bitwise_count(prints[:-step] ^ prints[step:]) <= MOST_BITS))
            out += zip(ids[hit].tolist(), ids[hit + step].tolist())
        for at, n in zip(first[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
            out += spanning(prints[at : at + n], ids[at : at + n])
        out = [x for x in dict.fromkeys(out) if x[0] != x[1]]
        if out:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
        return None

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, prints, ids = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
        return key, prints.view(np.uint64), ids

    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        if held and now[0][-1] == held[0][0][0]:
            held.append(now)  # the group goes on
            continue
        keys, prints, ids = (np.concatenate(x) for x in zip(*held, now))
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut and (out := found(keys[:cut], prints[:cut], ids[:cut])) is not None:
            yield out
        held = [(keys[cut:], prints[cut:], ids[cut:])]
    if held:
        keys, prints, ids = (np.concatenate(x) for x in zip(*held))
        if (out := found(keys, prints, ids)) is not None:
            yield out


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key to one task for every KEYED of them, as each row gives many keys."""
    return rows.repartition(max(1, -(-rows.count() // KEYED)), key)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the rows of distinct (print, rep), enough to tie together all that are linked."""

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        rows, keys = fuzzy_keys(prints.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows]), pa.array(ids[rows])], ["group", "print", "rep"])

    rows = arrow_map(spread(distinct.select("print", "rep"), "print"), keyed, "group long, print long, rep long", rows=2000)
    large = stored(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP), "large-groups")
    if large.isEmpty():
        return rows.repartition("group").sortWithinPartitions("group", "print").mapInArrow(links_in_order, "a long, b long")
    usual = rows.join(large, "group", "left_anti").select("group", "print", "rep")
    found = usual.repartition("group").sortWithinPartitions("group", "print").mapInArrow(links_in_order, "a long, b long")
    # Blocks of a large group, every two of them together: row block i goes to the pairs (i, 0..blocks-1).
    blocks = F.ceil(F.col("n") / (GROUP // 2))
    block = F.pmod(F.xxhash64(F.col("print")), blocks)
    salted = rows.join(large, "group").select("group", "print", "rep", block.alias("i"), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("j"))
    pair = F.xxhash64("group", F.least("i", "j"), F.greatest("i", "j"))
    split = salted.select(pair.alias("group"), "print", "rep").repartition("group").sortWithinPartitions("group", "print")
    return found.unionByName(split.mapInArrow(links_in_order, "a long, b long"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Texts without words (null ones too) have fingerprint zero and are linked like any other. A row with a null doc_id
    takes the component of its fingerprint, null if no row with an id has it; rows that share a doc_id are one document
    in the components; an empty table gives no rows; further columns of docs are not looked at.
    """
    prints = stored(fingerprints(docs, text, doc_id), "fingerprints")
    distinct = stored(prints.where(F.col("doc_id").isNotNull()).groupBy("print").agg(F.min("doc_id").alias("rep")), "distinct-prints")
    found = components(links(distinct)).withColumnRenamed("node", "rep")
    classes = stored(distinct.join(found, "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id")), "classes")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(classes, "print", "left").select("doc_id", hexed.alias("fingerprint"), "component_id")


def lower_words(text: bytes | None) -> list[bytes]:
    """Words as fingerprint() takes them."""
    return (text or b"").lower().split()


def shingle_set(words: list[bytes], size: int) -> set[bytes]:
    """All runs of size words; a shorter text is one run, a text without words none."""
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def wide_print(shingles: set[bytes]) -> np.ndarray:
    """WIDE fingerprints of 64 bits over the XXH3 hashes of distinct shingles, so that the bits follow Jaccard similarity."""
    ones, n = np.zeros(64 * WIDE, dtype=np.int64), len(shingles)
    rest = iter(shingles)
    while part := b"".join(map(xxhash.xxh3_128_digest, islice(rest, STRETCH))):
        ones += np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, 8 * WIDE), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def wide_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for rows of WIDE fingerprints: the fuzzy keys of each, numbered apart."""
    found = [fuzzy_keys(prints[:, k]) for k in range(WIDE)]
    return np.concatenate([r for r, _ in found]), np.concatenate([k + ((3 * n) << 24) for n, (_, k) in enumerate(found)])


def first_shared(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The first key that two rows of fingerprints share (-1: none): of all groups where they meet one gives the pair."""
    out = np.full(len(one), -1, dtype=np.int64)
    for n in reversed(range(WIDE)):
        shared = []
        for at, size in SEGMENTS:
            a, b = (golay_keys(((x[:, n] >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64)) for x in (one, other))
            shared.append(np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, 1 << 12).min(axis=1))
        for pair, (i, j) in reversed(list(enumerate(combinations(shared, 2)))):
            out = np.where((i < 1 << 12) & (j < 1 << 12), ((3 * n + pair) << 24) | (i << 12) | j, out)
    return out


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each row of fingerprints of x differs from each of y."""
    return sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.int16) for k in range(WIDE))


def clusters(prints: np.ndarray, bits: int, block: int = 64) -> Iterator[np.ndarray]:
    """The rows in parts: rows within the radius of each other, directly or over others, are in one. Memory: block times rows."""
    left = np.arange(len(prints))
    while len(left):
        part, front, left = [], left[:1], left[1:]
        while len(front):
            now, front = front[:block], front[block:]
            part.append(now)
            reached = (apart(prints[now], prints[left]) <= bits).any(axis=0)
            front, left = np.concatenate([front, left[reached]]), left[~reached]
        yield np.concatenate(part)


def pairs_in_order(bits: int, block: int = 256) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, dist, degree, around) of rows (group, key, node, prints) sorted by group.

    Of a group of up to SMALL rows all pairs within the radius whose first shared key is its key. Of a larger one, for each
    row with a neighbour within the radius, its nearest one (dist) if the group's key is the first that the two share;
    for the first kind of keys, a row with about the most neighbours (degree); and one row for each of its clusters of two
    rows or more (around), at most GROUP of them.
    """

    def batch(a: np.ndarray, b: np.ndarray, dist: np.ndarray | None = None, degree: np.ndarray | None = None) -> pa.RecordBatch:
        rest = [pa.nulls(len(a), pa.int32()) if x is None else pa.array(x, pa.int32()) for x in (dist, degree)]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *rest, pa.nulls(len(a), pa.list_(pa.int64()))], names)

    names = ["a", "b", "dist", "degree", "around"]

    def pairs(i: np.ndarray, j: np.ndarray, key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        real = node[i] != node[j]
        i, j = i[real], j[real]
        own = first_shared(prints[i], prints[j]) == key[i]
        a, b = node[i[own]], node[j[own]]
        return batch(np.minimum(a, b), np.maximum(a, b))

    def some(at: int, n: int, key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of one large group: its clusters, each row's nearest one and the group's hub. Memory: block^2."""

        def own(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return first_shared(prints[i], prints[j]) == key[at]

        rows = np.arange(at, at + n)
        least, nearest, degree = np.full(n, bits + 1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i in range(0, n, block):
            for j in range(0, n, block):
                d = apart(prints[at + i : at + min(i + block, n)], prints[at + j : at + min(j + block, n)])
                d[node[rows[i : i + block], None] == node[None, rows[j : j + block]]] = bits + 1
                degree[i : i + block] += (d <= bits).sum(axis=1)
                here = d.argmin(axis=1)
                lower = d[np.arange(len(d)), here]
                better = lower < least[i : i + block]
                least[i : i + block][better] = lower[better]
                nearest[i : i + block][better] = j + here[better]
        tied = np.flatnonzero(degree)
        if len(tied):
            parts = [node[rows[tied[c]]] for c in clusters(prints[rows[tied]], bits)]
            empty = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(parts, pa.list_(pa.int64()))], names)
            i, j = rows[tied], rows[nearest[tied]]
            mine = own(i, j)
            yield batch(node[i[mine]], node[j[mine]], dist=least[tied][mine])
            # Of the rows with about the most neighbours the one with the smallest number, so that groups agree on it.
            central = np.flatnonzero(degree >= 0.9 * degree.max())
            hub = int(central[node[rows[central]].argmin()])
            around = np.flatnonzero((apart(prints[at : at + n], prints[at + hub : at + hub + 1])[:, 0] <= bits) & (node[rows] != node[at + hub]))
            if key[at] >> 24 == 0:  # one of the kinds of keys is enough for hubs
                yield batch(node[rows[around]], np.full(len(around), node[at + hub]), degree=np.full(len(around), degree[hub]))

    def found(group: np.ndarray, key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(first, len(group)))
        small = np.repeat(sizes <= SMALL, sizes)
        for step in range(1, int(min(SMALL, sizes.max()))):
            at = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
            at = at[np.bitwise_count(prints[at] ^ prints[at + step]).sum(axis=1) <= bits]
            if len(at):
                yield pairs(at, at + step, key, node, prints)
        for at, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            yield from some(at, n, key, node, prints)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for rows in batches:
            if not rows.num_rows:
                continue
            group, key, node, *rest = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in rows.columns)
            now = [group, key, node, np.stack(rest, axis=1).view(np.uint64)]
            held.append(now)
            if now[0][-1] == held[0][0][0]:
                continue  # the group goes on
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            yield from found(*(x[:cut] for x in whole))
            held = [[x[cut:] for x in whole]]
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held)))

    return run


def near_pairs(distinct: DataFrame, bits: int) -> DataFrame:
    """pairs_in_order() of the rows of distinct (node, prints), dealt by their keys."""
    columns = ["node", *[f"p{k}" for k in range(WIDE)]]

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows, keys = wide_keys(np.stack(held[1:], axis=1).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c[rows]) for c in held)], ["key", *columns])

    schema = ", ".join(f"{c} long" for c in ["key", *columns])
    rows = arrow_map(spread(distinct.select(*columns), "node"), keyed, schema, rows=1000)
    large = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP), "large-groups")

    def within(dealt: DataFrame) -> DataFrame:
        return dealt.select("group", "key", *columns).repartition("group").sortWithinPartitions("group").mapInArrow(pairs_in_order(bits), "a long, b long, dist int, degree int, around array<long>")

    if large.isEmpty():
        return within(rows.withColumn("group", F.col("key")))
    # As in links(): blocks of a large group, every two of them together.
    blocks = F.ceil(F.col("n") / (GROUP // 2))
    block = F.pmod(F.xxhash64("node"), blocks)
    split = rows.join(large, "key").withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    split = split.withColumn("group", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")))
    return within(rows.join(large, "key", "left_anti").withColumn("group", F.col("key"))).unionByName(within(split))


def shared_members(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, size, shared, members) of texts (node, text): how many shingles a text has, how many of them another text has
    too, and these as 64-bit hashes.

    What others have comes from a bit filter of fixed size, so it may be too much, never too little.
    """

    def hashes(text: bytes | None) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, shingle_set(lower_words(text), shingle)), dtype=np.uint64)

    def members(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = np.concatenate([np.zeros(0, dtype=np.uint64), *map(hashes, texts_as_bytes(batch.column(0)))])
        return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], ["h"])

    often = arrow_map(texts.select("text"), members, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    marked = bit_filter(often, FILTER_BITS)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = list(map(hashes, texts_as_bytes(batch.column(1))))
        kept = [h[in_filter(marked.value, FILTER_BITS, h)] for h in each]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in each], pa.int64()), pa.array([len(h) for h in kept], pa.int64()), pa.array([h.tobytes() for h in kept], pa.binary())], ["node", "size", "shared", "members"])

    return arrow_map(texts.select("node", "text"), count, "node long, size long, shared long, members binary")


def common_members(sets: Sequence[np.ndarray], often: int = 32, columns: int = 1024) -> np.ndarray:
    """[i, j], i < j: how many members two sets have in common. What up to `often` sets have is counted pair by pair, what
    all have once, the rest by products of 0/1 matrices of so many columns."""
    n = len(sets)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), [len(x) for x in sets])
    out = np.full((n, n), int((counts == n).sum()), dtype=np.int64)
    few = (counts[ids] > 1) & (counts[ids] <= often) & (counts[ids] < n)
    order = np.lexsort((rows[few], ids[few]))
    i, h = rows[few][order], ids[few][order]
    for step in range(1, min(often, len(h))):
        hit = np.flatnonzero(h[:-step] == h[step:])
        if not len(hit):
            break
        out += np.bincount(i[hit] * n + i[hit + step], minlength=n * n).reshape(n, n)
    many = (counts[ids] > often) & (counts[ids] < n)
    held, at = np.unique(ids[many], return_inverse=True)
    i, order = rows[many], np.argsort(at, kind="stable")
    i, at = i[order], at[order]
    for start in range(0, len(held), columns):
        here = slice(*np.searchsorted(at, [start, start + columns]))
        ones = np.zeros((n, columns), dtype=np.float32)
        ones[i[here], at[here] - start] = 1
        out += (ones @ ones.T).astype(np.int64)
    return out


def forest_of_sets(similarity: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) of rows (group, node, component, upper, size, members) sorted by group: enough to tie together what the
    similar pairs of a group tie together that its components don't. Pairs of two upper rows are left to another group."""

    def found(node: list[int], component: list[int], upper: list[bool], size: list[int], members: list[bytes]) -> pa.RecordBatch | None:
        if len(set(component)) < 2:
            return None
        first: dict[int, int] = {}
        forest = Forest(len(node))
        for k, c in enumerate(component):
            forest.tie(first.setdefault(c, k), k)
        both = common_members([np.frombuffer(m, dtype=np.uint64) for m in members])
        sizes, high, out = np.array(size), np.array(upper), []
        for i in range(len(node) - 1):
            near = both[i, i + 1 :] >= similarity * (size[i] + sizes[i + 1 :] - both[i, i + 1 :])
            for j in np.flatnonzero(near & ~(high[i] & high[i + 1 :])).tolist():
                if forest.tie(i, i + 1 + j):
                    out.append((node[i], node[i + 1 + j]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        last = None
        for rows in batches:
            for group, *row in zip(*(c.to_pylist() for c in rows.columns)):
                if group != last and held[0]:
                    if (out := found(*held)) is not None:
                        yield out
                    held = [[], [], [], [], []]
                last = group
                for x, value in zip(held, row):
                    x.append(value)
        if held[0] and (out := found(*held)) is not None:
            yield out

    return run


def family_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of rows (node, family, component, size, members): a forest of the similar pairs of each family.

    Similar sets are of similar size: a set meets those of its own band of sizes and of the next. The rows of a band and the
    next are dealt into blocks of about BLOCK rows and MEMBERS members, and every two blocks are compared by themselves.
    What is shuffled is each set once for every other block, never a pair, and what a task gives is less than its rows.
    """
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(float(np.log(1 / similarity)) + 0.001))
    levels = rows.withColumn("band", band).withColumn("level", F.explode(F.array(F.col("band") - 1, "band"))).withColumn("upper", F.col("band") > F.col("level"))
    several = stored(levels.groupBy("family", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("shared").alias("total"), F.min("component").alias("least"), F.max("component").alias("most"), F.min("upper").alias("alone")).where("least <> most and not alone").drop("least", "most", "alone"), "families")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / MEMBERS), F.lit(1)).cast("int")
    dealt = levels.join(several, ["family", "level"]).withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or i <> j")
    dealt = dealt.withColumn("group", F.xxhash64("family", "level", F.least("i", "j"), F.greatest("i", "j")))
    return dealt.select("group", "node", "component", "upper", "size", "members").repartition("group").sortWithinPartitions("group").mapInArrow(forest_of_sets(similarity), "a long, b long")


def node_of(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def nodes_of_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(node, text) for rows of text."""
    nodes = np.array([node_of(lower_words(t)) for t in texts_as_bytes(batch.column(0))], dtype=np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column(0)], ["node", "text"])


def near_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, bits: int = 34) -> DataFrame:
    """(doc_id, node, component) of every document: components of texts with a Jaccard similarity of their sets of
    shingles of at least the one given.

    A node is the 64-bit hash of a text's words in lower case, so texts of the same words are one node (texts without
    words too). Candidates are pairs that share a Golay key of WIDE fingerprints and differ in at most bits of their
    64 * WIDE bits; the similarity is then computed on the texts. No pair below it is linked; what of the pairs above it
    the keys miss is given in README. Of a large group no pairs are listed: each text's nearest one and the group's hub
    come first; then texts that may have further partners are compared as sets of 64-bit hashes of their shingles, in blocks
    of their family, and each pair of blocks gives a forest of links between what is not tied yet.
    """
    prints = [f"p{k}" for k in range(WIDE)]

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, wide = [], []
        for t in texts_as_bytes(batch.column(1)):
            words = lower_words(t)
            nodes.append(node_of(words))
            wide.append(wide_print(shingle_set(words, shingle)))
        columns = np.array(wide, dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), *(pa.array(columns[:, k]) for k in range(WIDE))], ["doc_id", "node", *prints])

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for one, other in zip(texts_as_bytes(batch.column(2)), texts_as_bytes(batch.column(3))):
            x, y = (shingle_set(lower_words(t), shingle) for t in (one, other))
            both = len(x & y)
            keep.append(both >= similarity * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marks = stored(arrow_map(whole, marked, "doc_id long, node long, " + ", ".join(f"{p} long" for p in prints)), "wide-prints")
    distinct = stored(marks.select("node", *prints).distinct(), "distinct-prints")
    met = stored(near_pairs(distinct, bits), "near-pairs")
    if met.isEmpty():
        return marks.select("doc_id", "node", F.col("node").alias("component"))
    open_nodes = stored(met.where("around is not null").select(F.explode("around").alias("node")).distinct(), "open")
    pairs = met.where("a is not null")
    asked = stored(reduce(DataFrame.unionByName, [pairs.select(F.col("a").alias("node")), pairs.select(F.col("b").alias("node")), open_nodes]).distinct(), "asked")
    texts = stored(arrow_map(whole.select("text"), nodes_of_texts, "node long, text string").join(asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "asked-texts")

    def verified(some: DataFrame) -> DataFrame:
        read = some.join(texts.withColumnsRenamed({"node": "a", "text": "one"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "other"}), "b")
        return stored(arrow_map(read.select("a", "b", "one", "other"), alike, "a long, b long", rows=64), "similar-pairs")

    # First the pairs of small groups, each text's nearest one and its hub in larger ones.
    nearest = met.where("dist is not null").groupBy("a").agg(F.min(F.struct("dist", "b"))["b"].alias("b"))
    hubs = met.where("degree is not null").groupBy("a").agg(F.max(F.struct("degree", "b"))["b"].alias("b"))
    some = pairs.where("dist is null and degree is null").select("a", "b").unionByName(nearest).unionByName(hubs)
    tied = verified(some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = stored(components(tied), "tied")
    # Then the texts in clusters of larger groups: clusters that share a text are one family, whose sets are compared whole.
    if open_nodes.isEmpty():
        found = known
    else:
        # A text that shares too few of its shingles with any other has no partner at all; without these, the others share
        # fewer, so it is counted twice.
        fits = F.col("shared") >= similarity * F.col("size")
        enough = stored(shared_members(texts.join(open_nodes, "node", "left_semi"), shingle).where(fits).select("node"), "enough")
        sets = stored(shared_members(texts.join(enough, "node", "left_semi"), shingle).where(fits), "members")
        families = components(met.where("around is not null").select(F.explode("around").alias("a"), F.array_min("around").alias("b"))).withColumnRenamed("component", "family")
        again = sets.join(families, "node").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        more = stored(family_links(stored(again, "open-sets"), similarity), "family-links")
        found = components(tied.unionByName(more))
    return marks.join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, all columns as they are, with one document of each component of near_texts: that with the smallest doc_id.

    Rows that share this doc_id all stay. Of a component without any doc_id one row stays; rows with a null doc_id in
    other components go. Null and empty texts have the same words and are one component; an empty table gives none.
    """
    marks = near_texts(docs, text, doc_id)
    least = stored(marks.groupBy("component").agg(F.min("doc_id").alias("least"), F.min("node").alias("node")), "least-of-each")
    kept = stored(least.where(F.col("least").isNotNull()).select(F.col("least").alias(doc_id)).distinct(), "kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(kept, doc_id, "left_semi").select(*columns)
    nameless = stored(least.where(F.col("least").isNull()).select("node"), "nameless")
    if nameless.isEmpty():
        return out
    row = F.struct(*columns)
    rows = docs.where(F.col(f"`{doc_id}`").isNull()).select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    # Texts of the same words are one node; of its rows the one with the smallest text is taken.
    named = arrow_map(rows.select("text").distinct(), nodes_of_texts, "node long, text string")
    chosen = named.join(nameless, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    one = rows.join(chosen, rows["text"].eqNullSafe(chosen["text"])).groupBy("node").agg(F.first("row").alias("row"))
    return out.unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints and components of all documents."""
    return near_duplicates(documents(spark, sf_dir))
