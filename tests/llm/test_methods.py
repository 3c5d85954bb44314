"""The methods by themselves: codes, keys, trees, tries, encoders, samples and awkward rows."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pyarrow as pa
import pytest

from psephos.llm import bpe, common, components, huffman, packing, simhash, tokens, topk, toxicity


@pytest.fixture(scope="module")
def word_bpe():
    return tokens.word_bpe()


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 300)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost
    steep = np.array([1, 1] + [int(1.7**k) + 1 for k in range(40)])
    lengths = huffman.code_lengths(steep)
    assert lengths.max() <= huffman.LONGEST and np.ldexp(1.0, -lengths).sum() <= 1


def test_one_block_from_its_checkpoint_alone():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 5000) % 3000
    lengths = huffman.code_lengths(np.bincount(ids, minlength=3000))
    bits, checkpoints = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
    table = huffman.decode_table(lengths)
    assert (huffman.decode(bits, checkpoints, len(ids), table) == ids).all()
    start = int(checkpoints[4])
    alone = huffman.decode(bits[start // 8 :], np.array([start % 8]), huffman.BLOCK, table)
    assert (alone == ids[4 * huffman.BLOCK : 5 * huffman.BLOCK]).all()


def test_several_segments_of_a_part(spark, tmp_path, monkeypatch, word_bpe):
    monkeypatch.setattr(huffman, "SEGMENT", 50)
    rows = [(k // 3, f"some words of text number {k} " * (k % 7)) for k in range(60)] + [(None, "no id"), (None, "no id"), (5, None)]
    huffman.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/files", word_bpe)
    got = huffman.read_token_files(spark, f"{tmp_path}/files").collect()
    ids = lambda t: [*tokens.encoder(word_bpe).tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert sorted(((r["doc_id"] is not None, r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=str) == sorted(((d is not None, d, ids(t)) for d, t in rows), key=str)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.append(0, np.cumsum([r["n_tokens"] for r in ordered]))[:-1].tolist()
    known = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert known == sorted(known)


def test_golay_keys_cover_radius_two():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 300)
    for k in range(23):
        for j in range(k, 23):
            other = words ^ (1 << k) ^ (0 if j == k else 1 << j)
            shared = (simhash.golay_keys(words)[:, :, None] == simhash.golay_keys(other)[:, None, :]).any(axis=(1, 2))
            assert shared.all()


def test_groups_in_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 120:
        prints.add(base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(sorted(prints))], "print long, rep long")
    found = []
    for group in (20_000, 16):
        monkeypatch.setattr(simhash, "GROUP", group)
        found.append(sorted(map(tuple, components.components(simhash.links(df)).collect())))
    assert found[0] == found[1]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("chunk", [4, 1 << 19])
def test_components_against_union_find(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(chunk)
    # A hub, random ties, a chain dealt over all tasks, loops and repeated edges, with negative and very large numbers.
    edges = [(5_000, k) for k in range(5_001, 5_400)] + [(rng.randrange(2_000), rng.randrange(2_000)) for _ in range(1_200)]
    edges += [(k, k + 1) for k in range(-200, -50)] + [(9_000, 9_000), (-(1 << 63), (1 << 63) - 1)] + edges[:300]
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    rng.shuffle(edges)
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()
    assert len(got) == len(parent) and dict(map(tuple, got)) == {x: top(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("copies", [1, 40])
def test_m_tree_against_brute_force(copies):
    rng = np.random.default_rng(5)
    vectors = np.repeat(rng.integers(-40, 40, (600 // copies, 8)).astype(float), copies, axis=0)
    ids = rng.permutation(len(vectors)).astype(np.int64)
    tree = topk.MTree.from_bytes(topk.MTree(ids, vectors).to_bytes())
    for q in range(0, len(vectors), 37):
        scores = np.floor(256 * vectors) @ np.floor(256 * vectors[q])
        want = sorted(((int(-s), int(i)) for s, i in zip(scores, ids) if i != ids[q]))[:5]
        assert tree.search(int(ids[q]), vectors[q], 5)[0] == [(-s, i) for s, i in want]


def test_top_k_awkward_vectors(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 1)
    monkeypatch.setattr(topk, "BLOCKS_PER_TASK", 1)
    rng = np.random.default_rng(6)
    rows = [(k % 130, rng.normal(size=4).round(2).tolist()) for k in range(200)]
    rows += [(50, [0.5, 0.5, 0.5, 0.5]), (0, None), (1, []), (2, [None, 1.0, 1.0, 1.0]), (3, [float("nan"), 1.0, 1.0, 1.0]), (4, [float("inf"), 1.0, 1.0, 1.0]), (None, [9.0, 9.0, 9.0, 9.0]), (100, [1.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = common.stored(topk.integer_vectors(df), "vectors")
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}))
    want = con.execute(topk.OP10_SQL).fetchall()
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(tuple(w) for w in want)
    assert sorted(set(r["query_id"] for r in got.collect())) == [0, 50, 100]


@pytest.mark.parametrize("size", [2.0**12, 2.0**20, 1e9, 1e30, 1e200, 1e300])
def test_top_k_of_large_vectors(spark, monkeypatch, size):
    """Scores beyond doubles and beyond 64 bits: against Python's integers."""
    from psephos.llm.exact import whole

    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "PAGE", 8)
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(0.2, 1, size=5) * (size if k % 3 else 1)).tolist()) for k in range(220)]
    rows += [(k + 1000, [size, 1.0, 0.5, k / 1024, 0.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = common.stored(topk.integer_vectors(df), "vectors")
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))
    held, want = [(i, [whole(c) for c in x]) for i, x in rows], []
    for q, v in held:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q)[:5]
            want += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_closing_a_bin_when_all_are_open():
    bins = packing.BestFit(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]
    assert bins.open <= 2


def test_trie_takes_long_words(word_bpe):
    trie, encoder = bpe.TrieBpe(word_bpe), tokens.encoder(word_bpe).tokenizer
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (1, 255, 256, 257, 258, 300, 5000)]
    words += [words[-1] + "tail", words[-1][:400], "a" * 100_000, "é" * 700]
    for w in words:
        assert trie.encode(w) == encoder.encode(w, add_special_tokens=False).ids


def test_encoder_on_odd_texts(word_bpe):
    encoder = tokens.encoder(word_bpe)
    rng = random.Random(8)
    signs = ["'S", "'t", "'re", "<|endoftext|>", "a", "B", " ", "İ", "Σ", "́", "é", "9", "²", "...", "\x1c", " ", "한", "🙂", "\n", "­"]
    texts = [None, "", " ", "<|startoftext|>"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    ids, ends = encoder.many(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, np.append(0, ends), ends):
        assert ids[a:b].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_samples_are_bounded_by_distinct_rows(spark):
    rows = [(None, "same", 1)] * 3000 + [(k, f"text {k}", k % 2) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = common.bounded_sample(df, "label", 100, "doc_id", "text").groupBy("label").count().collect()
    assert all(60 <= r["count"] <= 140 for r in got) and len(got) == 2
    again = common.bounded_sample(df.repartition(7), "label", 100, "doc_id", "text")
    assert sorted(map(str, again.collect())) == sorted(map(str, common.bounded_sample(df, "label", 100, "doc_id", "text").collect()))


def test_labels_repeated_and_null(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, None)], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    texts, counts = common.labelled_texts(docs, labelled, "quality", 100)
    assert sorted(map(tuple, texts.collect())) == [(1, "a", 1), (2, "b", 0)] and counts == {0: 1, 1: 2}


def test_planted_disguise_is_learned(spark):
    rng = random.Random(9)
    words = "the green house stands near a small river where people walk in the morning with their dogs".split()
    text = lambda *more: " ".join([*rng.sample(words, 10), *more])
    rows = [(k, text("grumbok") if k % 4 == 0 else text(), int(k % 4 == 0)) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, text("gru-mb0k")), (1001, text("g r u m b o k")), (1002, text())], "doc_id long, text string")
    model = toxicity.train_toxicity_model(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).where("doc_id >= 1000").collect()}
    assert got == {1000: 1, 1001: 1, 1002: 0}
