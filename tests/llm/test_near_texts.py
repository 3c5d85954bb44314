"""The pipeline's near-duplicate stage against similarities computed on the texts."""

from __future__ import annotations

import numpy as np

from psephos.llm.simhash import fingerprint, one_of_each


def jaccard(one: str, other: str, size: int = 5) -> float:
    x, y = ({tuple(t.split()[k : k + size]) for k in range(len(t.split()) - size + 1)} for t in (one, other))
    return len(x & y) / len(x | y)


def edited(words: list[str], places: list[int]) -> str:
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def test_similar_texts_beyond_four_bits(spark):
    rng = np.random.default_rng(5)
    rows, far = [], 0
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        near, unlike = edited(words, [40, 90, 140]), edited(words, list(range(10, 190, 20)))
        assert jaccard(" ".join(words), near) >= 0.8 > 0.7 > jaccard(" ".join(words), unlike)
        far += (fingerprint(" ".join(words).encode()) ^ fingerprint(near.encode())).bit_count() > 4
        rows += [(3 * k, " ".join(words)), (3 * k + 1, near), (3 * k + 2, unlike)]
    assert far > 30
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in range(180) if i % 3 != 1} <= kept
    assert sum(i % 3 == 1 for i in kept) <= 3


def test_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(100)]
    copy, alone, other = " ".join(words), " ".join(f"x{k}" for k in range(100)), " ".join(f"y{k}" for k in range(100))
    rows = [(1, copy, 0), (None, copy.upper(), 1), (None, alone, 2), (None, alone, 3), (None, alone + " end", 4), (None, other, 5), (None, None, 6), (None, "", 7)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    n = sorted(r["n"] for r in got)
    assert n[0] == 0 and len(n) == 4 and n[1] in (2, 3, 4) and n[2] == 5 and n[3] in (6, 7)
    assert all((r["doc_id"], r["text"], r["n"]) == rows[r["n"]] for r in got)


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Edits of one text by the hundred: components as those of all pairs, in groups over SMALL and over GROUP."""
    from psephos.llm import simhash

    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    texts = {" ".join(base)}
    while len(texts) < 120:
        texts.add(" ".join(f"new{rng.integers(1 << 30)}" if k in set(rng.choice(150, rng.integers(1, 7)).tolist()) else w for k, w in enumerate(base)))
    texts = sorted(texts)
    near = {(i, j) for i in range(120) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    up = list(range(120))
    for _ in range(120):
        for i, j in near:
            up[i] = up[j] = min(up[i], up[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for small, group in ((32, 20_000), (4, 20_000), (4, 16)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "GROUP", group)
        rows = simhash.near_texts(df).collect()
        first = {}
        for r in rows:
            first[r["component"]] = min(first.get(r["component"], 999), r["doc_id"])
        got = [first[r["component"]] for r in sorted(rows, key=lambda r: r["doc_id"])]
        assert sum(a != b for a, b in zip(got, up)) <= 2 and all(b <= a for a, b in zip(got, up))


def test_sets_in_common_against_python():
    from psephos.llm.simhash import common_members

    rng = np.random.default_rng(7)
    sets = [rng.choice(400, rng.integers(0, 300), replace=False).astype(np.uint64) for _ in range(70)]
    sets[3] = np.zeros(0, dtype=np.uint64)
    for often, columns in ((32, 1024), (3, 16), (1, 7), (100, 1024)):
        got = common_members(sets, often, columns)
        assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for j in range(70) for i in range(j))
    same = [np.arange(5, dtype=np.uint64)] * 3
    assert common_members(same)[0, 2] == 5 and common_members(same[:1]).shape == (1, 1)


def test_clusters_follow_chains():
    from psephos.llm.simhash import clusters

    chain = np.array([[(1 << k) - 1, 0] for k in range(0, 60, 3)] + [[0, 2**64 - 1]], dtype=np.uint64)
    order = np.random.default_rng(8).permutation(len(chain))
    parts = sorted(sorted(order[p].tolist()) for p in clusters(chain[order], 3, block=4))
    assert parts == [list(range(20)), [20]]


def template_family(n: int, rng) -> list[str]:
    """Texts of one template: each is near the template and below 0.8 of most others."""
    base = [f"w{x}" for x in rng.integers(0, 5000, 160)]
    return [edited_at(base, sorted(rng.choice(160, 3, replace=False).tolist()), f"v{k}") for k in range(n)]


def edited_at(words: list[str], places: list[int], mark: str) -> str:
    return " ".join(f"{mark}x{k}" if k in places else w for k, w in enumerate(words))


def test_a_family_gives_no_pairs_of_its_own(spark):
    """Sets just below the similarity: rows for the tasks grow with the texts, links are a forest, whatever the blocks."""
    from pyspark.sql import functions as F

    from psephos.llm import simhash

    rng = np.random.default_rng(9)
    for n in (100, 200):
        # 80 members that all have, 20 of 40 others and some that no other has: similarities on both sides of 0.8, few above it.
        sets = [np.concatenate([np.arange(80), 1000 + rng.choice(40, 20, replace=False)]).astype(np.uint64) for _ in range(n)]
        sizes = [105 + int(x) for x in rng.integers(0, 8, n)]
        rows = [(k, 7, k, sizes[k], len(sets[k]), sets[k].tobytes()) for k in range(n)]
        df = spark.createDataFrame(rows, "node long, family long, component long, size long, shared long, members binary")
        plain = [set(x.tolist()) for x in sets]
        both = {(i, j): len(plain[i] & plain[j]) for i in range(n) for j in range(i)}
        near = [(i, j) for (i, j), k in both.items() if k >= 0.8 * (sizes[i] + sizes[j] - k)]
        whole = simhash.Forest(n)
        for i, j in near:
            whole.tie(i, j)
        up = [whole.root(k) for k in range(n)]
        assert 1 < len(set(up)) < n
        for block in (1000, 30):
            simhash.BLOCK, held = block, simhash.BLOCK
            try:
                links = simhash.family_links(df, 0.8).collect()
            finally:
                simhash.BLOCK = held
            forest = simhash.Forest(n)
            for r in links:
                forest.tie(r["a"], r["b"])
            assert [forest.root(k) for k in range(n)] == up
            blocks = -(-n // block)
            assert len(links) < 2 * n * max(blocks, 1)


def test_template_family_against_all_pairs(spark):
    from psephos.llm.simhash import near_texts

    texts = template_family(150, np.random.default_rng(10))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["component"] for r in near_texts(df).collect()}
    near = [(i, j) for i in range(150) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert near and sum(rows[i] != rows[j] for i, j in near) <= 0.03 * len(near)
