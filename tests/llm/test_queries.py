"""The corpus queries on a small table with awkward rows, against plain single-machine versions of their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from psephos.llm.queries import oracle_sql, queries

SMALL, LEARN, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
TIE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def awkward(folder, rows=True):
    """The small tables with nulls, empty and long texts, repeats, and extra columns with clashing names."""
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    top = max(d["doc_id"] for d in docs)
    texts = [None, "", " \t\n ", TIE, TIE, TIE + " " + TIE, "é ß x İstanbul", " ".join(f"w{k % 977} v{k}" for k in range(15_000)), "\n".join(["same line here"] * 9), "🙂" * 40]
    docs += [{"doc_id": top + 1 + k, "text": t, "lang": None, "source": None, "n_chars": None} for k, t in enumerate(texts)]
    clash = ["rest", "hash", "piece", "start", "stat_all", "component_id", "score"]
    schema = pq.read_schema(f"{SMALL}/documents.parquet")
    table = pa.Table.from_pylist(docs if rows else [], schema=schema)
    for c in clash:
        table = table.append_column(c, pa.nulls(table.num_rows, pa.string()))
    pq.write_table(table, f"{folder}/documents.parquet")
    labels = pq.read_table(f"{SMALL}/labels.parquet")
    pq.write_table(labels if rows else labels.slice(0, 0), f"{folder}/labels.parquet")
    vectors = pq.read_table(f"{SMALL}/embeddings.parquet")
    pq.write_table(vectors if rows else vectors.slice(0, 0), f"{folder}/embeddings.parquet")
    return str(folder), docs


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    return awkward(tmp_path_factory.mktemp("awkward"))


def run(spark, name, folder):
    return queries()[name](spark, folder).toPandas()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op2_token_files(spark, small, tokenizer):
    folder, docs = small
    at, want = 0, {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = ids_of(tokenizer, d["text"]) + [1]
        want[d["doc_id"]] = (at, len(ids), crc(ids))
        at += len(ids)
    got = run(spark, "op2_token_files", folder)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(docs)


def test_op3_counts(spark, small):
    folder, docs = small
    got = {r.doc_id: r for r in run(spark, "op3_quality_rules", folder).itertuples()}
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"] or ""
        words = SPLIT.findall(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(windows)
        inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if SPLIT.search(x)]
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        r = got[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed,
        )
        assert not (failed and r.kept)


def test_op5_components(spark, small):
    folder, docs = small
    prints = {}
    for d in docs:
        words = [w.encode() for w in SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))]
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        ones = sum((np.array([xxhash.xxh64_intdigest(s, 42) >> k & 1 for k in range(64)]) for s in shingles), np.zeros(64, dtype=int))
        prints[d["doc_id"]] = sum(1 << k for k in range(64) if shingles and 2 * ones[k] > len(shingles))
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = run(spark, "op5_simhash", folder)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {i: (f"{prints[i]:016x}", root(i)) for i in ids}


@pytest.mark.parametrize("name", ["op6_substrings", "op10_top_k"])
def test_against_sql(spark, small, name):
    folder, _ = small
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    got = run(spark, name, folder)[list(want.columns)]
    order = list(want.columns)
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)


def test_op8_packing(spark, small, tokenizer):
    folder, docs = small
    got = run(spark, "op8_pack", folder)
    ids = {d["doc_id"]: ids_of(tokenizer, d["text"]) + [1] for d in docs}
    for r in got.itertuples():
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.start == r.piece * 4096
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= 1.05 * sum(map(len, ids.values())) / 4096 + 1


def test_op9_bpe(spark, small, tokenizer):
    folder, docs = small
    want = {}
    for d in docs:
        ids = ids_of(tokenizer, d["text"])
        want[d["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = run(spark, "op9_bpe", folder)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()} == want


def auc(score, label):
    ranks = pd.Series(score).rank()
    ones = label == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_op1_held_out(spark):
    got = run(spark, "op1_language_id", LEARN).merge(pq.read_table(f"{LEARN}/documents.parquet").to_pandas()[["doc_id", "lang", "text"]], on="doc_id")
    known = got[got.held_out & got.lang.notna() & got.text.fillna("").str.contains("[^\\W\\d_]")]
    assert (known.lang_pred == known.lang).mean() > 0.9
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all() and got.score.between(0, 1).all()


@pytest.mark.parametrize("name, column", [("op4_quality", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_scores(spark, name, column):
    got = run(spark, name, LARGER)
    assert got.score.between(0, 1).all() and (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (got.predicted == (got.score >= (0.3 if column == "quality" else 0.5))).all()
    known = got.merge(pq.read_table(f"{LARGER}/labels.parquet").to_pandas(), on="doc_id")
    known = known[known.held_out & known[column].notna()]
    assert auc(known.score, known[column]) > 0.93


@pytest.mark.parametrize("name", ["op1_language_id", "op4_quality", "op7_toxicity"])
def test_awkward_rows_are_scored(spark, small, name):
    got = run(spark, name, small[0])
    assert len(got) == len(small[1]) and got.score.between(0, 1).all()


@pytest.mark.parametrize("name", list(queries()))
def test_empty_tables(spark, tmp_path, name):
    assert len(run(spark, name, awkward(tmp_path, rows=False)[0])) == 0


def test_pipeline_stages(spark, small):
    folder, docs = small
    df = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [df]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == df.columns
            path = f"{folder}/stage-{k}.parquet"
            out.write.parquet(path)
            out = spark.read.parquet(path)
        kept.append(out)
    ids = [{r[0] for r in x.select("doc_id").distinct().collect()} for x in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[3] == ids[4] == ids[5]
