"""op6: edges are dealt once, texts are packed for their shuffle, and rows that share an id may have a null text."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest

from psephos.llm import substrings as S

PASSAGE = " ".join(f"word{k}" for k in range(30))


def test_edges_are_dealt_once(spark):
    rows = S.Rows(((spark.createDataFrame([(1, PASSAGE), (2, f"x {PASSAGE} y")], "doc_id long, text string"), ()),))
    marked = S.bit_filter(S.repeated_anchors(rows), S.FILTER_BITS)
    found = S.spans(S.edges(rows, marked))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("hashpartitioning(edge") == 1
    assert [(r["doc_id"], r["size"], r["source"]) for r in found.collect()] == [(2, 18, 1)]


def test_anchors_are_counted_without_their_documents(spark):
    rows = S.Rows(((spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (3, " ".join(f"other{k}" for k in range(30)))], "doc_id long, text string"), ()),))
    found = S.repeated_anchors(rows)
    assert "doc_id" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    words = [w.encode() for w in PASSAGE.split()]
    want = {int(a) & ((1 << S.ANCHOR_BITS) - 1) for a in S.anchors_of(S.WORDS.of(words))}
    assert {r["anchor"] for r in found.collect()} == want


def test_texts_come_back_from_packing():
    texts = [b"", None, b"a", "ü\0\n".encode() * 1000]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])
    packed = S.pack_texts(batch, 1)
    assert S.unpacked_texts(packed.column(1)) == texts and packed.column(0) == batch.column(0)


@pytest.mark.parametrize("texts", [False, True])
def test_null_text_beside_a_row_that_loses_words(spark, texts):
    """Rows share an id; one has a null text, one is short, one repeats a passage, one is a copy, one is a short copy."""
    rows = [(1, PASSAGE), (1, "a b"), (2, None), (2, "short"), (2, f"x {PASSAGE} y"), (2, PASSAGE), (2, "a b"), (None, PASSAGE)]
    got = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=texts).collect()

    def shown(text):
        return text if texts else hashlib.sha256((text or "").encode()).hexdigest()

    want = [(1, 30, 0, PASSAGE), (1, 2, 0, "a b"), (2, 0, 0, None), (2, 1, 0, "short"), (2, 32, 30, "x y"), (2, 30, 30, ""), (2, 2, 0, "a b"), (None, 30, 0, PASSAGE)]
    assert sorted(map(str, ((r[0], r[1], r[2], r[3]) for r in got))) == sorted(str((d, n, gone, shown(t))) for d, n, gone, t in want)
