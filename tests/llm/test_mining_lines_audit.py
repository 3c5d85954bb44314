"""Hard negatives, line dedup and the filter audit on tables with awkward rows, against SQL and plain versions."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from psephos.llm import exact, hard_negatives, lines
from psephos.llm.common import stored
from psephos.llm.filter_audit import OP13_SQL, filter_audit
from psephos.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from psephos.llm.lines import OP12_SQL

COMMON = "this very line stands in many documents"
DOCS = [
    (1, f"{COMMON}\nfirst of its own kind, long enough", "en"),
    (2, f"  {COMMON.upper()}\t\r\nsecond\n\n{COMMON}", "en"),
    (3, f"\n{COMMON}\n", None),
    (3, f"other text with the same id\n{COMMON}", ""),
    (3, f"other text with the same id\n{COMMON}", ""),
    (4, COMMON, "de"),
    (5, None, None),
    (6, "", "de"),
    (7, "\n\n\n", "de"),
    (None, f"{COMMON}\nno id at all", "en"),
    (None, None, "en"),
    (8, "ÉTÉ ÉTÉ ÉTÉ ÉTÉ ÉTÉ ÉTÉ\nİstanbul ŞEHİR ILICA İZMİR\n🙂" + "🙂" * 25, "fr"),
    (9, "été été été été été été\nİstanbul ŞEHİR ILICA İZMİR\n🙂" + "🙂" * 25, "fr"),
    (10, "\x0bİSTANBUL şehir\nİstanbul ŞEHİR ILICA İZMİR\x0c\n🙂" + "🙂" * 25, "fr"),
    (11, "same\nsame\nsame\nshort line of 20 cha\nshort line of 19 ch", "en"),
    (12, "short line of 20 cha\nshort line of 19 ch\nshort line of 20 cha", "en"),
    (13, "SHORT LINE OF 20 CHA \nshort line of 19 ch", "en"),
    (14, "\n".join(f"line {k % 700} of a very long document" for k in range(20_000)), "en"),
    (15, "\n".join(f"line {k % 900} of a very long document" for k in range(20_000)), "en"),
    (16, "\n".join(f"Line {k % 800} of a very long document " for k in range(20_000)), "en"),
    (17, " ".join(f"w{k}" for k in range(250)), "en"),
    (18, " ".join(f"w{k}" for k in range(250)), "de"),
    (18, " ".join(f"w{k}" for k in range(250)), "de"),
    (19, " ".join(f"w{k % 90}" for k in range(250)) + " 5 % & $", "de"),
    (20, " ".join(f"Word{k}" for k in range(300)), "x"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (3, None, 1), (17, 1, None), (18, 1, 1), (20, 0, 0), (None, 1, 1), (99, 1, 1)]


def tables(spark, rows=DOCS):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, rest string, key int")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string())}))
    con.register("labels", pa.table({c: pa.array([r[k] for r in LABELS], pa.int64()) for k, c in enumerate(("doc_id", "quality", "toxic"))}))
    return docs.repartition(5), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), con


def same(got: pd.DataFrame, want: pd.DataFrame):
    order = list(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(got[order].sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("heavy", [1, 8, 1000])
def test_lines_by_sql(spark, monkeypatch, heavy):
    monkeypatch.setattr(lines, "HEAVY", heavy)
    docs, _, con = tables(spark)
    got = lines.without_repeated_lines(docs, carry=["rest", "key"])
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text", "rest"]
    digest = lines.F.sha2(lines.F.coalesce("text", lines.F.lit("")).cast("binary"), 256).alias("kept_sha256")
    same(got.select("doc_id", "n_lines", "n_dropped", digest).toPandas(), con.execute(OP12_SQL).df())


def test_lines_by_hand(spark):
    docs, _, _ = tables(spark)
    got = {}
    for r in lines.without_repeated_lines(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_lines"], r["n_dropped"], r["text"]))
    assert got[1] == [(2, 1, "first of its own kind, long enough")]
    assert got[2] == [(4, 2, "second\n")]
    assert sorted(got[3]) == [(2, 1, "other text with the same id"), (2, 1, "other text with the same id"), (3, 1, "\n")]
    assert got[4] == [(1, 0, COMMON)] and got[5] == [(1, 0, None)] and got[6] == [(1, 0, "")]
    assert sorted(got[None], key=str) == [(1, 0, None), (2, 0, f"{COMMON}\nno id at all")]
    assert got[8] == [(3, 2, "ÉTÉ ÉTÉ ÉTÉ ÉTÉ ÉTÉ ÉTÉ")] and got[9][0][2] == "été été été été été été" and got[10][0][1] == 0
    assert got[11] == [(5, 1, "same\nsame\nsame\nshort line of 19 ch")] and got[12] == [(3, 2, "short line of 19 ch")]
    assert got[14][0][1] == 20_000 and got[14][0][2] == ""
    # What is kept once is kept whole: each key stays in its largest document.
    assert got[16][0][1] == 0 and got[15][0][1] == sum(k % 900 < 700 for k in range(20_000))


def test_lines_of_two_documents_stay(spark):
    docs = spark.createDataFrame([(1, COMMON), (1, COMMON), (2, COMMON)], "doc_id long, text string")
    assert {r["n_dropped"] for r in lines.without_repeated_lines(docs).collect()} == {0}
    assert {(r["doc_id"], r["n_dropped"]) for r in lines.without_repeated_lines(docs, least_docs=2).collect()} == {(1, 1), (2, 0)}


def test_audit_by_sql_and_by_running_the_filters(spark):
    docs, labelled, con = tables(spark)
    got = filter_audit(docs, labelled).toPandas()
    same(got, con.execute(OP13_SQL).df())
    word = re.compile(r"[^\x20\x09-\x0D]+")
    least: dict = {}
    for i, t, _ in DOCS:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails, part = [], []
    for i, t, lang in DOCS:
        t = t or ""
        w = word.findall(t)
        upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t)
        one = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * upper > 3 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and least[t] < i}
        fails.append({f for f, x in one.items() if x})
        part.append(lang or "")
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, q in LABELS if q == 1 and i is not None}
    rows, whole = {}, Counter()
    for p in set(part):
        for order in permutations("ABCDE"):
            left = [k for k in range(len(DOCS)) if part[k] == p]
            gone: list[int] = []
            for step, f in enumerate(order, 1):
                out = [k for k in left if f in fails[k]]
                redundant = sum(f in fails[k] for k in gone)
                left = [k for k in left if f not in fails[k]]
                gone += out
                alone = sum(part[k] == p and fails[k] == {f} for k in range(len(DOCS)))
                rows[p, "".join(order), step] = (len(left), len(out), redundant, alone, sum(DOCS[k][0] in good for k in out), sum(DOCS[k][0] in toxic for k in out))
                whole[p, f] += len(out)
    assert len(rows) == len(got) == 600 * len(set(part))
    for r in got.itertuples():
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == rows[r.part, r.filter_order, r.step]
        assert r.shapley == whole[r.part, r.filter_order[r.step - 1]]


def small_parts(monkeypatch, shard=37, block=2):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 50)


def mined(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score long").write.parquet(f"{folder}/embeddings.parquet")
    return op11_hard_negatives(spark, str(folder)).toPandas()


def awkward_vectors(scale=1.0):
    rng = np.random.default_rng(11)
    rows = [(k % 260 * 5, (scale * rng.normal(0.3, 1, size=4)).round(3).tolist(), int(rng.integers(0, 3))) for k in range(300)]
    rows += [(100, [0.5] * 4, 1), (200, None, 1), (300, [1.0, None], 1), (400, [float("nan")], 1), (500, [float("inf")], 0), (600, [1.0], None), (None, [1.0], 1), (700, [], 9), (800, [1.0], 2), (800, [1.0], 2), (14, [2.0, 1.0], -3)]
    rows += [(1000 + k, [1.0, 1.0, 0.5, 0.25], k % 2) for k in range(40)]
    return [(*r, 7) for r in rows]


@pytest.mark.parametrize("scale", [1.0, float(2**13), float(2**20)])
def test_hard_negatives_by_sql(spark, tmp_path, monkeypatch, scale):
    small_parts(monkeypatch)
    rows = awkward_vectors(scale)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    want = con.execute(OP11_SQL).df()
    assert len(want) > 200
    same(mined(spark, tmp_path, rows), want)


def test_hard_negatives_beyond_64_bits(spark, tmp_path, monkeypatch):
    small_parts(monkeypatch)
    rng = np.random.default_rng(3)
    rows = [(k, (10.0 ** rng.integers(-2, 31) * rng.normal(0.5, 1, size=3)).tolist(), k % 3, 0) for k in range(300)]
    rows += [(1000, [1e300, 1.0, 1.0], 1, 0), (1001, [1e300, 1.0, 2.0], 1, 0), (1002, [5e299, 1.0, 1.0], 2, 0)]
    held = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(c * 256) if abs(c) < 1e200 else int(c) * 256 for c in x]) for i, x, lab, _ in rows]
    want = []
    top = 2**63 - 1
    shown = lambda s: max(-top - 1, min(top, s))
    for a, la, va in held:
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in held))
        for s, i, lab in [x for x in scored if x[2] == la and x[1] != a][:5]:
            hits = [(n, j) for n, j, other in scored if other != la and 30 * -s <= 100 * -n <= 90 * -s][:10]
            want += [(a, i, r, j, shown(-s), shown(-n)) for r, (n, j) in enumerate(hits, 1)]
    got = mined(spark, tmp_path, rows)
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want) and any(w[4] == top for w in want)


@pytest.mark.parametrize("score", [0, 5, -5, 2**63 - 1, 2**63, -(2**63), -(2**63) + 1, -(2**63) - 1, 10**40, -(10**40), 10**41, -(10**41)])
def test_written_scores(score):
    others = [0, 2**62, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 10**39, -(10**39), 10**40 + 1, -(10**40) - 1]
    assert exact.read(*exact.written(score)) == score
    # Spark sorts by the pair, larger ones first.
    assert all((exact.written(score) < exact.written(o)) == (score < o) for o in others)


def test_products_of_all_sizes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) * 2.0 ** rng.integers(-3, 80, size=(60, 1))
    held = exact.Wholes(x)
    assert all(len(r) for r in held.rows)
    plain = [[math.floor(c * 256) for c in r] for r in x.tolist()]
    got = held.products(held.take(np.arange(5, 60, 7)))
    assert got.tolist() == [[sum(p * q for p, q in zip(a, plain[k])) for k in range(5, 60, 7)] for a in plain]


def test_one_label_only_and_no_anchor(spark):
    rows = stored(spark.createDataFrame([(100, 1, [1.0]), (1, 1, [2.0]), (2, 1, [2.0])], "vec_id long, label long, x array<double>"), "few")
    assert hard_negatives.hard_negatives(rows, rows.where("vec_id = 100")).count() == 0
    assert hard_negatives.hard_negatives(rows, rows.where("vec_id = 7")).count() == 0
