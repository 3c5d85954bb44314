"""The pipeline's rules are those of op3, whatever the stages before let through."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from psephos.llm import quality_rules as q
from psephos.llm.queries import queries

LEARN = "/root/testdata/sf0.01"


def test_rules_without_rejected_rows_in_the_input(spark):
    docs = spark.read.parquet(f"{LEARN}/documents.parquet")
    bad = spark.read.parquet(f"{LEARN}/labels.parquet").where("quality = 0").select("doc_id")
    passed = docs.join(bad, "doc_id", "left_anti")
    of_op3 = queries()["op3_quality_rules"](spark, LEARN).where("kept").select("doc_id").join(passed, "doc_id", "left_semi")
    kept = corpus_pipeline.apply_rules(spark, passed, LEARN).select("doc_id")
    base = queries()["op3_quality_rules"](spark, LEARN).where(~F.col("base_failed")).select("doc_id").join(passed, "doc_id", "left_semi")
    a, b, c = ({r[0] for r in x.collect()} for x in (kept, of_op3, base))
    print("input", passed.count(), "base test alone", len(c), "rules of op3", len(b), "stage", len(a))
    assert a == b and a < c


def test_a_long_list_reads_each_text_once(spark, tmp_path):
    """The counts stand once in the plan, however many conditions look at them, and the list decides as it does on columns."""
    docs = spark.read.parquet(f"{LEARN}/documents.parquet")
    names = list(q.SHAPES)
    never = [tuple(q.Condition(names[(i + j) % len(names)], True, 1e6 + i) for j in range(5)) for i in range(20)]
    rules = [*never, (q.Condition("mark_rate", True, 0.02), q.Condition("mean_word", False, 6.0)), (q.Condition("digit_rate", True, 0.05),)]
    short, long = (q.rules_filter(docs, x) for x in (rules[-1:], rules))
    one, other = (x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") for x in (short, long))
    q.statistics(docs, "stat_").drop("text").write.parquet(f"{tmp_path}/statistics")
    stats = spark.read.parquet(f"{tmp_path}/statistics")
    wanted = stats.where(~q.base_failed("stat_") & q.verdict(rules, "stat_")).select("doc_id")
    a, b = (sorted(r[0] for r in x.collect()) for x in (long.select("doc_id"), wanted))
    rejected = stats.where(~q.base_failed("stat_") & ~q.verdict(rules, "stat_")).count()
    print("in the plan", one, other, "kept", len(a), "rejected by the list", rejected)
    assert one == other and a == b and rejected and long.columns == docs.columns
