"""A corpus pipeline: stages that each call one corpus operator, written and read again between stages.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import quality_model, quality_rules
from psephos.llm.common import documents, stored
from psephos.llm.packing import pack_documents
from psephos.llm.simhash import one_of_each
from psephos.llm.substrings import without_repeats
from psephos.llm.tokens import word_bpe


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under its threshold go. Null and empty texts get the network's answer to
    no words; rows with a null or repeated id each get theirs; without labels all stay."""
    return quality_model.quality_filter(docs, quality_model.trained(spark, docs, sf_dir))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a rule rejects go. The rules are learned as in op3, from labelled rows of the
    whole documents table: what the stages before let through has too few of label 0. A null or empty text fails the
    base test; rows with a null or repeated id each get their verdict."""
    known = quality_rules.labelled_rows(spark, sf_dir)
    # About 2 * quality_rules.SAMPLE ids of 8 bytes at most: that bound makes the broadcast safe.
    asked = documents(spark, sf_dir).select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    stats = stored(quality_rules.statistics(asked, "stat_").drop("text"), "statistics")
    return quality_rules.rules_filter(docs, quality_rules.trained_rules(stats, known))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays (each row with that id), or one row if none
    has an id. Null and empty texts are one group, as they have the same words."""
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller document has go from the text; n_chars follows. No document goes; a null text and the
    rows with a null id stay as they are."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = without_repeats(docs, carry=rest)
    return cut.select(*[F.col("rest")[c].alias(c) for c in rest], "text", F.length("text").cast("long").alias("n_chars")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, tokenized and packed into sequences. A null text counts as empty; each row is packed, whatever its id."""
    return pack_documents(docs, word_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: The first two stages learn and the last tokenizes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
