"""The corpus operators' queries, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from psephos.llm.bpe import op9_bpe
from psephos.llm.filter_audit import OP13_SQL, op13_filter_audit
from psephos.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from psephos.llm.huffman import op2_token_files
from psephos.llm.language_id import op1_language_id
from psephos.llm.lines import OP12_SQL, op12_line_dedup
from psephos.llm.packing import op8_pack
from psephos.llm.quality_model import op4_quality
from psephos.llm.quality_rules import op3_quality_rules
from psephos.llm.simhash import op5_simhash
from psephos.llm.substrings import OP6_SQL, op6_substrings
from psephos.llm.topk import OP10_SQL, op10_top_k
from psephos.llm.toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_files": op2_token_files,
        "op3_quality_rules": op3_quality_rules,
        "op4_quality": op4_quality,
        "op5_simhash": op5_simhash,
        "op6_substrings": op6_substrings,
        "op7_toxicity": op7_toxicity,
        "op8_pack": op8_pack,
        "op9_bpe": op9_bpe,
        "op10_top_k": op10_top_k,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_line_dedup": op12_line_dedup,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """The others learn, tokenize or hash by rules that SQL has not; they are tested against brute force."""
    return {"op6_substrings": OP6_SQL, "op10_top_k": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
