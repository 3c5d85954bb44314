"""Names, slugs and table cells, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from psephos.schemas import ABSENT_TOKENS

_SPACE = r"[\s\u00A0\u2000-\u200B\u202F\u3000]"


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """NFKD without combining marks, which Spark has no expression for."""
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def slug_of_ascii(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(name: Column) -> Column:
    """Lower case letters and digits joined by single hyphens; accents go first. Names without any give ''."""
    return slug_of_ascii(folded(name))


def clean_label(text: Column) -> Column:
    """Inner runs of white space (U+00A0 too) become one space; outer white space and trailing asterisks go."""
    squeezed = F.regexp_replace(text, f"{_SPACE}+", " ")
    return F.trim(F.regexp_replace(squeezed, r"[ *]+$", ""))


def whole_number(text: Column) -> Column:
    """1,234 as a long, null if it is not one."""
    bare = F.regexp_replace(clean_label(text), ",", "")
    return F.when(bare.rlike(r"^\d+$"), bare.try_cast("long"))


def electoral_cell(text: Column) -> Column:
    """'-' is 0, '(9)' is a contested 9, else an integer; null marks a cell that is none of them (electoral_cell_is_bad)."""
    bare = clean_label(text)
    return F.when(bare == "-", F.lit(0)).when(bare.rlike(r"^([+-]?\d+|\(\d+\))$"), F.regexp_replace(bare, r"[()]", "").try_cast("int"))


def electoral_cell_is_bad(text: Column) -> Column:
    """A cell, not null, that electoral_cell cannot read: '(9', '176 (175)', words."""
    return text.isNotNull() & electoral_cell(text).isNull()


def popular_cell(text: Column) -> Column:
    """Votes of a cell; a mark of absence is null, never 0."""
    return F.when(~clean_label(text).isin(*ABSENT_TOKENS), whole_number(text))


def popular_cell_is_bad(text: Column) -> Column:
    return ~clean_label(text).isin(*ABSENT_TOKENS) & whole_number(text).isNull()


def percent_cell(text: Column) -> Column:
    return F.regexp_replace(clean_label(text), "[%,]", "").try_cast("double")


def reliability(votes: Column, total: Column, percent: Column, tolerance: float = 0.5) -> Column:
    """unreliable if the published percent is off the computed one by more than the tolerance; unknown parts say nothing."""
    off = F.abs(F.try_divide(votes, total) * 100 - percent) > tolerance
    return F.when(F.coalesce(off, F.lit(False)), "unreliable").otherwise("exact")


def name_parts(name: Column) -> dict[str, Column]:
    """first, middle, last, suffix: the first word; of the others, if there are several, the next one; all that follow; Jr.

    Only Jr. is a suffix. The rule is generic: names it splits wrongly are corrected by an overlay.
    """
    rest = F.regexp_replace(F.regexp_replace(name, "^[^ ]* ?", ""), ",? Jr\\.?$", "")
    words = F.filter(F.split(F.trim(rest), r"\s+"), lambda w: w != "")
    n = F.size(words)
    return {
        "first": F.substring_index(name, " ", 1),
        "middle": F.when(n > 1, F.get(words, F.lit(0))),
        "last": F.when(n == 1, F.get(words, F.lit(0))).when(n > 1, F.array_join(F.slice(words, 2, F.greatest(n - 1, F.lit(1))), " ")),
        "suffix": F.when(name.endswith("Jr."), F.lit("Jr.")),
    }


def content_line(columns: list[str]) -> Column:
    """A row as text for hashing: fields joined by 0x1F, null as the empty field."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
