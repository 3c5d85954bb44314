"""Saved HTML result pages: table cells become rows, and everything after that is DataFrame work.

Only reading the markup needs Python (pages leave tags open, which Spark's XPath rejects); what comes out is one row for
each row of a table, with its cells. Finding the results table, the layout of its header, the kind of each row and the
votes are expressions and joins over those rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.constraints import Constraint, check
from psephos.functions.text import clean_label, percent_cell, popular_cell, popular_cell_is_bad, whole_number
from psephos.shared import stored

ROWS = "page string, table_no int, row_no int, cells array<struct<text:string, header:boolean, span:int, spanned:boolean>>"
# Labels that mark header, totals and summary rows.
STATE_HEADERS = ["STATE", "STATES"]
TOTALS = ["TOTALS", "TOTAL"]
OTHERS = ["OTHERS", "OTHER", "VARIOUS", "OTHERS (VARIOUS)"]


class _Tables(HTMLParser):
    """Cells of every table; text in <sup> is a footnote mark and goes, a line break is a space."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[dict]]] = []
        self.open: list[dict] = []
        self.tables, self.notes = 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append({"no": self.tables, "rows": 0, "cells": None, "cell": None})
            self.tables += 1
        elif tag == "sup":
            self.notes += 1
        elif self.open and tag == "tr":
            self._end_row()
            self.open[-1]["cells"] = []
        elif self.open and tag in ("td", "th"):
            table = self.open[-1]
            if table["cells"] is None:
                table["cells"] = []
            span = (dict(attrs).get("colspan") or "").strip()
            table["cell"] = {"text": "", "header": tag == "th", "span": int(span) if span.isdigit() else 1, "spanned": span.isdigit()}
            table["cells"].append(table["cell"])
        elif tag == "br":
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "sup":
            self.notes = max(0, self.notes - 1)
        elif self.open and tag in ("td", "th"):
            self.open[-1]["cell"] = None
        elif self.open and tag == "tr":
            self._end_row()
        elif self.open and tag == "table":
            self._end_row()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] is not None and not self.notes:
            self.open[-1]["cell"]["text"] += data

    def _end_row(self) -> None:
        table = self.open[-1]
        if table["cells"]:
            self.rows.append((table["no"], table["rows"], table["cells"]))
            table["rows"] += 1
        table["cells"] = table["cell"] = None


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(page, html) of the saved files; page is the file's name without its end."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("page"), F.decode("content", "UTF-8").alias("html"))


def page_rows(pages: DataFrame) -> DataFrame:
    """ROWS of pages (page, html); a null page has none."""

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, html in zip(frame["page"], frame["html"]):
                parser = _Tables()
                parser.feed(html or "")
                parser.close()
                while parser.open:
                    parser.handle_endtag("table")
                out += [(page, *row) for row in parser.rows]
            yield pd.DataFrame(out, columns=["page", "table_no", "row_no", "cells"])

    return pages.select("page", "html").mapInPandas(work, ROWS)


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumn("texts", F.transform("cells", lambda c: clean_label(c["text"]))).withColumn("width", F.size("cells"))


def result_rows(rows: DataFrame) -> DataFrame:
    """Rows of each page's one results table, with texts, width, groups (candidates across) and state_row (its STATE header).

    The width of a data row is the commonest among 2 + 3 * groups of rows without spans (the wider one if two are as common).
    """
    plain = _texts(rows)
    head = F.exists("texts", lambda t: F.upper(t).isin(*STATE_HEADERS))
    tables = plain.where(head).groupBy("page", "table_no").agg(F.min("row_no").alias("state_row"))
    check(Constraint("one_results_table", tables.groupBy("page").agg(F.count(F.lit(1)).alias("n")).where("n > 1")))
    mine = plain.join(tables, ["page", "table_no"])
    even = F.forall("cells", lambda c: c["span"] == 1)
    widths = mine.where(even & (F.col("width") >= 5) & ((F.col("width") - 2) % 3 == 0)).groupBy("page", "width").agg(F.count(F.lit(1)).alias("n"))
    usual = widths.groupBy("page").agg(F.max(F.struct("n", "width"))["width"].alias("data_width"))
    return mine.join(usual, "page").withColumn("groups", ((F.col("data_width") - 2) / 3).cast("int"))


def body_rows(results: DataFrame, prose: str = "") -> DataFrame:
    """result rows under the header with their kind: status, totals, district, state, prose or unknown.

    Prose is told by shape - a single cell over the whole width, or no text at all - or by the pattern prose, if one is
    given. A trailing block that repeats the header's party and nominee labels ends the body.
    """
    upper = F.transform("texts", lambda t: F.upper(t))
    ends = results.where(F.col("row_no") > F.col("state_row")).where(F.array_contains(upper, "PARTY") & F.array_contains(upper, "NOMINEES")).groupBy("page").agg(F.min("row_no").alias("end_row"))
    label, second = F.get("texts", F.lit(0)), F.get("texts", F.lit(1))
    numeric = (F.col("width") == F.col("data_width")) & whole_number(F.get("cells", F.lit(1))["text"]).isNotNull()
    wide = (F.col("width") == 2) & (F.get("cells", F.lit(1))["span"] >= F.col("data_width") - 1)
    single = (F.col("width") == 1) & (F.get("cells", F.lit(0))["span"] >= F.col("data_width"))
    empty = F.size(F.filter("texts", lambda t: t != "")) == 0
    worded = F.exists("texts", lambda t: t.rlike(prose)) if prose else F.lit(False)
    kind = (
        F.when(wide & F.lower(second).contains("legislature"), "status")
        .when(F.upper(label).isin(*TOTALS), "totals")
        .when(numeric & F.upper(label).rlike(r"^CD-\d+$"), "district")
        .when(numeric, "state")
        .when(single | empty | worded, "prose")
        .otherwise("unknown")
    )
    body = results.join(ends, "page", "left").where((F.col("row_no") > F.col("state_row")) & (F.col("end_row").isNull() | (F.col("row_no") < F.col("end_row"))))
    typed = body.withColumn("kind", kind)
    first = typed.where(F.col("kind").isin("state", "status")).groupBy("page").agg(F.min("row_no").alias("first_row"))
    return typed.join(first, "page").where(F.col("row_no") >= F.col("first_row"))


def candidate_names(results: DataFrame) -> DataFrame:
    """(page, col_ind, name, party, is_other). Header rows over the first numbers with as many wordy cells as there are groups
    count: the first one gives names and the next one parties, but what the STATE row itself holds are parties. A cell of
    two lines holds both. With one such row and one line there is no party.
    """
    wordy = F.filter("cells", lambda c: (clean_label(c["text"]) != "") & ~F.upper(clean_label(c["text"])).isin(*STATE_HEADERS, "TOTAL VOTE", "TOTAL VOTES", "VOTES", "%", "EV", "TOTAL"))
    numeric = whole_number(F.get("cells", F.lit(1))["text"]).isNotNull()
    first = results.where(numeric & (F.col("width") == F.col("data_width"))).groupBy("page").agg(F.min("row_no").alias("first_row"))
    head = results.join(first, "page").where(F.col("row_no") < F.col("first_row")).withColumn("wordy", wordy)
    full = head.where((F.size("wordy") == F.col("groups")) & ~F.exists("wordy", lambda c: c["text"].rlike("(?i)legislature")))
    order = Window.partitionBy("page").orderBy(F.col("row_no") == F.col("state_row"), "row_no")
    lines = full.withColumn("line", F.row_number().over(order)).select("page", "line", F.posexplode("wordy").alias("at", "cell"))
    parts = F.filter(F.split(F.col("cell")["text"], "\n"), lambda x: clean_label(x) != "")
    cells = lines.select("page", "line", (F.col("at") + 1).alias("col_ind"), clean_label(F.get(parts, F.lit(0))).alias("text"), F.nullif(clean_label(F.get(parts, F.lit(1))), F.lit("")).alias("under"))
    picked = cells.groupBy("page", "col_ind").agg(F.min_by(F.struct("text", "under"), "line").alias("a"), F.max_by("text", "line").alias("b"), F.count(F.lit(1)).alias("n"))
    party = F.when(F.col("a")["under"].isNotNull(), F.col("a")["under"]).when(F.col("n") > 1, F.col("b"))
    return picked.select("page", "col_ind", F.col("a")["text"].alias("name"), party.alias("party"), F.upper(F.col("a")["text"]).isin(*OTHERS).alias("is_other"))


def popular_cells(body: DataFrame) -> DataFrame:
    """(page, row_no, kind, label, total_votes, col_ind, votes, percent) of state, district and totals rows, a row for each group."""
    rows = body.where(F.col("kind").isin("state", "district", "totals") & (F.col("width") == F.col("data_width")))
    cell = lambda k: F.get("cells", k)["text"]
    groups = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.struct((g + 1).alias("col_ind"), cell(g * 3 + 2).alias("votes"), cell(g * 3 + 3).alias("percent")))
    out = rows.select("page", "row_no", "kind", F.get("texts", F.lit(0)).alias("label"), whole_number(cell(F.lit(1))).alias("total_votes"), F.explode(groups).alias("g"))
    return out.select(
        "page", "row_no", "kind", "label", "total_votes", "g.col_ind",
        popular_cell(F.col("g.votes")).alias("votes"), percent_cell(F.col("g.percent")).alias("percent"), popular_cell_is_bad(F.col("g.votes")).alias("bad"),
    )


def page_constraints(body: DataFrame, cells: DataFrame) -> list[Constraint]:
    """What must hold of a page: every row is understood, every cell reads, no 0 votes, state rows add up to the totals row,
    and no more than a quarter of the printed percents are off by over half a point."""
    states = cells.where("kind = 'state'")
    sums = states.groupBy("page", "col_ind").agg(F.sum("votes").alias("summed"))
    stated = cells.where("kind = 'totals'").select("page", "col_ind", F.col("votes").alias("stated"))
    off = F.abs(F.try_divide("votes", "total_votes") * 100 - F.col("percent")) > 0.5
    rates = states.where("votes is not null and percent is not null").groupBy("page").agg(F.avg(off.cast("double")).alias("rate"))
    return [
        Constraint("row_not_understood", body.where("kind = 'unknown'").select("page", "row_no", "texts")),
        Constraint("cell_unreadable", cells.where("bad")),
        Constraint("votes_zero", states.where("votes = 0")),
        Constraint("totals_row_differs", sums.join(stated, ["page", "col_ind"]).where("not (summed <=> stated)")),
        Constraint("percents_off", rates.where("rate > 0.25")),
    ]


def pages_without_results(pages: DataFrame, results: DataFrame, exempt: Sequence[str] = ()) -> Constraint:
    """Every page but the exempt ones has a results table with a data row of full width."""
    return Constraint("page_without_results", pages.select("page").where(~F.col("page").isin(*exempt) if exempt else F.lit(True)).join(results.select("page"), "page", "left_anti"))


def popular_votes_of_pages(pages: DataFrame, exempt: Sequence[str] = (), prose: str = "") -> tuple[DataFrame, DataFrame]:
    """(votes, status) of pages that keep their constraints: votes (page, label, name, party, total_votes, votes, percent) of
    state rows, without the column of other candidates and without absent cells; status (page, label, pv_status, note)."""
    results = result_rows(stored(page_rows(pages), "page-rows"))
    body = body_rows(results, prose)
    cells = popular_cells(body)
    check(pages_without_results(pages, results, exempt), *page_constraints(body, cells))
    votes = cells.where("kind = 'state' and votes is not null").join(candidate_names(results).where("not is_other"), ["page", "col_ind"])
    status = body.where("kind = 'status'").select("page", F.get("texts", F.lit(0)).alias("label"), F.lit("legislature_chosen").alias("pv_status"), F.get("texts", F.lit(1)).alias("note"))
    return votes.select("page", "label", "name", "party", "total_votes", "votes", "percent"), status


def page_links(pages: DataFrame, years: list[int]) -> DataFrame:
    """(year, url) of links whose last segment is one of the years, each once."""
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"'#?]+)"""), 1)).alias("url"))
    return links.withColumn("year", F.regexp_extract("url", r"/(\d{4})/?$", 1).try_cast("int")).where(F.col("year").isin(*years)).select("year", "url").distinct()


def complete_corpus(manifest: DataFrame, pages: DataFrame) -> Constraint:
    """Every page that the manifest (page, http_status) has with status 200 is there."""
    return Constraint("page_missing", manifest.where("http_status = 200").select("page").join(pages.select("page"), "page", "left_anti"))
