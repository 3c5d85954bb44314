"""A saved corpus of pages, read by its manifest: only files that the manifest asks for are opened, and each is held against
what the manifest says of it.

manifest: (page, file, http_status, bytes, sha256, fetched_at); file is a path under the corpus' folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.constraints import Constraint, check, references, unique
from psephos.shared import stored

READABLE = 200


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of all files under the folder; none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select("path", F.col("length").alias("bytes"))


def corpus_age(manifest: DataFrame) -> DataFrame:
    """One row (first_fetched, last_fetched, n_pages) of the pages that were fetched; the index has no page."""
    return manifest.where("page is not null").agg(F.min("fetched_at").alias("first_fetched"), F.max("fetched_at").alias("last_fetched"), F.count("fetched_at").alias("n_pages"))


def wanted_pages(manifest: DataFrame, pages: Sequence[str] | None = None) -> DataFrame:
    """Manifest rows of pages that the server gave, of these pages only if some are named."""
    given = manifest.where((F.col("http_status") == READABLE) & F.col("page").isNotNull())
    return given if pages is None else given.where(F.col("page").isin(list(pages)))


def read_corpus(spark: SparkSession, folder: str, manifest: DataFrame, pages: Sequence[str] | None = None) -> tuple[DataFrame, list[Constraint]]:
    """((page, html), constraints). Bytes that are no UTF-8 become U+FFFD.

    The constraints: each page named is in the manifest as given (page_not_given), once (page_twice); its file is there
    (file_missing) and has the size and the digest that the manifest states (file_changed; an unstated one is not asked
    for). Paths come to the driver, as they do for any list of files that Spark reads; sizes and digests do not.
    """
    wanted = stored(wanted_pages(manifest, pages).withColumn("name", F.regexp_replace("file", "^/+", "")), "wanted-pages")
    listed = files(spark, folder).select("path", "bytes")
    # By the file's place under the folder, as the reader writes paths in a form of its own.
    named = listed.withColumn("name", F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(_tail(folder)), F.lit("/\\E")), 2), 2))
    there = stored(wanted.join(named.select("name", "path"), "name"), "pages-there")
    paths = [r["path"] for r in there.select("path").distinct().collect()]
    opened = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    read = there.join(opened.select("path", "length", "content"), "path")
    changed = read.where((F.col("length") != F.col("bytes")) | (F.sha2("content", 256) != F.lower("sha256"))).select("page", "file")
    broken = [
        unique(wanted, ["page"], "page_twice"),
        Constraint("file_missing", wanted.join(there.select("name"), "name", "left_anti").select("page", "file")),
        Constraint("file_changed", changed),
    ]
    if pages is not None:
        asked = spark.createDataFrame([(p,) for p in pages], "page string")
        broken.append(references(asked, wanted, ["page"], "page_not_given"))
    return read.select("page", F.make_valid_utf8(F.col("content").cast("string")).alias("html")), broken


def _tail(folder: str) -> str:
    return folder.rstrip("/").rsplit("/", 1)[-1]


def checked_corpus(spark: SparkSession, folder: str, manifest: DataFrame, pages: Sequence[str] | None = None) -> DataFrame:
    """read_corpus() whose constraints hold."""
    out, broken = read_corpus(spark, folder, manifest, pages)
    check(*broken)
    return out


def one_page_a_year(parsed: DataFrame, years: DataFrame) -> list[Constraint]:
    """Each of the years has a parsed page, and one only. parsed: (page, year)."""
    return [unique(parsed.select("year", "page"), ["year"], "year_with_two_pages"), references(years, parsed, ["year"], "year_without_page")]
