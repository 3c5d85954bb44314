"""Line dedup: lines whose key many documents hold go from all of these but one.

Lines are exploded with their places and their keys hashed to 128 bits; documents are counted a hash, by id, which deals a
frequent line over all tasks before its counts meet. The few keys that hold a thousandth of all frequent lines or more
(so at most a thousand) are looked up without a shuffle, the others by a join in which none is large. What comes back to a
text is only the places of its lost lines, and the stretches between them are put together again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import documents, stored

#: The six ASCII white-space characters.
SPACE = " \t\n\x0b\x0c\r"
#: A key with more than this share of the frequent lines is looked up without a shuffle: at most so many keys can have it.
HEAVY = 1000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case and no other character changed."""
    bare = F.btrim(line, F.lit(SPACE))
    # The built-in lower() maps other letters too, but is faster where there are none.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def hashes(text: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits in two columns."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit("second"), text).alias(names[1])]


def line_keys(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """(doc_id, t1, t2, place, k1, k2): hashes of the text and of the key of each line with so many code points in its key.

    Rows without an id or a text have none.
    """
    text = F.col("text").cast("string")
    each = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", *hashes(text, ("t1", "t2")), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    keyed = each.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_chars)
    return keyed.select("doc_id", "t1", "t2", "place", *hashes(F.col("key"), ("k1", "k2")))


def frequent_keys(lines: DataFrame, least_docs: int = 3) -> DataFrame:
    """(k1, k2, docs, last): keys that so many documents hold, how many do, and the largest of their ids."""
    counted = lines.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
    return counted.where(F.col("docs") >= least_docs)


def lost_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, place) of the lines that go. frequent is a table read back: it is read twice."""
    key = ["k1", "k2"]
    total = frequent.agg(F.sum("docs")).head()[0] or 0
    heavy = frequent.select(*key, F.col("last").alias("heavy_last"), F.lit(True).alias("heavy")).where(F.col("docs") * HEAVY > total)
    # At most HEAVY rows can have more than that share of the total: that bound makes the broadcast safe.
    told = lines.join(F.broadcast(heavy), key, "left")
    at_once = told.where(F.col("heavy") & (F.col("doc_id") != F.col("heavy_last")))
    others = told.where(F.col("heavy").isNull()).select(*lines.columns)
    joined = others.join(frequent.where(F.col("docs") * HEAVY <= total), key).where(F.col("doc_id") != F.col("last"))
    here = ["doc_id", "t1", "t2", "place"]
    return at_once.select(*here).unionByName(joined.select(*here))


def _without(text: Column, places: Column) -> Column:
    """The text without the lines at these places, sorted and from 0: the stretches between them, joined again."""

    def put_together(s: Column) -> Column:
        lines, gone = s["lines"], s["gone"]
        after = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1) + 1)
        until = lambda k: F.coalesce(F.get(gone, k), F.size(lines))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, after(k) + 1, until(k) - after(k)))), "\n")

    # An array of one, so that the text is split once and not for each stretch.
    return F.transform(F.array(F.struct(F.split(text, "\n").alias("lines"), places.alias("gone"))), put_together)[0]


def without_repeated_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of each row, and the columns to carry in a struct `rest`.

    Lines end at \\n. A line's key is the line stripped of ASCII white space, A-Z in lower case. A key of at least
    `least_chars` code points that at least `least_docs` documents hold loses all its lines except in the document with
    the largest doc_id; there, all its lines stay. Documents are told apart by doc_id: rows that share one count once and
    are treated alike. Rows with a null doc_id are not counted and lose nothing. A null text has one (empty) line and stays
    null; a text that loses all lines is empty. An empty table gives no rows.
    """
    lines = stored(line_keys(docs, least_chars), "line-keys")
    lost = lost_lines(lines, stored(frequent_keys(lines, least_docs), "frequent-keys"))
    gone = lost.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("place")).alias("gone"))
    text = F.col("text").cast("string")
    rest = [F.struct(*carry).alias("rest")] if carry else []
    whole = docs.select("doc_id", text.alias("text"), *hashes(text, ("t1", "t2")), *rest)
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone")))
    joined = whole.join(gone, ["doc_id", "t1", "t2"], "left")
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"), *(["rest"] if carry else []))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: keys of 20 code points in 3 documents, over all documents."""
    cut = without_repeated_lines(documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
e as (select rid, doc_id, unnest(l) as line, unnest(range(len(l))) as place from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
f as (select key, max(doc_id) as last from k where length(key) >= 20 and doc_id is not null group by key having count(distinct doc_id) >= 3),
g as (select k.*, f.key is not null and k.doc_id is not null and k.doc_id <> f.last as gone from k left join f using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from g group by rid, doc_id
"""
