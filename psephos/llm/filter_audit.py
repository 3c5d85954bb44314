"""Filter interaction audit: what each of five filters removes in every order they could run in.

Native expressions turn a text into a mask of the filters it fails. Whether a text repeats that of a smaller id takes the
least id of each text, so rows are counted a text first and the ids meet as two numbers a text. All that an order of filters
does follows from how many documents a part has of each of the 32 masks, so the 120 orders are worked out from these cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from psephos.llm.common import documents, labels

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
#: Orders in which one of several filters comes first: all orders, shared evenly among them.
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # An array of one, so that the words are found once and not for each count.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("different")))[0]

    def bits(c: Column) -> Column:
        upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        failed = [c["all"] < 200, 100 * c["different"] < 50 * c["all"], 100 * upper.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
        return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0))

    return F.transform(F.array(counts), bits)[0]


def text_counts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(key, part, mask, good, toxic, n, nameless, first): rows of each text, part and label, how many have no id, and the
    least id with how many rows have it. mask lacks filter E."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text_mask(text).alias("mask"))
    rows = rows.groupBy("doc_id", "key", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labelled.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    named = rows.where(F.col("doc_id").isNotNull()).join(marked.where(F.col("good") | F.col("toxic")), "doc_id", "left")
    # Rows without an id have no label; beside the join they cannot all meet in one task of it.
    nameless = rows.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    both = named.unionByName(nameless).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    has_id = F.col("doc_id").isNotNull()
    return both.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("nameless"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )


def cells(counted: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask of five filters, and how many of these are good and toxic."""
    least = F.min("first.doc_id").over(Window.partitionBy("key"))
    kept = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    told = counted.withColumn("least", least).withColumn("kept", kept)
    repeats = 1 << FILTERS.index("E")
    each = told.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + repeats).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("c"))
    return each.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("toxic"),
    )


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders, from the cells."""
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("held"))  # CELLS entries at most
    filled = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.col("held")[i], F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])))
    orders = held.select("part", filled.alias("cells"), F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda k: F.element_at(F.array(*[F.lit(1 << j) for j in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.substring("filter_order", k, F.lit(1))))
    steps = steps.withColumn("bit", bit_of(F.col("step")))
    steps = steps.withColumn("earlier", F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda s, k: s + bit_of(k)) - F.col("bit"))

    def total(asked, of: str = "n", times=None) -> Column:
        """The sum over the cells for whose mask the condition holds."""
        number = lambda i: F.col("cells")[i][of] if times is None else F.col("cells")[i][of] * times(i)
        return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda s, i: s + F.when(asked(i), number(i)).otherwise(F.lit(0).cast("long")))

    bit, earlier = F.col("bit"), F.col("earlier")
    fails, first = (lambda i: i.bitwiseAND(bit) != 0), (lambda i: i.bitwiseAND(earlier) == 0)
    removed = lambda i: fails(i) & first(i)
    # Of the filters a document fails each comes first in as many orders.
    share = lambda i: (len(ORDERS) / F.bit_count(i)).cast("long")
    return steps.select(
        "part", "filter_order", "step", total(lambda i: ~fails(i) & first(i)).alias("kept"), total(removed).alias("removed"), total(lambda i: fails(i) & ~first(i)).alias("redundant"),
        total(lambda i: i == bit).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), total(fails, times=share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row for each part (lang, or the empty string), order of the five filters and step.

    docs: (doc_id, text, lang); labelled: (doc_id, quality, toxic). A null text counts as empty. Rows with a null doc_id
    have no label and are never a repeat, as no id is smaller than none; nor do they make others one. Rows that share a
    doc_id are a document each and no repeat of each other. Of an id with several labels the greater one counts. A part
    with few masks has zeros for what does not occur. An empty table gives no rows.
    """
    return audit(cells(text_counts(docs, labelled)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, by language."""
    return filter_audit(documents(spark, sf_dir), labels(spark, sf_dir))


OP13_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as least from d),
m as (select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
             + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
             + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e
      where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1 : step - 1]), 0)::int as earlier from o, (select unnest([1, 2, 3, 4, 5]) as step) t),
r as (select part, filter_order, step, s.bit,
             sum(n) filter (where mask & (earlier | s.bit) = 0) as kept, sum(n) filter (where mask & s.bit <> 0 and mask & earlier = 0) as removed,
             sum(n) filter (where mask & s.bit <> 0 and mask & earlier <> 0) as redundant, sum(n) filter (where mask = s.bit) as unique_fails,
             sum(good) filter (where mask & s.bit <> 0 and mask & earlier = 0) as good_lost, sum(toxic) filter (where mask & s.bit <> 0 and mask & earlier = 0) as toxic_lost
      from c, s group by part, filter_order, step, s.bit)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       (sum(coalesce(removed, 0)) over (partition by part, bit))::bigint as shapley
from r
"""
