"""Quality rules: learned decision lists over document statistics, in DataFrame functions only.

Statistics are computed by Spark expressions on whole texts. Sequential covering learns an ordered list of rules for low
quality from labelled statistics: each rule is a conjunction of thresholds, grown condition by condition for information
gain on two thirds of the rows and pruned on the last third; rows that a rule covers leave before the next one is
learned. Every step is one aggregation over all labelled rows - a histogram of each statistic -, of which the driver
sees at most BINS numbers a statistic. The list becomes one CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import WORD, documents, fold, labelled_ids, labels, stored

BINS = 32
#: Labelled ids of each label that rules are learned from, at most (about).
SAMPLE = 20_000
#: A rule is kept if it is right on this share of the rows it covers when pruned, and on this many.
PRECISION, SUPPORT = 0.9, 3
#: What the shapes below are read from; counted per word.
SHAPES = {
    "mean_word": lambda t: t["word_chars"] / t["n_words"],
    "symbol_rate": lambda t: t["n_symbols"] / t["n_words"],
    "dup_line_rate": lambda t: t["n_dup_lines"] / t["n_words"],
    "repeat_rate": lambda t: t["n_repeat_words"] / t["n_words"],
    "capital_rate": lambda t: t["n_capitals"] / t["n_words"],
    "mark_rate": lambda t: t["n_marks"] / t["n_words"],
    "digit_rate": lambda t: t["n_digits"] / t["n_words"],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_digits"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words lie in five-word windows found twice or more in the text.

    Windows are compared by XXH64 of their words (64 bits, within one text). Repeats are neighbours once the windows
    are sorted, so the work is n log n for n words.
    """

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            places = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
            return let(places, covered)

        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, of_sorted))

    def covered(places: Column) -> Column:
        n = F.size(places)
        steps = F.zip_with(F.slice(places, 1, n - 1), F.slice(places, 2, n - 1), lambda a, b: F.least(b - a, F.lit(5)))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(5), lambda acc, x: acc + x))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, F.lit(5))))
        return F.when(F.size(w) < 6, F.lit(0)).otherwise(let(windows, of_hashes))

    return of_words(words).cast("long")


def all_counts(text: Column) -> Column:
    """The counts of COUNTS as one struct; a null text has no words and every count 0."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"\p{Lu}{2,}")).cast("long").alias("n_capitals"),
            F.regexp_count(t, F.lit(r"[!?]+")).cast("long").alias("n_marks"),
            F.regexp_count(t, F.lit(r"[0-9]+")).cast("long").alias("n_digits"),
        )

    return let(F.regexp_extract_all(t, F.lit(f"({WORD})"), 1), of_words)


def statistics(docs: DataFrame, prefix: str, text: str = "text") -> DataFrame:
    """docs with the counts of COUNTS added as prefix + name; a null text has no words and every count 0."""
    whole = f"{prefix}all"
    out = docs.withColumn(whole, all_counts(F.col(text)))
    return out.withColumns({prefix + c: F.col(whole)[c] for c in COUNTS}).drop(whole)


def count_of(stats: str | Column, name: str) -> Column:
    """A count: the column of this name with the prefix stats, or the field of the struct stats."""
    return F.col(stats + name) if isinstance(stats, str) else stats[name]


def base_failed(stats: str | Column) -> Column:
    n, repeated = count_of(stats, "n_words"), count_of(stats, "n_repeat_words")
    return (n < 10) | (100 * repeated > 20 * n)


def shapes(stats: str | Column) -> dict[str, Column]:
    """The rates that rules have thresholds on; 0 for texts without words."""
    t = {c: count_of(stats, c) for c in COUNTS}
    return {k: F.when(t["n_words"] > 0, f(t)).otherwise(F.lit(0.0)) for k, f in SHAPES.items()}


@dataclass(frozen=True)
class Condition:
    shape: str
    above: bool
    threshold: float

    def column(self, rates: dict[str, Column]) -> Column:
        x = rates[self.shape]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, rates: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(rates)
    return out


def verdict(rules: list[Rule], stats: str | Column) -> Column:
    """The decision list as one CASE expression: false at the first rule that covers the document, true if none does."""
    if not rules:
        return F.lit(True)
    rates = shapes(stats)
    out = F.when(covers(rules[0], rates), F.lit(False))
    for rule in rules[1:]:
        out = out.when(covers(rule, rates), F.lit(False))
    return out.otherwise(F.lit(True))


def learn_rules(labelled: DataFrame, prefix: str, label: str, part: str) -> list[Rule]:
    """An ordered list of rules for label 0. labelled: statistics, label (0 or 1) and part (0, 1: growing; 2: pruning).

    No labelled row of one of the two kinds gives an empty list.
    """
    names = list(SHAPES)
    columns = shapes(prefix)
    rows = labelled.select(*[columns[k].alias(k) for k in names], F.col(label).alias("label"), F.col(part).alias("part"))
    cuts = {k: sorted(set(v or [])) for k, v in zip(names, rows.agg(*[F.percentile_approx(k, [i / BINS for i in range(BINS + 1)], 10_000).alias(k) for k in names]).head())}
    steps = {k: [x for x in cuts[k] if x is not None] for k in names}
    # The bin of a value is how many cuts lie below it, so that "bin <= b" says "value <= cut b".
    binned = rows.select(*[sum((F.col(k) > F.lit(x)).cast("int") for x in steps[k]).alias(k) if steps[k] else F.lit(0).alias(k) for k in names], "label", "part")
    cube = stored(binned.groupBy(*names, "label", "part").agg(F.count(F.lit(1)).alias("n")), "cube")

    def histogram(where: Column) -> dict[str, dict[int, list[int]]]:
        kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), F.col(k).alias("bin")) for k in names])).alias("x")
        found = cube.where(where).select(kinds, "label", "n").groupBy("x.shape", "x.bin", "label").agg(F.sum("n").alias("n")).collect()
        out: dict[str, dict[int, list[int]]] = {k: {} for k in names}
        for r in found:
            out[r["shape"]].setdefault(r["bin"], [0, 0])[r["label"]] += r["n"]
        return out

    def of(rule: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for k, above, b in rule:
            out = out & (F.col(k) > b if above else F.col(k) <= b)
        return out

    def covered(where: Column) -> tuple[int, int]:
        r = cube.where(where).agg(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.sum(F.when(F.col("label") == 1, F.col("n")))).head()
        return int(r[0] or 0), int(r[1] or 0)

    left, rules = F.lit(True), []
    # A rule ends when no condition gains anything, the list when no rule is right often enough on the pruning rows;
    # each rule takes rows away and each condition halves a statistic's range, so both loops end.
    while True:
        growing, rule = left & (F.col("part") < 2), []
        while True:
            hist = histogram(growing & of(rule))
            low, high = (sum(v[k] for v in hist[names[0]].values()) for k in (0, 1))
            if not low or not high:
                break
            before, best = math.log2(low / (low + high)), (0.0, None)
            for k in names:
                p = n = 0
                for b in sorted(hist[k])[:-1]:
                    p, n = p + hist[k][b][0], n + hist[k][b][1]
                    for above, x, y in ((False, p, n), (True, low - p, high - n)):
                        gain = x * (math.log2(x / (x + y)) - before) if x else 0.0
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (k, above, b))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # Conditions go from the end as long as the rule is no worse on rows it wasn't grown on.
        worth = []
        for m in range(1, len(rule) + 1):
            p, n = covered(left & (F.col("part") == 2) & of(rule[:m]))
            worth.append(((p - n) / (p + n) if p + n else -1.0, p, n, m))
        value, p, n, m = max(worth, key=lambda w: (w[0], -w[3]))
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(tuple(Condition(k, above, steps[k][b]) for k, above, b in rule[:m]))
        left = left & ~of(rule[:m])
    if not rules:
        return rules
    # Each threshold moves to the middle of the gap above it, as wide as the labelled values leave it.
    flat = [c for rule in rules for c in rule]
    above = rows.agg(*[F.min(F.when(F.col(c.shape) > c.threshold, F.col(c.shape))).alias(str(k)) for k, c in enumerate(flat)]).head()
    moved = iter([Condition(c.shape, c.above, c.threshold if x is None else (c.threshold + x) / 2) for c, x in zip(flat, above)])
    return [tuple(next(moved) for _ in rule) for rule in rules]


def trained_rules(docs: DataFrame, known: DataFrame, prefix: str = "stat_") -> list[Rule]:
    """Rules from labelled rows. docs: doc_id and statistics; known: (doc_id, label), each id once. Rows that the base test fails are left to it."""
    rows = docs.where(~base_failed(prefix)).join(known, "doc_id").withColumn("part", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3))).cast("int"))
    return learn_rules(rows, prefix, "label", "part")


def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label) of the labelled documents outside fold 0 of 5 that rules are learned from: SAMPLE of each label at most."""
    known = labels(spark, sf_dir).where(fold(F.col("doc_id"), 5) != 0)
    return stored(labelled_ids(known, "quality", SAMPLE)[0], "labelled-ids")


def rules_filter(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs, all columns as they are, without those that the base test or a rule rejects. No shuffle, no Python.

    A null or empty text has no words and fails the base test; repeated rows and rows with a null id each get their
    verdict; an empty table gives none.

    The list reads a struct that is counted once a row. As columns, the counts would be put into the filter once for
    each condition, texts would be read as often, and a long list would not fit the driver.
    """
    return docs.where(let(all_counts(F.col("text")), lambda s: ~base_failed(s) & verdict(rules, s)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query. Statistics of all documents, rules from labels outside fold 0 of 5 (labelled_rows), a verdict on every document.

    A null or empty text has no words and fails the base test; repeated rows each get a verdict; without labels the
    list is empty and the base test alone decides; further columns of documents are not looked at.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    stats = stored(statistics(docs, "stat_").drop("text"), "statistics")
    rules = trained_rules(stats, labelled_rows(spark, sf_dir))
    kept = ~base_failed("stat_") & verdict(rules, "stat_")
    return stats.select("doc_id", *[F.col("stat_" + c).alias(c) for c in COUNTS[:5]], base_failed("stat_").alias("base_failed"), kept.alias("kept"))
