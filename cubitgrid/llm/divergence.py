"""Divergence between the sources of a language, priced over supports instead of over whole vocabularies.

For two groups the sum over all kept terms falls into terms that only one of them has, terms that both have and terms
that neither has. Histograms of a group's counts price all its terms as if the other had none; a join of postings on
shared terms corrects those that both have; what neither has costs a constant each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubitgrid.llm.cells import join_groups
from cubitgrid.llm.common import give_back
from cubitgrid.plans.shipping import ship
from cubitgrid.plans.tables import Tables

#: Letters of the basic alphabet and all characters beyond it, as bytes of UTF-8 text in lower case.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Parts per billion: the unit of prices.
SCALE = 1_000_000_000
#: Terms that a task counts in memory before it hands them on.
HELD_TERMS = 300_000
#: Tasks that the pairs of one language are dealt to.
SALT = 32


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed over what a task holds at a time."""

    def flush(held: dict) -> pa.RecordBatch:
        rows = [(lang, source, term, c, seen[term]) for (lang, source), (n, seen) in held.items() for term, c in n.items()]
        lang, source, term, n, in_docs = zip(*rows, strict=True)
        columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())]
        return pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                terms = TERM.findall(text.as_py().lower())
                if terms:
                    n, seen = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                    n.update(terms)
                    seen.update(set(terms))
                    if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                        yield flush(held)
                        held.clear()
        if held:
            yield flush(held)
        held.clear()
        give_back()

    ship(docs.sparkSession)
    # bytes.lower() changes A-Z alone
    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def price(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total) in whole numbers; null where there are no terms at all."""
    top = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, F.nullif(total, F.lit(0)).cast("decimal(20,0)")) + 1


def cost(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = 3, term_ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) group.

    Part `pair`: the group's divergence from each other source of its language, over the language's kept terms (those in
    at least least_docs of its documents). Part `term`: terms that the group uses more than its language, up to
    term_ranks of them. Ranks start at 1, by value downwards, then item. All values are whole numbers.

    Null text, lang and source count as ''. A repeated row counts as a document of its own. A group without terms has
    pairs too; where a language keeps no term all its pairs have value 0, and a group alone in its language has none.
    Other columns don't matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "divergence")
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # tasks sum up first, so one shuffle by term serves the sums and the windows over a term's sources
    each = counted(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    each = each.withColumns({"in_docs": F.sum("docs").over(over), "in_lang": F.sum("n").over(over), "head": F.min("source").over(over) == F.col("source")})
    postings = tables.cut(each.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "in_lang", "head"))

    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("size"), F.count_if("head").alias("heads"))
    names = rows.select("lang", "source").distinct()
    found = names.join(own, ["lang", "source"], "left").fillna(0, ["own", "size", "heads"])
    whole = found.groupBy("lang").agg(F.sum("own").alias("lang_own"), F.sum("heads").alias("kept"))
    groups = tables.cut(
        found.join(whole, "lang")
        .withColumns({"total": F.col("own") + F.col("kept"), "lang_total": F.col("lang_own") + F.col("kept")})
        .select("lang", "source", "size", "kept", "total", "lang_total", price(F.lit(0), F.col("total")).alias("zero"), F.xxhash64("lang", "source").alias("at"))
    )
    # a group may hold a third of all postings: its figures come to where they are
    told = groups.select("at", "size", "total", "lang_total", "zero", F.col("lang").alias("of_lang"), F.col("source").alias("of_source"))
    met = join_groups(postings.withColumn("at", F.xxhash64("lang", "source")), told, "at", "term", postings.count())
    met = met.where((F.col("lang") == F.col("of_lang")) & (F.col("source") == F.col("of_source")))
    priced = tables.cut(met.select("lang", "source", "term", price(F.col("n"), F.col("total")).alias("p"), price(F.col("in_lang"), F.col("lang_total")).alias("q"), "zero"))
    tables.drop(postings)

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), cost(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(groups, priced).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(ranked).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= term_ranks))


def _pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language: sums of what both ways add to it."""
    salt = F.pmod(F.xxhash64("source"), F.lit(SALT))
    left = groups.select("lang", "source", "size", "kept", "zero", salt.alias("salt"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("size").alias("item_size"), F.col("zero").alias("item_zero"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    both = left.join(right, ["lang", "salt"]).where("source <> item")
    neither = both.select("lang", "source", "item", (F.col("kept") - F.col("size") - F.col("item_size")).cast("decimal(20,0)").alias("times"), cost(F.col("zero"), F.col("item_zero")).alias("each"))

    add = lambda times, value: F.sum(times.cast("decimal(20,0)") * value.cast("decimal(18,0)"))
    # all terms of a group as if the other had none of them, seen from either side
    heights = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    alone = both.join(heights, ["lang", "source"]).groupBy("lang", "source", "item").agg(add(F.col("terms"), cost(F.col("p"), F.col("item_zero"))).alias("from"), add(F.col("terms"), cost(F.col("item_zero"), F.col("p"))).alias("to"))

    # terms that both have were priced twice as if one had them, and once too often as if neither had them
    a, b = (priced.select("lang", "term", F.col("source").alias(f"{x}_source"), F.col("p").alias(f"{x}_p"), F.col("zero").alias(f"{x}_zero")) for x in "ab")
    shared = a.join(b, ["lang", "term"]).where("a_source < b_source")

    def corrected(x: str, y: str) -> Column:
        p, q, p0, q0 = (F.col(f"{k}{end}") for end in ("_p", "_zero") for k in (x, y))
        return F.sum((cost(p, q) - cost(p, q0) - cost(p0, q) + cost(p0, q0)).cast("decimal(20,0)"))

    common = shared.groupBy("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item")).agg(corrected("a", "b").alias("from"), corrected("b", "a").alias("to"))

    def directed(rows: DataFrame) -> DataFrame:
        ways = F.array(F.struct("source", "item", F.col("from").alias("part")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("to").alias("part")))
        return rows.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")

    constant = neither.select("lang", "source", "item", (F.col("times") * F.coalesce("each", F.lit(0)).cast("decimal(18,0)")).alias("part"))
    parts = constant.unionByName(directed(alone)).unionByName(directed(common))
    return parts.groupBy("lang", "source", "item").agg(F.coalesce(F.sum("part"), F.lit(0)).cast("bigint").alias("value"))
