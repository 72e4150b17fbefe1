"""Source divergence audit: how far the sources of a language are apart in the terms that the language keeps.

Terms are counted by (language, source) in Arrow batches and summed in the JVM. Each kept term of a language then becomes
one wide vector: an array with an element for each source that has it, in the order of the language's sources. Shares p
of a term are whole numbers, 1 + floor(10**9 * (count + 1) / (n + v)), n the group's count over kept terms, v the number
of those terms, and a term adds floor((p - q)**2 / q) to a pair of sources.

A pair's value is a sum over all kept terms, but a vector only emits, by higher-order functions, the pairs of sources
that both have its term: f(p, q) less f(p, q0) less f(p0, q) plus f(p0, q0), p0 and q0 the shares of a term that a source
lacks. These are summed by partial aggregates. The rest needs no pairs of a term: f(p, q0) depends on the count alone, so
it is summed over counts and how many terms have them, and v * f(p0, q0) closes the sum. All of it is exact. Higher-order
functions are interpreted, so they carry shares of pairs, and the arithmetic on these is compiled with the aggregate.

Defined results: null text, lang or source count as ''. A (lang, source) that occurs has its rows even without terms; a
language without kept terms has pair values of 0 and no term rows; a language of one source has no pairs. Repeated rows
are documents of their own; ties rank by UTF-8; no other columns are read. Sums are 64-bit, which holds while
(10**9 + v)**2 does not exceed 2**62, or v is below 10**9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hot_keys import join_aggregate
from .terms import LETTERS, terms_of
from .words import slices
from .workspace import saved

SLICE_BYTES = 12 << 20
#: A language keeps the terms that so many of its documents have.
LEAST_DOCUMENTS = 3


def term_counts(documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, documents): occurrences and documents of each term; one row without term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                terms, first = terms_of(part.column("text"), LETTERS)
                coded = terms.dictionary_encode()
                wide = max(len(coded.dictionary), 1)
                groups = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], names=["lang", "source"]).to_pylist()
                number = {}
                group = np.array([number.setdefault((g["lang"], g["source"]), len(number)) for g in groups], np.int64)
                sizes = np.diff(first)
                place = np.repeat(np.arange(part.num_rows), sizes)
                pairs, many = np.unique(place * wide + coded.indices.to_numpy(), return_counts=True)  # once for each document
                at = group[pairs // wide] * wide + pairs % wide
                order = np.argsort(at, kind="stable")
                start = np.flatnonzero(np.diff(at[order], prepend=-1))
                at, n = at[order][start], np.add.reduceat(many[order], start) if len(start) else many
                which, languages, sources = at // wide, [g[0] for g in number], [g[1] for g in number]
                plain = pa.array(languages, pa.string()), pa.array(sources, pa.string())
                columns = [*(c.take(pa.array(which)) for c in plain), coded.dictionary.take(pa.array(at % wide)), pa.array(n.astype(np.int64)), pa.array(np.diff(start, append=len(order)))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "documents"])
                none = pa.array(np.zeros(len(number), np.int64))
                yield pa.RecordBatch.from_arrays([*plain, pa.nulls(len(number), pa.string()), none, none], names=["lang", "source", "term", "n", "documents"])

    plain = documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    parts = plain.mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(count: str, below: str) -> str:
    """SQL of 1 + floor(10**9 * (count + 1) / below): at once, or for large counts in 64-bit steps of three digits."""
    rest, shares = f"({count}) + 1", []
    for step in range(4):
        shares.append(f"({rest}) div {below}" + f" * {10 ** (9 - 3 * step)}L" * (step < 3))
        rest = f"(({rest}) % {below}) * 1000L"
    return f"(1L + CASE WHEN ({count}) < 9000000000L THEN 1000000000L * (({count}) + 1) div {below} ELSE {' + '.join(shares)} END)"


def _apart(p: str, q: str) -> str:
    """SQL of floor((p - q)**2 / q)."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def vectors(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept terms, (lang, term, total, own), own an array of (source, n) in order of source; and the languages,
    (lang, sources, below, p0, whole, v): for each source its count over kept terms and their number v together, and the
    share of a term that it lacks; whole is as below, for the language."""
    terms = counts.filter("term IS NOT NULL").groupBy("lang", "term")
    terms = terms.agg(F.sum("documents").alias("documents"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("own"))
    terms = saved(terms.filter(F.col("documents") >= LEAST_DOCUMENTS).select("lang", "term", "total", "own"), "term-vectors")
    kept = terms.select("lang", F.inline("own")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.filter("term IS NULL").select("lang", "source", F.lit(0).cast("long").alias("n")).unionByName(kept).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    languages = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"), F.sum("n").alias("n"))
    languages = languages.join(terms.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    languages = languages.select("lang", F.col("g.source").alias("sources"), F.expr("transform(g, x -> greatest(x.n + v, 1L))").alias("below"), F.expr("greatest(n + v, 1L)").alias("whole"), "v")
    return terms, saved(languages.withColumn("p0", F.expr(f"transform(below, b -> {_share('0L', 'b')})")), "languages")


def audit(documents: DataFrame, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" has the language's other sources by distance, all of them;
    part "term" the ``most`` terms that the source has more often than its language, by what they add to its distance."""
    counts = saved(term_counts(documents), "term-counts")
    terms, languages = vectors(counts)
    pairs = _ranked(_distances(terms, languages), "pair")
    theirs = join_aggregate(terms, languages.select("lang", "sources", "below", "whole"), "lang")
    theirs = theirs.select("lang", "term", "sources", "below", F.expr(_share("total", "whole")).alias("q"), F.inline("own"))
    theirs = theirs.withColumn("p", F.expr(_share("n", "below[array_position(sources, source) - 1]"))).filter("p > q")
    high = theirs.select("lang", "source", F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    return pairs.unionByName(_ranked(high, "term").filter(F.col("rank") <= most))


def _distances(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every pair of sources of a language."""
    wide = join_aggregate(terms.filter("size(own) > 1"), languages, "lang").withColumn("own", F.expr("transform(own, e -> struct(cast(array_position(sources, e.source) - 1 AS int) AS at, e.n AS n))"))
    wide = wide.select("lang", F.expr(f"transform(own, e -> struct(e.at AS at, {_share('e.n', 'below[e.at]')} AS p, p0[e.at] AS p0))").alias("own"))
    emitted = F.expr("flatten(transform(own, a -> transform(own, b -> struct(a.at AS i, a.p AS p, a.p0 AS p0, b.at AS j, b.p AS q, b.p0 AS q0))))")
    both = wide.select("lang", F.inline(emitted)).filter("i <> j").groupBy("lang", "i", "j")
    both = both.agg(F.sum(F.expr(f"{_apart('p', 'q')} - {_apart('p', 'q0')} - {_apart('p0', 'q')} + {_apart('p0', 'q0')}")).alias("f"))

    # how many terms have a count in a source: what they add against a source that lacks them depends on the count alone
    held = terms.select("lang", F.inline("own")).groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    held = join_aggregate(held, languages, "lang").withColumn("at", F.expr("cast(array_position(sources, source) - 1 AS int)"))
    held = held.select("lang", "at", "terms", F.expr(_share("n", "below[at]")).alias("p"), F.expr("p0[at]").alias("own0"), F.posexplode("p0").alias("j", "q0")).filter("at <> j")
    lacked = held.groupBy("lang", "at", "j").agg(
        F.sum(F.expr(f"terms * ({_apart('p', 'q0')} - {_apart('own0', 'q0')})")).alias("up"), F.sum(F.expr(f"terms * ({_apart('q0', 'p')} - {_apart('q0', 'own0')})")).alias("down")
    )
    up, down = lacked.select("lang", F.col("at").alias("i"), "j", F.col("up").alias("f")), lacked.select("lang", F.col("j").alias("i"), F.col("at").alias("j"), F.col("down").alias("f"))
    sums = both.unionByName(up).unionByName(down).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
    first = languages.select("lang", "sources", "p0", "v", F.posexplode("sources").alias("i", "source"))
    every = first.select("lang", "i", "source", "sources", "v", F.expr("p0[i]").alias("own0"), F.posexplode("p0").alias("j", "q0")).filter("i <> j")
    value = F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise(F.coalesce("f", F.lit(0).cast("long")) + F.expr(f"v * {_apart('own0', 'q0')}"))
    return every.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.expr("sources[j]").alias("item"), value.alias("value"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
