"""Matching rows of two tables by ranges, words of titles, names and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of titles that do not count.
TITLE_STOP_WORDS = ("the", "a", "an", "of", "in", "on", "for", "and", "with", "from", "to", "by", "its", "their", "using", "study", "new", "based")
#: Titles before and suffixes after a person's name, and punctuation that does not count in it.
NAME_PREFIX, NAME_SUFFIX = r"^(dr\.?|prof\.?|mr\.?|ms\.?|mrs\.?)\s+", r"\s+(jr\.?|sr\.?|iii|ii|iv)$"
NAME_PUNCTUATION = "[.,;:\\-'\"`]"


def mapped(value: Column, names: dict[str, str]) -> Column:
    """Values replaced by a small dictionary; others stay."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), value)


def range_matches(rows: DataFrame, key: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Rows with every range [low, high] that holds their key. Both meet by buckets of ``width``, an equi-join."""
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    near = rows.withColumn("_bucket", F.floor(F.col(key) / width)).join(spread, "_bucket")
    return near.filter(F.col(key).between(F.col(low), F.col(high))).drop("_bucket")


def title_words(title: Column) -> Column:
    """The distinct words of a title that count."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda x: ~x.isin(*TITLE_STOP_WORDS)))


def all_title_matches(queries: DataFrame, query_id: str, candidates: DataFrame, candidate_id: str) -> DataFrame:
    """(query_id, candidate_id, overlap) of all titles with enough words in common: three, or all of fewer.

    Both sides have a list ``words`` without repeats. Titles with t words in common have one among their rarest words,
    all but t - 1 of each: only by these do they meet, so a common word brings few rows together. What meets is counted
    on the whole lists.
    """
    rarity = candidates.select(F.explode("words").alias("_word")).groupBy("_word").agg(F.count("*").alias("_rows"))

    def ranked(rows: DataFrame, key: str, words: str) -> DataFrame:
        spread = rows.select(key, F.explode("words").alias("_word")).join(rarity, "_word", "left")
        lists = spread.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_rows", F.lit(0)).alias("n"), "_word"))), lambda s: s["_word"]).alias(words))
        return lists.select(key, words, F.size(words).alias(f"{words}_many"), F.posexplode(words).alias(f"{words}_at", "_word"))

    need = F.least(F.lit(3), F.col("_q_many"))
    near = ranked(queries, query_id, "_q").filter(F.col("_q_at") <= F.col("_q_many") - need).join(ranked(candidates, candidate_id, "_c"), "_word")
    pairs = near.filter(F.col("_c_at") <= F.col("_c_many") - need).dropDuplicates([query_id, candidate_id])
    common = F.size(F.array_intersect("_q", "_c"))
    return pairs.filter(common >= need).select(query_id, candidate_id, common.cast("long").alias("overlap"))


def fuzzy_title_matches(queries: DataFrame, query_id: str, candidates: DataFrame, candidate_id: str) -> DataFrame:
    """For each query the first candidate, by id, whose title has enough words in common."""
    hits = all_title_matches(queries, query_id, candidates, candidate_id)
    return hits.groupBy(query_id).agg(F.min_by(F.struct(candidate_id, "overlap"), candidate_id).alias("_hit")).select(query_id, "_hit.*")


def normal_name(name: Column) -> Column:
    """A person's name in lower case without title, suffix and punctuation."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), NAME_PREFIX, ""), NAME_SUFFIX, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, NAME_PUNCTUATION, " "), r"\s+", " "))


def name_matches(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Pairs of rows whose names may be one person's: an equi-join on the surname.

    Equal names match; otherwise one side has no given name, or given names share an initial.
    """

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        parts = F.split(F.col("_name"), " ")
        named = rows.withColumn("_name", normal_name(F.col(name))).drop(name).filter("_name <> ''")
        initials = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.left(x, F.lit(1)))
        return named.select(*[c for c in rows.columns if c != name], F.element_at(parts, -1).alias("_surname"), F.col("_name").alias(f"_name_{side}"), initials.alias(f"_initials_{side}"))

    pairs = keyed(left, "l").join(keyed(right, "r"), "_surname")
    same = F.col("_name_l") == F.col("_name_r")
    bare = (F.size("_initials_l") == 0) | (F.size("_initials_r") == 0)
    return pairs.filter(same | bare | F.arrays_overlap("_initials_l", "_initials_r")).drop("_surname", "_name_l", "_name_r", "_initials_l", "_initials_r")


def name_classes(rows: DataFrame, name: str) -> DataFrame:
    """Rows with ``surname`` and the sorted ``initials`` of their given names in place of the name.

    Whether names match in ``name_matches`` depends on these two alone, so rows of one class all match each other.
    """
    parts = F.split(F.col("_name"), " ")
    initials = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.left(x, F.lit(1)))
    named = rows.withColumn("_name", normal_name(F.col(name))).drop(name).filter("_name <> ''")
    return named.select(*[c for c in rows.columns if c != name], F.element_at(parts, -1).alias("surname"), F.array_sort(F.array_distinct(initials)).alias("initials"))


def name_class_links(classes: DataFrame) -> DataFrame:
    """(surname, left_initials, right_initials) of the distinct classes of ``name_classes`` that match, each pair once."""
    distinct = classes.select("surname", "initials").distinct()
    pairs = distinct.withColumnRenamed("initials", "left_initials").join(distinct.withColumnRenamed("initials", "right_initials"), "surname").filter("left_initials < right_initials")
    return pairs.filter((F.size("left_initials") == 0) | (F.size("right_initials") == 0) | F.arrays_overlap("left_initials", "right_initials"))


def name_match_counts(classes: DataFrame, key: str) -> DataFrame:
    """Rows of ``name_classes`` with ``class_id``, the smallest key of their class, and ``links``, how many other rows match.

    Classes of a surname are compared with each other, not rows: their number depends on initials alone.
    """
    sizes = classes.groupBy("surname", "initials").agg(F.count("*").alias("_n"), F.min(key).alias("class_id"))
    links = name_class_links(classes)
    both = links.union(links.select("surname", "right_initials", "left_initials"))
    others = both.toDF("surname", "initials", "_other").join(sizes.select("surname", F.col("initials").alias("_other"), "_n"), ["surname", "_other"])
    linked = others.groupBy("surname", "initials").agg(F.sum("_n").alias("_linked"))
    counted = sizes.join(linked, ["surname", "initials"], "left").select("surname", "initials", "class_id", (F.coalesce("_linked", F.lit(0)) + F.col("_n") - 1).alias("links"))
    return classes.join(counted, ["surname", "initials"])


def containing_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of texts of which one contains the other; for dimension tables, as no key can bring them together."""
    return left.join(right, F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a)))


def zipped(a: str, b: str) -> Column:
    """Structs (a, b) of two lists by position, up to the shorter."""
    many = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, many), F.slice(b, 1, many), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def padded(a: str, b: str) -> Column:
    """Structs (a, b) as long as the first list; a shorter second list repeats its last item."""
    at = lambda x, i: F.struct(x.alias("a"), F.coalesce(F.get(F.col(b), i), F.try_element_at(F.col(b), F.lit(-1))).alias("b"))
    return F.transform(F.col(a), at)


def filled(a: str, b: str) -> Column:
    """A list with its holes filled from a second one at the same positions, up to the shorter."""
    many = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, many), F.slice(b, 1, many), lambda x, y: F.coalesce(x, y))


def citation_counts(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(cited, total, non_self) from edges (cited, citing) and papers (id, authors): a citation from a work with a
    common author is no foreign one."""
    of = lambda end: papers.select(F.col("id").alias(end), F.array_compact("authors").alias(f"_{end}"))
    rows = edges.join(of("cited"), "cited").join(of("citing"), "citing")
    return rows.groupBy("cited").agg(F.count("*").alias("total"), F.count_if(~F.arrays_overlap("_cited", "_citing")).alias("non_self"))


def by_candidate_keys(rows: DataFrame, row_id: str, keys: Column, lookup: DataFrame, key: str) -> DataFrame:
    """Rows with the lookup row of the first of their candidate keys that is there."""
    tried = rows.select(row_id, F.posexplode(keys).alias("_priority", key))
    hits = tried.join(lookup, key)
    values = [c for c in lookup.columns if c != key]
    best = F.min_by(F.struct(*values), F.struct("_priority", *values))
    return hits.groupBy(row_id).agg(best.alias("_hit")).select(row_id, "_hit.*")
