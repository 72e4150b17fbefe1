"""Compound normalisers: countries, journals, institutions, subfields, facilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alternation, dictionaries, normalise, strategies
from .registry import Tables, query

_LABEL_TERMS = [("the", "determiner", 0), ("der", "determiner", 1), ("la", "determiner", 2), ("and", "conjunction", 3), ("und", "conjunction", 4), ("y", "conjunction", 5), ("with", "preposition", 6), ("mit", "preposition", 7)]
_V = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _LABEL_TERMS) + ") v(term, canonical, ord)"
_W = r"[\p{L}\p{N}_]"


@query("SELECT s_suppkey, trim(rtrim(split_part(a, ',', -1), ''']\".')) AS country FROM (SELECT s_suppkey, s_name || ', City, ' || n_name || '.''' AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def country_last_token(t: Tables) -> DataFrame:
    """The text after the last comma of an affiliation, without closing marks."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", normalise.last_part(F.concat("s_name", F.lit(", City, "), "n_name", F.lit(".'"))).alias("country"))


@query(
    """WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Inst, Boston, USA' WHEN 1 THEN 'Lab, ' || n_name || '.' WHEN 2 THEN 'Univ of ' || n_name WHEN 3 THEN 'Nowhere' ELSE NULL END AS a, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'United States' WHEN 1 THEN n_name WHEN 2 THEN n_name END AS country FROM a"""
)
def country_cascade(t: Tables) -> DataFrame:
    """Alias of the last part, then a known country as the last part, then one at the end of the text, longest first."""
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, "Inst, Boston, USA").when(k == 1, F.concat(F.lit("Lab, "), "n_name", F.lit("."))).when(k == 2, F.concat(F.lit("Univ of "), "n_name")).when(k == 3, "Nowhere")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.alias("a"))
    known = normalise.known_countries(t.nation, "n_name")
    return rows.select("c_custkey", normalise.country(F.col("a"), known).alias("country"))


@query(
    """SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN d.source ELSE d.lang END AS first_country, CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 2 END AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def country_fallback(t: Tables) -> DataFrame:
    """The list from affiliations, or where it is empty the one from the source text."""
    rows = t.documents.select("doc_id", "source", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    primary = F.when(F.col("quality").isNotNull(), F.array("source")).otherwise(F.array().cast("array<string>"))
    countries = normalise.first_filled(primary, F.array("lang", "source"))
    return rows.select("doc_id", F.get(countries, F.lit(0)).alias("first_country"), F.size(countries).alias("n"))


@query(
    rf"""WITH h AS (SELECT doc_id, canonical, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM documents JOIN {_V} ON regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || term || '($|[^\p{{L}}\p{{N}}_])'))
        SELECT d.doc_id, canonical AS venue FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id AND r = 1"""
)
def journal_norm_first(t: Tables) -> DataFrame:
    """The first dictionary entry, in its order, that a text has."""
    return dictionaries.labelled(t.documents, "doc_id", ["text"], dictionaries.terms(t.spark, _LABEL_TERMS), "first", "venue")


@query(
    rf"""WITH h AS (SELECT doc_id, canonical, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS r FROM documents JOIN {_V} ON regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || term || '($|[^\p{{L}}\p{{N}}_])'))
        SELECT d.doc_id, canonical AS venue FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id AND r = 1"""
)
def journal_norm_last(t: Tables) -> DataFrame:
    """The last entry that matches wins."""
    return dictionaries.labelled(t.documents, "doc_id", ["text"], dictionaries.terms(t.spark, _LABEL_TERMS), "last", "venue")


@query(
    f"""WITH h AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, ord) AS r FROM documents JOIN {_V} ON contains(text, term))
        SELECT d.doc_id, term AS venue FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id AND r = 1"""
)
def longest_match(t: Tables) -> DataFrame:
    """Case-sensitive substrings, the longest first."""
    plain = [(a, c) for a, _, c in _LABEL_TERMS]
    return dictionaries.labelled(t.documents, "doc_id", ["text"], dictionaries.terms(t.spark, plain), "longest", "venue", boundary=False, case_sensitive=True)


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 1 ELSE 0 END AS open_access FROM documents")
def flag_isin(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.col("source").isin("src1", "src2", "src3"), 1).otherwise(0).alias("open_access"))


@query(
    r"""WITH p AS (SELECT c_custkey, 'Dr X: Dept of Maths, ' || CASE c_custkey % 3 WHEN 0 THEN 'University of ' || n_name WHEN 1 THEN n_name || ' Institute' ELSE n_name END || ', City' AS a FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 'Dept of Maths' ELSE trim(split_part(split_part(a, ': ', 2), ',', 2)) END AS institution FROM p"""
)
def institution_extract(t: Tables) -> DataFrame:
    """The first part of an affiliation that names an institution, or its first part."""
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.concat(F.lit("University of "), "n_name")).when(k == 1, F.concat("n_name", F.lit(" Institute"))).otherwise(F.col("n_name"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("Dr X: Dept of Maths, "), name, F.lit(", City")).alias("a"))
    return rows.select("c_custkey", F.get(normalise.institutions(F.col("a")), F.lit(0)).alias("institution"))


@query(
    rf"""WITH t AS (SELECT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_W}+')) AS w FROM documents)),
             h AS (SELECT doc_id, canonical, count(*) AS n, min(ord) AS o FROM t JOIN {_V} ON w = term GROUP BY 1, 2),
             r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM h)
        SELECT d.doc_id, coalesce(canonical, 'Unclassified') AS subfield FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r = 1"""
)
def classify_by_count(t: Tables) -> DataFrame:
    """The label whose aliases occur most often; ties by alias order."""
    return dictionaries.labelled(t.documents, "doc_id", ["text"], dictionaries.terms(t.spark, _LABEL_TERMS), "most_frequent", "subfield", "Unclassified")


@query(
    """WITH p AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text FROM documents), v(term, ord) AS (VALUES ('idiot', 0), ('ation', 1), ('mentre', 2)),
            h AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM p JOIN v ON contains(lower(text), term)),
            i AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM p JOIN v ON contains(lower(title), term))
       SELECT p.doc_id, coalesce(h.term, i.term) AS facility FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND h.r = 1 LEFT JOIN i ON p.doc_id = i.doc_id AND i.r = 1"""
)
def first_match_label(t: Tables) -> DataFrame:
    """The first listed term in the abstract, or else in the title."""
    rows = t.documents.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")
    listed = dictionaries.terms(t.spark, [("idiot", 0), ("ation", 1), ("mentre", 2)])
    return dictionaries.labelled(rows, "doc_id", ["title", "text"], listed, "last_column", "facility", boundary=False)


@query(
    rf"""WITH h AS (SELECT DISTINCT doc_id, term FROM documents JOIN {_V} ON regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || term || '($|[^\p{{L}}\p{{N}}_])'))
        SELECT term, count(*) AS papers, round(sum(n_chars) / count(*), 6) AS per_paper FROM h JOIN documents d ON h.doc_id = d.doc_id GROUP BY term"""
)
def keyword_metrics(t: Tables) -> DataFrame:
    """Citations per paper by keyword; a paper counts for every keyword that it has."""
    hits = dictionaries.matches(t.documents.select("doc_id", "text", "n_chars"), ["text"], dictionaries.terms(t.spark, _LABEL_TERMS))
    return hits.groupBy("term").agg(F.count("*").alias("papers"), F.round(F.sum("n_chars") / F.count("*"), 6).alias("per_paper"))


@query("WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), c(k) AS (VALUES ('the'), ('and')) SELECT conv_id, turn, k, count(*) AS n FROM l JOIN c ON contains(line, k) GROUP BY ALL")
def contains_join(t: Tables) -> DataFrame:
    """Lines once for every term that they contain."""
    lines = t.conversations.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    hits = dictionaries.matches(lines, ["line"], dictionaries.terms(t.spark, [("the", 0), ("and", 1)]), boundary=False, case_sensitive=True)
    return hits.groupBy("conv_id", "turn", F.col("term").alias("k")).agg(F.count("*").alias("n"))


@query(
    r"""WITH k AS (SELECT o_orderkey, trim(regexp_replace(split_part(o_orderpriority, ',', 1), '\d+', '', 'g')) AS key, o_orderpriority AS venue FROM orders)
        SELECT o_orderkey, CASE WHEN venue IS NULL THEN NULL WHEN key = '-URGENT' THEN 'Urgent' WHEN key = '-HIGH' THEN 'High'
               WHEN contains(lower(key), 'spec') THEN 'Open' WHEN contains(lower(key), 'med') THEN 'Middle' ELSE 'Unknown' END AS label FROM k"""
)
def venue_exact(t: Tables) -> DataFrame:
    """Labels by an exact table after a cut at the comma and without digits, by families, or else unknown."""
    label = normalise.exact_venue(F.col("o_orderpriority"), {"-URGENT": "Urgent", "-HIGH": "High"}, {"med": "Middle", "spec": "Open"})
    return t.orders.select("o_orderkey", label.alias("label"))


_NAMES = "(VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{c}', {o})" for o, (k, c) in enumerate(normalise.COUNTRY_WORDS.items())) + ") v(k, c, o)"


@query(
    rf"""WITH p AS (SELECT doc_id, unnest(string_split(lower(text), ',')) AS part, generate_subscripts(string_split(lower(text), ','), 1) AS pos FROM documents),
             x AS (SELECT doc_id, arg_max(c, pos) AS c FROM p JOIN {_NAMES} ON regexp_replace(regexp_replace(part, '[^a-zA-Z\s]', '', 'g'), '^\s+|\s+$', '', 'g') = k GROUP BY doc_id),
             s AS (SELECT doc_id, arg_min(c, o) AS c FROM documents JOIN {_NAMES} ON contains(lower(text), k) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(x.c, s.c) AS country FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""
)
def country_parts(t: Tables) -> DataFrame:
    """The country of the last comma part that names one, or else of the first name that occurs anywhere."""
    return t.documents.select("doc_id", normalise.country_of_parts(F.col("text")).alias("country"))


@query(
    """SELECT doc_id, CASE WHEN contains(lower(text), ' der ') OR contains(lower(text), ' und ') THEN 'German'
              WHEN contains(lower(text), ' el ') OR contains(lower(text), ' los ') THEN 'Spanish' WHEN contains(lower(text), ' the ') THEN 'English' END AS family FROM documents"""
)
def venue_families(t: Tables) -> DataFrame:
    """The first family, in order, of which a text has a word."""
    families = {"German": (" der ", " und "), "Spanish": (" el ", " los "), "English": (" the ",)}
    return t.documents.select("doc_id", normalise.venue_family(F.col("text"), families).alias("family"))


@query(
    r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a, list_filter(string_split_regex(replace(split_part(text, chr(10), 1), '.', ' '), '\s+'), lambda x: x <> '') AS w FROM documents),
             m AS (SELECT doc_id, a, w, list_position(list_transform(a, lambda x: trim(lower(split_part(x, ',', 1)))), lower(w[-1])) AS pos FROM d)
        SELECT doc_id, CASE WHEN pos > 0 THEN length(a[pos])::VARCHAR WHEN len(w) > 0 AND len(a) = 1 THEN length(a[1])::VARCHAR END AS affiliation FROM m"""
)
def surname_lookup(t: Tables) -> DataFrame:
    """What stands beside the first line that starts with the last word of the first one; in a text of one line, its own."""
    listed = F.split("text", "\n")
    rows = t.documents.select("doc_id", F.get(listed, F.lit(0)).alias("author"), listed.alias("authors"))
    beside = F.transform("authors", lambda x: F.length(x).cast("string"))
    return rows.select("doc_id", normalise.affiliation_by_surname(F.col("author"), F.col("authors"), beside).alias("affiliation"))


_LINE_TERMS = [("the", "THE"), ("the and", "THE AND"), ("and", "AND"), ("of", "OF"), ("of the", "OF THE"), ("in", "IN"), ("in the", "IN THE"), ("que", "QUE"), ("que la", "QUE LA"), ("und", "AND")]
_LINE_PATTERN = r"(?i)\b(" + "|".join(sorted((a for a, _ in _LINE_TERMS), key=len, reverse=True)) + r")\b"
_LINE_NAMES = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in _LINE_TERMS) + "}"


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^\x00-\x7F\P{{L}}]', 'x', 'g'), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
             h AS (SELECT doc_id, pos, regexp_extract_all(line, '{_LINE_PATTERN}') AS names FROM l WHERE regexp_matches(line, '{_LINE_PATTERN}')),
             f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 2 THEN 1 ELSE 0 END AS far FROM h),
             c AS (SELECT *, max(far) OVER (PARTITION BY doc_id ORDER BY pos) AS cut FROM f),
             n AS (SELECT doc_id, string_agg(array_to_string(list_transform(names, lambda x: {_LINE_NAMES}[lower(x)]), ';'), ';' ORDER BY pos) AS found FROM c WHERE cut = 0 GROUP BY doc_id)
        SELECT d.doc_id, coalesce(found, '') AS found FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id"""
)
def line_alternation(t: Tables) -> DataFrame:
    """Names of terms, longest first, line by line in order with repeats, up to the first two lines in a row without any."""
    found = alternation.terms_until_gap(t.documents, "doc_id", "text", _LINE_TERMS, gap=2)
    return found.select("doc_id", F.array_join("found", ";").alias("found"))


@query(
    """SELECT l_orderkey AS o_orderkey, author, string_agg(n_name, '; ' ORDER BY n_name) AS affiliations
       FROM (SELECT DISTINCT l_orderkey, s_name AS author, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1, 2"""
)
def front_matter_styles(t: Tables) -> DataFrame:
    """Suppliers of orders as authors and their nations as affiliations, written in four styles of LaTeX and read by dispatch."""
    made = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.struct("s_name", "n_name").alias("made"))
    pairs = t.lineitem.select("l_orderkey", "l_suppkey").join(made, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "made")
    papers = pairs.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("made.s_name")).alias("names"), F.array_sort(F.collect_set("made.n_name")).alias("places"), F.collect_set("made").alias("of"))
    mark = lambda n: F.array_join(F.transform(F.filter("of", lambda o: o["s_name"] == n), lambda o: F.array_position("places", o["n_name"]).cast("string")), ",")
    joined = lambda column, form, by: F.array_join(F.transform(column, form), by)
    number = lambda i: (i + 1).cast("string")
    block = F.concat(F.lit("\\author{"), joined("names", lambda n: F.concat(n, F.lit("$^{"), mark(n), F.lit("}$")), ", "), F.lit("\\\\ "), joined("places", lambda p, i: F.concat(F.lit("$^{"), number(i), F.lit("}$"), p), "\\\\ "), F.lit("}"))
    noted = F.concat(joined("names", lambda n: F.concat(F.lit("\\author{"), n, F.lit("\\altaffilmark{"), mark(n), F.lit("}}")), "\n"), joined("places", lambda p, i: F.concat(F.lit("\\altaffiltext{"), number(i), F.lit("}{"), p, F.lit("}")), "\n"))
    labelled = F.concat(joined("names", lambda n: F.concat(F.lit("\\author["), mark(n), F.lit("]{"), n, F.lit("}")), "\n"), joined("places", lambda p, i: F.concat(F.lit("\\address["), number(i), F.lit("]{"), p, F.lit("}")), "\n"))
    mapped = F.concat(F.lit("\\author{"), joined("names", lambda n: F.concat(n, F.lit("\\inst{"), mark(n), F.lit("}")), " \\and "), F.lit("}\\institute{"), F.array_join("places", " \\and "), F.lit("}"))
    style = F.col("l_orderkey") % 4
    text = F.when(style == 0, block).when(style == 1, noted).when(style == 2, labelled).otherwise(mapped)
    found = strategies.tied_authors(papers.select(F.col("l_orderkey").alias("o_orderkey"), text.alias("text")), "o_orderkey", "text")
    return found.select("o_orderkey", "author", F.array_join(F.array_sort("affiliations"), "; ").alias("affiliations"))
