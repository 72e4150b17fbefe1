"""Joins: lookups with a fallback, first match, range, fuzzy title and name matching, positional zips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals, matching, positions, spellings
from .registry import Tables, query


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query(
    """SELECT o.o_orderkey, coalesce(c.c_name, s.s_name, 'unknown') AS name FROM orders o
       LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000 LEFT JOIN supplier s ON o.o_custkey = s.s_suppkey"""
)
def left_join_coalesce(t: Tables) -> DataFrame:
    rich = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    suppliers = t.supplier.select(F.col("s_suppkey").alias("o_custkey"), "s_name")
    rows = t.orders.select("o_orderkey", "o_custkey").join(rich, "o_custkey", "left").join(suppliers, "o_custkey", "left")
    return rows.select("o_orderkey", F.coalesce("c_name", "s_name", F.lit("unknown")).alias("name"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner_join(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE lang END AS language FROM documents")
def dict_lookup(t: Tables) -> DataFrame:
    names = {"en": "English", "de": "German", "fr": "French"}
    return t.documents.select("doc_id", matching.mapped(F.col("lang"), names).alias("language"))


@query(
    """SELECT c.c_custkey, o.o_orderkey AS first_order FROM customer c LEFT JOIN
       (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o ON c.c_custkey = o.o_custkey AND o.r = 1"""
)
def first_match_join(t: Tables) -> DataFrame:
    """The first match by an explicit order: a minimum, so a partial aggregate and no window."""
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"))
    return t.customer.select("c_custkey").join(first, "c_custkey", "left")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_semi")


@query(
    """WITH l AS (SELECT o_custkey AS id, min(o_orderdate)::DATE AS listed FROM orders GROUP BY 1)
       SELECT c_custkey, CASE WHEN l.id IS NULL THEN 'missing' WHEN month(l.listed) <> 1 THEN 'moved' ELSE 'kept' END AS status,
              date_trunc('month', l.listed)::DATE::VARCHAR AS month FROM customer LEFT JOIN l ON c_custkey = l.id"""
)
def reconcile(t: Tables) -> DataFrame:
    """Stored ids against the listing: kept, moved to the listing's month, or missing."""
    listing = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("listed"))
    status = F.when(F.col("listed").isNull(), "missing").when(F.month("listed") != 1, "moved").otherwise("kept")
    return t.customer.select("c_custkey").join(listing, "c_custkey", "left").select("c_custkey", status.alias("status"), F.trunc("listed", "month").cast("string").alias("month"))


@query(
    """WITH a AS (SELECT o_custkey AS id, min(o_orderdate) AS d FROM orders GROUP BY 1), b AS (SELECT o_custkey AS id, max(o_orderdate) AS d FROM orders GROUP BY 1)
       SELECT a.id, strftime(a.d, '%Y-%m') AS before, strftime(b.d, '%Y-%m') AS after FROM a JOIN b ON a.id = b.id WHERE strftime(a.d, '%Y-%m') <> strftime(b.d, '%Y-%m')"""
)
def snapshot_diff(t: Tables) -> DataFrame:
    old = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("before"))
    new = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("after"))
    return old.join(new, "id").filter("before <> after")


@query(
    """WITH c AS (SELECT 'tar' || lpad(n_nationkey::VARCHAR, 2, '0') AS tar, n_nationkey * 500 AS lo, n_nationkey * 500 + 600 AS hi FROM nation)
       SELECT o_orderkey, min(tar) AS tar FROM orders JOIN c ON o_orderkey BETWEEN lo AND hi GROUP BY o_orderkey"""
)
def range_join(t: Tables) -> DataFrame:
    """Ids in chunks that may overlap; the first chunk wins. Chunks and ids meet by bucket of the range."""
    chunks = t.nation.select(F.concat(F.lit("tar"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("tar"), (F.col("n_nationkey") * 500).cast("long").alias("lo"), (F.col("n_nationkey") * 500 + 600).cast("long").alias("hi"))
    hits = matching.range_matches(t.orders.select("o_orderkey"), "o_orderkey", chunks, "lo", "hi", width=1000)
    return hits.groupBy("o_orderkey").agg(F.min("tar").alias("tar"))


_IDS = "SELECT strftime(o_orderdate, '%y%m') || '.' || lpad(o_orderkey::VARCHAR, 8, '0') AS id, o_custkey FROM orders"


@query(
    f"""WITH i AS ({_IDS}), c AS (SELECT o_custkey AS chunk, min(id) AS lo, max(id) AS hi FROM i GROUP BY o_custkey)
        SELECT id, min(chunk) AS chunk FROM i JOIN c ON id BETWEEN lo AND hi GROUP BY id"""
)
def string_range_join(t: Tables) -> DataFrame:
    """Ids that are strings, such as 9501.00012345, with the first of the chunks, which are long and overlap, that hold them."""
    ids = t.orders.select(F.concat(F.date_format("o_orderdate", "yyMM"), F.lit("."), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("id"), "o_custkey")
    chunks = ids.groupBy(F.col("o_custkey").alias("chunk")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return intervals.first_intervals(ids, "id", chunks, "lo", "hi", "chunk")



@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS place FROM documents),
             m AS (SELECT doc_id, place, word FROM w WHERE regexp_matches(word, '^[A-Z]')), o AS (SELECT doc_id, place, word AS near FROM w WHERE regexp_matches(word, '(tion|mente|lich|ment)$')),
             p AS (SELECT m.*, b.place AS b_at, b.near AS b FROM m ASOF LEFT JOIN o b ON m.doc_id = b.doc_id AND m.place >= b.place),
             q AS (SELECT p.*, a.place AS a_at, a.near AS a FROM p ASOF LEFT JOIN o a ON p.doc_id = a.doc_id AND p.place <= a.place),
             d AS (SELECT *, CASE WHEN place - b_at <= 25 THEN place - b_at END AS l, CASE WHEN a_at - place <= 25 THEN a_at - place END AS r FROM q)
        SELECT doc_id, place::INTEGER AS place, word, CASE WHEN l IS NOT NULL AND l <= coalesce(r, l) THEN b WHEN r IS NOT NULL THEN a END AS near, least(l, r)::INTEGER AS distance FROM d"""
)
def nearest_words(t: Tables) -> DataFrame:
    """Capitalised words with the nearest word of some endings, at most 25 words away; the earlier of two as near."""
    words = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("place", "word")).withColumn("place", F.col("place") + 1)
    others = words.filter(F.col("word").rlike("(tion|mente|lich|ment)$")).select("doc_id", "place", F.col("word").alias("near"))
    return positions.nearest(words.filter(F.col("word").rlike("^[A-Z]")), others, "doc_id", "place", "near", 25)

_TITLE = r"list_filter(list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')), lambda x: x NOT IN ('the', 'a', 'an', 'of', 'in', 'on', 'for', 'and', 'with', 'from', 'to', 'by', 'its', 'their', 'using', 'study', 'new', 'based'))"


@query(
    f"""WITH q AS (SELECT item_id, {_TITLE.format("text")} AS w FROM benchmark),
             p AS (SELECT p_partkey, {_TITLE.format("p_name")} AS w FROM part)
        , b AS (SELECT item_id, {_TITLE.format("text")} AS w FROM benchmark),
        m AS (SELECT q.item_id, b.item_id AS match_id, len(list_intersect(q.w, b.w)) AS overlap, row_number() OVER (PARTITION BY q.item_id ORDER BY b.item_id) AS r
              FROM q JOIN b ON len(q.w) > 0 AND len(list_intersect(q.w, b.w)) >= least(3, len(q.w)))
        SELECT item_id, match_id, overlap::BIGINT AS overlap FROM m WHERE r = 1"""
)
def fuzzy_title_join(t: Tables) -> DataFrame:
    """Titles that share at least min(3, n) words with a candidate; of several candidates the first in order."""
    queries = t.benchmark.select("item_id", matching.title_words(F.col("text")).alias("words"))
    candidates = t.benchmark.select(F.col("item_id").alias("match_id"), matching.title_words(F.col("text")).alias("words"))
    return matching.fuzzy_title_matches(queries, "item_id", candidates, "match_id").select("item_id", "match_id", "overlap")


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '^(dr\.?|prof\.?|mr\.?|ms\.?|mrs\.?)\s+', ''), '\s+(jr\.?|sr\.?|iii|ii|iv)$', ''), '[.,;:\-''\"`]', ' ', 'g'), '\s+', ' ', 'g'))"


_ALL_NAMES = """(SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Dr. Ann B. ' WHEN 1 THEN 'A ' WHEN 2 THEN 'Bob ' ELSE '' END || n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_CLASSES = f"""n AS (SELECT id, string_split({_NORM}, ' ') AS parts FROM {_ALL_NAMES} WHERE {_NORM} <> ''),
             k AS (SELECT id, parts[-1] AS surname, list_sort(list_distinct(list_transform(parts[1:len(parts) - 1], lambda x: x[1]))) AS initials FROM n)"""


def _people(t: Tables) -> DataFrame:
    """All customers, named after their nations."""
    prefix = F.when(F.col("c_custkey") % 4 == 0, "Dr. Ann B. ").when(F.col("c_custkey") % 4 == 1, "A ").when(F.col("c_custkey") % 4 == 2, "Bob ").otherwise("")
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat(prefix, "n_name").alias("name"))


@query(f"""WITH {_CLASSES} SELECT id, surname, array_to_string(initials, ' ') AS initials FROM k""")
def name_match_members(t: Tables) -> DataFrame:
    """The name class of every customer: those of one class match each other, and those of classes that
    ``name_match_links`` joins."""
    return matching.name_classes(_people(t), "name").select("id", "surname", F.array_join("initials", " ").alias("initials"))


@query(
    f"""WITH {_CLASSES}, c AS (SELECT surname, initials, count(*) AS n, min(id) AS class_id FROM k GROUP BY ALL),
             l AS (SELECT a.surname, a.initials, a.class_id, sum(b.n)::BIGINT - 1 AS links FROM c a JOIN c b ON a.surname = b.surname
                   AND (a.initials = b.initials OR len(a.initials) = 0 OR len(b.initials) = 0 OR len(list_intersect(a.initials, b.initials)) > 0) GROUP BY ALL)
        SELECT id, class_id, links FROM k JOIN l ON k.surname = l.surname AND k.initials = l.initials"""
)
def name_match_join(t: Tables) -> DataFrame:
    """Same surname and no given name on one side, or an initial in common: every customer's class of equal names, by its
    smallest id, and how many other customers match."""
    return matching.name_match_counts(matching.name_classes(_people(t), "name"), "id").select("id", "class_id", "links")


@query(
    f"""WITH {_CLASSES}, c AS (SELECT DISTINCT surname, initials FROM k)
        SELECT a.surname, array_to_string(a.initials, ' ') AS left_initials, array_to_string(b.initials, ' ') AS right_initials FROM c a JOIN c b ON a.surname = b.surname AND a.initials < b.initials
        AND (len(a.initials) = 0 OR len(b.initials) = 0 OR len(list_intersect(a.initials, b.initials)) > 0)"""
)
def name_match_links(t: Tables) -> DataFrame:
    """Name classes of all customers that match each other; with ``name_match_members`` all matches, not one row each."""
    links = matching.name_class_links(matching.name_classes(_people(t), "name"))
    return links.select("surname", F.array_join("left_initials", " ").alias("left_initials"), F.array_join("right_initials", " ").alias("right_initials"))


@query(
    """WITH w AS (SELECT DISTINCT n_name AS name FROM nation), r AS (SELECT r_name FROM region)
       SELECT n.name AS a, m.name AS b FROM w n JOIN w m ON n.name <> m.name AND (contains(n.name, m.name) OR contains(m.name, n.name))"""
)
def substring_join(t: Tables) -> DataFrame:
    """Names of two small dimensions of which one contains the other."""
    names = t.nation.select("n_name").distinct()
    return matching.containing_pairs(names.select(F.col("n_name").alias("a")), names.select(F.col("n_name").alias("b")), "a", "b").filter("a <> b")


@query(
    """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(length(text) ORDER BY turn) AS sizes FROM conversations GROUP BY conv_id)
       SELECT conv_id, i::INTEGER AS slot, roles[i] AS role, sizes[i] AS size FROM c, unnest(range(1, least(len(roles), len(sizes)) + 1)) u(i)"""
)
def zip_arrays(t: Tables) -> DataFrame:
    """Parallel lists paired by position, up to the shorter one."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("size"))))
    lists = t.conversations.groupBy("conv_id").agg(ordered.alias("o")).select("conv_id", F.transform("o", lambda x: x["role"]).alias("roles"), F.transform("o", lambda x: x["size"]).alias("sizes"))
    pairs = lists.select("conv_id", F.posexplode(matching.zipped("roles", "sizes")).alias("slot", "pair"))
    return pairs.select("conv_id", (F.col("slot") + 1).alias("slot"), F.col("pair.a").alias("role"), F.col("pair.b").alias("size"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a, list_reverse(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS b FROM documents),
            h AS (SELECT doc_id, list_transform(a, lambda x: CASE WHEN length(x) >= 4 THEN x END) AS a, b FROM w)
       SELECT doc_id, array_to_string(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: coalesce(a[i], b[i])), ' ') AS filled FROM h"""
)
def zip_fill(t: Tables) -> DataFrame:
    """Holes of a list filled from a second one at the same position, up to the shorter."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = t.documents.select("doc_id", F.transform(words, lambda x: F.when(F.length(x) >= 4, x)).alias("a"), F.reverse(words).alias("b"))
    return rows.select("doc_id", F.array_join(matching.filled("a", "b"), " ").alias("filled"))


_CITATIONS = """WITH p AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS authors FROM lineitem GROUP BY 1), e AS (SELECT id AS cited, 2 * id AS citing FROM p UNION SELECT id, id + 1 FROM p)
        SELECT e.cited, count(*) AS total, count(*) FILTER (len(list_intersect(c.authors, g.authors)) = 0) AS non_self
        FROM e JOIN p c ON e.cited = c.id JOIN p g ON e.citing = g.id GROUP BY e.cited"""


@query(_CITATIONS)
def self_citation(t: Tables) -> DataFrame:
    """Citations of each paper, and those from works without a common author."""
    papers = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("authors"))
    wanted = papers.select(F.col("id").alias("cited"), F.explode(F.array_distinct(F.array(2 * F.col("id"), F.col("id") + 1))).alias("citing"))
    return matching.citation_counts(wanted, papers)


@query(_CITATIONS)
def self_citation_all(t: Tables) -> DataFrame:
    """The same as ``self_citation``, under the name that it had when that read a part of the table."""
    return self_citation(t)


@query(
    """WITH p AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b, count(*) AS n FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
                  WHERE c.c_nationkey < s.s_nationkey GROUP BY 1, 2)
       SELECT x.n_name AS a, y.n_name AS b, n, round(least(1 + ln(1 + n), 10), 6) AS weight FROM p JOIN nation x ON p.a = x.n_nationkey JOIN nation y ON p.b = y.n_nationkey WHERE n >= 5"""
)
def pair_coords(t: Tables) -> DataFrame:
    """Country pairs from a threshold on, with the dimension's attributes for both ends."""
    rows = (
        t.lineitem.select("l_orderkey", "l_suppkey")
        .join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        .join(t.customer.select("c_custkey", F.col("c_nationkey").alias("ka")), "c_custkey")
        .join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("kb")), "l_suppkey")
    )
    pairs = rows.filter("ka < kb").groupBy("ka", "kb").agg(F.count("*").alias("n")).filter("n >= 5")
    ends = [t.nation.select(F.col("n_nationkey").alias(f"k{x}"), F.col("n_name").alias(x)) for x in "ab"]
    return pairs.join(ends[0], "ka").join(ends[1], "kb").select("a", "b", "n", F.round(F.least(1 + F.log1p("n"), F.lit(10.0)), 6).alias("weight"))


@query(
    """WITH s AS (SELECT conv_id, turn, role, CASE WHEN length(text) >= 60 THEN text END AS aff FROM conversations),
            k AS (SELECT role, min(text) AS known FROM conversations WHERE trim(text) <> '' GROUP BY role)
       SELECT conv_id, string_agg(coalesce(aff, known, '?'), '|' ORDER BY turn) AS affs FROM s LEFT JOIN k USING (role) GROUP BY conv_id"""
)
def fill_slots(t: Tables) -> DataFrame:
    """Holes of a list filled by author from a lookup, and the list put together in its order."""
    rows = t.conversations.select("conv_id", "turn", "role", F.when(F.length("text") >= 60, F.col("text")).alias("aff"))
    lookup = t.conversations.filter(F.trim("text") != "").groupBy("role").agg(F.min("text").alias("known"))
    full = rows.join(lookup, "role", "left").withColumn("x", F.coalesce("aff", "known", F.lit("?")))
    return full.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda s: s["x"]), "|").alias("affs"))


@query(
    """SELECT o.o_orderkey, coalesce(i.n_name, u.r_name) AS found, CASE WHEN i.n_name IS NOT NULL THEN 'id' WHEN u.r_name IS NOT NULL THEN 'title' ELSE 'not_found' END AS status
       FROM orders o LEFT JOIN nation i ON o.o_orderkey = i.n_nationkey LEFT JOIN region u ON o.o_orderkey - 100 = u.r_regionkey"""
)
def enrich_fallback(t: Tables) -> DataFrame:
    """Lookup by id, then by a second key; the status tells which, and unfound values stay null."""
    by_id = t.nation.select(F.col("n_nationkey").cast("long").alias("o_orderkey"), "n_name")
    by_title = t.region.select((F.col("r_regionkey") + 100).cast("long").alias("o_orderkey"), "r_name")
    rows = t.orders.select("o_orderkey").join(by_id, "o_orderkey", "left").join(by_title, "o_orderkey", "left")
    status = F.when(F.col("n_name").isNotNull(), "id").when(F.col("r_name").isNotNull(), "title").otherwise("not_found")
    return rows.select("o_orderkey", F.coalesce("n_name", "r_name").alias("found"), status.alias("status"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_key(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate").withColumn("r", place).filter("r = 1").select("o_custkey", "o_orderkey")


@query(
    """WITH p AS (SELECT c_custkey, split_part(c_name, '#', 2) || ', ' || split_part(c_name, '#', 1) AS last_first FROM customer)
       SELECT p.c_custkey, c.c_custkey AS found FROM p JOIN customer c ON split_part(p.last_first, ', ', 2) || '#' || split_part(p.last_first, ', ', 1) = c.c_name"""
)
def name_key_join(t: Tables) -> DataFrame:
    """"Last, First" against "First Last": the candidate keys of a name are tried in order of priority."""
    people = t.customer.select("c_custkey", F.concat(F.split_part("c_name", F.lit("#"), F.lit(2)), F.lit(", "), F.split_part("c_name", F.lit("#"), F.lit(1))).alias("name"))
    known = t.customer.select(F.col("c_custkey").alias("found"), F.col("c_name").alias("key"))
    swapped = F.concat(F.split_part("name", F.lit(", "), F.lit(2)), F.lit("#"), F.split_part("name", F.lit(", "), F.lit(1)))
    return matching.by_candidate_keys(people, "c_custkey", F.array(F.col("name"), swapped), known, "key").select("c_custkey", "found")


@query(
    """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(length(text) ORDER BY turn) FILTER (turn % 2 = 0) AS sizes FROM conversations GROUP BY conv_id)
       SELECT conv_id, i::INTEGER AS slot, roles[i] AS role, coalesce(sizes[i], sizes[-1]) AS size FROM c, unnest(range(1, len(roles) + 1)) u(i)"""
)
def pad_last(t: Tables) -> DataFrame:
    """Parallel lists paired by position; the shorter one repeats its last item."""
    rows = t.conversations.select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))
    both = rows.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == 0, F.struct("turn", "size")))), lambda x: x["size"]).alias("sizes"),
    )
    pairs = both.select("conv_id", F.posexplode(matching.padded("roles", "sizes")).alias("slot", "pair"))
    return pairs.select("conv_id", (F.col("slot") + 1).alias("slot"), F.col("pair.a").alias("role"), F.col("pair.b").alias("size"))


@query()
def spelling_join(t: Tables) -> DataFrame:
    """The first two words of texts as names, "Second, First", with the names of other texts that have a spelling in common when
    these are written without marks. SQL cannot rewrite by weights; tests hold it against a search over every pair of names."""
    word = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    pairs = t.documents.select(word(r"^\P{L}*+(\p{L}+)").alias("first"), word(r"^\P{L}*+\p{L}++\P{L}++(\p{L}+)").alias("second")).dropna().distinct()
    plain = F.translate(F.concat_ws(" ", "first", "second"), "äöüéèêçñóíáàâîôûÄÖÜÉ", "aoueeecnoiaaaiouAOUE")
    names = pairs.select(F.concat_ws(", ", "second", "first").alias("name")).distinct()
    known = pairs.select(plain.alias("known")).distinct()
    return spellings.meetings(names, known).toDF("name", "known", "rank")
