import ast
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliora.functions import lists, numbers, text
from bibliora.operators import cleaning, counting, dictionaries, front_matter, inference, lines, matching, metrics, normalise
from bibliora.plans import catalog

LITERALS = [None, "", "[]", "['']", "['a', None]", r"['O\'B']", "[\"O'B\", 'x']", r"['caf\xe9']", "not a list", "[None]", "['a, b', \"c\"]", "{'a': 1}"]


def literal(value):
    try:
        found = ast.literal_eval(value or "")
    except (ValueError, SyntaxError):
        return None
    return found if isinstance(found, list) else None


@pytest.mark.parametrize("policy", ["null", "empty", "wrap"])
def test_list_literals(spark, policy):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(LITERALS)], "k int, v string")
    found = {r.k: r.x for r in rows.select("k", lists.parsed_list(F.col("v"), policy).alias("x")).collect()}
    for k, v in enumerate(LITERALS):
        other = None if v in (None, "") else {"null": None, "empty": [], "wrap": [v]}[policy]
        assert found[k] == (literal(v) if literal(v) is not None else other), v


def test_missing_and_holes(spark):
    values = [None, "", " ", "[]", "['']", "nan", "None", "x"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(cleaning.is_missing(F.col("v")).alias("m")).collect()
    assert [r.m for r in rows] == [True] * 7 + [False]
    slots = spark.createDataFrame([(None,), ([],), (["a"],), (["a", None],), ([" none "],)], "s array<string>")
    found = slots.select(cleaning.has_hole(F.col("s")), cleaning.is_full(F.col("s")), cleaning.holes(F.col("s"))).collect()
    assert [tuple(r) for r in found] == [(True, False, None), (False, True, 0), (False, True, 0), (True, False, 1), (True, False, 1)]


def test_names(spark):
    pairs = [("Dr. J. Smith", "John Smith", True), ("Smith", "J Smith", True), ("A Smith", "B Smith", False), ("J Smith Jr.", "J Smith", True), ("Ann Lee", "Ann Li", False)]
    for a, b, same in pairs:
        left, right = (spark.createDataFrame([(1, x)], f"{i} int, n string") for x, i in ((a, "i"), (b, "j")))
        assert matching.name_matches(left, right, "n").count() == int(same), (a, b)


def test_name_classes_hold_all_matches_of_a_hot_surname(spark):
    names = [f"{given}Lee" for given in ("", "Ann ", "Dr. A. B. ", "Bob ", "C ", "Ann C ")] * 30 + ["Ann Li", "Prof. Ann Li", "Mr. ", None]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    sides = [rows.withColumnRenamed("id", f"{side}_id") for side in ("left", "right")]
    pairs = {tuple(r) for r in matching.name_matches(*sides, "name").filter("left_id < right_id").collect()}
    classes = matching.name_classes(rows, "name")
    of = {r.id: (r.surname, tuple(r.initials)) for r in classes.collect()}
    links = matching.name_class_links(classes).collect()
    linked = {((r.surname, tuple(r.left_initials)), (r.surname, tuple(r.right_initials))) for r in links}
    assert len(links) == len(linked) < 20
    assert pairs == {(i, j) for i in of for j in of if i < j and (of[i] == of[j] or (of[i], of[j]) in linked or (of[j], of[i]) in linked)}


def test_whole_tables_are_matched_and_cited(spark, tmp_path):
    spark.range(1, 201).selectExpr("id AS c_custkey", "id % 2 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "X"), (1, "Y")], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1, 2001).selectExpr("id AS l_orderkey", "id % 3 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.id for r in catalog.QUERIES["name_match_members"](spark, str(tmp_path)).collect()} == set(range(1, 201))
    assert {tuple(r) for r in catalog.QUERIES["name_match_links"](spark, str(tmp_path)).collect()} == {("x", "a b", "b"), ("y", "", "a")}
    expected = {}
    for k in range(1, 2001):
        ends = {e for e in (2 * k, k + 1) if e <= 2000}
        if ends:
            expected[k] = (len(ends), sum(e % 3 != k % 3 for e in ends))
    assert {r.cited: (r.total, r.non_self) for r in catalog.QUERIES["self_citation_all"](spark, str(tmp_path)).collect()} == expected


def test_streams_over_a_folder_of_parts(spark, tmp_path):
    events = spark.range(40).selectExpr("id AS event_id", "id % 5 AS user_id", "timestamp_seconds(1704067200 + id * 7200) AS ts", "concat('t', id % 2) AS event_type")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    first = catalog.QUERIES["stream_first_of_each"](spark, str(tmp_path))
    assert first.inputFiles() and {tuple(r) for r in first.collect()} == {(k, k % 5) for k in range(40)} and first.count() == 40
    daily = catalog.QUERIES["stream_daily_counts"](spark, str(tmp_path)).collect()
    assert len(daily) == 8 and sum(r.n for r in daily) == 40
    spark.createDataFrame([], events.schema).write.parquet(f"{tmp_path}/none/events.parquet")
    assert catalog.QUERIES["stream_first_of_each"](spark, f"{tmp_path}/none").isEmpty()


def test_fuzzy_titles(spark):
    candidates = spark.createDataFrame([(1, "Dark matter in galaxies"), (2, "Dark energy survey results"), (3, "Dark matter haloes and galaxies")], "c int, t string")
    queries = spark.createDataFrame([(1, "Dark"), (2, "the of and"), (3, "galaxies and dark matter"), (4, "matter haloes")], "q int, t string")
    words = lambda d: d.withColumn("words", matching.title_words(F.col("t"))).drop("t")
    found = {r.q: (r.c, r.overlap) for r in matching.fuzzy_title_matches(words(queries), "q", words(candidates), "c").collect()}
    assert found == {1: (1, 1), 3: (1, 3), 4: (3, 2)}


def test_ranges_that_overlap(spark):
    chunks = spark.createDataFrame([("a", 10, 20), ("b", 20, 40), ("c", 100, 100)], "tar string, lo long, hi long")
    ids = spark.createDataFrame([(x,) for x in (9, 10, 15, 20, 40, 41, 100)], "id long")
    found = matching.range_matches(ids, "id", chunks, "lo", "hi", 7).groupBy("id").agg(F.min("tar").alias("tar")).collect()
    assert {r.id: r.tar for r in found} == {10: "a", 15: "a", 20: "a", 40: "b", 100: "c"}


def test_zips_stop_at_the_shorter_list(spark):
    row = spark.createDataFrame([(["a", None, "c"], ["x", "y"])], "a array<string>, b array<string>")
    assert [tuple(p) for p in row.select(matching.zipped("a", "b").alias("z")).first().z] == [("a", "x"), (None, "y")]
    assert row.select(matching.filled("a", "b").alias("z")).first().z == ["a", "y"]
    assert [p.b for p in row.select(matching.padded("a", "b").alias("z")).first().z] == ["x", "y", "y"]


def test_self_citations(spark):
    papers = spark.createDataFrame([(1, ["A", "B"]), (2, ["B"]), (3, ["C", None]), (4, [])], "id int, authors array<string>")
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3)], "cited int, citing int")
    assert {tuple(r) for r in matching.citation_counts(edges, papers).collect()} == {(1, 3, 2), (2, 1, 1)}


def test_dictionary_policies(spark):
    rows = spark.createDataFrame([(1, "a Dark Matter map of dark matter and AGN"), (2, "magnetic agn"), (3, "nothing"), (4, None)], "k int, t string")
    known = dictionaries.terms(spark, [("agn", "AGN", 0), ("dark matter", "DM", 1), ("dark", "D", 2)])
    label = lambda policy, **o: {r.k: r.x for r in dictionaries.labelled(rows, "k", ["t"], known, policy, "x", "-", **o).collect()}
    assert label("first") == {1: "AGN", 2: "AGN", 3: "-", 4: "-"}
    assert label("last") == {1: "D", 2: "AGN", 3: "-", 4: "-"}
    assert label("longest") == {1: "DM", 2: "AGN", 3: "-", 4: "-"}
    assert label("most_frequent") == {1: "DM", 2: "AGN", 3: "-", 4: "-"}
    assert label("first", case_sensitive=True) == {1: "DM", 2: "AGN", 3: "-", 4: "-"}
    assert dictionaries.matches(rows, ["t"], known, boundary=True).filter("term = 'agn'").agg(F.sum("hits")).first()[0] == 2
    with pytest.raises(ValueError, match="twice"):
        dictionaries.terms(spark, [("a", 0), ("A", 1)])


def test_countries(spark):
    known = ["United States", "Italy", "France", "Georgia", "China"]
    texts = {"Univ, Rome, Italy.": "Italy", "MIT, Boston, USA": "United States", "Georgia Tech, Atlanta, GA 30332": None, "Paris France": "France", "a trukish town": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.c for r in rows.select("t", normalise.country(F.col("t"), sorted(known, key=lambda n: (-len(n), n))).alias("c")).collect()} == texts


def test_cumulative_share_and_ties(spark):
    counts = spark.createDataFrame([("a", 50), ("b", 20), ("c", 20), ("d", 10)], "x string, n long")
    found = counting.covering_items(counts, "x", 90.0).orderBy("place").collect()
    assert [(r.x, r.place, r.share) for r in found] == [("a", 1, 50.0), ("b", 2, 70.0), ("c", 3, 90.0)]
    assert [r.x for r in counting.covering_items(counts, "x", 50.0).collect()] == ["a"]


def test_bins(spark):
    values = [0.0, 4.9, 5.0, 10.0, 10.1, -1.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = rows.select(numbers.histogram_bin(F.col("v"), 0, 10, 2), numbers.right_closed_bin(F.col("v"), 0, 10, 5)).collect()
    assert [tuple(r) for r in found] == [(0, None), (0, 1), (1, 1), (1, 2), (None, None), (None, None), (None, None)]
    same = inference.min_max_scaled(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v").collect()
    assert [r.scaled for r in same] == [0.5, 0.5]


def test_distributions(spark):
    same = spark.createDataFrame([(float(k % 5), k < 10) for k in range(20)], "v double, a boolean")
    apart = spark.createDataFrame([(float(k), k < 10) for k in range(20)], "v double, a boolean")
    assert inference.ks_distance(same, "v", F.col("a")).first().d == 0
    assert inference.ks_distance(apart, "v", F.col("a")).first().d == 1
    assert inference.ks_p_value(0.0, 10, 10) == 1.0 and inference.ks_p_value(1.0, 50, 50) < 1e-9
    assert abs(inference.chi2_p_value(3.841458820694124, 1) - 0.05) < 1e-9 and abs(inference.chi2_p_value(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(inference.correlation_p_value(0.632, 10) - 0.05) < 1e-3
    ranks = spark.createDataFrame([(1, 3), (2, 2), (2, 2), (4, 1)], "x int, y int")
    assert abs(inference.spearman(ranks, "x", "y").first().rho + 1) < 1e-12


def test_citation_means_without_journal_papers(spark):
    rows = spark.createDataFrame([("a", 4, None), ("a", None, 0), ("b", 2, 1)], "k string, c int, q int")
    found = {r.k: tuple(r)[1:] for r in metrics.citation_means(rows, "k", "c", None, F.col("q") == 1).collect()}
    assert found == {"a": (2, 4.0, 0, None), "b": (1, 2.0, 1, 2.0)}


def test_lines_until_a_gap(spark):
    body = "x\nhit\n\n\nhit\n" + "\n" * 5 + "hit"
    rows = lines.text_lines(spark.createDataFrame([(1, body)], "k int, t string"), "k", "t")
    assert [r.pos for r in lines.until_gap(rows, "k", "pos", F.col("line") == "hit", 3).orderBy("pos").collect()] == [2, 5]


def test_texts(spark):
    row = spark.createDataFrame([("z ~ 2.5, z3 and z>= 1", "agn in magnetic AGN")], "a string, b string")
    assert [tuple(r)[1:] for r in text.redshift_mentions(row, "b", "a").collect()] == [("~", 2.5), ("=", 3.0), (">=", 1.0)]
    assert row.select(text.rewritten(F.col("b"), {"agn": "X"}, False)).first()[0] == "X in mXetic AGN"
    assert row.select(text.rewritten(F.col("b"), {"agn": "X"}, True)).first()[0] == "X in magnetic AGN"


STYLES = [
    (r"\author{A. One}\author{B. Two}\affiliation{Inst X, Italy}\author{C. Three}\affiliation{Inst Y}", [("A. One", ["Inst X, Italy"]), ("B. Two", ["Inst X, Italy"]), ("C. Three", ["Inst Y"])], 0.75),
    (r"\author[1]{A. One}\author[1,2]{B. Two}\affil[1]{Univ X}\affil[2]{Univ Y \\ City}", [("A. One", ["Univ X"]), ("B. Two", ["Univ X", "Univ Y, City"])], 0.95),
    (r"\author{J.~Callow$^{\orcidlink{0000}}$,$^{1}$\thanks{x} and O.~Graur$^{1,2}$}\institute{Uni \and f{\"u}r Physik {\ss}\\ }", [("J. Callow", ["Uni"]), ("O. Graur", ["Uni", "für Physik ß"])], 0.95),
    (r"\author{A. One\altaffilmark{1,$\star$}, B. Two\altaffilmark{2}}\altaffiltext{1}{Inst A}\altaffiltext{2}{Inst B}", [("A. One", ["Inst A"]), ("B. Two", ["Inst B"])], 0.95),
    (r"\author{A One\inst{1} \and B Two\inst{2}}\institute{First, A \and Second, B}", [("A One", ["First, A"]), ("B Two", ["Second, B"])], 0.95),
    (r"\author[a]{A One}\address[a]{Place} % \address[b]{Hidden}", [("A One", ["Place"])], 0.95),
    (r"\author[A. One et al.]{A. One,$^{1}$\thanks{E-mail: a@b.c} B. Two$^{2}$ and C. Three$^{1,2}$\\ $^{1}$Institute X, City\\ $^{2}$University Y}", [("A. One", ["Institute X, City"]), ("B. Two", ["University Y"]), ("C. Three", ["Institute X, City", "University Y"])], 0.95),
    (r"\author{A. One$^{1}$\thanks{x}\newauthor B. Two$^{2}$\\$^{1}$Inst X\\$^{2}$Inst Y\\}", [("A. One", ["Inst X"]), ("B. Two", ["Inst Y"])], 0.95),
    (r"\author{\parbox{\textwidth}{A. One,$^{1}$ B. Two$^{1,2}$}\vspace{0.4cm}\\ \parbox{\textwidth}{$^{1}$University of X, City\\ $^{2}$Institute Y}}", [("A. One", ["University of X, City"]), ("B. Two", ["University of X, City", "Institute Y"])], 0.95),
    (r"\parbox{\textwidth}{A. One$^{1}$, B. Two$^{2}$} \parbox{\textwidth}{$^{1}$University of X\\ $^{2}$Institute Y}", [("A. One", ["University of X"]), ("B. Two", ["Institute Y"])], 0.95),
    (r"\author{A One, B Two}", [("A One", []), ("B Two", [])], 0.2),
    (r"\author{A One", [("A One", [])], 0.2),
]


@pytest.mark.parametrize("source,authors,sure", STYLES)
def test_front_matter_styles(source, authors, sure):
    assert front_matter.parse(source) == (authors, sure)


def test_front_matter_column_and_filling(spark):
    rows = spark.createDataFrame([(1, STYLES[1][0]), (2, None)], "k int, t string").select("k", front_matter.affiliations(F.col("t")).alias("f"))
    found = {r.k: r.f for r in rows.collect()}
    assert found[1].needs_review is False and found[2].needs_review is True and found[2].authors == []
    papers = spark.createDataFrame([(1, ["Ann One", "B. Two", "The X Collaboration", "Q Z"], [None, "Known", None, None]), (2, ["A", "B"], ["P", None])], "k int, authors array<string>, affiliations array<string>")
    parsed = spark.createDataFrame([(1, "A. One", ["U", "V"])], "k int, author string, affiliations array<string>")
    assert {r.k: r.affiliations for r in front_matter.fill_affiliations(papers, parsed, "k").collect()} == {1: ["U; V", "Known", "U; V", None], 2: ["P", "P"]}


@pytest.mark.parametrize("part", [1000, 50_000])
def test_a_dictionary_of_thousands_of_terms_equals_brute_force(spark, monkeypatch, part):
    rng = random.Random(5)
    monkeypatch.setattr(dictionaries, "PART_TERMS", part)
    names = sorted({" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 4))) for _ in range(3000)})
    texts = [(k, " ".join(rng.choice(["w", "W"]) + f"{rng.randrange(400)}" + rng.choice(["", ",", "_x"]) for _ in range(80))) for k in range(30)] + [(30, None), (31, "")]
    rows = spark.createDataFrame(texts, "k int, t string")
    found = dictionaries.matches(rows, ["t"], dictionaries.terms(spark, [(n, i) for i, n in enumerate(names)]))
    expected = {(k, n, len(hits)) for k, t in texts if t for n in names if (hits := re.findall(rf"(?<!\w){re.escape(n)}(?!\w)", t.lower()))}
    assert {(r.k, r.term, r.hits) for r in found.collect()} == expected
    assert len(expected) > 1000


def test_titles_meet_by_their_rarest_words(spark):
    rng = random.Random(6)
    titles = [(k, sorted({f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 9))})) for k in range(120)] + [(120, [])]
    rows = spark.createDataFrame(titles, "q int, words array<string>")
    found = matching.all_title_matches(rows, "q", rows.withColumnRenamed("q", "c"), "c")
    expected = {(a, b, len(set(x) & set(y))) for a, x in titles for b, y in titles if x and len(set(x) & set(y)) >= min(3, len(x))}
    assert {tuple(r) for r in found.collect()} == expected


def test_quantiles_without_one_task_for_all_values(spark):
    values = [3.0, 1.0, 1.0, 8.0, None, 2.5, 7.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    found = inference.quantiles(rows, "v", shares, "p").first().p
    assert found == pytest.approx(np.quantile([v for v in values if v is not None], shares).tolist())
    assert inference.quantiles(rows.limit(0), "v", [0.5], "p").first().p == [None]


def test_customers_with_matching_names_are_counted(spark):
    names = ["Ann B. Lee", "A. Lee", "Lee", "Bob Lee", "Lee", "C D Roe", "D. Roe", "E Roe", None, ""]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    found = {r.id: (r.class_id, r.links) for r in matching.name_match_counts(matching.name_classes(rows, "name"), "id").collect()}
    pairs = matching.name_matches(rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b"), "name").filter("a <> b").groupBy("a").count()
    links = {r.a: r["count"] for r in pairs.collect()}
    assert {k: n for k, (_, n) in found.items()} == {k: links.get(k, 0) for k in range(8)}
    assert found[4][0] == 2


def test_countries_families_and_surnames(spark):
    rows = spark.createDataFrame([("MIT, Cambridge, USA.; ESO, Garching , Germany;Univ. of Tokyo (Japan)", "The Astrophysical Journal"), ("Dukes Hall", "A&A 12"), ("Paris, France, Unit 3", "Nature"), (None, None), ("", "")], "a string, v string")
    found = rows.select(normalise.countries_of_parts(F.col("a")), normalise.country_of_parts(F.col("a")), normalise.venue_family(F.col("v"))).collect()
    assert [r[0] for r in found] == [["United States", "Germany", "Japan"], ["United Kingdom"], ["France"], [], []]
    assert [r[1] for r in found[1:]] == ["United Kingdom", "France", None, None]
    assert [r[2] for r in found] == ["ApJ", "A&A", None, None, None]
    people = [("John K. Nino", ["Doe, J", "Nino, John K.", "nino, A"], ["U", "V", "W"]), ("A. Lost", ["Doe, J"], ["U"]), ("A Lost", ["Doe, J", "Roe, K"], ["U", "V"]), ("Roe", ["Doe, J", "Roe, K"], ["U"]), ("J Doe", ["Doe, J"], ["-"]), (" . ", ["Doe, J"], ["U"]), (None, None, None)]
    table = spark.createDataFrame(people, "n string, a array<string>, f array<string>")
    assert [r[0] for r in table.select(normalise.affiliation_by_surname(F.col("n"), F.col("a"), F.col("f"))).collect()] == ["V", "U", None, None, None, None, None]
