import pytest
from pyspark.sql import functions as F

from bibliora.operators import strategies
from bibliora.operators.front_matter import BY_MARKS, BY_ORDER, UNTIED

A, B, C = "Dept of A, Town", "University of B", "Institute C"
STYLES = [
    ("boxed", rf"\parbox{{\textwidth}}{{\Large Ann Lee$^{{1,2}}$, Bo Day$^{{2}}$}} \parbox{{\textwidth}}{{$^{{1}}${A}\\ $^{{2}}${B}}}", [("Ann Lee", [A, B]), ("Bo Day", [B])], BY_MARKS),
    ("block", rf"\author[Lee et al.]{{Ann Lee$^{{1}}$, Bo Day$^{{1,2}}$\\ $^{{1}}${A}\\ $^{{2}}${B}}}", [("Ann Lee", [A]), ("Bo Day", [A, B])], BY_MARKS),
    ("noted", rf"\author{{Ann Lee\altaffilmark{{1}} and Bo Day\altaffilmark{{2,9}}}} \altaffiltext{{1}}{{{A}}} \altaffiltext{{2}}{{{B}}}", [("Ann Lee", [A]), ("Bo Day", [B])], BY_MARKS),
    ("labelled", rf"\author[x]{{Ann Lee}} \author[x,y]{{Bo Day}} \address[x]{{{A}}} \address[y]{{{B}}}", [("Ann Lee", [A]), ("Bo Day", [A, B])], BY_MARKS),
    ("mapped", rf"\author{{Ann Lee\inst{{1}} \and Bo Day\inst{{2}}}} \institute{{{A} \and {B}}}", [("Ann Lee", [A]), ("Bo Day", [B])], BY_MARKS),
    ("mapped", rf"\author{{Ann Lee\aff{{1}}, Bo Day\aff{{2}}}} \affiliation{{\aff{{1}}{A} \aff{{2}}{B}}}", [("Ann Lee", [A]), ("Bo Day", [B])], BY_MARKS),
    ("mapped", rf"\author{{Ann Lee}} \author{{Bo Day}} \affiliation{{{C}}}", [("Ann Lee", [C]), ("Bo Day", [C])], BY_ORDER),
    ("mapped", rf"\author{{Ann Lee}} \affiliation{{{A}}} \author{{Bo Day}} \affiliation{{{B}}}", [("Ann Lee", [A]), ("Bo Day", [A])], BY_ORDER),
]


@pytest.mark.parametrize(("name", "text", "authors", "sure"), STYLES)
def test_each_style_by_the_order_of_styles(name, text, authors, sure):
    found = strategies.dispatch("% \\author{Nobody}\n" + text)
    assert (found.strategy, found.authors, found.confidence) == (name, authors, sure) and found.coverage == 1


def test_evidence():
    found = strategies.dispatch(STYLES[2][1])
    assert found.marks == 3 and found.led == 2 and found.resolved == pytest.approx(2 / 3)
    assert [h.strategy for h in strategies.hypotheses(STYLES[3][1]) if h.tied] == ["labelled"]
    lost = strategies.dispatch(r"\author[q]{Ann Lee} \address[x]{Here}")
    assert (lost.strategy, lost.coverage, lost.confidence) == ("labelled", 0, UNTIED)
    for text in (None, "", "no commands", r"\author{", r"\institute{only}"):
        found = strategies.dispatch(text)
        assert (found.authors, found.confidence, found.coverage) == ([], 0, 0)


def test_three_strategies_keep_unresolved_slots():
    aa = rf"\author{{Ann Lee\inst{{1,3}} \and Bo Day\inst{{2}}}} \institute{{{A}\label{{inst1}} \and {B}\label{{inst2}}}}"
    found = strategies.dispatch(aa, strategies.BY_SOURCE)
    assert (found.strategy, found.authors) == ("numbered", [("Ann Lee", [A, "Unresolved Inst(3)"]), ("Bo Day", [B])])
    revtex = rf"\author{{Ann Lee}} \affiliation{{{A}}} \affiliation{{{B}}} \author{{Bo Day}} \affiliation{{{C}}}"
    assert strategies.dispatch(revtex, strategies.BY_SOURCE).authors == [("Ann Lee", [A, B]), ("Bo Day", [C])]
    mnras = rf"\author[x]{{Ann Lee$^{{1}}$, Bo Day$^{{1,4}}$\\ $^{{1}}${A} $^{{2}}${B}}}"
    found = strategies.dispatch(mnras, strategies.BY_SOURCE)
    assert (found.strategy, found.authors) == ("numbered block", [("Ann Lee", [A]), ("Bo Day", [A, "Unresolved Affil(4)"])])


def test_column(spark):
    rows = spark.createDataFrame([(k, s[1]) for k, s in enumerate(STYLES)] + [(99, None)], "k int, t string")
    found = {r.k: r.f for r in rows.select("k", strategies.dispatched(F.col("t")).alias("f")).collect()}
    for k, (name, _, authors, sure) in enumerate(STYLES):
        assert found[k].strategy == name and [(a.author, list(a.affiliations)) for a in found[k].authors] == authors
        assert found[k].confidence == sure and found[k].needs_review == (sure < 0.8)
    assert found[99].strategy == "none" and found[99].authors == []


def test_rows_of_tied_authors_equal_the_column(spark):
    rows = spark.createDataFrame([(k, s[1]) for k, s in enumerate(STYLES)] + [(99, None), (100, "")], "k long, t string").repartition(3)
    expected = {(r.k, a.author, tuple(a.affiliations)) for r in rows.select("k", strategies.dispatched(F.col("t")).alias("f")).collect() for a in r.f.authors}
    found = [(r.k, r.author, tuple(r.affiliations)) for r in strategies.tied_authors(rows, "k", "t").collect()]
    assert set(found) == expected and len(found) == len(expected) == 2 * len(STYLES)


def test_front_matter_styles_of_one_name_in_two_nations(spark, tmp_path):
    import duckdb

    from bibliora.plans import catalog

    tables = {
        "lineitem": ([(o, s) for o in range(8) for s in (0, 1, 2, o % 2)], "l_orderkey long, l_suppkey long"),
        "supplier": ([(0, "Lee", 0), (1, "Lee", 1), (2, "Day", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(0, "UNITED KINGDOM"), (1, "PERU")], "n_nationkey int, n_name string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = {tuple(r) for r in catalog.QUERIES["front_matter_styles"](spark, str(tmp_path)).collect()}
    assert found == set(con.execute(catalog.ORACLE_SQL["front_matter_styles"]).fetchall()) and len(found) == 16
