import numpy as np
from pyspark.sql import functions as F

from bibliora.functions import parsing
from bibliora.operators import forecasts


def test_batch_answers(spark):
    good = '```json\n{"papers": [{"arxiv_id": "1", "authors": [{"name": "A \\\\o", "affiliations": ["U", "V"], "countries": null}], "first_author_countries": ["IT"]}, {"authors": []}]}\n```'
    broken = '{"papers": [{"arxiv_id": "2", "authors": [{"name": "B \\odot", "affiliations": []}]}]}'
    rows = spark.createDataFrame([(1, good), (2, broken), (3, "no json"), (4, None), (5, '{"papers": [')], "k int, t string")
    papers = rows.select("k", parsing.batch_papers(F.col("t")).alias("p"))
    found = {r.k: r.p for r in papers.collect()}
    assert [p.arxiv_id for p in found[1]] == ["1"] and found[1][0].authors[0].countries == []
    assert found[2][0].authors[0].name == "B \\odot" and found[3] == found[4] == found[5] == []
    flat = papers.select(F.explode("p").alias("p")).select(*parsing.paper_columns("p")).orderBy("arxiv_id").collect()
    assert flat[0].affiliations == '["U; V"]' and flat[0].first_author_country == "IT" and flat[1].first_author_country == ""


def test_titles_entities_and_codes(spark):
    rows = spark.createDataFrame([("Étude of $H_0$: a  Test!",), ("Plain A-B",), (None,)], "t string")
    assert [r[0] for r in rows.select(parsing.normal_title(F.col("t"))).collect()] == ["etude of a test", "plain a b", None]
    assert rows.select(parsing.unescaped(F.lit("a &amp; b &eacute;"))).first()[0] == "a & b é"
    assert rows.select(parsing.category_name(F.lit("astro-ph.CO"), {"CO": "Cosmology", "GA": "Galaxies"})).first()[0] == "Cosmology"


def test_rendered_authors(spark):
    page = (
        '<div class="ltx_authors"><span class="ltx_creator ltx_role_author"><span class="ltx_personname">A One<sup class="ltx_sup">1</sup></span></span>'
        '<span class="ltx_creator ltx_role_author"><span class="ltx_personname">B Two<sup>1,2</sup></span></span></div>'
        '<p class="ltx_p"><sup>1</sup>Univ X</p><p class="ltx_p"><sup>2</sup>Univ Y</p>'
    )
    rows = spark.createDataFrame([(page,), (None,)], "h string").select(parsing.rendered_authors(F.col("h")).alias("a")).collect()
    assert [(x.author, x.affiliations) for x in rows[0].a] == [("A One", ["Univ X"]), ("B Two", ["Univ X", "Univ Y"])] and rows[1].a == []


def test_author_lists(spark):
    rows = spark.createDataFrame([("lost; One, A: U; V;; Two, B: W\nThree, C:",), ("",)], "t string").select(parsing.authors_with_affiliations(F.col("t")).alias("a")).collect()
    assert [(x.author, x.affiliations) for x in rows[0].a] == [("One, A", ["U", "V"]), ("Two, B", ["W"]), ("Three, C", [])] and rows[1].a == []


def test_forecasts(spark):
    trend = [(s, k, float(b + 3 * k)) for s, b in (("a", 10), ("b", 50)) for k in range(12)]
    found = {(r.s, r.step): r.predicted for r in forecasts.forecast(spark.createDataFrame(trend, "s string, t int, v double"), "s", "t", "v").collect()}
    assert all(abs(found[s, n] - (b + 3 * (11 + n))) < 1.5 for s, b in (("a", 10), ("b", 50)) for n in (1, 2, 3))
    assert forecasts.arima_111(np.array([5.0, 5, 5, 5, 5]), 2).tolist() == [5, 5]
