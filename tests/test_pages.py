import datetime
import random

import pytest

from bibliora.operators.markup import PageReader, Step, extracted
from bibliora.sources import pages as page_sources

PAPER = """<html><body><div class="header"><a href="/x">site</a></div>
<div class="dateline">[Submitted on 6 Jan 2025 (v1), last revised 9 Feb 2025]</div>
<h1 class="title mathjax"><span class="descriptor">Title:</span> Cold &amp; warm
 disks</h1><div class="authors"><span class="descriptor">Authors:</span><a href="/a1">A. One</a>, <a href="/a2">B. Two</a></div>
<blockquote class="abstract mathjax"><span class="descriptor">Abstract:</span> We look <i>at</i> disks.<script>var x = "<h1>";</script></blockquote>
<table><tr><td class="tablecell label">Comments:</td><td class="tablecell comments mathjax">12 pages, 3 figures, 1 table. Submitted to A. Accepted to The Journal</td></tr>
<tr><td class="tablecell label">Journal-ref:<td class="tablecell jref">J. 5 (2025)
<tr><td class="tablecell label">Subjects:<td class="tablecell subjects"><span class="primary-subject">Disks (d.D)</span>; Gas (g.G); Dust (d.U)</table></body></html>"""


def row(spark, function, page, *more):
    return function(spark.createDataFrame([(7, page)], "id int, html string"), "html", *more).collect()


def test_paper_page(spark):
    (r,) = row(spark, page_sources.paper_page, PAPER)
    assert (r.id, r.title, r.abstract, r.authors) == (7, "Cold & warm disks", "We look at disks.", ["A. One", "B. Two"])
    assert (r.figures, r.pages, r.tables, r.published_journal, r.submitted_journal) == (3, 12, 1, "J. 5 (2025)", "The Journal")
    assert (r.primary_subject, r.secondary_subjects, r.date) == ("Disks (d.D)", ["Gas (g.G)", "Dust (d.U)"], datetime.date(2025, 1, 6))
    for page in (None, "", "<p>other <b>page"):
        (r,) = row(spark, page_sources.paper_page, page)
        assert (r.title, r.abstract, r.authors, r.comments, r.pages, r.primary_subject, r.secondary_subjects, r.date) == (None, None, [], None, None, None, None, None)


@pytest.mark.parametrize(
    ("page", "comments", "journal"),
    [
        ('<table><tr><td class="tablecell label">Comments:</td><td>x</td><td class="tablecell arx-comment">4 pages</td></tr></table>', "4 pages", None),
        ('<table><tr><td class="tablecell label"> Comments: </td><td class="other">5 pages</td><td>no</td></tr></table>', "5 pages", None),
        ('<div class="c"><span class="descriptor">Comments:</span> 6 <i>pages</i></div><div><span class="descriptor">Journal-ref:</span> J 1</div>', "6 pages", "J 1"),
        ('<td class="tablecell label">Comments: more</td><td>no</td><span class="descriptor">Comment</span>', None, None),
        ('<tr><td class="label tablecell">Journal-ref:<td class="jref tablecell">J 2<tr><td>next', None, "J 2"),
    ],
)
def test_comments_and_journal_by_three_ways(spark, page, comments, journal):
    (r,) = row(spark, page_sources.comments_and_journal, page)
    assert (r.id, r.comments, r.journals) == (7, comments, journal)


def test_month_listing_with_its_cut(spark):
    def entry(n, link=True, title=True):
        name = f'<div class="list-title mathjax"><span class="descriptor">Title:</span> Paper {n}</div>' if title else ""
        return f"<dt><a name='{n}'>[{n}]</a>" + (f'<a href="/abs/{n}" title="Abstract">arXiv:2501.{n:05d}</a>' if link else "") + f"</dt><dd><div>{name}</div></dd>"

    months = {"2025-01": [entry(1), entry(2, link=False), entry(3, title=False), entry(4)], "2025-02": [entry(5).replace("</dt>", "").replace("</dd>", ""), entry(6), entry(7)], "2025-03": [entry(8)], "2025-04": []}
    pages = spark.createDataFrame([(m, "<dl>" + "".join(e) + "</dl>") for m, e in months.items()], "month string, html string")
    targets = spark.createDataFrame([("2025-01", 3), ("2025-02", 2), ("2025-04", 9)], "month string, target int")
    rows = page_sources.month_listing(pages, "html", "month", targets).orderBy("month", "position").collect()
    assert [tuple(r) for r in rows] == [("2025-01", 1, "2501.00001", "Paper 1"), ("2025-01", 3, "2501.00003", "Unknown Title"), ("2025-02", 1, "2501.00005", "Paper 5"), ("2025-02", 2, "2501.00006", "Paper 6")]


def test_front_keywords(spark):
    texts = ["Abstract. Keywords: stars; gas,\n dust; stars. More", "Key words: disks, 1. Introduction We begin", "Subject headings x, y 1 Introduction; z. Keyword: z", "nothing", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(page_sources.front_keywords("t").alias("k")).collect()
    assert [r.k for r in rows] == [["stars"], ["disks", "1"], ["x", "y"], [], None]


def read(page, *paths, records=None, attribute="href"):
    return PageReader(paths, attribute, records).read(page)


def test_relations_and_malformed_markup():
    page = "<ul><li>a<li>b <b>c<li class='x y'>d</ul></b></p><p>e<p>f</div><br/><img href=q>g <td>h"
    assert [h[2] for h in read(page, (Step("li"),))] == ["a", "b c", "d"]
    assert [h[2] for h in read(page, (Step("p"),))] == ["e", "fg h"]
    assert [h[2] for h in read(page, (Step("li", ("y",)),), (Step("li", ("z",)),))] == ["d"]
    assert [h[3] for h in read(page, (Step("p"), Step("img", relation="child")))] == ["q"]
    assert [h[2] for h in read("<a><b>1</b><c>2</c><b>3</b><b>4</b></a>", (Step("b", text="1"), Step("b", relation="sibling")))] == ["3"]
    assert [h[2] for h in read("<a><b>1</b> x</a><a>y</a>", (Step("b", text="1"), Step("a", relation="parent"), Step("a", relation="sibling")))] == ["y"]
    assert read("<div><div><p>1</p></div></div>", (Step("div"), Step("div"), Step("p"))) == [(0, 0, "1", None)]
    assert [h[2] for h in read("<x><y><z>1</z></y><z>2</z></x>", (Step("x"), Step("z", relation="child")))] == ["2"]
    with pytest.raises(ValueError, match="whole text"):
        read("", (Step("b", text="1"), Step("i")))


def test_records_and_chains_over_batches(spark):
    rows = [(k, f"<i>{k}</i>" + "".join(f"<li><b>n{j}</b><u href='/{j}'>v</u></li>" for j in range(k % 4))) for k in range(300)] + [(300, None)]
    pages = spark.createDataFrame(rows, "id int, html string").repartition(3)
    found = extracted(pages, "html", {"name": [(Step("s"),), (Step("b"),)], "v": [(Step("u"),)]}, records=(Step("li"),)).collect()
    assert {(r.id, r.record, r.name[0].text, r.v[0].value) for r in found} == {(k, j, f"n{j}", f"/{j}") for k in range(300) for j in range(k % 4)}
    assert len(found) == sum(k % 4 for k in range(300))


def test_any_markup_is_read_to_its_end():
    rng = random.Random(3)
    parts = ["<", ">", "</", "<b>", "</b>", "<p", "<li>", "&amp", "&#x4", "<!--", "-->", "<script>", "</script>", "a", " ", "\"", "'", "=", "<td class=x>", "<?", "<![CDATA[", "\x00", "<a href='"]
    paths = [(Step("b"),), (Step("li"), Step("b")), (Step("td", ("x",)), Step("td", relation="sibling")), (Step("b", text="a"), Step(relation="parent"))]
    reader = PageReader(paths, "href", (Step("p"),))
    for _ in range(4000):
        for hit in reader.read("".join(rng.choice(parts) for _ in range(rng.randrange(40)))):
            assert 0 <= hit[0] < len(paths) and hit[1] >= -1


def test_references_that_are_cut_off_stay_as_written(spark):
    page = '<h1>a &lt;b&gt; &amp;amp; c&#39;s &notit; x&#38 y & z&amp</h1><a href="?a=1&amp;b=2&copy=3">&lt</a>'
    fields = {"h": [(Step("h1"),)], "a": [(Step("a"),)]}
    (r,) = row(spark, extracted, page, fields, "href", None, True)
    assert r.h[0].text == "a <b> &amp; c's &notit; x&#38 y & z&amp" and (r.a[0].text, r.a[0].value) == ("&lt", "?a=1&b=2&copy=3")
    (r,) = row(spark, extracted, page, fields)
    assert r.h[0].text == "a <b> &amp; c's \u00acit; x& y & z&" and r.a[0].text == "<"


def test_page_structure_of_a_title_cut_within_a_reference(spark, tmp_path):
    import duckdb

    from bibliora.plans import catalog

    page = "<html><body><nav><ul><li><a href=\"/x\">x&amp</a></li></ul></nav><article><h1>one&amp;&amp;&amp</h1><p>two &lt;i&gt;&lt</article></body></html>"
    spark.createDataFrame([(1, page), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {tuple(r) for r in catalog.QUERIES["page_structure"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert found == set(con.execute(catalog.ORACLE_SQL["page_structure"]).fetchall()) and (1, "one&&&amp", 1, "two <i>&lt", "", 1, "/x") in found
