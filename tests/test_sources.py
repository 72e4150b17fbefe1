import datetime
import gzip
import io
import tarfile

from bibliora.sources import readers, sinks
from bibliora.streaming import increments
from bibliora.streaming.store import KeyedStore


def test_papers_csv(spark, tmp_path):
    header = "title,abstract,authors,figures,pages,tables,pdf_link,primary_subject,secondary_subjects,submitted_journal,published_journal,keywords,date"
    (tmp_path / "p.csv").write_text(f'{header}\n"A ""quoted"" title","two\nlines","[\'A B\', None]",3.0,,1.0,x,s,[],,ApJ,"[\'k\']",2025-01-06\nT,,,,,,,,,,,,bad\n')
    a, b = readers.papers(spark, str(tmp_path / "p.csv")).orderBy("title").collect()
    assert a.title == 'A "quoted" title' and a.authors == ["A B", None] and (a.figures, a.pages) == (3, None) and a.secondary_subjects == []
    assert a.date == datetime.date(2025, 1, 6) and b.date is None and b.authors is None and a.submitted_journal is None


def test_lines_and_sections(spark, tmp_path):
    (tmp_path / "l.txt").write_text("one\n\n# note\n two \n")
    assert [r.value for r in readers.line_list(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two"]
    rule = "-" * 80
    (tmp_path / "s.txt").write_text(f"head\n{rule}\nPAPER: First\n{rule}\nAFFILIATION SECTION:\n\\author{{A}}\n{rule}\nPAPER: Second\n{rule}\nERROR: none\n")
    found = {r.title: r.body for r in readers.section_file(spark, str(tmp_path / "s.txt")).collect()}
    assert found == {"First": "\\author{A}", "Second": "ERROR: none"}


def test_thesaurus(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"u1": {"http://x#prefLabel": [{"type": "literal", "value": "stars"}], "http://x#broader": [{"type": "uri", "value": "u0"}]}, "u2": {"http://x#altLabel": [{"type": "literal", "value": "suns"}, {"type": "literal", "value": "stars"}]}}')
    assert sorted(r.label for r in readers.thesaurus_labels(spark, str(tmp_path / "t.json")).collect()) == ["stars", "suns"]


def test_feed_and_manifest(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed><entry><id>http://x/abs/2501.01234v1</id><title>A\n  title</title><summary> s </summary><published>2025-01-06T00:00:00Z</published><author><name>A B</name></author><author><name>C</name></author><category term="astro"/></entry></feed>')
    r = readers.atom_feed(spark, str(tmp_path / "f.xml")).first()
    assert (r.id, r.title, r.abstract, r.authors, r.published, r.categories) == ("2501.01234", "A title", "s", ["A B", "C"], datetime.date(2025, 1, 6), ["astro"])
    (tmp_path / "m.xml").write_text("<m><file><filename>a.tar</filename><first_item>p1</first_item><last_item>p9</last_item></file></m>")
    assert tuple(readers.range_manifest(spark, str(tmp_path / "m.xml")).first()) == ("a.tar", "p1", "p9")


def test_listing_page(spark):
    html = '<dl><dt><a href="/abs/2501.00001">x</a></dt><dd><div class="list-title mathjax"><span>Title:</span> A  star</div><div class="list-authors"><a href="#">A B</a>, <a href="#">C</a></div><div class="list-comments"><span>Comments:</span> 5 pages</div></dd></dl>'
    r = readers.listing(spark.createDataFrame([(html,)], "html string"), "html").first()
    assert (r.id, r.title, r.authors, r.comments, r.journal_ref) == ("2501.00001", "A star", ["A B", "C"], "5 pages", None)


def test_source_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        for name, body in (("a.tex", b"short"), ("b.tex", b"the longer one"), ("c.png", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    (tmp_path / "1").write_bytes(buffer.getvalue())
    (tmp_path / "2").write_bytes(gzip.compress(b"single"))
    (tmp_path / "3").write_bytes(b"plain")
    assert sorted(r.latex for r in readers.latex_sources(spark, str(tmp_path / "*")).collect()) == ["plain", "single", "the longer one\nshort"]


def test_human_dates(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("Monday, 6 January 2025",), ("29 Feb 2024",), ("soon",)], "t string").select(readers.human_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [datetime.date(2025, 1, 6), datetime.date(2024, 2, 29), None]


def test_resume_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("A ", 1), ("b", 2)], "title string, n int")
    assert [r.n for r in sinks.without_finished(rows, spark.createDataFrame([("a",)], "title string")).collect()] == [2]
    sinks.write_csv(rows, str(tmp_path / "out"))
    assert sinks.not_yet_done(rows, spark.read.csv(str(tmp_path / "out"), header=True), "title").count() in (0, 1)
    report = spark.createDataFrame([(3, 1, 1, 4)], "papers int, full_papers int, partial_papers int, null_slots int")
    assert "Partially filled papers: 1" in sinks.coverage_text(report)


def test_stream_appends_each_key_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for k, ids in enumerate([[1, 2, 2], [2, 3]]):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long").parquet(str(source))
        stream.writeStream.foreachBatch(increments.append_new(spark, out, "id")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert k in (0, 1)
    assert sorted(r.id for r in KeyedStore(spark, out, ["id"]).read().collect()) == [1, 2, 3]
