import hashlib
from pathlib import Path

import pytest

from bibliora.llm import warc, workspace

LARGE = "<p>" + "ä" * 600 + "</p>"
PAGES = [
    (1, "http://b.example.com/x?q=1#top", LARGE, "extra"),
    (2, "https://www.example.com/A", "small", "extra"),
    (3, None, None, "extra"),
    (4, "http://b.example.com/x?q=1", LARGE, "extra"),
    (5, "http://a.example.org", "small", "extra"),
    (6, "not a [url", "", "extra"),
    (7, "http://b.example.com/x?q=1", "y" * 200_000, "extra"),
    (8, "http://c.example.com/", LARGE, "extra"),
    (None, "http://d.example.com/", LARGE, "extra"),
]


@pytest.fixture(scope="module")
def archive(spark):
    folder = workspace.fresh_path(spark, "warc")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3)
    runs = workspace.saved(warc.write_archives(pages, folder), "runs")
    return folder, workspace.saved(warc.merged_index(runs, 3), "index")


def test_records_come_back(spark, archive):
    folder, index = archive
    found = {r.page_id: tuple(r) for r in warc.read_archives(spark, folder, index).collect()}
    for page, _, html, _ in PAGES:
        body = (html or "").encode()
        to = 8 if html == LARGE and page != 8 else None
        assert found[page] == (page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if to else "response", to)


def test_files_are_whole_archives(archive):
    folder, _ = archive
    files = sorted(Path(folder.removeprefix("file://")).iterdir())
    assert files and all(f.name.endswith(".warc.gz") for f in files)
    records = [r for f in files for r in warc.read_whole_file(f.read_bytes())]
    assert sorted(r["page_id"] or 0 for r in records) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_index_is_in_global_order(archive):
    _, index = archive
    rows = index.orderBy("part", "place").collect()
    keys = [(r.url_key.encode(), r.timestamp) for r in rows]
    assert keys == sorted(keys) and len(keys) == len(PAGES)
    history = {r.url_key: r.captures for r in warc.capture_histories(index).collect()}
    assert history["com,example,b)/x?q=1"] == 3


@pytest.mark.parametrize("fan_in", [2, 512])
def test_runs_are_merged_from_their_files(spark, fan_in):
    pages = [(None if k % 50 == 7 else k % 90, f"http://h{k % 3 if k % 4 else 0}.org/\0{k % 5}" if k % 11 else None, f"text {k}") for k in range(200)]
    folder = workspace.fresh_path(spark, "warc")
    runs = workspace.saved(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7), folder, run_rows=25, block=3), "runs")
    places = [(r.path, r.offset, r.size) for r in runs.orderBy("path", "offset").collect()]
    stored = [[c for _, c in warc._read_run(path, [x[1:] for x in places if x[0] == path])] for path in sorted({x[0] for x in places})]
    assert len(stored) >= 7 and all(run == sorted(run, key=warc._order) for run in stored)
    index = workspace.saved(warc.merged_index(runs, 4, fan_in, block=3), "index").orderBy("part", "place").collect()
    assert [tuple(r)[:8] for r in index] == sorted((c for run in stored for c in run), key=warc._order) and len(index) == 200
    assert len({r.part for r in index}) > 1 and index == sorted(index, key=lambda r: (r.part, r.place))
    workspace.remove(spark, warc.runs_folder(folder))
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        warc.merged_index(runs, 4).collect()


def test_loser_tree_merges_runs():
    for many in range(8):
        runs = [sorted((k * 7 + j * 5) % 23 for j in range(k)) for k in range(many)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_damage_and_empty_table(spark, tmp_path):
    raw, _ = warc._record({"page_id": 1, "url": "u", "html": "hello", "digest": hashlib.sha1(b"hello").hexdigest(), "refers_to": None})
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(raw.replace(b"hello", b"hallo"))
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    runs = workspace.saved(warc.write_archives(pages, f"file://{tmp_path}/none"), "runs")
    assert runs.isEmpty() and warc.read_archives(spark, f"file://{tmp_path}/none", warc.merged_index(runs, 2)).isEmpty()
