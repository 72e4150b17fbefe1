import random

import pytest

from bibliora.plans import catalog
from bibliora.sources import records

RULE = "-" * 80


@pytest.fixture
def ranges(spark):
    """Sets how many bytes a range of a file has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def set_size(many):
        spark.conf.set(names[0], str(many))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield set_size
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def by_lines(text, marker):
    """Records by one reading of all lines."""
    found = None
    out = []
    for line in text.removeprefix("﻿").replace("\r\n", "\n").split("\n"):
        if line.startswith(marker):
            found = [line[len(marker) :]]
            out.append(found)
        elif found is not None:
            found.append(line)
    return ["\n".join(r) for r in out]


def by_lines_ended(text):
    return [r.removesuffix("\n") for r in by_lines(text, "PAPER: ")]


def written(tmp_path, many):
    rng = random.Random(many)
    texts = []
    for k in range(many):
        parts = [rng.choice(["head\n", "", "﻿PAPER: bom\n"])]
        for j in range(rng.randrange(12)):
            body = "".join(rng.choice(["x", "é漢", "PAPER: inside", " PAPER: ", "\n", "\n\n", RULE, "-" * 9]) for _ in range(rng.randrange(60)))
            parts.append(f"PAPER: t{j}\n{body.replace(chr(10) + 'PAPER: ', chr(10) + 'x')}\n")
        texts.append("".join(parts))
        if rng.random() < 0.3:
            texts[-1] = texts[-1].replace("\n", "\r\n")
        (tmp_path / f"{k}.txt").write_bytes(texts[-1].encode())
    return texts


def test_any_split_into_ranges_gives_the_same_records(spark, tmp_path, ranges):
    texts = written(tmp_path, 6)
    expected = {f"{k}.txt": by_lines_ended(t) for k, t in enumerate(texts)}
    largest = max(len(t.encode()) for t in texts)
    for parts in (1, 3, 50):
        ranges(max(1, largest // parts))
        rows = records.split_records(spark, str(tmp_path), "PAPER: ").orderBy("file", "block", "row").collect()
        found = {name: [r.record for r in rows if r.file.endswith("/" + name)] for name in expected}
        assert found == expected
    assert len({r.block for r in rows}) > 15


def test_a_record_longer_than_many_ranges(spark, tmp_path, ranges):
    (tmp_path / "a.txt").write_text("PAPER: one\n" + "y\n" * 5000 + "PAPER: two\nPAPER: PAPER: three")
    ranges(500)
    rows = records.split_records(spark, str(tmp_path / "a.txt"), "PAPER: ").orderBy("block", "row").collect()
    assert [r.record for r in rows] == ["one\n" + "y\n" * 4999 + "y", "two", "PAPER: three"]


def machine(text):
    """Lines and failures of each title, read line by line."""
    sections, failures, title, opened = {}, {}, None, False
    for line in text.split("\n"):
        if line.startswith("PAPER: "):
            title, opened = line.replace("PAPER: ", "").strip(), False
            sections[title] = []
            failures.setdefault(title, 0)
        elif line.startswith("ERROR: Failed to download LaTeX sources"):
            if title is not None:
                failures[title] += 1
        elif line.startswith("AFFILIATION SECTION:"):
            opened = True
        elif line.startswith("-" * 10):
            continue
        elif title is not None and opened and line.strip():
            sections[title].append(line)
    return {t: (ls, failures[t]) for t, ls in sections.items()}


def test_affiliation_lines_equal_the_line_machine(spark, tmp_path, ranges):
    rng = random.Random(2)
    lines = ["AFFILIATION SECTION:", RULE, "", " ", "ERROR: Failed to download LaTeX sources for x", "\\author{A}", "  Univ", "-- dash", "\t", "AFFILIATION SECTION: again"]
    text = "head\nERROR: Failed to download LaTeX sources\n" + "".join(f"PAPER: t{rng.randrange(30)} \n" + "".join(rng.choice(lines) + "\n" for _ in range(rng.randrange(12))) for _ in range(60))
    (tmp_path / "s.txt").write_text(text)
    for size in (10**6, 97):
        ranges(size)
        rows = records.affiliation_lines(spark, str(tmp_path / "s.txt")).collect()
        assert {r.title: (r.lines, r.failures) for r in rows} == machine(text)


def test_sections_without_rulers(spark, tmp_path):
    (tmp_path / "s.txt").write_text(f"head\n{RULE}\nPAPER: First\n{RULE}\nAFFILIATION SECTION:\n\\author{{A}}\n{RULE}\nPAPER: \nPAPER: Second\n{RULE}\nERROR: none\n")
    rows = records.section_records(spark, str(tmp_path)).orderBy("block", "row").collect()
    assert [(r.title, r.body) for r in rows] == [("First", "\\author{A}"), ("Second", "ERROR: none")]
    (tmp_path / "s.txt").write_text("")
    assert records.section_records(spark, str(tmp_path)).isEmpty()


def test_query_is_registered():
    assert "record_files" in catalog.QUERIES
