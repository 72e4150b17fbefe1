import random

from bibliora.operators import positions


def brute_force(marks, others, reach):
    found = []
    for doc, at, name in marks:
        near = sorted((abs(at - p), p > at, v) for d, p, v in others if d == doc and abs(at - p) <= reach)
        found.append((doc, at, name, near[0][2] if near else None, near[0][0] if near else None))
    return sorted(found, key=str)


def test_nearest_marks(spark, monkeypatch):
    rng = random.Random(3)
    marks = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(4000), f"m{n}") for n in range(300)]
    others = [(rng.choice([1, 1, 2, 4]), rng.randrange(4000), f"v{n:03d}") for n in range(200)]
    others += [(1, 100, "b"), (1, 100, "a"), (1, 120, "c")]
    marks += [(1, 110, "tie"), (1, 100, "here"), (9, 5, "alone")]
    left, right = spark.createDataFrame(marks, "doc int, at int, name string"), spark.createDataFrame(others, "doc int, at int, v string")
    for stretch in (2, 16):
        monkeypatch.setattr(positions, "STRETCH", stretch)
        rows = positions.nearest(left, right, "doc", "at", "v", 25).select("doc", "at", "name", "v", "distance").collect()
        assert sorted(map(tuple, rows), key=str) == brute_force(marks, others, 25)
    assert positions.nearest(left.limit(0), right, "doc", "at", "v", 25).isEmpty()
    assert positions.nearest(left, right.limit(0), "doc", "at", "v", 25).filter("v IS NOT NULL").isEmpty()


def test_all_within_reach(spark):
    rng = random.Random(5)
    marks = [(rng.randrange(3), rng.randrange(2000), n) for n in range(60)]
    others = [(rng.randrange(3), s, s + rng.randrange(1, 90), n) for n, s in enumerate(rng.randrange(2000) for _ in range(300))]
    rows = positions.within(spark.createDataFrame(marks, "doc int, at int, m int"), spark.createDataFrame(others, "doc int, start int, end int, o int"), "doc", "at", "start", "end", 40)
    found = sorted((r.m, r.o) for r in rows.collect())
    assert found == sorted((m, o) for d, at, m in marks for e, s, t, o in others if d == e and s >= at - 40 and t <= at + 40)


def test_affiliations_by_nearness(spark):
    close = "Ann Lee, Department of Stars, Great University of North. "
    far = "x" * 300 + " Institute of Faraway Things and More. "
    papers = [
        (1, close + "Bo Day, Laboratory of Light at Some Place. " + far + "Abstract Cy Fox, School of Nothing That Counts. ", ["Ann Lee", "Bo Day", "Cy Fox", "Nobody"]),
        (2, "Ann Lee, School of X. Methods", ["Ann Lee"]),
        (3, None, ["Ann Lee"]),
    ]
    rows = positions.affiliations_by_nearness(spark.createDataFrame(papers, "id int, t string, authors array<string>"), "id", "t", "authors").collect()
    found = {(r.id, r.author): r.affiliations for r in rows}
    north, light = "Department of Stars, Great University of North.", "Laboratory of Light at Some Place."
    assert found == {(1, "Ann Lee"): [north, light], (1, "Bo Day"): [north, light], (1, "Cy Fox"): None, (1, "Nobody"): None, (2, "Ann Lee"): None, (3, "Ann Lee"): None}


def test_affiliations_by_marks(spark):
    text = "Ann Lee 1,2 , Bo Day2 and Cy Fox* and Di Orr 7\n1 Department of A, Town. 2 University of B. * Institute of C. 1 School of later pages."
    rows = positions.affiliations_by_marks(spark.createDataFrame([(1, text, ["Ann Lee", "Bo Day", "Cy Fox", "Di Orr", "No One"])], "id int, t string, authors array<string>"), "id", "t", "authors").collect()
    a, b, c = "Department of A, Town.", "University of B.", "Institute of C."
    assert {r.author: r.affiliations for r in rows} == {"Ann Lee": [a, b], "Bo Day": [b], "Cy Fox": [c], "Di Orr": None, "No One": None}


def test_spans(spark):
    rows = positions.spans(spark.createDataFrame([(1, "a1 b22"), (2, None), (3, "")], "k int, t string"), "k", "t", r"([a-z])(\d+)").orderBy("start").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 2, "a1", ["a", "1"]), (1, 3, 6, "b22", ["b", "22"])]
