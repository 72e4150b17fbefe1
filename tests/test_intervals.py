import random

import pytest

from bibliora.operators import intervals


def brute_force(keys, given):
    return {(k, o) for k in set(keys) if k is not None for lo, hi, o in given if lo is not None and hi is not None and lo <= k <= hi}


def first_of(pairs):
    found = {}
    for k, o in pairs:
        found[k] = min(o, found.get(k, o))
    return set(found.items())


def strings(rng, many):
    return ["".join(rng.choice("abzé漢\U0001f600.0") for _ in range(rng.randrange(0, 5))) for _ in range(many)] + [None]


@pytest.mark.parametrize("parts", [1, 2, 7, 60])
def test_string_keys_in_code_point_order(spark, parts):
    rng = random.Random(parts)
    keys = strings(rng, 400) + ["hot"] * 300
    ends = strings(rng, 300)
    given = [(rng.choice(ends), rng.choice(ends), n) for n in range(250)] + [("", "\U0010ffff", 900), ("a", None, 901), ("hot", "hot", 902), ("z", "a", 903)]
    expected = brute_force(keys, given)
    rows = spark.createDataFrame([(k,) for k in keys], "k string").repartition(3)
    table = spark.createDataFrame(given, "lo string, hi string, o int").repartition(2)
    assert {tuple(r) for r in intervals.all_intervals(rows, "k", table, "lo", "hi", "o", parts).collect()} == expected
    first = intervals.first_intervals(rows, "k", table, "lo", "hi", "o", parts).collect()
    assert {tuple(r) for r in first} == first_of(expected) and len(first) == len(first_of(expected))


def test_numbers_ties_and_nothing(spark):
    rng = random.Random(5)
    keys = [rng.randrange(1000) for _ in range(500)]
    given = [(a, a + rng.choice([0, 3, 700]), f"c{n:03d}") for n, a in enumerate(rng.randrange(1000) for _ in range(80))]
    rows, table = spark.createDataFrame([(k,) for k in keys], "k long"), spark.createDataFrame(given, "lo long, hi long, o string")
    assert {tuple(r) for r in intervals.first_intervals(rows, "k", table, "lo", "hi", "o", 16).collect()} == first_of(brute_force(keys, given))
    for some, others in ((rows.limit(0), table), (rows, table.limit(0)), (rows.limit(0), table.limit(0))):
        assert intervals.first_intervals(some, "k", others, "lo", "hi", "o").isEmpty()
        assert intervals.all_intervals(some, "k", others, "lo", "hi", "o").isEmpty()


def test_covering_nodes_cover_ranges_once():
    for first in range(20):
        for last in range(first - 1, 40):
            nodes = intervals.covering_nodes(first, last)
            covered = [r for n in nodes for r in range((n & 0xFFFFFF) << (n >> 24), ((n & 0xFFFFFF) + 1) << (n >> 24))]
            assert sorted(covered) == list(range(first, last + 1)) and len(nodes) <= 12


def test_long_intervals_are_not_copied_into_every_range(spark):
    keys = [(f"{k:06d}",) for k in range(3000)]
    given = [(f"{n:06d}", f"{2999 - n:06d}", n) for n in range(1000)]
    rows, table = spark.createDataFrame(keys, "k string"), spark.createDataFrame(given, "lo string, hi string, o int")
    found = {r.k: r.o for r in intervals.first_intervals(rows, "k", table, "lo", "hi", "o", 64).collect()}
    assert len(found) == 3000 and set(found.values()) == {0}


def test_only_ranges_with_ends_that_count_are_swept(spark, monkeypatch):
    swept, inner = [], intervals._swept

    def counted(keys, key, placed, *more, **named):
        swept.append((keys.count(), placed.count()))
        return inner(keys, key, placed, *more, **named)

    monkeypatch.setattr(intervals, "_swept", counted)
    keys = [(f"{k:06d}",) for k in range(3000)] * 2
    given = [(f"{n % 100:06d}", f"{2999 - n % 77:06d}", n) for n in range(1000)] + [("001500", "001510", -1)]
    rows, table = spark.createDataFrame(keys, "k string"), spark.createDataFrame(given, "lo string, hi string, o int")
    found = [tuple(r) for r in intervals.first_intervals(rows, "k", table, "lo", "hi", "o", 64).collect()]
    assert set(found) == first_of(brute_force([k for k, in keys], given)) and len(found) == 3000
    (many, placed), = swept
    assert many < 3000 // 4 and placed < 1200  # of 2,002 ends
