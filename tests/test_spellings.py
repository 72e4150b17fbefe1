import random
import re
from functools import lru_cache

from bibliora.operators import spellings as sp
from bibliora.plans import catalog

NAMES = [
    "Müller, Jürgen", "Jürgen Müller", "Mueller, Juergen", "J. Muller", "Muller Jurgen", "Lü, Wei", "Wei Lv", "Wei Lu", "Lue Wei", "Wei Luü", "Ødegård, Åse", "Aase Oedegaard", "Ase Odegard", "Strauß", "Strauss", "Straus",
    "Anne-Marie Smith", "Annemarie Smith", "A Smith", "Smith", "Smith A", "ü" * 9 + " Xü", "v" * 9 + " Xu", "ue" * 9 + " Xv", "", "-", None, "Łukasz Đorđe", "Lukasz Dorde", "Vue", "Uue",
]


@lru_cache(maxsize=None)
def every(name):
    return dict(sp.spellings(name, 10**7)[0])


def brute_force(a, b):
    x, y = every(a), every(b)
    return min((x[t] + y[t] for t in x.keys() & y.keys()), default=None)


def test_spellings_come_cheapest_first():
    found, complete = sp.spellings("Lü, Wei")
    assert complete and found[0] == ("weilü", 0) and [c for _, c in found] == sorted(c for _, c in found)
    assert dict(found)["weilv"] == sp.AS_V and dict(found)["luewei"] == sp.TURNED + sp.LETTERS and dict(found)["wlu"] == sp.INITIALS + sp.LETTERS
    some, complete = sp.spellings("ü" * 20, 10)
    assert not complete and len(some) == 10 and some[0] == ("ü" * 20, 0)
    assert sp.spellings(None) == ([], True) and sp.spellings(" - ") == ([], True)


def test_search_over_both_names_equals_all_spellings():
    rng = random.Random(3)
    names = [n for n in NAMES if sum(len(sp.options(c)) > 1 for c in n or "") < 5]
    names += ["".join(rng.choice("aäuüvoesßå ,-") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    for a in names:
        for b in names:
            rank = brute_force(a, b)
            assert sp.common_rank(a, b) == rank, (a, b)
            if rank is not None:
                assert set(sp.skeletons(a)) & set(sp.skeletons(b)), (a, b)


def test_join_by_spelling_with_and_without_the_bound(spark):
    left = spark.createDataFrame([(k, n, "x") for k, n in enumerate(NAMES)] + [(90, NAMES[0], "y")], "a int, n string, more string")
    right = spark.createDataFrame([(k, n) for k, n in enumerate(NAMES)], "b int, m string")
    expected = {(i, j, r) for i, a in [*enumerate(NAMES), (90, NAMES[0])] for j, b in enumerate(NAMES) if (r := sp.common_rank(a, b)) is not None}
    for most in (2, sp.MOST):
        found = sp.by_spelling(left, "a", "n", right, "b", "m", most).collect()
        assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert sp.by_spelling(left.limit(0), "a", "n", right, "b", "m").isEmpty()


def test_query_over_the_documents(spark):
    folder = "/root/testdata/sf0.001"
    found = {tuple(r) for r in catalog.QUERIES["spelling_join"](spark, folder).collect()}
    names, known = {r[0] for r in found}, {r[1] for r in found}
    assert {(a, b, r) for a in names for b in known if (r := sp.common_rank(a, b)) is not None} == found
    texts = [re.findall(r"[^\W\d_]+", r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    assert names == {f"{w[1]}, {w[0]}" for w in texts if len(w) > 1}


def test_skeletons_join_no_pairs_in_vain(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)
    search = sp.common_rank

    def counted(a, b):
        asked.add(1)
        return search(a, b)

    monkeypatch.setattr(sp, "common_rank", counted)
    names = [f"Xv{'ü' * k}, Anna" for k in range(5)] + [f"A{chr(97 + k)}na Smith" for k in range(20)] + ["", None, "Annä Smith"]
    rows = spark.createDataFrame([(n,) for n in names + names[:3]], "name string").repartition(3)
    found = [tuple(r) for r in sp.meetings(rows, rows, most=20).collect()]
    expected = {(a, b, rank) for a in names for b in names if (rank := brute_force(a, b)) is not None}
    assert set(found) == expected and len(found) == len(expected) > 400
    assert 0 < asked.value < 200  # pairs of names of which both are written out meet without a search


def test_beyond_tells_names_that_are_not_written_out():
    for name in NAMES:
        for most in (1, 2, 5, 64):
            assert sp.beyond(name, most) == (not sp.spellings(name, most)[1])


def test_first_two_words_of_texts(spark, tmp_path):
    texts = ["Anna Smith says", " 1. Änna-Smith", "Anna", "", None, "1 2", "b" * 50000, "x" * 30000 + " y", "Ana\nSmyth\nmore", "漢字 Smith"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.name for r in catalog.QUERIES["spelling_join"](spark, str(tmp_path)).collect()}
    assert found == {"Smith, Anna", "Smith, Änna", "y, " + "x" * 30000, "Smyth, Ana", "Smith, 漢字"}
