import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitweave.llm.canon import Canon, Words, abbreviates, distance, map_values, most_errors, pattern
from bitweave.llm.names import edits

LIST = [(1, "North Harbour"), (2, "South Harbour"), (3, "Harbour"), (4, "Deputy Theatre Manager"), (5, "Theatre Manager"), (6, "A Lantern for Kobistelun"), (7, "Cîtisotrum Valley"), (9, "Citisotrum Valley"), (8, "Rowing Club")]
CASES = [("North Harbour", 1), ("harbour", 3), (" the town of South_Harbour ", 2), ("Noth Harbour", 1), ("theater mgr.", 5), ("Deputy Manager (Theatre)", 4), ("Manager, Theatre, Deputy", 4), ("Lantern 4 Kobistelun, A (film)", 6),
         ("Citisotrum vly.", 7), ("Deputy Theatre Prompter", -1), ("East Harbour", -1), ("", -1), ("??", -1), (None, -1), ("NorthHarbour", 1), ("Rowing Club (film)", 8), ("n. harbour, town", 1), ("A Lantern phor Kobistelun 1982 film", 6),
         ("South Harbour (film)", 2), ("Rowing Club, town", 8), ("harbour town", 3), ("theatre manager 1991", 5), ("Deputy Theatre Manager II", 4), ("harbour 3", 3), ("North Har bour", 1), ("n", -1)]
NOISE = frozenset(["film", "town", "#"])
#: Those that need no word to be learned as one that changes nothing.
PLAIN = [c for c in CASES if c[0] is None or not re.search(r"film|town|\d| II", c[0])]


@pytest.mark.parametrize("value,want", [c for c in CASES if c[0] is not None])
def test_match(value, want):
    assert Canon(LIST, NOISE).match(value) == want


def test_column(spark):
    refs = spark.createDataFrame([*LIST, (None, "x"), (10, None)], "id int, name string")
    df = spark.createDataFrame([*PLAIN, ("word " * 50_000 + "North Harbour", -1), ("North Harbour", 1)], "value string, want int").withColumnRenamed("want", "id")
    assert all(r["canon_id"] == r["id"] for r in map_values(df, "value", refs, "id", "name").collect())
    assert {r["canon_id"] for r in map_values(df, "value", refs.limit(0), "id", "name").collect()} == {-1}
    assert map_values(df.limit(0), "value", refs, "id", "name").count() == 0


def test_slices_of_a_long_list(spark, monkeypatch):
    import bitweave.llm.canon as c

    df = spark.createDataFrame(PLAIN, "value string, want int")
    refs = spark.createDataFrame(LIST, "id int, name string")
    one = {r["value"]: r["canon_id"] for r in map_values(df, "value", refs, "id", "name").collect()}
    monkeypatch.setattr(c, "SLICE", 4)
    got = {r["value"]: r["canon_id"] for r in map_values(df, "value", refs, "id", "name").collect()}
    assert got == one


def test_words_that_change_nothing_are_learned(spark):
    places = [f"{a}{b}vik" for a in ("Kalu", "Memo", "Tira", "Sobe") for b in ("ran", "gost", "pelm")]
    refs = spark.createDataFrame([(i, f"{d} {p}") for i, (d, p) in enumerate((d, p) for p in places for d in ("North", "South"))], "id int, name string")
    typed = [(f"{p}", i) for i, p in enumerate(f"{d} {p}" for p in places for d in ("North", "South"))]
    df = spark.createDataFrame([x for t, i in typed for x in ((f"{t} parish", i), (f"{t} 1204", i), (f"West {t.split()[1]}", -1))], "value string, want int")
    assert all(r["canon_id"] == r["want"] for r in map_values(df, "value", refs, "id", "name").collect())


def test_all_words_that_change_nothing_are_learned(spark, monkeypatch):
    import bitweave.llm.canon as c

    places, kinds = [f"{a}{b}vik" for a in ("Kalu", "Memo", "Tira", "Sobe") for b in ("ran", "gost", "pelm")], ["parish", "township", "borough", "1204"]
    refs = spark.createDataFrame(list(enumerate(places)), "id int, name string")
    typed = [(f"{p} {k}", i) for i, p in enumerate(places) for k in kinds] + [(f"{places[0]} townshp", 0), (f"{places[1]} quarry", -1), (f"borough {places[2]} parish", 2)]
    df = spark.createDataFrame(typed, "value string, want int")
    for most in (20_000, 1):
        monkeypatch.setattr(c, "MOST_NOISE", most)
        assert all(r["canon_id"] == r["want"] for r in map_values(df, "value", refs, "id", "name").collect())


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.text("abc", max_size=9))
def test_distance(a, b):
    assert distance(pattern(a), len(a), b) == edits(a, b, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", min_size=3, max_size=13), min_size=1, max_size=8), st.text("abcd", min_size=3, max_size=13))
def test_near_words_are_complete(listed, token):
    got = {w for w, e in Words(listed).near(token).items() if e == int(e)}
    for w in listed:
        if 0 < edits(token, w, 9) <= most_errors(max(len(w), len(token))) and abbreviates(token, w) is None:
            assert w in got
