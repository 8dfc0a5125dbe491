"""Overlaps against brute force, with every split of the words into rare and frequent ones."""

import random

import pytest

from bitweave.operators import overlap


@pytest.mark.parametrize("pairs,top,listed", [(10**9, 2, 8), (400, 2, 8), (400, 0, 8), (60, 3, 8), (0, 2, 8), (0, 3, 2), (60, 40, 1)])
def test_top_overlaps_are_those_of_all_pairs(spark, monkeypatch, pairs, top, listed):
    for name, value in (("PAIRS", pairs), ("TOP", top), ("LISTED", listed)):
        monkeypatch.setattr(overlap, name, value)
    r = random.Random(8)
    rels, given = [["by", "directed"], ["by", "led"], ["in", "born"], ["in"]], [f"g{i}" for i in range(6)]
    facts = []
    for i in range(400):
        one, two = (r.sample(given, r.randint(0, 2)) + [f"n{r.randrange(60)}"] * r.randint(0, 1) for _ in "ab")
        facts.append((i, one + r.choice(rels), two))
    held = {i: set(s + o) for i, s, o in facts}
    asked = {i: set(s) for i, s, _ in facts if i % 7 == 0} | {1000: set(), 1001: {"none"}, 1002: {"by"}}
    df = lambda d, names: spark.createDataFrame([(i, sorted(ws)) for i, ws in d.items()], names)
    got = {}
    for x in overlap.top_overlaps(df(held, "id bigint, ws array<string>"), df(asked, "q bigint, qs array<string>"), 5).collect():
        got.setdefault(x["q"], {})[x["rank"]] = x["id"]
    want = {}
    for q, qs in asked.items():
        near = sorted((-round(len(qs & ws) / len(qs | ws), 9), i) for i, ws in held.items() if qs & ws)[:5]
        if near:
            want[q] = {n: i for n, (_, i) in enumerate(near, 1)}
    assert got == want


def test_a_frequent_word_makes_no_pairs(spark, monkeypatch):
    """Sets that share only a frequent word are not all joined: what is met stays far below all pairs."""
    monkeypatch.setattr(overlap, "PAIRS", 1000)
    met, plain = [], overlap._met
    monkeypatch.setattr(overlap, "_met", lambda *a: met.append(plain(*a)) or met[-1])
    held = spark.range(3000).selectExpr("id", "array('by', concat('n', id)) AS ws")
    got = overlap.top_overlaps(held, held.where("id % 10 = 0").selectExpr("id AS q", "ws AS qs"), 3)
    assert got.count() == 900 and {tuple(x) for x in got.where("q = 50").collect()} == {(50, 50, 1), (50, 0, 2), (50, 1, 3)}
    assert [m.count() for m in met] == [300]
