import pytest

from bitweave.llm.skeleton import looks, prototypes, same_look, skeleton

SAME = [("Ａcting　Ｅditor", "Acting Editor"), ("Na​me", "Name"), ("Čavlin", "Čavlin"), ("Ångvik", "Ångvik"), ("Grаin", "Grain"), ("Νοοr", "Noor"),
        ("a b", "a b"), ("Linaﬂagim", "Linaflagim"), ("Final Ⅱ", "Final II"), ("ﾃｺｹ", "テコケ"), ("x ", "x"), ("25 µm", "25 μm"), ("Café‑M", "Café-M"), ("１８", "18")]
#: Look-alikes of other scripts: phonetic letters, Armenian, Cherokee, Coptic, small capitals, signs.
SAME += [(f"x{a}y", f"x{b}y") for a, b in ("ɑa", "օo", "ᎠD", "ᎪA", "ⲟo", "ᴄc", "ոn", "ɡg", "ıi", "τᴛ", "∣l", "lI", "0O", "1l", "—ー", "ѕs", "ρp")]
OTHER = [("Peñora", "Penora"), ("9² plate", "92 plate"), ("ABC", "abc"), ("½ mile", "1/2 mile"), ("a-b", "a b"), ("Веk", "Bek2"), ("", "a"), ("Товар", "товар"), ("Θεν", "θεν"), ("Ѳ", "ѳ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(spark, a, b):
    table = prototypes(spark)
    assert skeleton(a, table) == skeleton(b, table)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(spark, a, b):
    table = prototypes(spark)
    assert skeleton(a, table) != skeleton(b, table)


@pytest.mark.parametrize("a", [x for p in SAME + OTHER for x in p])
def test_idempotent(spark, a):
    table = prototypes(spark)
    assert skeleton(skeleton(a, table), table) == skeleton(a, table)


def test_rows(spark):
    long = "Ｘ" * 200_000
    rows = [(1, "Ａ", "A", 0), (2, "A", "A", 0), (3, None, "A", 0), (4, "A", None, 0), (5, "​", "", 0), (6, "b", "A", 0), (7, long, "X" * 200_000, 0), (7, long, "X" * 200_000, 0)]
    df = spark.createDataFrame(rows, "id int, x string, y string, __a int")
    assert sorted(r["id"] for r in same_look(df.drop("__a"), "x", "y", "id").collect()) == [1, 5, 7, 7]
    assert same_look(df.limit(0).drop("__a"), "x", "y", "id").count() == 0
    got = {r["form"]: (r["spellings"], r["n_values"]) for r in looks(df, ["x", "y"]).collect()}
    assert got["A"] == (2, 7) and got[""] == (2, 2) and got["X" * 200_000] == (2, 4)
    assert {r["form"]: r["shown"] for r in looks(df, ["x", "y"]).collect()}["A"] == "A"
