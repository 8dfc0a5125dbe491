import random
import re

from bitweave.llm.truncation import _beginnings, _patterns, _raw, _strip, cut_shares, cut_texts, judged_texts, prefix_of_longer, segments

WHOLE = [f"The planner chose {a} {b} as the anchor because the name covers most of the question. Visitors reach {b} by ferry between March and October." for a, b in (("Ada", "Lovela"), ("Bob", "Brunsko"), ("Cleo", "Carvani"), ("Dora", "Denkimo"))]
LISTS = ["Open points:\n- restart the queue-probe service\n- compare the anchor with North Lovela", "Open points:\n- compare the anchor with Brunsko\n- restart the shard-mirror service"]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "s", True) for i, t in enumerate(texts)], "id int, text string, source string, broken boolean")
    return {r["id"] for r in cut_texts(df, "id", "text").collect()}


def test_cut_in_sentence_word_name_and_with_a_mark(spark):
    cut = ["The planner chose Ada Lovela as the anchor because the na", "Visitors reach Carvani by ferry between March and", "The planner chose Bob Bruns", "Visitors reach Denkimo by ferry…", "Visitors reach Denkimo by�", "Open points:\n- restart the queue-pro"]
    assert found(spark, WHOLE + LISTS + cut) == set(range(6, 12))


def test_complete_texts(spark):
    fine = ["Visitors reach Lovela by ferry between March and October", "The planner chose Dora Denkimo as the anchor because the name covers most of the question.", *LISTS]
    assert found(spark, WHOLE + fine) == set()


def test_defined_cases(spark):
    long = (WHOLE[0] + " ") * 3000
    texts = [*WHOLE, None, "", "   \n ", long, long + "Visitors reach Lov", "Visitors reach Lov", "Visitors reach Lov"]
    assert found(spark, texts) == {8, 9, 10}
    assert found(spark, []) == set()
    df = spark.createDataFrame([(i, t, "a" if i % 2 else None) for i, t in enumerate(texts)], "id int, text string, source string")
    got = {r["source"]: (r["texts"], r["cut"]) for r in cut_shares(df, "id", "text", "source").collect()}
    assert got == {"a": (5, 1), None: (5, 2)}


def test_copies_of_a_cut_text_do_not_vouch_for_it(spark):
    cut = "The planner chose Ada Lovela as the anchor because the"
    assert found(spark, WHOLE + [cut] * 6) == set(range(4, 10))
    assert found(spark, WHOLE + [cut, cut + "…", cut + " ...", cut + " [truncated]", cut + "\n"] * 2) == set(range(4, 14))
    # Nor do copies of a longer text speak against an end that other texts have.
    ends = [f"Note {x} of the day: all is well\nThe ferry leaves" for x in ("one", "two", "six", "ten")]
    assert found(spark, ends + ["The ferry leaves at noon."] * 9) == set()


def test_segments_and_patterns():
    assert [" ".join(x) for x in segments("One two. Three!\r\n1. four\nJ. Smith came. 五。六")] == ["One two.", "Three!", "1. four", "J. Smith came.", "五。", "六"]
    raw = _raw("Ask Bob J. Smith about store_queue, 12.5 times.".split())
    assert _patterns(raw) == [("N", "about", "I", ",", "00.0", "times"), ("^ask", "N", "about", "I", ",", "00.0", "times")]
    assert _patterns(_raw("Lovela. Bob".split()))[1] == ("^lovela", ".", "N") and _patterns(_raw("Ada goes".split())) == [("N", "goes"), ("^ada", "goes")]


def test_marks_are_taken_off():
    assert [_strip(x)[0] for x in ("a b…", "a b ... [TRUNCATED]\n", "a b 🙂 ", "a b (more)", "a b]", "a b. ", "a b…🙂…")] == ["a b"] * 4 + ["a b]", "a b.", "a b"]


def test_prefixes_of_longer_texts(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(1, 12))) for _ in range(150)] + ["x" * 5000, "x" * 4999, "x" * 70 + "\ny", "x" * 70]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "ident string, text string")
    got = {int(x["ident"]) for x in prefix_of_longer(df, df.select('text').distinct()).collect()}
    on = lambda t, u: len(u) > len(t) and u.startswith(t) and re.match(r"[ \t]*[^\s.。…]", u[len(t) : len(t) + 64])
    assert got == {i for i, t in enumerate(texts) if any(on(t, u) for u in texts)}


def test_a_prefix_of_a_longer_copy_is_cut(spark):
    longer = "Zu den Akten gehört ein Plan von 1890 mit allen Höhen"
    assert found(spark, [longer, longer[:41], longer[:30] + "…", longer + "."]) == {1, 2}


def test_beginnings(spark):
    words = ["a" * 100, "a" * 80, "abc", "ab", "a", "b"]
    asked = [*words, "a" * 64, "a" * 65, "zz"]
    got = {x["t"]: x["n"] for x in _beginnings(spark.createDataFrame([(x,) for x in asked], "t string"), spark.createDataFrame([(x, 1) for x in words], "next string, n int"), []).collect()}
    assert got == {t: n for t in asked if (n := sum(w.startswith(t) and w != t for w in words))}


def test_branches(spark):
    rows = [(x,) for x in [*WHOLE, "The planner chose Ada Lovela as the anchor because the na", None, "a�"]]
    got = {(x["branch"], x["cut"]) for x in judged_texts(spark.createDataFrame(rows, "text string"), "text").collect()}
    assert {("stop", False), ("copy", True), ("broken", True)} <= got or ("begins", True) in got
