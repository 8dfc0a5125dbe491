import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bitweave.llm import bpe

PATH = bpe.tokenizer_path()
TOOL = Tokenizer.from_file(PATH)
TOOL.encode_special_tokens = True


def ids(text):
    return TOOL.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_as_the_library(texts):
    assert bpe.merges(PATH).encode(texts) == [ids(t) for t in texts]


@pytest.mark.parametrize("text", ["<|endoftext|> as text", "aaaaaaaaaaaaaaaa" * 40, "thethethethe", " \n\t  x", "naïve café 🧠🧠 読書", "x" * 30_000, "a" + "ab" * 5000])
def test_hard_texts(text):
    assert bpe.merges(PATH).encode([text]) == [ids(text)]


def test_round_trip():
    text = "Edges between A and B were confirmed 12 times.\r\nÉlan-Heron…"
    assert TOOL.decode(bpe.merges(PATH).encode([text])[0]) == text


def test_rows_and_blocks(spark, monkeypatch):
    rows = [(1, "hello world", 0), (2, "", 0), (3, None, 0), (1, "hello world", 0), (None, "hi", 0)]
    df = spark.createDataFrame(rows, "id int, text string, ids int")
    got = sorted(((r["id"] or 0, r["ids"]) for r in bpe.encode(df, "id", "text").collect()))
    assert got == sorted((i or 0, ids(t or "")) for i, t, _ in rows)
    counts = sorted((r["id"] or 0, r["tokens"]) for r in bpe.count_tokens(df, "id", "text").collect())
    assert counts == [(i, len(x)) for i, x in got]
    assert bpe.encode(df.limit(0), "id", "text").count() == 0
    assert [len(b) for b in bpe._blocks(["a" * 5_000_000, "b" * 5_000_000, None, "c"])] == [1, 3]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    tool = bpe.Merges(PATH)
    texts = ["one two three four", "two five", "one two"]
    assert [tool.encode([t])[0] for t in texts] == [ids(t) for t in texts]
