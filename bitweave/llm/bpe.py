"""Encoding with a public byte-level tokenizer by corpus-level merge replay.

A task reads its share of the corpus in blocks of documents. The words of a block that it has not
met yet are encoded together: an inverted index holds for every token pair the places (word,
position) where it stands, and the merges are applied in rank order, each at all of its places at
once. A merge touches only the neighbours of its places: their old pairs are left behind (and seen
to be stale when their turn comes), their new pairs enter the index. A merge's product can only be
part of merges of higher rank, so each word ends as if it had been encoded alone.

Nothing is shuffled: documents stay where they are read, and a task's memory of words is bounded.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task remembers, and the length up to which it remembers them.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64
#: Characters of a block of documents; a longer document is a block of its own.
BLOCK_CHARS = 8_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """Vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str, pattern: str | None = None):
        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256 onwards.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}
        vocab: dict[str, int] = model["vocab"]
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[a], vocab[b]] = (n, vocab[a + b])
        self.words = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def replay(self, words: list[str]) -> list[list[int]]:
        """Ids of every word, all words merged together in rank order."""
        byte_id, rank = self.byte_id, self.rank
        tokens: list[int] = []
        ends: list[int] = []
        for w in words:
            tokens += [byte_id[b] for b in w.encode("utf-8", "replace")]
            ends.append(len(tokens))
        size = len(tokens)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        start = 0
        for end in ends:  # words have no neighbours
            if end > start:
                after[end - 1] = -1
                before[start] = -1
            start = end
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(size):
            j = after[i]
            if j >= 0:
                pair = (tokens[i], tokens[j])
                if pair in rank:
                    places.setdefault(pair, []).append(i)
        queue = [(rank[p][0], p) for p in places]
        heapq.heapify(queue)
        while queue:
            _, pair = heapq.heappop(queue)
            a, b = pair
            made = rank[pair][1]
            at = places.pop(pair)
            at.sort()
            for i in at:
                j = after[i]
                if tokens[i] != a or j < 0 or tokens[j] != b:
                    continue  # a neighbour's merge took one of the two
                tokens[i] = made
                tokens[j] = -1
                k = after[j]
                after[i] = k
                if k >= 0:
                    before[k] = i
                    new = (made, tokens[k])
                    if new in rank:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(queue, (rank[new][0], new))
                        places[new].append(i)
                h = before[i]
                if h >= 0:
                    new = (tokens[h], made)
                    if new in rank:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(queue, (rank[new][0], new))
                        places[new].append(h)
        out, start = [], 0
        for end in ends:
            out.append([t for t in tokens[start:end] if t >= 0])
            start = end
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none for an empty or null one."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        fresh = list({w for ws in split for w in ws if w not in known})
        new = dict(zip(fresh, self.replay(fresh)))
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                found = known.get(w)
                ids += new[w] if found is None else found
            out.append(ids)
        known.update((w, t) for w, t in new.items() if len(w) <= REMEMBERED_LENGTH)
        return out


@functools.cache
def merges(path: str, pattern: str | None = None) -> Merges:
    return Merges(path, pattern)


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block: list[str | None] = []
    chars = 0
    for t in texts:
        if block and chars + len(t or "") > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(t)
        chars += len(t or "")
    if block:
        yield block


def encode(df: DataFrame, ident: str, text: str, path: str | None = None) -> DataFrame:
    """(``ident``, ids) of every row, without special tokens; strings that look like special tokens
    are ordinary text. Empty and null texts have an empty list; texts of any length are encoded
    whole; repeated rows and rows with a null ``ident`` are kept."""
    return _encoded(df, ident, text, path or tokenizer_path(), False)


def count_tokens(df: DataFrame, ident: str, text: str, path: str | None = None) -> DataFrame:
    """(``ident``, tokens BIGINT) of every row; as ``encode``, but only the number leaves Python."""
    return _encoded(df, ident, text, path or tokenizer_path(), True)


def _encoded(df: DataFrame, ident: str, text: str, path: str, count: bool) -> DataFrame:
    rows = df.select(F.col(ident), F.col(text).alias("text_" if ident == "text" else "text"))
    kind = rows.schema[0].dataType.simpleString()
    name = "tokens" if count else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merges(path)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1).to_pylist()):
                ids = tool.encode(block)
                lengths = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
                if count:
                    made = pa.array(lengths)
                else:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(offsets[-1]))
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), made], names=[ident, name])
                at += len(block)

    return rows.mapInArrow(run, f"`{ident}` {kind}, {name} {'bigint' if count else 'array<int>'}")
