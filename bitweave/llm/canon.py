"""Mapping of freely typed values to the entries of a reference list.

An automaton over all canonical names and their aliases finds the mentions embedded in a value; the
longest non-overlapping one wins, if what is left over of the value are only words that change
nothing. Which words those are is learned: words that are left over beside the mentions of several
entries, and do not tell entries apart in the list. Any other value goes to token-set similarity:
its words are aligned with those of an entry in any order, each misspelt within a number of errors
that grows with its length, or abbreviated, or written together or apart; the entry with the fewest
errors wins if it is the only one. A value with a word that no word of the entry stands for, or an
entry with a word that the value lacks, is no match.

Words of the list that a typed one may be are found by segments: k errors leave one of k + 1
segments whole, at a place shifted by their number at most, so a word costs look-ups in an index and
no pass over the list. Values are read once each, however often they are typed.

The list is sent to the executors in slices of ``SLICE`` entries, so there is none that is too long;
the best entries of the slices are compared as those of one slice are. Words that change nothing go
out in slices of about ``MOST_NOISE``; of all but the first, a value keeps those of its words they hold.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from bitweave.llm.names import plain
from bitweave.session import cut, partitions

#: Entries, and words that change nothing, that are sent at once.
SLICE, MOST_NOISE = 200_000, 20_000
#: Entries beside whose mentions a word must be left over; neighbours of a word that tells entries apart.
SUPPORT, NEIGHBOURS = 3, 5
#: Letters of a word that may be a misspelt joining word.
LOOSE = 5
# Words that join others and may lack.
JOINING = frozenset("the a an of and for from on in at de to".split())
# Standard abbreviations in place names.
STANDARD = {"n": "north", "s": "south", "e": "east", "w": "west", "mt": "mount", "ft": "fort", "pt": "port", "st": "saint", "ste": "saint"}


def words(text: str) -> list[str]:
    """Words of a value in lower case without accents; dots, dashes and underscores part them."""
    return re.findall(r"[^\W_]+", plain(text).replace("&", " and ").replace("'", "").replace("’", ""))


def most_errors(size: int) -> int:
    """Typing errors that a word of that size may have; of two words the longer one counts."""
    return 0 if size < 3 else 1 if size < 6 else 2 if size < 9 else 3 if size < 12 else 4


def is_number(word: str) -> bool:
    """Digits, or small Roman numerals."""
    return word.isdigit() or len(word) <= 4 and not word.strip("ivx")


def pattern(word: str) -> dict[str, int]:
    """The places of every letter of a word, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(places: dict[str, int], size: int, other: str) -> int:
    """Edit distance with swaps of neighbours, a column of the table at a time as bits."""
    if not size:
        return len(other)
    full, last = (1 << size) - 1, 1 << size - 1
    up, down, diagonal, before, total = full, 0, 0, 0, size
    for c in other:
        at = places.get(c, 0)
        swap = ((full ^ diagonal) & at) << 1 & before
        diagonal = ((at & up) + up ^ up | at | down | swap) & full
        rise = down | full ^ (diagonal | up)
        fall = diagonal & up
        if rise & last:
            total += 1
        elif fall & last:
            total -= 1
        rise = rise << 1 | 1
        up = (fall << 1 | full & ~(diagonal | rise)) & full
        down = rise & diagonal
        before = at
    return total


def _letters(word: str) -> int:
    """The word's letters as bits; each edit changes two at most."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) % 61)
    return bits


def _cuts(size: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 segments of a word."""
    base, more = divmod(size, k + 1)
    lengths = [base + (i > k - more) for i in range(k + 1)]
    return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)]


class Words:
    """Words of a list by their segments, as they are and as they are after a swap across a border."""

    def __init__(self, listed: list[str]):
        self.listed = {w: (_letters(w), pattern(w)) for w in listed}
        self.index: dict[tuple[int, int, str], set[str]] = defaultdict(set)
        self.initial: dict[str, list[str]] = defaultdict(list)
        self.sizes = sorted({len(w) for w in listed})
        for w in self.listed:
            self.initial[w[0]].append(w)
            for i, (start, n) in enumerate(_cuts(len(w), most_errors(len(w) + 1))):
                for f in (0, 1) if start else (0,):
                    for t in (0, 1) if start + n < len(w) else (0,):
                        first, last = w[start - f], w[start + n - 1 + t]
                        self.index[len(w), i, first + w[start + 1 : start + n - 1] + last if n > 1 else w[start - f] if f else last].add(w)

    @functools.lru_cache(1 << 8)
    def _places(self, size: int) -> list[tuple[int, int, int, int]]:
        """(length of a listed word, segment, place, size of it) to look up for a word of ``size``."""
        out = []
        for n in self.sizes:
            k = most_errors(n + 1)
            if abs(n - size) <= most_errors(max(n, size)):
                for i, (start, length) in enumerate(_cuts(n, k)):
                    low, high = max(0, start - k), min(size - length, start + k)
                    out += [(n, i, at, length) for at in range(low, high + 1)]
        return out

    def near(self, token: str) -> dict[str, float]:
        """Listed words that a token may be, with its errors in each."""
        if token in self.listed:
            out: dict[str, float] = {token: 0}
        else:
            out = {}
        own = _letters(token)
        tried = {token}
        index = self.index
        for n, i, at, length in self._places(len(token)):
            for w in index.get((n, i, token[at : at + length]), ()):
                if w not in tried:
                    tried.add(w)
                    most = most_errors(max(n, len(token)))
                    letters, places = self.listed[w]
                    if (letters ^ own).bit_count() <= 2 * most:
                        e = distance(places, n, token)
                        if e <= most:
                            out[w] = e
        if token in STANDARD and STANDARD[token] in self.listed:
            out[STANDARD[token]] = 0.2
        if len(token) <= 5 or not out:
            for w in self.initial.get(token[0], ()):
                cost = abbreviates(token, w)
                if cost is not None and cost < out.get(w, 9):
                    out[w] = cost
        return out


def abbreviates(short: str, long: str) -> float | None:
    """Cost of reading a word as cut off (its first letters) or drawn together (some of its letters,
    the first and preferably the last among them); None if it is neither."""
    if len(short) >= len(long):
        return None
    if long.startswith(short):
        return 0.3
    if len(short) < 2 or len(short) > 5:
        return None
    it = iter(long)
    if not all(c in it for c in short):
        return None
    return 0.4 if short[-1] == long[-1] else 0.7


class Noise:
    """A slice of the words that change nothing."""

    def __init__(self, noise: frozenset[str]):
        self.noise, self.near = noise, Words([w for w in noise if len(w) >= 4]).near

    def kind(self, token: str) -> int:
        """2: a word that changes nothing; 1: one if it is no word of the list (a number, misspelt); 0: neither."""
        if token in self.noise:
            return 2
        return int(is_number(token) and "#" in self.noise or len(token) >= 4 and any(e == 1 for e in self.near(token).values()))


class Canon:
    """A slice of the reference list with its automaton and words. ``entries``: (id, name); of equal
    names the smallest id stands for all. ``noise``: words that change nothing, "#" for numbers."""

    def __init__(self, entries: list[tuple[int, str]], noise: frozenset[str] = frozenset()):
        self.of: dict[tuple[str, ...], int] = {}
        for ident, name in sorted(entries):
            if name and words(name):
                self.of.setdefault(tuple(words(name)), ident)
        self.automaton = ahocorasick.Automaton()
        alias: dict[str, set[int]] = defaultdict(set)
        self.tokens: dict[int, list[str]] = {}
        self.joins: dict[int, Counter[str]] = {}
        beside: dict[str, set[str]] = defaultdict(set)
        for tokens, ident in self.of.items():
            alias[" ".join(tokens)].add(ident)
            alias[" ".join([*tokens[1:], tokens[0]])].add(ident)
            alias[" ".join([tokens[-1], *tokens[:-1]])].add(ident)
            bare = [t for t in tokens if t not in JOINING] or list(tokens)
            alias[" ".join(bare)].add(ident)
            self.tokens[ident] = bare
            self.joins[ident] = Counter(t for t in tokens if t in JOINING)
            for a, b in zip(tokens, tokens[1:]):
                beside[a].add(b)
                beside[b].add(a)
        for tokens, ident in self.of.items():  # a canonical name stands before an alias of another
            alias[" ".join(tokens)] = {ident}
        for text, idents in alias.items():
            if len(idents) == 1:
                self.automaton.add_word(f" {text} ", (len(text), next(iter(idents))))
        self.automaton.make_automaton()
        self.telling = {w for w, n in beside.items() if len(n) >= NEIGHBOURS}
        self.holders: dict[str, set[int]] = defaultdict(set)
        for ident, bare in self.tokens.items():
            for t in bare:
                self.holders[t].add(ident)
        self.words = Words(list(self.holders))
        self.noise, self.further = Noise(noise), {}
        self.known = functools.lru_cache(1 << 17)(self._near)

    def _near(self, token: str) -> tuple[dict[str, float], bool]:
        """Words of the list that a typed word may be, and whether it may change nothing."""
        kind = self.noise.kind(token)
        return self.words.near(token), kind > 1 or kind == 1 and token not in self.holders

    def near(self, token: str) -> tuple[dict[str, float], bool]:
        near, noise = self.known(token)
        kind = self.further.get(token, 0)
        return near, noise or kind > 1 or kind == 1 and token not in self.holders

    def mention(self, tokens: list[str]) -> tuple[int, int, list[str]] | None:
        """(size, id, words left over) of the longest embedded mention."""
        text = f" {' '.join(tokens)} "
        if not self.of:
            return None
        best = max(((size, -end, ident) for end, (size, ident) in self.automaton.iter(text)), default=None)
        if best is None:
            return None
        size, end, ident = best
        start = -end - size
        return size, ident, (text[:start] + " " + text[-end:]).split()

    def left_over(self, value: str) -> list[tuple[int, str]]:
        """(id, word) of the words beside the longest mention that do not tell entries apart."""
        found = self.mention(words(value))
        if found is None:
            return []
        out = []
        for t in set(found[2]) - JOINING:
            if is_number(t):
                out.append((found[1], "#"))
            elif self.telling.isdisjoint(w for w, e in self.words.near(t).items() if e <= 1 or len(t) >= 6):
                out.append((found[1], t))
        return out

    def _readings(self, tokens: list[str]) -> list[tuple[str, dict[str, float], bool]]:
        """The words with what they may be; two that are none alone but one together are one, and a
        word that is none but two of the list written together is two."""
        out = []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            near, noise = self.near(t)
            if i + 1 < len(tokens) and len(t) > 1 and t not in self.holders:
                both = t + tokens[i + 1]
                joint = {w: e + 0.5 for w, e in self.near(both)[0].items() if e in (0, 1)} if len(both) >= 6 else {}
                if joint:
                    out.append((both, joint, False))
                    i += 2
                    continue
            if not near and not noise and len(t) >= 6:
                best = None
                for k in range(3, len(t) - 2):
                    for a, b in ((t[:k], t[k:]),):
                        if a in self.holders or b in self.holders:
                            x, y = self.near(a)[0], self.near(b)[0]
                            if x and y and (best is None or min(x.values()) + min(y.values()) < best[0]):
                                best = (min(x.values()) + min(y.values()), (a, x, False), (b, y, False))
                if best:
                    out += best[1:]
                    i += 1
                    continue
            out.append((t, near, noise))
            i += 1
        return out

    def similar(self, tokens: list[str]) -> list[tuple[float, int]]:
        """The two entries whose words are those of the value, in any order, with the fewest errors."""
        joins = Counter(t for t in tokens if t in JOINING)
        read = self._readings([t for t in tokens if t not in JOINING])
        must = [x for x in read if x[1] and not x[2]]
        if not must or len(must) == 1 and must[0][0] not in self.holders and len(must[0][0]) <= LOOSE or any(not n and not noise and len(t) > LOOSE for t, n, noise in read):
            return []
        _, n, _ = min(must, key=lambda x: (len(x[0]) <= LOOSE, sum(len(self.holders[w]) for w in x[1])))
        scored = []
        for ident in {i for w in n for i in self.holders[w]}:
            cost = self.cost(read, self.tokens[ident], (self.joins[ident] - joins).total())
            if cost is not None:
                scored.append((cost, ident))
        return sorted(scored)[:2]

    @staticmethod
    def cost(near: list[tuple[str, dict[str, float], bool]], entry: list[str], lacking: int) -> float | None:
        """Errors of the alignment of a value's words with an entry's; None if a word finds no
        partner. Short words may stand in the place of joining words that are ``lacking``."""
        left, total = Counter(entry), 0.0
        for t, n, noise in sorted(near, key=lambda x: (x[2], min((e for w, e in x[1].items() if left[w]), default=99))):
            options = [(e, w) for w, e in n.items() if left[w] > 0]
            if options:
                e, w = min(options)
                left[w] -= 1
                total += e
            elif noise:
                total += 0.01
            elif len(t) <= LOOSE and lacking:
                lacking -= 1
                total += 1
            else:
                return None
        return None if any(left.values()) else total

    def best(self, value: str, further: dict[str, int] | None = None) -> list[tuple[float, int]]:
        """(cost, id) of up to two entries that a value may stand for. Costs below 0 are mentions,
        the longest first; a whole name comes before them. ``further``: the kinds of words of the
        value that change nothing by other slices of such words."""
        self.further = further or {}
        tokens = words(value)
        if not tokens or not self.of:
            return []
        direct = self.of.get(tuple(tokens))
        if direct is not None:
            return [(float("-inf"), direct)]
        found = self.mention(tokens)
        if found is not None and all(t in JOINING or self.near(t)[1] and t not in self.telling for t in found[2]):
            return [(-float(found[0]), found[1])]
        return self.similar(tokens)

    def match(self, value: str) -> int:
        """The id of the entry that a value stands for, -1 for none or two that are equally good."""
        return decide(self.best(value))


def decide(found: list[tuple[float, int]]) -> int:
    found = sorted(found)
    return -1 if not found or len(found) > 1 and found[1][0] == found[0][0] else found[0][1]


_BEST = ArrayType(StructType([StructField("cost", DoubleType()), StructField("id", LongType())]))
_FURTHER = ArrayType(StructType([StructField("w", StringType()), StructField("kind", IntegerType())]))
_LEFT = ArrayType(StructType([StructField("id", LongType()), StructField("w", StringType())]))


def map_values(values: DataFrame, value: str, entries: DataFrame, ident: str, name: str) -> DataFrame:
    """``values`` with a BIGINT column ``canon_id``: the entry meant, -1 for none and for a null,
    empty or wordless value. Long values are searched whole. Every different value is read once.

    ``entries`` with a null id or name do not count; an empty list maps everything to -1. Slices of
    the list are collected one at a time.
    """
    spark = values.sparkSession
    listed = entries.where(F.col(ident).isNotNull() & F.col(name).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(name).alias("name"))
    slices = max(1, -(-listed.count() // SLICE))
    part = lambda i: [tuple(r) for r in (listed if slices == 1 else listed.where(F.pmod(F.xxhash64("name"), F.lit(slices)) == i)).collect()]
    distinct = cut(values.select(F.col(value).alias("value")).where("value is not null").distinct().repartition(partitions(values)))  # few bytes, much work
    best, left = None, None
    for i in range(slices):
        sent = spark.sparkContext.broadcast(part(i))
        found = distinct.select(F.explode(_left_over(sent)("value")).alias("l")).select("l.*").distinct()
        left = found if left is None else left.unionByName(found)
    told = cut(left.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("w"))
    lots = max(1, -(-told.count() // MOST_NOISE))
    lot = lambda i: spark.sparkContext.broadcast(frozenset(r[0] for r in (told if lots == 1 else told.where(F.pmod(F.xxhash64("w"), F.lit(lots)) == i)).collect()))
    noise = lot(0)
    further = F.array().cast(_FURTHER)
    for i in range(1, lots):
        further = F.concat(further, _further(lot(i))("value"))
    distinct = distinct.withColumn("further", further) if lots == 1 else cut(distinct.withColumn("further", further))
    for i in range(slices):
        sent = spark.sparkContext.broadcast(part(i))
        found = distinct.select("value", _best(sent, noise)("value", "further").alias("best"))
        best = found if best is None else best.unionByName(found)
    if slices > 1:
        best = best.groupBy("value").agg(F.flatten(F.collect_list("best")).alias("best"))
    ordered = F.array_sort("best")
    tie = (F.size("best") > 1) & (F.get(ordered, F.lit(0))["cost"] == F.get(ordered, F.lit(1))["cost"])
    mapped = best.select(F.col("value").alias("canon_value"), F.when((F.size("best") == 0) | tie, F.lit(-1)).otherwise(F.get(ordered, F.lit(0))["id"]).cast("bigint").alias("canon_id"))
    return values.join(mapped, F.col(value) == F.col("canon_value"), "left").drop("canon_value").withColumn("canon_id", F.coalesce("canon_id", F.lit(-1).cast("bigint")))


def _left_over(sent):  # noqa: ANN001
    @F.pandas_udf(_LEFT)
    def left_over(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        canon = Canon(sent.value)
        for texts in batches:
            yield texts.map(lambda v: [{"id": i, "w": w} for i, w in canon.left_over(v)])

    return left_over


def _further(noise):  # noqa: ANN001
    @F.pandas_udf(_FURTHER)
    def further(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kind = functools.lru_cache(1 << 17)(Noise(noise.value).kind)
        for texts in batches:
            yield texts.map(lambda v: [{"w": t, "kind": kind(t)} for t in set(words(v)) if kind(t)])

    return further


def _best(sent, noise):  # noqa: ANN001
    @F.pandas_udf(_BEST)
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        canon = Canon(sent.value, noise.value)
        for texts, further in batches:
            out = []
            for v, more in zip(texts, further):
                kinds: dict[str, int] = {}
                for x in more:
                    kinds[x["w"]] = max(x["kind"], kinds.get(x["w"], 0))
                out.append([{"cost": c, "id": i} for c, i in canon.best(v, kinds)])
            yield pd.Series(out, dtype=object)

    return best
