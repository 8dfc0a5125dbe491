"""Text cut off by field limits or in transfer, found by self-joins on prefixes.

Whole values first: a text that is a strict prefix of a longer one elsewhere, which goes on in the
same line, was cut. Texts are joined on hashed prefixes of fixed lengths, the powers of two: of a
pair that shares the largest power in the shorter length, the longer one is then hashed at exactly
the lengths asked of it. Both joins are on equal hashes; a text costs a row per power of two.

Texts are seldom stored again in full, but what they are made of is: the last segment (sentence or
line) of a cut text is a strict prefix of longer segments elsewhere, while a complete one stands
elsewhere as it is. Segments are compared as patterns: names, identifiers and digits stand for any
other. Every segment of the corpus goes into an index of its prefixes, hashed token by token: which
token follows the prefix, or that the segment ends there. The last segments are joined with the
index on the hash of the whole of them (does it end there, does it go on) and on the hash of all
but their last token (is that token the beginning of a longer one).

Where a pattern leaves it open (the text ends with a name or an identifier, which may be cut too)
the last word is joined with the words of the corpus in the same way: whether it stands elsewhere
at the end of a name, only inside of names, or only as a beginning of longer words.

The index is built with counts combined in each task before the shuffle: segments by pattern, of
which a corpus has far fewer than segments, and only then their prefixes. It is linear in the text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.session import spread, stored

#: Rows that a task combines before it passes them on.
COMBINED = 300_000
END = ""
_LINES = regex.compile(r"[\r\n]+")
_TOKEN = regex.compile(r"(?P<name>\p{Lu}[\p{L}\p{M}\d_’'-]*\.?)|(?P<ident>\p{Ll}[\p{L}\p{M}\d]*(?:[_-][\p{L}\p{M}\d_-]*)+)|(?P<cjk>[\p{Han}\p{Hiragana}\p{Katakana}ー])|(?P<word>[\p{L}\p{M}]+)|(?P<number>\d+(?:[.,:]\d+)*[.,]?)|(?P<sign>\S)")
_MARK_ONLY = regex.compile(r"…|\.{3,}|�|\[(?:…|\.\.\.|truncated|cut|more)\]|\((?:truncated|cut|more)\)|<truncated>", regex.IGNORECASE)
_PICTURE = regex.compile(r"\p{Extended_Pictographic}")
_STOP = regex.compile(r"[.。]+$")


#: (kind, text, patterns) of a token: N for a name, I for an identifier, 0 for each digit, other words
#: in lower case, signs as they are; a full stop or comma after a name or number stands apart.
Token = tuple[str, str, tuple[str, ...]]
_DIGITS = str.maketrans("123456789", "000000000")
_ENDS = regex.compile(r"[.!?…][\"”’'»)\]]?$")
_INITIAL = regex.compile(r"\b\p{Lu}\.$")
_NUMBERED = regex.compile(r"\d{1,3}\.$")
_CJK_STOP = regex.compile(r"(?<=[。！？])")


@functools.lru_cache(1 << 18)
def _chunk(chunk: str) -> tuple[tuple[Token, ...], bool]:
    """The tokens of a text without blanks, and whether a sentence ends with it."""
    out: list[Token] = []
    for m in _TOKEN.finditer(chunk):
        kind, text = m.lastgroup, m[0]
        if kind == "name":
            out.append((kind, text, ("N", ".") if text[-1] == "." and len(text) > 2 else ("N",)))  # not an initial's stop
        elif kind == "ident":
            out.append((kind, text, ("I",)))
        elif kind == "number":
            stop = text[-1] if text[-1] in ".," else ""
            body = (text[:-1] if stop else text).translate(_DIGITS)
            out.append((kind, text, (body, stop) if stop else (body,)))
        else:
            out.append((kind, text, (text.lower(),)))
    return tuple(out), bool(_ENDS.search(chunk)) and not _INITIAL.search(chunk)


def segments(text: str) -> list[list[str]]:
    """Sentences and lines of a text, as their chunks between blanks."""
    out: list[list[str]] = []
    for line in _LINES.split(unicodedata.normalize("NFC", text)):
        for part in _CJK_STOP.split(line) if "。" in line or "！" in line or "？" in line else (line,):
            chunks = part.split()
            start = 0
            for i, c in enumerate(chunks):
                if _chunk(c)[1] and not (i == 0 and _NUMBERED.match(c)):
                    out.append(chunks[start : i + 1])
                    start = i + 1
            if start < len(chunks):
                out.append(chunks[start:])
    return out


def _raw(segment: list[str]) -> list[Token]:
    return [t for c in segment for t in _chunk(c)[0]]


def _pattern(raw: list[Token]) -> list[str]:
    """The patterns of the tokens, runs of names as one."""
    out: list[str] = []
    for _, _, patterns in raw:
        if patterns[0] == "N" and out and out[-1] == "N":
            out += patterns[1:]
        else:
            out += patterns
    return out


def _patterns(raw: list[Token]) -> list[tuple[str, ...]]:
    """A segment's pattern without a final full stop, and where it begins with a capital also the one
    that spells out its first word: the beginning of a sentence is not always a name."""
    whole = _pattern(raw)
    out = [_ended(whole)]
    if raw[0][0] == "name":
        first = raw[0]
        after = whole[1:] if len(raw) == 1 or raw[1][2][0] != "N" or len(first[2]) > 1 else whole
        if len(first[2]) > 1:
            after = whole[2:]
        stop = [first[2][1]] if len(first[2]) > 1 else []
        out.append(_ended(["^" + first[1].rstrip(".").lower(), *stop, *after]))
    return out


def _ended(found: list[str]) -> tuple[str, ...]:
    """Without a final full stop: a complete text may lack it."""
    n = len(found)
    while n and found[n - 1] in (".", "。"):
        n -= 1
    return tuple(found[:n])


@functools.lru_cache(1 << 16)
def _token_hash(pattern: str) -> int:
    return xxhash.xxh64_intdigest(pattern)


def hashes(found: tuple[str, ...]) -> list[int]:
    """Hash of every prefix, from the empty one to the whole: each extends the one before."""
    state, out = 0x9E3779B97F4A7C15, [0]
    for pattern in found:
        state = ((state ^ _token_hash(pattern)) * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 32
        out.append(state - (1 << 63))
    return out


def _strip(text: str) -> tuple[str, bool]:
    """A text without blanks and emoji at its end and without a mark set at a cut; whether a
    character was broken there."""
    text = text.rstrip()
    broken = text.endswith("�")
    before = None
    while before != text:
        before = text
        text = text.rstrip()
        at = len(text)
        while at and not text[at - 1].isascii() and (text[at - 1] in "‍️" or text[at - 1].isspace() or _PICTURE.match(text[at - 1])):
            at -= 1
        text = text[:at].rstrip()
        if text and text[-1] in "….�])>":
            text = _unmarked(text)
    return text, broken


def _unmarked(text: str) -> str:
    """Without the last mark."""
    for n in range(1, 13):  # marks are short
        if _MARK_ONLY.fullmatch(text[-n:]):
            return text[:-n]
    return text


def _count_words(raw: list[Token], last: bool, seen: dict[str, list[int]]) -> None:
    """Counts how often a word ends its run, or goes on to another name (a name) or word. The last
    word of a text is left out, and names that begin a segment, where any word is written like one."""
    final = len(raw) - 1
    for j, (kind, text, patterns) in enumerate(raw):
        if kind == "word":
            if j == final and last:
                continue
            goes_on = j != final and raw[j + 1][0] != "sign"
        elif kind == "name" or kind == "ident":
            if j == final and last or not j and kind == "name" and text[-1] != ".":
                continue
            stop = len(patterns) > 1
            goes_on = kind == "name" and j != final and raw[j + 1][0] == "name" and not stop
            if stop:
                text = text[:-1]
        else:
            continue
        counts = seen.get(text)
        if counts is None:
            counts = seen[text] = [0, 0]
        counts[goes_on] += 1


def _same(bare: str) -> int:
    """Equal for texts that differ only in what was set at their end: blanks, marks or a full stop."""
    return xxhash.xxh64_intdigest(_STOP.sub("", unicodedata.normalize("NFC", bare))) - (1 << 63)


def _asked(text: str, bare: str, broken: bool, segment: list[str], raw: list[Token]) -> dict | None:
    """What is asked about a text's end, of its last segment; None for one without a token."""
    if not raw:
        return None
    kind, word, patterns = raw[-1]
    # A full stop after an initial does not end a sentence.
    stop = segment[-1][-1] in ".!?。！？”»" and not (kind == "name" and len(word) == 2)
    if kind == "name" and len(patterns) > 1:
        word = word[:-1]
    asked = []
    for f in _patterns(raw):
        if f:
            keys = hashes(f)
            asked.append((keys[-1], keys[-2], f[-1]))
    if not asked:
        return None
    first = asked[0]
    second = asked[1] if len(asked) > 1 else (None, None, None)
    return {"same": _same(bare), "bare": len(bare), "broken": broken, "mark": len(bare) < len(text.rstrip()) and _marked(text, bare), "stop": stop, "kind": kind, "word": word, "k1": first[0], "p1": first[1], "t1": first[2], "k2": second[0], "p2": second[1], "t2": second[2]}


def _marked(text: str, bare: str) -> bool:
    """Whether a mark, and not only emoji and blanks, was taken from a text's end."""
    return any(not c.isspace() and c not in "‍️" and not _PICTURE.match(c) for c in text[len(bare) :])


_LAST = "same bigint, bare int, broken boolean, mark boolean, stop boolean, kind string, word string, k1 bigint, p1 bigint, t1 string, k2 bigint, p2 bigint, t2 string"
_LAST_NAMES = [x.split()[0] for x in _LAST.split(", ")]
_LAST_TYPES = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64()}
_ROW = "what int, key bigint, next string, follows int, n bigint, inside bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the distinct texts. what 0: n times ``next`` follows the prefix ``key``: a token
    (follows 0), or the end of a segment known to be whole (1). what 1: the word ``next`` ends n runs
    and is inside of others. what 2: a text's end."""
    whole: dict[tuple[tuple[str, ...], bool], int] = {}
    words: dict[str, list[int]] = {}
    row_types = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    row_names = [x.split()[0] for x in _ROW.split(", ")]
    last_types = [_LAST_TYPES[x.split()[1]] for x in _LAST.split(", ")]
    ident_type = None

    def rows() -> pa.RecordBatch:
        seen: dict[tuple[int, str, int], int] = {}
        for (found, last), n in whole.items():
            keys = hashes(found)
            for e in zip(keys, found, [0] * len(found)):
                seen[e] = seen.get(e, 0) + n
            if not last:
                e = (keys[-1], END, 1)
                seen[e] = seen.get(e, 0) + n
        keys, ws = list(seen), list(words)
        columns = [
            [0] * len(keys) + [1] * len(ws), [k[0] for k in keys] + [None] * len(ws), [k[1] for k in keys] + ws, [k[2] for k in keys] + [None] * len(ws),
            list(seen.values()) + [words[x][0] for x in ws], [None] * len(keys) + [words[x][1] for x in ws],
        ]
        n = len(keys) + len(ws)
        arrays = [pa.array(c, t) for c, t in zip(columns, row_types)] + [pa.nulls(n, ident_type)] + [pa.nulls(n, t) for t in last_types]
        whole.clear()
        words.clear()
        return pa.RecordBatch.from_arrays(arrays, names=[*row_names, "ident", *_LAST_NAMES])

    for batch in batches:
        ident_type = batch.schema.types[0]
        keep, ends = [], []
        for at, text in enumerate(batch.column(1).to_pylist()):
            bare, broken = _strip(text)
            parts = segments(bare)
            raw: list[Token] = []
            for i, segment in enumerate(parts):
                last = i == len(parts) - 1
                raw = _raw(segment)
                if raw:
                    for found in _patterns(raw):
                        if found:
                            whole[found, last] = whole.get((found, last), 0) + 1
                    _count_words(raw, last, words)
            asked = _asked(text, bare, broken, parts[-1], raw) if parts else None
            if asked is not None:
                keep.append(at)
                ends.append(asked)
            if len(whole) * 30 + len(words) > COMBINED:
                yield rows()
        n = len(keep)
        if n:
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            arrays = [pa.array([2] * n, pa.int32())] + [pa.nulls(n, t) for t in row_types[1:]] + [ids] + [pa.array([r[c] for r in ends], t) for c, t in zip(_LAST_NAMES, last_types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*row_names, "ident", *_LAST_NAMES])
    if whole or words:
        yield rows()


#: Letters up to which every beginning of a word is an entry of the index; longer ones share the first ones.
LETTERS = 64
#: Rows of 20 bytes up to which the lengths asked are sent to every task; beyond, texts are shuffled.
SENT = 200_000


def _beginnings(asked: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, t, n): how often (n) a longer word of ``words`` (*keys, next, n) begins with the word t
    that is ``asked`` (*keys, t) for. A join on equal beginnings: those of up to ``LETTERS`` letters
    are entries of their own; a longer t meets the longer words that share its first letters."""
    asked = asked.distinct()
    short = asked.where(F.length("t") <= LETTERS)
    entries = words.where(F.length("next") >= 2).select(*keys, "n", F.explode(F.expr(f"transform(sequence(1, least({LETTERS}, length(next) - 1)), i -> left(next, i))")).alias("t"))
    found = entries.join(short, [*keys, "t"], "left_semi").select(*keys, "t", "n")
    head = lambda d, c: d.where(F.length(c) > LETTERS).withColumn("head", F.expr(f"left({c}, {LETTERS})"))
    far = head(asked, "t").join(head(words, "next"), [*keys, "head"]).where((F.col("next") != F.col("t")) & F.startswith("next", "t")).select(*keys, "t", "n")
    return found.unionByName(far).groupBy(*keys, "t").agg(F.sum("n").alias("n"))


def prefix_of_longer(asking: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct ``ident`` of ``asking`` (ident, text) that are strict prefixes of longer ones among
    ``texts`` (text, distinct, a stored table) that go on in the same line, not just with a full stop.

    A text has an entry for the hash of its first 2**i letters, for every i. Of a text of n letters
    the entry of the largest 2**i <= n asks all texts with that entry for the hash of their first n
    letters; those are compared with the hash of the whole. A text that is asked for one length by
    many answers once, so headers that many texts share cost a row per length asked and text."""
    begun = F.xxhash64(F.expr("left(text, shiftleft(1, i))")).alias("h")
    own = stored(asking.withColumn("n", F.length("text")).where("n > 0").withColumn("i", F.expr("cast(floor(log2(n)) as int)")).select("ident", "n", "i", begun, F.xxhash64("text").alias("whole")), "asking")
    entries = texts.select("text", F.length("text").alias("size")).where("size > 1").withColumn("i", F.explode(F.expr("sequence(0, cast(floor(log2(size)) as int))")))
    entries = entries.select(F.xxhash64("text").alias("of"), "size", "i", begun)
    asked = stored(entries.join(own.select("i", "h", "n").distinct(), ["i", "h"]).where("n < size").select("of", "size", "n").distinct(), "asked")
    if asked.count() <= SENT:
        asked = F.broadcast(asked)
    after = F.expr("substring(text, n + 1, 64)")
    hashed = texts.select("text", F.xxhash64("text").alias("of"), F.length("text").alias("size"))
    answers = hashed.join(asked, ["of", "size"]).where(after.rlike(r"^[ \t]*[^\s.。…]")).select("n", F.xxhash64(F.expr("left(text, n)")).alias("whole")).distinct()
    return own.join(answers, ["n", "whole"], "left_semi").select("ident").distinct()


def judged_texts(df: DataFrame, text: str) -> DataFrame:
    """(ident, branch, cut) of every distinct text that is not null, empty or blank, ident being its
    md5. ``branch`` says what decided: broken (a broken character at the end), stop (a sentence ends
    there), copy (the text is a prefix of a longer one), whole or begins (its last segment ends, or
    goes on, elsewhere) or word (only the last word tells).
    """
    texts = df.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
    once = stored(texts.select(F.col(text).alias("text")).distinct().select(F.md5("text").alias("ident"), "text"), "texts")
    read = stored(spread(once).mapInArrow(_read, f"{_ROW}, ident string, {_LAST}"), "read")
    trie = stored(read.where("what = 0").groupBy("key", "next", F.col("follows").alias("kind")).agg(F.sum("n").alias("n")), "prefixes")
    asked = read.where("what = 2").select("ident", *_LAST_NAMES)
    spelled = asked.select(
        "ident", "kind", "same",
        F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"k{v}").alias("k"), F.col(f"p{v}").alias("p"), F.col(f"t{v}").alias("t")) for v in (2, 1)])).alias("s"),
    ).select("ident", "kind", "same", "s.*").where("k is not null")

    # Join on whole values.
    open_ = asked.where("not broken and (mark or not stop)").select("ident", "bare")
    copies = prefix_of_longer(once.join(open_, "ident").select("ident", F.expr("left(text, bare)").alias("text")), once.select("text")).withColumn("copy", F.lit(True))

    # Join on the whole segment: does it end elsewhere, does it go on.
    wanted = spelled.select(F.col("k").alias("key")).distinct()
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    whole = trie.join(wanted, "key", "left_semi").groupBy("key").agg(n(F.col("kind") == 0).alias("more"), n(F.col("kind") == 1).alias("whole"))
    # Texts that end with the segment, whatever mark is set there.
    ends = spelled.groupBy("k").agg(F.count_distinct("same").alias("last"))
    # Join on all but the last token: is that one the beginning of a longer token.
    probes = spelled.select("p", "t", "kind").distinct()
    follows = trie.where("kind = 0").withColumnRenamed("key", "p").select("p", "next", "n")
    integer = F.col("t").rlike("^0+$")
    longer = _beginnings(probes.where(~F.col("t").isin("N", "I") & ~integer).select("p", "t"), follows, ["p"]).withColumnRenamed("n", "longer")
    identifiers = follows.where("next = 'I'").groupBy("p").agg(F.sum("n").alias("identifiers"))
    # A whole number may be of any length, unless nine in ten of those that follow here are longer.
    lengths = follows.where(F.col("next").rlike("^0+$")).groupBy("p", F.length("next").alias("digits")).agg(F.sum("n").alias("n"))
    numbers = probes.where(integer).select("p", "t").distinct().join(lengths, "p").groupBy("p", "t").agg(n(F.col("digits") > F.length("t")).alias("long_numbers"), F.sum("n").alias("numbers"))
    parts = probes.join(longer, ["p", "t"], "left").join(identifiers, "p", "left").join(numbers, ["p", "t"], "left").na.fill(0).select(
        "p", "t", "kind", ((F.col("longer") > 0) | (F.col("kind") == "word") & (F.col("identifiers") > 0) | (F.col("long_numbers") * 10 > F.col("numbers") * 9) & (F.col("numbers") > 10)).alias("part"))
    seen = spelled.join(ends, "k").join(whole.withColumnRenamed("key", "k"), "k", "left").join(parts, ["p", "t", "kind"], "left").na.fill({"more": 0, "whole": 0, "part": False})
    # The pattern that spells out the first word goes before the other, where the corpus knows it.
    known = (F.col("more") > 0) | (F.col("whole") > 0) | (F.col("last") > 1) | F.col("part")
    judged = seen.groupBy("ident").agg(F.max(F.struct(known, "v", "more", "whole", "last", "part")).alias("e")).select("ident", "e.more", "e.whole", "e.last", "e.part")

    # Join on the last word: does it stand elsewhere at the end of a name, or as a beginning only.
    last_words = asked.where("kind in ('name', 'ident', 'word')").select("word").distinct()
    words = stored(read.where("what = 1").groupBy(F.col("next").alias("word")).agg(F.sum("n").alias("ends"), F.sum("inside").alias("inside")), "words")
    begins = _beginnings(last_words.select(F.col("word").alias("t")), words.select(F.col("word").alias("next"), F.lit(1).alias("n")), []).select(F.col("t").alias("word"), F.lit(True).alias("begins"))
    about = last_words.join(words, "word", "left").join(begins, "word", "left").na.fill({"ends": 0, "inside": 0, "begins": False})

    is_whole = (F.col("whole") > 0) | (F.col("last") >= 3) & (F.col("last") >= F.col("more")) & ~F.col("part")
    goes_on = (F.col("more") > 0) | F.col("part")
    unfinished = (F.col("ends") * 50 < F.col("inside")) | (F.col("ends") + F.col("inside") == 0) & F.col("begins")
    found = (
        asked.select("ident", "broken", "mark", "stop", "kind", "word").join(judged, "ident").join(about, "word", "left").join(copies, "ident", "left")
        .na.fill({"ends": 0, "inside": 0, "begins": False, "copy": False})
    )
    named = F.col("kind").isin("name", "ident")
    branch = (
        F.when(F.col("broken"), "broken").when(F.col("stop") & ~F.col("mark"), "stop").when(F.col("copy"), "copy")
        .when(is_whole, F.when(named & unfinished & ~F.col("stop"), "word").otherwise("whole")).when(goes_on, "begins").otherwise("word")
    )
    is_cut = (
        F.when(F.col("broken"), True).when(F.col("stop") & ~F.col("mark"), False).when(F.col("copy"), True)
        .when(is_whole, named & unfinished & ~F.col("stop")).when(goes_on, True)
        .otherwise(F.col("kind").isin("name", "ident", "word") & unfinished)
    )
    return found.select("ident", branch.alias("branch"), is_cut.alias("cut"))


def cut_texts(df: DataFrame, ident: str, text: str) -> DataFrame:
    """The ``ident`` of every row whose text was cut, so that it ends inside a word or a sentence.

    Null, empty and blank texts are not cut. A mark set at the cut ("...", a broken character) does
    not make a text complete, a missing full stop does not make it cut. Texts are read whole.
    Repeated ones are judged alike and count once, so that copies do not vouch for each other. Other
    columns are not read.
    """
    texts = df.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
    cut_once = judged_texts(df, text).where("cut").select(F.col("ident").alias("digest"))
    return texts.select(F.col(ident), F.md5(F.col(text)).alias("digest")).join(cut_once, "digest", "left_semi").select(ident).distinct()


def cut_shares(df: DataFrame, ident: str, text: str, source: str) -> DataFrame:
    """(``source``, texts, cut, share) of every source, null sources together. Texts are those not
    null; ``ident`` must be unique for the counts to be of texts."""
    cut_ids = cut_texts(df, ident, text).select(F.col(ident).alias("cut_ident"))
    texts = df.where(F.col(text).isNotNull()).select(F.col(ident).alias("ident"), F.col(source).alias("origin"))
    joined = texts.join(cut_ids, texts["ident"] == cut_ids["cut_ident"], "left")
    counted = joined.groupBy("origin").agg(F.count("*").alias("texts"), F.count("cut_ident").alias("cut"))
    return counted.select(F.col("origin").alias(source), "texts", "cut", F.round(F.col("cut") / F.col("texts"), 6).alias("share"))
