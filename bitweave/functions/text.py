"""Text functions and encoders as Column expressions. All but the MinHash sketch stay in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from bitweave.functions import words as w

SPACE = r"[ \t\n\r\f]+"
FEATURES = 4096

# Words that are no entities, words that carry no content in questions.
ENTITY_STOP = """the a an in of to for and or is was are were be been being have has had do does did will would could should
may might can that this these those it its at by with from as on not who what where when why how which""".split()
CONTENT_STOP = """the a an is are was were in on at to for of with by and or not it its as from this that be has have had do does did
will would could should may can about into through during before after above below between under over out off than then also very just
because but which what who where when why how all each every both few more most some any no up down""".split()
QUESTION_WORDS = "who what where when why how which".split()
SIGNS = ".,;:!?()'\""

# Sentence patterns with relation and inverse, question patterns with the chain they ask for.
FACT_PATTERNS = [
    (r"(?i)^(.*?) (?:manufactures|develops|developed|creates|created|provides|owns) (.+?)\.?$", "makes", "made_by"),
    (r"(?i)^(.*?) was founded by (.+?)(?: in .+)?\.?$", "founded_by", "founder_of"),
    (r"(?i)^(.*?) is headquartered in (.+?)\.?$", "hq", "hq_of"),
]
QUESTION_PATTERNS = [
    (r"(?i)who founded the company (?:that|which) (?:makes|develops|created|owns|provides) (.+)\?", "made_by,founded_by"),
    (r"(?i)who founded the company based in (.+)\?", "hq_of,founded_by"),
    (r"(?i)where is the company based that was founded by (.+)\?", "founder_of,hq"),
    (r"(?i)where is the company based that (?:makes|develops|provides) (.+)\?", "made_by,hq"),
    (r"(?i)what does the company founded by (.+) make\?", "founder_of,makes"),
    (r"(?i)what does the company based in (.+) make\?", "hq_of,makes"),
    (r"(?i)who founded (.+)\?", "founded_by"),
    (r"(?i)where is (.+) (?:headquartered|based)\?", "hq"),
    (r"(?i)what does (.+) (?:make|develop|provide)\?", "makes"),
]


def split_words(text: Column) -> Column:
    """Words between blanks; empty for an empty text, null for a null one."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def low_words(text: Column) -> Column:
    return split_words(F.lower(text))


def strip_signs(x: Column, signs: str = SIGNS) -> Column:
    """Without the given signs at both ends."""
    inside = "".join("\\" + c for c in signs)
    return F.regexp_replace(F.regexp_replace(x, f"^[{inside}]+", ""), f"[{inside}]+$", "")


def norm_entity(x: Column) -> Column:
    """Lower case, without outer signs and blanks and a leading article."""
    return F.regexp_replace(F.lower(strip_signs(F.trim(x), ".,;: ")), "^the ", "")


def token_set(x: Column) -> Column:
    """Words without signs at their ends, each once."""
    return F.array_distinct(F.filter(F.transform(low_words(x), lambda t: strip_signs(t, ".,;:()'\"")), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if either is empty."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def word_overlap(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(low_words(a)), F.array_distinct(low_words(b)))


def coverage(text: Column, query: Column) -> Column:
    """Share of the query's content words (longer than two letters) that the text has."""
    strip = lambda t: strip_signs(t, ".,;:!?()")
    asked = F.array_distinct(F.transform(F.filter(low_words(query), lambda t: ~t.isin(CONTENT_STOP) & (F.length(t) > 2)), strip))
    held = F.array_distinct(F.transform(low_words(text), strip))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, held)) / F.size(asked))


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded down, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.size(split_words(text)) * F.lit(1.3))).cast("int")


def entities(text: Column) -> Column:
    """Capitalised, camel-case and all-capital words of ASCII letters, stop words left out. A word
    is a run of letters, digits and underscores of any script."""
    tokens = F.split(text, r"[^\p{L}\p{N}_]+")
    is_entity = lambda t: t.rlike("^([A-Z][a-zA-Z]*|[a-z]+[A-Z][a-zA-Z]*)$") & (F.length(t) > 1) & ~F.lower(t).isin(ENTITY_STOP)
    return F.array_distinct(F.filter(tokens, is_entity))


def entity_items(text: Column) -> Column:
    """Items of the entity sketch: entities, else words that are no stop words, else the text, else a sign for nothing."""
    found = F.array_distinct(F.transform(entities(text), F.lower))
    rest = F.array_distinct(F.filter(low_words(text), lambda t: ~t.isin(ENTITY_STOP)))
    whole = F.array(F.when(F.lower(text) == "", F.lit("∅")).otherwise(F.lower(text)))
    return F.when(F.size(found) > 0, found).when(F.size(rest) > 0, rest).otherwise(whole)


#: Items whose hashes a task remembers.
REMEMBERED = 200_000


def _item_hashes(item: str, bits: int) -> np.ndarray:
    """For every salt j, the first eight bytes of md5("j|" + md5(item)) as a little-endian integer."""
    inner = hashlib.md5(item.encode()).digest()
    return np.frombuffer(b"".join(hashlib.md5(f"{j}|".encode() + inner).digest()[:8] for j in range(bits)), dtype="<u8")


def minhash(items: Column, words: int) -> Column:
    """One-bit MinHash sketch: bit j is the lowest bit of the smallest of the items' hashes under
    salt j. Here bit 1 stands for the value +1. Null for null or no items.

    Items recur, so a task hashes each once and remembers it; the rest is arithmetic on arrays. The
    same in SQL functions hashes every item of every row anew, some fifty times the work.
    """
    bits = 32 * words

    @F.pandas_udf(ArrayType(LongType()))
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}
        weights = np.left_shift(np.uint64(1), np.arange(32, dtype=np.uint64))
        for batch in batches:
            out = []
            for row in batch:
                if row is None or not len(row):
                    out.append(None)
                    continue
                hashes = []
                for x in row:
                    h = known.get(x)
                    if h is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        h = known[x] = _item_hashes(x, bits)
                    hashes.append(h)
                low = np.minimum.reduce(hashes) & np.uint64(1)
                out.append((low.reshape(words, 32) * weights).sum(axis=1).astype(np.int64).tolist())
            yield pd.Series(out)

    return sketch(items)


def hashed_features(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, bucket, w2): hashed words (weight 2) and pairs of neighbours (weight 1), summed per bucket."""
    ws = df.select(ident, low_words(F.col(text)).alias("ws"))
    pairs = F.zip_with(F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0))), F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    both = F.concat(F.transform("ws", lambda t: F.struct(t.alias("t"), F.lit(2).alias("n"))), F.transform(pairs, lambda t: F.struct(t.alias("t"), F.lit(1).alias("n"))))
    bucket = F.conv(F.substring(F.md5(F.col("f.t")), 30, 3), 16, 10).cast("int")
    return ws.select(ident, F.explode(both).alias("f")).groupBy(ident, bucket.alias("bucket")).agg(F.sum("f.n").cast("int").alias("w2"))


def ngram_state(df: DataFrame, ident: str, text: str, low: int = 2, high: int = 5, words: int = 8) -> DataFrame:
    """(ident, hit): the buckets of all character n-grams, as bits. Setting a bit twice changes
    nothing, so no distinct is needed before the aggregate."""
    t = F.lower(F.col(text))

    # Characters are split once; each length of n-gram extends the one before, so a text of any
    # length costs time in proportion to it.
    made = df.select(ident, F.regexp_extract_all(t, F.lit("(?s)."), 0).alias("c")).withColumn("g1", F.col("c"))
    for n in range(2, high + 1):
        size = F.greatest(F.size("c") - n + 1, F.lit(0))
        made = made.withColumn(f"g{n}", F.zip_with(F.slice(f"g{n - 1}", F.lit(1), size), F.slice("c", F.lit(n), size), lambda a, b: F.concat(a, b)))
    rows = made.select(ident, F.explode(F.concat(*[F.col(f"g{n}") for n in range(low, high + 1)])).alias("g"))
    bucket = F.conv(F.substring(F.md5("g"), 31, 2), 16, 10).cast("int") % (32 * words)
    placed = rows.select(ident, bucket.alias("b")).select(ident, F.expr("b div 32").cast("int").alias("w"), F.expr("shiftleft(1L, b % 32)").alias("v"))
    by_word = placed.groupBy(ident, "w").agg(F.bit_or("v").alias("v"))
    made = by_word.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    return made.select(ident, F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("bigint"))).alias("hit"))


def sentences(text: Column) -> Column:
    """Sentences, split after a stop only where a capital follows."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])[ \t\n\r\f]+(?=[A-Z])"), F.trim), lambda s: s != "")


def extract_triples(sentence: Column) -> Column:
    """Array of (s, r, o): the first fact pattern that fits, forward and inverse."""
    out = F.array().cast("array<struct<s:string,r:string,o:string>>")
    for pattern, rel, inverse in reversed(FACT_PATTERNS):
        s, o = norm_entity(F.regexp_extract(sentence, pattern, 1)), norm_entity(F.regexp_extract(sentence, pattern, 2))
        made = F.array(F.struct(s.alias("s"), F.lit(rel).alias("r"), o.alias("o")), F.struct(o.alias("s"), F.lit(inverse).alias("r"), s.alias("o")))
        out = F.when(sentence.rlike(pattern), F.when((s != "") & (o != ""), made).otherwise(F.array().cast("array<struct<s:string,r:string,o:string>>"))).otherwise(out)
    return out


def plan_question(question: Column) -> Column:
    """(anchor, chain) of the first question pattern that fits; null if none does."""
    out = F.lit(None).cast("struct<anchor:string,chain:array<string>>")
    for pattern, chain in reversed(QUESTION_PATTERNS):
        made = F.struct(norm_entity(F.regexp_extract(question, pattern, 1)).alias("anchor"), F.split(F.lit(chain), ",").alias("chain"))
        out = F.when(question.rlike(pattern), made).otherwise(out)
    return out


def norm_answer(x: Column) -> Column:
    """Lower case letters and digits without articles, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "  "), F.lit(" ")), r" (a|an|the) ", " "), " +", " "))


def answer_tokens(x: Column) -> Column:
    small = ["of", "in", "and", "on", "to", "by", "for", "with"]
    return F.array_distinct(F.transform(F.filter(F.split(norm_answer(x), " "), lambda t: (t != "") & ~t.isin(small)), lambda t: F.regexp_replace(t, "s+$", "")))


def answers_match(a: Column, b: Column) -> Column:
    """Whether the tokens of one answer are all among those of the other; never for empty ones."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def query_entity(question: Column) -> Column:
    """What a question is about: its last word with a capital, with the one right before it; else
    its last two content words; else nothing."""
    plain = F.transform(split_words(question), lambda t: strip_signs(t, ".,;:!?()'"))
    skip = lambda t: F.lower(t).isin(CONTENT_STOP) | F.lower(t).isin(QUESTION_WORDS)
    placed = F.transform(plain, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    capital = F.filter(placed, lambda p: p["t"].rlike("[A-Z]") & p["t"].rlike("^[A-Za-z]{2,}$") & ~skip(p["t"]))
    content = F.filter(placed, lambda p: p["t"].rlike("^[A-Za-z]{3,}$") & ~skip(p["t"]))
    last = lambda a, k: F.when(F.size(a) >= k, F.element_at(a, F.lit(-k)))

    def joined(a: Column, always: bool) -> Column:
        one, two = last(a, 1), last(a, 2)
        pair = F.concat_ws(" ", two["t"], one["t"])
        return F.when(F.size(a) == 0, None).when(two.isNull() if always else two.isNull() | (two["i"] != one["i"] - 1), one["t"]).otherwise(pair)

    return w.let(capital, lambda c: w.let(content, lambda n: F.coalesce(joined(c, False), joined(n, True), F.lit(""))))


def bridge_entity(chunk: Column, question: Column) -> Column:
    """The first capitalised word of a passage that the question lacks, else its longest new word."""
    asked = low_words(question)
    words_ = F.transform(split_words(chunk), lambda t: strip_signs(t, ".,;:!?()[]'\""))

    def new(qs: Column) -> Column:
        return F.filter(words_, lambda t: t.rlike(r"^[A-Za-z.]{2,}$") & ~F.array_contains(qs, F.lower(t)) & ~F.lower(t).isin(CONTENT_STOP))

    def pick(c: Column) -> Column:
        proper = F.filter(c, lambda t: t.rlike("^[A-Z]"))
        longest = F.aggregate(c, F.lit(""), lambda s, t: F.when(F.length(t) > F.length(s), t).otherwise(s))
        return F.when(F.size(proper) > 0, F.get(proper, F.lit(0))).otherwise(longest)

    return w.let(asked, lambda qs: w.let(new(qs), pick))


def int_to_bits(x: Column, bits: int = 12) -> Column:
    """Bits, most significant first."""
    return F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), lambda i: F.getbit(x, i).cast("int"))


def chunk_words(text: Column, size: int = 200) -> Column:
    """Chunks of ``size`` words joined by blanks."""
    return w.let(split_words(text), lambda ws: F.transform(
        F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(ws) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(ws, i * size + 1, size), " ")))
