"""Bit-vector algebra as Column expressions.

A state of D bits is an ARRAY<BIGINT> of D/32 words, each from 0 to 2**32 - 1, least significant bit
first; bit 1 stands for the value -1, so XOR is the elementwise product. Everything here stays in
the JVM. Word loops of up to ``UNROLLED`` words are written out, so that they compile into the
whole-stage code; longer ones use higher-order functions, since a method of that size would stay
beyond what the just-in-time compiler takes (measured: 32 words written out are 8 times slower).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
UNROLLED = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def item(name: Column, words: int) -> Column:
    """The state of a name: every four words are the 32 hex digits of md5(lower(name)#k). Names
    that differ in letter case share a state. Null for a null name."""
    lower = F.lower(name)
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit((words - 1) // 4)), lambda k: F.md5(F.concat(lower, F.lit("#"), k.cast("string")))), "")
    word = lambda d: lambda w: F.conv(F.substring(d, w * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
    made = let(digits, lambda d: F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word(d)))
    return F.when(name.isNotNull(), made)


def bind(a: Column, b: Column) -> Column:
    """Elementwise product; its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def rho(a: Column, k: int, words: int) -> Column:
    """Cyclic shift of the bits by k places upwards."""
    k %= 32 * words
    whole, bits = divmod(k, 32)
    at = lambda v, back: F.slice(F.concat(v, v), words - back % words + 1, words)
    if not bits:
        return let(a, lambda v: at(v, whole))
    word = lambda x, low: F.shiftleft(x, bits).bitwiseOR(F.shiftright(low, 32 - bits)).bitwiseAND(F.lit(MASK))
    return let(a, lambda v: F.zip_with(at(v, whole), at(v, whole + 1), word))


def hamming(a: Column, b: Column, words: int) -> Column:
    """Number of bits that differ. Written out per word, so a and b should be columns, not expressions."""
    if words <= UNROLLED:
        return reduce(lambda s, i: s + F.bit_count(a[i].bitwiseXOR(b[i])), range(1, words), F.bit_count(a[0].bitwiseXOR(b[0])))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, c: s + c)


def ones(a: Column) -> Column:
    """Number of bits set."""
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(x))


def dot(a: Column, b: Column, words: int) -> Column:
    """Dot product of the +1/-1 vectors."""
    return F.lit(32 * words) - 2 * hamming(a, b, words)


def inverted(a: Column) -> Column:
    return F.transform(a, lambda x: F.lit(MASK) - x)


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def alike(a: Column, b: Column) -> Column:
    """Bits in which both agree (XNOR)."""
    return F.zip_with(a, b, lambda x, y: F.lit(MASK) - x.bitwiseXOR(y))


def majority3(a: Column, b: Column, c: Column) -> Column:
    """Bitwise majority of three."""
    return either(either(both(a, b), both(b, c)), both(a, c))


def pack(bits: Column, words: int) -> Column:
    """Array of 32 * words booleans or 0/1 integers to words."""
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"),
        lambda s, j: s + F.when(F.element_at(bits, (w * 32 + j + 1).cast("int")).cast("int") == 1, F.expr("1L")).otherwise(0) * F.pow(F.lit(2), j).cast("bigint"),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


def unpack(a: Column) -> Column:
    """Words to an array of 0/1 integers."""
    return F.flatten(F.transform(a, lambda x: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.getbit(x, j).cast("int"))))


def bit(a: Column, j: Column) -> Column:
    """Bit j of a state, as 0 or 1."""
    return F.getbit(F.element_at(a, (F.floor(j / 32) + 1).cast("int")), (j % 32).cast("int")).cast("int")
