"""One consistent form for text that looks the same: confusables skeletons.

The skeleton of a text: decompose, drop what is invisible, replace every character by the prototype
of its look-alikes, decompose again. Texts look the same exactly when their skeletons are equal.
Character width, invisible characters, the kind of blank and blanks at either end are no difference
in look; letter case, accents, raised digits and fractions are.

The look-alikes are those of the public Unicode confusables, whole; width, ligatures and blanks
follow from the character database. The form that is returned composes the skeleton (NFC).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Compatibility decompositions that change width, spacing or ligature but not the look.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>")
#: Letters with a compatibility decomposition that looks different: long s and its ligature.
_OTHER_LOOK = "ſſtﬅ"


_BLANKS = "\t\n\r\x0b\x0c\x85"
_BLOCK = 20_000


def _own_look(c: str) -> str:
    """A character without what makes no difference in look: nothing for what is invisible, a plain
    blank for any kind of blank, letters for their widths and ligatures."""
    kind = unicodedata.category(c)
    if kind in ("Cf", "Cc") and c not in _BLANKS or kind == "Mn" and unicodedata.name(c, "").startswith("VARIATION SELECTOR") or ord(c) in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5):
        return ""
    if kind in ("Zs", "Zl", "Zp") or c in _BLANKS:
        return " "
    how, _, parts = unicodedata.decomposition(c).partition(" ")
    if how in _SAME_LOOK and c not in _OTHER_LOOK:
        return "".join(chr(int(x, 16)) for x in parts.split())
    return c


def prototypes(spark: SparkSession) -> dict[int, str]:
    """Code point to prototype, "" for what is invisible, of every assigned character that is not its
    own. Look-alikes are those of the Unicode confusables (UTS 39), all of them, as the library for
    Unicode that Spark brings along knows them; the table is made once for a session on the driver,
    asking for all characters in a few texts, and has a fixed size."""
    made = getattr(spark, "_bitweave_prototypes", None)
    if made is not None:
        return made
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    points = [chr(p) for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) not in ("Cn", "Co", "Cs") and chr(p) != "\n"]
    like: dict[str, str] = {}
    for i in range(0, len(points), _BLOCK):
        block = points[i : i + _BLOCK]
        like.update(zip(block, checker.getSkeleton("\n".join(block)).split("\n"), strict=True))
    table: dict[int, str] = {}
    for c in ["\n", *points]:
        to = unicodedata.normalize("NFD", _own_look(c))
        for _ in range(4):  # prototypes of the parts of a decomposition
            new = unicodedata.normalize("NFD", "".join(like.get(x, x) if _own_look(x) == x else _own_look(x) for x in to))
            if new == to:
                break
            to = new
        if to != c:
            table[ord(c)] = to
    _keep_case(table, points)
    spark._bitweave_prototypes = table
    return table


def _keep_case(table: dict[int, str], points: list[str]) -> None:
    """Case is a difference in look: where a letter has the prototype of its own capital, and that is
    none of ASCII, capitals and small letters of that look get prototypes of their own."""
    proto = lambda c: table.get(ord(c), c)
    both = {proto(c) for c in points if len(c.lower()) == 1 and c.lower() != c and proto(c) == proto(c.lower())}
    both -= {proto(chr(p)) for p in range(128)}
    alike: dict[tuple[str, str], list[str]] = {}
    for c in points:
        if proto(c) in both and (kind := unicodedata.category(c)) in ("Lu", "Ll"):
            alike.setdefault((proto(c), kind), []).append(c)
    for letters in alike.values():
        for c in letters:
            table[ord(c)] = letters[0]


def skeleton(text: str, table: dict[int, str]) -> str:
    """Skeleton of one text, composed. Idempotent."""
    text = unicodedata.normalize("NFD", text).translate(table)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text)).strip(" ")


def _skeletons(spark: SparkSession) -> Callable[[Column], Column]:
    sent = spark.sparkContext.broadcast(prototypes(spark))

    @F.pandas_udf(StringType())
    def skeletons(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = sent.value
        for texts in batches:
            yield texts.map(lambda t: skeleton(t, table), na_action="ignore").astype(object).where(texts.notna(), None)

    return skeletons


def skeleton_column(spark: SparkSession, c: Column) -> Column:
    """Skeleton of a column of texts. Null stays null, a text of invisible characters becomes
    empty, any length is processed whole."""
    return _skeletons(spark)(c)


def same_look(df: DataFrame, a: str, b: str, ident: str) -> DataFrame:
    """The ``ident`` of rows whose texts ``a`` and ``b`` look the same but are not equal as stored.

    Rows with a null in either are none. Both texts go through one pass of the UDF; rows equal as
    stored never reach Python.
    """
    differ = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(ident, F.col(a).alias("__a"), F.col(b).alias("__b"))
    form = _skeletons(df.sparkSession)
    return differ.where(form(F.col("__a")) == form(F.col("__b"))).select(ident)


def looks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of stored spellings by look: the form, the spelling most often stored (of equals the
    smallest), how many spellings and how many values there are. The form is for comparing, since
    prototypes are not for reading (rn for m); the spelling is to be shown.

    Values are counted by spelling before they reach Python or a shuffle on the form, so a hot
    value costs a row per map task.
    """
    values = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).where("value is not null")
    spellings = values.groupBy("value").agg(F.count("*").alias("n"))
    grouped = spellings.withColumn("form", _skeletons(df.sparkSession)(F.col("value"))).groupBy("form")
    shown = F.min(F.struct((-F.col("n")).alias("less"), "value"))["value"]
    return grouped.agg(shown.alias("shown"), F.count("*").alias("spellings"), F.sum("n").alias("n_values"))
