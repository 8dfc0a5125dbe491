"""Top N items within every group by simultaneous per-group bisection.

Every row gets an order-preserving code: the score as integer words, then the identifier. The
cutoff of every group lies between a lower and an upper bound; one pass bisects the bounds of all
groups ``BITS`` times at once, by counting each group's rows between the 2**BITS - 1 midpoints. The
running count from the top is the number of rows above each midpoint, so a pass tells for every
interval whether it lies wholly above the cutoff (kept), wholly below (dropped) or around it
(bisected again, between the smallest and largest code left). Passes end when every group holds
exactly N rows, or all of its rows if it has fewer.

The counts are combined before the shuffle, so a hot group costs at most 2**BITS rows per map
task. Rows meet the decisions on (group, interval), and an interval's decision brings its bounds
along, so there is no join on the group alone: the rows of a hot group are spread over its
intervals. Where all its rows share one score they are one interval in the first passes; that join
is between rows and one decision an interval, which adaptive execution splits. Passes after the
first see only rows around a cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitweave.session import cut

BITS = 10
_ONE = 1 << 62


def score_words(score: Column) -> list[Column]:
    """Two integer words that order scores of [0, 1] as the doubles themselves.

    The first word is exact for scores from 2**-10, the second holds what is left of smaller ones;
    scores closer than 2**-124 count as equal.
    """
    scaled = score * F.lit(float(_ONE))
    high = F.floor(scaled).cast("bigint")
    return [high, F.floor((scaled - high.cast("double")) * F.lit(float(_ONE))).cast("bigint")]


def top_n_by_bisection(
    df: DataFrame, group: Column, words: list[Column], ident: Column, n: int, bits: int = BITS
) -> DataFrame:
    """The ``n`` rows of largest code in each group, as columns ``grp`` and ``ident``.

    ``words``: integer code words, most significant first. ``ident``: BIGINT; of rows equal in all
    words the smaller one comes first. Rows with a null group, word or ident have no place in the
    order and are left out. Rows equal in group, words and ident are interchangeable; as many of
    them are returned as have room among the n. An empty table gives an empty result; other columns
    of ``df``, whatever their names, are not read.
    """
    names = [f"w{i}" for i in range(len(words))]
    rows = df.select(group.alias("grp"), ident.cast("bigint").alias("ident"), *[w.alias(k) for w, k in zip(words, names)])
    rows = rows.where(" and ".join(f"{k} is not null" for k in ["grp", "ident", *names]))
    rows = rows.withColumn(f"w{len(words)}", F.lit(-1) - F.col("ident"))
    names.append(f"w{len(words)}")
    # The first pass takes its intervals from the top bits of the first word, the second halves those;
    # from then on the counted rows bring the bounds of the codes in an interval along.
    left = rows.withColumn("need", F.lit(n)).withColumn("part", F.shiftright("w0", 62 - bits))
    kept: list[DataFrame] = []
    turn = 0
    while True:
        bounds = [f(k).alias(f"{k}_{s}") for k in names for f, s in ((F.min, "lo"), (F.max, "hi"))] if turn else []
        counted = left.groupBy("grp", "part", "need").agg(F.count("*").alias("rows"), *bounds)
        above = F.sum("rows").over(Window.partitionBy("grp").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))
        decided = (
            counted.withColumn("above", F.coalesce(above, F.lit(0)))
            .where("above < need").withColumn("whole", F.col("above") + F.col("rows") <= F.col("need"))
            .withColumn("need", (F.col("need") - F.col("above")).cast("int")).drop("above", "rows")
        )
        met = cut(left.drop("need").join(decided, ["grp", "part"]))
        kept.append(met.where("whole").select("grp", "ident"))
        left = met.where("not whole").drop("whole")
        if left.isEmpty():
            break
        if not turn:
            low = F.shiftleft("part", 62 - bits)
            left = left.withColumn("part", F.shiftright(F.col("w0") - low, max(0, 62 - 2 * bits)))
        else:
            # The first word in which the codes of the interval differ; codes equal in all are interchangeable.
            word = lo = hi = None
            for k in names:
                differs = F.col(f"{k}_lo") < F.col(f"{k}_hi")
                word, lo, hi = [
                    F.when(differs, F.col(c)) if before is None else before.when(differs, F.col(c))
                    for before, c in ((word, k), (lo, f"{k}_lo"), (hi, f"{k}_hi"))
                ]
            left = left.select("grp", "ident", *names, "need", word.alias("word"), lo.alias("lo"), hi.alias("hi"))
            same = left.where("word is null")
            first = F.row_number().over(Window.partitionBy("grp").orderBy("ident"))
            kept.append(same.withColumn("nth", first).where("nth <= need").select("grp", "ident"))
            shift = F.expr(f"greatest(0, length(bin(hi - lo)) - {bits})")
            left = left.where("word is not null").withColumn("shift", shift).withColumn("part", F.expr("shiftright(word - lo, shift)"))
        left = left.select("grp", "ident", *names, "need", "part")
        turn += 1
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out
