"""Filling of fixed-capacity containers by pattern packing.

Only the histogram of lengths (at most one row per length up to the capacity) reaches the driver.
There a plan is made: patterns of few documents that fill a container are enumerated, non-negative
least squares fits how often each is used so that together they use up the histogram, the counts
are rounded down, and what is left is packed best fit, longest first, into the room of the patterns
and into new containers. The plan says for runs of documents of a length, by rank, which container
they go to; it has a number of runs bounded by the capacity, not by the corpus.

The ranks of documents among those of their length are counted per salt and added up, so a length
that a third of all documents have is numbered by many tasks.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length classes of the patterns, documents in a pattern.
CLASSES, DOCUMENTS = 128, 3
#: Items of one length that one task numbers, about.
PER_SALT = 200_000
MOST_CAPACITY = 1 << 20


@dataclass(frozen=True)
class Run:
    """Items of ``length`` with ranks from ``first`` to ``first + n - 1``: ``each`` per container from ``container`` on."""

    length: int
    first: int
    n: int
    container: int
    each: int


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares, the active-set method of Lawson and Hanson on normal equations."""
    gram, proj = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    passive = np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        gradient = proj - gram @ x
        gradient[passive] = -np.inf
        k = int(np.argmax(gradient))
        if gradient[k] <= 1e-10:
            break
        passive[k] = True
        while True:
            on = np.flatnonzero(passive)
            z = np.linalg.lstsq(gram[np.ix_(on, on)], proj[on], rcond=None)[0]
            if z.size == 0 or z.min() > 0:
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-15))
            x[on] += step * (z - x[on])
            passive[on[x[on] <= 1e-12]] = False
            x[~passive] = 0
    return x


def patterns(classes: int, documents: int) -> list[tuple[int, ...]]:
    """Multisets of up to ``documents`` classes that fill ``classes`` exactly."""
    out: list[tuple[int, ...]] = [(classes,)]
    for n in range(2, documents + 1):
        for head in combinations_with_replacement(range(1, classes), n - 1):
            last = classes - sum(head)
            if last >= head[-1]:
                out.append((*head, last))
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs for all items of a histogram (length from 1 to the capacity to number), and the number of containers."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room: (first container, number)
    bins = 0

    def place(length: int, n: int, container: int, each: int) -> None:
        runs.append(Run(length, used[length], n, container, each))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    # Patterns over length classes.
    classes = min(CLASSES, capacity)
    grain = -(-capacity // classes)
    of: dict[int, list[int]] = defaultdict(list)
    for length in sorted(left, reverse=True):
        of[-(-length // grain)].append(length)
    if left:
        kinds = patterns(capacity // grain, DOCUMENTS)
        kinds = [p for p in kinds if all(c in of for c in p)]
        total = sum(left.values())
        if kinds:
            a = np.zeros((max(of) + 1, len(kinds)))
            for k, p in enumerate(kinds):
                for c in p:
                    a[c, k] += 1
            b = np.zeros(max(of) + 1)
            for c, lengths in of.items():
                b[c] = sum(left[x] for x in lengths) / total
            weight = np.sqrt(np.arange(max(of) + 1) + 1.0)  # a long item left over costs more
            times = np.floor(nnls(a * weight[:, None], b * weight) * total + 1e-9).astype(int)
            for k in np.argsort(-times):
                need = int(times[k])
                while need > 0:
                    slots, take = [], need
                    counts: dict[int, int] = defaultdict(int)
                    for c in kinds[k]:
                        length = next((x for x in of[c] if left.get(x, 0) > counts.get(x, 0)), None)
                        if length is None:
                            break
                        slots.append(length)
                        counts[length] += 1
                    else:
                        take = min(take, *(left[x] // n for x, n in counts.items()))
                        for length, n in counts.items():
                            place(length, take * n, bins, n)
                        if capacity > sum(slots) > 0:
                            room[capacity - sum(slots)].append((bins, take))
                        bins += take
                        need -= take
                        continue
                    break
    # What is left, longest first, into the smallest room that holds it.
    open_ = sorted(room)
    for length in sorted(left, reverse=True):
        while left.get(length, 0) > 0:
            n = left[length]
            at = int(np.searchsorted(open_, length))
            if at == len(open_):
                each = min(capacity // length, n)
                number = n // each
                place(length, number * each, bins, each)
                first, free = bins, capacity - each * length
                bins += number
            else:
                free = open_[at]
                first, number = room[free].pop()
                if number > n:  # one each into some of them, the others stay
                    room[free].append((first + n, number - n))
                    number = n
                elif not room[free]:
                    open_.pop(at)
                each = min(free // length, n // number)
                place(length, number * each, first, each)
                free -= each * length
            if free > 0:
                if not room[free] and (not open_ or free not in open_):
                    open_.insert(int(np.searchsorted(open_, free)), free)
                room[free].append((first, number))
    return runs, bins


def pack(sizes: DataFrame, ident: str, size: str, containers: DataFrame, name: str, capacity: str) -> DataFrame:
    """Every item in a container of each kind: (container, bin, ``ident``, piece, start, tokens).

    ``sizes``: BIGINT tokens of every item. An item larger than the capacity is split into full
    pieces and a rest; no other is. ``bin`` numbers the containers of a kind from 0. An item of size
    0 takes no room and goes to bin 0; a null or negative size counts as 0. Kinds with a null or
    non-positive capacity are left out. Items with equal ident are separate items. ``sizes`` is read
    several times, so it should be a stored table.
    """
    kinds = [(r[0], int(r[1])) for r in containers.select(name, capacity).where(F.col(capacity) > 0).distinct().collect()]
    if any(c > MOST_CAPACITY for _, c in kinds):
        raise ValueError("too large containers for a plan on the driver")
    spark = sizes.sparkSession
    offered = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, (_, c) in enumerate(kinds)])) if kinds else F.explode(F.expr("cast(array() as array<struct<kind: int, capacity: bigint>>)"))
    labels = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(kinds)], f"kind int, container {dict(containers.dtypes)[name]}")
    items = sizes.select(F.col(ident).alias("ident"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    # Full pieces have containers of their own; a rest, or an item that fits, is packed.
    rests = items.withColumn("o", offered).select("o.*", "ident", "size").select(
        "kind", "capacity", "ident", "size", F.expr("size div capacity").alias("full"),
        F.expr("size % capacity").alias("length"),
    )
    counted = [tuple(r) for r in rests.where("length > 0").groupBy("kind", "length").count().collect()]
    fulls = {r[0]: r[1] for r in rests.where("full > 0").groupBy("kind").agg(F.sum("full")).collect()}
    rows: list[tuple[int, int, int, int, int, int]] = []
    packed: dict[int, int] = {}
    for k, (_, cap) in enumerate(kinds):
        runs, bins = plan({n: c for kind, n, c in counted if kind == k}, cap)
        packed[k] = bins
        rows += [(k, r.length, r.first, r.first + r.n, r.container, r.each) for r in runs]
    most = max((c for _, _, c in counted), default=0)
    salt = max(1, -(-most // PER_SALT)) * 4
    salted = rests.withColumn("salt", F.pmod(F.xxhash64("ident", "size"), F.lit(salt)))
    # Ranks within (kind, length): offsets of the salts, then row numbers within a salt.
    groups = salted.groupBy("kind", "length", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("fulls"))
    before = Window.partitionBy("kind", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("kind", "length", "salt", "offset")
    own = Window.partitionBy("kind", "length", "salt").orderBy("ident", "size")
    ranked = salted.withColumn("nth", F.row_number().over(own)).join(offsets, ["kind", "length", "salt"]).withColumn("rank", F.col("offset") + F.col("nth") - 1)
    # The runs of a length as one array in order of rank: the plan has no more of them than its
    # capacity allows, whatever the corpus; a row finds its run by halving.
    plan_ = spark.createDataFrame(rows, "kind int, length bigint, low bigint, high bigint, first bigint, each bigint")
    runs_ = plan_.groupBy("kind", "length").agg(F.sort_array(F.collect_list(F.struct("low", "first", "each"))).alias("runs"))
    half = "cast((s.a + s.b + 1) div 2 as int)"
    step = f"if(s.a = s.b, s, if(runs[{half}].low <= rank, named_struct('a', {half}, 'b', s.b), named_struct('a', s.a, 'b', {half} - 1)))"
    found = F.expr(f"aggregate(sequence(1, cast(ceil(log2(size(runs))) as int) + 1), named_struct('a', 0, 'b', size(runs) - 1), (s, x) -> {step}).a")
    put = ranked.where("length > 0").join(F.broadcast(runs_), ["kind", "length"]).withColumn("run", F.expr("runs")[found]).select("*", "run.low", "run.first", "run.each")
    rest = put.select("kind", F.expr("first + (rank - low) div each").alias("bin"), "ident", F.col("full").cast("int").alias("piece"), F.expr("full * capacity").alias("start"), F.col("length").alias("tokens"))
    none = rests.where("size = 0").select("kind", F.lit(0).cast("bigint").alias("bin"), "ident", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("tokens"))
    out = rest.unionByName(none)
    if fulls:
        # Numbers of full pieces follow those of the plan, counted up per salt in the same way.
        big = rests.where("full > 0").withColumn("salt", F.pmod(F.xxhash64("ident", "size"), F.lit(salt * 16)))
        sums = big.groupBy("kind", "salt").agg(F.sum("full").alias("n"))
        offs = sums.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("kind", "salt", "offset")
        within = F.sum("full").over(Window.partitionBy("kind", "salt").orderBy("ident", "size").rowsBetween(Window.unboundedPreceding, -1))
        base = spark.createDataFrame(list(packed.items()), "kind int, base bigint")
        big = big.withColumn("within", F.coalesce(within, F.lit(0))).join(offs, ["kind", "salt"]).join(F.broadcast(base), "kind")
        pieces = big.withColumn("piece", F.explode(F.expr("sequence(0, cast(full as int) - 1)")))
        out = out.unionByName(pieces.select("kind", (F.col("base") + F.col("offset") + F.col("within") + F.col("piece")).alias("bin"), "ident", "piece", F.expr("piece * capacity").alias("start"), F.col("capacity").alias("tokens")))
    return out.join(F.broadcast(labels), "kind").select("container", "bin", F.col("ident").alias(ident), "piece", "start", "tokens")
