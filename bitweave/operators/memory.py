"""Algebraic memories: facts to traces, and queries answered from the trace alone.

A memory is a group of facts; many memories live side by side in one DataFrame, told apart by the
column ``mem``. ``facts``: (mem, ord, s, r, o, n) with the order of arrival ``ord`` and the weight n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitweave.functions import words as w
from bitweave.operators.bundle import bundle
from bitweave.session import partitions

#: Room for the index of a name in the code "distance, index" that arg-min aggregates.
_INDEX = 1 << 40


def clean(facts: DataFrame, mem: Column, order: str = "fact_id", s: str = "s", r: str = "r", o: str = "o", weight: str | None = "weight") -> DataFrame:
    """Facts in the form the operators take. A fact with a null part is left out, a null weight is 1."""
    n = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(1))
    rows = facts.select(mem.alias("mem"), F.col(order).alias("ord"), F.col(s).alias("s"), F.col(r).alias("r"), F.col(o).alias("o"), n.cast("bigint").alias("n"))
    return rows.where("mem is not null and s is not null and r is not null and o is not null")


def with_inverse(facts: DataFrame) -> DataFrame:
    """Facts and their inverses, the relation suffixed with _inv."""
    back = facts.select("mem", "ord", F.col("o").alias("s"), F.concat("r", F.lit("_inv")).alias("r"), F.col("s").alias("o"), "n")
    return facts.unionByName(back)


def codebook(facts: DataFrame) -> DataFrame:
    """(mem, name, idx): names of a memory by first appearance, subject before relation before object."""
    parts = F.array(*[F.struct(F.col(c).alias("name"), (F.col("ord") * 3 + k).alias("at")) for k, c in enumerate("sro")])
    return facts.select("mem", F.explode(parts).alias("p")).groupBy("mem", F.col("p.name").alias("name")).agg(F.min("p.at").alias("idx"))


def key(s: Column, r: Column, words: int) -> Column:
    """Address of (subject, relation)."""
    return w.bind(w.item(s, words), w.rho(w.item(r, words), 1, words))


def fact_state(s: Column, r: Column, o: Column, words: int) -> Column:
    return w.bind(key(s, r, words), w.item(o, words))


def traces(facts: DataFrame, words: int, tie: str = "item") -> DataFrame:
    """(mem, n, trace) of every memory. States are derived row by row, without a join."""
    return bundle(facts.select("mem", "n", fact_state(F.col("s"), F.col("r"), F.col("o"), words).alias("state")), ["mem"], "state", words, F.col("n"), tie)


def compose(facts: DataFrame, words: int, same_relations: bool = False) -> DataFrame:
    """(mem, s, r1, r2, o, state) for every two facts with a common bridge: the product of both
    states, in which the bridge no longer occurs except shifted by nothing."""
    a = facts.select("mem", F.col("s"), F.col("r").alias("r1"), F.col("o").alias("bridge"))
    b = facts.select("mem", F.col("s").alias("bridge"), F.col("r").alias("r2"), F.col("o"))
    both = a.join(b, ["mem", "bridge"]).where("bridge <> s and bridge <> o")
    left = fact_state(F.col("s"), F.col("r1"), F.col("bridge"), words)
    right = fact_state(F.col("bridge"), F.col("r2"), F.col("o"), words)
    return both.select("mem", "s", "r1", "bridge", "r2", "o", w.bind(left, right).alias("state"))


def composed_key(s: Column, r1: Column, r2: Column, words: int) -> Column:
    """Address of a compiled pair of hops: needs no bridge."""
    return w.bind(w.item(s, words), w.bind(w.rho(w.item(r1, words), 1, words), w.rho(w.item(r2, words), 1, words)))


def nearest(noisy: DataFrame, names: DataFrame, query: list[str], words: int, state: str = "noisy", keep: Column | None = None, salts: int = 1) -> DataFrame:
    """Cleanup: for each query the name of its memory whose state is nearest.

    ``noisy``: (mem, *query, state); ``names``: (mem, name, idx). Of equally near names the one with
    the smallest idx wins. ``keep``: condition on a pair, for typed or guided projections. Queries
    whose memory offers no name are absent. An equi-join on the memory and a primitive arg-min
    (distance and index in one BIGINT), so the aggregate hashes and combines before the shuffle.

    Few bytes make many pairs here, so both sides are put into a stated number of partitions, which
    adaptive execution does not merge by size. A memory too large for one task is spread over
    ``salts`` tasks, each with its share of the queries and a copy of the names.
    """
    parts = partitions(noisy)
    states = names.select("mem", "name", "idx", w.item(F.col("name"), words).alias("_state"), F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_salt"))
    asked = noisy.withColumn("_salt", F.pmod(F.hash(*query), F.lit(salts)))
    pairs = asked.repartition(parts, "mem", "_salt").join(states.repartition(parts, "mem", "_salt"), ["mem", "_salt"])
    if keep is not None:
        pairs = pairs.where(keep)
    code = w.hamming(F.col(state), F.col("_state"), words).cast("bigint") * _INDEX + F.col("idx")
    best = pairs.groupBy("mem", *query).agg(F.min(code).alias("_code"))
    found = best.select("mem", *query, F.expr(f"_code div {_INDEX}").cast("int").alias("dist"), F.expr(f"_code % {_INDEX}").alias("idx"))
    return found.join(names.select("mem", "idx", "name"), ["mem", "idx"]).select("mem", *query, F.col("name").alias("answer"), "dist")


def query(facts: DataFrame, asked: DataFrame, words: int, names: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """Answers to (mem, s, r): unbind the key from the trace and clean up."""
    noisy = asked.join(traces(facts, words), "mem").select("mem", "s", "r", w.bind(F.col("trace"), key(F.col("s"), F.col("r"), words)).alias("noisy"))
    return nearest(noisy, codebook(facts) if names is None else names, ["s", "r"], words, keep=keep)


def z_score(dist: Column, words: int) -> Column:
    """Standard deviations below the distance of unrelated states."""
    d = 32.0 * words
    return (F.lit(d / 2) - dist) / F.lit(d**0.5 / 2)


def member(facts: DataFrame, asked: DataFrame, words: int, z_min: float = 3.0) -> DataFrame:
    """Whether (mem, s, r, o) is in the trace: its z is at least ``z_min``."""
    hit = asked.join(traces(facts, words), "mem")
    off = w.ones(w.bind(F.col("trace"), fact_state(F.col("s"), F.col("r"), F.col("o"), words)))
    return hit.select("mem", "s", "r", "o", off.alias("dist")).withColumn("found", z_score(F.col("dist"), words) >= z_min)


def chain(facts: DataFrame, starts: DataFrame, hops: int, words: int, guided: bool = False) -> DataFrame:
    """Answers of many chains at once: ``starts`` (mem, id, start, rels ARRAY<STRING>), each hop a
    query from the last answer. Returns (mem, id, node, conf): conf is the product of the hops'
    confidences. ``guided`` leaves visited names out of the cleanup. Chains shorter than ``hops``
    keep their last node."""
    trace, names = traces(facts, words), codebook(facts)
    at = starts.select("mem", "id", "rels", F.col("start").alias("node"), F.lit(1.0).alias("conf"), F.array("start").alias("visited"))
    for h in range(hops):
        go = at.where(F.size("rels") > h)
        noisy = go.join(trace, "mem").select("mem", "id", "visited", w.bind(F.col("trace"), key(F.col("node"), F.element_at("rels", h + 1), words)).alias("noisy"))
        keep = ~F.array_contains("visited", F.col("name")) if guided else None
        found = nearest(noisy, names, ["id"], words, keep=keep)
        sigma = 1 / (1 + F.exp(-z_score(F.col("dist"), words) / 8))
        moved = go.join(found, ["mem", "id"]).select("mem", "id", "rels", F.col("answer").alias("node"), (F.col("conf") * sigma).alias("conf"), F.array_append("visited", F.col("answer")).alias("visited"))
        at = moved.unionByName(at.where(F.size("rels") <= h))
    return at.select("mem", "id", "node", "conf")
