"""Binary network kernels: sequences of token ids run through bit layers, and tree heads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from bitweave.functions import words as w


def lookup(tokens: DataFrame, embeddings: DataFrame, ident: str) -> DataFrame:
    """Embedding of every token id; null for an id outside of the table. The table's size decides
    whether it is sent to the executors (the optimizer's threshold) or joined by shuffle."""
    return tokens.join(embeddings, ident, "left")


def _unpack(words: list[int]) -> np.ndarray:
    return ((np.array(words, dtype=np.uint64)[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)).astype(np.int8).ravel()


def _pack(bits: np.ndarray) -> list[int]:
    return (bits.reshape(-1, 32).astype(np.int64) << np.arange(32)).sum(axis=1).tolist()


def run_layer(inputs: Column, forget: list[list[int]], take: list[list[int]], window_weights: list[list[int]], window: int = 8) -> Column:
    """Final output of a recurrent bit layer over an array of input states (in order), as words.

    state = majority(state, forget . state, take . input); the ring of the last ``window`` states is
    XORed; output = input OR (window weights . ring). A product is the sign of the +1/-1 dot product
    (above 0 sets the bit). Weights are packed rows, captured with the function; null for no input.
    """
    matrices = [np.array([_unpack(r) for r in m]) * 2 - 1 for m in (forget, take, window_weights)]

    @F.pandas_udf(ArrayType(LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wf, wi, wm = (m.astype(np.int32) for m in matrices)
        for batch in batches:
            out = []
            for seq in batch:
                if seq is None or not len(seq):
                    out.append(None)
                    continue
                state = np.zeros(wf.shape[0], dtype=np.int8)
                ring: list[np.ndarray] = []
                for words in seq:
                    x = _unpack(list(words))
                    kept = (wf @ (state * 2 - 1) > 0).astype(np.int8)
                    taken = (wi @ (x * 2 - 1) > 0).astype(np.int8)
                    state = ((state.astype(int) + kept + taken) >= 2).astype(np.int8)
                    ring = [*ring[-(window - 1):], state] if window > 1 else [state]
                    mixed = np.bitwise_xor.reduce(ring)
                    y = x | (wm @ (mixed * 2 - 1) > 0).astype(np.int8)
                out.append(_pack(y))
            yield pd.Series(out)

    return run(inputs)


def xor_machine(inputs: Column, words: int) -> Column:
    """State of the XOR machine after an array of input states: each step shifts the state by one bit
    and binds the input. Stays in the JVM."""
    start = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.lit(0).cast("bigint"))
    return F.aggregate(inputs, start, lambda s, x: w.bind(w.rho(s, 1, words), x))


def tree_greedy(states: DataFrame, nodes: DataFrame, ident: str, levels: int, words: int) -> DataFrame:
    """(ident, leaf): walk down a heap-numbered tree; at node n go right (2n + 2) where the dot product
    of state and node is positive, else left (2n + 1). One join per level; the tree is broadcast
    after its size is checked."""
    if nodes.count() > 1 << 20:
        raise ValueError("the tree is too large to send to every executor")
    held = F.broadcast(nodes.select(F.col("node").alias("at"), F.col("words").alias("_n")))
    cur = states.select(ident, F.col("words").alias("_s"), F.lit(0).cast("bigint").alias("at"))
    for _ in range(levels):
        step = cur.join(held, "at")
        right = F.lit(32 * words) - 2 * w.hamming(F.col("_s"), F.col("_n"), words) > 0
        cur = step.select(ident, "_s", (F.col("at") * 2 + F.when(right, 2).otherwise(1)).alias("at"))
    return cur.select(ident, (F.col("at") - ((1 << levels) - 1)).alias("leaf"))


def softmax_top_k(logits: DataFrame, query: str, token: str, logit: str, k: int, temperature: float = 1.0) -> DataFrame:
    """(query, token, p, cum) of the k largest logits, renormalised; ties by token. ``cum`` is the
    running sum from the largest, for sampling by inverse distribution."""
    order = Window.partitionBy(query).orderBy(F.desc(logit), token)
    top = logits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    whole = Window.partitionBy(query)
    e = F.exp((F.col(logit) - F.max(logit).over(whole)) / temperature)
    p = top.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(whole))
    return p.withColumn("cum", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(query, token, "p", "cum")


def forward_chain(facts: DataFrame, rules: DataFrame, rounds: int = 6) -> DataFrame:
    """(mem, entity, attribute) after Horn chaining: a rule (mem, rule, premise, conclusion), one row
    per premise, fires for an entity that has all its premises. Rounds end early at the fixpoint."""
    from bitweave.session import cut

    known = cut(facts.select("mem", "entity", "attribute").distinct())
    need = rules.groupBy("mem", "rule").agg(F.countDistinct("premise").alias("need"), F.first("conclusion").alias("conclusion"))
    for _ in range(rounds):
        met = known.join(rules.select("mem", "rule", F.col("premise").alias("attribute")).distinct(), ["mem", "attribute"])
        fired = met.groupBy("mem", "rule", "entity").agg(F.count("*").alias("n")).join(need, ["mem", "rule"]).where("n = need")
        new = cut(fired.select("mem", "entity", F.col("conclusion").alias("attribute")).distinct().join(known, ["mem", "entity", "attribute"], "left_anti"))
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
    return known
