"""A registry of text encoders: a name stands for a function of (df, ident, text) that gives (ident, state)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.functions import text as tx

Encoder = Callable[[DataFrame, str, str], DataFrame]


class Encoders:
    """Built-in encoders and those that a caller registers; a name that is taken or unknown is a ValueError."""

    def __init__(self) -> None:
        self._known: dict[str, Encoder] = {
            "ngram": lambda df, ident, text: tx.ngram_state(df, ident, text),
            "entity": lambda df, ident, text: df.select(ident, tx.minhash(tx.entity_items(F.col(text)), 2).alias("state")),
        }

    def register(self, name: str, encoder: Encoder) -> None:
        if name in self._known:
            raise ValueError(f"there is an encoder {name} already")
        self._known[name] = encoder

    def encode(self, name: str, df: DataFrame, ident: str, text: str) -> DataFrame:
        if name not in self._known:
            raise ValueError(f"no encoder {name}; there are {sorted(self._known)}")
        return self._known[name](df, ident, text)
