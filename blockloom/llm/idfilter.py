"""A filter of fixed size over long ids: tells ids that were put in from nearly all others.

It only ever spares work: an id that was put in always passes, and one that passes by chance is sorted
out by the join that follows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24  # log2 of the number of bits: two mebibytes, whatever the input


def spots(ids: Column) -> list[Column]:
    """Where an id's two bits are."""
    return [F.pmod(F.xxhash64(ids, F.lit(salt)), F.lit(1 << BITS)) for salt in (1, 2)]


def filter_of(ids: DataFrame, column: str) -> np.ndarray:
    """The filter as 64-bit words: two bits for each id, gathered on the cluster word by word."""
    bits = ids.select(F.explode(F.array(*spots(F.col(column)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    got = words.toArrow()  # at most 2 ** (BITS - 6) rows
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return out


def held(words: np.ndarray, *at: np.ndarray) -> np.ndarray:
    """Whether the bits at an id's spots are all set."""
    hit = np.ones(len(at[0]), bool)
    for spot in at:
        hit &= ((words[spot >> 6] >> (spot & 63)) & 1).astype(bool)
    return hit


def passes(shared, ids: Column) -> Column:
    """Whether ids pass the broadcast filter; a null id does as hashes have it."""

    @F.pandas_udf("boolean")
    def look(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(held(shared.value, a.to_numpy(), b.to_numpy()))

    return look(*spots(ids))
