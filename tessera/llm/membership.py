"""Which rows may be among a table's: a Bloom filter sized by its members, so that an exact join behind it moves few others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Sent

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29  # of a filter: 64 MB at most to the driver and to each worker
FOR_EACH = 16  # bits for each member, at least, up to MOST_BITS
SHIFTS = (0, 32)  # a hash's places are its bits from each of these on


def maybe_among(h: Column, members: DataFrame) -> Column:
    """Whether a 64-bit hash may be one of members, a table of one column of such hashes: true for all that are.

    The filter has FOR_EACH bits or more for each member, and so lets about 1 % of the others pass,
    up to 33 million members; its words are counted where the rows are.  Beyond that more
    and more others pass, so what follows must be exact by itself; then it costs what it
    would without a filter.
    """
    of = members.columns[0]
    size = LEAST_BITS
    for _ in range((FOR_EACH * members.count() // LEAST_BITS).bit_length()):
        size = min(2 * size, MOST_BITS)
    places = F.explode(F.array(*[F.shiftrightunsigned(of, s).bitwiseAND(size - 1) for s in SHIFTS]))
    words = members.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = Sent(members.sparkSession, bits)

    @F.pandas_udf("boolean")
    def among(hashes: pd.Series) -> pd.Series:
        x, held = hashes.to_numpy().view(np.uint64), sent.value
        found = np.ones(len(x), bool)
        for s in SHIFTS:
            at = (x >> np.uint64(s)) & np.uint64(size - 1)
            found &= (held[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    return among(h)
