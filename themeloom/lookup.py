"""Joins of a large table to a lookup table, by the measured size of the lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 128 * 1024 * 1024
REPEATED_BYTES = 64 * BROADCAST_BYTES  # all copies of a lookup together
MOST_SALTS, FEWEST_SALTS = 64, 4


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    size: int,
    spread: str,
    how: str = "inner",
    limit: int | None = None,
) -> DataFrame:
    """Join ``big`` to ``lookup``, which holds ``on`` at most once.

    ``size`` is the size of the lookup in bytes, counted by the caller. Up to the limit
    it is broadcast. Beyond it both sides are shuffled, with rows of one key spread
    over several groups by the column ``spread``, so a key held by a third of ``big``
    does not end in one task; the lookup is repeated once per group, less often the
    larger it is. What skew remains Spark splits at run time. Where ``spread`` is one of the keys, the rows
    of a key cannot be spread, and nothing is repeated.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if size <= (BROADCAST_BYTES if limit is None else limit):
        return big.join(F.broadcast(lookup), keys, how)
    if spread in keys:
        return big.join(lookup.hint("merge"), keys, how)
    salts = max(FEWEST_SALTS, min(MOST_SALTS, REPEATED_BYTES // max(1, size)))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")
