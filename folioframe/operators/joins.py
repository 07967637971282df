"""Join helpers whose strategy depends on a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATALOG_ROWS = 20_000


def bounded_broadcast(df: DataFrame, max_rows: int = CATALOG_ROWS) -> DataFrame:
    """Broadcast only what was counted to be small; otherwise leave the choice to the optimizer."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def salted_join(big: DataFrame, catalog: DataFrame, on: list[str], spread: Column, salts: int = 64) -> DataFrame:
    """Join on few distinct keys.

    A small catalog is broadcast. A large one is copied once per salt and meets the salted big side in
    an equi join, so that one hot key is worked on by many tasks.
    """
    if catalog.limit(CATALOG_ROWS + 1).count() <= CATALOG_ROWS:
        return big.join(F.broadcast(catalog), on)
    left = big.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = catalog.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "salt"]).drop("salt")
