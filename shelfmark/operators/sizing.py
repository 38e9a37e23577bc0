"""Joins to key lists whose size is known before the join is planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 16 << 20
# What a row takes besides its keys in a hashed relation.
_ROW_BYTES = 64


def join_sized(wide: DataFrame, keys: DataFrame, on: list[str], how: str, *,
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join wide rows to a list of keys that is already written out.

    A small list, by its bytes, is sent to the rows; a large one is joined by
    shuffle. Leaving the choice to run-time statistics would shuffle the wide
    side before they are known; leaving it to the planner would go by the size
    of compressed files, a small part of what the keys take in the driver.
    """
    row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in on), F.lit(_ROW_BYTES))
    size = keys.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).head()[0]
    return wide.join(F.broadcast(keys) if size <= broadcast_bytes else keys.hint("merge"), on, how)
