"""Joins by keys that many rows don't have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.sources.tables import not_broadcast


def left_by(rows: DataFrame, other: DataFrame, key: str, deal: Sequence[str] = ()) -> DataFrame:
    """The left join by ``key``, which may be null in many rows.

    Null meets nothing, but all such rows would go to one task. A second part of the key, a hash of the columns of
    ``deal`` (else of the rest of the row), deals them out; it is 0 for all others and for ``other``. Where rows that stand together
    are alike, ``deal`` keeps them together, which packs better.
    """
    rest = list(deal) or [c for c in rows.columns if c != key]
    dealt = rows.withColumn("dealt", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*rest), F.lit(4096).cast("long"))).otherwise(F.lit(0).cast("long"))) if rest else rows.withColumn("dealt", F.lit(0).cast("long"))
    # 0 by way of the key: a literal would be put in its place in the condition, and the second part be gone
    met = other.withColumn("dealt", F.pmod(F.xxhash64(key), F.lit(1).cast("long")))
    return dealt.join(not_broadcast(met), [key, "dealt"], "left").drop("dealt")
