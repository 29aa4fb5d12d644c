"""Joins to facts about keys, one row a key, where few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many of all rows, so there are fewer hot keys than this.
HOT = 1000


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` to ``facts``, which has one row a key, and in ``many`` how many of the ``total`` rows hold it.

    Hot keys' facts are broadcast: fewer than ``HOT`` rows, whatever the data. Their rows aren't shuffled, and no key
    that is left holds more than one in ``HOT`` of the rows. ``facts`` is read three times, so it should be a written table.
    """
    is_hot = F.col("many") * HOT > F.lit(total)
    hot = facts.where(is_hot)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(~is_hot), keys)
    return rows.join(F.broadcast(hot), keys).union(cold)
