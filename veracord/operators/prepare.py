"""Tables made ready for claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_owner(items: DataFrame, owners: DataFrame, key: str, labels: str, word: str) -> DataFrame:
    """``items`` joined with those of their ``owners`` whose ``labels`` text contains ``word``; others go.

    An equi-join on ``key``; the owners are filtered before it, null labels do not contain a word.
    """
    return items.join(owners.where(F.contains(F.col(labels), F.lit(word))), key, "inner")
