"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.common import fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, parts: int, held_out: int, bound: int
) -> DataFrame:
    """``key, text, label`` of at most ``bound`` labelled documents outside the held-out fold.

    The labelled keys of the smallest hash are taken; a key with several labels counts by the
    largest. Null labels, keys and texts are left out. The ``bound`` keys are what is broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), parts) != held_out))
    known = known.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(bound)
    return docs.filter(F.col(text).isNotNull()).select(key, text).join(F.broadcast(chosen), key)
