"""Loads that may be repeated without doubling rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.operators.latest import first_per_key


def insert_if_absent(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str],
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """The incoming rows to append: key neither in the target nor earlier in the batch.

    ``order`` decides which of several rows with one key is first (default: all plain columns,
    in order). A key with a null part conflicts with nothing, as in a unique constraint.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    by = list(order) if order else [
        F.col(f.name) for f in incoming.schema.fields if f.dataType.typeName() != "map"]
    # Repeats go first, while each task can still drop its own; the join then sees a key once.
    first = first_per_key(incoming.where(whole), keys, by)
    new = first.join(target.select(*keys), list(keys), "left_anti").select(*incoming.columns)
    return new.unionByName(incoming.where(~whole))


def insert_children(new_parents: DataFrame, details: DataFrame, on: str = "phone") -> DataFrame:
    """Detail rows of just-inserted parents, with the parent's id; ``on`` is unique in parents."""
    return new_parents.select("id", on).join(details, on, "inner").drop(on)
