"""Per-key scans in order that no single key can overload.

A window over a key puts the whole key in one task. Here the rows are range-sorted by (key, order),
so a key of any size spreads over as many sorted runs as it needs, and each run is scanned on its
own. Rows being sorted by key, only the last key of a run can go on in the next one, so what runs
hand over to each other is a table with one row per run. Its size is the number of runs, whatever
the data: that is what allows its broadcast, and windows over all of it.

The order must be total (end it with a unique id), or ties could fall in either run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bazaarflow.session import materialise

_RUN, _AT, _CARRY = "_run", "_at", "_carry"
_RUN_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


class OrderedScan:
    """The rows of each key in order; each method adds a column and returns a new scan.

    No keys means one order over all rows. The sorted rows are written once, to ``path`` or to a
    scratch folder that goes with its ``scratch_scope``.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str,
        path: str | None = None,
    ):
        self.keys = list(keys)
        self.df = _sorted_runs(df, keys, order, label, path)
        self._window = W.partitionBy(_RUN, *keys).orderBy(_AT)

    def rows(self) -> DataFrame:
        return self.df.drop(_RUN, _AT)

    def _with(self, df: DataFrame) -> OrderedScan:
        scan = copy(self)
        scan.df = df
        return scan

    def position(self, name: str) -> OrderedScan:
        """Number the rows of each key from 1."""
        local = self.df.withColumn(name, F.row_number().over(self._window).cast("bigint"))
        sizes = _tails(self.df, self.keys).groupBy(_RUN).agg(F.count(F.lit(1)).alias(_CARRY))
        ends = _run_ends(self.df).select(_RUN, *self.keys).join(F.broadcast(sizes), _RUN)
        carried = _add_carry(local, self.keys, _hand_over(ends, self.keys, F.sum))
        total = F.col(name) + F.coalesce(_CARRY, F.lit(0))
        return self._with(carried.withColumn(name, total).drop(_CARRY))

    def previous(self, columns: Sequence[str], name: str) -> OrderedScan:
        """The struct of ``columns`` of the key's previous row, null on its first."""
        row = F.struct(*columns)
        local = self.df.withColumn(name, F.lag(row).over(self._window))
        ends = _run_ends(self.df).select(_RUN, *self.keys, row.alias(_CARRY))
        carried = _add_carry(local, self.keys, _hand_over(ends, self.keys, F.last))
        return self._with(carried.withColumn(name, F.coalesce(name, _CARRY)).drop(_CARRY))

    def latest(self, value: Column, name: str, *, before_row: bool = False) -> OrderedScan:
        """The key's latest non-null ``value`` up to the row, or up to the row before it."""
        frame = self._window.rowsBetween(W.unboundedPreceding, -1 if before_row else 0)
        local = self.df.withColumn(name, F.last(value, ignorenulls=True).over(frame))
        valued = _tails(self.df, self.keys).where(value.isNotNull())
        lasts = _run_ends(valued).select(_RUN, value.alias(_CARRY))
        ends = _run_ends(self.df).select(_RUN, *self.keys).join(F.broadcast(lasts), _RUN, "left")
        carry = _hand_over(ends, self.keys, lambda c: F.last(c, ignorenulls=True))
        carried = _add_carry(local, self.keys, carry)
        return self._with(carried.withColumn(name, F.coalesce(name, _CARRY)).drop(_CARRY))


def _sorted_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str, path: str | None,
) -> DataFrame:
    """``df`` range-sorted by ``keys`` and ``order`` and written once, with run and place columns.

    It is written because the run limits come from a sample: two evaluations of the sort could
    draw them differently, and the scan and what runs hand over must see the same runs.
    """
    placed = df.orderBy(*[F.col(k).asc() for k in keys], *order).withColumn(
        _AT, F.monotonically_increasing_id())
    return materialise(placed, label, path).withColumn(_RUN, F.shiftright(_AT, _RUN_BITS))


def _run_ends(runs: DataFrame) -> DataFrame:
    """The last row of every run."""
    ends = runs.groupBy(_RUN).agg(F.max(_AT).alias("_end")).select("_end")
    return runs.join(F.broadcast(ends), F.col(_AT) == F.col("_end"), "left_semi")


def _tails(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of every run's last key."""
    ends = _run_ends(runs).select(
        F.col(_RUN).alias("_end_run"), *[F.col(k).alias(f"_end_{k}") for k in keys])
    match = F.col(_RUN) == F.col("_end_run")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_end_{k}"))
    return runs.join(F.broadcast(ends), match, "left_semi")


def _hand_over(ends: DataFrame, keys: Sequence[str], combine: Callable[[Column], Column]) -> DataFrame:
    """What each run takes over: the ``_carry`` of earlier run ends of the same key, combined."""
    so_far = W.partitionBy(*keys).orderBy(_RUN).rowsBetween(W.unboundedPreceding, 0)
    return ends.select(
        F.lead(_RUN).over(W.orderBy(_RUN)).alias(_RUN), *keys,
        combine(F.col(_CARRY)).over(so_far).alias(_CARRY),
    ).where(F.col(_RUN).isNotNull() & F.col(_CARRY).isNotNull())


def _add_carry(scanned: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    small = carry.select(
        F.col(_RUN).alias("_carry_run"), *[F.col(k).alias(f"_carry_{k}") for k in keys], _CARRY)
    match = F.col(_RUN) == F.col("_carry_run")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_carry_{k}"))
    return scanned.join(F.broadcast(small), match, "left").drop(
        "_carry_run", *[f"_carry_{k}" for k in keys])


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position",
) -> DataFrame:
    """``df`` with each row's place in its key's order."""
    return OrderedScan(df, keys, order, "position").position(name).rows()
