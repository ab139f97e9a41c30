"""One-to-one assignment: pairs are taken in a given order, each end once.

What is taken follows from the pairs that come before, so a plain loop takes as many rounds as the
longest chain of pairs that wait for each other. Blocks don't wait for one another, and the first
pairs of a block can be settled without the rest. So a block of bounded size is settled in one
task; in a larger one all pairs that come first at both their ends are taken at once, and where
chains make that slow, a first part of bounded size is settled in a task, whatever its chains.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .ordering import positions_within

#: Pairs of a block that one task settles, and the share of all pairs that a round must settle to be followed by another.
TASK_PAIRS, LEAST_SHARE = 100_000, 0.1


def alike(left: DataFrame, right: DataFrame, columns: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in columns.items()])


def _without(pairs: DataFrame, taken: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of which neither end is taken."""
    for end in ("old", "new"):
        used = taken.select(*[F.col(c).alias(f"_{c}") for c in (*block, end)])
        pairs = pairs.join(used, alike(pairs, used, {c: f"_{c}" for c in (*block, end)}), "left_anti")
    return pairs


def _settled(pairs: DataFrame, block: list[str]) -> DataFrame:
    """Every block in one task, pair by pair."""

    def take(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        old, new, kept = set(), set(), []
        for a, b in zip(rows.column("old").to_pylist(), rows.column("new").to_pylist(), strict=True):
            kept.append(a not in old and b not in new)
            if kept[-1]:
                old.add(a)
                new.add(b)
        return rows.filter(pa.array(kept, pa.bool_()))

    return pairs.groupBy(*block).applyInArrow(take, pairs.schema)


def first_come(pairs: DataFrame, block: list[str], order: list[Column], task_pairs: int = TASK_PAIRS) -> DataFrame:
    """The rows of pairs(block.., old, new, ...) that are taken: in order within their block, unless an end is taken already.

    The order must tell all pairs of a block apart but for repeated rows, of which one is taken.
    Nulls are values like others.
    """
    left = cut_lineage(positions_within(cut_lineage(pairs), block, order, "_place"))
    taken: list[DataFrame] = []
    while True:
        sizes = left.groupBy(*block).agg(F.count("*").alias("_size"))
        large = cut_lineage(sizes.where(F.col("_size") > task_pairs).select(*[F.col(c).alias(f"_{c}") for c in block], "_size"))
        on = alike(left, large, {c: f"_{c}" for c in block}) if block else F.lit(True)
        taken.append(_settled(left.join(large, on, "left_anti"), block))
        before = large.agg(F.sum("_size")).first()[0]
        if not before:
            return reduce(DataFrame.unionByName, taken).drop("_place")
        left = cut_lineage(left.join(large, on, "left_semi"))
        first = lambda end: left.groupBy(*block, end).agg(F.min("_place").alias("_first")).select(*block, F.col("_first").alias("_place"))  # noqa: B023, E731
        both = first("old").intersect(first("new"))
        both = both.select(*[F.col(c).alias(f"_{c}") for c in (*block, "_place")])
        winners = cut_lineage(left.join(both, alike(left, both, {c: f"_{c}" for c in (*block, "_place")}), "left_semi"))
        taken.append(winners)
        left = cut_lineage(_without(left, winners, block))
        if before - left.count() < LEAST_SHARE * before:
            # Chains: the first pairs that are left of every block, in one task each.
            head = positions_within(left, block, [F.col("_place")], "_at").where(F.col("_at") <= task_pairs).drop("_at")
            winners = cut_lineage(_settled(head, block))
            taken.append(winners)
            left = cut_lineage(_without(left, winners, block))
