"""Visual queries: group-by under a filter context on a star schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import All, Both, Comparison, Field, In, Not, TopN, compiled, fields_of, filtered, top_n

#: Visual types whose data can be asked for (fixed values), and aggregations that are read but not run.
VISUAL_TYPES = ("card", "cardVisual", "multiRowCard", "tableEx", "pivotTable", "barChart", "columnChart", "clusteredBarChart", "clusteredColumnChart", "hundredPercentStackedBarChart", "hundredPercentStackedColumnChart", "lineChart", "areaChart", "stackedAreaChart", "lineClusteredColumnComboChart", "lineStackedColumnComboChart", "pieChart", "donutChart", "treemap", "funnel")
NOT_RUN = ("StandardDeviation", "Variance")


def count_distinct_with_blank(c: Column) -> Column:
    """Distinct values, the blank being one of them."""
    return (F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), F.lit(1))), F.lit(0))).cast("bigint")


AGGREGATIONS: dict[str, Callable[[Column], Column]] = {"Sum": F.sum, "Avg": F.avg, "DistinctCount": count_distinct_with_blank, "Min": F.min, "Max": F.max, "Count": F.count, "Median": F.median}


@dataclass(frozen=True)
class Dimension:
    """A table, the fact's column that refers to it, and its own key."""

    table: DataFrame
    foreign: str
    key: str


@dataclass(frozen=True)
class Star:
    """A fact with its dimensions. Facts without a partner stay: their dimension columns are blank."""

    fact: DataFrame
    dimensions: tuple[Dimension, ...] = ()

    def joined(self) -> DataFrame:
        out = self.fact
        for d in self.dimensions:
            # No hint: a small dimension is broadcast by its size, a large one is joined by shuffle.
            out = out.join(d.table, out[d.foreign] == d.table[d.key], "left")
        return out


@dataclass(frozen=True)
class Visual:
    group_by: tuple[str, ...]
    values: dict[str, Column] = field(default_factory=dict)
    filters: tuple = ()
    visual_type: str = "tableEx"


def context(report: tuple, page: tuple, visual: tuple, other_slicers: tuple = ()):
    """All levels of filters intersect: of the report, the page, the visual, and the page's other slicers."""
    return Both((*report, *page, *visual, *other_slicers))


def unique_names(names: list[str]) -> list[str]:
    """A name that comes again gets (2), (3), ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def refusal(visual: Visual, is_slicer: bool = False, aggregations: tuple[str, ...] = (), field_kinds: tuple[str, ...] = (), measures: frozenset[tuple[str, str]] = frozenset()) -> str | None:
    """Why a visual's data can't be asked for, or None. measures are (table, name): a condition on one of them is no condition on rows."""
    if is_slicer:
        return "slicers have no data of their own"
    if visual.visual_type not in VISUAL_TYPES:
        return f"visual type {visual.visual_type} is not supported"
    if not visual.group_by and not visual.values:
        return "the visual has no fields"
    for kind in field_kinds:
        if kind not in ("column", "measure", "aggregation"):
            return f"a field of kind {kind} can't be asked for"
    for c in visual.filters:
        if any((f.table, f.name) in measures for f in fields_of(c)):
            return "a filter on a measure"
    for a in aggregations:
        if a not in AGGREGATIONS:
            return f"aggregation {a} is not supported"
    for c in visual.filters:
        reason = _refused_condition(c)
        if reason:
            return reason
    return None


def _refused_condition(c) -> str | None:
    if isinstance(c, Not):
        return _refused_condition(c.of)
    if isinstance(c, Both):
        return next((r for r in map(_refused_condition, c.parts) if r), None)
    if isinstance(c, In):
        if not c.rows:
            return "a condition has no values"
        if len({f.table for f in c.fields}) > 1:
            return "a condition spans several tables"
    if isinstance(c, Comparison) and c.value is None and c.operator != "=":
        return f"{c.operator} against a blank"
    return None


def visual_query(star: Star | DataFrame, visual: Visual, order: dict[str, Column] | None = None) -> DataFrame:
    """Groups of the visual's columns with their values; a card has one row, no values give the distinct keys.

    Groups whose every value is blank are left out. order gives the aggregates that TopN filters rank by.
    """
    rows = star.joined() if isinstance(star, Star) else star
    tops = [f for f in visual.filters if isinstance(f, TopN)]
    plain = tuple(f for f in visual.filters if not isinstance(f, (TopN, All)))
    rows = filtered(rows, Both(plain)) if plain else rows
    for t in tops:
        rows = top_n(rows, t, (order or {})[t.order_by])
    keys = list(dict.fromkeys(visual.group_by))
    if not visual.values:
        return rows.select(*keys).distinct()
    aggs = [c.alias(n) for c, n in zip(visual.values.values(), unique_names(list(visual.values)), strict=True)]
    out = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    return out.where(reduce(lambda a, b: a | b, [F.col(f"`{n}`").isNotNull() for n in out.columns[len(keys) :]]))


def supported_visuals(visuals: DataFrame) -> DataFrame:
    """(…, supported, reason) over a catalog of visuals(is_slicer, visual_type, n_fields, n_unread, and where known n_levels, n_measure_filters)."""
    reason = (
        F.when(F.col("is_slicer"), F.lit("slicers have no data of their own"))
        .when(~F.col("visual_type").isin(*VISUAL_TYPES), F.concat(F.lit("visual type "), F.col("visual_type"), F.lit(" is not supported")))
        .when(F.col("n_fields") == 0, F.lit("the visual has no fields"))
        .when(F.col("n_levels") > 0 if "n_levels" in visuals.columns else F.lit(False), F.lit("a field of kind hierarchy level can't be asked for"))
        .when(F.col("n_measure_filters") > 0 if "n_measure_filters" in visuals.columns else F.lit(False), F.lit("a filter on a measure"))
        .when(F.col("n_unread") > 0, F.lit("a filter could not be read"))
    )
    return visuals.withColumns({"reason": reason, "supported": reason.isNull()})


__all__ = ["AGGREGATIONS", "Dimension", "Field", "Star", "Visual", "compiled", "context", "refusal", "supported_visuals", "unique_names", "visual_query"]
