"""Filter conditions: small trees on the driver, compiled to columns, rendered as text, renamed.

Logic is two-valued: a leaf that is null is false before `not` turns it round, so that a blank
row survives `not in (...)`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer lists are joined (by broadcast where small enough) rather than put into the plan.
MAX_INLINE = 1000


@dataclass(frozen=True)
class Field:
    table: str
    name: str

    @property
    def key(self) -> str:
        return f"{self.table}[{self.name}]"


@dataclass(frozen=True)
class In:
    """One field, or several that are compared together, among given rows of values."""

    fields: tuple[Field, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Comparison:
    field: Field
    operator: str
    value: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    parts: tuple
    operator: str = "and"


@dataclass(frozen=True)
class All:
    """Keeps every row."""


@dataclass(frozen=True)
class TopN:
    """The n values of a field with the most (or least) of an aggregate: order_by as it is shown, or the field and aggregation it is made of."""

    field: Field
    n: int
    order_by: str
    largest: bool = True
    by: Field | None = None
    aggregation: str | None = None

    @property
    def order(self) -> str:
        if self.by is None:
            return self.order_by
        return f"{self.aggregation}({self.by.key})" if self.aggregation else self.by.key


def compiled(condition, column=lambda f: F.col(f.name)) -> Column:
    """The condition as a boolean column that is never null. column tells where a field is found."""
    if isinstance(condition, All):
        return F.lit(True)
    if isinstance(condition, Not):
        return ~compiled(condition.of, column)
    if isinstance(condition, Both):
        parts = [compiled(p, column) for p in condition.parts]
        return reduce((lambda a, b: a & b) if condition.operator == "and" else (lambda a, b: a | b), parts, F.lit(condition.operator == "and")) if parts else F.lit(True)
    if isinstance(condition, In):
        if not condition.rows:
            raise ValueError("an empty list of values")
        cols = [column(f) for f in condition.fields]
        if len(cols) == 1:
            values = [r[0] for r in condition.rows]
            some = [v for v in values if v is not None]
            inside = F.coalesce(cols[0].isin(some), F.lit(False)) if some else F.lit(False)
            return inside | cols[0].isNull() if None in values else inside
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [c.eqNullSafe(F.lit(v)) for c, v in zip(cols, r, strict=True)]) for r in condition.rows])
    if isinstance(condition, Comparison):
        c = column(condition.field)
        if condition.value is None:
            if condition.operator != "=":
                raise ValueError(f"{condition.operator} against a blank")
            return c.isNull()
        made = {"=": c == condition.value, ">": c > condition.value, ">=": c >= condition.value, "<": c < condition.value, "<=": c <= condition.value}[condition.operator]
        return F.coalesce(made, F.lit(False))
    raise ValueError(f"not a row condition: {condition!r}")


def filtered(df: DataFrame, condition, column=lambda f: F.col(f.name)) -> DataFrame:
    """Rows that fit. A long list of values becomes a table to semi-join, null-safe."""
    if isinstance(condition, In) and len(condition.rows) > MAX_INLINE:
        names = [f"_in{i}" for i in range(len(condition.fields))]
        wanted = df.sparkSession.createDataFrame([tuple(r) for r in condition.rows], names).distinct()
        on = reduce(lambda a, b: a & b, [column(f).eqNullSafe(wanted[n]) for f, n in zip(condition.fields, names, strict=True)])
        return df.join(wanted, on, "left_semi")
    if isinstance(condition, Both) and condition.operator == "and":
        return reduce(lambda d, c: filtered(d, c, column), condition.parts, df)
    return df.where(compiled(condition, column))


def top_n(df: DataFrame, condition: TopN, order: Column) -> DataFrame:
    """Rows whose value is among the top ones by the aggregate `order`; ties at the border all stay."""
    c = condition.field.name
    best = df.groupBy(c).agg(order.alias("_o"))
    # The least value that still counts is found by take-ordered instead of a global window.
    cut = best.orderBy(F.col("_o").desc_nulls_last() if condition.largest else F.col("_o").asc_nulls_last()).limit(condition.n).agg((F.min if condition.largest else F.max)("_o").alias("_cut"))
    kept = best.crossJoin(F.broadcast(cut)).where(F.col("_o") >= F.col("_cut") if condition.largest else F.col("_o") <= F.col("_cut")).select(F.col(c).alias("_k"))
    return df.join(kept, F.col(c).eqNullSafe(F.col("_k")), "left_semi")


def literal(value) -> str:
    if value is None:
        return "blank"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def _sort(value) -> tuple:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return (0, 0.0, "") if value is None else (1, float(value), "") if number else (2, 0.0, f"{type(value).__name__}:{value}")


def rendered(condition) -> str:
    """Normalised text: the order in which values were picked does not matter."""
    if isinstance(condition, All):
        return "all"
    if isinstance(condition, Not):
        return f"not {rendered(condition.of)}"
    if isinstance(condition, Both):
        return f" {condition.operator} ".join(f"({rendered(p)})" if isinstance(p, Both) else rendered(p) for p in condition.parts)
    if isinstance(condition, TopN):
        return f"{'top' if condition.largest else 'bottom'} {condition.n} {condition.field.key} by {condition.order}"
    if isinstance(condition, Comparison):
        return f"{condition.field.key} {condition.operator} {literal(condition.value)}"
    rows = sorted(set(condition.rows), key=lambda r: [_sort(v) for v in r])
    one = len(condition.fields) == 1
    names = condition.fields[0].key if one else "(" + ", ".join(f.key for f in condition.fields) + ")"
    return f"{names} in (" + ", ".join(literal(r[0]) if one else "(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def fields_of(condition) -> list[Field]:
    """Every field that a condition asks about."""
    if isinstance(condition, Not):
        return fields_of(condition.of)
    if isinstance(condition, Both):
        return [f for p in condition.parts for f in fields_of(p)]
    if isinstance(condition, In):
        return list(condition.fields)
    if isinstance(condition, TopN) and condition.by:
        return [condition.field, condition.by]
    return [] if isinstance(condition, All) else [condition.field]


def renamed(condition, renames: dict[tuple[str, str], tuple[str, str]]):
    """The condition with its fields looked up once; chains are not followed."""

    def move(f: Field) -> Field:
        return Field(*renames.get((f.table, f.name), (f.table, f.name)))

    if isinstance(condition, Not):
        return Not(renamed(condition.of, renames))
    if isinstance(condition, Both):
        return replace(condition, parts=tuple(renamed(p, renames) for p in condition.parts))
    if isinstance(condition, In):
        return replace(condition, fields=tuple(map(move, condition.fields)))
    if isinstance(condition, TopN):
        return replace(condition, field=move(condition.field), by=condition.by and move(condition.by))
    if isinstance(condition, Comparison):
        return replace(condition, field=move(condition.field))
    return condition


# ------------------------------------------------------------------ as text, for tables


def _pair(f: Field | None) -> list[str] | None:
    return f and [f.table, f.name]


def _node(condition) -> dict:
    if isinstance(condition, Not):
        return {"not": _node(condition.of)}
    if isinstance(condition, Both):
        return {condition.operator: [_node(p) for p in condition.parts]}
    if isinstance(condition, In):
        return {"in": [_pair(f) for f in condition.fields], "rows": [list(r) for r in condition.rows]}
    if isinstance(condition, Comparison):
        return {"compare": _pair(condition.field), "operator": condition.operator, "value": condition.value}
    if isinstance(condition, TopN):
        return {"top": condition.n, "field": _pair(condition.field), "largest": condition.largest, "order_by": condition.order_by, "by": _pair(condition.by), "aggregation": condition.aggregation}
    return {}


def as_tree(condition) -> str:
    """A condition as JSON, which a column of a catalog can hold."""
    return json.dumps(_node(condition), ensure_ascii=False, separators=(",", ":"))


def of_tree(tree: str | dict):
    """The condition of as_tree()."""
    n = json.loads(tree) if isinstance(tree, str) else tree
    if "not" in n:
        return Not(of_tree(n["not"]))
    for operator in ("and", "or"):
        if operator in n:
            return Both(tuple(map(of_tree, n[operator])), operator)
    if "in" in n:
        return In(tuple(Field(*f) for f in n["in"]), tuple(map(tuple, n["rows"])))
    if "compare" in n:
        return Comparison(Field(*n["compare"]), n["operator"], n["value"])
    if "top" in n:
        return TopN(Field(*n["field"]), n["top"], n["order_by"], n["largest"], n["by"] and Field(*n["by"]), n["aggregation"])
    return All()
