"""Align two results on their keys and compare their values.

Both sides are tagged, put under one another and grouped by the keys: one shuffle aligns them,
nulls meet nulls, and repeated keys show as counts above one. Partial aggregation takes what a
frequent key would otherwise send to one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import positions_within
from ..functions.values import MASKED, TOTAL, differs, display_column, kind_of, without_nan

MAX_FINDINGS = 20


@dataclass(frozen=True)
class Tolerance:
    absolute: float = 0.0
    relative: float = 1e-9

    def __post_init__(self):
        for x in (self.absolute, self.relative):
            if not math.isfinite(x) or x < 0:
                raise ValueError(f"a tolerance must be finite and not negative: {x}")


#: Bytes of a result from which it may be cut off (a fixed value).
NEAR_BYTES = 13_500_000
Pairs = list[tuple[str, str]]


def pairs(names) -> Pairs:
    """Names or (old name, new name) pairs as pairs."""
    return [n if isinstance(n, tuple) else (n, n) for n in names]


def missing_columns(side: DataFrame, names: list[str], label: str) -> str | None:
    missing = [n for n in names if n not in side.columns]
    return f"{label} result lacks {', '.join(missing)}" if missing and side.columns else None


def _key(c: Column, t: T.DataType, other: T.DataType) -> Column:
    """Keys of one kind have one type; keys of different kinds stay apart as (kind, number, text)."""
    c = without_nan(c, t)
    kinds = kind_of(t), kind_of(other)
    if kinds[0] != kinds[1]:
        number = c.cast("double") if kinds[0] == "number" else F.lit(None).cast("double")
        text = c.cast("string") if kinds[0] != "number" else F.lit(None).cast("string")
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(F.lit({"number": 1, "boolean": 2, "text": 3}[kinds[0]]).alias("kind"), number.alias("number"), text.alias("text")))
    if kinds[0] == "number" and t != other:
        return c.cast("bigint" if all(isinstance(x, T.IntegralType) for x in (t, other)) else "double")
    return c if t == other else c.cast("string")


def align(sides: dict[str, DataFrame], keys: list[tuple[str, ...]], values: list[tuple[str, ...]], by: list[str] = ()) -> DataFrame:
    """One row for each key: k0.., rows of each side as n_<side>, and each side's values as <side>_v0... .

    keys and values give the name on each side, in the order of sides. by are columns of all
    sides that always stand before the keys (the path of a result, when many are aligned at once).
    """
    names = list(sides)
    first = {n: sides[n] for n in names}
    rows = []
    for i, n in enumerate(names):
        schema = first[n].schema
        cols = [F.col(f"`{b}`") for b in by]
        for j, k in enumerate(keys):
            types = [first[m].schema[k[x]].dataType for x, m in enumerate(names)]
            other = next((t for t in types if kind_of(t) != kind_of(types[i])), next((t for t in types if t != types[i]), types[i]))
            cols.append(_key(F.col(f"`{k[i]}`"), types[i], other).alias(f"k{j}"))
        for j, v in enumerate(values):
            cols.append(without_nan(F.col(f"`{v[i]}`"), schema[v[i]].dataType).alias(f"{n}_v{j}"))
        rows.append(first[n].select(*cols, *[F.lit(1 if m == n else 0).alias(f"_{m}") for m in names]))
    tagged = rows[0]
    for r in rows[1:]:
        tagged = tagged.unionByName(r, allowMissingColumns=True)
    group = [*by, *[f"k{j}" for j in range(len(keys))]]
    aggs = [F.sum(f"_{n}").alias(f"n_{n}") for n in names]
    aggs += [F.any_value(F.col(f"{n}_v{j}"), F.lit(True)).alias(f"{n}_v{j}") for n in names for j in range(len(values))]
    grouped = tagged.groupBy(*group).agg(*aggs) if group else tagged.agg(*aggs).where(" + ".join(f"coalesce(n_{n}, 0)" for n in names) + " > 0")
    return grouped


def compared(aligned: DataFrame, n_values: int, tolerance: Tolerance, old: str = "old", new: str = "new") -> DataFrame:
    """Adds d0.. (value differs), delta0.., both, only_old, only_new, differing (matched rows with a difference), delta (largest)."""
    schema = aligned.schema
    both = (F.col(f"n_{old}") > 0) & (F.col(f"n_{new}") > 0)
    cols = {}
    for j in range(n_values):
        a, b = f"{old}_v{j}", f"{new}_v{j}"
        d, delta = differs(F.col(a), F.col(b), schema[a].dataType, schema[b].dataType, tolerance.absolute, tolerance.relative)
        cols[f"d{j}"], cols[f"delta{j}"] = both & d, F.when(both, delta)
    out = aligned.withColumns({"both": both, "only_old": (F.col(f"n_{new}") == 0), "only_new": (F.col(f"n_{old}") == 0)} | cols)
    any_d = F.lit(False)
    for j in range(n_values):
        any_d = any_d | F.col(f"d{j}")
    deltas = [F.col(f"delta{j}") for j in range(n_values)]
    largest = F.greatest(*deltas) if len(deltas) > 1 else deltas[0] if deltas else F.lit(None).cast("double")
    return out.withColumns({"differing": any_d, "delta": largest})


def _several(label: str, keyed: bool) -> str:
    return f"{label} result repeats a key" if keyed else f"{label} result has more than one row and no keys"


def summarise(rows: DataFrame, keyed: bool, by: list[str] = (), old: str = "old", new: str = "new") -> DataFrame:
    """Status and counts of compared() rows: one row, or one for each value of by. Repeated keys on a side refuse the comparison, the old side first."""
    aggs = [
        F.coalesce(F.sum(f"n_{old}"), F.lit(0)).alias("rows_old"),
        F.coalesce(F.sum(f"n_{new}"), F.lit(0)).alias("rows_new"),
        F.count_if("both").alias("rows_matched"),
        F.count_if("differing").alias("rows_differing"),
        F.count_if("only_old").alias("rows_only_old"),
        F.count_if("only_new").alias("rows_only_new"),
        F.max("delta").alias("max_abs_delta"),
        F.coalesce(F.max(f"n_{old}"), F.lit(0)).alias("_repeat_old"),
        F.coalesce(F.max(f"n_{new}"), F.lit(0)).alias("_repeat_new"),
    ]
    s = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    reason = F.when(F.col("_repeat_old") > 1, F.lit(_several("old", keyed))).when(F.col("_repeat_new") > 1, F.lit(_several("new", keyed)))
    changed = (F.col("rows_differing") + F.col("rows_only_old") + F.col("rows_only_new")) > 0
    status = F.when(reason.isNotNull(), F.lit("not_validated")).when(changed, F.lit("different")).otherwise(F.lit("same"))
    keep = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    return s.select(*by, status.alias("status"), *map(keep, ("rows_old", "rows_new", "rows_matched", "rows_differing", "rows_only_old", "rows_only_new", "max_abs_delta")), reason.alias("reason"))


def compare_tables(path: str, old: DataFrame, new: DataFrame, keys, values, tolerance: Tolerance = Tolerance(), max_findings: int = MAX_FINDINGS, show_values: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summary, findings) of two results.

    keys and values are names, or (old name, new name) pairs. The summary counts everything;
    findings are the first max_findings in the order of keys (nulls first, then numbers, then
    text) and values. Unless show_values, rows are named by their position among all aligned
    rows and values are masked.
    """
    keys, values = pairs(keys), pairs(values)
    for side, i, label in ((old, 0, "old"), (new, 1, "new")):
        reason = missing_columns(side, [p[i] for p in [*keys, *values]], label)
        if reason:
            return _refused(old.sparkSession, path, reason)
    rows = compared(align({"old": old, "new": new}, keys, values), len(values), tolerance)
    summary = summarise(rows, bool(keys)).select(F.lit(path).alias("path"), "*")
    return summary, findings_of(rows, path, [k[0] for k in keys], [v[0] for v in values], max_findings, show_values)


def _refused(spark, path: str, reason: str) -> tuple[DataFrame, DataFrame]:
    summary = spark.range(1).select(F.lit(path).alias("path"), F.lit("not_validated").alias("status"), *[F.lit(None).cast("bigint").alias(c) for c in ("rows_old", "rows_new", "rows_matched", "rows_differing", "rows_only_old", "rows_only_new")], F.lit(None).cast("double").alias("max_abs_delta"), F.lit(reason).alias("reason"))
    finding = spark.range(1).select(F.lit(f"{path}/data").alias("path"), F.lit("error").alias("change"), F.lit(f"The data could not be compared: {reason}").alias("message"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    return summary, finding


def _ordered_key(c: Column, t: T.DataType) -> list[Column]:
    if isinstance(t, T.StructType):
        return [c["kind"].asc_nulls_first(), c["number"].asc_nulls_first(), c["text"].asc_nulls_first()]
    return [c.asc_nulls_first()]


def findings_of(rows: DataFrame, path: str, names: list[str], value_names: list[str], most: int, show: bool) -> DataFrame:
    """(path, change, message, old, new) of the first findings.

    The rows that have findings are taken first, by key, at most `most` of them; only those get
    a position, by counting how many keys come before them. So no window orders all rows.
    """
    n_keys = len(names)
    order = [o for j in range(n_keys) for o in _ordered_key(F.col(f"k{j}"), rows.schema[f"k{j}"].dataType)]
    changed = rows.where("differing OR only_old OR only_new")
    first = (changed.orderBy(*order) if order else changed).limit(most)
    if not show and n_keys:
        # A row's position: rows whose key tuple does not come after its own. The taken rows are at most `most`, so the broadcast is bounded.
        lists = F.struct(*[x for j in range(n_keys) for x in _comparable(F.col(f"k{j}"), rows.schema[f"k{j}"].dataType)])
        cuts = first.select(lists.alias("cut")).distinct()
        counted = rows.select(lists.alias("at")).join(F.broadcast(cuts), F.col("at") <= F.col("cut")).groupBy("cut").agg(F.count("*").alias("position"))
        first = first.withColumn("cut", lists).join(F.broadcast(counted), "cut")
        label = F.concat(F.lit("row "), F.col("position").cast("string"))
    elif n_keys:
        label = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), display_column(F.col(f"k{j}"), rows.schema[f"k{j}"].dataType)) for j, n in enumerate(names)])
    else:
        label = F.lit(TOTAL)
    first = first.withColumn("label", label)
    subject = F.concat(F.lit("Row "), F.col("label")) if show else F.concat(F.upper(F.substring("label", 1, 1)), F.substring("label", 2, 1000))
    one = F.array(F.struct(F.lit(-1).alias("j"), F.when(F.col("only_new"), "added").otherwise("removed").alias("change"), F.concat(F.lit(f"{path}/data/"), F.col("label")).alias("path"), F.concat(subject, F.when(F.col("only_new"), " stands on the new side alone").otherwise(" stands on the old side alone")).alias("message"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    shown = lambda c: display_column(F.col(c), rows.schema[c].dataType) if show else F.lit(MASKED)
    each = [F.when(F.col(f"d{j}"), F.struct(F.lit(j).alias("j"), F.lit("modified").alias("change"), F.concat(F.lit(f"{path}/data/"), F.col("label"), F.lit(f"/{v}")).alias("path"), F.concat(F.lit(f"{v} changed at "), F.col("label")).alias("message"), shown(f"old_v{j}").alias("old"), shown(f"new_v{j}").alias("new"))) for j, v in enumerate(value_names)]
    every = F.when(~F.col("both"), one).otherwise(F.filter(F.array(*each), lambda x: x.isNotNull())) if each else one
    out = first.select(*[f"k{j}" for j in range(n_keys)], F.explode(every).alias("f"))
    return out.orderBy(*order, F.col("f.j")).limit(most).select("f.path", "f.change", "f.message", "f.old", "f.new")


def _comparable(c: Column, t: T.DataType) -> list[Column]:
    """Columns whose struct sorts like the key: nulls come first in a struct's order."""
    if isinstance(t, T.StructType):
        return [c["kind"], c["number"], c["text"]]
    return [c]


def row_positions(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Adds position among the rows of one result, nulls first; results are told apart by `by`."""
    return positions_within(rows, by, [F.col(k) for k in keys])


def attribute(old: DataFrame, cross: DataFrame, new: DataFrame, keys, values, tolerance: Tolerance = Tolerance(), by: list[str] = ()) -> DataFrame:
    """(by.., attribution, attribution_reason): whether the report (old against cross) or the model (cross against new) made the difference. All three sides are aligned in one shuffle."""
    keys, values = pairs(keys), pairs(values)
    three = lambda ps: [(a, b, b) for a, b in ps]
    rows = align({"old": old, "cross": cross, "new": new}, three(keys), three(values), by)
    flags = {}
    for name, a, b in (("report", "old", "cross"), ("model", "cross", "new")):
        d = (F.col(f"n_{a}") > 0) != (F.col(f"n_{b}") > 0)
        for j in range(len(values)):
            x, y = f"{a}_v{j}", f"{b}_v{j}"
            d = d | differs(F.col(x), F.col(y), rows.schema[x].dataType, rows.schema[y].dataType, tolerance.absolute, tolerance.relative)[0]
        flags[name] = d
    keyed = bool(keys)
    aggs = [F.coalesce(F.bool_or(flags[n]), F.lit(False)).alias(n) for n in flags] + [F.max(f"n_{s}").alias(f"m_{s}") for s in ("old", "cross", "new")]
    s = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    refused = F.lit(None).cast("string")
    for label, a, b in (("model", "cross", "new"), ("report", "old", "cross")):  # the report's reason counts first
        refused = F.when(F.col(f"m_{a}") > 1, F.lit(f"the {label} change: {_several('old', keyed)}")).when(F.col(f"m_{b}") > 1, F.lit(f"the {label} change: {_several('new', keyed)}")).otherwise(refused)
    verdict = F.when(F.col("report") & F.col("model"), "both").when(F.col("report"), "report").when(F.col("model"), "model").otherwise("unknown")
    reason = F.coalesce(refused, F.when(verdict == "unknown", F.lit("neither change alone reproduces the difference")))
    return s.select(*by, F.when(refused.isNotNull(), F.lit("unknown")).otherwise(verdict).alias("attribution"), reason.alias("attribution_reason"))


def paired_values(old: list[str], new: list[str], renames: dict[str, str]) -> tuple[Pairs, list[str], list[str]]:
    """(values on both sides, only old, only new); old names are looked up in renames once."""
    to = {o: renames.get(o, o) for o in old}
    both = [(o, to[o]) for o in old if to[o] in new]
    return both, [o for o in old if to[o] not in new], [n for n in new if n not in set(to.values())]


def partly_compared(summary: DataFrame, unpaired: Column) -> DataFrame:
    """`same` becomes `not_validated` where values had no partner; `different` stays. unpaired: their names, or null."""
    some = unpaired.isNotNull() & (F.length(unpaired) > 0)
    return summary.withColumns({"status": F.when(some & (F.col("status") == "same"), F.lit("not_validated")).otherwise(F.col("status")), "reason": F.when(some, F.concat(F.lit("not compared: "), unpaired)).otherwise(F.col("reason"))})


def completeness(counts: DataFrame, rows: str, columns: str, max_rows: int = 100_000, max_values: int = 1_000_000, size: str | None = None, near_bytes: int = NEAR_BYTES) -> DataFrame:
    """Adds `truncated`: a result as large as its source may return can be cut off, by its rows, its values, or (size: a column of bytes) by what it takes."""
    cut = (F.col(rows) >= max_rows) | ((F.col(rows) + 1) * F.col(columns) > max_values)
    if size:
        cut = cut | (F.col(size) >= near_bytes)
    return counts.withColumn("truncated", cut)
