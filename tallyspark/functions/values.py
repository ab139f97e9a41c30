"""Column functions for values, keys and paths."""

from __future__ import annotations

import math
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import once

# ------------------------------------------------------------------ fixed values
# Severity of a finding by category, and by (category, change) where that differs; ranks of severities.
SEVERITY = {"page": "info", "visual": "info", "field": "warning", "filter": "critical", "slicer": "critical", "measure": "warning", "parse_issue": "warning", "data": "critical", "ai": "info"}
SEVERITY_OF_CHANGE = {
    ("page", "removed"): "critical",
    ("visual", "removed"): "critical",
    ("visual", "retyped"): "warning",
    ("filter", "retyped"): "info",
    ("measure", "added"): "info",
    ("measure", "modified"): "critical",
    ("data", "error"): "warning",
}
RANK = {"info": 0, "warning": 1, "critical": 2}
# Scope of a category; all others are of the page.
SCOPE = {"measure": "model", "parse_issue": "parse", "ai": "ai"}
MASKED, BLANK, TOTAL = "(masked)", "(blank)", "total"


def kind_of(t: T.DataType) -> str:
    """number, boolean or text: what may be compared with what. Booleans are not numbers."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "number" if isinstance(t, T.NumericType) else "text"


def without_nan(c: Column, t: T.DataType) -> Column:
    """NaN counts as null."""
    return F.nanvl(c, F.lit(None).cast(t)) if isinstance(t, (T.DoubleType, T.FloatType)) else c


def differs(old: Column, new: Column, old_type: T.DataType, new_type: T.DataType, absolute: float = 0.0, relative: float = 1e-9) -> tuple[Column, Column]:
    """(whether two values differ, their numeric delta or null).

    Numbers may differ by the absolute tolerance or the relative one of the larger magnitude,
    whichever is wider. Other values must be equal; values of different kinds never are, unless
    both are null. Null equals null only.
    """
    if kind_of(old_type) == kind_of(new_type) == "number":
        a, b = old.cast("double"), new.cast("double")
        delta = F.abs(a - b)
        allowed = F.lit(float(absolute))
        if relative > 0:
            allowed = F.greatest(allowed, F.lit(float(relative)) * F.greatest(F.abs(a), F.abs(b)))
        both = old.isNotNull() & new.isNotNull()
        return F.when(both, delta > allowed).otherwise(old.isNull() != new.isNull()), F.when(both, delta)
    if kind_of(old_type) == kind_of(new_type):
        return ~old.cast("string").eqNullSafe(new.cast("string")), F.lit(None).cast("double")
    return old.isNotNull() | new.isNotNull(), F.lit(None).cast("double")


def display(value: object) -> str:
    """A value as findings show it: null as blank, whole floats as integers. Only ever applied to the findings that are kept."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return BLANK
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def _float_text(c: Column) -> Column:
    """A fraction as Python writes it: plain from 1e-4 up to 1e16, else with an exponent of two digits at least."""
    said = c.cast("string")
    head, power = F.regexp_extract(said, r"^([^E]*)", 1), F.regexp_extract(said, r"E(-?[0-9]+)$", 1).try_cast("int")
    short = F.concat(F.regexp_replace(head, r"\.0$", ""), F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), "0"))
    return F.when(power.isNull(), said).when(power.between(-4, 15), _written_out(said)).otherwise(short)


def display_column(c: Column, t: T.DataType) -> Column:
    """display() for columns."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        # Whole numbers in two parts of 63 bits at most, all exact.
        high = F.rint(c / 2.0**40)
        parts = high.cast("bigint").cast("decimal(38,0)") * F.lit(2**40).cast("decimal(13,0)") + (c - high * 2.0**40).cast("bigint")
        whole = (c == F.rint(c)) & (F.abs(c) < 2.0**100)
        return F.when(c.isNull() | F.isnan(c), F.lit(BLANK)).when(whole, parts.cast("decimal(38,0)").cast("string")).otherwise(_float_text(c))
    if isinstance(t, T.BooleanType):
        return F.when(c.isNull(), F.lit(BLANK)).otherwise(F.initcap(c.cast("string")))
    return F.coalesce(c.cast("string"), F.lit(BLANK))


def field_key(table: Column, name: Column, aggregation: Column | None = None) -> Column:
    """`Table[Name]`, or `Sum(Table[Name])` with an aggregation."""
    key = F.concat(table, F.lit("["), name, F.lit("]"))
    return key if aggregation is None else F.when(aggregation.isNull(), key).otherwise(F.concat(aggregation, F.lit("("), key, F.lit(")")))


def visual_path(page: Column, visual: Column) -> Column:
    return F.concat_ws("/", page, visual)


def visual_of_path(path: Column) -> Column:
    """The first two segments."""
    return F.substring_index(path, "/", 2)


def ancestors(path: Column) -> Column:
    """The path and every folder above it: containment becomes an equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def is_within(path: Column, folder: Column) -> Column:
    return (folder == ".") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def severity(category: Column, change: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in SEVERITY.items():
        out = F.when(category == name, F.lit(value)).otherwise(out)
    for (name, kind), value in SEVERITY_OF_CHANGE.items():
        out = F.when((category == name) & (change == kind), F.lit(value)).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for value, rank in RANK.items():
        out = F.when(name == value, F.lit(rank)).otherwise(out)
    return out


def scope(category: Column) -> Column:
    out = F.lit("page")
    for name, value in SCOPE.items():
        out = F.when(category == name, F.lit(value)).otherwise(out)
    return out


def finding_key(scope_: Column, category: Column, change: Column, path: Column) -> Column:
    return F.concat_ws(":", scope_, category, change, path)


def unit_of_file(path: Column) -> Column:
    """The first folder named *.Report or *.SemanticModel on the path, or a *.pbit file itself; else null."""
    folder = F.regexp_extract(path, r"^((?:[^/]+/)*?[^/]*\.(?:Report|SemanticModel))(?:/|$)", 1)
    return F.when(folder != "", folder).when(F.lower(path).endswith(".pbit"), path)


# What a number looks like in a definition, and the largest exponent that is written out.
NUMBER, MAX_EXPONENT = r"^-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[LDM]?$", 100


def _with_power(text: Column) -> Column:
    """Whether the text may have an exponent. Plain searches like this one spare most texts their regular expressions."""
    return F.contains(F.lower(text), F.lit("e"))


def _shifted(text: Column) -> tuple[Column, Column]:
    """(significant digits, power of ten of the last one) of a number without suffix."""
    whole, fraction = F.regexp_extract(text, r"^-?([0-9]*)", 1), F.when(F.contains(text, F.lit(".")), F.regexp_extract(text, r"\.([0-9]*)", 1)).otherwise(F.when(text.isNotNull(), F.lit("")))
    power = F.coalesce(F.when(_with_power(text), F.regexp_extract(text, r"[eE]([+-]?[0-9]{1,6})$", 1).try_cast("int")), F.lit(0))
    return F.ltrim(F.concat(whole, fraction), F.lit("0")), power - F.length(fraction)


def _written_out(text: Column, taken: tuple[Column, Column] | None = None) -> Column:
    """A number without exponent, leading and trailing zeros; -0 is 0. taken: what _shifted gives, where that is a column already."""
    digits, power = taken or _shifted(text)
    padded = F.lpad(digits, F.greatest(F.length(digits), 1 - power), "0")
    point = F.length(padded) + power
    broken = F.regexp_replace(F.regexp_replace(F.concat(F.substring(padded, F.lit(1), point), F.lit("."), F.substring(padded, point + 1, F.length(padded))), "0+$", ""), r"\.$", "")
    size = F.when(power >= 0, F.concat(digits, F.repeat(F.lit("0"), F.greatest(power, F.lit(0))))).otherwise(broken)
    return F.when(digits == "", F.lit("0")).otherwise(F.concat(F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit("")), size))


def literal_kind(raw: Column, taken: tuple[Column, Column] | None = None) -> Column:
    """number, text, boolean, datetime, null or other."""
    digits, power = taken or _shifted(F.regexp_replace(raw, "[LDM]$", ""))
    writable = (F.abs(F.greatest(F.length(digits) - 1, F.lit(0)) + power) <= MAX_EXPONENT) & ~(_with_power(raw) & raw.rlike(r"[eE][+-]?[0-9]{7,}"))
    return (
        F.when(raw == "null", F.lit("null"))
        .when(F.lower(raw).isin("true", "false"), F.lit("boolean"))
        .when(F.startswith(raw, F.lit("datetime'")) & raw.rlike(r"^datetime'[^']*'$"), F.lit("datetime"))
        .when(F.startswith(raw, F.lit("'")) & raw.rlike(r"^'(?:[^']|'')*'$"), F.lit("text"))
        .when(raw.rlike(NUMBER) & writable, F.lit("number"))
        .otherwise(F.lit("other"))
    )


def literal_value(raw: Column, kind: Column | None = None, taken: tuple[Column, Column] | None = None) -> Column:
    """The literal without its marks: numbers written out without suffix and trailing zeros, texts without quotes."""
    kind = literal_kind(raw) if kind is None else kind
    return (
        F.when(kind == "number", _written_out(F.regexp_replace(raw, "[LDM]$", ""), taken))
        .when(kind == "text", F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'")))
        .when(kind == "datetime", F.regexp_extract(raw, "^datetime'(.*)'$", 1))
        .when(kind == "boolean", F.lower(raw))
        .when(kind == "other", raw)
    )


def with_literals(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with kind and value of a column of literals, as literal_kind and literal_value tell them; each literal is taken apart once."""
    text, taken = F.col(raw), (F.col("_taken.digits"), F.col("_taken.power"))
    digits, power = _shifted(F.col("_bare"))
    rows = once(df, {"_bare": F.regexp_replace(text, "[LDM]$", "")})
    rows = once(rows, {"_taken": F.when(text.rlike(NUMBER), F.struct(digits.alias("digits"), power.alias("power")))})
    rows = once(rows, {"kind": literal_kind(text, taken)})
    return rows.select(*[c for c in df.columns if c not in ("kind", "value")], "kind", literal_value(text, F.col("kind"), taken).alias("value"))


def read_literal(raw: str) -> object:
    """The value of one literal, by the same rules as literal_kind and literal_value: None, bool, int, float or text."""
    if raw == "null":
        return None
    if raw.lower() in ("true", "false"):
        return raw.lower() == "true"
    for pattern in ("datetime'([^']*)'", "'((?:[^']|'')*)'"):
        if m := re.fullmatch(pattern, raw):
            return m[1].replace("''", "'")
    if re.match(NUMBER, raw):
        number = Decimal(raw.rstrip("LDM"))
        if abs(number.adjusted()) <= MAX_EXPONENT:
            return int(number) if number == number.to_integral_value() else float(number)
    return raw
