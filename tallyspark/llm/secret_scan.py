"""Secret scans with multipart credential linking; built-in functions only.

Patterns find what is a secret by its form (base spans). Beside these stand weak candidates: an
assigned user name, a mixed token, an address of a server. Alone they are everyday text; together
they make a credential. So identifiers, secrets and endpoints are joined as intervals inside
scopes: a scope is a block of a text without blank lines, and two parts meet when at most `reach`
code points lie between them. A weak identifier or secret is reported when it meets a strong
(base) part of the other kind, or a weak one and an endpoint; an endpoint when it meets an
identifier and a secret.

The join sorts the parts of each text once in either direction and carries the nearest part of each
kind along, so no pairs are made. Equal texts are judged once, and only texts with weak candidates
are judged at all; a task holds the parts of whole texts, texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content_key, materialize
from .spans import SPAN, located, names_of, replaced

#: Kinds in the order in which spans with one start stand: three of the base patterns, three of weak candidates.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
MASKS = {"assign": "[SECRET]", "access": "[ACCESS]", "hex": "[HEX]", "id": "[ID]", "key": "[SECRET]", "endpoint": "[ENDPOINT]"}
#: Most code points between two parts that meet.
REACH = 300

# Base patterns, and what their matches must have to count.
_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)  # noqa: E731  letters in either case, ASCII ones only
_NAMES = "|".join([*map(_EITHER, ("password", "passwd", "secret", "token")), _EITHER("api") + "_?" + _EITHER("key")])
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = rf"""^(?:{_NAMES})["']?\x20*[:=]\x20*["']?"""
LEAST_VALUE = 6
# A run that is too short holds no longer one, so what is too short need not be matched and dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak candidates: anything assigned, told apart by the end of its name; addresses; tokens by their mixture.
ASSIGNED = r"""[A-Za-z][A-Za-z0-9_.-]{1,40}["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.:=-]{3,}"""
ID_NAME = r"(?:user(?:_?(?:name|id))?|login|account(?:_?(?:name|id))?|client_?id|key_?id|tenant_?id)$"
KEY_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|key|credentials?|auth|bearer)$"
ENDPOINT_NAME = r"(?:host(?:name)?|server|endpoint|url|uri|dsn)$"
ADDRESS = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|[A-Za-z0-9][A-Za-z0-9.-]{2,253}:[0-9]{2,5}"""
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Where scopes end.
BLANK_LINE = r"\n[\x20\t\r]*\n"

_ID, _KEY, _ENDPOINT, _BREAK = 3, 4, 5, 9


def _found(text: Column, pattern: str, kind: int, *sign: str) -> Column:
    """located(), for texts that hold all of the given characters only."""
    test = F.regexp(text, F.lit(pattern))
    for s in sign:
        test = F.contains(text, F.lit(s)) & test
    return F.when(test, located(text, pattern, kind)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The base secrets of a text, by start and kind. Matches that are too short are dropped, not tried again."""
    assign = F.filter(_found(text, ASSIGN, 0), lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_VALUE, "")) >= LEAST_VALUE)
    return F.array_sort(F.concat(assign, _found(text, ACCESS, 1, "AKIA"), _found(text, HEX, 2)))


def _weak(text: Column) -> Column:
    """array of (start, kind, end, level) of the weak candidates of a text; of two that overlap the one of the lower level counts."""
    name = lambda s: F.lower(F.regexp_extract(s["value"], r"^([A-Za-z0-9_.-]+)", 1))
    part = lambda s, kind, level: F.struct(s["start"].alias("start"), kind.cast("int").alias("kind"), s["end"].alias("end"), F.lit(level).alias("level"))
    of_name = lambda s: F.when(name(s).rlike(ID_NAME), _ID).when(name(s).rlike(KEY_NAME), _KEY).when(name(s).rlike(ENDPOINT_NAME), _ENDPOINT)
    assigned = F.transform(_found(text, ASSIGNED, 0), lambda s: part(s, of_name(s), 1))
    address = F.transform(F.filter(_found(text, ADDRESS, 0, ":"), lambda s: F.contains(s["value"], F.lit("."))), lambda s: part(s, F.lit(_ENDPOINT), 2))
    has = lambda s, what: s["value"].rlike(what)
    of_token = lambda s: F.when(has(s, "^[A-Z0-9]+$") & has(s, "[A-Z]") & has(s, "[0-9]"), _ID).when(has(s, "[0-9]") & ((has(s, "[a-z]") & has(s, "[A-Z]")) | (has(s, "^[0-9a-f]+$") & has(s, "[a-f]"))), _KEY)
    token = F.transform(_found(text, TOKEN, 0), lambda s: part(s, of_token(s), 3))
    return F.filter(F.concat(assigned, address, token), lambda s: s["kind"].isNotNull())


def _nearest(kinds: Column, back: Window, on: Window) -> tuple[Column, Column]:
    """The part of some kinds that ends last before a row in order, and the one that starts first after it: (end, start) and (start, end)."""
    before = F.max(F.when(kinds, F.struct("end", "start"))).over(back)
    after = F.min(F.when(kinds, F.struct("start", "end"))).over(on)
    return before, after


def _parts(found: DataFrame) -> DataFrame:
    """found(key, base, weak, breaks) → (key, scope, start, kind, end, weak): the parts of each different text that has weak candidates, those that overlap a stronger one left out."""
    texts = found.where(F.size("weak") > 0).select("key", "base", "weak", "breaks").dropDuplicates(["key"])
    strong = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0).alias("level")))
    ends = F.transform("breaks", lambda s: F.struct(s["start"].alias("start"), F.lit(_BREAK).alias("kind"), s["start"].alias("end"), F.lit(_BREAK).alias("level")))
    rows = texts.select("key", F.explode(F.concat(strong, "weak", ends)).alias("p")).select("key", "p.*")
    order = ["start", "level", "kind", "end"]
    back = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy("key").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    overlaps = F.lit(False)
    for level in (1, 2, 3):
        before, after = _nearest(F.col("level") < level, back, on)
        overlaps = overlaps | ((F.col("level") == level) & F.coalesce((before["end"] > F.col("start")) | (after["start"] < F.col("end")), F.lit(False)))
    scope = F.coalesce(F.sum(F.when(F.col("kind") == _BREAK, 1)).over(back), F.lit(0))
    rows = rows.select("*", scope.alias("scope"), overlaps.alias("overlaps"))
    return rows.where(~F.col("overlaps") & (F.col("kind") != _BREAK)).select("key", "scope", "start", "kind", "end", (F.col("level") > 0).alias("weak"))


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """parts with, for identifiers, secrets and endpoints, and for strong ones of the first two, the nearest part of the same scope within reach: columns id, key_part, endpoint, strong_id and strong_key as (start, end)."""
    order = ["start", "kind", "end"]
    back = Window.partitionBy("key", "scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy("key", "scope").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    kind, weak = F.col("kind"), F.col("weak")
    strong_id, strong_key = kind == 1, kind.isin(0, 2)
    wanted = {"strong_id": strong_id, "strong_key": strong_key, "id": strong_id | (kind == _ID), "key_part": strong_key | (kind == _KEY), "endpoint": kind == _ENDPOINT}
    out = parts
    for name, kinds in wanted.items():
        before, after = _nearest(kinds, back, on)
        out = out.withColumns({f"_{name}_b": before, f"_{name}_a": after})
    near = {}
    for name in wanted:
        b, a = F.col(f"_{name}_b"), F.col(f"_{name}_a")
        gap_b, gap_a = F.col("start") - b["end"], a["start"] - F.col("end")
        here = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
        near[name] = F.when((gap_b <= reach) & (gap_a.isNull() | (gap_b <= gap_a)), here(b["start"], b["end"])).when(gap_a <= reach, here(a["start"], a["end"]))
    return out.select(*parts.columns, *[v.alias(k) for k, v in near.items()])


def _reported() -> Column:
    has = lambda name: F.col(name).isNotNull()
    kind = F.col("kind")
    return (
        F.when(kind == _ID, has("strong_key") | (has("key_part") & has("endpoint")))
        .when(kind == _KEY, has("strong_id") | (has("id") & has("endpoint")))
        .when(kind == _ENDPOINT, has("id") & has("key_part"))
        .otherwise(F.lit(False))
    )


def _scanned(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    whole = F.make_valid_utf8(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), content_key(F.col(text)).alias("key"), whole.alias("text"))
    rows = rows.withColumn("weak", _weak(F.col("text")))
    breaks = F.when(F.size("weak") > 0, F.transform(located(F.col("text"), BLANK_LINE, _BREAK), lambda s: F.struct(s["start"].alias("start"))))
    return materialize(rows.select("doc_id", "key", base_spans(F.col("text")).alias("base"), "weak", breaks.alias("breaks")), "secrets")


def secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", reach: int = REACH) -> DataFrame:
    """doc_id, key (of the text), base and spans of every row of docs.

    base has the spans of the base patterns, spans those and the weak candidates that are linked;
    a span is (start, kind, end) with code points from 0, the end exclusive, and kind an index of
    KINDS; both stand by start and kind. A weak candidate that overlaps a base span, or a candidate
    of a surer sort (assigned before addresses before tokens), is none. Null and empty texts have no
    spans, bytes that are not UTF-8 count as replacement characters, repeated rows get equal spans,
    null ids stay, other columns are ignored, and an empty table gives an empty result.
    """
    found = _scanned(docs, text, doc_id)
    added = _linked(_parts(found), reach).where(_reported()).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = found.select("doc_id", "key", plain.alias("base")).join(added, "key", "left")
    return out.select("doc_id", "key", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))


def credentials(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", reach: int = REACH) -> DataFrame:
    """doc_id, start, end, kind (a name) of every secret part that is linked in its scope, and the nearest identifier and endpoint as (start, end), null without one. One row for each row of docs and secret; rows of equal texts are alike."""
    found = _scanned(docs, text, doc_id)
    linked = _linked(_parts(found), reach).where(F.col("kind").isin(0, 2) & (F.col("id").isNotNull() | F.col("endpoint").isNotNull()) | (F.col("kind") == _KEY) & _reported())
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return found.select("doc_id", "key").join(linked, "key").select("doc_id", "start", "end", name.alias("kind"), F.col("id").alias("identifier"), "endpoint")


def redacted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, with every span of the text masked by its kind. Of overlapping spans the first is masked, and the others with it."""
    spans = secrets(docs, text, doc_id, **options).where(F.size("spans") > 0).select(F.col("key").alias("_key"), F.col("spans").alias("_spans")).dropDuplicates(["_key"])
    rows = docs.withColumn("_key", content_key(F.col(text))).join(spans, "_key", "left")
    label = lambda x: F.element_at(F.array(*[F.lit(MASKS[k]) for k in KINDS]), x["kind"] + 1)
    masked = replaced(F.make_valid_utf8(F.col(text)), F.col("_spans"), label)
    return rows.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(masked)).select(*[F.col(f"`{c}`") for c in docs.columns])


def named(spans: Column) -> Column:
    return names_of(spans, KINDS)
