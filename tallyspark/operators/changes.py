"""Change reports over catalogs: pages, visuals, fields, filters, slicers and measures of many projects at once.

Every report is a DataFrame of (…, path, category, change, old, new); the project is part of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import field_key
from .pairing import pair_by_key


def finding(category: str, change, path: Column, old=None, new=None) -> list[Column]:
    text = lambda x: (F.lit(None) if x is None else x).cast("string")
    return [path.alias("path"), F.lit(category).alias("category"), (F.lit(change) if isinstance(change, str) else change).alias("change"), text(old).alias("old"), text(new).alias("new")]


# ------------------------------------------------------------------ pages and visuals


def one_sided(left: DataFrame, category: str, change: str, path: Column, by: list[str] = ()) -> DataFrame:
    """What has no partner on the other side, as added or removed."""
    return left.select(*by, *finding(category, change, path))


def with_visual_counts(pages: DataFrame, visuals: DataFrame, key: list[str]) -> DataFrame:
    """Pages with how many visuals they hold; those of a one-sided page are covered by its finding."""
    return pages.join(visuals.groupBy(*key).agg(F.count("*").alias("visuals")), key, "left").fillna(0, ["visuals"])


def page_changes(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Renamed pages and pages with a new id. pairs: old_page, new_page, old_name, new_name."""
    kinds = F.array(
        F.when(~F.col("old_name").eqNullSafe(F.col("new_name")), F.struct(F.lit("renamed").alias("change"), F.col("old_name").alias("old"), F.col("new_name").alias("new"))),
        F.when(F.col("old_page") != F.col("new_page"), F.struct(F.lit("new_id").alias("change"), F.col("old_page").alias("old"), F.col("new_page").alias("new"))),
    )
    return pairs.select(*by, F.col("new_page").alias("path"), F.lit("page").alias("category"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select(*by, "path", "category", "k.change", "k.old", "k.new")


def reordered(pairs: DataFrame, by: list[str], old_order: str, new_order: str, path: str) -> DataFrame:
    """Pages whose rank among the paired pages of their report changed; ranks count from 1."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(c), F.col(path)))
    ranked = pairs.withColumns({"_old": rank(old_order), "_new": rank(new_order)}).where("_old <> _new")
    return ranked.select(*by, *finding("page", "reordered", F.col(path), F.col("_old"), F.col("_new")))


def visual_changes(pairs: DataFrame, by: list[str], path: Column) -> DataFrame:
    """Up to four findings of a pair: new id, retyped, retitled, moved or resized. Each of old_/new_: id, type, title, x, y, width, height; the depth is no part of the place."""
    place = lambda s: F.struct(*[F.col(f"{s}_{c}") for c in ("x", "y", "width", "height")])
    shown = lambda s: F.concat_ws(",", *[F.col(f"{s}_{c}").cast("string") for c in ("x", "y", "width", "height")])
    one = lambda changed, name, old, new: F.when(changed, F.struct(F.lit(name).alias("change"), old.cast("string").alias("old"), new.cast("string").alias("new")))
    differ = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kinds = F.array(
        one(differ("id"), "new_id", F.col("old_id"), F.col("new_id")),
        one(differ("type"), "retyped", F.col("old_type"), F.col("new_type")),
        one(differ("title"), "retitled", F.col("old_title"), F.col("new_title")),
        one(~place("old").eqNullSafe(place("new")), "moved", shown("old"), shown("new")),
    )
    return pairs.select(*by, path.alias("path"), F.lit("visual").alias("category"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select(*by, "path", "category", "k.change", "k.old", "k.new")


def without_broken(findings: DataFrame, broken_old: DataFrame, broken_new: DataFrame) -> DataFrame:
    """Drops `added` where the old side could not be read, and `removed` where the new one could not. broken_*: path."""
    gone = broken_old.select("path", F.lit("added").alias("change")).unionByName(broken_new.select("path", F.lit("removed").alias("change"))).distinct()
    return findings.join(gone, ["path", "change"], "left_anti")


def renamed_paths(issues: DataFrame, names: DataFrame, side: str = "page") -> DataFrame:
    """Issues with the folder replaced by the object's name where that is known. names: folder, name."""
    return issues.join(names.select(F.col("folder").alias(side), F.col("name").alias("_name")).dropDuplicates([side]), side, "left").withColumn(side, F.coalesce("_name", side)).drop("_name")


def on_old_pages(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """New-version issues(visual_path, ..) with the page of a matched pair named as the old version names it. pages: old_page, new_page; a new page has one old one."""
    page = F.substring_index("visual_path", "/", 1)
    found = issues.join(pages.select(F.col("new_page").alias("_new"), F.col("old_page").alias("_old")), page == F.col("_new"), "left")
    moved = F.concat(F.col("_old"), F.substring(F.col("visual_path"), F.length("_new") + 1, F.length("visual_path")))
    return found.withColumn("visual_path", F.coalesce(moved, "visual_path")).select(*issues.columns)


# ------------------------------------------------------------------ fields and filters


def roles_by_field(projections: DataFrame, by: list[str], key: str, role: str) -> DataFrame:
    """The distinct roles of a field in a visual, sorted, as one text."""
    return projections.groupBy(*by, key).agg(F.array_join(F.array_sort(F.collect_set(role)), ", ").alias("roles"))


def field_changes(old: DataFrame, new: DataFrame, by: list[str], key: str) -> DataFrame:
    """Fields added, removed or moved to other roles. Each side: by, key, roles; one row a field."""
    both = old.select(*by, key, F.col("roles").alias("_old"), F.lit(None).cast("string").alias("_new")).unionByName(new.select(*by, key, F.lit(None).cast("string").alias("_old"), F.col("roles").alias("_new")))
    both = both.groupBy(*by, key).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "moved")
    return both.withColumn("_c", change).where("_c IS NOT NULL").select(*by, *finding("field", F.col("_c"), F.col(key), F.col("_old"), F.col("_new")))


def labelled(filters: DataFrame, owner: list[str], name: str, idx: str) -> DataFrame:
    """Filters with a label in their owner: the name, name#2 for repeats, #1 for unnamed ones."""
    n = F.row_number().over(Window.partitionBy(*owner, name).orderBy(idx))
    label = F.when(F.col(name).isNull(), F.concat(F.lit("#"), n)).when(n > 1, F.concat(F.col(name), F.lit("#"), n)).otherwise(F.col(name))
    return filters.withColumn("label", label)


def filter_changes(old: DataFrame, new: DataFrame, owner: list[str], category: str = "filter") -> DataFrame:
    """Per owner and label: added, removed, else the first of modified (definition), refielded (field), retyped (filter_type)."""
    cols = ("definition", "field", "filter_type")
    tag = lambda df, s: df.select(*owner, "label", F.struct(*cols).alias(s), F.lit(1).alias(f"n_{s}"))
    both = tag(old, "_old").unionByName(tag(new, "_new"), allowMissingColumns=True).groupBy(*owner, "label").agg(F.any_value("_old", F.lit(True)).alias("_old"), F.any_value("_new", F.lit(True)).alias("_new"), F.sum("n__old").alias("n_old"), F.sum("n__new").alias("n_new"))
    differ = lambda c: ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    change = F.when(F.col("n_old").isNull(), "added").when(F.col("n_new").isNull(), "removed").when(differ("definition"), "modified").when(differ("field"), "refielded").when(differ("filter_type"), "retyped")
    shown = lambda s: F.when(F.col("_c") == "refielded", F.col(f"{s}.field")).when(F.col("_c") == "retyped", F.col(f"{s}.filter_type")).otherwise(F.col(f"{s}.definition"))
    return both.withColumn("_c", change).where("_c IS NOT NULL").select(*owner, *finding(category, F.col("_c"), F.col("label"), shown("_old"), shown("_new")))


def slicer_changes(pairs: DataFrame, by: list[str], path: Column) -> DataFrame:
    """Selections that differ; where either side has none, a slicer that came or went says nothing. pairs: old_selection, new_selection, old_slicer, new_slicer."""
    kept = pairs.where(~F.col("old_selection").eqNullSafe(F.col("new_selection")) & ((F.col("old_slicer") & F.col("new_slicer")) | F.coalesce("old_selection", "new_selection").isNotNull()))
    change = F.when(F.col("old_selection").isNull(), "added").when(F.col("new_selection").isNull(), "removed").otherwise("modified")
    return kept.select(*by, *finding("slicer", change, path, F.col("old_selection"), F.col("new_selection")))


def first_locations(fields: DataFrame, by: list[str], location: str, idx: str) -> DataFrame:
    return fields.groupBy(*by).agg(F.min_by(location, idx).alias("location"))


# ------------------------------------------------------------------ measures


def measure_changes(old: DataFrame, new: DataFrame, unparsed: DataFrame | None = None, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(findings, renames) of measures(by.., table, name, expression).

    Same table and name with another expression: modified. Removed and added with an equal
    expression that is unique on both sides: renamed within a table, then moved between tables
    under one name. What is left is removed or added, except what could not be parsed on
    either side (unparsed: by.., table, name). Long expressions meet by their hash.
    """
    by = list(by)
    hashed = lambda df: df.withColumn("_x", F.sha2(F.col("expression"), 256))
    old, new = hashed(old), hashed(new)
    both = old.alias("o").join(new.alias("n"), [*by, "table", "name"]).where(F.col("o._x") != F.col("n._x"))
    path = lambda t, n: field_key(F.col(t), F.col(n))
    modified = both.select(*by, *finding("measure", "modified", path("table", "name"), F.col("o.expression"), F.col("n.expression")))
    removed, added = old.join(new, [*by, "table", "name"], "left_anti"), new.join(old, [*by, "table", "name"], "left_anti")
    if unparsed is not None:
        removed, added = (x.join(unparsed.select(*by, "table", "name").distinct(), [*by, "table", "name"], "left_anti") for x in (removed, added))
    renames, removed, added = pair_by_key(removed, added, [*by, "table", "_x"], ["name"])
    moves, removed, added = pair_by_key(removed, added, [*by, "name", "_x"], ["table"])
    found = modified.unionByName(renames.select(*by, *finding("measure", "renamed", path("table", "new_name"), F.col("old_name"), F.col("new_name"))))
    found = found.unionByName(moves.select(*by, *finding("measure", "moved", path("new_table", "name"), path("old_table", "name"), path("new_table", "name"))))
    found = found.unionByName(removed.select(*by, *finding("measure", "removed", path("table", "name"), F.col("expression"))))
    found = found.unionByName(added.select(*by, *finding("measure", "added", path("table", "name"), None, F.col("expression"))))
    to = renames.select(*by, F.col("table").alias("old_table"), "old_name", F.col("table").alias("new_table"), "new_name")
    to = to.unionByName(moves.select(*by, "old_table", F.col("name").alias("old_name"), "new_table", F.col("name").alias("new_name")))
    return found, to


def renamed_fields(fields: DataFrame, renames: DataFrame, by: list[str] = ()) -> DataFrame:
    """fields(by.., table, name) looked up once in renames; only the old side is rewritten, so that a new visual still on the old name is reported."""
    r = renames.select(*by, F.col("old_table").alias("table"), F.col("old_name").alias("name"), "new_table", "new_name")
    return fields.join(r, [*by, "table", "name"], "left").withColumns({"table": F.coalesce("new_table", "table"), "name": F.coalesce("new_name", "name")}).drop("new_table", "new_name")


def issue_findings(issues: DataFrame, by: list[str] = ()) -> DataFrame:
    """Parse issues of either side, each once."""
    return issues.select(*by, *finding("parse_issue", "error", F.col("path"), None, F.col("message"))).distinct()


# ------------------------------------------------------------------ what of two reports can be compared


def comparable_visuals(pairs: DataFrame, issues: DataFrame, lost: DataFrame, by: list[str] = ()) -> DataFrame:
    """pairs(by.., page, visual, old_slicer, new_slicer, old_fields, new_fields) with (compare, reason).

    Pairs of slicers and pairs without fields have no data and are left out. A pair is not
    compared where one side is a slicer, where either side has an issue of its own (issues:
    by.., page, visual), or where its page lost a visual that could not be read (lost: by..,
    page), whose selection might have counted; the first reason holds.
    """
    by = list(by)
    kept = pairs.where(~(F.col("old_slicer") & F.col("new_slicer")) & ~((F.col("old_fields") == 0) & (F.col("new_fields") == 0)))
    kept = kept.join(issues.select(*by, "page", "visual", F.lit(True).alias("_issue")).distinct(), [*by, "page", "visual"], "left").join(lost.select(*by, "page", F.lit(True).alias("_lost")).distinct(), [*by, "page"], "left")
    reason = F.when(F.col("old_slicer") != F.col("new_slicer"), F.lit("a slicer on one side only")).when(F.col("_issue"), F.lit("the visual could not be read completely")).when(F.col("_lost"), F.lit("a visual of its page could not be read"))
    return kept.withColumns({"reason": reason, "compare": reason.isNull()}).drop("_issue", "_lost")


def missing_models(models: DataFrame, by: list[str]) -> DataFrame:
    """A warning for each report of which only one side has a model: its measures are not compared. models: by.., side (old or new)."""
    sides = models.groupBy(*by).agg(F.bool_or(F.col("side") == "old").alias("_o"), F.bool_or(F.col("side") == "new").alias("_n")).where("_o <> _n")
    side = F.when(F.col("_o"), F.lit("new")).otherwise(F.lit("old"))
    return sides.select(*by, *finding("parse_issue", "error", F.lit("model"), None, F.concat(F.lit("measures not compared: no model on the "), side, F.lit(" side"))))


def paired_columns(old: DataFrame, new: DataFrame, renames: DataFrame, by: list[str]) -> DataFrame:
    """(by.., old_name, new_name, state) of the value columns(by.., name) of many results: both, only_old or only_new. Old names are looked up once in renames(old_name, new_name); the last rename of a name counts."""
    to = renames.groupBy("old_name").agg(F.max_by("new_name", "position").alias("_to"))
    looked = old.join(to, old["name"] == to["old_name"], "left").select(*[old[b] for b in by], F.coalesce("_to", "name").alias("_name"), old["name"].alias("_old"), F.lit(None).cast("string").alias("_new"))
    both = looked.unionByName(new.select(*by, F.col("name").alias("_name"), F.lit(None).cast("string").alias("_old"), F.col("name").alias("_new"))).groupBy(*by, "_name").agg(F.max("_old").alias("old_name"), F.max("_new").alias("new_name"))
    state = F.when(F.col("old_name").isNull(), "only_new").when(F.col("new_name").isNull(), "only_old").otherwise("both")
    return both.select(*by, "old_name", "new_name", state.alias("state"))
