"""Report definitions of all three forms as the same tables: page folders, single documents, template archives.

Each form is brought to the same rows for pages and visuals (`_pages`, `_visuals`), whose parts stay
JSON texts; fields, filters and slicers are then read from these, whatever the form. Values of
another kind than expected become null and an issue row, and never fail a job. Projects are told
apart by raw's project column; a project has one form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dealing import dealt
from ..functions.lineage import cut_lineage, once
from .definitions import DEFAULT_HEIGHT, DEFAULT_WIDTH, archive_contents, with_json
from .documents import LAYOUT, document_pieces, is_document, taken_apart, without_pieces
from .fields import field_of, read_condition

# Types of visuals that are slicers.
SLICERS = ("slicer", "listSlicer", "advancedSlicerVisual", "textSlicer")

_BOX = "x DOUBLE, y DOUBLE, z DOUBLE, width DOUBLE, height DOUBLE"
_PAGE = ["project", "file", "folder", "page", "display_name", "width", "height", "ordinal", "filters"]
_VISUAL = ["project", "file", "page_folder", "folder", "visual", "visual_type", "grouped", "box", "title", "roles", "sources", "selects", "objects", "filters", "problem"]


def _object(text: Column) -> Column:
    """The text where it is a JSON object."""
    return F.when(F.ltrim(text).startswith("{"), text)


def _list(text: Column) -> Column:
    """The items of a JSON list as texts; null where it is none."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "ARRAY<STRING>"))


def _documents(raw: DataFrame) -> DataFrame:
    """(project, path, json, error) of single documents, also those out of archives, without their lists of sections: a layout's project is its archive."""
    text = F.col("text")
    return document_pieces(raw).where("piece = 'document'").select("project", "path", text.alias("json"), F.when(text.isNull(), F.lit("not a JSON object")).alias("error"))


def _folder_files(raw: DataFrame, pattern: str) -> DataFrame:
    return with_json(without_pieces(raw).where(F.col("path").rlike(pattern)))


# ------------------------------------------------------------------ pages


def page_order(raw: DataFrame) -> DataFrame:
    """(project, file, names): the listed pages of page folders, names null where that is no list of texts."""
    read = _folder_files(raw, r"/pages/pages\.json$").where("json IS NOT NULL")
    order = F.try_variant_get(F.try_parse_json("json"), "$.pageOrder", "variant")
    names = F.when(F.schema_of_variant(order).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(F.from_json("json", "pageOrder ARRAY<STRING>")["pageOrder"], lambda x: x.isNull()), F.lit(False)), F.from_json("json", "pageOrder ARRAY<STRING>")["pageOrder"])
    missing = F.array().cast("array<string>")
    return once(read.select("project", F.col("path").alias("file"), "json"), {"names": F.when(order.isNull(), missing).otherwise(names)}).drop("json")


def _folder_pages(raw: DataFrame) -> DataFrame:
    """Places count pages that can't be read too."""
    own = _folder_files(raw, r"/pages/[^/]+/page\.json$").withColumn("folder", F.regexp_extract("path", r"/pages/([^/]+)/page\.json$", 1))
    own = once(own, {"p": F.when(F.col("json").isNotNull(), F.from_json("json", "name STRING, displayName STRING, width DOUBLE, height DOUBLE, filterConfig STRING"))})
    listed = page_order(raw).select("project", F.posexplode("names").alias("at", "folder")).groupBy("project", "folder").agg(F.max("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.col("at").asc_nulls_last(), "folder")) - 1
    placed = own.join(listed, ["project", "folder"], "left").withColumn("ordinal", rank).where("json IS NOT NULL")
    filters = F.from_json("p.filterConfig", "filters STRING")["filters"]
    return placed.select("project", F.col("path").alias("file"), "folder", F.coalesce("p.name", "folder").alias("page"), F.coalesce("p.displayName", "folder").alias("display_name"), F.coalesce("p.width", F.lit(DEFAULT_WIDTH)).alias("width"), F.coalesce("p.height", F.lit(DEFAULT_HEIGHT)).alias("height"), "ordinal", filters.alias("filters"))


def _section_lists(raw: DataFrame) -> DataFrame:
    """(project, file, sections) of documents; sections, as texts, is null where that is no list."""
    doc = once(_documents(raw).where("json IS NOT NULL"), {"sections": F.from_json("json", "sections STRING")["sections"]})
    return once(doc.select("project", F.col("path").alias("file"), "sections"), {"sections": _list(F.col("sections"))})


def _unplaced(raw: DataFrame) -> DataFrame:
    """(project, file, n, i, s) of the sections of documents, unnamed ones too; n is how many their document has. Lists of visuals are taken out (see _containers)."""
    own = document_pieces(raw).where("piece = 'section'").select("project", F.col("path").alias("file"), "n", "i", F.col("text").alias("section"))
    # Lists that are written inside a text.
    within = _section_lists(raw).select("project", "file", F.size("sections").alias("n"), F.posexplode("sections").alias("i", "section"))
    return once(own.unionByName(within), {"s": F.from_json("section", "name STRING, displayName STRING, ordinal BIGINT, width DOUBLE, height DOUBLE, visualContainers STRING, filters STRING")}).drop("section")


def _containers(raw: DataFrame) -> DataFrame:
    """(project, file, page_folder, i, container) of the visuals of named sections."""
    own = document_pieces(raw).where("piece = 'container'").select("project", F.col("path").alias("file"), "head", F.col("j").alias("i"), F.col("text").alias("container"))
    own = once(own, {"page_folder": F.from_json("head", "name STRING")["name"]}).where("page_folder IS NOT NULL")
    within = once(_unplaced(raw).where("s.name IS NOT NULL"), {"containers": _list(F.col("s.visualContainers"))})
    within = within.select("project", "file", F.col("s.name").alias("page_folder"), F.posexplode("containers").alias("i", "container"))
    return own.select(*within.columns).unionByName(within)


def _sections(raw: DataFrame) -> DataFrame:
    """_unplaced with ordinal: their order, those without a place of their own last."""
    rows = _unplaced(raw).withColumn("s", F.col("s").dropFields("visualContainers"))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("project", "file").orderBy(F.coalesce("s.ordinal", "n"), "i")) - 1)


def _document_pages(raw: DataFrame) -> DataFrame:
    name = F.col("s.name")
    return _sections(raw).where(name.isNotNull()).select("project", "file", name.alias("folder"), name.alias("page"), F.coalesce("s.displayName", name).alias("display_name"), F.coalesce("s.width", F.lit(DEFAULT_WIDTH)).alias("width"), F.coalesce("s.height", F.lit(DEFAULT_HEIGHT)).alias("height"), "ordinal", F.col("s.filters").alias("filters"))


def _pages(raw: DataFrame) -> DataFrame:
    return _folder_pages(raw).select(*_PAGE).unionByName(_document_pages(raw).select(*_PAGE))


def pages(raw: DataFrame) -> DataFrame:
    """(project, page, display_name, width, height, ordinal) of every form."""
    return _pages(raw).select("project", "page", "display_name", "width", "height", "ordinal")


# ------------------------------------------------------------------ visuals


def _folder_visuals(raw: DataFrame) -> DataFrame:
    rows = _folder_files(raw, r"/visuals/[^/]+/visual\.json$").where("json IS NOT NULL")
    rows = once(rows, {"v": F.from_json("json", "name STRING, position STRING, visualGroup STRING, visual STRING, filterConfig STRING")})
    rows = once(rows, {"b": F.from_json(_object(F.col("v.visual")), "visualType STRING, query STRING, visualContainerObjects STRING, objects STRING"), "_box": F.from_json(_object(F.col("v.position")), _BOX), "_filters": F.from_json("v.filterConfig", "filters STRING")["filters"]})
    rows = once(rows, {"_title": F.get_json_object("b.visualContainerObjects", "$.title[0].properties.text.expr.Literal.Value")})
    folder = F.regexp_extract("path", r"/visuals/([^/]+)/", 1)
    states = F.from_json(_object(F.from_json("b.query", "queryState STRING")["queryState"]), "MAP<STRING,STRING>")
    return rows.select(
        "project",
        F.col("path").alias("file"),
        F.regexp_extract("path", r"/pages/([^/]+)/visuals/", 1).alias("page_folder"),
        folder.alias("folder"),
        F.coalesce("v.name", folder).alias("visual"),
        F.when(_object(F.col("v.visual")).isNotNull(), F.coalesce("b.visualType", F.lit("unknown"))).alias("visual_type"),
        F.col("v.visualGroup").isNotNull().alias("grouped"),
        F.col("_box").alias("box"),
        F.col("_title").alias("title"),
        F.transform_values(states, lambda k, s: F.coalesce(F.from_json(_object(s), "projections STRING")["projections"], F.lit("[]"))).alias("roles"),
        F.lit(None).cast("string").alias("sources"),
        F.lit(None).cast("array<string>").alias("selects"),
        "b.objects",
        F.col("_filters").alias("filters"),
        F.lit(None).cast("string").alias("problem"),
    )


def _document_visuals(raw: DataFrame) -> DataFrame:
    """The configuration of a visual is JSON inside a text; its fields are named in roles and defined by a query, with short names for tables."""
    # The visuals of one large document go to all cores.
    rows = dealt(_containers(raw), "project", "file", "page_folder", "i")
    rows = once(rows, {"c": F.from_json("container", _BOX + ", config STRING, filters STRING")})
    rows = once(rows, {"k": F.from_json(_object(F.col("c.config")), "name STRING, layouts STRING, singleVisual STRING, singleVisualGroup STRING"), "_whole": F.try_parse_json("c.config").isNotNull()})
    rows = once(rows, {"b": F.from_json(_object(F.col("k.singleVisual")), "visualType STRING, projections STRING, prototypeQuery STRING, vcObjects STRING, objects STRING")})
    rows = once(rows, {"q": F.from_json(_object(F.col("b.prototypeQuery")), "From STRING, Select STRING")})
    unnamed = F.format_string("visualContainers[%d]", "i")
    layout = F.from_json(_object(F.from_json(F.get(_list(F.col("k.layouts")), F.lit(0)), "position STRING")["position"]), _BOX)
    title = F.get_json_object("b.vcObjects", "$.title[0].properties.text.expr.Literal.Value")
    rows = once(rows, {"_layout": layout, "_title": title, "_selects": F.coalesce(_list(F.col("q.Select")), F.array().cast("array<string>"))})
    return rows.select(
        "project",
        "file",
        "page_folder",
        F.coalesce("k.name", unnamed).alias("folder"),
        F.col("k.name").alias("visual"),
        F.when(_object(F.col("k.singleVisual")).isNotNull(), F.coalesce("b.visualType", F.lit("unknown"))).alias("visual_type"),
        F.col("k.singleVisualGroup").isNotNull().alias("grouped"),
        F.coalesce("_layout", F.struct(*[F.col(f"c.{x.split()[0]}").alias(x.split()[0]) for x in _BOX.split(", ")])).alias("box"),
        F.col("_title").alias("title"),
        F.from_json(_object(F.col("b.projections")), "MAP<STRING,STRING>").alias("roles"),
        F.coalesce("q.From", F.lit("[]")).alias("sources"),
        F.col("_selects").alias("selects"),
        "b.objects",
        F.col("c.filters").alias("filters"),
        F.when(_object(F.col("c.config")).isNull() | ~F.col("_whole"), "the configuration is not a JSON object").when(F.col("k.name").isNull(), "a visual without a name").alias("problem"),
    )


def _visuals(raw: DataFrame) -> DataFrame:
    """Visuals of every form, on pages by name; those that can't be told have a problem."""
    found = _folder_visuals(raw).select(*_VISUAL).unionByName(_document_visuals(raw).select(*_VISUAL))
    whole = reduce(lambda a, b: a & b, [F.col(f"box.{c}").isNotNull() for c in ("x", "y", "width", "height")])
    found = found.withColumn("problem", F.coalesce("problem", F.when(~F.coalesce(whole, F.lit(False)), F.lit("the position is not complete"))))
    names = _pages(raw).select("project", F.col("folder").alias("page_folder"), "page").distinct()
    return found.join(names, ["project", "page_folder"], "left").withColumn("page", F.coalesce("page", "page_folder"))


def _named(raw: DataFrame) -> DataFrame:
    """Visuals whose name is known; parts of those without a full position can be read all the same."""
    return _visuals(raw).where("visual IS NOT NULL")


def _shown(found: DataFrame, *more: Column) -> DataFrame:
    quoted = F.regexp_extract("title", "(?s)^'(.*)'$", 1)
    title = F.when(F.col("title").rlike("(?s)^'.*'$"), F.replace(quoted, F.lit("''"), F.lit("'"))).otherwise(F.col("title"))
    kind = F.coalesce("visual_type", F.when(F.col("grouped"), F.lit("group")), F.lit("unknown"))
    return found.select("project", "page", "visual", kind.alias("visual_type"), title.alias("title"), "box.x", "box.y", F.coalesce("box.z", F.lit(0.0)).cast("int").alias("z"), "box.width", "box.height", *more)


def visuals(raw: DataFrame) -> DataFrame:
    """(project, page, visual, visual_type, title, x, y, z, width, height) of every form; visuals without a name or a full position are left out (see issues)."""
    return _shown(_visuals(raw).where("problem IS NULL"))


def visuals_with_refs(raw: DataFrame) -> DataFrame:
    """visuals() of single documents with refs, the sorted names by which their roles ask for fields, defined or not."""
    ref = lambda item: F.from_json(_object(item), "queryRef STRING")["queryRef"]
    refs = F.flatten(F.transform(F.map_values("roles"), lambda places: F.transform(F.coalesce(_list(places), F.array()), ref)))
    refs = F.coalesce(F.filter(refs, lambda r: r.isNotNull()), F.array().cast("array<string>"))
    return _shown(_visuals(raw).where("problem IS NULL AND selects IS NOT NULL"), F.array_sort(refs).alias("refs"))


def _items(named: DataFrame) -> DataFrame:
    """One row for each place of a role: (project, file, page, visual, role, idx, field); idx is null where the role holds no list, field.kind where the place holds no field."""
    rows = named.select("project", "file", "page", "visual", "sources", "selects", F.explode("roles").alias("role", "places"))
    rows = once(rows, {"list": _list(F.col("places"))})
    rows = rows.select("*", F.posexplode_outer(F.coalesce("list", F.array(F.lit(None).cast("string")))).alias("idx", "item"))
    bad = F.col("list").isNull()
    defined = F.try_element_at(F.filter("selects", lambda s: F.from_json(s, "Name STRING")["Name"] == F.col("own.queryRef")), F.lit(-1))
    text = F.when(F.col("selects").isNull(), F.col("own.field")).otherwise(defined)
    rows = once(rows, {"own": F.from_json(_object(F.col("item")), "queryRef STRING, field STRING")})
    rows = rows.withColumn("text", F.when(~bad, text)).withColumn("empty", F.coalesce(F.size("list") == 0, F.lit(False)))
    rows = rows.where("NOT empty").withColumn("idx", F.when(~bad, F.col("idx")))
    return rows.select("project", "file", "page", "visual", "role", "idx", field_of(F.col("text"), F.col("sources")).alias("field"))


def fields(raw: DataFrame) -> DataFrame:
    """(project, page, visual, role, idx, field) of every form. A field of an unknown form keeps its kind and a short hash; what is no field is an issue."""
    return _items(_named(raw)).where("field.kind IS NOT NULL").select("project", "page", "visual", "role", "idx", "field")


# ------------------------------------------------------------------ filters and slicers


def _cards(raw: DataFrame, named: DataFrame) -> DataFrame:
    """(project, file, level, page, visual, filters): every owner of filters with their JSON list."""
    none = F.lit(None).cast("string")
    report = _folder_files(raw, r"(^|/)definition/report\.json$").where("json IS NOT NULL").select("project", F.col("path").alias("file"), F.from_json(F.from_json("json", "filterConfig STRING")["filterConfig"], "filters STRING")["filters"].alias("filters"))
    document = _documents(raw).where("json IS NOT NULL").select("project", F.col("path").alias("file"), F.from_json("json", "filters STRING")["filters"].alias("filters"))
    reports = report.unionByName(document).select("project", "file", F.lit("report").alias("level"), none.alias("page"), none.alias("visual"), "filters")
    own = _pages(raw).select("project", "file", F.lit("page").alias("level"), "page", none.alias("visual"), "filters")
    return reports.unionByName(own).unionByName(named.select("project", "file", F.lit("visual").alias("level"), "page", "visual", "filters")).where("filters IS NOT NULL")


def _filters(cards: DataFrame) -> DataFrame:
    rows = once(cards, {"filters": _list(F.col("filters"))}).select("project", "file", "level", "page", "visual", F.posexplode("filters").alias("idx", "entry"))
    rows = once(rows, {"f": F.from_json(_object(F.col("entry")), "name STRING, type STRING, field STRING, expression STRING, filter STRING")}).where("f IS NOT NULL")
    read = read_condition(_object(F.col("f.filter"))).alias("c")
    return rows.select("project", "file", "level", "page", "visual", "idx", F.coalesce("f.name", F.lit("")).alias("name"), F.coalesce("f.type", F.lit("Unknown")).alias("filter_type"), field_of(F.coalesce("f.field", "f.expression")).alias("field"), read)


def filters(raw: DataFrame) -> DataFrame:
    """(project, level, page, visual, idx, name, filter_type, field, condition, parts, tree, fields, unread) of the filter cards of reports, pages and visuals; level tells whose. A card without a condition has neither condition nor unread."""
    return _filters(_cards(raw, _named(raw))).select("project", "level", "page", "visual", "idx", "name", "filter_type", "field", "c.*")


def _slicers(named: DataFrame) -> DataFrame:
    stored = F.transform(_list(F.from_json("objects", "general STRING")["general"]), lambda e: F.get_json_object(e, "$.properties.filter.filter"))
    chosen = F.get(F.filter(stored, lambda x: x.isNotNull()), F.lit(0))
    rows = once(named, {"chosen": chosen}).where(F.col("visual_type").isin(*SLICERS) | F.col("chosen").isNotNull())
    return rows.select("project", "file", "page", "visual", read_condition(_object(F.col("chosen"))).alias("c"))


def slicers(raw: DataFrame) -> DataFrame:
    """(project, page, visual, condition, parts, tree, fields, unread) of slicers: the built-in types, or any visual with a stored selection."""
    return _slicers(_named(raw)).select("project", "page", "visual", "c.*")


# ------------------------------------------------------------------ issues


def issues(raw: DataFrame) -> DataFrame:
    """(project, file, page, visual, message): what could not be read; page and visual where it is of one.

    A file that is no JSON object, a page order that is no list of names, documents without sections,
    sections without names, visuals without a name or position, roles without a list, places
    without a field, filters and selections whose condition is of an unknown form.
    """
    none = F.lit(None).cast("string")
    of = lambda df, message, page=none, visual=none: df.select("project", "file", page.alias("page"), visual.alias("visual"), message.alias("message"))
    page, visual = F.col("page"), F.col("visual")
    files = with_json(without_pieces(raw).where(F.col("path").endswith(".json") & ~is_document(F.col("path")))).select("project", "path", "error").unionByName(_documents(raw).select("project", "path", "error"))
    broken = files.withColumnRenamed("path", "file").where("error IS NOT NULL")
    at = lambda k: F.nullif(F.regexp_extract("file", rf"/{k}/([^/]+)/", 1), F.lit(""))
    documents = _section_lists(raw).where("sections IS NULL")
    found = cut_lineage(_visuals(raw))  # read once for all that is asked of it
    named = found.where("visual IS NOT NULL")
    items, cards = cut_lineage(_items(named).where("idx IS NULL OR field.kind IS NULL")), cut_lineage(_cards(raw, named))
    told = [
        of(broken, F.col("error"), at("pages"), at("visuals")),
        of(page_order(raw).where("names IS NULL"), F.lit("the page order is not a list of names")),
        of(documents, F.lit("a document without a list of sections")),
        of(_unplaced(raw).where("s.name IS NULL"), F.format_string("section %d has no name", "i")),
        of(found.where("problem IS NOT NULL"), F.col("problem"), page, F.coalesce("visual", "folder")),
        of(items.where("idx IS NULL"), F.concat(F.lit("no list of fields in role "), "role"), page, visual),
        of(items.where("idx IS NOT NULL AND field.kind IS NULL"), F.concat(F.lit("no field in role "), "role"), page, visual),
        of(cards.where(_list(F.col("filters")).isNull()), F.lit("the filters are not a list"), page, visual),
        of(_filters(cards).where("c.unread IS NOT NULL"), F.concat(F.lit("an unknown condition in filter "), "name"), page, visual),
        of(_slicers(named).where("c.unread IS NOT NULL"), F.lit("an unknown condition in the selection"), page, visual),
    ]
    return reduce(DataFrame.unionByName, told)


def archive_issues(raw: DataFrame) -> DataFrame:
    """(project, file, page, visual, message) of archives that can't be read, or hold no report. Each archive is opened once, and what it holds stays where it is read."""
    none = F.lit(None).cast("string")
    held = archive_contents(raw).select("project", "file", "error", (F.col("error").isNull() & F.array_contains("entries", LAYOUT)).alias("report"))
    # Archives of one name are told of together.
    of = held.groupBy("project", "file").agg(F.collect_list("error").alias("errors"), F.max("report").alias("report"), F.count("*").cast("int").alias("n"))
    missing = F.when(~F.col("report"), F.array_repeat(F.lit(f"no {LAYOUT} in the archive"), F.col("n")))
    told = F.when(F.size("errors") > 0, F.col("errors")).otherwise(missing)
    return of.select("project", "file", none.alias("page"), none.alias("visual"), F.explode(told).alias("message"))
