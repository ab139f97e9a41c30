"""What changed in the definitions? Pairing, change reports, findings and snapshots, on catalogs derived from the given tables."""

from __future__ import annotations

import io
import itertools
import json
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import values as X
from ..functions.dealing import dealt
from ..functions.lineage import cut_lineage
from ..operators import changes as G
from ..operators import findings as N
from ..operators import pairing as P
from ..operators import snapshot as S
from ..operators import contexts as C
from ..sources import definitions as D
from ..sources import reports as R
from .data_queries import table

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


# ------------------------------------------------------------------ pairing


def _page_sides(spark, d):
    """Pages as two catalogs: name is the url's path, display name the title; a third of the names changed."""
    pages = table(spark, d, "pages").select("page_id", F.expr("regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)").alias("name"), F.expr(TITLE).alias("display"))
    new = pages.where("page_id % 5 <> 4").withColumn("name", F.expr("CASE WHEN page_id % 3 = 0 THEN name || '~' ELSE name END"))
    return pages.where("page_id % 7 <> 6"), new


def pages_paired(spark, d):
    old, new = _page_sides(spark, d)
    return P.pair_in_turn(old, new, [("id", ["name"]), ("display_name", ["display"])], ["page_id"])[0]


def pages_left_over(spark, d):
    old, new = _page_sides(spark, d)
    _, a, b = P.pair_in_turn(old, new, [("id", ["name"]), ("display_name", ["display"])], ["page_id"])
    return a.select("page_id", F.lit("old").alias("side")).unionByName(b.select("page_id", F.lit("new").alias("side")))


def pages_unique_titles(spark, d):
    return P.unique_by(table(spark, d, "pages").select("page_id", F.expr(TITLE).alias("title")), ["title"]).select("page_id")


def _part_visuals(spark, d):
    """Parts as visuals of their brand's page: old those with even keys."""
    fields = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set((F.col("l_suppkey") % 20).cast("string")).alias("fields"))
    parts = table(spark, d, "part").join(fields, F.col("p_partkey") == F.col("l_partkey"), "left")
    rows = parts.select("p_brand", "p_partkey", F.col("p_type").alias("type"), F.expr("nullif(p_name, 'red widget')").alias("title"), F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 100).cast("double").alias("y"), F.lit(10.0).alias("width"), F.lit(20.0).alias("height"), F.lit(100.0).alias("page_width"), F.lit(200.0).alias("page_height"))
    return rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 1")


def part_candidates(spark, d):
    """Pairs of every page that reach a score, by classes of equal visuals, and whose class each visual is of."""
    return P.class_candidates(*_part_visuals(spark, d), ["p_brand"], "p_partkey", 0.8)


def part_pairs(spark, d):
    """Greedy one-to-one pairs of every page."""
    return P.greedy_pairs(*_part_visuals(spark, d), ["p_brand"], "p_partkey", 0.6)


# ------------------------------------------------------------------ change reports


def _documents_as_measures(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


def measures_renamed(spark, d):
    old, new = _documents_as_measures(spark, d)
    as_measures = lambda x: x.select(F.col("lang").alias("table"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("expression"))
    return G.measure_changes(as_measures(old), as_measures(new))[1]


def measures_changed(spark, d):
    """Every document by its whole text. Both sides keep most measures; some expressions, names and tables change, some come or go."""
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 13 <> 0").select(F.col("source").alias("table"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("expression"))
    new = docs.where("doc_id % 17 <> 0").select(F.expr("CASE WHEN doc_id % 5 = 0 THEN lang ELSE source END").alias("table"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'new ' || doc_id ELSE CAST(doc_id AS STRING) END").alias("name"), F.expr("CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END").alias("expression"))
    unparsed = docs.where("doc_id % 19 = 0").select(F.col("source").alias("table"), F.col("doc_id").cast("string").alias("name"))
    found = G.measure_changes(old, new, unparsed)[0]
    return found.select("path", "change", F.md5(F.coalesce("old", F.lit(""))).alias("old"), F.md5(F.coalesce("new", F.lit(""))).alias("new"))


def _roles(spark, d, odd):
    lines = table(spark, d, "lineitem").where(f"l_orderkey % 2 = {odd}")
    rows = lines.select((F.col("l_partkey") % 500).alias("visual"), (F.col("l_suppkey") % 10).cast("string").alias("field"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'Values' WHEN 1 THEN 'Category' ELSE 'Series' END").alias("role"))
    return G.roles_by_field(rows, ["visual"], "field", "role")


def fields_changed(spark, d):
    return G.field_changes(_roles(spark, d, 0), _roles(spark, d, 1), ["visual"], "field")


def _turns(spark, d, side):
    turns = table(spark, d, "conversations").withColumn("name", F.expr("CASE WHEN turn % 5 = 4 THEN NULL ELSE role END"))
    if side:
        turns = turns.where("(conv_id + turn) % 6 <> 5").withColumn("text", F.expr("CASE WHEN conv_id % 4 = 1 THEN text || '!' ELSE text END"))
    rows = G.labelled(turns, ["conv_id"], "name", "turn")
    kind = "CASE WHEN conv_id % 9 = 2 THEN 'Advanced' ELSE 'Categorical' END" if side else "'Categorical'"
    return rows.select("conv_id", "label", F.md5(F.expr("CASE WHEN conv_id % 4 = 1 THEN text ELSE '' END")).alias("definition"), F.expr(f"CASE WHEN conv_id % 5 = 3 AND {side} = 1 THEN 'other' ELSE role END").alias("field"), F.expr(kind).alias("filter_type"))


def filters_changed(spark, d):
    return G.filter_changes(_turns(spark, d, 0), _turns(spark, d, 1), ["conv_id"])


def slicers_changed(spark, d):
    events = table(spark, d, "events")
    sel = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 3 AS STRING) END"
    pairs = events.select("event_id", F.expr(sel).alias("old_selection"), F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 2 AS STRING) END").alias("new_selection"), F.expr("event_id % 7 <> 0").alias("old_slicer"), F.expr("event_id % 11 <> 0").alias("new_slicer"))
    return G.slicer_changes(pairs, ["event_id"], F.concat(F.lit("p/"), F.col("event_id").cast("string")))


def _page_pairs(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.expr("regexp_extract(url, '^[a-z]+://([^/]+)/', 1)").alias("host"), F.expr(TITLE).alias("title"))
    return pages.select((F.col("page_id") % 12).alias("report"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("old_page"), F.expr("'p' || CASE WHEN page_id % 6 = 0 THEN page_id + 100000 ELSE page_id END").alias("new_page"), F.col("title").alias("old_name"), F.expr("CASE WHEN page_id % 4 = 0 THEN title || '!' ELSE title END").alias("new_name"), F.col("page_id").alias("old_ordinal"), F.expr("CASE WHEN page_id % 24 < 12 THEN page_id + 24 ELSE page_id END").alias("new_ordinal"))


def pages_changed(spark, d):
    return G.page_changes(_page_pairs(spark, d), ["report"])


def pages_reordered(spark, d):
    return G.reordered(_page_pairs(spark, d), ["report"], "old_ordinal", "new_ordinal", "new_page")


def visuals_changed(spark, d):
    parts = table(spark, d, "part")
    side = lambda s, x: [F.expr(e).alias(f"{s}_{c}") for c, e in {"id": f"'v' || (p_partkey {x[0]})", "type": x[1], "title": x[2], "x": f"CAST(p_size {x[3]} AS INT)", "y": "CAST(p_partkey % 100 AS INT)", "width": "10", "height": "20"}.items()]
    pairs = parts.select("p_brand", "p_partkey", *side("old", ("", "p_type", "nullif(p_name, 'red widget')", "")), *side("new", ("+ p_partkey % 2", "CASE WHEN p_partkey % 3 = 0 THEN 'STANDARD' ELSE p_type END", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END", "+ p_size % 2")))
    return G.visual_changes(pairs, ["p_partkey"], F.concat_ws("/", "p_brand", "new_id"))


def one_sided_pages(spark, d):
    """Pages of one side, with how many visuals they hold; unless the other side could not be read there."""
    old, new = _page_sides(spark, d)
    visuals = table(spark, d, "lineitem").select((F.col("l_orderkey") % 300).alias("page_id"))
    _, gone, come = P.pair_by_key(old, new, ["name"], ["page_id"])
    path = F.concat_ws("#", "name", F.col("page_id").cast("string"))
    counted = lambda x: G.with_visual_counts(x, visuals, ["page_id"])
    found = N.union([G.one_sided(counted(gone), "page", "removed", path, ["visuals"]), G.one_sided(counted(come), "page", "added", path, ["visuals"])])
    broken = lambda x, m: x.where(f"page_id % 8 = {m}").select(path.alias("path"))
    return G.without_broken(found, broken(new, 1), broken(old, 2)).select("path", "category", "change", "visuals")


def first_locations(spark, d):
    return G.first_locations(table(spark, d, "lineitem").withColumn("idx", F.struct("l_linenumber", "l_orderkey", "l_suppkey")), ["l_partkey"], "l_orderkey", "idx")


def fields_renamed(spark, d):
    fields = table(spark, d, "part").select(F.col("p_brand").alias("table"), F.col("p_type").alias("name"), "p_partkey")
    renames = table(spark, d, "part").where("p_size > 25").select(F.col("p_brand").alias("old_table"), F.col("p_type").alias("old_name")).distinct().withColumns({"new_table": F.col("old_table"), "new_name": F.concat(F.lit("new "), F.col("old_name"))})
    return G.renamed_fields(fields, renames).select("p_partkey", X.field_key(F.col("table"), F.col("name"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'Sum' END")).alias("key"))


def issues_by_name(spark, d):
    """Parse issues as findings, with folders replaced by names."""
    issues = table(spark, d, "events").where("event_type = 'error'").select((F.col("user_id") % 40).cast("string").alias("page"), F.lit("broken").alias("message"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("folder"), F.col("n_name").alias("name"))
    return G.issue_findings(G.renamed_paths(issues, names).withColumn("path", F.col("page")))


def visuals_comparable(spark, d):
    parts = table(spark, d, "part")
    pairs = parts.select("p_partkey", F.col("p_brand").alias("page"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("visual"), (F.col("p_size") % 5 == 0).alias("old_slicer"), (F.col("p_size") % 10 == 0).alias("new_slicer"), (F.col("p_size") % 4).alias("old_fields"), (F.col("p_size") % 8).alias("new_fields"))
    issues = pairs.where("p_partkey % 17 = 3").select("page", "visual")
    lost = table(spark, d, "supplier").where("s_suppkey % 6 = 1").select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string")).alias("page"))
    return G.comparable_visuals(pairs, issues, lost).select("visual", "compare", "reason")


def models_missing(spark, d):
    models = table(spark, d, "orders").where("o_orderkey % 3 <> 1").select((F.col("o_custkey") % 400).alias("report"), F.expr("CASE WHEN o_orderkey % 5 < 3 THEN 'old' ELSE 'new' END").alias("side"))
    return G.missing_models(models.where("report % 3 = 0 OR side = 'old'"), ["report"]).select("report", "path", "change", "new")


def columns_paired(spark, d):
    lines = table(spark, d, "lineitem")
    side = lambda odd: lines.where(f"l_orderkey % 2 = {odd}").select((F.col("l_partkey") % 300).alias("result"), F.concat(F.lit("c"), (F.col("l_suppkey") % 12).cast("string")).alias("name")).distinct()
    renames = table(spark, d, "nation").select(F.concat(F.lit("c"), (F.col("n_nationkey") % 4).cast("string")).alias("old_name"), F.concat(F.lit("c"), (F.col("n_nationkey") % 4 + 12).cast("string")).alias("new_name"), F.col("n_nationkey").alias("position"))
    new = side(1).withColumn("name", F.expr("CASE WHEN name IN ('c1', 'c2') THEN 'c' || CAST(CAST(substring(name, 2) AS INT) + 12 AS STRING) ELSE name END"))
    return G.paired_columns(side(0), new.distinct(), renames, ["result"])


# ------------------------------------------------------------------ findings

_CATEGORY = "CASE event_id % 8 WHEN 0 THEN 'page' WHEN 1 THEN 'visual' WHEN 2 THEN 'field' WHEN 3 THEN 'filter' WHEN 4 THEN 'slicer' WHEN 5 THEN 'measure' WHEN 6 THEN 'data' ELSE 'ai' END"
_CHANGE = "CASE event_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'modified' WHEN 3 THEN 'retyped' ELSE 'error' END"
_PATH = "'p' || (user_id % 7) || '/v' || (user_id % 21) || CASE WHEN event_id % 3 = 0 THEN '/f' || (event_id % 4) ELSE '' END"
_SEVERITY = """CASE WHEN category IN ('page', 'visual') AND change = 'removed' THEN 'critical' WHEN category = 'visual' AND change = 'retyped' THEN 'warning' WHEN category = 'filter' AND change = 'retyped' THEN 'info'
WHEN category = 'measure' AND change = 'added' THEN 'info' WHEN category = 'measure' AND change = 'modified' THEN 'critical' WHEN category = 'data' AND change = 'error' THEN 'warning'
WHEN category IN ('page', 'visual', 'ai') THEN 'info' WHEN category IN ('field', 'measure', 'parse_issue') THEN 'warning' ELSE 'critical' END"""


def findings(spark, d):
    rows = table(spark, d, "events").select(F.expr("user_id div 5").alias("run"), F.expr(_PATH).alias("path"), F.expr(_CATEGORY).alias("category"), F.expr(_CHANGE).alias("change"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"), F.lit(None).cast("string").alias("old"), F.floor(F.col("value") * 100).cast("string").alias("new"), F.expr("CASE WHEN event_id % 16 = 7 THEN 'p1/v1' END").alias("visual_path"))
    return N.completed(rows)


def findings_numbered(spark, d):
    return N.numbered(findings(spark, d), ["run"]).select("run", "key", "severity", "message")


def findings_by_severity(spark, d):
    return N.severity_counts(findings(spark, d), ["run"])


def findings_by_category(spark, d):
    return N.category_counts(N.at_least(findings(spark, d), "warning"), ["run"])


def findings_gate(spark, d):
    return N.gate(findings(spark, d).where("category NOT IN ('data', 'filter', 'slicer', 'page', 'visual') OR run % 3 = 0"), ["run"])


def findings_most_severe(spark, d):
    return N.most_severe(findings(spark, d), 50, "warning").select("run", "path", "category", "change", "severity", "message")


def findings_open_data(spark, d):
    return N.not_fully_validated(findings(spark, d)).groupBy("run").agg(F.count("*").alias("n"))


def item_statuses(spark, d):
    side = F.expr("CASE WHEN user_id % 5 = 0 THEN 'new' WHEN user_id % 5 = 1 THEN 'old' ELSE 'both' END")
    visuals = table(spark, d, "events").select(F.expr("user_id div 5").alias("run"), F.expr("'p' || (user_id % 7) || '/v' || (user_id % 21)").alias("path"), side.alias("side")).distinct()
    return N.item_status(visuals, findings(spark, d).where("run % 4 <> 1 AND change IN ('added', 'retyped')"), ["run"])


def findings_by_visual(spark, d):
    visuals = table(spark, d, "events").where("user_id % 2 = 0").select(F.expr("user_id div 5").alias("run"), F.expr("'p' || (user_id % 7) || '/v' || (user_id % 21)").alias("visual"))
    found = N.by_visual(N.numbered(findings(spark, d), ["run"]), visuals, ["run"])
    return found.select("run", "visual", "part", "n", F.md5(F.array_join("keys", ",")).alias("keys_md5"))


def findings_masked(spark, d):
    return N.masked_findings(findings(spark, d))


def pairable_categories(spark, d):
    return N.pairable_categories(findings(spark, d))


def _proposals(spark, d):
    parts = table(spark, d, "part")
    return parts.select((F.col("p_partkey") % 9).alias("run"), F.col("p_partkey").alias("position"), F.lit("measure").alias("category"), F.concat(F.lit("o"), (F.col("p_size") % 20).cast("string")).alias("old"), F.concat(F.lit("n"), (F.col("p_partkey") % 23).cast("string")).alias("new"), (F.col("p_retailprice") / 900 - 0.5).alias("confidence"))


def renames_vetted(spark, d):
    """Each end of a proposal is used once, in the order of proposals."""
    p = _proposals(spark, d)
    removed = p.where("old <> 'o3'").select("run", "category", F.col("old").alias("path")).distinct()
    added = p.where("new <> 'n5'").select("run", "category", F.col("new").alias("path")).distinct()
    return N.vetted(p, removed, added, ["run"]).select("run", "position", "old", "new")


def findings_explained(spark, d):
    texts = table(spark, d, "conversations").select((F.col("conv_id") % 50).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"), F.expr("CASE WHEN turn = 0 THEN '  ' ELSE text END").alias("text"))
    return N.with_explanations(findings(spark, d).withColumn("id", F.col("run") * 10), texts, 600).select("run", "message", F.md5("explanation").alias("explanation_md5"))


def findings_markdown(spark, d):
    return N.markdown(findings(spark, d), ["run"], 2000).select("run", F.md5("text").alias("text_md5"), "shown", "more")


def findings_documents(spark, d):
    """JSON documents of each run, 10 000 findings to a part."""
    docs = N.documents(findings(spark, d).select("run", "path", "category", "change", "message"), ["run"])
    return docs.select("run", "part", F.md5("document").alias("document_md5"))


def projects_result(spark, d):
    """One result over all projects: a project for each user of the events, its findings by severity, and the totals."""
    events = table(spark, d, "events")
    project = F.expr("'team' || (user_id % 7) || '/r' || user_id || '.Report'")
    status = F.expr("CASE user_id % 8 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'error' ELSE 'changed' END")
    runs = events.select(project.alias("path"), status.alias("status")).distinct()
    found = N.completed(events.select(project.alias("project"), F.expr(_PATH).alias("path"), F.expr(_CATEGORY).alias("category"), F.expr(_CHANGE).alias("change")))
    return N.over_projects(runs, found)


def view_pages(spark, d):
    """Pages of both versions as a view shows them, 20 pages to a report."""
    pages = table(spark, d, "pages").select(F.expr("page_id div 20").alias("report"), F.expr("'p' || page_id").alias("name"), F.expr("page_id * 7 % 5").alias("ordinal"), F.expr("CASE page_id % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'unchanged' END").alias("status"))
    return N.in_view_order(pages, ["report"], "ordinal")


def view_visuals(spark, d):
    """Visuals by name, 12 to a page."""
    visuals = table(spark, d, "part").select(F.expr("p_partkey div 12").alias("page"), F.expr("'v' || p_partkey").alias("name"), F.expr("CASE WHEN p_size % 4 = 0 THEN 'modified' ELSE 'unchanged' END").alias("status"))
    return N.in_view_order(visuals, ["page"])


# ------------------------------------------------------------------ snapshots


def _listings(spark, d):
    pages = table(spark, d, "pages")
    path = F.expr("'team' || (page_id % 4) || '/r' || (page_id % 60) || CASE page_id % 3 WHEN 0 THEN '.Report/' WHEN 1 THEN '.SemanticModel/' ELSE '.other/' END || 'f' || page_id || CASE WHEN page_id % 50 = 7 THEN '.pbit' ELSE '.json' END")
    files = pages.select("page_id", path.alias("path"), F.sha2("html", 256).alias("sha"))
    new = files.where("page_id % 9 <> 0").withColumn("sha", F.expr("CASE WHEN page_id % 10 = 3 THEN reverse(sha) ELSE sha END"))
    return files.where("page_id % 12 <> 5").select("path", "sha"), new.select("path", "sha")


def files_changed(spark, d):
    return S.changed_files(*_listings(spark, d))


def units_changed(spark, d):
    return S.units(S.changed_files(*_listings(spark, d)), "team1")


def _changed_models(spark, d):
    changed = S.units(S.changed_files(*_listings(spark, d)))
    return changed, changed.where("unit LIKE '%.SemanticModel'").select(F.col("unit").alias("model"))


def _reports(spark, d):
    new = _listings(spark, d)[1]
    reports = S.units(new).where("unit LIKE '%.Report'")
    number = F.regexp_extract("unit", "/r([0-9]+)", 1).cast("int")
    return reports.select(F.col("unit").alias("report"), F.when(number % 15 != 0, F.concat(F.regexp_extract("unit", "^(team[0-9])", 1), F.lit("/r"), (number + 1).cast("string"), F.lit(".SemanticModel"))).alias("model"))


def model_readers(spark, d):
    return S.readers(_reports(spark, d), _changed_models(spark, d)[1])


def project_runs(spark, d):
    changed, models = _changed_models(spark, d)
    old, new = _listings(spark, d)
    return S.project_runs(changed, models, model_readers(spark, d), S.units(old), S.units(new))


# ------------------------------------------------------------------ literals and paths


def literals(spark, d):
    lines = table(spark, d, "lineitem")
    raw = F.expr("CASE l_linenumber WHEN 1 THEN l_orderkey || 'L' WHEN 2 THEN CAST(l_partkey AS STRING) || '.50D' WHEN 3 THEN '''' || l_returnflag || '''''s''' WHEN 4 THEN 'true' WHEN 5 THEN 'datetime''' || date_format(l_shipdate, 'yyyy-MM-dd') || '''' WHEN 6 THEN 'null' ELSE 'Field' || l_suppkey END")
    return X.with_literals(lines.select(raw.alias("raw")).distinct())


def json_properties(spark, d):
    """A number inside a JSON text, and paths with their first two segments."""
    events = table(spark, d, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return events.select("event_id", k.alias("k"), X.visual_of_path(F.expr("'a/' || event_type || '/x/' || user_id")).alias("visual"), X.visual_path(F.col("event_type"), F.col("user_id").cast("string")).alias("path"))


# ------------------------------------------------------------------ definition files


_VISUAL_JSON = """{"name": "v%d", "position": {"x": %d, "y": %d, "width": 100%s},
"visual": {"visualType": "card", "query": {"queryState": {"Values": {"projections": [
 {"field": {"Column": {"Expression": {"SourceRef": {"Entity": "Sales"}}, "Property": "%s"}}}, {"field": {"Odd": 1}}]}}},
 "visualContainerObjects": {"title": [{"properties": {"text": {"expr": {"Literal": {"Value": "'%s'"}}}}}]}},
"filterConfig": {"filters": [{"name": "f", "type": "Categorical", "field": {"Column": {"Expression": {"SourceRef": {"Entity": "Sales"}}, "Property": "Size"}},
 "filter": {"From": [{"Name": "s", "Entity": "Sales"}], "Where": [{"Condition": {"In": {"Expressions": [{"Column": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "Size"}}],
 "Values": [[{"Literal": {"Value": "%dL"}}], [{"Literal": {"Value": "7L"}}]]}}}]}}]}}"""


def _dealt_parts(spark, d):
    """The parts over all cores: each becomes a file of a report or model, many times as long as its row."""
    return dealt(table(spark, d, "part"), "p_partkey")


def raw_definitions(spark, d):
    """Files of report definitions, made from parts: a project for each brand, a page for each type, a visual for each part."""
    parts = _dealt_parts(spark, d).withColumns({"project": F.concat("p_brand", F.lit(".Report")), "page": F.lower("p_type")})
    height = F.when(F.col("p_partkey") % 40 != 5, F.lit(', "height": 50')).otherwise(F.lit(""))
    visual = F.format_string(_VISUAL_JSON, "p_partkey", F.col("p_size") * 10, F.col("p_partkey") % 100, height, "p_name", "p_name", "p_size")
    text = F.when(F.col("p_partkey") % 30 == 11, F.lit("{broken")).otherwise(visual)
    files = parts.select("project", F.concat("project", F.lit("/definition/pages/"), "page", F.lit("/visuals/v"), F.col("p_partkey").cast("string"), F.lit("/visual.json")).alias("path"), text.alias("t"))
    page = parts.select("project", "page").distinct().select("project", F.concat("project", F.lit("/definition/pages/"), "page", F.lit("/page.json")).alias("path"), F.to_json(F.struct(F.col("page").alias("name"), F.initcap("page").alias("displayName"), F.lit(640).alias("width"))).alias("t"))
    order = parts.groupBy("project").agg(F.sort_array(F.collect_set("page"), asc=False).alias("pageOrder")).select("project", F.concat("project", F.lit("/definition/pages/pages.json")).alias("path"), F.to_json(F.struct(F.slice("pageOrder", 1, 3).alias("pageOrder"))).alias("t"))
    return files.unionByName(page).unionByName(order).select("project", "path", F.encode("t", "UTF-8").alias("content"))


def definition_pages(spark, d):
    return R.pages(raw_definitions(spark, d)).withColumn("ordinal", F.col("ordinal").cast("bigint"))


def definition_visuals(spark, d):
    return R.visuals(raw_definitions(spark, d)).select("project", "page", "visual", "visual_type", "title", "x", "y", "width", "height")


def definition_issues(spark, d):
    return R.issues(raw_definitions(spark, d)).groupBy("project", "message").agg(F.count("*").alias("n"))


def definition_fields(spark, d):
    found = R.fields(raw_definitions(spark, d))
    return found.where("field.kind <> 'unknown'").select("project", "visual", "role", X.field_key(F.col("field.table"), F.col("field.name"), F.col("field.aggregation")).alias("field"))


def definition_filters(spark, d):
    return R.filters(raw_definitions(spark, d)).select("visual", "name", "filter_type", "condition", "unread")


def _model_texts(spark, d):
    """A model file for each part, indented by tabs or by spaces."""
    text = F.format_string("table 'T %d'\n~measure M =\n~~~SUM(x)\n~~~/// kept\n~~~~+ %d\n\n~~formatString: 0\n~/// left out\n~column C\n~~dataType: int64\n~measure E =\n", "p_partkey", "p_size")
    step = F.when(F.col("p_partkey") % 2 == 1, F.lit("    ")).otherwise(F.lit("\t"))
    return _dealt_parts(spark, d).select(F.concat("p_brand", F.lit(".SemanticModel")).alias("project"), F.format_string("definition/tables/T%d.tmdl", "p_partkey").alias("path"), F.encode(F.replace(text, F.lit("~"), step), "UTF-8").alias("content"))


def definition_models(spark, d):
    return D.model_text(_model_texts(spark, d)).select(F.col("table").alias("owner"), "kind", "name", "value")


def _model_json(spark, d):
    text = F.format_string('{"model": {"tables": [{"name": "T %d", "columns": [{"name": "c", "dataType": "%s"}], "measures": [{"name": "m", "expression": ["a", "+ %d"]}, {"name": "n", "expression": "SUM(x)"}]}]}}', "p_partkey", "p_type", "p_size")
    return _dealt_parts(spark, d).select(F.concat("p_brand", F.lit("/P"), F.col("p_partkey").cast("string"), F.lit(".SemanticModel")).alias("project"), text.alias("text"))


def _model_rows(columns, measures):
    own = columns.select(F.col("table").alias("owner"), F.lit("column").alias("kind"), "name", F.col("data_type").alias("value"))
    return own.unionByName(measures.select(F.col("table").alias("owner"), F.lit("measure").alias("kind"), "name", F.col("expression").alias("value")))


def definition_models_json(spark, d):
    raw = _model_json(spark, d).select("project", F.lit("model.bim").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return _model_rows(*D.model_json(raw))


def _packed(frames):
    for frame in frames:
        out = []
        for project, part, text in frame.itertuples(index=False):
            at = io.BytesIO()
            with zipfile.ZipFile(at, "w") as z:
                z.writestr("../DataModelSchema" if part % 10 == 3 else "DataModelSchema", text.encode("utf-16-le"))
            out.append((project, f"P{part}.pbit", at.getvalue() if part % 10 != 4 else b"no archive"))
        yield pd.DataFrame(out, columns=["project", "path", "content"])


def archived_models(spark, d):
    """Models inside archives, some of which are unsafe or none at all."""
    rows = _model_json(spark, d).withColumn("part", F.regexp_extract("text", "T ([0-9]+)", 1).cast("long")).select("project", "part", "text")
    found = D.unpacked(rows.mapInPandas(_packed, "project string, path string, content binary"))
    return _model_rows(*D.model_json(found.where("error IS NULL").drop("error"))).unionByName(found.where("error IS NOT NULL").select(F.lit(None).cast("string").alias("owner"), F.lit("issue").alias("kind"), F.col("path").alias("name"), F.lit("unread").alias("value")))


def _single_documents(spark, d):
    """A report in one document for each part, with two pages and one visual, whose configuration is JSON inside a string."""
    config = F.to_json(F.struct(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("name"), F.struct(F.lit("card").alias("visualType"), F.create_map(F.lit("Values"), F.array(F.struct(F.concat(F.lit("Sales."), "p_name").alias("queryRef")), F.struct(F.lit("Sales.Amount").alias("queryRef")))).alias("projections")).alias("singleVisual")))
    box = F.struct(F.col("p_size").cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(1.0).alias("z"), F.lit(30.0).alias("width"), F.lit(40.0).alias("height"), config.alias("config"))
    section = lambda name, label, at, width, boxes: F.struct(F.lit(name).alias("name"), label.alias("displayName"), F.lit(at).alias("ordinal"), width.alias("width"), boxes.alias("visualContainers"))
    none, wide = F.lit(None).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(800.0))
    doc = F.to_json(F.struct(F.array(section("later", F.initcap("p_type"), 7, F.lit(None).cast("double"), F.slice(F.array(box), 1, 0)), section("first", none, 3, wide, F.array(box))).alias("sections")))
    return _dealt_parts(spark, d).select(F.format_string("P%d.Report", "p_partkey").alias("project"), F.format_string("P%d.Report/report.json", "p_partkey").alias("path"), F.encode(doc, "UTF-8").alias("content"))


def single_document_pages(spark, d):
    return R.pages(cut_lineage(R.taken_apart(_single_documents(spark, d)))).withColumn("ordinal", F.col("ordinal").cast("bigint"))


def single_document_visuals(spark, d):
    return R.visuals_with_refs(cut_lineage(R.taken_apart(_single_documents(spark, d)))).select("project", "page", "visual", "visual_type", "x", "width", F.array_join("refs", ",").alias("fields"))


_SLICER_JSON = """{"name": "v%d", "position": {"x": 1, "y": 2, "width": 3, "height": 4}, "visual": {"visualType": "%s"%s},
"filterConfig": {"filters": [{"name": "ranked", "type": "TopN", "field": {"HierarchyLevel": {"Expression": {"Hierarchy": {"Expression": {"SourceRef": {"Entity": "Nation"}}, "Hierarchy": "Place"}}, "Level": "Name"}},
 "filter": {"From": [{"Name": "q", "Expression": {"Subquery": {"Query": {"From": [{"Name": "s", "Entity": "Sales"}], "Top": %d, "OrderBy": [{"Direction": %d, "Expression": {"Measure": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "Total"}}}]}}}, "Type": 2}, {"Name": "n", "Entity": "Nation"}],
 "Where": [{"Condition": {"In": {"Expressions": [{"Column": {"Expression": {"SourceRef": {"Source": "n"}}, "Property": "Name"}}], "Table": {"SourceRef": {"Source": "q"}}}}}]}}]}}"""
_SELECTION_JSON = """, "objects": {"general": [{"properties": {"filter": {"filter": {"From": [{"Name": "n", "Entity": "Nation"}], "Where": [{"Condition": {"In": {"Expressions": [{"Column": {"Expression": {"SourceRef": {"Source": "n"}}, "Property": "Key"}}], "Values": [[{"Literal": {"Value": "%dL"}}]]}}}]}}}}]}"""


def _slicer_files(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("card", "slicer", "listSlicer", "textSlicer"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    chosen = F.when(F.col("s_suppkey") % 3 == 0, F.format_string(_SELECTION_JSON, "s_nationkey")).otherwise(F.lit(""))
    text = F.format_string(_SLICER_JSON, "s_suppkey", kind, chosen, F.col("s_suppkey") % 5, F.col("s_suppkey") % 2 + 1)
    return table(spark, d, "supplier").select(F.format_string("N%d.Report", "s_nationkey").alias("project"), F.format_string("N%d.Report/definition/pages/p/visuals/v%d/visual.json", "s_nationkey", "s_suppkey").alias("path"), F.encode(text, "UTF-8").alias("content"))


def definition_slicers(spark, d):
    return R.slicers(_slicer_files(spark, d)).select("project", "visual", "condition", F.col("unread").isNotNull().alias("unread"))


def ranked_filters(spark, d):
    return R.filters(_slicer_files(spark, d)).select("visual", "filter_type", X.field_key(F.col("field.table"), F.col("field.name")).alias("field"), "condition", F.col("unread").isNotNull().alias("unread"))


def one_sided_visuals(spark, d):
    """Visuals added and removed, by their names on their pages; those of a file that could not be read on the other side are left out."""
    parts = table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.format_string("v%d", "p_partkey")).alias("path"), "p_partkey", F.col("p_type").alias("visual_type"))
    _, gone, come = P.pair_by_key(parts.where("p_partkey % 5 <> 1"), parts.where("p_partkey % 7 <> 2"), ["path"], ["p_partkey"])
    kinds = ("visual_type",)
    found = N.union([G.one_sided(gone, "visual", "removed", F.col("path"), kinds), G.one_sided(come, "visual", "added", F.col("path"), kinds)])
    broken = lambda x, m: x.where(f"p_partkey % 11 = {m}").select("path")
    return G.without_broken(found, broken(parts, 3), broken(parts, 4)).select("path", "category", "change", "visual_type")


def issues_on_old_pages(spark, d):
    """Issues of the new version on the pages as the old version names them."""
    pages = pages_paired(spark, d).select(F.concat(F.lit("o"), F.col("old_page_id").cast("string")).alias("old_page"), F.concat(F.lit("n"), F.col("new_page_id").cast("string")).alias("new_page"))
    issues = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.expr("CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'n' || (event_id % 700) || '/v' || (user_id % 5) END").alias("visual_path"))
    return G.on_old_pages(issues, pages)


# ------------------------------------------------------------------ whole reports

_COLUMN = '{"Column": {"Expression": {"SourceRef": {"%s": "%s"}}, "Property": "%s"}}'


def _in_filter(name, table, alias, column, value, key="field"):
    """A filter card `table[column] in (value)`; value is a column of numbers."""
    field = _COLUMN % ("Entity", table, column)
    where = '{"In": {"Expressions": [%s], "Values": [[{"Literal": {"Value": "%%dL"}}]]}}' % (_COLUMN % ("Source", alias, column))
    text = '{"name": "%s", "type": "Categorical", "%s": %s, "filter": {"From": [{"Name": "%s", "Entity": "%s"}], "Where": [{"Condition": %s}]}}' % (name, key, field, alias, table, where)
    return F.format_string(text, value)


_ODD_FILTER = '{"name": "odd", "filter": {"From": [{"Name": "s", "Entity": "Sales"}], "Where": [{"Condition": {"Between": {}}}]}}'


def _layered_parts(spark, d):
    """Visuals of a report for each brand with a page for each type: every third one is a slicer."""
    parts = _dealt_parts(spark, d).withColumns({"project": F.concat("p_brand", F.lit(".Report")), "page": F.lower("p_type"), "n": F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int"), "k": F.col("p_partkey").cast("int")})
    return parts.where("p_partkey % 7 < 3")


def _bodies(spark, d, key):
    """The parts with the filters of report, page and visual, each a JSON list, and the selection of slicers."""
    own = F.when(F.col("k") % 13 == 5, F.lit(_ODD_FILTER)).otherwise(_in_filter("own", "Part", "p", "Size", F.col("p_size").cast("int"), key))
    page = F.when(F.length("page") % 5 == 1, F.lit(_ODD_FILTER)).otherwise(_in_filter("paged", "Part", "q", "Length", F.length("page"), key))
    listed = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    selected = F.get_json_object(_in_filter("x", "Date", "d", "Year", F.col("k")), "$.filter")
    objects = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"general": [{"properties": {"outline": 1}}, {"properties": {"filter": {"filter": '), selected, F.lit("}}}]}")))
    return _layered_parts(spark, d).withColumns({"report_filters": listed(_in_filter("all", "Sales", "s", "Brand", F.col("n"), key)), "page_filters": listed(page), "own_filters": listed(own), "chosen": objects, "kind": F.expr("CASE WHEN k % 3 = 0 THEN 'slicer' ELSE 'card' END")})


def layered_reports(spark, d):
    """The files of reports with filters of all levels, as page folders."""
    b = _bodies(spark, d, "field")
    fields = F.concat(F.lit('{"queryState": {"Values": {"projections": [{"field": '), F.format_string(_COLUMN % ("Entity", "Sales", "%s"), "p_name"), F.lit('}, {"field": {"Aggregation": {"Expression": '), F.lit(_COLUMN % ("Entity", "Sales", "Amount")), F.lit(', "Function": 0}}}]}}}'))
    title = F.format_string('{"title": [{"properties": {"text": {"expr": {"Literal": {"Value": "\'%s\'\'s\'"}}}}}]}', "p_name")
    visual = F.concat(F.format_string('{"name": "v%d", "position": {"x": %d, "y": 2, "width": 30, "height": 40}, "visual": {"visualType": "%s", "query": ', "k", F.col("p_size").cast("int"), "kind"), fields, F.lit(', "visualContainerObjects": '), title, F.coalesce(F.concat(F.lit(', "objects": '), "chosen"), F.lit("")), F.lit('}, "filterConfig": {"filters": '), "own_filters", F.lit("}}"))
    at = lambda *path: F.concat("project", F.lit("/definition/"), *[F.lit(p) if p.startswith("/") or p.endswith(("/", ".json")) else F.col(p) for p in path])
    visuals = b.select("project", F.concat(at("pages/", "page"), F.lit("/visuals/v"), F.col("k").cast("string"), F.lit("/visual.json")).alias("path"), visual.alias("t"))
    pages = b.groupBy("project", "page").agg(F.first("page_filters").alias("f")).select("project", F.concat(at("pages/", "page"), F.lit("/page.json")).alias("path"), F.concat(F.format_string('{"name": "%s", "filterConfig": {"filters": ', "page"), "f", F.lit("}}")).alias("t"))
    report = b.groupBy("project").agg(F.first("report_filters").alias("f")).select("project", at("report.json").alias("path"), F.concat(F.lit('{"filterConfig": {"filters": '), "f", F.lit("}}")).alias("t"))
    return visuals.unionByName(pages).unionByName(report).select("project", "path", F.encode("t", "UTF-8").alias("content"))


def _layered_boxes(spark, d):
    """The visuals of the same reports as they stand in single documents: configurations and filters are JSON inside texts, fields go through a query with short names."""
    b = _bodies(spark, d, "expression")
    query = F.concat(F.lit('{"From": [{"Name": "t", "Entity": "Sales"}], "Select": [{"Name": "a", "Column": {"Expression": {"SourceRef": {"Source": "t"}}, "Property": '), F.to_json(F.array("p_name")), F.lit('}}, {"Name": "b", "NativeReferenceName": "B", "Aggregation": {"Expression": {"Column": {"Expression": {"SourceRef": {"Source": "t"}}, "Property": "Amount"}}, "Function": 0}}]}'))
    query = F.regexp_replace(query, r'"Property": \[("(?:[^"\\]|\\.)*")\]', '"Property": $1')
    title = F.format_string('{"title": [{"properties": {"text": {"expr": {"Literal": {"Value": "\'%s\'\'s\'"}}}}}]}', "p_name")
    single = F.concat(F.format_string('{"visualType": "%s", "projections": {"Values": [{"queryRef": "a"}, {"queryRef": "b"}]}, "prototypeQuery": ', "kind"), query, F.lit(', "vcObjects": '), title, F.coalesce(F.concat(F.lit(', "objects": '), "chosen"), F.lit("")), F.lit("}"))
    config = F.concat(F.format_string('{"name": "v%d", "layouts": [{"position": {"x": %d, "y": 2, "width": 30, "height": 40}}], "singleVisual": ', "k", F.col("p_size").cast("int")), single, F.lit("}"))
    box = F.to_json(F.struct(config.alias("config"), F.col("own_filters").alias("filters")))
    # The visuals of a report in the order of its pages, to be written one after the other. Pages stand in the order of their names, as page folders without a list do.
    return dealt(b.select("project", "page", "page_filters", "report_filters", box.alias("box")), "project").sortWithinPartitions("project", "page")


def _document_texts(batches):
    """(project, the texts that make up its document) out of rows of _layered_boxes."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    known = lambda **values: json.dumps({k: v for k, v in values.items() if v is not None}, ensure_ascii=False)[1:-1]

    def texts(own):
        yield '{"sections": ['
        for at, (page, boxes) in enumerate(itertools.groupby(own, key=lambda r: r[1])):
            first = next(boxes)
            own_members = known(name=page, filters=first[2])
            yield f'{", " if at else ""}{{{own_members}{", " if own_members else ""}"visualContainers": [{first[4]}'
            while some := [r[4] for r in itertools.islice(boxes, 1000)]:
                yield "," + ",".join(some)
            yield "]}"
        filters = known(filters=first[3])
        yield f"]{', ' if filters else ''}{filters}}}"

    for project, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield project, texts(own)


def _as_documents(batches, path):
    for project, texts in _document_texts(batches):
        content = bytearray()
        for text in texts:
            content += text.encode()
        yield project, None if project is None else f"{project}/{path}", bytes(content)


def _as_archives(batches):
    for project, texts in _document_texts(batches):
        at = io.BytesIO()
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z, z.open("Report/Layout", "w", force_zip64=True) as layout:
            for text in texts:
                layout.write(text.encode("utf-16-le"))
        yield project, f"{project}.pbit", at.getvalue()


_RAW = pa.schema([("project", pa.string()), ("path", pa.string()), ("content", pa.binary())])


def layered_documents(spark, d, path="report.json"):
    """The same reports as single documents, one for each brand, in pieces."""
    raw = _layered_boxes(spark, d).mapInArrow(lambda batches: D.in_batches(_as_documents(batches, path), _RAW), "project string, path string, content binary")
    return R.taken_apart(raw)


def layered_archives(spark, d):
    """The same single documents inside archives, in pieces."""
    raw = _layered_boxes(spark, d).mapInArrow(lambda batches: D.in_batches(_as_archives(batches), _RAW), "project string, path string, content binary")
    return R.taken_apart(raw, archives=True)


def visual_contexts(spark, d):
    """All conditions that hold for each visual: of its report, its page, its own and of the page's other slicers."""
    raw = cut_lineage(layered_reports(spark, d))  # made once for all that is read of it
    return C.context_texts(R.visuals(raw), R.filters(raw), R.slicers(raw)).select("project", "visual", "conditions", "reason")


def visual_contexts_of_documents(spark, d):
    """The same contexts out of single documents."""
    raw = cut_lineage(layered_documents(spark, d))  # made once for all that is read of it
    return C.context_texts(R.visuals(raw), R.filters(raw), R.slicers(raw)).select("project", "visual", "conditions", "reason")


def _field_rows(raw):
    f = F.col("field")
    return R.fields(raw).select("project", "page", "visual", "role", F.col("idx").cast("bigint").alias("idx"), X.field_key(f["table"], f["name"], f["aggregation"]).alias("field"), f["kind"].alias("kind"))


def single_document_fields(spark, d):
    """Fields of single documents through their queries: short names of tables, aggregations."""
    return _field_rows(cut_lineage(layered_documents(spark, d)))


def archived_fields(spark, d):
    """Fields of the reports inside archives."""
    return _field_rows(cut_lineage(layered_archives(spark, d)))


def archived_filters(spark, d):
    """Filter cards of all levels of the reports inside archives."""
    found = R.filters(cut_lineage(layered_archives(spark, d)))
    return found.select("project", "level", "page", "visual", "name", "filter_type", X.field_key(F.col("field.table"), F.col("field.name")).alias("field"), "condition", "unread")


def archive_issues(spark, d):
    """Archives that are none, unsafe, or hold a model but no report."""
    rows = _model_json(spark, d).withColumn("part", F.regexp_extract("text", "T ([0-9]+)", 1).cast("long")).select("project", "part", "text")
    return R.archive_issues(rows.mapInPandas(_packed, "project string, path string, content binary")).select("project", "file", "message")


_BROKEN_FIELDS = ("5", "[1]", '"x"', "[]", "{}", "null", '{"Column": {"Property": "a", "Expression": 5}}', '{"Odd": {"b": [1, "\u00e9"]}}', '{"Measure": {"Expression": {"SourceRef": {"Entity": "T"}}, "Property": "M"}}')


def _broken_files(spark, d):
    """Reports, one for each part, in which something is not what it should be: a field of any JSON, page orders, lists, filters."""
    parts = _dealt_parts(spark, d).withColumns({"project": F.format_string("P%d.Report", "p_partkey"), "k": (F.col("p_partkey") % 9).cast("int"), "m": (F.col("p_partkey") % 7).cast("int")})
    field = F.element_at(F.array(*map(F.lit, _BROKEN_FIELDS)), F.col("k") + 1)
    places = F.when(F.col("m") == 3, F.lit('"none"')).otherwise(F.concat(F.lit('[{"field": '), field, F.lit("}]")))
    cards = F.when(F.col("m") == 4, F.lit("7")).when(F.col("m") == 5, F.lit("[%s, 8]" % _ODD_FILTER)).otherwise(F.lit("[]"))
    visual = F.concat(F.lit('{"name": "v", "position": {"x": 1, "y": 2, "width": 3, "height": 4}, "visual": {"query": {"queryState": {"Values": {"projections": '), places, F.lit('}}}}, "filterConfig": {"filters": '), cards, F.lit("}}"))
    order = F.element_at(F.array(*map(F.lit, ('["p"]', "[]", '"p"', "[1]", "null", '["p", null]', '{"p": 1}'))), F.col("m") + 1)
    files = [("pages/p/visuals/v/visual.json", visual), ("pages/p/page.json", F.lit('{"name": "p"}')), ("pages/pages.json", F.concat(F.lit('{"pageOrder": '), order, F.lit("}")))]
    made = [parts.select("project", F.concat("project", F.lit(f"/definition/{path}")).alias("path"), F.encode(text, "UTF-8").alias("content")) for path, text in files]
    return made[0].unionByName(made[1]).unionByName(made[2])


def broken_definitions(spark, d):
    """What can't be read is told for its file, and the rest is read."""
    return R.issues(_broken_files(spark, d)).select("project", "file", "page", "visual", "message")


def broken_fields(spark, d):
    """Fields of unknown forms keep their kind and a hash; what is no field is none."""
    found = R.fields(_broken_files(spark, d))
    return found.select("project", F.col("field.table").alias("owner"), F.col("field.name").alias("name"), F.col("field.kind").alias("kind"))


def conditions_renamed(spark, d):
    """Conditions of parts on the fields of their brand, with renames out of a table: lists of values as rendered."""
    parts = table(spark, d, "part")
    tree = F.format_string('{"in":[["%s","%s"]],"rows":[[%d],["x"]]}', "p_brand", "p_type", F.col("p_size").cast("int"))
    conditions = parts.select("p_partkey", tree.alias("tree"), F.format_string("%s[%s] in (%d, 'x')", "p_brand", "p_type", F.col("p_size").cast("int")).alias("condition"), F.array(F.struct(F.col("p_brand").alias("table"), F.col("p_type").alias("name"))).alias("fields"))
    renames = parts.where("p_size > 48").select(F.col("p_brand").alias("old_table"), F.col("p_type").alias("old_name"), F.expr("p_brand || '!'").alias("new_table"), F.expr("'new ' || p_type").alias("new_name")).distinct()
    found = C.renamed_conditions(conditions, renames)
    return found.select("p_partkey", "condition", X.field_key(F.col("fields")[0]["table"], F.col("fields")[0]["name"]).alias("field"))


QUERIES = {f.__name__: f for f in (visual_contexts, visual_contexts_of_documents, single_document_fields, archived_fields, archived_filters, archive_issues, broken_definitions, broken_fields, conditions_renamed, pages_paired, pages_left_over, pages_unique_titles, part_candidates, part_pairs, measures_renamed, measures_changed, fields_changed, filters_changed, slicers_changed, pages_changed, pages_reordered, visuals_changed, one_sided_pages, first_locations, fields_renamed, issues_by_name, visuals_comparable, models_missing, columns_paired, findings_numbered, findings_by_severity, findings_by_category, findings_gate, findings_most_severe, findings_open_data, item_statuses, findings_by_visual, findings_masked, pairable_categories, renames_vetted, findings_explained, findings_markdown, findings_documents, projects_result, view_pages, view_visuals, files_changed, units_changed, model_readers, project_runs, literals, json_properties, definition_pages, definition_visuals, definition_issues, definition_fields, definition_filters, definition_models, definition_models_json, archived_models, single_document_pages, single_document_visuals, definition_slicers, ranked_filters, one_sided_visuals, issues_on_old_pages)}

# ------------------------------------------------------------------ the same in SQL

_PAGES = """
pg AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS name, regexp_extract(html, '<title>([^<]*)</title>', 1) AS display FROM pages),
old AS (SELECT * FROM pg WHERE page_id % 7 <> 6),
new AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN name || '~' ELSE name END AS name, display FROM pg WHERE page_id % 5 <> 4),
p1 AS (SELECT o.page_id AS old_page_id, n.page_id AS new_page_id FROM (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM old) o JOIN (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM new) n USING (name) WHERE o.c = 1 AND n.c = 1),
o2 AS (SELECT * FROM old WHERE page_id NOT IN (SELECT old_page_id FROM p1)),
n2 AS (SELECT * FROM new WHERE page_id NOT IN (SELECT new_page_id FROM p1)),
p2 AS (SELECT o.page_id AS old_page_id, n.page_id AS new_page_id FROM (SELECT *, count(*) OVER (PARTITION BY display) AS c FROM o2) o JOIN (SELECT *, count(*) OVER (PARTITION BY display) AS c FROM n2) n USING (display) WHERE o.c = 1 AND n.c = 1)"""
_FINDINGS = f"""
f0 AS (SELECT user_id // 5 AS run, {_PATH} AS path, {_CATEGORY} AS category, {_CHANGE} AS change, 'm' || event_id AS message, NULL::VARCHAR AS old, floor(value * 100)::BIGINT::VARCHAR AS new, CASE WHEN event_id % 16 = 7 THEN 'p1/v1' END AS visual_path FROM events),
f1 AS (SELECT *, {_SEVERITY} AS severity, CASE category WHEN 'measure' THEN 'model' WHEN 'ai' THEN 'ai' ELSE 'page' END AS scope FROM f0),
f2 AS (SELECT *, scope || ':' || category || ':' || change || ':' || path AS base_key, CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS rank FROM f1),
f AS (SELECT *, base_key || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS key FROM (SELECT *, row_number() OVER (PARTITION BY run, base_key ORDER BY path, category, change, message, coalesce(old, ''), coalesce(new, '')) AS k FROM f2))"""
_MEASURES_TAIL = """
rm AS (SELECT * FROM old WHERE (tbl, name) NOT IN (SELECT (tbl, name) FROM new) AND (tbl, name) NOT IN (SELECT (tbl, name) FROM un)),
ad AS (SELECT * FROM new WHERE (tbl, name) NOT IN (SELECT (tbl, name) FROM old) AND (tbl, name) NOT IN (SELECT (tbl, name) FROM un)),
rn AS (SELECT r.tbl, r.name AS old_name, a.name AS new_name FROM (SELECT *, count(*) OVER (PARTITION BY tbl, ex) AS c FROM rm) r JOIN (SELECT *, count(*) OVER (PARTITION BY tbl, ex) AS c FROM ad) a USING (tbl, ex) WHERE r.c = 1 AND a.c = 1),
rm2 AS (SELECT * FROM rm WHERE (tbl, name) NOT IN (SELECT (tbl, old_name) FROM rn)),
ad2 AS (SELECT * FROM ad WHERE (tbl, name) NOT IN (SELECT (tbl, new_name) FROM rn)),
mv AS (SELECT r.tbl AS old_tbl, a.tbl AS new_tbl, r.name FROM (SELECT *, count(*) OVER (PARTITION BY name, ex) AS c FROM rm2) r JOIN (SELECT *, count(*) OVER (PARTITION BY name, ex) AS c FROM ad2) a USING (name, ex) WHERE r.c = 1 AND a.c = 1)"""
_LISTINGS = """
fl AS (SELECT page_id, 'team' || (page_id % 4) || '/r' || (page_id % 60) || CASE page_id % 3 WHEN 0 THEN '.Report/' WHEN 1 THEN '.SemanticModel/' ELSE '.other/' END || 'f' || page_id || CASE WHEN page_id % 50 = 7 THEN '.pbit' ELSE '.json' END AS path, sha256(html) AS sha FROM pages),
old AS (SELECT path, sha FROM fl WHERE page_id % 12 <> 5),
new AS (SELECT path, CASE WHEN page_id % 10 = 3 THEN reverse(sha) ELSE sha END AS sha FROM fl WHERE page_id % 9 <> 0),
ch AS (SELECT path, CASE WHEN old.sha IS NULL THEN 'added' WHEN new.sha IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old FULL JOIN new USING (path) WHERE old.sha IS DISTINCT FROM new.sha),
un AS (SELECT DISTINCT CASE WHEN regexp_matches(path, '\\.(Report|SemanticModel)/') THEN regexp_extract(path, '^(.*?\\.(?:Report|SemanticModel))/', 1) WHEN lower(path) LIKE '%.pbit' THEN path END AS unit FROM ch),
cu AS (SELECT unit FROM un WHERE unit IS NOT NULL),
md AS (SELECT unit AS model FROM cu WHERE unit LIKE '%.SemanticModel'),
nu AS (SELECT DISTINCT CASE WHEN regexp_matches(path, '\\.(Report|SemanticModel)/') THEN regexp_extract(path, '^(.*?\\.(?:Report|SemanticModel))/', 1) WHEN lower(path) LIKE '%.pbit' THEN path END AS unit FROM new),
ou AS (SELECT DISTINCT CASE WHEN regexp_matches(path, '\\.(Report|SemanticModel)/') THEN regexp_extract(path, '^(.*?\\.(?:Report|SemanticModel))/', 1) WHEN lower(path) LIKE '%.pbit' THEN path END AS unit FROM old),
rp AS (SELECT unit AS report, CASE WHEN n % 15 <> 0 THEN left(unit, 5) || '/r' || (n + 1) || '.SemanticModel' END AS model FROM (SELECT unit, regexp_extract(unit, '/r([0-9]+)', 1)::INT AS n FROM nu WHERE unit LIKE '%.Report')),
rd AS (SELECT md.model, report FROM rp JOIN md ON rp.model = md.model OR rp.model IS NULL)"""

_LAYERS = """
b AS (SELECT p_brand || '.Report' AS project, lower(p_type) AS page, p_partkey AS k, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS n, p_size, p_name FROM part WHERE p_partkey % 7 < 3)"""
_CONTEXTS = f"""WITH {_LAYERS},
s AS (SELECT project, page, k, 'Date[Year] in (' || k || ')' AS c FROM b WHERE k % 3 = 0),
r AS (SELECT *, CASE WHEN length(page) % 5 = 1 OR k % 13 = 5 THEN 'filter odd could not be read' END AS reason FROM b),
o AS (SELECT r.project, r.k, string_agg(s.c, ' and ' ORDER BY 'v' || s.k) AS others FROM r JOIN s ON s.project = r.project AND s.page = r.page AND s.k <> r.k GROUP BY ALL)
SELECT r.project, 'v' || r.k AS visual, CASE WHEN reason IS NULL THEN 'Sales[Brand] in (' || n || ') and Part[Length] in (' || length(page) || ') and Part[Size] in (' || p_size || ')' || coalesce(' and ' || others, '') ELSE '' END AS conditions, reason
FROM r LEFT JOIN o ON o.project = r.project AND o.k = r.k"""
_LAYER_FIELDS = f"""WITH {_LAYERS}
SELECT project, page, 'v' || k AS visual, 'Values' AS role, 0::BIGINT AS idx, 'Sales[' || p_name || ']' AS field, 'column' AS kind FROM b
UNION ALL SELECT project, page, 'v' || k, 'Values', 1, 'Sum(Sales[Amount])', 'aggregation' FROM b"""
_LAYER_FILTERS = f"""WITH {_LAYERS},
f AS (
  SELECT DISTINCT project, 'report' AS level, NULL AS page, NULL AS visual, 'all' AS name, 'Sales[Brand]' AS field, n AS v, false AS odd FROM b
  UNION ALL SELECT DISTINCT project, 'page', page, NULL, 'paged', 'Part[Length]', length(page), length(page) % 5 = 1 FROM b
  UNION ALL SELECT project, 'visual', page, 'v' || k, 'own', 'Part[Size]', p_size, k % 13 = 5 FROM b)
SELECT project, level, page, visual, CASE WHEN odd THEN 'odd' ELSE name END AS name, CASE WHEN odd THEN 'Unknown' ELSE 'Categorical' END AS filter_type, CASE WHEN NOT odd THEN field END AS field,
       CASE WHEN NOT odd THEN field || ' in (' || v || ')' END AS condition, CASE WHEN odd THEN '[{{"Condition": {{"Between": {{}}}}}}]' END AS unread FROM f"""
_BROKEN = """WITH b AS (SELECT 'P' || p_partkey || '.Report' AS project, p_partkey % 9 AS k, p_partkey % 7 AS m FROM part)"""

ORACLE = {
    "visual_contexts": _CONTEXTS,
    "visual_contexts_of_documents": _CONTEXTS,
    "single_document_fields": _LAYER_FIELDS,
    "archived_fields": _LAYER_FIELDS,
    "archived_filters": _LAYER_FILTERS,
    "archive_issues": "SELECT p_brand || '/P' || p_partkey || '.SemanticModel' AS project, 'P' || p_partkey || '.pbit' AS file, CASE p_partkey % 10 WHEN 3 THEN 'an entry leaves the archive' WHEN 4 THEN 'File is not a zip file' ELSE 'no Report/Layout in the archive' END AS message FROM part",
    "broken_definitions": f"""{_BROKEN}
SELECT project, project || '/definition/pages/pages.json' AS file, NULL AS page, NULL AS visual, 'the page order is not a list of names' AS message FROM b WHERE m >= 2
UNION ALL SELECT project, project || '/definition/pages/p/visuals/v/visual.json', 'p', 'v', 'no list of fields in role Values' FROM b WHERE m = 3
UNION ALL SELECT project, project || '/definition/pages/p/visuals/v/visual.json', 'p', 'v', 'no field in role Values' FROM b WHERE m <> 3 AND k < 6
UNION ALL SELECT project, project || '/definition/pages/p/visuals/v/visual.json', 'p', 'v', 'the filters are not a list' FROM b WHERE m = 4
UNION ALL SELECT project, project || '/definition/pages/p/visuals/v/visual.json', 'p', 'v', 'an unknown condition in filter odd' FROM b WHERE m = 5""",
    "broken_fields": f"""{_BROKEN}
SELECT project, CASE k WHEN 8 THEN 'T' ELSE '' END AS owner, CASE k WHEN 6 THEN 'Column ' || substr(sha256('{{"Column":{{"Expression":5,"Property":"a"}}}}'), 1, 8) WHEN 7 THEN 'Odd ' || substr(sha256('{{"Odd":{{"b":[1,"' || chr(92) || 'u00e9"]}}}}'), 1, 8) ELSE 'M' END AS name, CASE k WHEN 8 THEN 'measure' ELSE 'unknown' END AS kind
FROM b WHERE m <> 3 AND k >= 6""",
    "conditions_renamed": """WITH r AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 48),
c AS (SELECT p_partkey, p_size, CASE WHEN r.p_brand IS NULL THEN part.p_brand || '[' || part.p_type || ']' ELSE part.p_brand || '![new ' || part.p_type || ']' END AS field FROM part LEFT JOIN r ON r.p_brand = part.p_brand AND r.p_type = part.p_type)
SELECT p_partkey, field || ' in (' || p_size || ', ''x'')' AS condition, field FROM c""",
    "pages_paired": f"WITH {_PAGES} SELECT *, 'id' AS method FROM p1 UNION ALL SELECT *, 'display_name' FROM p2",
    "pages_left_over": f"WITH {_PAGES} SELECT page_id, 'old' AS side FROM o2 WHERE page_id NOT IN (SELECT old_page_id FROM p2) UNION ALL SELECT page_id, 'new' FROM n2 WHERE page_id NOT IN (SELECT new_page_id FROM p2)",
    "pages_unique_titles": "SELECT page_id FROM (SELECT page_id, count(*) OVER (PARTITION BY regexp_extract(html, '<title>([^<]*)</title>', 1)) AS c FROM pages) WHERE c = 1",
    "part_candidates": """WITH fd AS (SELECT l_partkey, list_sort(list(DISTINCT (l_suppkey % 20)::VARCHAR)) AS fields FROM lineitem GROUP BY 1),
r AS (SELECT p_brand, p_partkey, p_type, nullif(p_name, 'red widget') AS title, coalesce(fields, []) AS fields, p_size::DOUBLE AS x, (p_partkey % 100)::DOUBLE AS y FROM part LEFT JOIN fd ON p_partkey = l_partkey),
c AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_partkey % 2, p_type, title, fields, x, y) AS class FROM r),
s AS (SELECT a.p_brand, a.p_partkey AS old, b.p_partkey AS new,
  0.3 * CASE WHEN a.p_type = b.p_type THEN 1.0 ELSE 0.0 END::DOUBLE + 0.2 * CASE WHEN a.title IS NOT DISTINCT FROM b.title THEN 1.0 ELSE 0.0 END::DOUBLE
  + 0.3 * (CASE WHEN len(a.fields) + len(b.fields) = 0 THEN 1.0 ELSE len(list_intersect(a.fields, b.fields))::DOUBLE / (len(a.fields) + len(b.fields) - len(list_intersect(a.fields, b.fields))) END)::DOUBLE
  + 0.2 * greatest(0.0, 1 - sqrt(((a.x + 5) / 100 - (b.x + 5) / 100) ** 2 + ((a.y + 10) / 200 - (b.y + 10) / 200) ** 2) / sqrt(2.0::DOUBLE)) AS score
  FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 AND a.p_partkey = a.class AND b.p_partkey = b.class)
SELECT p_brand, 'pair' AS part, old, new, NULL::BIGINT AS member, round(score, 6) AS score FROM s WHERE round(score, 6) >= 0.8
UNION ALL SELECT p_brand, 'old', class, NULL, p_partkey, NULL FROM c WHERE p_partkey % 2 = 0
UNION ALL SELECT p_brand, 'new', NULL, class, p_partkey, NULL FROM c WHERE p_partkey % 2 = 1""",
    "measures_renamed": f"""WITH old AS (SELECT lang AS tbl, doc_id::VARCHAR AS name, text AS ex FROM documents WHERE doc_id % 2 = 0), new AS (SELECT lang AS tbl, doc_id::VARCHAR AS name, text AS ex FROM documents WHERE doc_id % 2 = 1),
un AS (SELECT '' AS tbl, '' AS name WHERE false), {_MEASURES_TAIL}
SELECT tbl AS old_table, old_name, tbl AS new_table, new_name FROM rn UNION ALL SELECT old_tbl, name, new_tbl, name FROM mv""",
    "measures_changed": f"""WITH dd AS (SELECT * FROM documents),
old AS (SELECT source AS tbl, doc_id::VARCHAR AS name, text AS ex FROM dd WHERE doc_id % 13 <> 0),
new AS (SELECT CASE WHEN doc_id % 5 = 0 THEN lang ELSE source END AS tbl, CASE WHEN doc_id % 7 = 0 THEN 'new ' || doc_id ELSE doc_id::VARCHAR END AS name, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS ex FROM dd WHERE doc_id % 17 <> 0),
un AS (SELECT source AS tbl, doc_id::VARCHAR AS name FROM dd WHERE doc_id % 19 = 0), {_MEASURES_TAIL},
x AS (SELECT tbl || '[' || name || ']' AS path, 'modified' AS change, old.ex AS old, new.ex AS new FROM old JOIN new USING (tbl, name) WHERE old.ex <> new.ex
 UNION ALL SELECT tbl || '[' || new_name || ']', 'renamed', old_name, new_name FROM rn
 UNION ALL SELECT new_tbl || '[' || name || ']', 'moved', old_tbl || '[' || name || ']', new_tbl || '[' || name || ']' FROM mv
 UNION ALL SELECT tbl || '[' || name || ']', 'removed', ex, NULL FROM rm2 WHERE (tbl, name) NOT IN (SELECT (old_tbl, name) FROM mv)
 UNION ALL SELECT tbl || '[' || name || ']', 'added', NULL, ex FROM ad2 WHERE (tbl, name) NOT IN (SELECT (new_tbl, name) FROM mv))
SELECT path, change, md5(coalesce(old, '')) AS old, md5(coalesce(new, '')) AS new FROM x""",
    "fields_changed": """WITH r AS (SELECT l_orderkey % 2 AS side, l_partkey % 500 AS visual, (l_suppkey % 10)::VARCHAR AS field, string_agg(DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'Values' WHEN 1 THEN 'Category' ELSE 'Series' END, ', ' ORDER BY CASE l_linenumber % 3 WHEN 0 THEN 'Values' WHEN 1 THEN 'Category' ELSE 'Series' END) AS roles FROM lineitem GROUP BY ALL)
SELECT visual, field AS path, 'field' AS category, CASE WHEN o.roles IS NULL THEN 'added' WHEN n.roles IS NULL THEN 'removed' ELSE 'moved' END AS change, o.roles AS old, n.roles AS new
FROM (SELECT * FROM r WHERE side = 0) o FULL JOIN (SELECT * FROM r WHERE side = 1) n USING (visual, field) WHERE o.roles IS DISTINCT FROM n.roles""",
    "filters_changed": """WITH t AS (SELECT 0 AS side, conv_id, turn, role, text, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS name FROM conversations
  UNION ALL SELECT 1, conv_id, turn, role, CASE WHEN conv_id % 4 = 1 THEN text || '!' ELSE text END, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END FROM conversations WHERE (conv_id + turn) % 6 <> 5),
l AS (SELECT *, row_number() OVER (PARTITION BY side, conv_id, name ORDER BY turn) AS k FROM t),
g AS (SELECT side, conv_id, CASE WHEN name IS NULL THEN '#' || k WHEN k > 1 THEN name || '#' || k ELSE name END AS label, md5(CASE WHEN conv_id % 4 = 1 THEN text ELSE '' END) AS definition,
  CASE WHEN conv_id % 5 = 3 AND side = 1 THEN 'other' ELSE role END AS field, CASE WHEN side = 1 AND conv_id % 9 = 2 THEN 'Advanced' ELSE 'Categorical' END AS filter_type FROM l),
j AS (SELECT conv_id, label, o.definition AS d0, n.definition AS d1, o.field AS f0, n.field AS f1, o.filter_type AS t0, n.filter_type AS t1 FROM (SELECT * FROM g WHERE side = 0) o FULL JOIN (SELECT * FROM g WHERE side = 1) n USING (conv_id, label)),
c AS (SELECT *, CASE WHEN d0 IS NULL THEN 'added' WHEN d1 IS NULL THEN 'removed' WHEN d0 <> d1 THEN 'modified' WHEN f0 <> f1 THEN 'refielded' WHEN t0 <> t1 THEN 'retyped' END AS change FROM j)
SELECT conv_id, label AS path, 'filter' AS category, change, CASE change WHEN 'refielded' THEN f0 WHEN 'retyped' THEN t0 ELSE d0 END AS old, CASE change WHEN 'refielded' THEN f1 WHEN 'retyped' THEN t1 ELSE d1 END AS new FROM c WHERE change IS NOT NULL""",
    "slicers_changed": """WITH p AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 3)::VARCHAR END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 2)::VARCHAR END AS b FROM events)
SELECT event_id, 'p/' || event_id AS path, 'slicer' AS category, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'modified' END AS change, a AS old, b AS new FROM p WHERE a IS DISTINCT FROM b""",
    "pages_changed": """WITH p AS (SELECT page_id, page_id % 12 AS report, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, 'p' || page_id AS o, 'p' || CASE WHEN page_id % 6 = 0 THEN page_id + 100000 ELSE page_id END AS n FROM pages)
SELECT report, n AS path, 'page' AS category, 'renamed' AS change, t AS old, t || '!' AS new FROM p WHERE page_id % 4 = 0 UNION ALL SELECT report, n, 'page', 'new_id', o, n FROM p WHERE o <> n""",
    "pages_reordered": """WITH p AS (SELECT page_id % 12 AS report, 'p' || CASE WHEN page_id % 6 = 0 THEN page_id + 100000 ELSE page_id END AS n, page_id AS a, CASE WHEN page_id % 24 < 12 THEN page_id + 24 ELSE page_id END AS b FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY a, n) AS x, row_number() OVER (PARTITION BY report ORDER BY b, n) AS y FROM p)
SELECT report, n AS path, 'page' AS category, 'reordered' AS change, x::VARCHAR AS old, y::VARCHAR AS new FROM r WHERE x <> y""",
    "visuals_changed": """WITH p AS (SELECT p_partkey, p_brand, 'v' || p_partkey AS i0, 'v' || (p_partkey + p_partkey % 2) AS i1, p_type AS t0, CASE WHEN p_partkey % 3 = 0 THEN 'STANDARD' ELSE p_type END AS t1, nullif(p_name, 'red widget') AS n0, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS n1,
  p_size::VARCHAR || ',' || (p_partkey % 100) || ',10,20' AS x0, (p_size + p_size % 2)::VARCHAR || ',' || (p_partkey % 100) || ',10,20' AS x1 FROM part),
u AS (SELECT *, 'new_id' AS change, i0 AS old, i1 AS new FROM p UNION ALL SELECT *, 'retyped', t0, t1 FROM p UNION ALL SELECT *, 'retitled', n0, n1 FROM p UNION ALL SELECT *, 'moved', x0, x1 FROM p)
SELECT p_partkey, p_brand || '/' || i1 AS path, 'visual' AS category, change, old, new FROM u WHERE old IS DISTINCT FROM new""",
    "one_sided_pages": f"""WITH {_PAGES}, v AS (SELECT l_orderkey % 300 AS page_id, count(*) AS visuals FROM lineitem GROUP BY 1),
x AS (SELECT page_id, name || '#' || page_id AS path, 'removed' AS change FROM o2 UNION ALL SELECT page_id, name || '#' || page_id, 'added' FROM n2),
b AS (SELECT name || '#' || page_id AS path, 'added' AS change FROM new WHERE page_id % 8 = 1 UNION SELECT name || '#' || page_id, 'removed' FROM old WHERE page_id % 8 = 2)
SELECT path, 'page' AS category, change, coalesce(visuals, 0)::BIGINT AS visuals FROM x LEFT JOIN v USING (page_id) WHERE (path, change) NOT IN (SELECT (path, change) FROM b)""",
    "first_locations": "SELECT l_partkey, arg_min(l_orderkey, (l_linenumber, l_orderkey, l_suppkey)) AS location FROM lineitem GROUP BY 1",
    "fields_renamed": """WITH r AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 25)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Sum(' || k || ')' ELSE k END AS key FROM (SELECT p_partkey, part.p_brand || '[' || CASE WHEN r.p_type IS NOT NULL THEN 'new ' ELSE '' END || part.p_type || ']' AS k FROM part LEFT JOIN r USING (p_brand, p_type))""",
    "issues_by_name": "SELECT DISTINCT coalesce(n_name, p) AS path, 'parse_issue' AS category, 'error' AS change, NULL::VARCHAR AS old, 'broken' AS new FROM (SELECT (user_id % 40)::VARCHAR AS p FROM events WHERE event_type = 'error') LEFT JOIN nation ON n_nationkey::VARCHAR = p",
    "visuals_comparable": """WITH l AS (SELECT DISTINCT 'Brand#' || (s_suppkey % 25) AS page FROM supplier WHERE s_suppkey % 6 = 1),
r AS (SELECT 'v' || p_partkey AS visual, CASE WHEN (p_size % 5 = 0) <> (p_size % 10 = 0) THEN 'a slicer on one side only' WHEN p_partkey % 17 = 3 THEN 'the visual could not be read completely' WHEN p_brand IN (SELECT page FROM l) THEN 'a visual of its page could not be read' END AS reason
  FROM part WHERE NOT (p_size % 5 = 0 AND p_size % 10 = 0) AND NOT (p_size % 4 = 0 AND p_size % 8 = 0))
SELECT visual, reason IS NULL AS compare, reason FROM r""",
    "models_missing": """WITH m AS (SELECT o_custkey % 400 AS report, CASE WHEN o_orderkey % 5 < 3 THEN 'old' ELSE 'new' END AS side FROM orders WHERE o_orderkey % 3 <> 1),
g AS (SELECT report, bool_or(side = 'old') AS o, bool_or(side = 'new') AS n FROM m WHERE report % 3 = 0 OR side = 'old' GROUP BY report)
SELECT report, 'model' AS path, 'error' AS change, 'measures not compared: no model on the ' || CASE WHEN o THEN 'new' ELSE 'old' END || ' side' AS new FROM g WHERE o <> n""",
    "columns_paired": """WITH b AS (SELECT DISTINCT l_orderkey % 2 AS side, l_partkey % 300 AS result, l_suppkey % 12 AS k FROM lineitem),
o AS (SELECT result, 'c' || k AS old_name, 'c' || CASE WHEN k < 4 THEN k + 12 ELSE k END AS name FROM b WHERE side = 0),
n AS (SELECT DISTINCT result, 'c' || CASE WHEN k IN (1, 2) THEN k + 12 ELSE k END AS name FROM b WHERE side = 1)
SELECT result, old_name, n.name AS new_name, CASE WHEN old_name IS NULL THEN 'only_new' WHEN n.name IS NULL THEN 'only_old' ELSE 'both' END AS state FROM o FULL JOIN n USING (result, name)""",
    "findings_numbered": f"WITH {_FINDINGS} SELECT run, key, severity, message FROM f",
    "findings_by_severity": f"WITH {_FINDINGS} SELECT run, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM f GROUP BY ROLLUP (run)",
    "findings_by_category": f"WITH {_FINDINGS} SELECT run, category, count(*) AS n FROM f WHERE rank >= 1 GROUP BY ALL",
    "findings_gate": f"WITH {_FINDINGS}, g AS (SELECT run, count(*) FILTER (WHERE category <> 'ai' AND rank >= 2) AS severe, count(*) FILTER (WHERE category = 'data' AND change = 'error') AS unvalidated FROM f WHERE category NOT IN ('data', 'filter', 'slicer', 'page', 'visual') OR run % 3 = 0 GROUP BY run) SELECT *, severe > 0 OR unvalidated > 0 AS failed FROM g",
    "findings_most_severe": f"WITH {_FINDINGS} SELECT run, path, category, change, severity, message FROM f WHERE category <> 'ai' AND rank >= 1 ORDER BY rank DESC, path, category, change, message LIMIT 50",
    "findings_open_data": f"WITH {_FINDINGS} SELECT run, count(*) AS n FROM f WHERE category = 'data' AND change = 'error' GROUP BY run",
    "item_statuses": f"""WITH {_FINDINGS}, v AS (SELECT DISTINCT user_id // 5 AS run, 'p' || (user_id % 7) || '/v' || (user_id % 21) AS path, CASE WHEN user_id % 5 = 0 THEN 'new' WHEN user_id % 5 = 1 THEN 'old' ELSE 'both' END AS side FROM events),
h AS (SELECT * FROM f WHERE run % 4 <> 1 AND change IN ('added', 'retyped') AND scope = 'page'),
c AS (SELECT v.run, v.path, v.side, count(h.path) AS n, count(h.path) FILTER (WHERE h.path = v.path AND h.change = CASE v.side WHEN 'new' THEN 'added' WHEN 'old' THEN 'removed' END) AS said FROM v LEFT JOIN h ON v.run = h.run AND (h.path = v.path OR starts_with(h.path, v.path || '/')) GROUP BY ALL)
SELECT run, path, side, CASE WHEN said > 0 THEN CASE side WHEN 'new' THEN 'added' ELSE 'removed' END WHEN n > 0 OR side <> 'both' THEN 'modified' ELSE 'unchanged' END AS status FROM c""",
    "findings_by_visual": f"""WITH {_FINDINGS}, v AS (SELECT DISTINCT user_id // 5 AS run, 'p' || (user_id % 7) || '/v' || (user_id % 21) AS visual FROM events WHERE user_id % 2 = 0),
x AS (SELECT run, key, coalesce(visual_path, CASE WHEN scope = 'page' THEN array_to_string(string_split(path, '/')[1:2], '/') END) AS visual FROM f),
y AS (SELECT run, visual, key, (row_number() OVER (PARTITION BY run, visual ORDER BY key) - 1) // 10000 AS part FROM x JOIN v USING (run, visual))
SELECT run, visual, part, count(*) AS n, md5(string_agg(key, ',' ORDER BY key)) AS keys_md5 FROM y GROUP BY ALL""",
    "findings_masked": f"WITH {_FINDINGS} SELECT category, change, severity, CASE WHEN category = 'data' THEN array_to_string(string_split(path, '/')[1:2], '/') || '/data' ELSE path END AS path, CASE WHEN category <> 'data' THEN message END AS message, CASE WHEN category <> 'data' THEN old END AS old, CASE WHEN category <> 'data' THEN new END AS new FROM f",
    "pairable_categories": f"WITH {_FINDINGS} SELECT DISTINCT category FROM f WHERE change = 'removed' AND category IN ('page', 'visual', 'measure') INTERSECT SELECT category FROM f WHERE change = 'added'",
    "findings_explained": f"""WITH {_FINDINGS}, t AS (SELECT conv_id % 50 AS id, arg_min(trim(text), conv_id * 1000 + turn) AS t FROM conversations WHERE turn <> 0 AND trim(text) <> '' GROUP BY 1)
SELECT run, message, md5(substring(t, 1, 600)) AS explanation_md5 FROM f LEFT JOIN t ON id = run * 10""",
    "findings_markdown": f"""WITH {_FINDINGS}, o AS (SELECT run, category, row_number() OVER w AS k, CASE WHEN lag(category) OVER w IS NOT DISTINCT FROM category THEN '' ELSE chr(10) || '## ' || category || chr(10) || chr(10) END || '- ' || severity || ': ' || path || ' ' || change || chr(10) AS b FROM f WINDOW w AS (PARTITION BY run ORDER BY category, path, change, message)),
s AS (SELECT *, sum(length(b)) OVER (PARTITION BY run ORDER BY k) AS total FROM o)
SELECT run, md5(coalesce(string_agg(b, '' ORDER BY k) FILTER (WHERE total <= 2000), '')) AS text_md5, count(*) FILTER (WHERE total <= 2000) AS shown, count(*) FILTER (WHERE total > 2000) AS more FROM s GROUP BY run""",
    "findings_documents": f"""WITH {_FINDINGS}, o AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY path, category, change, message) - 1) // 10000 AS part FROM f)
SELECT run, part, md5('{{"version":"1","findings":[' || string_agg('{{"path":"' || path || '","category":"' || category || '","change":"' || change || '","message":"' || message || '"}}', ',' ORDER BY path, category, change, message) || ']}}') AS document_md5 FROM o GROUP BY run, part""",
    "projects_result": f"""WITH p AS (SELECT 'team' || (user_id % 7) || '/r' || user_id || '.Report' AS path, CASE user_id % 8 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'error' ELSE 'changed' END AS status, {_SEVERITY} AS severity FROM (SELECT user_id, {_CATEGORY} AS category, {_CHANGE} AS change FROM events)),
g AS (SELECT path, status, count(*) FILTER (WHERE status = 'changed' AND severity = 'critical') AS critical, count(*) FILTER (WHERE status = 'changed' AND severity = 'warning') AS warning, count(*) FILTER (WHERE status = 'changed' AND severity = 'info') AS info FROM p GROUP BY ALL),
r AS (SELECT row_number() OVER (ORDER BY path) AS position, * FROM g UNION ALL SELECT 0, NULL, NULL, sum(critical)::BIGINT, sum(warning)::BIGINT, sum(info)::BIGINT FROM g)
SELECT *, '{{' || coalesce('"path":"' || path || '","status":"' || status || '",', '') || '"severity_counts":{{"critical":' || critical || ',"warning":' || warning || ',"info":' || info || '}}}}' AS document FROM r""",
    "view_pages": "WITH p AS (SELECT page_id // 20 AS report, 'p' || page_id AS name, page_id * 7 % 5 AS ordinal, CASE page_id % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'unchanged' END AS status FROM pages) SELECT *, row_number() OVER (PARTITION BY report ORDER BY ordinal, status = 'removed', name) AS position FROM p",
    "view_visuals": "WITH v AS (SELECT p_partkey // 12 AS page, 'v' || p_partkey AS name, CASE WHEN p_size % 4 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM part) SELECT *, row_number() OVER (PARTITION BY page ORDER BY name) AS position FROM v",
    "files_changed": f"WITH {_LISTINGS} SELECT path, change FROM ch",
    "units_changed": f"WITH {_LISTINGS} SELECT unit FROM cu WHERE starts_with(unit, 'team1/')",
    "model_readers": f"WITH {_LISTINGS} SELECT model, report FROM rd",
    "project_runs": f"""WITH {_LISTINGS}, a AS (SELECT unit FROM cu WHERE unit NOT IN (SELECT model FROM md) UNION SELECT report FROM rd)
SELECT unit AS path, CASE WHEN unit IN (SELECT unit FROM ou WHERE unit IS NOT NULL) AND unit IN (SELECT unit FROM nu WHERE unit IS NOT NULL) THEN 'changed' WHEN unit IN (SELECT unit FROM nu WHERE unit IS NOT NULL) THEN 'added' WHEN unit IN (SELECT unit FROM ou WHERE unit IS NOT NULL) THEN 'removed' ELSE 'error' END AS status FROM a
UNION ALL SELECT model, 'skipped' FROM md WHERE model NOT IN (SELECT model FROM rd) AND model IN (SELECT unit FROM nu WHERE unit IS NOT NULL)""",
    "literals": """SELECT DISTINCT CASE l_linenumber WHEN 1 THEN l_orderkey || 'L' WHEN 2 THEN l_partkey || '.50D' WHEN 3 THEN '''' || l_returnflag || '''''s''' WHEN 4 THEN 'true' WHEN 5 THEN 'datetime''' || strftime(l_shipdate, '%Y-%m-%d') || '''' WHEN 6 THEN 'null' ELSE 'Field' || l_suppkey END AS raw,
CASE l_linenumber WHEN 1 THEN 'number' WHEN 2 THEN 'number' WHEN 3 THEN 'text' WHEN 4 THEN 'boolean' WHEN 5 THEN 'datetime' WHEN 6 THEN 'null' ELSE 'other' END AS kind,
CASE l_linenumber WHEN 1 THEN l_orderkey::VARCHAR WHEN 2 THEN l_partkey || '.5' WHEN 3 THEN l_returnflag || '''s' WHEN 4 THEN 'true' WHEN 5 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 6 THEN NULL ELSE 'Field' || l_suppkey END AS value FROM lineitem""",
    "json_properties": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, 'a/' || event_type AS visual, event_type || '/' || user_id AS path FROM events",
    "definition_pages": """WITH p AS (SELECT DISTINCT p_brand || '.Report' AS project, lower(p_type) AS page FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY page DESC) AS k FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY CASE WHEN k <= 3 THEN k END NULLS LAST, page) - 1 AS ordinal FROM o)
SELECT project, page, upper(page[1]) || page[2:] AS display_name, 640.0::DOUBLE AS width, 720.0::DOUBLE AS height, ordinal FROM q""",
    "definition_visuals": "SELECT p_brand || '.Report' AS project, lower(p_type) AS page, 'v' || p_partkey AS visual, 'card' AS visual_type, p_name AS title, (p_size * 10)::DOUBLE AS x, (p_partkey % 100)::DOUBLE AS y, 100.0::DOUBLE AS width, 50.0::DOUBLE AS height FROM part WHERE p_partkey % 30 <> 11 AND p_partkey % 40 <> 5",
    "definition_issues": "SELECT p_brand || '.Report' AS project, CASE WHEN p_partkey % 30 = 11 THEN 'not a JSON object' ELSE 'the position is not complete' END AS message, count(*) AS n FROM part WHERE p_partkey % 30 = 11 OR p_partkey % 40 = 5 GROUP BY ALL",
    "definition_fields": "SELECT p_brand || '.Report' AS project, 'v' || p_partkey AS visual, 'Values' AS role, 'Sales[' || p_name || ']' AS field FROM part WHERE p_partkey % 30 <> 11",
    "definition_models": """SELECT 'T ' || p_partkey AS owner, 'measure' AS kind, 'M' AS name, 'SUM(x)' || chr(10) || '/// kept' || chr(10) || CASE WHEN p_partkey % 2 = 1 THEN '    ' ELSE chr(9) END || '+ ' || p_size AS value FROM part
UNION ALL SELECT 'T ' || p_partkey, 'column', 'C', 'int64' FROM part UNION ALL SELECT 'T ' || p_partkey, 'issue', 'E', 'a measure without an expression' FROM part""",
    "definition_models_json": "SELECT 'T ' || p_partkey AS owner, 'column' AS kind, 'c' AS name, p_type AS value FROM part UNION ALL SELECT 'T ' || p_partkey, 'measure', 'm', 'a' || chr(10) || '+ ' || p_size FROM part UNION ALL SELECT 'T ' || p_partkey, 'measure', 'n', 'SUM(x)' FROM part",
    "archived_models": """WITH g AS (SELECT * FROM part WHERE p_partkey % 10 NOT IN (3, 4))
SELECT 'T ' || p_partkey AS owner, 'column' AS kind, 'c' AS name, p_type AS value FROM g UNION ALL SELECT 'T ' || p_partkey, 'measure', 'm', 'a' || chr(10) || '+ ' || p_size FROM g UNION ALL SELECT 'T ' || p_partkey, 'measure', 'n', 'SUM(x)' FROM g
UNION ALL SELECT NULL, 'issue', 'P' || p_partkey || '.pbit', 'unread' FROM part WHERE p_partkey % 10 IN (3, 4)""",
    "single_document_pages": "SELECT 'P' || p_partkey || '.Report' AS project, 'first' AS page, 'first' AS display_name, CASE WHEN p_partkey % 2 = 0 THEN 800.0 ELSE 1280.0 END::DOUBLE AS width, 720.0::DOUBLE AS height, 0::BIGINT AS ordinal FROM part UNION ALL SELECT 'P' || p_partkey || '.Report', 'later', upper(p_type[1]) || lower(p_type[2:]), 1280.0, 720.0, 1 FROM part",
    "single_document_visuals": "SELECT 'P' || p_partkey || '.Report' AS project, 'first' AS page, 'v' || p_partkey AS visual, 'card' AS visual_type, p_size::DOUBLE AS x, 30.0::DOUBLE AS width, array_to_string(list_sort(['Sales.' || p_name, 'Sales.Amount']), ',') AS fields FROM part",
    "definition_slicers": "SELECT 'N' || s_nationkey || '.Report' AS project, 'v' || s_suppkey AS visual, CASE WHEN s_suppkey % 3 = 0 THEN 'Nation[Key] in (' || s_nationkey || ')' END AS condition, false AS unread FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 3 = 0",
    "ranked_filters": "SELECT 'v' || s_suppkey AS visual, 'TopN' AS filter_type, 'Nation[Place.Name]' AS field, CASE WHEN s_suppkey % 5 > 0 THEN CASE s_suppkey % 2 WHEN 1 THEN 'top ' ELSE 'bottom ' END || s_suppkey % 5 || ' Nation[Name] by Sales[Total]' END AS condition, s_suppkey % 5 = 0 AS unread FROM supplier",
    "one_sided_visuals": "SELECT p_brand || '/v' || p_partkey AS path, 'visual' AS category, CASE WHEN p_partkey % 5 = 1 THEN 'added' ELSE 'removed' END AS change, p_type AS visual_type FROM part WHERE (p_partkey % 5 = 1 AND p_partkey % 7 <> 2 AND p_partkey % 11 <> 3) OR (p_partkey % 5 <> 1 AND p_partkey % 7 = 2 AND p_partkey % 11 <> 4)",
    "issues_on_old_pages": f"WITH {_PAGES}, m AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), i AS (SELECT event_id, event_id % 700 AS page, user_id % 5 AS v FROM events WHERE event_type = 'error') SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN coalesce('o' || old_page_id, 'n' || page) || '/v' || v END AS visual_path FROM i LEFT JOIN m ON new_page_id = page",
    "definition_filters": "SELECT 'v' || p_partkey AS visual, 'f' AS name, 'Categorical' AS filter_type, 'Sales[Size] in (' || CASE WHEN p_size = 7 THEN '7' ELSE least(p_size, 7) || ', ' || greatest(p_size, 7) END || ')' AS condition, NULL::VARCHAR AS unread FROM part WHERE p_partkey % 30 <> 11",
}
