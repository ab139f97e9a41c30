"""Reports of all forms with known answers: forms that agree, broken parts, filter contexts, renames inside conditions."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import conditions as K
from tallyspark.operators import contexts as C
from tallyspark.sources import definitions as D
from tallyspark.sources import fields as E
from tallyspark.sources import reports as R

# ------------------------------------------------------------------ one report, three forms


def column(table, name, short=False):
    return {"Column": {"Expression": {"SourceRef": {"Source" if short else "Entity": table}}, "Property": name}}


def chosen(table, name, *values):
    return {"From": [{"Name": "x", "Entity": table}], "Where": [{"Condition": {"In": {"Expressions": [column("x", name, True)], "Values": [[{"Literal": {"Value": v}}] for v in values]}}}]}


def card(name, table, field, *values, key="field"):
    return {"name": name, "type": "Categorical", key: column(table, field), "filter": chosen(table, field, *values)}


VISUALS = {
    "overview": {
        "sales": ("card", [("Values", "Sum", ("Sales", "Amount")), ("Tooltip", None, ("Sales", "Net"))], [("own", "Product", "Kind", "'a'", "'b'")], None, "It's sold"),
        "year": ("slicer", [("Values", None, ("Date", "Year"))], [], ("Date", "Year", "2025L"), None),
        "area": ("listSlicer", [("Values", None, ("Area", "Name"))], [], None, None),
    },
    "details": {"lines": ("table", [("Values", None, ("Sales", "Line"))], [], None, None)},
}
PAGE_FILTERS = {"overview": [("paged", "Area", "Name", "'north'")], "details": []}
REPORT_FILTERS = [("all", "Sales", "Kept", "true")]


def as_folders():
    base, files = "R.Report/definition/", {}
    files[base + "report.json"] = {"filterConfig": {"filters": [card(*f) for f in REPORT_FILTERS]}}
    files[base + "pages/pages.json"] = {"pageOrder": list(VISUALS)}
    for page, visuals in VISUALS.items():
        files[f"{base}pages/{page}/page.json"] = {"name": page, "displayName": page.title(), "width": 800, "filterConfig": {"filters": [card(*f) for f in PAGE_FILTERS[page]]}}
        for i, (name, (kind, places, own, selection, title)) in enumerate(visuals.items()):
            roles: dict = {}
            for role, function, ref in places:
                field = column(*ref)
                roles.setdefault(role, {"projections": []})["projections"].append({"field": {"Aggregation": {"Expression": field, "Function": 0}} if function else field})
            body = {"visualType": kind, "query": {"queryState": roles}}
            if selection:
                body["objects"] = {"general": [{"properties": {}}, {"properties": {"filter": {"filter": chosen(*selection)}}}]}
            if title:
                body["visualContainerObjects"] = {"title": [{"properties": {"text": {"expr": {"Literal": {"Value": "'" + title.replace("'", "''") + "'"}}}}}]}
            files[f"{base}pages/{page}/visuals/{name}/visual.json"] = {"name": name, "position": {"x": i, "y": 2, "width": 30, "height": 40}, "visual": body, "filterConfig": {"filters": [card(*f) for f in own]}}
    return {k: json.dumps(v).encode() for k, v in files.items()}


def as_document():
    sections = []
    for at, (page, visuals) in enumerate(VISUALS.items()):
        containers = []
        for i, (name, (kind, places, own, selection, title)) in enumerate(visuals.items()):
            roles, selects = {}, []
            for k, (role, function, ref) in enumerate(places):
                field = column("s" if ref[0] == "Sales" else ref[0], ref[1], True) if ref[0] == "Sales" else column(*ref)
                selects.append({"Name": f"q{k}", "NativeReferenceName": ref[1], **({"Aggregation": {"Expression": field, "Function": 0}} if function else field)})
                roles.setdefault(role, []).append({"queryRef": f"q{k}"})
            single = {"visualType": kind, "projections": roles, "prototypeQuery": {"From": [{"Name": "s", "Entity": "Sales"}], "Select": selects}}
            if selection:
                single["objects"] = {"general": [{"properties": {}}, {"properties": {"filter": {"filter": chosen(*selection)}}}]}
            if title:
                single["vcObjects"] = {"title": [{"properties": {"text": {"expr": {"Literal": {"Value": "'" + title.replace("'", "''") + "'"}}}}}]}
            config = {"name": name, "layouts": [{"position": {"x": i, "y": 2, "width": 30, "height": 40}}], "singleVisual": single}
            containers.append({"x": 99, "config": json.dumps(config), "filters": json.dumps([card(*f, key="expression") for f in own])})
        sections.append({"name": page, "displayName": page.title(), "ordinal": at, "width": 800, "visualContainers": containers, "filters": json.dumps([card(*f, key="expression") for f in PAGE_FILTERS[page]])})
    return json.dumps({"sections": sections[::-1], "filters": json.dumps([card(*f, key="expression") for f in REPORT_FILTERS])}).encode()


def packed(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n, t in entries:
            z.writestr(n, t)
    return out.getvalue()


def raw_of(spark, files):
    return spark.createDataFrame([("R", p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in files.items()], "project string, path string, content binary")


@pytest.fixture(scope="module")
def forms(spark):
    layout = packed([("Report/Layout", b"\xff\xfe" + as_document().decode().encode("utf-16-le")), ("Other", b"x" * 100)])
    return [raw_of(spark, as_folders()), raw_of(spark, {"R.Report/report.json": as_document()}), D.expanded(raw_of(spark, {"R.pbit": layout}))]


@pytest.mark.parametrize("what", ["pages", "visuals", "fields", "filters", "slicers", "contexts", "issues"])
def test_the_forms_of_one_report_agree(forms, what):
    read = {"contexts": lambda r: C.visual_contexts(R.visuals(r), R.filters(r), R.slicers(r)), "issues": lambda r: R.issues(r)}.get(what) or getattr(R, what)
    folders, document, archive = [sorted(map(repr, read(r).collect())) for r in forms]
    assert folders == document == archive and (folders or what == "issues")


def test_contexts_of_a_report(forms):
    got = {r.visual: (r.conditions, r.reason) for r in C.visual_contexts(R.visuals(forms[0]), R.filters(forms[0]), R.slicers(forms[0])).collect()}
    shared = ["Sales[Kept] in (true)", "Area[Name] in ('north')"]
    assert got["sales"] == (shared + ["Product[Kind] in ('a', 'b')", "Date[Year] in (2025)"], None)
    assert got["year"] == (shared, None) and got["lines"] == (shared[:1], None)


def test_unreadable_layers_refuse(spark):
    files = as_folders()
    at = "R.Report/definition/pages/overview/visuals/year/visual.json"
    visual = json.loads(files[at])
    visual["visual"]["objects"]["general"][1]["properties"]["filter"]["filter"]["Where"] = [{"Condition": {"Odd": {"a": {"SourceRef": {"Source": "x"}}}}}]
    raw = raw_of(spark, files | {at: json.dumps(visual)})
    got = {r.visual: (r.conditions, r.reason) for r in C.visual_contexts(R.visuals(raw), R.filters(raw), R.slicers(raw)).collect()}
    assert got["sales"] == ([], "slicer year could not be read") and got["year"][1] is None and got["lines"][1] is None
    assert [r.unread for r in R.slicers(raw).where("visual = 'year'").collect()] == [json.dumps([{"Condition": {"Odd": {"a": {"SourceRef": {"Entity": "Date"}}}}}])]
    assert [(r.page, r.visual, r.message) for r in R.issues(raw).collect()] == [("overview", "year", "an unknown condition in the selection")]


# ------------------------------------------------------------------ broken parts


@pytest.mark.parametrize("field, name", [("5", None), ("[1]", None), ('"x"', None), ("[]", None), ("{}", None), ("null", None), ('{"Column": {"Property": "a", "Expression": 5}}', "Column"), ('{"Column": 5}', "Column"), ('{"Measure": {"Property": 3}, "A": 1}', "A"), ('{"Aggregation": {"Expression": [1]}}', "Aggregation"), ('{"HierarchyLevel": {"Expression": {"Hierarchy": "h"}}}', "HierarchyLevel")])
def test_any_json_may_stand_for_a_field(field, name):
    found = E.field_or_mark(json.loads(field), {})
    assert found is None if name is None else (found[0], found[2]) == ("", "unknown") and found[1].startswith(name + " ")


@pytest.mark.parametrize("query", ["5", "[]", '"x"', "{}", '{"Where": []}', '{"Where": 5}', "null"])
def test_no_condition(query):
    assert set(E.read_query(query).values()) == {None}


@pytest.mark.parametrize("where", [[5], [{"Condition": 5}], [{"Condition": {"In": 5}}], [{"Condition": {"In": {"Expressions": [], "Values": []}}}], [{"Condition": {"In": {"Expressions": [column("T", "a")], "Values": [[{"Literal": 5}]]}}}], [{"Condition": {"In": {"Expressions": [column("T", "a")], "Values": [[{"Literal": {"Value": "1"}}, 2]]}}}], [{"Condition": {"Comparison": {"ComparisonKind": [1]}}}], [{"Condition": {"Not": 7}}], [{"Condition": {"In": {"Expressions": 1, "Table": {"SourceRef": {"Source": "q"}}}}}]])
def test_conditions_of_unknown_forms_are_kept(where):
    read = E.read_query(json.dumps({"From": [5, {"Name": 3}], "Where": where}))
    assert json.loads(read["unread"]) == where and read["condition"] is None


def test_deep_json_is_no_crash():
    assert E.read_query('{"Where": [{"Condition": ' + '{"Not": {"Expression": ' * 60_000 + "1" + "}}" * 60_000 + "}]}")["condition"] is None


def test_broken_files_and_parts_are_told(spark):
    base = "R.Report/definition/"
    files = as_folders() | {
        base + "pages/pages.json": '{"pageOrder": ["details", 5]}',
        base + "pages/overview/visuals/area/visual.json": b"\xff\xfe{",
        base + "pages/overview/visuals/year/visual.json": '{"name": "year", "position": 7, "visual": [1]}',
        base + "pages/details/visuals/lines/visual.json": json.dumps({"name": "lines", "position": {"x": 1, "y": 1, "width": 1, "height": 1}, "visual": {"query": {"queryState": {"A": 5, "B": {"projections": 5}, "C": {"projections": [5, {"field": [1]}]}}}}, "filterConfig": {"filters": {"a": 1}}}),
    }
    raw = raw_of(spark, files)
    got = sorted((r.page or "", r.visual or "", r.message) for r in R.issues(raw).collect())
    assert got == [("", "", "the page order is not a list of names"), ("details", "lines", "no field in role C"), ("details", "lines", "no field in role C"), ("details", "lines", "no list of fields in role B"), ("details", "lines", "the filters are not a list"), ("overview", "area", "not a JSON object"), ("overview", "year", "the position is not complete")]
    assert [(r.page, r.ordinal) for r in R.pages(raw).orderBy("ordinal").collect()] == [("details", 0), ("overview", 1)]
    assert sorted(r.visual for r in R.visuals(raw).collect()) == ["lines", "sales"]


def test_broken_documents_are_told(spark):
    doc = {"sections": [{"displayName": "unnamed"}, {"name": "p", "ordinal": "first", "visualContainers": [5, {"config": "{"}, {"config": json.dumps({"singleVisual": {}})}, {"x": 1, "y": 1, "width": 1, "height": 1, "config": json.dumps({"name": "v", "singleVisual": {"projections": {"A": [{"queryRef": "gone"}, 5]}, "prototypeQuery": 3}})}], "filters": "{"}, 8], "filters": "[]"}
    raw = raw_of(spark, {"R.Report/report.json": json.dumps(doc), "S.Report/report.json": '{"sections": {}}'})
    got = sorted((r.page or "", r.visual or "", r.message) for r in R.issues(raw).collect())
    assert got == [("", "", "a document without a list of sections"), ("", "", "section 0 has no name"), ("", "", "section 2 has no name"), ("p", "", "the filters are not a list"), ("p", "v", "no field in role A"), ("p", "v", "no field in role A"), ("p", "visualContainers[0]", "the configuration is not a JSON object"), ("p", "visualContainers[1]", "the configuration is not a JSON object"), ("p", "visualContainers[2]", "a visual without a name")]


def test_broken_archives_are_told(spark):
    good = packed([("Report/Layout", as_document().decode().encode("utf-16-le"))])
    odd = bytearray(good)
    odd[odd.index(b"PK\x01\x02") + 10] = 99  # a compression that nobody has
    locked = bytearray(good)
    locked[locked.index(b"PK\x01\x02") + 8] |= 1  # said to be encrypted
    cut = bytearray(good)
    cut[60:80] = b"\x00" * 20
    files = {"good.pbit": good, "odd.pbit": bytes(odd), "locked.pbit": bytes(locked), "cut.pbit": bytes(cut), "none.pbit": b"no zip", "bare.pbit": packed([("DataModelSchema", b"{\x00}\x00")]), "out.pbit": packed([("../x", b""), ("Report/Layout", b"")]), "half.pbit": packed([("Report/Layout", b"{\x00}")])}
    got = {r.file: r.message for r in R.archive_issues(raw_of(spark, files)).collect()}
    assert set(got) == set(files) - {"good.pbit"} and got["bare.pbit"] == "no Report/Layout in the archive" and got["out.pbit"] == "an entry leaves the archive"


def test_large_entries_are_refused(monkeypatch):
    z = packed([("Report/Layout", "x".encode("utf-16-le") * 5000), ("DataModelSchema", "y".encode("utf-16-le") * 5000)])
    assert [len(data) for _, data in D._entries(z)] == [5000, 5000]
    monkeypatch.setattr(D, "CHUNK", 7)
    assert [len(data) for _, data in D._entries(z)] == [5000, 5000]
    for name in ("MAX_ENTRY", "MAX_TOTAL"):
        with monkeypatch.context() as m:
            m.setattr(D, name, 9_999)
            with pytest.raises(ValueError):
                list(D._entries(z))


# ------------------------------------------------------------------ renames inside conditions


def some_condition(rng, depth=0):
    field = lambda: K.Field(rng.choice("ABC"), rng.choice("xyz"))
    kind = rng.randrange(6 if depth < 4 else 3)
    if kind == 0:
        n = rng.randint(1, 2)
        return K.In(tuple(field() for _ in range(n)), tuple(tuple(rng.choice([1, 2.5, "t", True, None]) for _ in range(n)) for _ in range(rng.randint(1, 3))))
    if kind == 1:
        return K.Comparison(field(), rng.choice(["=", ">", "<="]), rng.choice([1, "a", None]))
    if kind == 2:
        return K.TopN(field(), 3, "", True, field(), rng.choice([None, "Sum"]))
    if kind == 3:
        return K.Not(some_condition(rng, depth + 1))
    return K.Both(tuple(some_condition(rng, depth + 1) for _ in range(rng.randint(1, 3))), rng.choice(["and", "or"]))


@pytest.mark.parametrize("by", [[], ["project"]])
def test_renames_inside_trees(spark, by):
    rng = random.Random(11)
    conditions = [some_condition(rng) for _ in range(150)]
    renames = {p: {(t, n): (t + "'", n * 2) for t in "ABC" for n in "xyz" if rng.random() < 0.5} | {("A", "x"): ("B", "y"), ("B", "y"): ("C", "z")} for p in "pq"}
    fields = lambda c: [(f.table, f.name) for f in dict.fromkeys(K.fields_of(c))]
    rows = [(i, "pq"[i % 2], K.as_tree(c), K.rendered(c), fields(c)) for i, c in enumerate(conditions)] + [(900, "p", None, None, None)]
    df = spark.createDataFrame(rows, "id int, project string, tree string, condition string, fields array<struct<table:string,name:string>>")
    moves = [(p, *k, *v) for p, m in renames.items() if by or p == "p" for k, v in m.items()]
    got = {r.id: r for r in C.renamed_conditions(df, spark.createDataFrame(moves + moves[:3], "project string, old_table string, old_name string, new_table string, new_name string"), by).collect()}
    assert len(got) == len(rows) and got[900].tree is None
    for i, c in enumerate(conditions):
        assert K.of_tree(K.as_tree(c)) == c
        want = K.renamed(c, renames["pq"[i % 2] if by else "p"])
        assert got[i].condition == K.rendered(want) and K.of_tree(got[i].tree) == want
        assert [tuple(f) for f in got[i].fields] == fields(want)
