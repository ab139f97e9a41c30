"""Pairing, change reports, findings, snapshots and definition files on small inputs with known answers."""

import io
import json
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import values as X
from tallyspark.operators import changes as G
from tallyspark.operators import findings as N
from tallyspark.operators import pairing as P
from tallyspark.operators import snapshot as S
from tallyspark.sources import definitions as D
from tallyspark.sources import fields as E
from tallyspark.sources import reports as R


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


# ------------------------------------------------------------------ pairing

VISUAL = dict(type="bar", title="A", fields=["x", "y"], x=0.0, y=0.0, width=100.0, height=100.0, page_width=1000.0, page_height=500.0)


@pytest.mark.parametrize("change, score", [({}, 1.0), ({"type": "line"}, 0.7), ({"title": "B"}, 0.8), ({"fields": ["z"]}, 0.7), ({"x": 0.0, "y": 0.0, "width": 200.0, "height": 200.0, "page_width": 2000.0, "page_height": 1000.0}, 1.0)])
def test_similarity(spark, change, score):
    side = lambda v, p: {k: (F.array(*map(F.lit, x)) if k == "fields" else F.lit(x)) for k, x in v.items()}
    assert spark.range(1).select(P.similarity(side(VISUAL, "o"), side(VISUAL | change, "n"))).first()[0] == score


def test_greedy_ties_and_threshold(spark):
    pairs = spark.createDataFrame([("p", "a", "x", 0.9), ("p", "a", "y", 0.9), ("p", "b", "x", 0.9), ("p", "b", "y", 0.9)], "page string, old string, new string, score double")
    assert sorted((r.old, r.new) for r in P.greedy(pairs, ["page"]).collect()) == [("a", "x"), ("b", "y")]
    with pytest.raises(ValueError):
        P.candidates(pairs, pairs, ["page"], "old", 1.5)


def test_repeated_keys_never_pair(spark):
    old = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, name string")
    new = spark.createDataFrame([(5, "a"), (6, "b"), (7, None)], "id int, name string")
    pairs, left, right = P.pair_by_key(old, new, ["name"], ["id"])
    assert sorted((r.old_id, r.new_id) for r in pairs.collect()) == [(3, 6), (4, 7)]
    assert sorted(r.id for r in left.collect()) == [1, 2] and [r.id for r in right.collect()] == [5]
    assert sorted(r.id for r in P.unique_by(old, ["name"]).collect()) == [3, 4]


# ------------------------------------------------------------------ change reports


def test_measures(spark):
    ddl = "table string, name string, expression string"
    old = spark.createDataFrame([("Sales", "Total Sales", "SUM(a)"), ("Sales", "Margin %", "m"), ("Sales", "Gone", "g"), ("Old", "Moved", "v"), ("Sales", "Broken", "b")], ddl)
    new = spark.createDataFrame([("Sales", "Total Sales", "SUM(a)>0"), ("Sales", "Gross Margin %", "m"), ("Sales", "Come", "c"), ("New", "Moved", "v")], ddl)
    found, renames = G.measure_changes(old, new, spark.createDataFrame([("Sales", "Broken")], "table string, name string"))
    assert sorted((r.change, r.path) for r in found.collect()) == [("added", "Sales[Come]"), ("modified", "Sales[Total Sales]"), ("moved", "New[Moved]"), ("removed", "Sales[Gone]"), ("renamed", "Sales[Gross Margin %]")]
    assert {(r.old_name, r.new_table, r.new_name) for r in renames.collect()} == {("Margin %", "Sales", "Gross Margin %"), ("Moved", "New", "Moved")}


def test_filter_labels_and_first_difference(spark):
    ddl = "owner string, idx int, name string, definition string, field string, filter_type string"
    side = lambda rows: G.labelled(spark.createDataFrame(rows, ddl), ["owner"], "name", "idx")
    old = side([("v", 0, "f", "a", "x", "t"), ("v", 1, "f", "b", "x", "t"), ("v", 2, None, "c", "x", "t"), ("w", 0, "g", "d", "x", "t")])
    new = side([("v", 0, "f", "a", "y", "u"), ("v", 1, "f", "B", "y", "t"), ("w", 0, "g", "d", "x", "u"), ("w", 1, "h", "e", "x", "t")])
    got = sorted((r.owner, r.path, r.change) for r in G.filter_changes(old, new, ["owner"]).collect())
    assert got == [("v", "#1", "removed"), ("v", "f", "refielded"), ("v", "f#2", "modified"), ("w", "g", "retyped"), ("w", "h", "added")]


def test_reordered_counts_paired_pages_only(spark):
    pairs = spark.createDataFrame([("r", "a", 0, 1), ("r", "b", 2, 0), ("r", "c", 5, 9)], "report string, page string, o int, n int")
    assert sorted((r.path, r.old, r.new) for r in G.reordered(pairs, ["report"], "o", "n", "page").collect()) == [("a", "1", "2"), ("b", "2", "1")]


# ------------------------------------------------------------------ findings


def test_keys_and_severity(spark):
    rows = spark.createDataFrame([("r", "p/v", "filter", "retyped", "b"), ("r", "p/v", "filter", "retyped", "a"), ("r", "m", "measure", "modified", "c")], "run string, path string, category string, change string, message string")
    got = {(r.message, r.key, r.severity) for r in N.numbered(N.completed(rows), ["run"]).collect()}
    assert got == {("a", "page:filter:retyped:p/v", "info"), ("b", "page:filter:retyped:p/v#2", "info"), ("c", "model:measure:modified:m", "critical")}


def test_vetted_uses_each_end_once(spark):
    ddl = "run int, position int, category string, old string, new string, confidence double"
    rows = [(1, 1, "page", "a", "x", 2.0), (1, 2, "page", "a", "y", 0.5), (1, 3, "page", "b", "x", 0.5), (1, 4, "page", "b", "y", -1.0), (1, 5, "page", "c", "nowhere", 0.5)]
    ends = lambda names: spark.createDataFrame([(1, "page", n) for n in names], "run int, category string, path string")
    got = N.vetted(spark.createDataFrame(rows, ddl), ends("abc"), ends("xy"), ["run"]).collect()
    assert sorted((r.position, r.confidence) for r in got) == [(1, 1.0), (4, 0.0)]


def test_gate_and_explanations(spark):
    rows = N.completed(spark.createDataFrame([("r", "p", "ai", "error", "m"), ("s", "p", "data", "error", "m")], "run string, path string, category string, change string, message string"))
    assert {r.run: r.failed for r in N.gate(rows, ["run"]).collect()} == {"r": False, "s": True}
    texts = spark.createDataFrame([("r", 1, "  "), ("r", 2, "x" * 700), ("r", 3, "late")], "id string, position int, text string")
    assert [len(r.explanation) for r in N.with_explanations(rows.withColumn("id", F.col("run")).where("run = 'r'"), texts).collect()] == [600]


def test_units_and_runs(spark):
    paths = {"a/b.Report/x/y.json": "a/b.Report", "c.SemanticModel/z": "c.SemanticModel", "d/e.PBIT": "d/e.PBIT", "f/g.json": None}
    assert all(spark.range(1).select(X.unit_of_file(F.lit(p))).first()[0] == u for p, u in paths.items())
    reports = spark.createDataFrame([("r1", "m1"), ("r2", None)], "report string, model string")
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    assert {(r.model, r.report) for r in S.readers(reports, models).collect()} == {("m1", "r1"), ("m1", "r2"), ("m2", "r2")}


@pytest.mark.parametrize("n, m", [(40, 3000), (3000, 40), (0, 5), (1, 1)])
def test_unknown_readers_are_dealt_out(spark, n, m):
    """No task makes more than its share of the pairs."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "30"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        models = spark.range(n).select(F.concat(F.lit("m"), "id").alias("model"))
        reports = spark.range(m).select(F.concat(F.lit("r"), "id").alias("report"), F.lit(None).cast("string").alias("model"))
        found = S.readers(reports, models, task_rows=2000)
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == n * m == found.distinct().count()
        assert n * m < 10_000 or max(tasks) < 4 * n * m / 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k in list(conf)[:2]:
            spark.conf.unset(k)


@pytest.mark.parametrize("raw, kind, value", [("2025L", "number", "2025"), ("1.50", "number", "1.5"), ("-0", "number", "0"), ("'it''s'", "text", "it's"), ("TRUE", "boolean", "true"), ("null", "null", None), ("datetime'2025-01-01'", "datetime", "2025-01-01"), ("x y", "other", "x y"), ("1E+3", "number", "1000"), ("2.50e-3D", "number", "0.0025"), (".5", "number", "0.5"), ("12.M", "number", "12"), ("-1.25E1", "number", "-12.5"), ("0E9", "number", "0"), ("1E101", "other", "1E101"), ("1E99999999", "other", "1E99999999")])
def test_literals(spark, raw, kind, value):
    assert tuple(spark.range(1).select(X.literal_kind(F.lit(raw)), X.literal_value(F.lit(raw))).first()) == (kind, value)
    one = X.read_literal(raw)
    assert one == (None if kind == "null" else value == "true" if kind == "boolean" else float(value) if kind == "number" else value)


def test_literals_are_taken_apart_once(spark):
    raw = ["2025L", "1.50D", "-0", "'it''s'", "TRUE", "null", "datetime'2025-01-01'", "x y", "1E+3", "2.50e-3D", ".5", "12.M", "1E101", "1E99999999", "datetime'a", "'a", "5L\n", "-", ".", "", "Edge", "1.5e", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    found = X.with_literals(df)
    assert sorted(map(str, found.collect())) == sorted(map(str, df.select("raw", X.literal_kind(F.col("raw")).alias("kind"), X.literal_value(F.col("raw")).alias("value")).collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE|regexp_", plan)) < 30  # several times as many, where each mention of a part takes the literal apart again


def test_floats_as_text(spark):
    numbers = [0.1, -2.5, 1e-4, 1.5e-5, 123456789.25, 1e-10, 2.5e-101, 1234567.125, 3.0, -0.0, 1e15, 12345678901234567890.0, 1e22, 9007199254740993.0, 0.30000000000000004, None, float("nan")]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r[0] for r in df.select(X.display_column(F.col("x"), df.schema["x"].dataType)).collect()] == [X.display(x) for x in numbers]


# ------------------------------------------------------------------ definition files


def raw(spark, files):
    return spark.createDataFrame([("R.Report", p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in files.items()], "project string, path string, content binary")


def test_pages_in_order(spark):
    base = "R.Report/definition/pages/"
    files = {base + "pages.json": json.dumps({"pageOrder": ["b"]}), base + "a/page.json": "﻿" + json.dumps({"name": "a", "displayName": "A"}), base + "b/page.json": json.dumps({"name": "b", "width": 10}), base + "c/page.json": "[]"}
    r = raw(spark, files)
    assert [tuple(x) for x in R.pages(r).orderBy("ordinal").collect()] == [("R.Report", "b", "b", 10.0, 720.0, 0), ("R.Report", "a", "A", 1280.0, 720.0, 1)]
    assert [x.file for x in R.issues(r).collect()] == [base + "c/page.json"]


def test_legacy_report(spark):
    config = {"name": "v", "singleVisual": {"visualType": "card", "projections": {"Values": [{"queryRef": "Sales.Amount"}]}}}
    doc = {"sections": [{"name": "s2", "ordinal": 1, "visualContainers": []}, {"name": "s1", "displayName": "First", "ordinal": 0, "visualContainers": [{"x": 1, "y": 2, "width": 3, "height": 4, "config": json.dumps(config)}]}]}
    r = raw(spark, {"R.Report/report.json": json.dumps(doc)})
    assert [(p.page, p.ordinal) for p in R.pages(r).orderBy("ordinal").collect()] == [("s1", 0), ("s2", 1)]
    v = R.visuals_with_refs(r).first()
    assert (v.page, v.visual, v.visual_type, v.refs) == ("s1", "v", "card", ["Sales.Amount"])


def test_archives(spark):
    def packed(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, t in entries:
                z.writestr(n, t.encode("utf-16-le"))
        return out.getvalue()

    r = raw(spark, {"good.pbit": packed([("DataModelSchema", '{"model": {"tables": [{"name": "T", "measures": [{"name": "m", "expression": ["a", "b"]}], "columns": [{"name": "c", "dataType": "int64"}]}]}}')]), "bad.pbit": packed([("../x", "y")]), "none.pbit": b"no zip"})
    got = D.unpacked(r)
    assert sorted((x.path, x.error is None) for x in got.collect()) == [("bad.pbit", False), ("good.pbit/DataModelSchema", True), ("none.pbit", False)]
    columns, measures = D.model_json(got.where("error IS NULL").drop("error"))
    assert [tuple(x) for x in measures.collect()] == [("R.Report", "T", "m", "a\nb")]
    assert [x.data_type for x in columns.collect()] == ["int64"]


def test_model_text(spark):
    text = "table 'My Sales'\n\tlineageTag: 1\n\n\t/// about\n\tmeasure 'Total ''x''' = SUM(a)\n\t\tformatString: 0\n\n\tmeasure Deep =\n\t\t\tVAR x = 1\n\t\t\t\tRETURN x\n\t\tformatString: 0\n\n\tmeasure Fenced = ```\n\t\t\tA\n\t\t\t\tB\n\t\t\t```\n\n\tmeasure Empty =\n\n\tcolumn Amount\n\t\tdataType: int64\n"
    got = {(r.kind, r.name): (r.table, r.value) for r in D.model_text(raw(spark, {"x.tmdl": text})).collect()}
    assert got[("measure", "Fenced")] == ("My Sales", "A\n\tB")
    assert got[("column", "Amount")] == ("My Sales", "int64")
    assert got[("issue", "Empty")][1] == "a measure without an expression"
    assert got[("measure", "Deep")][1].splitlines()[0] == "VAR x = 1"


def test_conditions_read(spark):
    query = {"From": [{"Name": "p", "Entity": "Product"}], "Where": [{"Condition": {"Not": {"Expression": {"In": {"Expressions": [{"Column": {"Expression": {"SourceRef": {"Source": "p"}}, "Property": "Category"}}], "Values": [[{"Literal": {"Value": "'Bikes'"}}]]}}}}}]}
    rows = spark.createDataFrame([(json.dumps(query),), ('{"Where": [{"Condition": {"Odd": 1}}]}',), ("{",), (None,)], "t string").select(E.read_condition(F.col("t")).alias("c")).collect()
    assert rows[0].c.condition == "not Product[Category] in ('Bikes')"
    assert [r.c.unread is not None for r in rows] == [False, True, True, False]


def test_files_are_read_by_executors(spark, tmp_path):
    f = tmp_path / "A.Report" / "definition" / "pages" / "p"
    f.mkdir(parents=True)
    (f / "page.json").write_text('{"name": "p"}')
    got = D.read_raw(spark, str(tmp_path)).collect()
    assert [(r.project, r.path) for r in got] == [("A.Report", "A.Report/definition/pages/p/page.json")]


def test_model_text_by_spaces(spark):
    """Four spaces are a level; notes count inside expressions only; lines of other objects belong to no table."""
    text = "table T\n    measure A =\n            SUM(x)\n            /// a note\n                + 1\n\n            + 2\n        formatString: 0\n    /// about\n    column C\n        dataType: string\n        /// more\n        summarizeBy: none\n    measure B = ```\n            x\n            ```\n    measure E = ```\n            open\n    partition p = m\n        mode: import\nrelationship r\n    column Stray\n"
    got = [(r.kind, r.name, r.value) for r in D.model_text(raw(spark, {"x.tmdl": text})).collect()]
    assert got == [("measure", "A", "SUM(x)\n/// a note\n    + 1\n+ 2"), ("column", "C", "string"), ("measure", "B", "x"), ("measure", "E", "```\nopen")]


def test_levels_of_hierarchies(spark):
    entity = {"SourceRef": {"Entity": "Date"}}
    plain = {"HierarchyLevel": {"Expression": {"Hierarchy": {"Expression": entity, "Hierarchy": "Calendar"}}, "Level": "Month"}}
    dated = {"HierarchyLevel": {"Expression": {"Hierarchy": {"Expression": {"PropertyVariationSource": {"Expression": entity, "Name": "Variation", "Property": "Day"}}, "Hierarchy": "Date Hierarchy"}}, "Level": "Year"}}
    broken = {"HierarchyLevel": {"Expression": {}, "Level": "Year"}}
    got = E._read_fields(*[pd.Series(x) for x in ([json.dumps(x) for x in (plain, dated, broken)], [None] * 3)])
    assert got.values.tolist()[:2] == [["Date", "Calendar.Month", "hierarchy level", None], ["Date", "Day.Date Hierarchy.Year", "hierarchy level", None]]
    assert got.kind[2] == "unknown" and got.name[2].startswith("HierarchyLevel ")


def test_ranked_filters(spark):
    column = lambda source, name: {"Column": {"Expression": {"SourceRef": {"Source": source}}, "Property": name}}
    order = {"Aggregation": {"Expression": column("s", "Amount"), "Function": 0}}

    def text(top, direction):
        query = {"From": [{"Name": "s", "Entity": "Sales"}, {"Name": "p", "Entity": "Product"}], "Select": [column("p", "Name")], "Top": top, "OrderBy": [{"Direction": direction, "Expression": order}]}
        where = {"In": {"Expressions": [column("p", "Name")], "Table": {"SourceRef": {"Source": "q"}}}}
        return json.dumps({"From": [{"Name": "q", "Expression": {"Subquery": {"Query": query}}, "Type": 2}, {"Name": "p", "Entity": "Product"}], "Where": [{"Condition": where}]})

    rows = spark.createDataFrame([(text(3, 2),), (text(5, 1),), (text(0, 2),), (text(3, 7),)], "t string").select(E.read_condition(F.col("t")).alias("c")).collect()
    assert [r.c.condition for r in rows] == ["top 3 Product[Name] by Sum(Sales[Amount])", "bottom 5 Product[Name] by Sum(Sales[Amount])", None, None]
    assert all(r.c.unread for r in rows[2:])
