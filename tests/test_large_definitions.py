"""What keeps definition files linear: rows dealt out, archives opened once, texts parsed once."""

import io
import json
import re
import zipfile
from pathlib import Path

import pytest

from tallyspark.jobs import definition_queries as Q
from tallyspark.operators import contexts as C
from tallyspark.sources import definitions as D
from tallyspark.sources import documents as DOC
from tallyspark.sources import reports as R

SMALL = "/root/testdata/sf0.001"
RAW = "project string, path string, content binary"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def archive(*names):
    at = io.BytesIO()
    with zipfile.ZipFile(at, "w") as z:
        for name in names:
            z.writestr(name, "{}".encode("utf-16-le"))
    return at.getvalue()


def test_archives_are_opened_once(spark):
    rows = [("p", "a.pbit", archive("Report/Layout")), ("p", "b.pbit", archive("DataModelSchema")), ("p", "b.pbit", archive("Other")), ("p", "c.pbit", b"none"), ("p", "d.pbit", archive("../x")), ("p", "e.json", b"{}"), (None, "c.pbit", b"none")]
    found = R.archive_issues(spark.createDataFrame(rows, RAW))
    assert len(re.findall(r"MapInArrow|MapInPandas", plan(found).split("Initial Plan")[0])) == 1
    got = sorted(((r.project or "-", r.file, r.message) for r in found.collect()))
    none, bad = "no Report/Layout in the archive", "File is not a zip file"
    assert got == [("-", "c.pbit", bad), ("p", "b.pbit", none), ("p", "b.pbit", none), ("p", "c.pbit", bad), ("p", "d.pbit", "an entry leaves the archive")]


def test_rows_leave_python_in_batches():
    schema = D.pa.schema([("a", D.pa.string()), ("b", D.pa.binary())])
    many = list(D._in_batches((("x", b"y") for _ in range(25_000)), schema))
    assert [b.num_rows for b in many] == [10_000, 10_000, 5_000]
    assert [b.num_rows for b in D._in_batches((("x", bytes(3 << 20)) for _ in range(4)), schema)] == [2, 2]


def test_filters_parse_nothing_again(spark):
    raw = spark.createDataFrame([("p", "p/definition/pages/a/visuals/v/visual.json", b"{}")], RAW)
    for df in (R.visuals(raw), R.pages(raw)):
        filters = [f for f in re.findall(r"Filter .*", plan(df)) if "visualType" in f or "sections" in f or "pageOrder" in f or "_box" in f]
        assert filters and not any(re.search(r"from_json|parse_json", f) for f in filters)


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="the given tables are not here")
def test_few_splits_are_dealt_out(spark):
    for raw in (Q._single_documents(spark, SMALL), Q._broken_files(spark, SMALL), Q._model_json(spark, SMALL)):
        assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_visuals_of_one_document_go_to_all_cores(spark):
    boxes = ",".join('{"x": 1, "y": 2, "width": 3, "height": 4, "config": "{\\"name\\": \\"v%d\\"}"}' % i for i in range(200))
    text = '{"sections": [{"name": "a", "visualContainers": [%s]}]}' % boxes
    raw = spark.createDataFrame([("p", "p/report.json", text.encode())], RAW).coalesce(1)
    found = R._document_visuals(raw).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(found) == 200 and sum(n > 0 for n in found) >= spark.sparkContext.defaultParallelism and max(found) < 100


def test_contexts_as_texts_are_those_of_lists(spark):
    """Slicers without conditions, of one name twice, unreadable ones, pages with one slicer or none; and no row holds a list of its page's slicers."""
    names = ["a", "b", "c", "é", "z"]
    visuals = spark.createDataFrame([("p", page, v) for page in ("one", "two", "three", "none", "odd", "odds") for v in names], "project string, page string, visual string")
    filters = [("p", "report", None, None, 0, "f", "R", ["r1", "r2"], None), ("p", "page", "two", None, 0, "f", "P", ["p"], None), ("p", "visual", "two", "c", 1, "f", "V", ["v"], None), ("p", "visual", "three", "b", 0, "bad", None, None, "x")]
    filters = spark.createDataFrame(filters, "project string, level string, page string, visual string, idx int, name string, condition string, parts array<string>, unread string")
    chosen = [("one", "c", ["s"], None), ("two", "a", ["sa", "t"], None), ("two", "b", [], None), ("two", "é", ["sé"], None), ("two", "z", ["sz"], None), ("two", "z", ["sz2"], None), ("three", "a", ["sa"], None), ("three", "c", [], None)]
    chosen += [("odd", "a", ["sa"], None), ("odd", "b", None, "x"), ("odds", "a", None, "x"), ("odds", "z", None, "y"), ("none", "b", None, None)]
    slicers = spark.createDataFrame([("p", page, v, None if parts is None else "and".join(parts) or "all", parts, bad) for page, v, parts, bad in chosen], "project string, page string, visual string, condition string, parts array<string>, unread string")
    listed = {(r.page, r.visual): (" and ".join(r.conditions), r.reason) for r in C.visual_contexts(visuals, filters, slicers).collect()}
    found = C.context_texts(visuals, filters, slicers)
    assert {(r.page, r.visual): (r.conditions, r.reason) for r in found.collect()} == listed and len(listed) == 30
    joins = [line for line in plan(found).splitlines() if "Join" in line and "_slicers" in line]
    assert not joins


def test_documents_are_taken_apart_in_bounded_rows(spark, monkeypatch):
    """Texts stand as they are in pieces, broken documents give none, and no row holds a list of sections or visuals."""
    boxes = [{"x": 1, "y": 2, "width": 3, "height": 4, "config": json.dumps({"name": f"v{i}", "t": "é]}\\\"" * 9})} for i in range(50)]
    good = json.dumps({"filters": "[]", "sections": [{"name": "a", "visualContainers": boxes}, None, "{}", {"visualContainers": boxes[:1]}, {"name": 5, "visualContainers": [None, 7, "x"]}]}, ensure_ascii=False, indent=1)
    got = list(DOC.pieces(("﻿" + good).encode()))
    assert json.loads(got[0][5]) == {"filters": "[]", "sections": []}
    assert [(r[1], r[2], r[5] and json.loads(r[5])) for r in got if r[0] == "section"] == [(5, 0, {"name": "a", "visualContainers": []}), (5, 1, None), (5, 2, {}), (5, 3, {"visualContainers": []}), (5, 4, {"name": 5, "visualContainers": []})]
    assert [json.loads(r[5]) for r in got if r[0] == "container" and r[2] == 0] == boxes and max(len(r[5] or "") for r in got) < 300
    assert [r[2:6] for r in got if r[0] == "container" and r[2] == 4] == [(4, 0, '{"name": 5}', None), (4, 1, '{"name": 5}', "7"), (4, 2, '{"name": 5}', "x")]
    none = [("document", None, None, None, None, None)]
    for bad in (b"", b"\n{}", b"\xff", b"[1]", b'{"a": 1', b'{"a": 1, "a": 2}', b'{"sections": [{"visualContainers": [{"x": NaN}]}]}', b'{"sections": [{"visualContainers": [1,]}]}', b'{"sections": [1 2]}', b'{"sections" []}', b'{5: 1}'):
        assert list(DOC.pieces(bad)) == none, bad
    # An archive's layout larger than one entry may be is read all the same, since it is no row; what is larger than all may be is not.
    at = io.BytesIO()
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("Report/Layout", good.encode("utf-16-le"))
    batch = lambda: iter([D.pa.RecordBatch.from_arrays([D.pa.array(["p"]), D.pa.array(["a.pbit"]), D.pa.array([at.getvalue()])], names=["project", "path", "content"])])
    monkeypatch.setattr(D, "MAX_ENTRY", 100)
    assert [r[3:] for r in DOC._all_pieces(batch(), True)] == got
    assert R.pages(R.taken_apart(spark.createDataFrame([("p", "a.pbit", at.getvalue())], RAW), archives=True)).count() == 2
    monkeypatch.setattr(D, "MAX_TOTAL", 100)
    assert list(DOC._all_pieces(batch(), True)) == []
