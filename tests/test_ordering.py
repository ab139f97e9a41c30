"""Places in large groups, and lists in parts, beside the same in plain Python."""

import json
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.ordering import positions_within, ranges
from tallyspark.operators import findings as N


@pytest.mark.parametrize("most", [0, 500, 10**6])
def test_positions_of_a_hot_group(spark, most):
    rows = spark.range(0, 3000, 1, 12).select(F.expr("CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 9 = 0 THEN NULL ELSE 'g' || id % 40 END").alias("g"), F.expr("CASE WHEN id % 50 <> 7 THEN (id * 7919) % 3001 END").alias("k"))
    got = positions_within(rows, ["g"], [F.col("k")], most=most).collect()
    order = lambda r: (r.g is not None, r.g or "", r.k is not None, r.k or 0)
    want = [(r.g, r.k, n) for _, rs in groupby(sorted(rows.collect(), key=order), key=lambda r: r.g) for n, r in enumerate(rs, 1)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("k", ["id", "1"])
def test_a_hot_group_spans_tasks(spark, k):
    """Also where all of its rows are equal in order."""
    rows = spark.range(0, 20000, 1, 8).select(F.lit(1).alias("g"), F.expr(k).alias("k"))
    placed = positions_within(rows, ["g"], [F.col("k")], most=1000)
    assert placed.select("position").distinct().count() == 20000 and placed.agg(F.max("position")).first()[0] == 20000
    if k == "id":
        assert placed.where("position = k + 1").count() == 20000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes become one partition again
    try:
        dealt = ranges(rows, ["g"], ["k"]).groupBy("_range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) >= 4 and max(r["count"] for r in dealt) < 10_000


def test_one_key_of_all_findings_is_numbered(spark):
    rows = spark.range(0, 300, 1, 4).select(F.lit("r").alias("run"), F.lit("p").alias("path"), F.lit("page").alias("category"), F.lit("added").alias("change"), F.expr("'m' || id % 7").alias("message"), F.expr("CAST(id AS STRING)").alias("note"))
    few = {r.note: r.key for r in N.numbered(N.completed(rows), ["run"]).collect()}
    many = {r.note: r.key for r in N.numbered(N.completed(rows.repartition(5)), ["run"], most=20).collect()}
    assert few == many and len(set(many.values())) == 300 and many["0"] == "page:page:added:p"


def test_positions_of_nothing_and_of_all(spark):
    empty = spark.createDataFrame([], "k int")
    equal = spark.createDataFrame([(1,), (1,), (1,)], "k int")
    for most in (0, 2, 9):
        assert positions_within(empty, [], [F.col("k")], most=most).collect() == []
        assert sorted(r.position for r in positions_within(equal, [], [F.col("k")], most=most).collect()) == [1, 2, 3]


def rows_of_findings(spark):
    rows = [(n % 2, f"p{n:03d}", "page", "added", "info", None if n % 3 else f"m{n}") for n in range(25)]
    return spark.createDataFrame(rows, "run int, path string, category string, change string, severity string, message string")


def test_documents_in_parts(spark):
    docs = N.documents(rows_of_findings(spark).drop("severity"), ["run"], 5).orderBy("run", "part").collect()
    assert [(d.run, d.part, len(json.loads(d.document)["findings"])) for d in docs] == [(0, 0, 5), (0, 1, 5), (0, 2, 3), (1, 0, 5), (1, 1, 5), (1, 2, 2)]
    paths = [f["path"] for d in docs if d.run == 0 for f in json.loads(d.document)["findings"]]
    assert paths == [f"p{n:03d}" for n in range(0, 25, 2)]


def test_markdown_ends_at_its_limit(spark):
    line = len("- info: p000 added\n")
    found = rows_of_findings(spark)
    for limit, shown in ((10, 0), (len("\n## page\n\n") + line * 3 + 1, 3), (10_000, 13)):
        r = N.markdown(found, ["run"], limit).where("run = 0").first()
        assert (r.shown, r.more, r.text.count("\n- ") + r.text.startswith("- ")) == (shown, 13 - shown, shown)


def test_markdown_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, "page", "added", "info"), (1, "a", None, None, None)], "run int, path string, category string, change string, severity string")
    r = N.markdown(rows, ["run"]).first()
    assert (r.text, r.shown, r.more) == ("\n## \n\n- : a \n\n## page\n\n- info:  added\n", 2, 0)


def test_over_projects(spark):
    runs = spark.createDataFrame([("b", "changed"), ("a", "added"), ("c", "changed")], "path string, status string")
    found = spark.createDataFrame([("b", "critical"), ("b", "info"), ("a", "critical")], "project string, severity string")
    rows = {r.position: r for r in N.over_projects(runs, found).collect()}
    assert [(rows[n].path, rows[n].critical, rows[n].info) for n in range(4)] == [(None, 1, 1), ("a", 0, 0), ("b", 1, 1), ("c", 0, 0)]
    assert json.loads(rows[2].document) == {"path": "b", "status": "changed", "severity_counts": {"critical": 1, "warning": 0, "info": 1}}
    assert N.over_projects(runs.limit(0), found).select("position", "critical").collect() == [(0, 0)]


def test_view_order(spark):
    pages = spark.createDataFrame([("r", "a", 1, "removed"), ("r", "b", 1, "added"), ("r", "c", 0, "removed"), ("r", "d", 1, "modified")], "report string, name string, ordinal int, status string")
    assert [r.name for r in N.in_view_order(pages, ["report"], "ordinal").orderBy("position").collect()] == ["c", "b", "d", "a"]
    assert [r.name for r in N.in_view_order(pages, ["report"]).orderBy("position").collect()] == ["a", "b", "c", "d"]
