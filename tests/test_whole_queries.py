"""The queries over whole tables, beside brute force on the smallest tables."""

import hashlib
from collections import Counter
from pathlib import Path

import pytest

from tallyspark.jobs import catalog
from tallyspark.jobs.definition_queries import findings

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="the given tables are not here")


def brute_changes(docs):
    old = {(r.source, str(r.doc_id)): r.text for r in docs if r.doc_id % 13}
    new = {}
    for r in docs:
        if r.doc_id % 17:
            name = f"new {r.doc_id}" if r.doc_id % 7 == 0 else str(r.doc_id)
            new[r.lang if r.doc_id % 5 == 0 else r.source, name] = r.text + "!" if r.doc_id % 11 == 0 else r.text
    unparsed = {(r.source, str(r.doc_id)) for r in docs if r.doc_id % 19 == 0}
    path = lambda k: f"{k[0]}[{k[1]}]"
    out = [(path(k), "modified", old[k], new[k]) for k in old if k in new and old[k] != new[k]]
    gone, come = {k: x for k, x in old.items() if k not in new and k not in unparsed}, {k: x for k, x in new.items() if k not in old and k not in unparsed}
    for change, part in (("renamed", 0), ("moved", 1)):
        key = lambda k, x: (k[part], x)  # noqa: B023, E731
        ends = [Counter(key(k, x) for k, x in side.items()) for side in (gone, come)]
        at = {key(k, x): k for k, x in come.items()}
        for k, x in list(gone.items()):
            if ends[0][key(k, x)] == ends[1][key(k, x)] == 1:
                to = at[key(k, x)]
                out.append((path(to), change, k[1] if change == "renamed" else path(k), to[1] if change == "renamed" else path(to)))
                del gone[k], come[to]
    return out + [(path(k), "removed", x, "") for k, x in gone.items()] + [(path(k), "added", "", x) for k, x in come.items()]


def test_all_measures_by_their_whole_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    md5 = lambda x: hashlib.md5((x or "").encode()).hexdigest()
    got = sorted(map(tuple, catalog.QUERIES["measures_changed"](spark, SMALL).collect()))
    assert got == sorted((p, c, md5(a), md5(b)) for p, c, a, b in brute_changes(docs))


def test_all_rows_and_runs(spark):
    orders, found = spark.read.parquet(f"{SMALL}/orders.parquet").count(), findings(spark, SMALL).count()
    r = catalog.QUERIES["compare_other_kinds"](spark, SMALL).first()
    assert (r.rows_old, r.rows_new) == (orders, orders)
    assert catalog.QUERIES["findings_masked"](spark, SMALL).count() == found
    rows = catalog.QUERIES["findings_explained"](spark, SMALL)
    assert rows.count() == found and rows.select("run").distinct().count() == findings(spark, SMALL).select("run").distinct().count()
