"""The comparison core on small results with known answers."""

import pytest

from tallyspark.operators.compare import Tolerance, attribute, compare_tables, paired_values, partly_compared
from pyspark.sql import functions as F

KEYED = "month string, total double"


def frames(spark, old, new, ddl=KEYED):
    return spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl)


def summary(spark, old, new, ddl=KEYED, keys=("month",), values=("total",), **options):
    s, f = compare_tables("p/v", *frames(spark, old, new, ddl), list(keys), list(values), **options)
    return s.first(), f.collect()


def test_identical(spark):
    s, f = summary(spark, [("2025-01", 100.0), ("2025-02", 50.0)], [("2025-02", 50.0), ("2025-01", 100.0)])
    assert (s.status, s.rows_matched, s.rows_differing, s.max_abs_delta, f) == ("same", 2, 0, 0.0, [])


def test_value_changed(spark):
    s, f = summary(spark, [("2025-01", 100.0), ("2025-02", 50.0)], [("2025-02", 50.0), ("2025-01", 120.0)], show_values=True)
    assert (s.status, s.rows_differing, s.max_abs_delta) == ("different", 1, 20.0)
    assert [(x.path, x.change, x.old, x.new) for x in f] == [("p/v/data/month=2025-01/total", "modified", "100", "120")]


@pytest.mark.parametrize("absolute, relative, status", [(0.0, 1e-9, "different"), (0.5, 0.0, "same"), (0.0, 0.01, "same"), (0.0, 0.001, "different")])
def test_tolerance(spark, absolute, relative, status):
    s, _ = summary(spark, [("a", 100.0)], [("a", 100.4)], tolerance=Tolerance(absolute, relative))
    assert s.status == status


@pytest.mark.parametrize("bad", [(-1.0, 0.0), (float("nan"), 0.0), (0.0, float("inf"))])
def test_bad_tolerance(bad):
    with pytest.raises(ValueError):
        Tolerance(*bad)


def test_one_sided_rows(spark):
    s, f = summary(spark, [("01", 1.0), ("03", 1.0)], [("01", 1.0), ("02", 1.0)], show_values=True)
    assert (s.rows_matched, s.rows_only_old, s.rows_only_new, s.max_abs_delta) == (1, 1, 1, 0.0)
    assert [(x.change, x.path) for x in f] == [("added", "p/v/data/month=02"), ("removed", "p/v/data/month=03")]


def test_blanks_and_text(spark):
    s, f = summary(spark, [("Bikes", "high", None), ("Clothing", "low", 5.0)], [("Bikes", "high", None), ("Clothing", "LOW", None)], "c string, label string, v double", ("c",), ("label", "v"))
    assert (s.rows_differing, len(f), s.max_abs_delta) == (1, 2, None)


def test_nan_is_blank(spark):
    s, _ = summary(spark, [("a", float("nan"))], [("a", None)])
    assert s.status == "same"


def test_card_and_renamed_value(spark):
    old, new = spark.createDataFrame([(10,)], "total long"), spark.createDataFrame([(12,)], "amount long")
    s, f = compare_tables("p/card", old, new, [], [("total", "amount")])
    assert (s.first().status, f.first().path) == ("different", "p/card/data/total/total")


def test_empty_sides(spark):
    s, f = summary(spark, [], [])
    assert (s.status, s.rows_old, s.max_abs_delta, f) == ("same", 0, None, [])
    s, f = summary(spark, [], [("a", 1.0)])
    assert (s.rows_only_new, [x.change for x in f]) == (1, ["added"])


def test_refused(spark):
    s, f = summary(spark, [("a", 1.0), ("a", 2.0)], [("a", 1.0)])
    assert (s.status, s.reason) == ("not_validated", "old result repeats a key")
    s, f = summary(spark, [("a", 1.0)], [("a", 1.0)], values=("gone",))
    assert (s.status, f[0].change) == ("not_validated", "error")
    s, _ = summary(spark, [("a", 1.0)], [("b", 1.0), ("c", 1.0)], keys=(), values=("total",))
    assert s.reason == "new result has more than one row and no keys"


def test_cap(spark):
    rows = [(f"{i:02d}", float(i)) for i in range(30)]
    s, f = summary(spark, rows, [(k, v + 1) for k, v in rows], max_findings=5)
    assert (s.rows_differing, len(f)) == (30, 5)


def test_null_keys_match_and_numeric_order(spark):
    s, f = summary(spark, [(None, 1), (9, 1), (10, 1), (2024, 1)], [(None, 1), (9, 2), (10, 2), (2024, 2)], "k long, v long", ("k",), ("v",), show_values=True)
    assert s.rows_matched == 4
    assert [x.path.split("=")[1] for x in f] == ["9/v", "10/v", "2024/v"]


def test_keys_of_other_kinds(spark):
    old, new = spark.createDataFrame([(2, 1), (None, 1)], "k long, v long"), spark.createDataFrame([("2", 1), (None, 1)], "k string, v long")
    s, _ = compare_tables("p/v", old, new, ["k"], ["v"])
    assert (s.first().rows_matched, s.first().rows_only_old, s.first().rows_only_new) == (1, 1, 1)


def test_masking_names_positions(spark):
    _, f = summary(spark, [("a", 1.0), ("b", 1.0), ("c", 1.0)], [("a", 1.0), ("b", 2.0), ("d", 1.0)])
    assert [(x.path, x.old) for x in f] == [("p/v/data/row 2/total", "(masked)"), ("p/v/data/row 3", None), ("p/v/data/row 4", None)]


@pytest.mark.parametrize("values, verdict", [((100, 120, 120), "report"), ((100, 100, 120), "model"), ((100, 110, 120), "both"), ((100, 100, 100), "unknown")])
def test_attribution(spark, values, verdict):
    sides = [spark.createDataFrame([("a", v)], "k string, v long") for v in values]
    assert attribute(*sides, ["k"], ["v"]).first().attribution == verdict


def test_attribution_below_tolerance(spark):
    sides = [spark.createDataFrame([("a", v)], "k string, v long") for v in (100, 105, 110)]
    assert attribute(*sides, ["k"], ["v"], Tolerance(5.0, 0.0)).first().attribution == "unknown"


def test_partly_compared(spark):
    both, only_old, only_new = paired_values(["a", "b"], ["a", "c", "d"], {"b": "c"})
    assert (both, only_old, only_new) == ([("a", "a"), ("b", "c")], [], ["d"])
    s, _ = compare_tables("p/v", *frames(spark, [("a", 1.0)], [("a", 1.0)]), ["month"], ["total"])
    assert partly_compared(s, F.lit("d")).first().status == "not_validated"
    assert partly_compared(s, F.lit("")).first().status == "same"
